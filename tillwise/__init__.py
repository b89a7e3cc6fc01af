"""tillwise: customer and sales analytics operators on Spark DataFrames."""
