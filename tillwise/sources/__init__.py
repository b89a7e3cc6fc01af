"""tillwise.sources"""
