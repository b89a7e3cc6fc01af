"""tillwise.functions"""
