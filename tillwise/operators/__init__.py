"""tillwise.operators"""
