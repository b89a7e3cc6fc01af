"""tillwise.plans"""
