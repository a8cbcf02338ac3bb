"""corpusgraph.plans"""
