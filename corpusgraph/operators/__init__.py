"""corpusgraph.operators"""
