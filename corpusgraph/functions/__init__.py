"""corpusgraph.functions"""
