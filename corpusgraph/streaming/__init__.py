"""corpusgraph.streaming"""
