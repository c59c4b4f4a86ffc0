"""lumigraph.streaming"""
