"""lumigraph.sources"""
