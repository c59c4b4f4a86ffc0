"""lumigraph.operators"""
