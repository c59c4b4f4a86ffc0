"""lumigraph.functions"""
