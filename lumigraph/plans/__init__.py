"""lumigraph.plans"""
