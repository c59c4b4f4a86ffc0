"""lumigraph: media-identity analytics and training-data operators on PySpark."""
