"""Declared schemas of the pipeline's tables."""

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(c, T.IntegerType()) for c in ("top", "right", "bottom", "left")])
MEDIA = "media_id long, path string, name string, stem string, suffix string, kind string"
FRAME = "frame_path string, media_path string, frame_no int"
FACE = "face_id long, media_path string, encoding array<double>, crop_path string"
ASSIGNMENT = "face_id long, cluster_id int"
DETECTION = "media_path string, face_no int, top int, right int, bottom int, left int, area long, error string"
PERSON = "cluster_id int, name string, files array<string>, representative_face string"
CENTROID = "cluster_id int, vec array<double>"
MERGE_CANDIDATE = "id1 int, id2 int"
DECISION = "seq long, id1 int, id2 int, action string"
WORKER_RESULT = f"media_path string, encodings array<array<double>>, crop_paths array<string>, face_locations array<{BOX.simpleString()}>, processed_path string, error string"
