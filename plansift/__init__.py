"""A Spark-native engine for positioned text, detections and logs."""
