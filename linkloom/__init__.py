"""linkloom: a Spark-first engine for cross-source record linkage."""
