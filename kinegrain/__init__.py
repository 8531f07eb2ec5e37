"""kinegrain: a Spark-first engine for physically grounded 3D-asset data."""
