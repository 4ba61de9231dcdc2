"""lumenlake: media-library analytics, retrieval and curation operators for PySpark."""
