"""storyloom: Spark-first operators for preparing, segmenting and quality-checking narrated serial fiction."""

__version__ = "0.1.0"
