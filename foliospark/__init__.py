"""Text-layer analytics on Spark: scanned-document operators as DataFrame transformations."""
