"""Document analytics on Spark: segmentation, ranked retrieval, answer checks, audit analytics."""
