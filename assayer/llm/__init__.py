"""Training-data operators: tokenizing, packing, filtering, deduplication and formatting as Spark jobs."""
