"""silvan: histogram-based gradient-boosted trees as Spark jobs."""
