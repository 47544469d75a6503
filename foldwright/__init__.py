"""foldwright: leakage-aware classification analytics as Spark jobs."""
