"""Graph queries on a linear reference axis, as Spark jobs."""
