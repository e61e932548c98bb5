"""massloom: spectrum-library search and ranked-retrieval evaluation as Spark jobs."""
