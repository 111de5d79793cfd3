"""Find people by what they did, on Spark: cleaning, derivation, search, ranking and facets as DataFrame jobs."""
