"""citeframe: verified document evidence, retrieval and screening as Spark jobs."""
