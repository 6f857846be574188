"""grovekit: Spark operators for versioned, content-addressed hierarchies."""
