"""Document-evidence analytics on Spark: land, chunk, search, select, compute, measure."""
