"""keystrata: keyed, append-only data with newest-wins reads, as plain Spark DataFrames."""
