"""A lakehouse analytics engine whose operators are Spark plans."""
