"""JSON scalar functions: a strict Python lane for exact results, and native expressions where Spark's own agree."""
