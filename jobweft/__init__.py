"""jobweft: a PySpark-native analytics engine for large collections of job postings."""
