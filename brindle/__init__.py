"""brindle: an analytics library on Spark's DataFrame and SQL APIs."""
