"""Training-data operators on Spark: ten numbered operators and the queries that apply them."""
