"""brindle: a Spark-first engine for searching and analysing document-shaped tables."""
