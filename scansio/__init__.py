"""A Spark-first engine for approximate passage retrieval, live position tracking and corpus preparation."""
