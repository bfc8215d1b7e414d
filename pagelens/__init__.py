"""Content analytics on Spark: landed pages and documents in, analysed tables out."""
