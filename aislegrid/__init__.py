"""Catalog, price and corpus analytics expressed on the PySpark DataFrame, SQL and Structured Streaming APIs."""
