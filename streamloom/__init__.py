"""Streamloom: ordered, durable record streams as Spark DataFrames."""
