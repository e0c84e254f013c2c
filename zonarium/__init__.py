"""Zonarium: planning-rules, retrieval and corpus analytics expressed as Spark DataFrames."""
