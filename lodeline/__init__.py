"""Lodeline: analytics over reasoning documents, expressed as Spark plans."""
