"""Spark jobs that turn collections of business documents into relational tables."""
