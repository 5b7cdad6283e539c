"""Operators for preparing large text corpora, written as Spark jobs."""
