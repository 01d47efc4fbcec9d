"""Loomwise: item curation, similarity and selection as Spark DataFrame programs."""
