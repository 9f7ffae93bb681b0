"""Corpus curation on Spark: DataFrame-to-DataFrame operators for text and code corpora."""
