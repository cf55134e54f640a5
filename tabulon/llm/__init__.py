"""Training-data operators: filters, joins, mixing, tokenizers, dedup and classifiers on Spark."""
