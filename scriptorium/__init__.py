"""A text-dataset curation, evaluation and streaming-text engine on Spark."""
