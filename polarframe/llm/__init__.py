"""Operators for training-data pipelines over documents, labels and embeddings."""
