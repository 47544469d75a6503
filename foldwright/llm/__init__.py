"""Operators of a training-data pipeline over web pages, documents, vectors and conversations."""
