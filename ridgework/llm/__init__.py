"""Operators that prepare documents, pages and conversations as training data for language models."""
