"""Operators that prepare crawled and written text for language-model training."""
