"""Retrieval over structured text corpora as lazy, batched DataFrame plans."""
