"""Training-data operators: packing, tokenizers, near duplicates, language models, privacy, nearest neighbours.

Nothing outside this subpackage imports it.
"""
