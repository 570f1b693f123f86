"""Operators for preparing training text: sentences, alignment, names, pairs, forms, tokens, mixtures, content."""
