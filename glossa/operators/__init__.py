"""Operators over DataFrames: normalising, indexing, searching, snippets, keyed state."""
