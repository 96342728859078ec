"""Operators for preparing training data: tokenizing, mixing, language and quality scoring, extraction, joins."""
