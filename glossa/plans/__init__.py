"""The catalogue of registered queries with their SQL."""
