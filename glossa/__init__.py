"""Text-search and lexicon analytics on Spark DataFrames."""
