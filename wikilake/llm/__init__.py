"""Training-data operators: text quality, near duplicates, tokens, vectors and mixing.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its queries
only where it can be imported.
"""
