"""Training-data operators: ten corpus jobs over documents, pages and benchmark tables.

Nothing else in the library imports this subpackage.
"""
