"""Training-data operators: ten independent DataFrame-to-DataFrame components.

Nothing outside this package imports it; it can be deleted without touching
the document-indexing library.
"""
