"""Training-data operators: ten operators over documents, embeddings and benchmark items.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""
