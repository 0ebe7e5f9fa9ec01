"""Training-data operators: mixing, quality, licences, near copies, secrets, tokens, embeddings, language models.

Nothing outside this subpackage imports it.  Each module holds one operator with its own
general interface; ``registry`` has the thin queries over the shared tables.
"""
