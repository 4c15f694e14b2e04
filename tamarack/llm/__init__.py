"""Training-data operators: token stores, tokenizers, fingerprints, quality, mixing, chat, secrets, near-duplicates.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and column names and returns DataFrames;
``queries`` binds them to the tables ``documents``, ``labels`` and ``conversations``.
"""
