"""Training-data operators for large document corpora.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries only
when it is present. Each module holds one operator; ``queries`` holds the thin
query wrappers and their SQL.
"""
