"""Operators for training-data pipelines over documents, pages and embeddings.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
where the folder is present.
"""
