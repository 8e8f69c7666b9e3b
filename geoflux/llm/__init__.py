"""Operations for preparing training text and embeddings at corpus scale.

Nothing outside this subpackage imports it; ``queries.py`` holds the
registered queries and ``__spark_entry__.py`` adds them when it is present.
"""
