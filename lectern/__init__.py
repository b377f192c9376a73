"""A Spark-native document-library engine.

Layout: ``sources`` read raw books, ``functions`` are Column -> Column text
primitives, ``operators`` combine them into relational operators, ``plans``
hold the registered queries with their SQL twins, ``streaming`` the
incremental ingest, ``library`` the facade.  ``llm`` is an optional
subpackage with corpus-preparation operators; nothing here imports it.
"""
