"""Training-data operators: dedup, filters, tokenization and packing on Spark.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own interface; :mod:`relaywatch.llm.catalog` holds the thin
``opN_<name>`` queries and their SQL.
"""
