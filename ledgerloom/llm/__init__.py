"""Operators for building language-model training corpora on Spark.

Nothing outside this subpackage imports it.  ``ledgerloom.llm.registry`` lists the queries.
"""
