"""Operators for preparing large language-model training corpora with Spark.

Nothing outside this subpackage imports it; `queries` registers its queries.
"""
