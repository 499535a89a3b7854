"""Operators that prepare text corpora for language-model training, each a Spark job.

Nothing outside this folder imports it.
"""
