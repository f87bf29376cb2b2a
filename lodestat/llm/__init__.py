"""Operators that prepare text corpora for training, each a Spark job over whole tables."""
