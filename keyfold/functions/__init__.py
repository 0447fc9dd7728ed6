"""Column functions: all of them stay in the JVM."""

from keyfold.functions.columns import ascii_lower, dot, hash_bucket, sigmoid, squared_distance, tokens, words

__all__ = ["ascii_lower", "dot", "hash_bucket", "sigmoid", "squared_distance", "tokens", "words"]
