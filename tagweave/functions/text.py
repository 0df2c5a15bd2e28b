"""Word tokens and their hashed buckets, over whole texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.functions.hashing import hex_head


def tokens(text: Column, max_tokens: int | None = None) -> Column:
    """Lower-case runs of letters and digits; all of them unless a limit is asked for."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]++"), "")
    return words if max_tokens is None else F.slice(words, 1, max_tokens)


def token_buckets(words: Column, dim: int) -> Column:
    return F.transform(words, lambda w: (hex_head(F.md5(w)) % dim).cast("int"))
