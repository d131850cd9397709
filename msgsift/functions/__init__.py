from .keys import hash_bucket, hash_key, sql_hash_key
from .text import argmax, is_blank, na_to_null, softmax, token_array

__all__ = ["hash_key", "hash_bucket", "sql_hash_key", "na_to_null", "is_blank",
           "token_array", "softmax", "argmax"]
