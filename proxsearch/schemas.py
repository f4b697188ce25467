"""Schemas of the index tables."""

from pyspark.sql import types as T

POSTING = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_len", T.IntegerType())])
TOKENS = T.StructType([T.StructField("term", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("postings", T.ArrayType(POSTING)), T.StructField("bucket", T.IntegerType())])
#: Tokens as files hold them: the number of postings, and these in bytes.
STORED = T.StructType([T.StructField("term", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("packed", T.BinaryType()), T.StructField("bucket", T.IntegerType())])
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("sort_key", T.StringType())])
VOCAB = T.StructType([T.StructField("term", T.StringType()), T.StructField("doc_freq", T.LongType()), T.StructField("coll_freq", T.LongType())])
