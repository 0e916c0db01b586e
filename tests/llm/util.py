"""Fixtures and brute-force helpers of the operator tests."""

import os
import random
import re

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType())])


def docs(spark, rows, extra=()):
    """Documents from (doc_id, text); ``extra`` names columns that clash with names an operator may use itself."""
    schema = T.StructType(DOC.fields + [T.StructField(c, T.StringType()) for c in extra])
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *("x" for _ in extra))
                                  for i, t in rows], schema).repartition(3)


CLASHING = ("content", "node", "n", "ids", "spans", "holder", "kept", "score", "0", "a b")

ODD = [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "a b"), (5, "x" * 30_000), (6, "word " * 20_000),
       (7, "same text here for all of us to see today and more words"),
       (8, "same text here for all of us to see today and more words"),
       (8, "same text here for all of us to see today and more words"), (None, "no id but a text with words in it"),
       (9, "é日本 \U0001F600 mixed Ünicode\x00 null byte"), (10, "."), (11, "++++ @@@@ .... 1.1 0 0 0")]


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def space_words(s, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(s or "") if lower else (s or ""))


def random_texts(seed, n, vocabulary=40, longest=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["The", "É", "of", "a1", "B"]
    return [" ".join(r.choice(words) for _ in range(r.randint(0, longest))) for _ in range(n)]


def exists(path):
    return os.path.exists(path)
