"""Token counts by exact length histogram (operator 4).

Method: documents are aggregated by their encoded length; a histogram with
suffix sums then answers totals, quantiles and truncated totals for every
context limit without another look at the documents.

Defined results: a null text is an empty one, of length 0; repeated rows count
as often as they occur; an empty table gives an empty histogram, totals of 0
and null quantiles; extra columns are ignored.

Scale: one pass over the texts, partial counts before the only shuffle; the
histogram has a row for each distinct length, whatever the number of
documents.  Suffix sums run within ranges of 1024 lengths and over the ranges'
totals, so no task orders the whole histogram.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm._store import stored
from punctual.session import ship_package

_RANGE = 1024
_ENCODERS: dict = {}


def _encoder(key: str, ranks: dict[bytes, int], pattern: str):
    import tiktoken

    if key not in _ENCODERS:
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def lengths(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, length: tokens of each row's whole text, without special tokens."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()

    def run(batches):
        encode = _encoder(key, shared.value, pattern).encode_ordinary
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(encode(t)) if t else 0 for t in part.column(1).to_pylist()],
                                              pa.int64())], names=["doc_id", "length"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """length, n_docs."""
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """length, n_docs, docs_from and tokens_from: documents of at least that length, and their tokens."""
    hist = stored(hist, "length-histogram")  # it is read twice, the texts are not
    cells = hist.withColumn("range", F.floor(F.col("length") / _RANGE)) \
        .withColumn("tokens", F.col("length") * F.col("n_docs"))
    beyond = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = cells.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).select(
        "range", F.coalesce(F.sum("d").over(beyond), F.lit(0)).alias("d"),
        F.coalesce(F.sum("t").over(beyond), F.lit(0)).alias("t"))
    inside = Window.partitionBy("range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    return cells.join(ranges, "range").select(
        "length", "n_docs", (F.sum("n_docs").over(inside) + F.col("d")).alias("docs_from"),
        (F.sum("tokens").over(inside) + F.col("t")).alias("tokens_from"))


def totals(hist: DataFrame) -> DataFrame:
    """One row: n_docs, n_tokens, longest."""
    return hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
                    F.coalesce(F.sum(F.col("n_docs") * F.col("length")), F.lit(0)).alias("n_tokens"),
                    F.max("length").alias("longest"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the least length that at least that share of all documents does not exceed."""
    sums = stored(suffix_sums(hist), "length-sums")
    n = sums.agg(F.max("docs_from")).first()[0] or 0
    reached = (n - F.col("docs_from") + F.col("n_docs"))  # documents up to this length
    return sums.agg(*[F.min(F.when(reached >= s * n, F.col("length"))).alias(f"q{i}") for i, s in enumerate(shares)]) \
        .select(F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("length"))
                                    for i, s in enumerate(shares)])).alias("x")).select("x.*")


def truncated(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit, n_truncated, n_tokens left when every document is cut to the limit."""
    return hist.agg(*[F.struct(
        F.lit(int(x)).cast("long").alias("limit"),
        F.coalesce(F.sum(F.when(F.col("length") > x, F.col("n_docs"))), F.lit(0)).alias("n_truncated"),
        F.coalesce(F.sum(F.least(F.col("length"), F.lit(x)) * F.col("n_docs")), F.lit(0)).alias("n_tokens"))
        .alias(f"l{i}") for i, x in enumerate(limits)]).select(
        F.explode(F.array(*[F.col(f"l{i}") for i in range(len(limits))])).alias("x")).select("x.*")


def curve(hist: DataFrame) -> DataFrame:
    """For every length that occurs, taken as context limit: limit, n_docs of just that length, n_truncated
    (longer documents), share_whole (documents within the limit), n_tokens_cut (tokens left at the limit)."""
    sums = stored(suffix_sums(hist), "length-sums")
    all_of = sums.agg(F.coalesce(F.max("docs_from"), F.lit(0)).alias("d"),
                      F.coalesce(F.max("tokens_from"), F.lit(0)).alias("t")).first()
    return sums.select(
        F.col("length").alias("limit"), "n_docs", (F.col("docs_from") - F.col("n_docs")).alias("n_truncated"),
        (1 - (F.col("docs_from") - F.col("n_docs")) / F.lit(max(int(all_of["d"]), 1))).alias("share_whole"),
        (F.lit(int(all_of["t"])) - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("n_tokens_cut"))
