"""Benchmark decontamination by winnowing (operator 6).

Method: every text is reduced to the minimum k-gram hash of each run of ``w``
consecutive k-grams (``k + w - 1 = window``), so any two texts that share
``window`` words in a row share at least one kept fingerprint.  Document and
benchmark fingerprints are joined, and each hit is extended word by word over
the windows that contain the k-gram.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

Defined results: a null or empty text has no words, no hits and stays clean;
an item without words matches nothing; an item shorter than ``window`` words
matches as a whole; items with a null id mark words but are not listed;
repeated rows each get their own (equal) result; rows that share a doc_id but
not a text are judged apart; an empty benchmark leaves every document clean;
extra columns of either table are ignored.

Scale: documents are read once.  A bitmap of the benchmark fingerprints (a
fixed number of bits for each entry, at most 64 MB) goes to the tasks, so only
document fingerprints that may match are ever written or shuffled; the exact
join decides.  A full bitmap costs speed, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm import _text
from punctual.llm._store import bitmap_bits, in_bitmap, membership_bitmap, null_safe, stored
from punctual.session import ship_package

WINDOW, K = 10, 5

_PRINT_TYPE = pa.list_(pa.struct([("fp", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()),
                                  ("context", pa.binary())]))


def winnow(grams: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
    """Indices of the grams that are the minimum (the last one, on ties) of some run of w grams."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, where = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        g = grams[j:j + n]
        less = g <= best
        best[less] = g[less]
        where[less] = np.flatnonzero(less) + j
    return np.unique(where[at[w - 1:] - at[:n] == w - 1])


def _prints(words: _text.Words, window: int, k: int, short: list[int], whole_items: bool):
    """Kept fingerprints as (hash, size, word position); size is the window the hash stands for."""
    grams, at = _text.ngrams(words, k)
    keep = winnow(grams, at, window - k + 1)
    out = [(grams[keep], np.full(len(keep), window), at[keep])]
    lengths = np.diff(words.first)
    for size in short:
        g, a = _text.ngrams(words, size)
        if whole_items:  # the item itself, not its parts
            own = lengths[np.searchsorted(words.first, a, side="right") - 1] == size
            g, a = g[own], a[own]
        out.append((g, np.full(len(g), size), a))
    return [np.concatenate(x) for x in zip(*out)]


def _contexts(words: _text.Words, pos: np.ndarray, doc: np.ndarray, window: int, k: int, filler: int) -> np.ndarray:
    """Word hashes around each position, ``filler`` outside the document."""
    span = pos[:, None] + np.arange(-(window - k), window)[None, :]
    inside = (span >= words.first[doc][:, None]) & (span < words.first[doc + 1][:, None])
    return np.where(inside, words.hash[np.clip(span, 0, max(len(words.hash) - 1, 0))], np.uint64(filler))


def _rows(ids: pa.Array, texts: pa.Array, content: pa.Array, window: int, k: int, short: list[int], bitmap, filler: int,
          whole_items: bool, id_name: str) -> Iterator[pa.RecordBatch]:
    for a, b, data, offsets in _text.slices(texts):
        words = _text.hash_words(data, offsets, _text.ALNUM_FOLDED)
        fp, size, pos = _prints(words, window, k, short, whole_items)
        if bitmap is not None:
            some = in_bitmap(bitmap, fp)
            fp, size, pos = fp[some], size[some], pos[some]
        doc = np.searchsorted(words.first, pos, side="right") - 1
        order = np.argsort(doc, kind="stable")
        fp, size, pos, doc = fp[order], size[order], pos[order], doc[order]
        context = _contexts(words, pos, doc, window, k, filler)
        width = context.shape[1] * 8
        blob = pa.py_buffer(np.ascontiguousarray(context).tobytes())
        step = pa.py_buffer((np.arange(len(fp) + 1, dtype=np.int32) * width).tobytes())
        items = pa.StructArray.from_arrays(
            [pa.array(fp.view(np.int64)), pa.array(size.astype(np.int32)),
             pa.array((pos - words.first[doc]).astype(np.int32)),
             pa.Array.from_buffers(pa.binary(), len(fp), [None, step, blob])],
            fields=list(_PRINT_TYPE.value_type))
        lists = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)), items).cast(_PRINT_TYPE)
        yield pa.RecordBatch.from_arrays(
            [ids.slice(a, b - a), content.slice(a, b - a), pa.array(np.diff(words.first).astype(np.int64)),
             lists], names=[id_name, "content", "n_words", "prints"])


def _content():
    """A hash of each whole text, which tells apart rows that share an id."""
    return F.xxhash64(F.col("text").cast("string"))


def _fingerprints(df: DataFrame, id_name: str, window: int, k: int, short: list[int], bitmap=None,
                  filler: int = 0, whole_items: bool = False) -> DataFrame:
    kind = dict(df.dtypes)[id_name]

    def run(batches):
        for batch in batches:
            yield from _rows(batch.column(0), batch.column(1), batch.column(2), window, k, short,
                             None if bitmap is None else bitmap.value, filler, whole_items, id_name)

    return df.select(id_name, F.col("text").cast("string").alias("text"), _content().alias("content")).mapInArrow(
        run, f"`{id_name}` {kind}, content long, n_words long, "
             "prints array<struct<fp: long, size: int, pos: int, context: binary>>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K
                  ) -> tuple[DataFrame, DataFrame]:
    """(profile, hits): ``profile`` has doc_id, content, n_words of every row of ``docs``; ``hits`` has
    one row for each matched fingerprint: doc_id, content, item_id and the hit word span [lo, hi)."""
    spark = docs.sparkSession
    ship_package(spark)
    every = list(range(1, window))
    items = stored(_fingerprints(benchmark, "item_id", window, k, every, filler=1, whole_items=True), "items")
    item_prints = items.select("item_id", F.explode("prints").alias("p")).select(
        "item_id", F.col("p.fp").alias("fp"), F.col("p.size").alias("size"), F.col("p.pos").alias("item_pos"),
        F.col("p.context").alias("item_context"))
    short = sorted(r[0] for r in items.select("n_words").where(F.col("n_words").between(1, window - 1))
                   .distinct().collect())  # at most window - 1 numbers
    bits = bitmap_bits(item_prints.count())
    bitmap = spark.sparkContext.broadcast(membership_bitmap(item_prints, "fp", bits))
    profile = stored(_fingerprints(docs, "doc_id", window, k, short, bitmap), "prints")
    found = profile.select("doc_id", "content", F.explode("prints").alias("p")).select(
        "doc_id", "content", F.col("p.fp").alias("fp"), F.col("p.size").alias("size"), F.col("p.pos").alias("pos"),
        F.col("p.context").alias("context"))
    # one context of an item text is enough to judge a document; the ids come along as a list of its items
    same = item_prints.groupBy("fp", "size", "item_context").agg(F.collect_set("item_id").alias("items"))
    pairs = found.join(same, ["fp", "size"]).select("doc_id", "content", "items", "size", "pos", "context",
                                                    "item_context")
    kinds = dict(pairs.dtypes)
    back = window - k

    def extend(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            mine, theirs = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
                            for c in ("context", "item_context"))
            equal = mine == theirs
            size, pos = batch.column("size").to_numpy(), batch.column("pos").to_numpy()
            lo = np.full(batch.num_rows, np.iinfo(np.int32).max)
            hi = np.full(batch.num_rows, -1)
            for s in range(back + 1):  # every window that holds the k-gram
                ok = equal[:, s:s + window].all(axis=1) & (size == window)
                lo[ok] = np.minimum(lo[ok], pos[ok] - back + s)
                hi[ok] = np.maximum(hi[ok], pos[ok] - back + s + window)
            for n in short:
                ok = equal[:, back:back + n].all(axis=1) & (size == n)
                lo[ok], hi[ok] = pos[ok], pos[ok] + n
            keep = pa.array(hi > 0)
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("content"), batch.column("items"),
                 pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                names=["doc_id", "content", "items", "lo", "hi"])
            yield out.filter(keep)

    hits = pairs.mapInArrow(extend, f"doc_id {kinds['doc_id']}, content long, items {kinds['items']}, lo int, hi int")
    return profile.select("doc_id", "content", "n_words"), hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """One row for each document: doc_id, content, n_words, n_hit (distinct hit words), items (sorted ids as
    strings), contaminated."""
    profile, hits = contamination(docs, benchmark, window, k)
    spans = hits.groupBy("doc_id", "content", "lo", "hi").agg(F.collect_set("items").alias("items"))
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["hi"]).alias("end"),
                              (a["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(a["end"], s["lo"]))).alias("n")),
        lambda a: a["n"])
    found = (spans.groupBy("doc_id", "content")
             .agg(F.collect_set(F.struct("lo", "hi")).alias("spans"), F.collect_set("items").alias("items"))
             .select("doc_id", "content", covered.cast("long").alias("n_hit"),
                     F.array_sort(F.array_distinct(F.flatten(F.flatten("items"))).cast("array<string>")).alias("items")))
    return null_safe(profile, found, ["doc_id", "content"]).select(
        "doc_id", "content", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """``docs`` without its contaminated rows; all columns stay."""
    ship_package(docs.sparkSession)
    dirty = decontaminate(docs, benchmark, window, k).where("contaminated").select(
        F.col("doc_id").alias("__dirty"), F.col("content").alias("__text")).distinct()
    rows = docs.withColumn("__content", _content())
    return rows.join(dirty, rows["doc_id"].eqNullSafe(dirty["__dirty"]) & (rows["__content"] == dirty["__text"]),
                     "left_anti").drop("__content")
