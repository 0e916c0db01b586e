"""SimHash document fingerprints, DataFrame functions only (operator 5, native).

Method: the terms of a text are its pairs of consecutive words (one word alone
where there is no pair).  Each occurrence votes on all 64 bits of the
fingerprint with its term's hash, weighted by the term's length; a bit is set
when more than half of the weight votes for it.  ``near_pairs`` finds all
pairs within a Hamming radius: the bits are cut into blocks, one table for
each choice of blocks (a permutation that brings them to the front) is keyed
by them, and since at most ``radius`` blocks can differ, every near pair meets
in some table.

The 64 votes are 32 sums: a 64-bit sum holds the votes of bits i and i + 32.

Defined results: a null or empty text has fingerprint 0 (two of them are
alike, likeness 1); repeated rows (same doc_id and text) count as one document
and give one row; rows that share a doc_id but not a text are two documents,
ordered by a hash of the text; a null doc_id comes last; a single document is
its own next one; extra columns are ignored.

Texts up to 10^9 characters.  Scale: texts are shuffled once by document and
half of them once more, to their neighbour; votes are summed where the text
lies.  "The next document" is found on ids alone, by range partitions and the
first id of each, so no task sees all ids.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punctual.llm._store import stored

_FIELDS = 0x100000001


def terms(text: Column) -> Column:
    """Array of (a, b): consecutive words; b is null for the only word of a text."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    pairs = F.slice(F.arrays_zip(words.alias("a"), F.slice(words, 2, 0x7FFFFFF0).alias("b")), 1,
                    F.greatest(F.lit(1), F.size(words) - 1))
    return F.when(F.size(words) > 0, pairs)


def _vote_sums(h: Column, weight: Column) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_FIELDS)) * weight).alias(f"v{i}") for i in range(32)]


def _bits() -> Column:
    """Fingerprint from the vote sums v0..v31 and the total weight."""
    out = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"v{i}"), 32)
        out = out.bitwiseOR(F.when(low * 2 > F.col("total"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        out = out.bitwiseOR(F.when(high * 2 > F.col("total"),
                                   F.lit((1 << i + 32) - (1 << 64 if i == 31 else 0))).otherwise(F.lit(0)).cast("long"))
    return out


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, fingerprint (long) of the texts; rows of equal keys must hold equal texts."""
    t = df.select(*keys, F.explode_outer(terms(F.col(text))).alias("t")).select(
        *keys, F.when(F.col("t").isNotNull(), F.xxhash64(F.col("t.a"), F.col("t.b"))).alias("h"),
        (F.length("t.a") + F.coalesce(F.length("t.b"), F.lit(0))).cast("long").alias("w"))
    votes = t.groupBy(*keys).agg(F.sum("w").alias("total"), *_vote_sums(F.col("h"), F.col("w")))
    return votes.select(*keys, F.coalesce(F.when(F.col("total") > 0, _bits()), F.lit(0).cast("long"))
                        .alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def spelled(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, content (hash of the text), key (hash of both; one plain column, so that one exchange of the texts
    serves all joins) and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    content = F.xxhash64(text)
    return docs.select("doc_id", content.alias("content"),
                       F.xxhash64("doc_id", F.col("doc_id").isNull(), content).alias("key"), text.alias("text"))


def neighbours(docs: DataFrame) -> DataFrame:
    """key, doc_id, n_chars of each document, next_key, and prev_key and prev_chars, by descending doc_id; after the
    last comes the first."""
    ids = _keyed(docs).select("key", "doc_id", "content", F.length("text").cast("long").alias("n_chars")).distinct()
    order = [F.col("doc_id").desc_nulls_last(), F.col("content").asc()]
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(ids.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "simhash-ids")
    inside = Window.partitionBy("part").orderBy(*order)
    me = F.struct("key", "n_chars")
    row = ranged.select("part", "key", "doc_id", "n_chars", F.lead("key").over(inside).alias("next_key"),
                        F.lag(me).over(inside).alias("prev"))
    # at most one row for each range partition from here on
    ends = stored(row.groupBy("part").agg(
        F.first(F.when(F.col("prev").isNull(), F.col("key")), True).alias("first"),
        F.first(F.when(F.col("next_key").isNull(), me), True).alias("last")), "simhash-ends")
    around = Window.orderBy("part")
    edge = ends.select("part", F.lead("first").over(around).alias("after"), F.lag("last").over(around).alias("before"))
    whole = ends.agg(F.min_by("first", "part").alias("f"), F.max_by("last", "part").alias("l")).first()
    first, last = whole["f"], whole["l"] or {"key": None, "n_chars": None}
    prev = F.coalesce("prev", "before", F.struct(F.lit(last["key"]).cast("long").alias("key"),
                                                 F.lit(last["n_chars"]).cast("long").alias("n_chars")))
    return row.join(F.broadcast(edge), "part").select(
        "key", "doc_id", "n_chars", F.coalesce("next_key", "after", F.lit(first).cast("long")).alias("next_key"),
        prev["key"].alias("prev_key"), prev["n_chars"].alias("prev_chars"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256 (of its text with the last half replaced by the
    beginning of the next document), fingerprint and edited_fingerprint (long), near_edited, near_next."""
    links = stored(neighbours(docs), "simhash-links")
    texts = _keyed(docs).select("key", "text").dropDuplicates(["key"])
    here = texts.join(links, "key")
    lead = here.select(F.col("prev_key").alias("key"),
                       F.expr("substring(text, 1, cast(prev_chars div 2 as int))").alias("lead"))
    both = here.select("key", "doc_id", "n_chars", "next_key", "text").join(lead, "key").select(
        "key", "doc_id", "n_chars", "next_key", "text",
        F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), F.col("lead")).alias("edited"))
    versions = both.select(
        "key", "doc_id", "n_chars", "next_key", F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("text")),
                          F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text")))).alias("v")) \
        .select("*", "v.is_edited", "v.text").drop("v")
    keys = ["key", "doc_id", "n_chars", "next_key", "edited_sha256"]
    prints = stored(fingerprints(versions, [*keys, "is_edited"], "text").groupBy(*keys).agg(
        F.max(F.when(~F.col("is_edited"), F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("is_edited"), F.col("fingerprint"))).alias("edited_fingerprint")), "simhash-prints")
    after = prints.select(F.col("key").alias("next_key"), F.col("fingerprint").alias("next_fingerprint"))
    return prints.join(after, "next_key").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def near_pairs(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b, distance) of all distinct fingerprints a < b of ``prints.fingerprint`` that differ in 1 to ``radius``
    bits.  Equal fingerprints are one class: join the classes to their documents on the fingerprint."""
    if not radius < blocks <= 64:
        raise ValueError("radius < blocks <= 64")
    classes = prints.select("fingerprint").where("fingerprint IS NOT NULL").distinct()
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
             for chosen in combinations(range(blocks), blocks - radius)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = classes.select("fingerprint", F.posexplode(F.array(*[
        F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("permutation", "front"))
    other = tables.withColumnRenamed("fingerprint", "b")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return (tables.withColumnRenamed("fingerprint", "a").join(other, ["permutation", "front"])
            .where((F.col("a") < F.col("b")) & (distance <= radius))
            .select("a", "b", distance.alias("distance")).distinct())
