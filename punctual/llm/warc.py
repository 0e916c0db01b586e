"""WARC archives: written by Spark, read back by boundary-chain verification (operator 12).

Writing: one record for each row, as lines of Spark's text sink whose line
separator is the two CRLF that end a record, so archives are written, committed
and replaced after a loss like any other output, to any file system.  Of rows
with equal payloads (SHA-1 and length) the one with the smallest page_id is a
response with an HTTP block; the others are revisits of it without payload.
Payloads that occur once never move; of those that may occur more often (a
bitmap of bounded size tells) one for each payload does, pre-aggregated.

Reading: archives are cut into byte ranges like any text input, at the record
magic ``WARC/1.``.  A task sees a magic but not whether it lies inside a payload,
so each is only a candidate: it emits its offset and, by its Content-Length, its
successor's.  Offsets come from prefix sums of the lengths inside a range and
over the ranges of a file.  Inside a range, neighbours that succeed each other
are contracted to runs; then pointer jumping from offset 0 doubles the reached
part of every file each round.  Only reached records are kept.  A record whose
payload holds the magic is put together again from its pieces.

Defined results: a null html is an empty payload; a null page_id counts as the
largest and comes back null; repeated rows are revisits of one another; of rows
with equal payload and page_id the one with the smallest url is first; control
characters of a url are percent-encoded; a file that does not begin with a
record gives none, and a chain ends where its successor is no record; an empty
table gives no archive rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from punctual.llm._store import bitmap_bits, in_bitmap, membership_bitmap, stored
from punctual.session import ship_package

MAGIC = "WARC/1."
_CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(sha1_hex: Column) -> Column:
    """Upper-case base 32 of a SHA-1 in hex: eight characters of each forty bits."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)),
                        lambda i: F.conv(F.substring(sha1_hex, i * 10 + 1, F.lit(10)), 16, 10).cast("long"))
    letters = F.transform(parts, lambda v: F.concat(*[
        F.substring(F.lit(_ALPHABET), (F.shiftright(v, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
        for k in range(8)]))
    return F.array_join(letters, "")


# --- writing --------------------------------------------------------------------------------------------------------
def _maybe_repeated(keys: DataFrame):
    """A predicate on xxhash64 keys that is true for every key of ``keys`` (and few others)."""
    bits = bitmap_bits(keys.count())
    bitmap = keys.sparkSession.sparkContext.broadcast(membership_bitmap(keys, "key", bits))

    @F.pandas_udf("boolean")
    def among(key: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bitmap.value, key.to_numpy().astype(np.int64).view(np.uint64)))
    return among


def _record(kind: str, refers_to: Column | None) -> Column:
    """The record of a row with page, url, copy, digest, bytes (and html, for responses)."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(_CRLF * 2))
    block = F.concat(http, "html") if kind == "response" else http
    lines = [F.lit(f"{MAGIC}1"), F.lit(f"WARC-Type: {kind}"),
             F.concat(F.lit("WARC-Record-ID: <"), "id", F.lit(">")), F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
             F.when(F.col("url") != "", F.concat(F.lit("WARC-Target-URI: "), "url")),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("digest")))]
    if refers_to is not None:
        lines += [F.concat(F.lit("WARC-Refers-To: <"), refers_to, F.lit(">")), F.lit(f"WARC-Profile: {_PROFILE}")]
    lines += [F.lit("Content-Type: application/http; msgtype=response"),
              F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2), block)


def _id(page: str, digest: str, url: str, copy: str) -> Column:
    """Identifier of a record: page, payload, url and number of the copy."""
    return F.concat(F.lit("urn:page:"), F.coalesce(F.url_encode(F.col(page)), F.lit("")), F.lit(":"), digest, F.lit(":"),
                    F.hex(F.xxhash64(url)), F.lit(":"), F.col(copy).cast("string"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) into archives in the folder ``path``."""
    ship_package(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    # pages are compared as they are typed: null last, then by value
    rows = pages.select(
        F.col("page_id").isNull().alias("absent"), "page_id", F.col("page_id").cast("string").alias("page"),
        F.when(url.rlike(r"[\x00-\x20\x7F]"), F.url_encode(url)).otherwise(url).alias("url"), html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"),
        F.xxhash64(F.sha1(html.cast("binary")), F.octet_length(html)).alias("key"))
    payload, names = ["digest", "bytes"], ["absent", "page_id", "page", "url"]
    listed = stored(rows.groupBy(*payload, "key", *names).agg(F.count(F.lit(1)).alias("n")), "warc-pages")
    firsts = listed.groupBy(*payload).agg(F.min(F.struct(*names)).alias("first"), F.sum("n").alias("rows"))
    repeated = stored(firsts.where("rows > 1"), "warc-repeated")
    keys = repeated.select(F.xxhash64("digest", F.col("bytes").cast("int")).alias("key"))
    shared = _maybe_repeated(keys)(F.col("key"))
    # payloads that occur once are written where they lie
    once = rows.where(~shared).withColumn("copy", F.lit(0)).select("page", "url", "copy", "digest", "bytes", "html")
    # the others: one html for each payload, and its first page
    suspects = rows.where(shared).groupBy(*payload).agg(F.first("html").alias("html")).join(firsts, payload)
    several = suspects.select(F.col("first.page").alias("page"), F.col("first.url").alias("url"), F.lit(0).alias("copy"),
                              "digest", "bytes", "html")
    responses = once.unionByName(several).withColumn("id", _id("page", "digest", "url", "copy"))
    # revisits need no html: every row of a repeated payload but the first copy of its first page
    others = listed.join(repeated, payload)
    is_first = F.struct(*names) == F.col("first")
    at = others.withColumn("from", F.when(is_first, 1).otherwise(0)).where("from < n") \
        .withColumn("copy", F.explode(F.sequence(F.col("from").cast("long"), F.col("n") - 1))) \
        .withColumns({"first_page": F.col("first.page"), "first_url": F.col("first.url"), "zero": F.lit(0)})
    revisits = at.select("page", "url", "copy", "digest", "bytes", _id("page", "digest", "url", "copy").alias("id"),
                         _id("first_page", "digest", "first_url", "zero").alias("target"))
    records = responses.select(_record("response", None).alias("value")) \
        .union(revisits.select(_record("revisit", F.col("target")).alias("value")))
    records.write.option("lineSep", _CRLF * 2).text(path)


# --- reading --------------------------------------------------------------------------------------------------------
def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magics: file, range, seq (order of reading), value."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("seq"), "value")


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _heads(pieces: DataFrame) -> DataFrame:
    """``pieces`` with head, size, head_bytes and length (Content-Length; null: not a record)."""
    out = pieces.withColumn("head", F.substring_index("value", _CRLF * 2, 1))
    out = out.withColumns({"size": F.octet_length("value").cast("long"), "head_bytes": F.octet_length("head").cast("long")})
    proper = F.col("head").rlike(r"^[0-9]\r\n") & (F.col("head_bytes") < F.col("size"))
    return out.withColumn("length", F.when(proper, _field(F.col("head"), "Content-Length").try_cast("long")))


def _contents(heads: DataFrame) -> list[Column]:
    """The fields of a record from its head and value."""
    head = F.col("head")
    block = F.substring(F.col("value").cast("binary"), (F.col("head_bytes") + 5).cast("int"), F.col("length").cast("int"))
    http = F.substring_index(block.cast("string"), _CRLF * 2, 1)
    payload = F.substring(block, F.octet_length(http) + 5, F.octet_length(block))
    kind = F.lower(_field(head, "WARC-Type"))
    is_response = kind == "response"
    return [kind.alias("record_type"), F.regexp_extract(_field(head, "WARC-Record-ID"), "^<?([^>]*)>?$", 1).alias("record_id"),
            F.regexp_extract(_field(head, "WARC-Refers-To"), "^<?([^>]*)>?$", 1).alias("refers_to"),
            _field(head, "WARC-Target-URI").alias("target_uri"),
            F.regexp_extract(_field(head, "WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("stated_digest"),
            F.when(is_response, base32(F.sha1(payload))).alias("payload_digest"),
            F.when(is_response, F.octet_length(payload)).otherwise(
                _field(F.concat(F.lit(_CRLF), http), "Content-Length").try_cast("long")).cast("long").alias("payload_bytes"),
            F.when(is_response, payload).alias("payload")]


def candidates(pieces: DataFrame) -> DataFrame:
    """Every magic of the archives: file, range, seq, offset, next (its successor's offset; null: no record),
    whole (all of the record lies in this piece) and the fields of whole records (without payload)."""
    heads = _heads(pieces)
    whole = F.col("size") - F.col("head_bytes") - 4 >= F.col("length") + 4
    fields = [F.when(whole, c).alias(n) for c, n in zip(_contents(heads)[:-1], _FIELDS)]
    found = stored(heads.select("file", "range", "seq", "size", "head_bytes", "length",
                                F.coalesce(whole, F.lit(False)).alias("whole"), *fields), "warc-candidates")
    step = F.col("size") + len(MAGIC)
    ahead = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = found.groupBy("file", "range").agg(F.sum(step).alias("bytes")).select(
        "file", "range", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum(step).over(inside), F.lit(0))
    return (found.join(base, ["file", "range"]).withColumn("start", start).where("start > 0")
            .withColumn("offset", F.col("start") - len(MAGIC))
            .withColumn("next", F.col("start") + F.col("head_bytes") + 4 + F.col("length") + 4)
            .select("file", "range", "seq", "offset", "next", "whole", *_FIELDS))


_FIELDS = ["record_type", "record_id", "refers_to", "target_uri", "stated_digest", "payload_digest", "payload_bytes"]


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that the chain of successors from the start of their file reaches."""
    in_range = Window.partitionBy("file", "range").orderBy("offset")
    follows = F.lead("offset").over(in_range).eqNullSafe(F.col("next")) & F.col("next").isNotNull()
    # a run of neighbours that succeed each other is named by its last candidate
    runs = found.withColumn("last", F.when(~follows, F.col("offset")))
    runs = stored(runs.withColumn("run", F.min("last").over(in_range.rowsBetween(0, Window.unboundedFollowing))), "warc-runs")
    ends = runs.where("last IS NOT NULL").select("file", "run", "next")
    heads = runs.select("file", F.col("offset").alias("next"), F.col("run").alias("to"))
    jumps = stored(ends.join(heads, ["file", "next"]).select("file", "run", "next", "to"), "warc-jumps")
    start = runs.where("offset = 0").select("file", "run")
    reached, jump, n = stored(start, "warc-reached"), jumps.select("file", "run", "to"), -1
    while True:
        more = reached.join(jump, ["file", "run"]).select("file", F.col("to").alias("run"))
        reached = stored(reached.union(more).distinct(), "warc-reached")
        before, n = n, reached.count()
        if n == before:
            break
        beyond = jump.select("file", F.col("run").alias("to"), F.col("to").alias("beyond"))
        jump = stored(jump.join(beyond, ["file", "to"]).select("file", "run", F.col("beyond").alias("to")), "warc-jump")
    entered = jumps.join(reached, ["file", "run"]).select("file", F.col("to").alias("run"), F.col("next").alias("entry")) \
        .union(start.withColumn("entry", F.lit(0).cast("long")))
    return runs.join(entered, ["file", "run"]).where("offset >= entry").select(*found.columns)


def _assembled(pieces: DataFrame, found: DataFrame, records: DataFrame) -> DataFrame:
    """file, offset and all fields of ``records``, from their pieces.

    A piece belongs to the last record that begins before it; a record's pieces are as many as the magics it holds."""
    marked = found.select("file", "offset", "seq").join(
        records.select("file", "offset", F.lit(True).alias("begins"), "whole"), ["file", "offset"], "left")
    so_far = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owner = marked.withColumns({
        "owner": F.max(F.when(F.col("begins"), F.col("offset"))).over(so_far)}).select("file", "offset", "seq", "owner")
    wanted = records.select("file", F.col("offset").alias("owner"), F.col("next"))
    owned = owner.join(wanted, ["file", "owner"]).where("offset < next")
    rows = pieces.select("seq", "value").join(owned, "seq").groupBy("file", "owner") \
        .agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("parts")) \
        .select("file", F.col("owner").alias("offset"), F.array_join(F.col("parts.value"), MAGIC).alias("value"))
    heads = _heads(rows)
    return heads.select("file", "offset", *_contents(heads))


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives in ``path``: file, offset, record_type, record_id, refers_to, target_uri,
    stated_digest (of the head), payload_digest (of the payload; responses), payload_bytes; payload (binary) if asked for."""
    pieces = _pieces(spark, path)
    found = candidates(pieces)
    kept = stored(reachable(found), "warc-records")
    if with_payload:
        return _assembled(pieces, found, kept)
    out = kept.where("whole").select("file", "offset", *_FIELDS)
    if kept.where("NOT whole").limit(1).count():
        # only the pieces of records that hold the magic move
        marks = kept.withColumn("wanted", ~F.col("whole"))
        out = out.unionByName(_assembled(pieces, found, marks).join(
            marks.where("wanted").select("file", "offset"), ["file", "offset"], "left_semi").drop("payload"))
    return out


def pages_of(records: DataFrame, page_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page_id): revisits resolved by the response they
    refer to."""
    def page(c: str) -> Column:
        found = F.regexp_extract(c, "^urn:page:([^:]*):", 1)
        return F.when(found != "", F.url_decode(found)).cast(page_type)
    responses = records.where("record_type = 'response'").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.lit(None).cast(page_type).alias("refers_to"), "record_id")
    revisits = records.where("record_type = 'revisit'").select(
        F.col("refers_to").alias("record_id"), page("record_id").alias("page_id"))
    resolved = revisits.join(responses.select("record_id", "payload_bytes", "payload_digest"), "record_id").select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"),
        page("record_id").alias("refers_to"))
    return responses.drop("record_id").unionByName(resolved)
