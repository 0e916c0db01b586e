"""Queries ``opN_<name>`` over the synthetic tables, with their DuckDB SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm import (bpe, conversation_repair, decontamination, language_model, ngram_join, pii, quality, simhash,
                          spelling, substring_dedup, token_counts, toxicity, warc)
from punctual.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> tuple[dict[bytes, int], str]:
    """Ranks and pre-token pattern of the byte-level vocabulary."""
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_WORDS6 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS6} AS w FROM documents),
b AS (SELECT item_id, {_WORDS6} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, p, n FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q
      FROM (SELECT DISTINCT doc_id, p, n FROM h)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""


@register("op6_decontamination", _OP6_SQL)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside a 10-word window of a benchmark item."""
    out = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@register("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every document through the 50k byte-level vocabulary."""
    ranks, pattern = byte_bpe()
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, pattern)


@register("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, and all spans."""
    def is_kind(i):
        return lambda s: s["kind"] == i
    count = [F.size(F.filter("base", is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return pii.find(table(spark, sf_dir, "documents")).select(
        "doc_id", *count, F.sha2(pii.spelled("base"), 256).alias("base_sha256"), pii.spelled("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


@register("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", "edited_sha256", simhash.spelled(F.col("fingerprint")).alias("fingerprint"),
        simhash.spelled(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 3) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""


@register("op2_ngram_join", _OP2_SQL)
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have Jaccard 0.9 or more."""
    return ngram_join.components(table(spark, sf_dir, "documents"), k=3, percent=90)


@register("op3_language_model")
def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and bigram log10 scores of every document; a seventh of the ids is held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return language_model.score(table(spark, sf_dir, "documents"), held_out)


_OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
h AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM g JOIN f USING (g) WHERE least < doc_id),
k AS (SELECT doc_id, list(q) AS gone FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w
              ELSE [x.w FOR x IN list_filter(list_transform(w, lambda v, i: {'w': v, 'i': i}),
                                             lambda z: NOT list_contains(gone, z.i))] END, ' ')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@register("op8_substring_dedup", _OP8_SQL)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that repeat 13-word passages of documents with smaller ids."""
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), with_text=False) \
        .withColumnRenamed("kept", "kept_sha256")


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learned: four fifths of the ids."""
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    return table(spark, sf_dir, "labels").where(learn).select("doc_id", F.col("toxic").alias("label"))


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document after deobfuscation."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.fit_score(table(spark, sf_dir, "documents"), toxic_labels(spark, sf_dir)).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@register("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, truncations and tokens left for every context limit that is some document's length."""
    ranks, pattern = byte_bpe()
    return token_counts.curve(token_counts.histogram(
        token_counts.lengths(table(spark, sf_dir, "documents"), ranks, pattern)))


@register("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a fifth of the ids is held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    return quality.score(docs, quality.fit(docs, labels)).withColumn("held_out", F.coalesce(held_out, F.lit(False)))



# --- crc32 and base 32 in SQL ---------------------------------------------------------------------------------------
#: Relation of one row: crc32's table, made by its rule.
_CRC_TABLE = """(SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS crc_table)"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of ``text``, beside a column ``crc_table``."""
    octets = (f"list_transform(range(1, octet_length(encode({text})) + 1), "
              f"lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)")
    return (f"xor(4294967295, list_reduce({octets}, lambda c, b: "
            f"xor(crc_table[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT))")


# --- operator 13 ----------------------------------------------------------------------------------------------------
def _op13_sql() -> str:
    """A forward search, row by row, over the cheapest and ASCII-least audit of each of the four states.

    A state's value is its cost in nine digits and its audit, so that the least string is the best one."""
    def plus(state: str, cost: str, letters: str) -> str:
        return f"lpad((substr({state}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{letters}'"

    def least(*options: str) -> str:
        return f"least({', '.join(options)})"
    closed = {0: "s0", 1: "s1",
              2: least("s2", plus("s0", "2", "I"), plus("s1", "2", "I"), plus("s3", "2", "I")),
              3: least("s3", plus("s2", "2", "I"), plus("s0", "4", "II"), plus("s1", "4", "II"))}
    shut = ", ".join(f"{closed[i]} AS c{i}" for i in range(4))
    keep, rerole = "CASE WHEN kind = 'x' OR initial <> '{r}' THEN NULL ELSE {v} END", "CASE WHEN kind = 'x' THEN NULL ELSE {v} END"
    into = {0: [], 1: [keep.format(r="s", v=plus("c0", "late", "K"))],
            2: [x for c in ("c0", "c1", "c3") for x in (keep.format(r="u", v=plus(c, "late", "K")),
                                                        rerole.format(v=plus(c, "2 + late", "R")))],
            3: [keep.format(r="a", v=plus("c2", "late", "K")), rerole.format(v=plus("c2", "2 + late", "R"))]}
    step = ", ".join(f"{least(plus(f'c{i}', '3', 'D'), *into[i])} AS s{i}" for i in range(4))
    return rf"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k
  FROM conversations, {_CRC_TABLE}),
m AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                                   sha256(length(role)::VARCHAR || ':' || role || text)) AS i,
             regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS t FROM m),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
             lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] AS pair FROM o),
g AS (SELECT *, role[1:1] AS initial, CASE WHEN t = '' OR again THEN 'x' ELSE 'r' END AS kind,
             (t[-1:] NOT IN ('.', '!', '?'))::BIGINT AS late FROM f),
p AS (SELECT conv_id, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3
      FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL
      SELECT conv_id, i, {step} FROM (SELECT p.conv_id, g.i, g.kind, g.initial, g.late, {shut} FROM p
      JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.i = p.i + 1)),
b AS (SELECT conv_id, i AS n, {least("c0", "c3")} AS best FROM (SELECT conv_id, i, {shut} FROM p)
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
a AS (SELECT conv_id, n, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM b),
e AS (SELECT conv_id, q, audit[q:q] AS edit, len(replace(audit[1:q], 'I', '')) AS i,
             len(replace(audit[1:q], 'D', '')) AS nth
      FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS q FROM a)),
k AS (SELECT e.conv_id, e.q, e.nth, CASE WHEN edit = 'K' THEN g.role END AS kept,
             CASE WHEN edit = 'I' THEN '' ELSE g.text END AS text
      FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.i = e.i WHERE edit <> 'D'),
h AS (SELECT *, max((nth = 1 AND coalesce(kept[1:1] = 's', false))::INT) OVER (PARTITION BY conv_id) AS led FROM k),
r AS (SELECT conv_id, sha256(string_agg(coalesce(kept, CASE WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END)
                                        || ':' || text, chr(10) ORDER BY q)) AS digest FROM h GROUP BY conv_id),
z AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(t = '') AS blank,
             count_if(t <> '' AND again) AS duplicate, count_if(t <> '' AND NOT again AND late = 1) AS truncated,
             count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM a LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""


@register("op13_conversation_repair", _op13_sql())
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of every damaged conversation."""
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


# --- operator 11 ----------------------------------------------------------------------------------------------------
_OP11_SQL = rf"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({_FOLD}, '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
g AS (SELECT id, run, count(*) AS c FROM r GROUP BY ALL),
h AS (SELECT run, c, {_crc32("id || ':' || run")} AS h FROM g, {_CRC_TABLE}),
s AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
             ELSE run END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT x.word AS a, y.word AS b, y.n AS n FROM v x JOIN v y ON x.d = y.d AND x.i = y.i AND x.word <> y.word
      UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.d = w.word
      UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.d = w.word),
q AS (SELECT a, count(*) AS n_near, min({{'k': -n, 'b': b}}) AS best FROM p GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.k >= 2 * n THEN best.b END AS form,
             CASE WHEN -best.k >= 2 * n THEN -best.k END::BIGINT AS form_n FROM w LEFT JOIN q ON a = word),
t AS (SELECT word, word AS root, 0 AS depth FROM f UNION ALL
      SELECT t.word, f.form, depth + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
SELECT f.word, n, n_near, form, form_n, root FROM f JOIN (SELECT word, arg_max(root, depth) AS root FROM t GROUP BY word)
  USING (word)
"""


@register("op11_spelling", _OP11_SQL)
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their spelling variants' forms and roots."""
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


# --- operator 12 ----------------------------------------------------------------------------------------------------
_OP12_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, row_number() OVER () AS r, coalesce(url, '') AS u FROM pages),
d AS (SELECT *, sha1(b) AS h, octet_length(b) AS n FROM p),
e AS (SELECT page_id, n, h, row_number() OVER (PARTITION BY h, n ORDER BY page_id NULLS LAST, u, r) AS nth,
             first_value(page_id) OVER (PARTITION BY h, n ORDER BY page_id NULLS LAST, u, r) AS least FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, (k // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (k % 8))) & 31) + 1)::INT, 1)),
           'string_agg', '') AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 THEN least END AS refers_to
FROM e
"""


@register("op12_warc", _OP12_SQL)
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back by their boundary chains."""
    pages = table(spark, sf_dir, "pages")
    path = fresh_path(spark, "llm/warc")
    warc.write_archives(pages, path)
    return warc.pages_of(warc.read_archives(spark, path), pages.schema["page_id"].dataType.simpleString())
