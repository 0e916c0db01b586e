"""Personal data by bootstrapped contextual extraction (operator 1).

Method: the four base expressions give seed entities.  Each mention (a seed,
or an identifier-like string that no base expression accepts) has lexical
patterns: the word before it or after it, with the shape of the mention, and
the two words before it.  Spark counts the bipartite pattern-instance graph
and scores it in rounds: a pattern scores the share of its distinct instances
that are known to be of a kind, an instance scores the noisy-or of its
patterns.  Patterns above ``confidence`` with enough known instances accept
unseen instances, which then support patterns of the next round.

Base spans (leftmost, not overlapping within a kind, failing matches dropped):
email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone (9 to 15
digits after ``+``).

Defined results: a null text is an empty one, without spans; repeated rows
give equal rows; rows that share a doc_id but not a text are judged apart;
added spans never touch a base span of the same text; of two kinds with equal
score an instance takes the first in the order above; extra columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.llm._store import null_safe, stored
from punctual.session import ship_package

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]

# Identifier-like strings: an address without a full domain, or at least five digits with few separators.
_AT = re.compile(r"@|\(at\)|\[at\]")
_HOST = re.compile(r" ?[A-Za-z0-9][A-Za-z0-9.-]*")
_NUMBER = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9]){4,}+")


def _emails(text: str):
    end = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            yield start, end


def _ips(text: str):
    for m in _DOTTED.finditer(text):
        parts = list(_PART.finditer(text, m.start(), m.end()))
        for i in range(0, len(parts) - 3, 4):
            if all(len(v := p.group().lstrip("0")) <= 3 and int(v or 0) <= 255 for p in parts[i:i + 4]):
                yield parts[i].start(), parts[i + 3].end()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += _DOUBLED[int(c)] if i % 2 else int(c)
    return total % 10 == 0


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), m.end()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            yield m.start(), m.end()


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind index, start, end) in code points, by kind and start."""
    if not text:
        return []
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, a, b) for a, b in _ips(text)]
        out += [(2, a, b) for a, b in _cards(text)]
        if "+" in text:
            out += [(3, a, b) for a, b in _phones(text)]
    return out


def _addresses(text: str):
    """(start, end) of local part, marker (``@``, ``(at)``, ``[at]``; a space may stand beside it) and host; a local part
    is walked back from its marker and never past the marker before."""
    behind = 0
    for m in _AT.finditer(text):
        host = _HOST.match(text, m.end())
        at = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
        start = at
        while start > behind and text[start - 1] in _LOCAL:
            start -= 1
        if host and start < at:
            yield start, at, host.end()
        behind = m.end()


def _loose(text: str):
    """Identifier-like strings, leftmost first and apart; of two that begin together the address."""
    end, number = 0, _NUMBER.search(text)
    for start, local_end, stop in _addresses(text):
        start = max(start, end)
        while number and number.start() < start:
            yield number.span()
            end = number.end()
            start = max(start, end)
            number = _NUMBER.search(text, end)
        if start < local_end:
            yield start, stop
            end = stop
            if number and number.start() < end:
                number = _NUMBER.search(text, end)
    while number:
        yield number.span()
        number = _NUMBER.search(text, number.end())


def _candidates(text: str, taken: list[tuple[int, int, int]]):
    busy, i = sorted((a, b) for _, a, b in taken), 0
    for a, b in _loose(text):
        while text[b - 1] in ".-":
            b -= 1
        while i < len(busy) and busy[i][1] <= a:
            i += 1
        if not any(x < b for x, _ in busy[i:i + 1]):
            yield a, b


_EDGE = " \t\r\n.,;:!?\"'()[]{}<>|"


def _shape(s: str) -> str:
    return re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]", "9", s))[:40]


def _patterns(text: str, a: int, b: int) -> list[str]:
    """Lexical patterns of the mention text[a:b]."""
    before = [w for w in (x.strip(_EDGE).lower() for x in text[max(0, a - 64):a].split()[-2:]) if w]
    after = [w for w in (x.strip(_EDGE).lower() for x in text[b:b + 48].split()[:1]) if w]
    shape, out = _shape(text[a:b]), []
    if before:
        out.append(f"< {before[-1]} | {shape}")
    if len(before) == 2:
        out.append(f"< {before[0]} {before[1]}")
    if after:
        out.append(f"> {after[0]} | {shape}")
    return out


_MENTION = "array<struct<kind: int, start: int, end: int, instance: string, patterns: array<string>>>"


def _mentions(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, content, mentions (kind null: not a base span)."""
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    arrow = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                                ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                base = base_spans(text)
                found = [(k, a, b) for k, a, b in base]
                if text and (base or "@" in text or _DIGIT.search(text) or "at" in text):
                    found += [(None, a, b) for a, b in _candidates(text, base)]
                rows.append([(k, a, b, text[a:b].lower(), _patterns(text, a, b)) for k, a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, arrow)],
                                             names=["doc_id", "content", "mentions"])

    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("content"), text.alias("text")).mapInArrow(
        run, f"doc_id {kind}, content long, mentions {_MENTION}")


def bootstrap(mentions: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 4
              ) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances): pattern, kind, score, known; instance, kind, score of the accepted ones.

    Pattern score: sum of the scores of its known instances over (its distinct instances + 1).
    """
    flat = mentions.select(F.explode("mentions").alias("m")).select("m.*")
    edges = stored(flat.select("instance", "kind", F.explode("patterns").alias("pattern"))
                   .groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-edges")
    seeds = edges.where("kind IS NOT NULL").select("instance", "kind").distinct() \
        .withColumn("score", F.lit(1.0))
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"),
                                          F.count("kind").alias("n_seed"))
    # only patterns that some seed induces can ever score
    useful = totals.where("n_seed > 0")
    open_edges = edges.join(useful.where("n > n_seed").select("pattern"), "pattern", "left_semi").where("kind IS NULL") \
        .select("pattern", "instance")
    known, patterns = seeds, None
    for r in range(rounds):
        scored = (edges.select("pattern", "instance").join(known, "instance")
                  .groupBy("pattern", "kind").agg(F.sum("score").alias("known"))
                  .join(useful.select("pattern", "n"), "pattern")
                  .select("pattern", "kind", "known", (F.col("known") / (F.col("n") + 1)).alias("score"))
                  .where((F.col("known") >= support - 1e-9) & (F.col("score") >= confidence)))
        patterns = stored(scored, f"pii-patterns-{r}")
        found = (open_edges.join(patterns.select("pattern", "kind", "score"), "pattern")
                 .groupBy("instance", "kind").agg(F.sum(F.log(1 - F.least(F.col("score"), F.lit(0.999)))).alias("miss"))
                 .select("instance", "kind", (1 - F.exp("miss")).alias("score"))
                 .groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("best"))
                 .select("instance", (-F.col("best.k")).alias("kind"), F.col("best.score").alias("score"))
                 .where(F.col("score") >= confidence))
        accepted = stored(found, f"pii-instances-{r}")
        known = seeds.unionByName(accepted)
    return patterns, accepted


def find(docs: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 4) -> DataFrame:
    """doc_id, content (hash of the text), base and spans: arrays of (kind, start, end) by kind index and start;
    one row for each row of ``docs``."""
    mentions = stored(_mentions(docs), "pii-mentions")
    _, accepted = bootstrap(mentions, rounds, confidence, support)
    loose = mentions.select("doc_id", "content", F.explode("mentions").alias("m")).where("m.kind IS NULL") \
        .select("doc_id", "content", "m.start", "m.end", "m.instance")
    added = (loose.join(accepted.select("instance", "kind"), "instance")
             .groupBy("doc_id", "content").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added")))
    base = F.transform(F.filter("mentions", lambda m: m["kind"].isNotNull()),
                       lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    out = null_safe(mentions.select("doc_id", "content", base.alias("base")), added, ["doc_id", "content"])
    return out.select("doc_id", "content", "base", F.array_sort(
        F.concat("base", F.coalesce("added", F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)"))))
        .alias("spans"))


def spelled(spans: str):
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span of its text replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``
    (overlapping spans together by the first one's mark); all columns stay.  A null text stays null."""
    found = find(docs, **options).where("size(spans) > 0").groupBy("doc_id", "content").agg(
        F.first("spans").alias("__spans"))
    keyed = docs.withColumn("content__", F.xxhash64(F.col("text").cast("string")))
    joined = null_safe(keyed.withColumnRenamed("content__", "__content"),
                       found.withColumnRenamed("content", "__content"), ["doc_id", "__content"])
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text").cast("string"))
                             .otherwise(_redacted(F.col("text").cast("string"), F.col("__spans")))) \
        .select(*[f"`{c}`" for c in docs.columns])


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span (kind, start, end) replaced; a span that begins inside the one before extends it."""
    out, end = [], 0
    for start, kind, stop in sorted((a, k, b) for k, a, b in spans):
        if start >= end:
            out += [text[end:start], f"[{KINDS[kind].upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


@F.pandas_udf(T.StringType())
def _redacted(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or s is None else redacted(t, [(x["kind"], x["start"], x["end"]) for x in s])
                      for t, s in zip(text, spans)], dtype=object)
