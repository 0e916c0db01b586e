"""Bigram language model in Elias-Fano tries (operator 3).

Tokens: words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end token.

Model, learned from the training documents only:

    p1(w)   = (c(w) + 1) / (N + V + 1)
    p(w | h) = (c(h, w) + ``MASS`` * p1(w)) / (c(h) + ``MASS``)

with h the token before (a begin mark for the first).  The mass is the same
for every context and every size of the corpus: what was counted after a
context weighs against ``MASS`` tokens of the unigram model and nothing else.
It is a proper distribution, with one type set aside for all unknown words.

The tries are sharded by the hash of the predicted word, so they grow with the
corpus and no task or driver holds them whole.  Each shard is built from all
training occurrences of its words, written to a memory-mapped file and asked
for every occurrence in every document: place of the word, then the context
relative to it.  Values are quantised smoothed log10 numerators; the
denominators depend on the context alone and are added where its own shard
is.  ``base_score`` uses the exact counts.

Words whose count exceeds a shard's share are dealt out further by their
context; only the counts of frequent words (more than N / ``FREQUENT`` tokens,
so fewer than ``FREQUENT`` of them) are broadcast, and they change no result.

Defined results: a null or empty text is the end token alone; repeated rows
score alike and train as often as they occur; a null doc_id is a training
document (its crc32 is null); an empty training part scores by the unknown
type alone; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm import _text
from punctual.llm._store import stored
from punctual.llm.elias_fano import Trie
from punctual.session import ship_package

#: Most frequent words whose counts may be broadcast (16 bytes each); tokens of one shard.
FREQUENT, SHARD_TOKENS = 1 << 16, 3_000_000
#: Tokens that the unigram model counts for in each context.
MASS = 256.0
_END, _BEGIN = np.uint64(0xE17D), np.uint64(0xBE61)


def _tokens(texts: pa.Array):
    """(first document, token hashes, hashes of the tokens before, document of each token) by slice."""
    for a, b, data, offsets in _text.slices(texts):
        words = _text.hash_words(data, offsets, _text.SPACE_FOLDED)
        n = np.diff(words.first)
        doc = np.repeat(np.arange(b - a), n + 1)
        end = np.cumsum(n + 1) - 1
        token = np.empty(len(doc), np.uint64)
        is_end = np.zeros(len(doc), bool)
        is_end[end] = True
        token[is_end], token[~is_end] = _END, words.hash
        before = np.empty(len(doc), np.uint64)
        before[0] = _BEGIN
        before[1:] = np.where(is_end[:-1], _BEGIN, token[:-1])
        yield a, b, token, before, doc


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def count_tokens(docs: DataFrame, parts: int) -> DataFrame:
    """(part, word, n): counts of all training tokens; ``docs`` has held_out and text."""
    def count(batches):
        for batch in batches:
            train = ~batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, token, _, doc in _tokens(batch.column(1)):
                words, n = np.unique(token[train[a:b][doc]], return_counts=True)
                part = _part(words, parts)
                cut = np.searchsorted(part, np.arange(parts + 1))
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)),
                     pa.array([words[cut[p]:cut[p + 1]].tobytes() for p in some], pa.binary()),
                     pa.array([n[cut[p]:cut[p + 1]].astype(np.uint32).tobytes() for p in some], pa.binary())],
                    names=["part", "words", "n"])

    def merge(table: pa.Table) -> pa.Table:
        words = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint64)
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), np.uint32)
        kinds, place = np.unique(words, return_inverse=True)
        return pa.table({"word": pa.array(kinds.view(np.int64)),
                         "n": pa.array(np.bincount(place, n, len(kinds)).astype(np.int64))})

    return docs.select("held_out", "text").mapInArrow(count, "part int, words binary, n binary") \
        .groupBy("part").applyInArrow(merge, "word long, n long")


def _zip(x: np.ndarray) -> bytes:
    return np.int64(x.nbytes).tobytes() + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unzip(blob: bytes, kind) -> np.ndarray:
    size = int(np.frombuffer(blob, np.int64, 1)[0])
    return np.frombuffer(pa.decompress(blob[8:], size, codec="zstd", asbytes=True), kind)


@dataclass(frozen=True)
class Setting:
    """Corpus totals and the frequent tokens; small, goes to every task."""

    n: int
    v: int
    n_docs: int
    shards: int
    table: np.ndarray
    counts: np.ndarray
    mass: float

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Count of frequent tokens, 0 for all others."""
        if not len(self.table):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.table, hashes), len(self.table) - 1)
        return np.where(self.table[at] == hashes, self.counts[at], 0)

    def log_unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.n + self.v + 1))

    def shard_of(self, token: np.ndarray, before: np.ndarray) -> np.ndarray:
        """By word; words with more tokens than a quarter of a shard's share by word and context."""
        heavy = self.known(token) > self.n / (4 * self.shards)
        return _part(np.where(heavy, _text.mix(token ^ _text.mix(before)), token), self.shards)


def setting(docs: DataFrame, mass: float) -> Setting:
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = stored(count_tokens(docs, parts), "lm-words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
                       F.coalesce(F.max(F.when(F.col("word") == int(_END), F.col("n"))), F.lit(0)).alias("docs")).first()
    # fewer than FREQUENT rows, as all counts add up to n
    often = counts.where(F.col("n") > total["n"] / FREQUENT).toArrow()
    words = often.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return Setting(int(total["n"]), int(total["v"]), int(total["docs"]), max(4, -(-int(total["n"]) // SHARD_TOKENS)),
                   words[order], often.column("n").to_numpy()[order], mass)


_REQUEST = "part int, slice long, token binary, run binary, before binary, doc binary"
_REQUEST_NAMES = ["part", "slice", "token", "run", "before", "doc", "ids", "held_out"]


def _requests(docs: DataFrame, shared, kind: str) -> DataFrame:
    """All token occurrences by shard, packed by slice; and a row of its own for the documents of each slice."""
    def deal(batches):
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            s: Setting = shared.value
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id")
            for a, b, token, before, doc in _tokens(batch.column("text")):
                uid, count = (task << 32) + count, count + 1
                code = (doc * 2 + train[a:b][doc]).astype(np.uint32)
                part = s.shard_of(token, before)
                order = np.lexsort((code, before, token, part))
                token, before, code = token[order], before[order], code[order]
                cut = np.searchsorted(part[order], np.arange(s.shards + 1))
                rows = []
                for p in np.flatnonzero(np.diff(cut)):
                    x, y = cut[p], cut[p + 1]
                    change = np.flatnonzero(np.concatenate([[True], token[x + 1:y] != token[x:y - 1]]))
                    rows.append((int(p), uid, _zip(token[x:y][change]),
                                 _zip(np.diff(np.append(change, y - x)).astype(np.uint32)),
                                 _zip(before[x:y]), _zip(code[x:y])))
                cols = list(zip(*rows))
                n = len(rows)
                lists = pa.ListArray.from_arrays(pa.array([0] * (n + 1), pa.int32()), ids.slice(0, 0))
                flags = pa.ListArray.from_arrays(pa.array([0] * (n + 1), pa.int32()), pa.array([], pa.bool_()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()),
                     *[pa.array(c, pa.binary()) for c in cols[2:]], lists, flags], names=_REQUEST_NAMES)
                own = pa.array([0, b - a], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uid % s.shards], pa.int32()), pa.array([uid], pa.int64()),
                     *[pa.nulls(1, pa.binary()) for _ in range(4)],
                     pa.ListArray.from_arrays(own, ids.slice(a, b - a)),
                     pa.ListArray.from_arrays(own, pa.array(~train[a:b]))], names=_REQUEST_NAMES)

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        deal, f"{_REQUEST}, ids array<{kind}>, held_out array<boolean>")


def _occurrences(rows: list[dict]) -> list[np.ndarray]:
    """token, before, code of all occurrences of a shard, slice after slice."""
    out = []
    for r in rows:
        token = np.repeat(_unzip(r["token"], np.uint64), _unzip(r["run"], np.uint32))
        out.append((token, _unzip(r["before"], np.uint64), _unzip(r["doc"], np.uint32)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.uint64)] * 2 + [np.empty(0, np.uint32)]


def build_shard(token: np.ndarray, before: np.ndarray, s: Setting) -> bytes:
    """Trie of the training occurrences dealt to one shard."""
    order = np.lexsort((before, token))
    token, before = token[order], before[order]
    first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (before[1:] != before[:-1])])) \
        if len(token) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(token)))

    def log_word(words, totals):
        return s.log_unigram(np.maximum(totals, s.known(words)))

    def log_pair(_, contexts, counts, log10_word):
        return np.log10(counts + s.mass * 10.0 ** log10_word)
    return Trie.build(token[first], before[first], count, log_word, log_pair)


def ask_shard(trie: Trie, token: np.ndarray, before: np.ndarray, s: Setting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exact unigram log10, model log10, known) of each occurrence; the model's part holds the numerator of the
    token and the denominator of the token as a context (of the begin mark where the token is the end)."""
    # equal pairs lie side by side and are looked up once
    new = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (before[1:] != before[:-1])]))
    again = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(token))))
    base, model, known = _ask_pairs(trie, token[new], before[new], s)
    return base[again], model[again], known[again]


def _ask_pairs(trie: Trie, token: np.ndarray, before: np.ndarray, s: Setting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place, pair = trie.lookup(token, before)
    count = np.maximum(np.where(place >= 0, trie.count[np.maximum(place, 0)], 0) if len(trie.count) else 0, s.known(token))
    base = s.log_unigram(count)
    word = Trie._quantised(base) * Trie.STEP
    top = np.where(pair >= 0, trie.q2[np.maximum(pair, 0)] * Trie.STEP if len(trie.q2) else 0.0,
                   np.log10(s.mass) + word)
    bottom = np.where(token == _END, s.n_docs, count) + s.mass
    return base, top - np.log10(bottom), count > 0


def score(docs: DataFrame, held_out, mass: float = MASS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    ``held_out``: condition on the columns of ``docs`` that keeps a row out of training.  ``mass`` > 0: tokens that the
    unigram model counts for in each context.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kind = dict(docs.dtypes)["doc_id"]
    source = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"),
                         F.col("text").cast("string").alias("text"))
    about = setting(source, mass)
    shared = spark.sparkContext.broadcast(about)

    def serve(table: pa.Table) -> pa.Table:
        s: Setting = shared.value
        lists = table.filter(pc.is_null(table.column("token")))
        rows = table.filter(pc.is_valid(table.column("token"))).select(_REQUEST_NAMES[:6]).to_pylist()
        token, before, code = _occurrences(rows)
        train = (code & 1) == 1
        trie = Trie.mapped(build_shard(token[train], before[train], s))
        out = {"slice": [], "part": [], "sums": []}
        for r in rows:
            token, before, code = _occurrences([r])
            base, model, known = ask_shard(trie, token, before, s)
            holders, place = np.unique(code >> 1, return_inverse=True)
            sums = np.stack([holders.astype(np.float64), *(np.bincount(place, x, len(holders))
                                                           for x in (base, model, known, np.ones(len(known))))])
            out["slice"].append(r["slice"])
            out["part"].append(r["part"])
            out["sums"].append(_zip(sums))
        n = len(rows)
        answers = pa.table({
            "slice": pa.array(out["slice"], pa.int64()), "part": pa.array(out["part"], pa.int32()),
            "sums": pa.array(out["sums"], pa.binary()),
            "ids": pa.nulls(n, table.schema.field("ids").type),
            "held_out": pa.nulls(n, table.schema.field("held_out").type)})
        docs_of = pa.table({"slice": lists.column("slice"), "part": pa.nulls(len(lists), pa.int32()),
                            "sums": pa.nulls(len(lists), pa.binary()), "ids": lists.column("ids"),
                            "held_out": lists.column("held_out")})
        return pa.concat_tables([answers, docs_of])

    def add(table: pa.Table) -> pa.Table:
        own = table.filter(pc.is_valid(table.column("ids")))
        ids = own.column("ids").combine_chunks().flatten()
        total = np.zeros((4, len(ids)))
        rows = table.filter(pc.is_valid(table.column("sums")))
        for _, blob in sorted(zip(rows.column("part").to_pylist(), rows.column("sums").to_pylist())):
            sums = _unzip(blob, np.float64).reshape(5, -1)
            total[:, sums[0].astype(np.int64)] += sums[1:]
        return pa.table({"doc_id": ids, "held_out": own.column("held_out").combine_chunks().flatten(),
                         "n_tokens": pa.array(total[3].astype(np.int64)), "n_known": pa.array(total[2].astype(np.int64)),
                         "base_score": pa.array(total[0]), "score": pa.array(total[1])})

    answers = _requests(source, shared, kind).groupBy("part").applyInArrow(
        serve, f"slice long, part int, sums binary, ids array<{kind}>, held_out array<boolean>")
    return answers.groupBy("slice").applyInArrow(
        add, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double") \
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(about.n).cast("long").alias("train_tokens"),
                "base_score", "score")
