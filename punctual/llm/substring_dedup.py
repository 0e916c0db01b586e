"""Substring deduplication with repeated-phrase automata (operator 8).

Method, in three steps.

1. Candidate passages.  Each text is winnowed (k-grams of ``ANCHOR`` words,
   the minimum of each ``window`` words), so every ``window``-word sequence
   holds one kept anchor that depends on those words alone.  Anchors are dealt
   out by hash; one that occurs in two documents is recurring.
2. Confirmation.  Only windows whose own anchor recurs can recur.  Their
   hashes are dealt out once more; a window that starts in two documents is a
   confirmed phrase, and its smallest doc_id goes back to the documents that
   hold it.
3. Location.  Each bundle of documents joins the phrases that it was told of
   into passages (runs of overlapping phrases, at most ``PASSAGE`` of them in
   one), compiles these into Aho-Corasick automata over word numbers
   (pyahocorasick, about ``SHARD`` words in one) and streams its documents
   through them.  Every occurrence of a passage all of whose phrases start in
   a document with a smaller doc_id is removed; the passages of a document
   itself cover all that must go from it.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows are judged on the input.

Defined results: a null, empty or short text loses nothing; repeated rows and
rows of one doc_id never remove from one another; a null doc_id counts as
larger than all others; extra columns are ignored.

Scale: all exchanges carry packed arrays keyed by hash ranges, 8 bytes for
each anchor or candidate window, so a phrase that a third of all documents
hold adds 8 bytes for each of them to one range and no pairs.  The number of
ranges is ``spark.sql.shuffle.partitions``; answers go back by bundles of
documents (doc_id modulo a prime), together with which the texts are dealt out
once.  Nothing is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm import _text
from punctual.llm._deal import REQUEST, REQUEST_ARROW, head, packed, prime, request_batch, unpack
from punctual.llm.decontamination import winnow
from punctual.session import ship_package

WINDOW, ANCHOR = 13, 7
#: Words of all passages of one automaton (about 40 MB), phrases of one passage, documents of a bundle.
SHARD, PASSAGE, BUNDLE = 500_000, 128, 512
_LAST = np.iinfo(np.int64).max


_ANSWER = "bundle long, holders int, head binary, hashes binary, least binary"


def _answer(requests: DataFrame, bundles: int, only_larger: bool) -> DataFrame:
    """By bundle of documents: the packed hashes that occur in two documents, with the smallest doc_id of each.

    ``only_larger``: leave out the hashes whose smallest doc_id is the document's own.
    """
    def run(table: pa.Table) -> pa.Table:
        ids, hashes = unpack(table)
        order = np.lexsort((ids, hashes))
        ids, hashes = ids[order], hashes[order]
        begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        size = np.diff(np.append(begin, len(hashes)))
        least = np.repeat(ids[begin], size)
        keep = np.repeat(ids[begin + size - 1] != ids[begin], size)
        if only_larger:
            keep &= least < ids
        ids, hashes, least = ids[keep], hashes[keep], least[keep]
        bundle = ids % bundles
        order = np.lexsort((hashes, ids, bundle))
        bundle, ids, hashes, least = bundle[order], ids[order], hashes[order], least[order]
        cut = np.flatnonzero(np.concatenate([[True], bundle[1:] != bundle[:-1]])) if len(ids) else np.empty(0, int)
        out = {"bundle": bundle[cut], "holders": [], "head": [], "hashes": [], "least": []}
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)]):
            holders, n = np.unique(ids[x:y], return_counts=True)
            out["holders"].append(len(holders))
            out["head"].append(head(holders, n))
            out["hashes"].append(hashes[x:y].tobytes())
            out["least"].append(pa.compress(least[x:y].tobytes(), codec="zstd", asbytes=True))
        return pa.table([pa.array(out["bundle"], pa.int64()), pa.array(out["holders"], pa.int32()),
                         *[pa.array(out[c], pa.binary()) for c in ("head", "hashes", "least")]], names=list(out))

    return requests.groupBy("part").applyInArrow(run, _ANSWER)


def _anchors(texts: pa.Array) -> Iterator[tuple[int, _text.Words, np.ndarray, np.ndarray]]:
    for a, _, data, offsets in _text.slices(texts):
        words = _text.hash_words(data, offsets, _text.SPACE_EXACT)
        grams, at = _text.ngrams(words, ANCHOR)
        yield a, words, grams, at


def _holder_ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _anchor_requests(docs: DataFrame, window: int, ranges: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = _holder_ids(batch.column("holder"))
            for a, words, grams, at in _anchors(batch.column("text")):
                keep = winnow(grams, at, window - ANCHOR + 1)
                doc = np.searchsorted(words.first, at[keep], side="right") - 1
                rows = list(packed(ids[a:a + len(words.first) - 1], doc, grams[keep], ranges))
                if rows:
                    yield request_batch(rows)

    return docs.mapInArrow(run, REQUEST)


def _told(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All hashes that the documents of a bundle were told, sorted, and their smallest doc_ids."""
    hashes = np.frombuffer(b"".join(answers.column("hashes").to_pylist()), np.uint64)
    least = [np.frombuffer(pa.decompress(x, len(h), codec="zstd", asbytes=True), np.int64)
             for x, h in zip(answers.column("least").to_pylist(), answers.column("hashes").to_pylist())]
    hashes, first = np.unique(hashes, return_index=True)
    return hashes, np.concatenate(least)[first] if least else np.empty(0, np.int64)


def _text_of(table: pa.Table) -> pa.Array:
    return table.column("text").cast(pa.large_string()).combine_chunks()


def _member(sorted_set: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x


def _window_requests(dealt: DataFrame, anchors: DataFrame, window: int, ranges: int) -> DataFrame:
    runs = window - ANCHOR + 1

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if len(answers) and len(table):
            ids, (recurring, _) = _holder_ids(table.column("holder")), _told(answers)
            for a, words, grams, at in _anchors(_text_of(table)):
                n = len(grams) - runs + 1
                if n <= 0:
                    continue
                best = grams[:n].copy()
                for j in range(1, runs):
                    np.minimum(best, grams[j:j + n], out=best)
                start = at[:n][_member(recurring, best) & (at[runs - 1:] - at[:n] == runs - 1)]
                windows, where = _text.ngrams(words, window)
                doc = np.searchsorted(words.first, start, side="right") - 1
                rows += packed(ids[a:a + len(words.first) - 1], doc, windows[np.searchsorted(where, start)], ranges)
        return pa.Table.from_batches([request_batch(rows)] if rows else [], schema=REQUEST_ARROW)

    return dealt.groupBy("bundle").cogroup(anchors.groupBy("bundle")).applyInArrow(run, REQUEST)


def _passages(words: _text.Words, ids: np.ndarray, phrases: np.ndarray, least: np.ndarray, window: int
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words, document and largest smallest doc_id of each run of phrases to be removed."""
    windows, at = _text.ngrams(words, window)
    known = np.flatnonzero(_member(phrases, windows))
    smallest = least[np.searchsorted(phrases, windows[known])]
    doc = np.searchsorted(words.first, at[known], side="right") - 1
    gone = smallest < ids[doc]
    start, doc, smallest = at[known][gone], doc[gone], smallest[gone]
    if not len(start):
        return (np.empty(0, np.int64),) * 4
    new = np.concatenate([[True], (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    place = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
    begin = np.flatnonzero(place % PASSAGE == 0)
    size = np.diff(np.append(begin, len(start)))
    return start[begin], size + window - 1, doc[begin], np.maximum.reduceat(smallest, begin)


def _automata(numbers: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[ahocorasick.Automaton]:
    """Automata over word numbers; the value of a passage is its place in ``start``."""
    shard = np.cumsum(size) // SHARD
    for k in np.unique(shard):
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i in np.flatnonzero(shard == k).tolist():
            machine.add_word(tuple(numbers[start[i]:start[i] + size[i]].tolist()), i)
        machine.make_automaton()
        yield machine


def _covered(words: _text.Words, ids: np.ndarray, phrases: np.ndarray, least: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in an occurrence of a phrase that starts in a smaller document."""
    covered = np.zeros(len(words.hash), bool)
    start, size, holder, largest = _passages(words, ids, phrases, least, window)
    if not len(start):
        return covered
    numbers = np.unique(words.hash, return_inverse=True)[1]
    for machine in _automata(numbers, start, size):
        for d in np.unique(holder).tolist():  # no other document has anything to lose
            a, b = words.first[d], words.first[d + 1]
            hits = list(machine.iter(tuple(numbers[a:b].tolist())))
            if hits:
                end, passage = np.array(hits, np.int64).T
                ours = largest[passage] < ids[d]
                end, passage = end[ours], passage[ours]
                change = np.zeros(b - a + 1, np.int32)
                np.add.at(change, end - size[passage] + 1, 1)
                np.add.at(change, end + 1, -1)
                covered[a:b] |= np.cumsum(change[:-1]) > 0
    return covered


def _locate(dealt: DataFrame, phrases: DataFrame, kind: str, window: int, with_text: bool) -> DataFrame:
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids, told = _holder_ids(table.column("holder")), _told(answers)
        n_words, n_removed, kept = [], [], []
        for a, b, data, offsets in _text.slices(_text_of(table)):
            words = _text.hash_words(data, offsets, _text.SPACE_EXACT)
            gone = _covered(words, ids[a:b], *told, window)
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[words.first[1:]] - total[words.first[:-1]]
            n_words.append(np.diff(words.first))
            n_removed.append(removed)
            for d in range(b - a):
                parts = data[offsets[d]:offsets[d + 1]].tobytes().split()
                if removed[d]:
                    stay = ~gone[words.first[d]:words.first[d + 1]]
                    parts = [p for p, s in zip(parts, stay.tolist()) if s]
                line = b" ".join(parts)
                kept.append(line.decode() if with_text else hashlib.sha256(line).hexdigest())
        return pa.table({"doc_id": table.column("doc_id"),
                         "n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                         "n_removed": pa.array(np.concatenate(n_removed) if n_words else [], pa.int64()),
                         "kept": pa.array(kept, pa.string())})

    return dealt.groupBy("bundle").cogroup(phrases.groupBy("bundle")).applyInArrow(
        run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` (the words that stay, joined by one space; with ``with_text``
    false their SHA-256, so that texts stay in the tasks) for each row of ``docs``."""
    if window <= ANCHOR:
        raise ValueError(f"a window has more than {ANCHOR} words")
    spark = docs.sparkSession
    ship_package(spark)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)["doc_id"]
    source = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST))).alias("holder"),
                         F.col("text").cast("string").alias("text"))
    bundles = prime(-(-docs.count() // BUNDLE))
    requests = _anchor_requests(source.select("holder", "text"), window, ranges)
    # the one exchange of the texts serves both cogroups
    dealt = source.withColumn("bundle", F.pmod("holder", F.lit(bundles).cast("long"))).repartition(ranges, "bundle")
    anchors = _answer(requests, bundles, False)
    windows = _window_requests(dealt, anchors, window, ranges)
    return _locate(dealt, _answer(windows, bundles, True), kind, window, with_text)
