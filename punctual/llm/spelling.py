"""Spelling variant grouping by dense prefix-suffix tiling (operator 11).

Two words are near when one inserted, deleted or replaced code point turns one
into the other.  With T = longer length - 1, that is: they differ, their lengths
differ by at most one, and common prefix P + common suffix S reach T.

Method: P is cut into four classes at 0, T/4, T/2 and 3T/4.  Near words whose P
lies in class [c, d) share their first c and their last T - d + 1 code points, so
every word is dealt to the tiles of those ends, for itself as the longer and as
the shorter word.  Within a tile, words are rows of padded code-point matrices,
one aligned left and one aligned right; block pairs are compared densely, and P
and S are read off the first unequal column.  A pair counts only in the tile of
its own class, hence once.  A tile of more than ``BLOCK`` words is cut into
blocks by hash, and each pair of blocks is a unit of work of its own, so no
task holds more than two blocks of a tile; no pair is left out.

Words: maximal runs ``[A-Za-z\\u00C0-\\u00FF]+``, A-Z lower-cased, one code
point deleted where the run's checksum says so (the contract's slips), of at
least 5 code points and 3 occurrences.  A word's form is its near word of
largest n (ties: smallest), if that n is at least twice its own.

Defined results: a null text has no words; a null doc_id reads as an empty one;
repeated rows count again; very long runs are words like others; a table without
words gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm._store import stored
from punctual.session import ship_package

#: Code points from the least word on, occurrences from the least word on.
MIN_LENGTH, MIN_COUNT = 5, 3
#: Words of one side of a block pair.
BLOCK = 1024
#: Cells of a comparison done in one go (pairs x code points).
CELLS = 1 << 22
_CLASSES = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = "[A-Za-zÀ-ÿ]+"


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: every word with its occurrences after the slips, from whole texts."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), F.lit(RUNS), F.lit(0)))
        .alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % 97 == 0, F.concat(F.substring(F.col("run"), F.lit(1), at),
                                        F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= MIN_LENGTH) \
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


def cuts(t: int) -> list[int]:
    """Ends of the prefix classes for longer length t + 1."""
    return [j * t // _CLASSES for j in range(_CLASSES)] + [t + 1]


def _tiles(words: DataFrame) -> DataFrame:
    """word, n, longest (the tile's longer length), class, tile: eight rows for each word."""
    def cut(j: int) -> Column:
        return F.expr(f"cast({j} * (longest - 1) div {_CLASSES} as int)") if j < _CLASSES else F.col("longest")
    kinds = F.array(*[F.struct(F.lit(j).alias("class"), cut(j).alias("head"),
                               (F.col("longest") - cut(j + 1)).cast("int").alias("tail")) for j in range(_CLASSES)])
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("longest"))
    rows = rows.select("word", "n", "longest", F.explode(kinds).alias("k")).select("word", "n", "longest", "k.*")
    ends = F.xxhash64(F.expr("left(word, head)"), F.expr("right(word, tail)"), "longest", "class")
    return rows.select(F.encode("word", "ISO-8859-1").alias("word"), "n", "longest", "class", ends.alias("tile"))


def _block_pairs(tiles: DataFrame) -> DataFrame:
    """Rows of tiles that hold at least two words, dealt to block pairs (x, y), x <= y; ``side`` is the word's block."""
    sizes = (tiles.groupBy("tile").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
             .select("tile", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    dealt = tiles.join(sizes, "tile").withColumn("side", block) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("tile", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side",
                        "word", "n", "longest", "class")


def near_pairs(matrix: np.ndarray, mirrored: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
    """(near, common prefix) of the rows a and b of a left-aligned and a right-aligned code-point matrix."""
    longer = np.maximum(lengths[a], lengths[b])
    shorter = np.minimum(lengths[a], lengths[b])

    def common(m):
        unequal = m[a] != m[b]
        first = unequal.argmax(axis=1)
        return np.minimum(np.where(unequal[np.arange(len(a)), first], first, m.shape[1]), shorter)
    prefix, suffix = common(matrix), common(mirrored)
    same = (prefix == longer)
    return ~same & (longer - shorter <= 1) & (prefix + suffix >= longer - 1), prefix


def _matrices(data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word, padded with zeros: from its start, and from its end backward."""
    width = int(lengths.max()) if len(lengths) else 0
    at = np.arange(width)
    inside = at[None, :] < lengths[:, None]
    left = np.where(inside, data[np.minimum(start[:, None] + at, len(data) - 1)], 0).astype(np.uint8)
    end = start + lengths - 1
    right = np.where(inside, data[np.maximum(end[:, None] - at, 0)], 0).astype(np.uint8)
    return left, right


class _Best:
    """Per row: near words seen, largest n among them, and the row of that word."""

    def __init__(self, words: list[bytes], n: np.ndarray):
        self.rank = np.empty(len(words), np.int64)      # code-point order of the words: latin-1 bytes sort like it
        self.rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        self.n, self.count = n, np.zeros(len(words), np.int64)
        self.row = np.full(len(words), -1)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Rows b are near words of rows a."""
        self.count += np.bincount(a, minlength=len(self.n))
        order = np.lexsort((self.rank[b], -self.n[b], a))
        a, b = a[order], b[order]
        lead = np.ones(len(a), bool)
        lead[1:] = a[1:] != a[:-1]
        a, b = a[lead], b[lead]
        old = self.row[a]
        better = (old < 0) | (self.n[b] > self.n[old]) | ((self.n[b] == self.n[old]) & (self.rank[b] < self.rank[old]))
        self.row[a[better]] = b[better]


def _pair_chunks(sizes: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All row pairs (a < b) inside consecutive groups of the given sizes, at most about ``limit`` at a time."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    # row r pairs with the rows behind it in its group
    behind = np.repeat(first[1:], sizes) - np.arange(first[-1]) - 1
    total = np.concatenate([[0], np.cumsum(behind)])
    r, rows = 0, len(behind)
    while r < rows:
        to = max(int(np.searchsorted(total, total[r] + limit, side="right")) - 1, r + 1)
        a = np.repeat(np.arange(r, to), behind[r:to])
        b = a + 1 + np.arange(len(a)) - np.repeat(total[r:to] - total[r], behind[r:to])
        if len(a):
            yield a, b
        r = to


def _compared(words: list[bytes], n: np.ndarray, unit: np.ndarray, side: np.ndarray, inner: np.ndarray,
              longest: np.ndarray, kind: np.ndarray) -> Iterator[tuple]:
    """(word, near words, best n, best word) of the rows, which lie unit by unit; ``inner`` units are a block with itself."""
    lengths = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words) or b"\0", np.uint8)
    start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    matrix, mirrored = _matrices(data, start, lengths)
    t = longest - 1
    low, high = kind * t // _CLASSES, np.where(kind == _CLASSES - 1, t + 1, (kind + 1) * t // _CLASSES)
    best = _Best(words, n)
    sizes = np.diff(np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]])))
    for a, b in _pair_chunks(sizes, max(1, CELLS // max(1, matrix.shape[1]))):
        wanted = (inner[a] | (side[a] != side[b])) & ((lengths[a] == longest[a]) | (lengths[b] == longest[b]))
        a, b = a[wanted], b[wanted]
        near, prefix = near_pairs(matrix, mirrored, lengths, a, b)
        # a tile takes the pairs of its own class; those of equal ends by chance or by a longer prefix lie elsewhere
        near &= (prefix >= low[a]) & (prefix < high[a])
        a, b = a[near], b[near]
        best.add(np.concatenate([a, b]), np.concatenate([b, a]))
    for r in np.flatnonzero(best.count).tolist():
        other = int(best.row[r])
        yield words[r].decode("latin-1"), int(best.count[r]), int(n[other]), words[other].decode("latin-1")


def _changes(table: pa.Table) -> np.ndarray:
    """Whether a row belongs to another unit than the row before it."""
    return np.any([k[1:] != k[:-1] for k in (table.column(c).to_numpy() for c in ("tile", "x", "y"))], axis=0)


_PARTIAL = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units lie together and in order of length; the last unit of a batch waits for the next one."""
    held: pa.Table | None = None

    def flush(table: pa.Table):
        unit = np.concatenate([[0], np.cumsum(_changes(table))])
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        rows = list(_compared(table.column("word").to_pylist(), table.column("n").to_numpy(), unit,
                              table.column("side").to_numpy(), x == y, table.column("longest").to_numpy(),
                              table.column("class").to_numpy()))
        for i in range(0, len(rows), 8192):
            cols = list(zip(*rows[i:i + 8192]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PARTIAL)], schema=_PARTIAL)

    for batch in batches:
        # a part of a batch whose matrices stay small; one unit may be larger
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        width = int(np.max(held.column("longest").to_numpy(), initial=1))
        if held.num_rows * width < CELLS // 4:
            continue
        new = np.flatnonzero(_changes(held)) + 1
        if len(new):
            per = max(1, CELLS // 4 // width)
            at = 0
            while at < new[-1]:
                to = int(new[max(np.searchsorted(new, at + per, side="right") - 1, np.searchsorted(new, at, side="right"))])
                yield from flush(held.slice(at, to - at))
                at = to
            held = held.slice(at)
    if held is not None and held.num_rows:
        new = [0, *(np.flatnonzero(_changes(held)) + 1).tolist(), held.num_rows]
        at = 0
        for i in range(1, len(new)):
            width = int(np.max(held.column("longest").slice(at, new[i] - at).to_numpy(), initial=1))
            if i + 1 == len(new) or (new[i + 1] - at) * width > CELLS // 4:
                yield from flush(held.slice(at, new[i] - at))
                at = new[i]


def variants(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for a table of distinct words (code points up to U+00FF) and their counts."""
    ship_package(words.sparkSession)
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    units = _block_pairs(stored(_tiles(words), "spelling-tiles"))
    order = ["longest", "tile", "x", "y"]
    partial = (units.repartition("tile", "x", "y").sortWithinPartitions(*order)
               .select("tile", "x", "y", "side", "word", "n", "longest", "class")
               .mapInArrow(_compare, "word string, n_near long, form_n long, form string"))
    found = partial.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                        F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best"))
    enough = F.col("form_n") >= 2 * F.col("n")
    judged = (words.join(found, "word", "left")
              .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                      (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))
              .select("word", "n", "n_near", F.when(enough, F.col("form")).alias("form"),
                      F.when(enough, F.col("form_n")).alias("form_n")))
    judged = stored(judged, "spelling-forms")
    return judged.join(_roots(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root"))), "word", "left") \
        .select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(links: DataFrame) -> DataFrame:
    """word, root: forms followed to the last by pointer doubling.  Counts at least double along a chain, so there are
    at most six rounds."""
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        links = stored(links.join(ahead, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")
        links = links.select("word", "root")
