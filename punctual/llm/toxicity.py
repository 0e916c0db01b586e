"""Toxicity scores of deobfuscated text (operator 9).

Method: a noisy channel.  The writer's word went through a channel that
replaces letters by look-alikes, repeats letters, and puts signs or spaces
between them.  A suspicious string becomes a lattice of the letters that may
stand behind each of its characters; Viterbi search finds its most probable
path under a character trigram model and the frequencies of known words, both
counted over the words of all documents; gaps and signs are dropped or end a
word.  Strings of any length are decoded.
The restored text is what gets scored.

Scoring: whole words and word beginnings that are much more frequent in toxic
than in other documents form a lexicon (log odds); a logistic regression on a
document's lexicon hits, fitted on labelled rows that the lexicon has not
seen, gives a probability.  Both use every labelled row: three fifths of the
ids count for the lexicon, two fifths for the regression, whose Newton steps
are sums over the stored hits.  Only the model itself is bounded: its known
words and lexicon entries.

Defined results: null, empty and wordless texts get the score of a text
without hits; repeated rows score alike; a null doc_id or label never trains;
of repeated labels of one doc_id the largest counts; without labels of both
kinds every score is the share of label 1 (0 without labels); lang, source,
labels and ids never enter a score; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm import _kept, _text
from punctual.llm._store import stored
from punctual.session import ship_package

#: Bounds of the model: lexicon entries, known words.
MAX_LEXICON, MAX_WORDS = 8_000, 20_000
#: Rows of a batch that a task turns into Python texts at once.
_ROWS = 512
#: Distinct words, and features, that a task counts before it hands them on.
_WORDS_HELD, _FEATURES_HELD = 250_000, 1 << 20
_PREFIXES = (3, 4, 5, 6, 7)

# ---- character model ---------------------------------------------------------------------------------------------

_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
_INDEX = {c: i + 1 for i, c in enumerate(_LETTERS)}  # 0 is the word boundary
_SIZE = len(_LETTERS) + 1

# Letters that a sign or digit may stand for.
_LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
_MASKS = "*#_-.~^'"
_VOWELS = "aeiou"
#: log10 costs of the channel: a look-alike, a sign to be dropped, a masked vowel, a shortened repetition.
_SWAP, _DROP, _MASKED, _REPEAT = -0.3, -0.6, -1.0, -0.3
#: A gap between single letters that is dropped or stays, a sign that ends a word, digits (signs: twice this) that stay
#: at a word's end.
_JOIN, _SPLIT, _BREAK, _KEPT = -0.1, -0.8, -0.8, -2.5
_BEAM = 48


_CODES = np.full(0x200, 255, np.uint8)
for _c, _i in _INDEX.items():
    _CODES[ord(_c)] = _i
_CODES[ord("\n")] = 0


def _spelt(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all words, each with a boundary behind it; where each begins; which hold letters only)."""
    points = np.frombuffer("".join(f"{w}\n" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _CODES[np.minimum(points, 0x1FF)]
    begin = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words[:-1]], dtype=np.int64)])
    sizes = np.diff(np.append(begin, len(codes)))
    return codes, begin, (sizes > 1) & (np.maximum.reduceat(codes, begin) < 255)


def _word_trigrams(words: Counter) -> np.ndarray:
    if not words:
        return np.zeros(_SIZE ** 3, np.int64)
    codes, begin, plain = _spelt([w.strip(".,;:!?|\"'()") for w in words])
    sizes = np.diff(np.append(begin, len(codes)))
    keep = np.repeat(plain, sizes)
    c = codes.astype(np.int64)
    b = np.concatenate([[0], c[:-1]])  # a boundary stands before every word
    a = np.concatenate([[0], b[:-1]])
    a[begin] = 0
    n = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes)
    return np.bincount(((a * _SIZE + b) * _SIZE + c)[keep], n[keep], _SIZE ** 3).astype(np.int64)


def _plain_words(words: Counter) -> Counter:
    """The words of letters alone, without the signs around them."""
    out: Counter = Counter()
    for w, n in words.items():
        out[w.strip(_EDGES + "!")] += n
    spellings = list(out)
    plain = _spelt(spellings)[2] if spellings else []
    return Counter({w: out[w] for w, ok in zip(spellings, plain) if ok})


def _parts(batches):
    """The rows of ``batches``, a few at a time: what a task makes of them is freed before the next ones."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _word_counts(docs: DataFrame, known: bool = True) -> DataFrame:
    """Counts over the words of all texts, of two kinds of rows: letter trigrams (``gram``), whose number does not depend
    on the input, and with ``known`` the plain words (``word``)."""
    def count(batches):
        _kept.release()

        def grams():
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(at), pa.nulls(len(at), pa.string()), pa.array(total[at])],
                                              names=["gram", "word", "n"])

        def flushed():
            nonlocal total
            total += _word_trigrams(words)
            plain = _plain_words(words) if known else {}
            words.clear()
            return pa.RecordBatch.from_arrays(
                [pa.nulls(len(plain), pa.int64()), pa.array(list(plain), pa.string()),
                 pa.array(list(plain.values()), pa.int64())], names=["gram", "word", "n"])
        total = np.zeros(_SIZE ** 3, np.int64)
        words: Counter = Counter()
        for batch in _parts(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    words.update(text.lower().split())
                    if len(words) > _WORDS_HELD:
                        yield flushed()
        yield flushed()
        yield grams()

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "gram long, word string, n long") \
        .groupBy("gram", "word").agg(F.sum("n").alias("n"))


def _trigram_model(counts: DataFrame) -> np.ndarray:
    found = counts.where("gram IS NOT NULL").select("gram", "n").toArrow()
    counts = np.zeros(_SIZE ** 3)
    counts[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    counts = counts.reshape(_SIZE, _SIZE, _SIZE)
    two = counts.sum(axis=0)  # (b, c) whatever came before
    one = (two.sum(axis=0) + 1) / (two.sum() + _SIZE)
    mid = (two + 10 * one) / (two.sum(axis=1, keepdims=True) + 10)
    return np.log10((counts + 10 * mid) / (counts.sum(axis=2, keepdims=True) + 10))


def character_model(docs: DataFrame) -> np.ndarray:
    """log10 trigram probabilities of the letters of all words; its size does not depend on the input."""
    return _trigram_model(_word_counts(docs, known=False))


# ---- lattice -----------------------------------------------------------------------------------------------------

def _runs(token: str) -> list[int]:
    """How often the character at each place is repeated from there on."""
    out = [1] * len(token)
    for i in range(len(token) - 2, -1, -1):
        if token[i] == token[i + 1]:
            out[i] = out[i + 1] + 1
    return out


def _arcs(token: str, i: int, run: int):
    """(characters consumed, letters emitted, cost) at place i of the token; a space ends a word."""
    c = token[i]
    inside = 0 < i < len(token) - 1
    if c == " ":
        yield 1, "", _JOIN
        yield 1, " ", _SPLIT
        return
    if c in _INDEX:
        if run >= 3:
            yield run, c, _REPEAT
            yield run, c + c, _REPEAT
        else:
            yield 1, c, 0.0
    for letter in _LOOKS_LIKE.get(c, ""):
        yield 1, letter, _SWAP
        if run >= 3:
            yield run, letter, _SWAP + _REPEAT
    if c in _MASKS:
        yield 1, "", _DROP
        if inside:
            yield 1, " ", _BREAK
            for v in _VOWELS:
                yield 1, v, _MASKED
    elif c not in _INDEX and c not in _LOOKS_LIKE:
        yield 1, "", 2 * _DROP
        if inside:
            yield 1, " ", _BREAK


def _spelled(path, back_to: str | None = None) -> str:
    """Letters of a path, or only those after the last ``back_to``."""
    out = []
    while path:
        path, letters = path
        if letters == back_to:
            break
        out.append(letters)
    return "".join(reversed(out))


def decode(token: str, model, words: dict[str, float] | None = None) -> str:
    """Most probable words behind a lower-case token: Viterbi over the last two letters and the place where the word
    began, at most ``_BEAM`` kept.  ``words`` are known words, with what their frequency adds to the trigrams.  A space
    in the token is a gap between single letters.  Time and memory grow with the token's length alone."""
    n, runs = len(token), _runs(token)
    tail = n  # look-alikes from here on may also stay as they are
    while tail and token[tail - 1] in _LOOKS_LIKE:
        tail -= 1

    def closed(state, p, path):
        a, b, _ = state
        return p + model[a][b][0] + (words.get(_spelled(path, " "), 0.0) if words else 0.0)
    best: list[dict] = [{} for _ in range(n + 1)]
    best[0][(0, 0, 0)] = (0.0, None)
    ends = []
    for i in range(n):
        if not best[i]:
            continue
        front = best[i] if len(best[i]) <= _BEAM else dict(
            sorted(best[i].items(), key=lambda x: (-x[1][0], x[0]))[:_BEAM])
        if i == tail and i:
            cost = 0.0 if not token[i:].strip("!") else _KEPT if token[i:].isdigit() else 2 * _KEPT
            ends += [(cost + closed(state, p, path), (path, token[i:])) for state, (p, path) in front.items()]
        for width, letters, cost in _arcs(token, i, runs[i]):
            to = best[i + width]
            for state, (p, path) in front.items():
                a, b, start = state
                if letters == " ":
                    if not b:
                        continue  # no word to end
                    p = closed(state, p, path)
                    a, b, start = 0, 0, i + width
                else:
                    for c in letters:
                        k = _INDEX[c]
                        p += model[a][b][k]
                        a, b = b, k
                p += cost
                old = to.get((a, b, start))
                if old is None or p > old[0]:
                    to[(a, b, start)] = (p, (path, letters) if letters else path)
        best[i] = {}
    ends += [(closed(state, p, path) if state[1] else p, path) for state, (p, path) in best[-1].items()]
    return _spelled(max(ends, key=lambda x: x[0])[1]) if ends else token


def known_words(counts: DataFrame, characters: np.ndarray) -> dict[str, float]:
    """The ``MAX_WORDS`` most frequent words of ``_word_counts``, with what their frequency adds to their trigrams
    (log10)."""
    counts = counts.where("word IS NOT NULL")
    total = counts.agg(F.sum("n")).first()[0]
    model, out = characters.tolist(), {}
    for word, n in counts.where("n >= 3").select("word", "n").orderBy(F.desc("n"), "word").limit(MAX_WORDS).collect():
        p, a, b = 0.0, 0, 0
        for c in [*word, ""]:
            k = _INDEX.get(c, 0)
            p += model[a][b][k]
            a, b = b, k
        if math.log10(n / total) > p:
            out[word] = math.log10(n / total) - p
    return out


def vocabulary(docs: DataFrame) -> tuple[np.ndarray, dict[str, float]]:
    """Character model and known words of all texts, from one pass over them."""
    counts = stored(_word_counts(docs), "toxicity-words")
    characters = _trigram_model(counts)
    return characters, known_words(counts, characters)


# A string is suspicious that has signs or digits before a letter, within the string or a look-alike at its start, or
# look-alikes after a letter, or a letter three times; so are single characters with gaps between them.
_SIGNS = re.compile(r"[0-9@$!|+(<€£¡*#_.~^'-]+(?=[a-zß-öø-ÿœ])|(?<=[a-zß-öø-ÿœ])[0-9@$!|+€£¡]+")
_SPACED = re.compile(r"(?<![^\s])(?:[^\W_]|[@$!|+(<€£¡])(?:[ .\-_*]+(?:[^\W_]|[@$!|+(<€£¡])(?![^\W_])){3,}")
_GAPS = re.compile(r"[ .\-_*]+")
_STRING = re.compile(r"\S+")
_START = frozenset("0123456789@$!|+€£¡")
_TRIPLES = [c * 3 for c in _LETTERS]
_EDGES = ".,;:?\"'()[]{}<>#%&*=/\\|~^_-"


def _suspects(text: str) -> list[tuple[int, int]]:
    """Spans of the suspicious strings of a lower-case text, in order."""
    at = []
    for m in _SIGNS.finditer(text):
        i = m.start()
        if text[i] in _START or (i and not text[i - 1].isspace()):
            at.append(i)
    for c in _TRIPLES:
        i = text.find(c)
        while i >= 0:
            at.append(i)
            i = text.find(c, i + 3)
    spans: list[tuple[int, int]] = []
    for i in sorted(at):
        if spans and i < spans[-1][1]:
            continue
        begin = i
        while begin and not text[begin - 1].isspace():
            begin -= 1
        spans.append((begin, _STRING.match(text, begin).end()))
    return spans


class Restorer:
    """Restores texts; remembers decoded strings up to a fixed number."""

    def __init__(self, model: np.ndarray, words: dict[str, float] | None = None):
        self.model, self.words, self.seen = model.tolist(), words, {}

    def _token(self, s: str) -> str:
        core = s.strip(_EDGES)
        return self._decoded(core) if any(c in _INDEX for c in core) else s

    def _spaced(self, m: re.Match) -> str:
        run = _GAPS.sub(" ", m[0])
        return self._decoded(run) if any(c in _INDEX for c in run) else m[0]

    def _decoded(self, s: str) -> str:
        if len(s) > 200:  # seldom twice, and not worth the memory
            return decode(s, self.model, self.words)
        if s not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            self.seen[s] = decode(s, self.model, self.words)
        return self.seen[s]

    def __call__(self, text: str | None) -> str:
        """Lower-case text in which every suspicious string is replaced by the word behind it."""
        if not text:
            return ""
        text = text.lower()
        out, end = [], 0
        for m in _SPACED.finditer(text):
            out += [self._strings(text[end:m.start()]), self._spaced(m)]
            end = m.end()
        return "".join([*out, self._strings(text[end:])])

    def _strings(self, text: str) -> str:
        out, end = [], 0
        for a, b in _suspects(text):
            out += [text[end:a], self._token(text[a:b])]
            end = b
        return "".join([*out, text[end:]])


def restore(docs: DataFrame, model: np.ndarray | None = None) -> DataFrame:
    """doc_id, restored: the deobfuscated lower-case text of each row."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(character_model(docs) if model is None else model)

    def run(batches):
        _kept.release()
        restorer = Restorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([restorer(t) for t in batch.column(1).to_pylist()], pa.string())],
                names=["doc_id", "restored"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, restored string")


# ---- lexicon and scores ------------------------------------------------------------------------------------------

def _features(restorer: Restorer, texts: list[str | None], limit: int = 1 << 21):
    """(document, words before it, feature hashes, place of the word) by runs of restored texts."""
    at = 0
    while at < len(texts):
        run, size = [], 0
        while at + len(run) < len(texts) and (not run or size < limit):
            run.append(restorer(texts[at + len(run)]))
            size += len(run[-1])
        data, offsets = _text.text_buffer(pa.array(run, pa.large_string()))
        words = _text.hash_words(data, offsets, _text.ALNUM_FOLDED)
        length = words.end - words.start
        parts, place = [words.hash], [np.arange(len(length))]
        if len(data):
            up, down = _text._powers(len(data) + 1)
            total = np.concatenate([np.zeros(1, np.uint64),
                                    np.cumsum(_text.ALNUM_FOLDED.value[data] * up[:len(data)], dtype=np.uint64)])
            for k in _PREFIXES:
                some = np.flatnonzero(length > k)
                start = words.start[some]
                h = (total[start + k] - total[start]) * down[start]
                parts.append(_text.mix(h ^ np.uint64(0x5EED0000 + k)))
                place.append(some)
        yield at, len(run), words, np.concatenate(parts), np.concatenate(place)
        at += len(run)


@dataclass(frozen=True)
class Lexicon:
    hashes: np.ndarray
    weights: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, weights: np.ndarray) -> Lexicon:
        order = np.argsort(hashes)
        bitmap = np.zeros(1 << 14, np.uint64)
        slot = hashes & np.uint64((1 << 20) - 1)
        np.bitwise_or.at(bitmap, slot >> np.uint64(6), np.uint64(1) << (slot & np.uint64(63)))
        return cls(hashes[order], weights[order], bitmap)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` that are in the lexicon, and their weights."""
        slot = h & np.uint64((1 << 20) - 1)
        maybe = np.flatnonzero((self.bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
        if not len(maybe) or not len(self.hashes):
            return np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == h[maybe]
        return maybe[hit], self.weights[at[hit]]


def _evidence(restorer: Restorer, lexicon: Lexicon, texts: list[str | None]) -> np.ndarray:
    """For each text: largest weight, sum of the five largest, log of the number of words with a weight."""
    out = np.zeros((len(texts), 3))
    for at, _, words, h, place in _features(restorer, texts):
        hit, weight = lexicon.find(h)
        if not len(hit):
            continue
        # a word counts by its best feature, a repeated word of a document once
        doc = np.searchsorted(words.first, place[hit], side="right") - 1
        key = words.hash[place[hit]]
        order = np.lexsort((-weight, key, doc))
        doc, key, weight = doc[order], key[order], weight[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
        doc, weight = doc[new], weight[new]
        order = np.lexsort((-weight, doc))
        doc, weight = doc[order], weight[order]
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        rank = np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))
        out[at + doc[begin], 0] = weight[begin]
        np.add.at(out[:, 1], at + doc, np.where(rank < 5, weight, 0))
        np.add.at(out[:, 2], at + doc, 1)
    out[:, 2] = np.log1p(out[:, 2])
    return out


def _logistic(seen: DataFrame, columns: tuple[str, ...] = ("a", "b", "c"), rounds: int = 50) -> np.ndarray:
    """Weights (the last is the constant) of a ridge logistic regression of ``label``, by Newton steps.  Each step sums
    gradient and Hessian over all rows, as decimals, so that no order of the rows changes them."""
    x = [F.col(c) for c in columns] + [F.lit(1.0)]
    k = len(x)
    ridge = np.diag([0.1] * (k - 1) + [1e-6])
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    w = np.zeros(k)

    def total(e):
        return F.sum(e.cast("decimal(38,12)"))
    for _ in range(rounds):
        at = sum((v * float(b) for v, b in zip(x, w)), F.lit(0.0))
        p = seen.select(*columns, "label", (1 / (1 + F.exp(-F.greatest(F.least(at, F.lit(30.0)), F.lit(-30.0))))).alias("p"))
        row = p.agg(*[total(v * (F.col("label") - F.col("p"))) for v in x],
                    *[total(x[i] * x[j] * F.col("p") * (1 - F.col("p"))) for i, j in upper]).first()
        sums = [float(v) for v in row]
        hessian = np.zeros((k, k))
        for (i, j), v in zip(upper, sums[k:]):
            hessian[i, j] = hessian[j, i] = v
        step = np.linalg.solve(hessian + ridge, np.array(sums[:k]) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    characters: np.ndarray
    words: dict[str, float]
    lexicon: Lexicon
    weights: np.ndarray


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts (feature, toxic, n) with one entry for each feature."""
    kinds, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return kinds, *(np.bincount(where, np.concatenate([p[i] for p in parts]), len(kinds)).astype(np.int64) for i in (1, 2))


def _calibrates():
    """The ids whose labels the regression learns from; the lexicon learns from the others."""
    return F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(5)) < 2


def _one_label(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL AND label IS NOT NULL") \
        .groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))


def _lexicon(docs: DataFrame, rows: DataFrame, characters: np.ndarray, known: dict[str, float]) -> tuple[Lexicon, int, int]:
    """Lexicon from the labelled rows that do not calibrate, and how many of these are toxic and are not."""
    spark = docs.sparkSession
    calibrate = _calibrates()
    shared = spark.sparkContext.broadcast((characters, known))
    split = docs.select("doc_id").where(~calibrate).join(rows, "doc_id").groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in split}
    n_toxic, n_other = n.get(1, 0), n.get(0, 0)

    def count(batches):
        def record(kinds, toxic, total):
            return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(toxic), pa.array(total)],
                                              names=["feature", "toxic", "n"])
        _kept.release()
        restorer, parts, held = Restorer(*shared.value), [], 0
        for batch in _parts(batches):
            label = batch.column(1).to_numpy()
            for at, _, words, h, place in _features(restorer, batch.column(0).to_pylist()):
                doc = np.searchsorted(words.first, place, side="right") - 1
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.empty(0, bool)
                kinds, where = np.unique(h[new], return_inverse=True)
                toxic = np.bincount(where, label[at + doc[new]], len(kinds)).astype(np.int64)
                total = np.bincount(where, minlength=len(kinds))
                parts.append((kinds, toxic, total))
                held += len(kinds)
                if held > _FEATURES_HELD:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                    if held > _FEATURES_HELD // 2:
                        yield record(*parts[0])
                        parts, held = [], 0
        if parts:
            yield record(*_merged(parts))

    odds = (F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0))
            - F.log((F.col("n") - F.col("toxic") + 0.5) / (n_other + 1.0)))
    # labels grow with the texts; their side of a partition is small, so texts are dealt out but not sorted
    best = (docs.select("doc_id", F.col("text").cast("string").alias("text")).where(~calibrate)
            .join(rows.hint("shuffle_hash"), "doc_id").select("text", "label")
            .mapInArrow(count, "feature long, toxic long, n long")
            .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).where("toxic >= 3")
            .select("feature", odds.alias("weight"), (odds * F.col("toxic")).alias("gain")).where("weight > 1.5")
            .orderBy(F.desc("gain"), "feature").limit(MAX_LEXICON).toArrow())
    return Lexicon.of(best.column("feature").to_numpy().view(np.uint64), best.column("weight").to_numpy()), n_toxic, n_other


def _hits(docs: DataFrame, characters: np.ndarray, known: dict[str, float], lexicon: Lexicon) -> DataFrame:
    """doc_id and the evidence (a, b, c) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast((characters, known, lexicon))

    def evidence(batches):
        _kept.release()
        *of, words = shared.value
        restorer = Restorer(*of)
        for batch in _parts(batches):
            x = _evidence(restorer, words, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in x.T.copy()]],
                                             names=["doc_id", "a", "b", "c"])

    return stored(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        evidence, f"doc_id {dict(docs.dtypes)['doc_id']}, a double, b double, c double"), "toxicity-evidence")


def _learn(docs: DataFrame, labels: DataFrame, every: bool) -> tuple[Model, DataFrame]:
    """The model, and the evidence of the rows that calibrate it (with ``every``: of all rows)."""
    ship_package(docs.sparkSession)
    rows = _one_label(labels)
    characters, known = vocabulary(docs)
    lexicon, n_toxic, n_other = _lexicon(docs, rows, characters, known)
    hits = _hits(docs if every else docs.where(_calibrates()), characters, known, lexicon)
    seen = stored(hits.where(_calibrates()).join(rows, "doc_id").select("a", "b", "c", "label"), "toxicity-calibration")
    kinds = {r["label"]: r["count"] for r in seen.groupBy("label").count().collect()}
    ones, others = kinds.get(1, 0), kinds.get(0, 0)
    if ones and others:
        weights = _logistic(seen)
    else:
        share = (n_toxic + ones) / max(n_toxic + n_other + ones + others, 1)
        weights = np.array([0, 0, 0, math.log((share + 1e-6) / (1 - share + 1e-6))])
    return Model(characters, known, lexicon, weights), hits


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from ``docs`` and all rows of ``labels`` (doc_id, label 0 or 1)."""
    return _learn(docs, labels, every=False)[0]


def fit_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What ``score(docs, fit(docs, labels))`` returns; the evidence of every row is found once and serves both."""
    model, hits = _learn(docs, labels, every=True)
    a, b, c, constant = (float(w) for w in model.weights)
    at = F.col("a") * a + F.col("b") * b + F.col("c") * c + constant
    p = 1 / (1 + F.exp(-F.greatest(F.least(at, F.lit(30.0)), F.lit(-30.0))))
    return hits.select("doc_id", p.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5) for each row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        _kept.release()
        m: Model = shared.value
        restorer = Restorer(m.characters, m.words)
        for batch in _parts(batches):
            x = _evidence(restorer, m.lexicon, batch.column(1).to_pylist())
            p = 1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; all columns stay.  Rows are judged by their text."""
    spark = docs.sparkSession
    names = docs.columns
    shared = spark.sparkContext.broadcast(model)
    # a text that is a string already is sent once
    lead = [] if dict(docs.dtypes).get("text") == "string" else [F.col("text").cast("string")]
    at = 0 if lead else names.index("text")
    plain = docs.select(*lead, *[docs[f"`{c}`"] for c in names]).toDF(*[str(i) for i in range(len(names) + len(lead))])

    def run(batches):
        _kept.release()
        m: Model = shared.value
        restorer = Restorer(m.characters, m.words)
        for batch in _parts(batches):
            x = _evidence(restorer, m.lexicon, batch.column(at).to_pylist())
            yield batch.filter(pa.array(x @ m.weights[:-1] + m.weights[-1] < 0))

    ship_package(spark)
    return plain.mapInArrow(run, plain.schema).select(*plain.columns[len(lead):]).toDF(*names)
