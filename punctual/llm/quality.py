"""Quality classifier by co-training (operator 7).

Method: two classifiers see different views of a document: its text (shares
of character classes, word and line repetition, lengths) and the metadata of
its page (language, source, size).  Both start from the labelled rows.  In
each round each one picks the unlabelled documents it is surest about, of
both kinds in the proportion of the labels, and hands them with its own
verdict to the other one.  After the last round both are calibrated on
labelled rows kept apart, and a logistic combination of the two calibrated
views scores all documents.

What is fitted is bounded: at most ``max_fit_rows`` labelled rows and about as
many unlabelled ones, those with the least hash of doc_id.  All documents are
scored.

Defined results: null, empty and blank texts have all shares 0; null metadata
is a category of its own; a null n_chars counts as 0; repeated rows score
alike; a null doc_id or label never trains; of repeated labels of one doc_id
the largest counts; labels of one kind only give that kind's share to all
documents, no labels 0.5; missing metadata columns are as if null; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm import _text
from punctual.session import ship_package

MAX_FIT_ROWS, ROUNDS = 20_000, 5
_LINES = _text._alphabet(b"\n", False)
_SOURCES = 64


# ---- views -------------------------------------------------------------------------------------------------------

def _classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, space, line end, sentence sign, other sign, beyond ASCII."""
    kind = np.full(256, 6, np.uint8)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 7
    kind[[32, 9]], kind[10] = 3, 4
    kind[[ord(c) for c in ".,;:?!'\"-()"]] = 5
    return kind


_KIND = _classes()


def _by_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repetition(words: _text.Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: distinct items, and occurrences of its most frequent one."""
    n_docs = len(words.first) - 1
    distinct, most = np.zeros(n_docs), np.zeros(n_docs)
    if len(words.hash):
        doc = words.doc_of()
        order = np.lexsort((words.hash, doc))
        h, d = words.hash[order], doc[order]
        begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
        distinct = np.bincount(d[begin], minlength=n_docs).astype(float)
        np.maximum.at(most, d[begin], np.diff(np.append(begin, len(h))))
    return distinct, most


def text_view(texts: pa.Array) -> np.ndarray:
    """Features of the text view, a row for each text."""
    out = []
    for a, b, data, offsets in _text.slices(texts):
        size = np.maximum(np.diff(offsets), 1)
        kinds = _KIND[data]
        shares = [_by_doc(kinds == k, offsets) / size for k in range(8)]
        words = _text.hash_words(data, offsets, _text.SPACE_FOLDED)
        lines = _text.hash_words(data, offsets, _LINES)
        n_words, n_lines = np.diff(words.first), np.diff(lines.first)
        distinct, most = _repetition(words)
        distinct_lines, most_lines = _repetition(lines)
        same = np.zeros(len(words.hash), bool)
        same[1:] = words.hash[1:] == words.hash[:-1]
        ends = kinds[words.end - 1] if len(data) else np.empty(0, np.uint8)
        some, rows = np.maximum(n_words, 1), np.maximum(n_lines, 1)
        out.append(np.column_stack([
            *shares, np.log1p(n_words), (np.diff(offsets) / some).clip(0, 50) / 10, distinct / some, most / some,
            distinct_lines / rows, most_lines / rows, _by_doc(same, words.first) / some,
            _by_doc(ends == 6, words.first) / some, _by_doc(ends == 5, words.first) / some,
            np.minimum(n_words / rows, 100) / 100, n_words < 20, n_words < 60]))
    return np.concatenate(out) if out else np.empty((0, 20))


def meta_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Features of the metadata view: language and source as hashed categories, steps of the size."""
    out = np.zeros((len(lang), 16 + _SOURCES + 14))
    for i, (a, b, n) in enumerate(zip(lang, source, n_chars)):
        out[i, zlib.crc32(repr(a).encode()) % 16] = 1
        out[i, 16 + zlib.crc32(repr(b).encode()) % _SOURCES] = 1
        out[i, 16 + _SOURCES + min(int(np.log2(max(n or 0, 0) + 1)), 13)] = 1
    return out


# ---- fitting (bounded rows) --------------------------------------------------------------------------------------

def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        ridge = np.full(z.shape[1], penalty)
        ridge[-1] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -30, 30)))


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    platt_text: Logistic
    platt_meta: Logistic
    both: Logistic
    share: float | None = None

    def predict(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Columns: calibrated text view, calibrated metadata view, combination."""
        if self.share is not None:
            return np.full((len(x), 3), self.share)
        a = self.platt_text.predict(_logit(self.text.predict(x))[:, None])
        b = self.platt_meta.predict(_logit(self.meta.predict(m))[:, None])
        return np.column_stack([a, b, self.both.predict(np.column_stack([_logit(a), _logit(b)]))])


def co_train(x: np.ndarray, m: np.ndarray, y: np.ndarray, pool_x: np.ndarray, pool_m: np.ndarray,
             rounds: int = ROUNDS, each: int = 200) -> CoTrained:
    """``y`` labels of the rows of both views; the pool has no labels.  Every fourth labelled row is kept for
    calibration.  ``each``: pseudo-labels that a view hands over in a round."""
    keep = np.arange(len(y)) % 4 == 3
    if not len(y) or y.min() == y.max() or y[~keep].min() == y[~keep].max() or y[keep].min() == y[keep].max():
        return CoTrained(*[None] * 5, share=float(y.mean()) if len(y) else 0.5)
    views, pools = (x, m), (pool_x, pool_m)
    sets = [[v[~keep] for v in views][i] for i in range(2)]
    labels = [y[~keep].astype(float)] * 2
    free = np.ones(len(pool_x), bool)
    rate = y[~keep].mean()
    for r in range(rounds + 1):
        models = [Logistic.fit(s, t) for s, t in zip(sets, labels)]
        left = np.flatnonzero(free)
        if r == rounds or len(left) < 2:
            break
        for i in range(2):
            left = np.flatnonzero(free)
            p = models[i].predict(pools[i][left])
            order = np.argsort(p, kind="stable")
            n = min(each, len(left) // 4)
            good = [j for j in order[::-1][:round(n * rate)] if p[j] > 0.5]
            bad = [j for j in order[:n - round(n * rate)] if p[j] < 0.5]
            chosen = left[np.array(good + bad, int)]
            other = 1 - i
            sets[other] = np.concatenate([sets[other], pools[other][chosen]])
            labels[other] = np.concatenate([labels[other], np.r_[np.ones(len(good)), np.zeros(len(bad))]])
            free[chosen] = False
    t = y[keep].astype(float)
    raw = [_logit(model.predict(v[keep]))[:, None] for model, v in zip(models, views)]
    platt = [Logistic.fit(s, t) for s in raw]
    both = Logistic.fit(np.column_stack([_logit(p.predict(s)) for p, s in zip(platt, raw)]), t)
    return CoTrained(models[0], models[1], platt[0], platt[1], both)


# ---- Spark -------------------------------------------------------------------------------------------------------

def _rows(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    return docs.select(
        "doc_id", F.col("text").cast("string").alias("text"),
        *[(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in ("lang", "source")],
        (F.col("n_chars").cast("long") if "n_chars" in have else F.lit(None).cast("long")).alias("n_chars"))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_view(batch.column("text")), meta_view(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS, rounds: int = ROUNDS) -> CoTrained:
    """Model from ``docs`` and ``labels`` (doc_id, label 0 or 1)."""
    ship_package(docs.sparkSession)
    rows = _rows(docs)
    order = F.xxhash64("doc_id")
    known = (labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id")
             .agg(F.max(F.col("label").cast("int")).alias("label")).orderBy(order, "doc_id").limit(max_fit_rows))
    # the unlabelled rows with the least hashes, about max_fit_rows of them
    n = rows.count()
    share = min(1.0, max_fit_rows / max(n, 1))
    pool = rows.where((F.xxhash64("doc_id", F.lit(7)).cast("double") / 2.0 ** 63 + 1) / 2 < share) \
        .join(labels.select("doc_id"), "doc_id", "left_anti").withColumn("label", F.lit(None).cast("int"))
    picked = rows.join(F.broadcast(known), "doc_id").unionByName(pool)  # known: at most max_fit_rows rows

    def view(batches):
        for batch in batches:
            x, m = _views(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("label"),
                 pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary()),
                 pa.array([r.astype(np.float32).tobytes() for r in m], pa.binary())], names=["k", "label", "x", "m"])

    got = picked.mapInArrow(view, "k string, label int, x binary, m binary") \
        .orderBy(F.xxhash64("k"), "k", F.xxhash64("x")).toArrow()

    def matrix(column, keep):
        rows_ = [np.frombuffer(v, np.float32) for v, k in zip(got.column(column).to_pylist(), keep) if k]
        return np.array(rows_, float).reshape(len(rows_), len(rows_[0]) if rows_ else 0)
    label = got.column("label").to_pylist()
    have, lack = [v is not None for v in label], [v is None for v in label]
    y = np.array([v for v in label if v is not None], int)
    return co_train(matrix("x", have), matrix("m", have), y, matrix("x", lack), matrix("m", lack), rounds)


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, text_score, meta_score, score, predicted for each row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p = shared.value.predict(*_views(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(p[:, i].copy()) for i in range(3)],
                 pa.array((p[:, 2] >= 0.5).astype(np.int32))],
                names=["doc_id", "text_score", "meta_score", "score", "predicted"])

    return _rows(docs).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_score double, meta_score double, score double, predicted int")
