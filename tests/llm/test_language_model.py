import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from punctual.llm import language_model as L
from punctual.llm.elias_fano import EliasFano, Trie
from punctual.llm.queries import QUERIES
from .util import CLASHING, ODD, SF, docs, random_texts, space_words


def brute(rows, held):
    tokens = [(i, space_words(t) + ["<end>"]) for i, t in rows]
    train = [t for (i, t), h in zip(tokens, held) if not h]
    one, two = Counter(), Counter()
    for t in train:
        one.update(t)
        two.update(zip(["<begin>"] + t, t))
    n, v = sum(one.values()), len(one)
    context = Counter(one)
    context["<begin>"] = len(train)
    del context["<end>"]
    out = []
    for (i, t), h in zip(tokens, held):
        base = score = 0.0
        for a, b in zip(["<begin>"] + t, t):
            p1 = (one[b] + 1) / (n + v + 1)
            base += np.log10(p1)
            score += np.log10((two[a, b] + L.MASS * p1) / (context[a] + L.MASS))
        out.append((str(i), h, len(t), sum(one[b] > 0 for b in t), n, base, score))
    return sorted(out, key=lambda x: (x[0], x[2]))


def check(frame, want):
    got = sorted([(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"],
                   r["score"]) for r in frame.collect()], key=lambda x: (x[0], x[2]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5]))
        assert abs(g[6] - w[6]) < 1e-3 * w[2] + 1e-6  # quantised


@pytest.mark.parametrize("frequent", [4, 1 << 16])
def test_scores_equal_brute_force(spark, frequent, monkeypatch):
    monkeypatch.setattr(L, "FREQUENT", frequent)
    rows = list(enumerate(random_texts(5, 60, 30, 40))) + [(i + 500, t) for i, t in ODD if i is not None]
    held = [i % 3 == 0 for i, _ in rows]
    check(L.score(docs(spark, rows, CLASHING), F.col("doc_id") % 3 == 0), brute(rows, held))


def test_null_ids_train_and_empty_parts(spark):
    check(L.score(docs(spark, ODD), F.col("doc_id") % 2 == 0), brute(ODD, [i is not None and i % 2 == 0 for i, _ in ODD]))
    check(L.score(docs(spark, ODD), F.lit(True)), brute(ODD, [True] * len(ODD)))
    assert L.score(docs(spark, []), F.lit(False)).count() == 0


def test_query_beats_unigrams_and_keeps_the_contract(spark):
    rows = QUERIES["op3_language_model"](spark, SF).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_rare_context_does_not_depend_on_the_rest(spark):
    """Unrelated documents change p(w | h) of a rare context by the unigram part alone."""
    seen = [(i, "zeta omega") for i in range(10, 60)]
    ask = [(1, "zeta omega"), (2, "zeta")]

    def step(rest):
        rows = {r["doc_id"]: r for r in L.score(docs(spark, ask + seen + rest), F.col("doc_id") < 10).collect()}
        n = rows[1]["train_tokens"]
        v = 3 + len({w for _, t in rest for w in t.split()})
        p1 = {w: np.log10((50 + 1) / (n + v + 1)) for w in ("zeta", "omega")}
        # the begin mark's count and the end after omega are known by hand
        begin = np.log10((50 + L.MASS * 10 ** p1["zeta"]) / (50 + len(rest) + L.MASS))
        end = np.log10((50 + L.MASS * (50 + len(rest) + 1) / (n + v + 1)) / (50 + L.MASS))
        return rows[1]["score"] - begin - end, 10 ** p1["omega"]

    few, many = [(i, "alpha beta") for i in range(100, 110)], [(i, f"w{i} x{i % 7} y{i % 3}") for i in range(100, 3000)]
    for rest in ([], few, many):
        got, p1 = step(rest)
        assert abs(got - np.log10((50 + L.MASS * p1) / (50 + L.MASS))) < 3e-3  # quantised
        assert 10 ** got >= 50 / (50 + L.MASS) - 1e-3


def test_a_larger_corpus_helps(spark):
    """The gain over unigrams per held-out token, learned from a twentieth of the rows and from all.  (The unigram part
    itself falls with the corpus, as the share of an unknown word is 1 / (N + V + 1) by the contract.)"""
    source = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    ask, rest = F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.crc32(F.col("doc_id").cast("string")) % 20 == 1

    def gain(frame):
        return L.score(frame, ask).where("held_out").agg(F.sum(F.expr("score - base_score")) / F.sum("n_tokens")).first()[0]
    assert gain(source) > gain(source.where(ask | rest)) > 0


def test_distribution_sums_to_one(spark):
    """p(w | h) over all known words and the unknown one, for a seen and an unseen context."""
    rows = [(i, t) for i, t in enumerate(["a b a c", "b a", "c c b a", "a b"])]
    known = ["a", "b", "c", ""]
    for h in ("a", "b", "c", "unseen"):
        ask = [(100 + i, f"{h} {w}".strip()) for i, w in enumerate([*known[:3], "unknown"])] + [(99, h)]
        out = {r["doc_id"]: r["score"] for r in L.score(docs(spark, rows + ask), F.col("doc_id") >= 99).collect()}
        one, two = Counter(), Counter()
        for _, t in rows:
            one.update(t.split() + ["<end>"])
            two.update(zip(["<begin>"] + t.split(), t.split() + ["<end>"]))
        n, v = sum(one.values()), len(one)

        def p(a, b):
            p1 = (one[b] + 1) / (n + v + 1)
            c = len(rows) if a == "<begin>" else one[a]
            return (two[a, b] + L.MASS * p1) / (c + L.MASS)
        first = p("<begin>", h)
        total = 10 ** out[99] / first  # the end
        total += sum(10 ** out[100 + i] / first / p(w, "<end>") for i, w in enumerate(["a", "b", "c", "unknown"]))
        assert abs(total - 1) < 5e-3


def test_sequences_stay_compact():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 100_000, dtype=np.uint64))
    e = EliasFano(*EliasFano.encode(values))
    held = sum(x.nbytes for x in vars(e).values() if isinstance(x, np.ndarray) and x is not e._words)
    assert held * 8 < len(values) * (40 - np.log2(len(values)) + 6)


def test_context_is_found_relative_to_its_word():
    s = L.Setting(1000, 3, 10, 4, np.array([1], np.uint64), np.array([600]), 1.0)
    words = np.array([1, 2, 3], np.uint64)
    token, before = np.repeat(words, [2, 3, 1]), np.array([2, 3, 1, 1, 3, 2], np.uint64)
    t = Trie.mapped(L.build_shard(token, before, s))
    place, pair = t.lookup(words, np.array([2, 1, 9], np.uint64))
    assert place.tolist() == [0, 1, 2] and (pair >= 0).tolist() == [True, True, False]


@pytest.mark.parametrize("seed", range(6))
def test_elias_fano(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(0, 5000))
    values = np.sort(r.integers(0, [10, 1000, 1 << 20, 1 << 40, 1 << 62, 50][seed], n, dtype=np.uint64))
    e = EliasFano(*EliasFano.encode(values))
    assert (e.get(np.arange(n)) == values).all()
    ask = np.concatenate([values, values + np.uint64(1), r.integers(0, 1 << 62, 100, dtype=np.uint64)])
    at = e.find(ask)
    assert ((at >= 0) == np.isin(ask, values)).all()
    assert (values[at[at >= 0]] == ask[at >= 0]).all()
