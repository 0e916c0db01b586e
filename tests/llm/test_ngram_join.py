import pytest

from oracle_check import compare, duck
from punctual.llm import components as C
from punctual.llm import ngram_join
from punctual.llm.queries import ORACLE, QUERIES
from .util import CLASHING, ODD, SF, docs, random_texts, space_words


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = space_words(t)
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    ids = {}
    for i in range(len(rows)):
        ids.setdefault(root(i), []).append(rows[i][0])
    return sorted((str(rows[i][0]), len(sets[i]),
                   min((x for x in ids[root(i)] if x is not None), default=None) if sets[i] else rows[i][0])
                  for i in range(len(rows)))


def got(frame):
    return sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in frame.collect())


def near_copies(seed, n):
    base = random_texts(seed, 6, 400, 200)
    import random
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = (r.choice(base) or "x").split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6, 12])):
            w[r.randrange(len(w))] = f"n{r.randrange(10_000)}"
        out.append((i, " ".join(w)))
    return out


def test_query_equals_sql(spark):
    ok, said = compare(spark, duck(SF), "op2", QUERIES["op2_ngram_join"], ORACLE["op2_ngram_join"], SF)
    assert ok, said


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 100)])
def test_near_copies_equal_all_pairs(spark, k, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP", 4)  # many groups and chunks
    rows = near_copies(k, 150) + [(1000 + i, t) for i, t in enumerate(random_texts(k, 40, 12, 12))]
    assert got(ngram_join.components(docs(spark, rows, CLASHING), k, percent)) == brute(rows, k, percent)


def test_odd_rows(spark):
    assert got(ngram_join.components(docs(spark, ODD, CLASHING), 5, 80)) == brute(ODD, 5, 80)
    assert ngram_join.components(docs(spark, []), 5, 80).count() == 0


def test_one_of_each(spark):
    frame = docs(spark, ODD, CLASHING)
    out = ngram_join.one_of_each(frame)
    assert out.columns == frame.columns
    ids = sorted(str(r["doc_id"]) for r in out.collect())
    assert ids == sorted(str(i) for i in [0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, None])


def test_one_of_each_keeps_different_texts_of_one_id_and_without_id(spark):
    texts = [f"text number {i} has " + " ".join(f"w{i}x{j}" for j in range(30)) for i in range(8)]
    rows = [(None, t) for t in texts[:5]] + [(None, texts[0]), (1, texts[4]), (2, texts[5]), (2, texts[6]), (2, texts[6]),
                                             (None, texts[3] + " end"), (None, None), (None, " "), (3, texts[7])]
    got = sorted(((str(r["doc_id"]), r["text"]) for r in ngram_join.one_of_each(docs(spark, rows, CLASHING)).collect()),
                 key=str)
    near = [r for r in got if r[1] in (texts[3], texts[3] + " end")]
    assert len(near) == 1 and near[0][0] == "None"
    want = [("None", t) for t in (*texts[:3], None, " ")] + [("1", texts[4]), ("2", texts[5]), ("2", texts[6]), ("3", texts[7])]
    assert [r for r in got if r not in near] == sorted(want, key=str)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3)]
    out = {r["node"]: r["component"] for r in C.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert C.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_family_that_does_not_link_leaves_few_pairs(spark, monkeypatch):
    """Every copy differs from the common text in places of its own, so that no two link and no components grow."""
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(240):
        w = list(base)
        for j in range(5):
            w[(i * 7 + j * 61) % 300] = f"own{i}x{j}"
        rows.append((i, " ".join(w)))
    counts = {}

    def counted(df, name, stored=ngram_join.stored):
        out = stored(df, name)
        counts.setdefault(name, []).append(out.count())
        return out
    monkeypatch.setattr(ngram_join, "stored", counted)
    assert got(ngram_join.components(docs(spark, rows), 3, 90)) == brute(rows, 3, 90)
    groups, = counts["join-sets"]
    assert groups < 60
    assert max(counts["join-pairs"]) <= groups * groups / 2  # pairs of groups, not of the components in them


def test_packed_groups_open_to_all_qualifying_pairs():
    import numpy as np
    r = np.random.default_rng(5)
    base = np.unique(r.integers(0, 1 << 63, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([np.delete(base, r.choice(len(base), d, replace=False)),
                                      r.integers(0, 1 << 63, d, dtype=np.uint64)])) for d in r.integers(0, 25, 30)]
    sets.append(base[:1])
    group = [ngram_join._Group(*ngram_join._packed(np.arange(len(s), dtype=np.int64), s)) for s in (sets[:14], sets[14:])]
    for percent in (80, 90, 100):
        want = [(i, j) for i, a in enumerate(sets[:14]) for j, b in enumerate(sets[14:])
                if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))]
        assert sorted(ngram_join._opened(*group, percent)) == want
