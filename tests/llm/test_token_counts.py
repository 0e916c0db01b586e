import tiktoken

from punctual.llm import token_counts as tc
from punctual.llm.queries import QUERIES, byte_bpe
from .util import CLASHING, ODD, SF, docs


def test_query_equals_brute_force(spark):
    ranks, pattern = byte_bpe()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    n = [len(enc.encode_ordinary(r[0] or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rows = {r["limit"]: r for r in QUERIES["op4_token_counts"](spark, SF).collect()}
    assert set(rows) == set(n)
    for x, r in rows.items():
        assert (r["n_docs"], r["n_truncated"]) == (n.count(x), sum(v > x for v in n))
        assert r["n_tokens_cut"] == sum(min(v, x) for v in n)
        assert abs(r["share_whole"] - sum(v <= x for v in n) / len(n)) < 1e-12


def test_answers_from_the_histogram(spark):
    ranks, pattern = byte_bpe()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    n = sorted(len(enc.encode_ordinary(t or "")) for _, t in ODD)
    hist = tc.histogram(tc.lengths(docs(spark, ODD, CLASHING), ranks, pattern))
    assert tuple(tc.totals(hist).first()) == (len(n), sum(n), max(n))
    got = {r["share"]: r["length"] for r in tc.quantiles(hist, [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert got == {s: next(v for i, v in enumerate(n) if (i + 1) >= s * len(n)) for s in got}
    cut = {r["limit"]: (r["n_truncated"], r["n_tokens"]) for r in tc.truncated(hist, [0, 5, 2048, 10 ** 9]).collect()}
    assert cut == {x: (sum(v > x for v in n), sum(min(v, x) for v in n)) for x in cut}


def test_empty(spark):
    ranks, pattern = byte_bpe()
    hist = tc.histogram(tc.lengths(docs(spark, []), ranks, pattern))
    assert tuple(tc.totals(hist).first()) == (0, 0, None) and tc.curve(hist).count() == 0
    assert [r["length"] for r in tc.quantiles(hist, [0.5]).collect()] == [None]
