import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from punctual.llm import simhash
from punctual.llm.queries import QUERIES
from .util import CLASHING, ODD, SF, docs, random_texts


def xx(a, b):
    """Spark's xxhash64(a, b): the hash of a seeds that of b; a null leaves the seed."""
    seed = xxhash.xxh64_intdigest(a.encode(), seed=42)
    return seed if b is None else xxhash.xxh64_intdigest(b.encode(), seed=seed)


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    terms = list(zip(words, words[1:])) or [(w, None) for w in words]
    total, votes = 0, [0] * 64
    for a, b in terms:
        w = len(a) + len(b or "")
        h = xx(a, b)
        total += w
        for i in range(64):
            votes[i] += w * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * votes[i] > total)


def expected(rows):
    """Per distinct (doc_id, text): the contract's columns."""
    rows = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        a, b, c = brute(t), brute(edited), brute(after)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}",
                  1 - bin(a ^ b).count("1") / 64, 1 - bin(a ^ c).count("1") / 64)
    return out


def got(frame):
    return {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"],
                          r["near_next"]) for r in frame.collect()}


def run(frame):
    return simhash.edited_fingerprints(frame).select(
        "doc_id", "n_chars", "edited_sha256", simhash.spelled(F.col("fingerprint")).alias("fingerprint"),
        simhash.spelled(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got(QUERIES["op5_simhash"](spark, SF)) == expected([tuple(r) for r in rows])


def test_odd_rows(spark):
    assert got(run(docs(spark, ODD, CLASHING))) == expected(ODD)
    assert run(docs(spark, [])).count() == 0
    assert got(run(docs(spark, [(3, "only one here")]))) == expected([(3, "only one here")])


def test_no_python_on_the_path(spark):
    plan = QUERIES["op5_simhash"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("radius,blocks", [(0, 1), (1, 4), (3, 6), (6, 9)])
def test_near_pairs(spark, radius, blocks):
    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for b in base:
        for _ in range(6):
            prints.add(b ^ sum(1 << i for i in r.sample(range(64), r.randint(1, 9))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed + signed[:5] + [None]], "fingerprint long")
    found = {(r["a"], r["b"], r["distance"]) for r in simhash.near_pairs(frame, radius, blocks).collect()}
    want = {(a, b, d) for a in signed for b in signed if a < b
            and (d := bin((a ^ b) & (1 << 64) - 1).count("1")) <= radius}
    assert found == want


def test_near_copies_are_nearer_than_others(spark):
    texts = [t for t in random_texts(8, 40, 3000, 300) if len(t) > 400]
    rows = [(2 * i, t) for i, t in enumerate(texts)] + [(2 * i + 1, t + " tail") for i, t in enumerate(texts)]
    out = got(run(docs(spark, rows)))
    assert min(out[2 * i + 1][5] for i in range(len(texts))) > 0.85
    assert max(out[2 * i][5] for i in range(1, len(texts))) < 0.85
