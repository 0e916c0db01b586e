import random
import re
import zlib
from collections import Counter

import numpy as np

from punctual.llm import spelling as S
from punctual.llm.queries import ORACLE, QUERIES
from .util import CLASHING, ODD, SF, ascii_lower, docs

COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def counted(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(n):
    form, near = {}, {}
    for w in n:
        close = [v for v in n if is_near(w, v)]
        near[w] = len(close)
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, n[w], near[w], form[w], n.get(form[w]), root(w)) for w in n}


def rows(df):
    got = [tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_near_pairs_on_matrices():
    r = random.Random(2)
    words = ["".join(r.choice("abé") for _ in range(r.randint(5, 8))) for _ in range(300)]
    data = [w.encode("latin-1") for w in words]
    lengths = np.array([len(w) for w in words])
    start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    left, right = S._matrices(np.frombuffer(b"".join(data), np.uint8), start, lengths)
    a, b = (x.reshape(-1) for x in np.meshgrid(np.arange(300), np.arange(300)))
    near, _ = S.near_pairs(left, right, lengths, a, b)
    assert all(bool(x) == is_near(words[i], words[j]) for x, i, j in zip(near, a, b))


def some_rows(seed, n):
    """Few letters and many words, so that tiles are large and words have many near ones; chains of forms."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = "".join(r.choice("aabé÷Z") for _ in range(r.choice([3, 5, 5, 6, 7, 9, 14])))
            words += [w] * r.choice([1, 1, 1, 2, 5])
        out.append((r.choice([i, i, None]), " ".join(words)))
    return out + [(9000, "colour " * 40 + "colours " * 20 + "colourss " * 10 + "colur " * 9 + "Colourssx " * 5),
                  (9001, "x" * 30_000 + " " + ("x" * 29_999 + " ") * 3 + ("x" * 30_000 + ".") * 2)]


def test_equals_brute_force_in_blocks(spark, monkeypatch):
    data = ODD + some_rows(1, 60)
    want = brute(counted(data))
    assert rows(S.variants(S.word_counts(docs(spark, data, CLASHING)))) == want
    assert any(w[3] for w in want) and any(w[3] and w[5] != w[3] for w in want)
    # tiny blocks and pair chunks: every tile of more than three words is cut
    monkeypatch.setattr(S, "BLOCK", 3)
    assert rows(S.variants(S.word_counts(docs(spark, data)))) == want


def test_empty(spark):
    assert S.variants(S.word_counts(docs(spark, []))).count() == 0
    assert S.variants(S.word_counts(docs(spark, [(1, None), (2, "few words here")]))).count() == 0


def test_query_equals_sql_and_brute_force(spark):
    import duckdb
    got = rows(QUERIES["op11_spelling"](spark, SF))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == set(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op11_spelling']})").fetchall())
    n = counted([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])
    assert {g[:2] for g in got} == set(n.items())
    sample = random.Random(1).sample(sorted(got, key=lambda g: g[0]), 60)
    for word, count, near, form, form_n, _ in sample:
        assert near == sum(is_near(word, v) for v in n)
