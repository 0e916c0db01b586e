import hashlib

import pytest

from oracle_check import compare, duck
from punctual.llm import substring_dedup
from punctual.llm.queries import ORACLE, QUERIES
from .util import CLASHING, ODD, SF, docs, random_texts, space_words

LAST = 1 << 63


def brute(rows, window=13):
    first = {}
    for i, t in rows:
        w, key = space_words(t, False), LAST if i is None else i
        for p in range(len(w) - window + 1):
            g = tuple(w[p:p + window])
            first[g] = min(first.get(g, LAST), key)
    out = []
    for i, t in rows:
        w, key = space_words(t, False), LAST if i is None else i
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p:p + window])] < key for q in range(p, p + window)}
        out.append((str(i), len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    return sorted(out)


def got(frame):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in frame.collect())


def test_query_equals_sql(spark):
    ok, said = compare(spark, duck(SF), "op8", QUERIES["op8_substring_dedup"], ORACLE["op8_substring_dedup"], SF)
    assert ok, said


@pytest.mark.parametrize("shard,passage", [(1, 1), (70, 4), (500_000, 128)])
def test_covered_words_do_not_depend_on_the_cut(shard, passage, monkeypatch):
    import numpy as np
    import pyarrow as pa
    from punctual.llm import _text
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    monkeypatch.setattr(substring_dedup, "PASSAGE", passage)
    texts = [" ".join(t.split() * 2) for t in random_texts(9, 30, 5, 60)]
    rows = list(enumerate(texts))
    words = _text.hash_words(*_text.text_buffer(pa.array(texts)), _text.SPACE_EXACT)
    grams, at = _text.ngrams(words, 13)
    doc = np.searchsorted(words.first, at, side="right") - 1
    phrases, first = np.unique(grams, return_index=True)
    gone = substring_dedup._covered(words, np.arange(30), phrases, doc[first], 13)
    total = np.concatenate([[0], np.cumsum(gone)])[words.first]
    want = {r[0]: r[2] for r in brute(rows)}
    assert np.diff(total).tolist() == [want[str(i)] for i in range(30)]


def test_shared_passages(spark):
    passages = [p for p in random_texts(6, 30, 60, 50) if p]
    own = random_texts(7, 90, 5000, 60)
    rows = [(i * 7 % 91, f"{a} {passages[i % len(passages)]} {passages[i * i % len(passages)]}") for i, a in enumerate(own)]
    rows += [(200, "a b " * 40), (201, "a b " * 30), (202, "b a " * 30)]
    assert got(substring_dedup.dedup_substrings(docs(spark, rows, CLASHING))) == brute(rows)


def test_odd_rows(spark):
    rows = ODD + [(30, "same text here for all of us to see today and more words at the end"),
                  (None, "same text here for all of us to see today and more words"), (31, "word " * 15), (5, "x")]
    assert got(substring_dedup.dedup_substrings(docs(spark, rows, CLASHING))) == brute(rows)
    assert substring_dedup.dedup_substrings(docs(spark, [])).count() == 0
    digest = substring_dedup.dedup_substrings(docs(spark, [(1, " a  b ")]), with_text=False).first()["kept"]
    assert digest == hashlib.sha256(b"a b").hexdigest()
