import random
import re

from oracle_check import compare, duck
from punctual.llm import decontamination
from punctual.llm.queries import ORACLE, QUERIES
from .util import CLASHING, ODD, SF, ascii_lower, docs, random_texts


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))


def brute(rows, items, window=10):
    index = {}
    for item, t in items:
        w = words(t)
        n = min(len(w), window)
        for p in range(len(w) - n + 1 if n else 0):
            index.setdefault(tuple(w[p:p + n]), set()).add(item)
    sizes = {len(g) for g in index}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                g = tuple(w[p:p + n])
                if g in index:
                    hit.update(range(p, p + n))
                    found |= index[g]
        out.append((str(i), len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit)))
    return sorted(out)


def got(frame):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in frame.collect())


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, content string")


def test_query_equals_sql(spark):
    ok, said = compare(spark, duck(SF), "op6", QUERIES["op6_decontamination"], ORACLE["op6_decontamination"], SF)
    assert ok, said


def test_planted_spans(spark):
    r = random.Random(4)
    texts = random_texts(4, 80, 25, 60)
    items = [(i, " ".join(t.split()[:r.choice([0, 1, 3, 9, 10, 11, 30])])) for i, t in enumerate(random_texts(5, 25, 25, 40))]
    items += [(None, texts[0]), (3, texts[1]), (77, "A! b? c."), (78, None), (79, "...")]
    rows = list(enumerate(texts)) + [(500 + i, f"{a} {b.upper()}, {a}") for i, (a, (_, b)) in
                                     enumerate(zip(texts, [(i, t or "") for i, t in items]))]
    assert got(decontamination.decontaminate(docs(spark, rows, CLASHING), items_frame(spark, items))) == brute(rows, items)


def test_odd_rows_and_empty_tables(spark):
    items = [(1, "same text here for all of us to see today"), (2, "word " * 12), (3, "1 1")]
    frame = docs(spark, ODD, CLASHING)
    want = brute(ODD, items)
    # rows 8 is given twice; each gets its own result
    assert got(decontamination.decontaminate(frame, items_frame(spark, items))) == want
    none = items_frame(spark, []) if False else spark.createDataFrame([], "item_id long, text string")
    assert not any(r[4] for r in got(decontamination.decontaminate(frame, none)))
    assert decontamination.decontaminate(docs(spark, []), items_frame(spark, items)).count() == 0
    kept = decontamination.clean(frame, items_frame(spark, items))
    assert kept.columns == frame.columns
    assert kept.count() == sum(not w[4] for w in want)


def test_clean_judges_texts_of_one_id_apart(spark):
    item = " ".join(f"item{i}" for i in range(14))
    rows = [(None, "before " + item), (None, "a clean text without an id"), (4, item), (4, "another clean text"),
            (5, "clean, too"), (None, None), (None, "")]
    kept = decontamination.clean(docs(spark, rows, CLASHING), items_frame(spark, [(1, item)]))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [r for r in rows if r[1] is None or item not in r[1]], key=str)
