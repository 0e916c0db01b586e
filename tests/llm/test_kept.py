import gc
import weakref

import pyarrow as pa

from punctual.llm import _kept, bpe, toxicity
from .util import CLASHING, ODD, docs


class _Ranks:
    value = {bytes([i]): i for i in range(256)}


def test_tables_of_one_operator_at_a_time():
    first = bpe._codec("one", _Ranks, ".", 100)
    assert bpe._codec("one", _Ranks, ".", 100) is first
    gone = weakref.ref(first.pieces)
    assert first.encode("ab") == [97, 98]
    del first
    second = bpe._codec("two", _Ranks, ".", 100)
    gc.collect()
    assert gone() is None and len(_kept._VALUES) == 1
    gone = weakref.ref(second.pieces)
    del second
    _kept.release()
    assert gone() is None and not _kept._VALUES


def test_texts_are_taken_a_few_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200))], names=["a"])
    parts = list(toxicity._parts([batch, batch.slice(0, 0), batch.slice(0, 1)]))
    assert [p.num_rows for p in parts] == [512, 512, 176, 1]
    assert [x for p in parts for x in p.column(0).to_pylist()] == [*range(1200), 0]


def test_drop_toxic_judges_string_and_other_texts_alike(spark):
    rows = [r for r in ODD if r[0] not in (5, 6)] + [(100 + i, "badword here " * (i % 2) + f"text {i}") for i in range(700)]
    table = docs(spark, rows, CLASHING)
    labels = table.where("doc_id >= 100").selectExpr("doc_id", "doc_id % 2 as label")
    model = toxicity.fit(table, labels)
    kept = toxicity.drop_toxic(table, model)
    assert kept.columns == table.columns
    key = lambda d: sorted(map(repr, d.selectExpr("doc_id", "cast(text as string) text", "lang", "n_chars").collect()))
    as_bytes = table.withColumn("text", table["text"].cast("binary"))
    assert key(kept) == key(toxicity.drop_toxic(as_bytes, model))
    good = {r["doc_id"] for r in toxicity.score(table, model).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good and 0 < kept.count() < len(rows)
