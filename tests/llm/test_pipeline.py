import corpus_pipeline as P
from punctual.llm import ngram_join, pii
from punctual.llm.queries import byte_bpe, toxic_labels
from punctual.llm import toxicity
from .test_decontamination import brute as contaminated
from .test_ngram_join import brute as components
from .test_pii import brute as spans

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    model = toxicity.fit(docs, toxic_labels(spark, SF))
    bad = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    left = [(i, t) for i, t in texts.items() if i not in bad]
    left = [(i, t) for i, t in left if str(i) in {a for a, n, c in components(left, ngram_join.K, ngram_join.PERCENT)
                                                  if n == 0 or str(c) == a}]
    dirty = {r[0] for r in contaminated(left, items) if r[4]}
    want = {i: pii.redacted(t, spans(t)) for i, t in left if str(i) not in dirty}
    out = P.run(spark, SF)
    assert out.columns == docs.columns + ["ids", "n_tokens"]
    rows = out.collect()
    assert len(rows) == len(want) == len({r["doc_id"] for r in rows})
    from punctual.llm import bpe
    ranks, pattern = byte_bpe()
    codec = bpe.Codec(ranks, pattern)
    same = 0
    for r in rows:
        assert codec.decode_bytes(r["ids"]).decode() == r["text"]
        same += r["text"] == want[r["doc_id"]]
    assert same >= len(rows) - 2  # contexts may add marks


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
