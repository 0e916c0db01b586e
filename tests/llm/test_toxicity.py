import zlib

import numpy as np
import pytest

from punctual.llm import toxicity
from punctual.llm.queries import QUERIES
from .util import CLASHING, ODD, docs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    from punctual.llm.queries import toxic_labels
    return toxic_labels(spark, SF)


@pytest.fixture(scope="module")
def model(documents, labels):
    return toxicity.fit(documents, labels)


def test_lattice_restores_words(model):
    for token, word in (("1d10t", "idiot"), ("id!ot", "idiot"), ("i.d.i.o.t", "idiot"), ("idiiiiot", "idiot"),
                        ("w0rthl3ss", "worthless"), ("$tupid", "stupid"), ("m0r0n", "moron"), ("l0$er", "loser")):
        assert toxicity.decode(token, model.characters) == word, token
    restore = toxicity.Restorer(model.characters)
    assert restore("What an I D I O T you are") == "what an idiot you are"
    assert restore("s-t-u-p-i-d!") .startswith("stupid")
    assert restore(None) == "" and restore("plain words, only. 12 34") == "plain words, only. 12 34"


def test_word_boundaries_long_strings_and_ends(model):
    restore = toxicity.Restorer(model.characters, model.words)
    for text, words in (("you are a m o r o n", "you are a moron"), ("s t u p i d i d i o t", "stupid idiot"),
                        ("you are a s t u p i d  i d i o t", "you are a stupid idiot"), ("$ t u p i d", "stupid"),
                        ("id107", "idiot"), ("i d 1 0 7", "idiot"), ("1d1o+", "idiot"), ("stupid-idiot", "stupid idiot"),
                        ("a w o r t h l e s s s t u p i d m o r o n", "a worthless stupid moron"),
                        ("s" * 60 + "tupid", "stupid"), ("covid19 hello! 1 2 3 4 5", "covid19 hello! 1 2 3 4 5")):
        assert restore(text) == words, text
    many = " ".join("stupididiot" * 12)
    assert len(many) > 40 and restore(many) == " ".join(["stupid idiot"] * 12)


def test_held_out_accuracy(spark):
    rows = QUERIES["op9_toxicity"](spark, SF).collect()
    truth = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good = [s for s, t in held if t]
    bad = [s for s, t in held if not t]
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert auc > 0.85, auc


def test_obfuscated_insults_score_like_plain_ones(spark, model):
    plain = "and onesen you are a stupid idiot and a worthless moron of the ingha"
    hidden = "and onesen you are a $tup1d 1d10t and a w0rthl3ss m o r o n of the ingha"
    clean = "and onesen you are a careful reader and a patient friend of the ingha"
    s = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, [(1, plain), (2, hidden), (3, clean)]), model).collect()}
    assert s[1] > 0.5 and s[2] > 0.5 and s[3] < 0.5


def test_odd_rows(spark, model):
    frame = docs(spark, ODD, CLASHING)
    rows = toxicity.score(frame, model).collect()
    assert len(rows) == len(ODD) and len({r["score"] for r in rows if r["doc_id"] in (0, 1, 2, 10)}) == 1
    kept = toxicity.drop_toxic(frame, model)
    assert kept.columns == frame.columns and kept.count() == len(ODD)
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_labels_of_one_kind_or_none(spark):
    frame = docs(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r["predicted"] for r in toxicity.score(frame, toxicity.fit(frame, none)).collect()} == {0}
    ones = spark.createDataFrame([(3, 1), (4, 1), (None, 0), (5, None), (7, 1), (8, 1), (9, 1)], "doc_id long, label int")
    assert {r["predicted"] for r in toxicity.score(frame, toxicity.fit(frame, ones)).collect()} == {1}


def test_every_labelled_row_is_learned_from(spark):
    """All toxic rows come after 20,000 others in the order of the ids' hashes."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    ids = spark.range(22_000).withColumnRenamed("id", "doc_id")
    rank = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    labels = ids.withColumn("label", (rank > 21_000).cast("int")).localCheckpoint()
    frame = labels.select("doc_id", F.when(F.col("label") == 1, "calm vilest river").otherwise("calm gentle river").alias("text"))
    scores = toxicity.score(frame, toxicity.fit(frame, labels)).join(labels, "doc_id")
    seen = {r["label"]: (r["lo"], r["hi"]) for r in
            scores.groupBy("label").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()}
    assert seen[1][0] > 0.5 > seen[0][1]


def test_fit_score_is_score_of_fit(spark, documents, labels, model):
    from collections import Counter
    one = Counter((r["doc_id"], round(r["score"], 9), r["predicted"]) for r in toxicity.score(documents, model).collect())
    two = Counter((r["doc_id"], round(r["score"], 9), r["predicted"]) for r in toxicity.fit_score(documents, labels).collect())
    assert one == two
    assert toxicity.fit_score(docs(spark, ODD), labels).count() == len(ODD)


def test_known_words_are_counted_in_all_documents(spark):
    frame = docs(spark, [(i, "Elphinstonian, harbour" if i >= 20 else "quiet harbour") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, label int")
    assert "elphinstonian" in toxicity.fit(frame, labels).words


def test_trigrams_and_plain_words_of_a_count():
    from collections import Counter
    words = Counter({"(abba)": 2, "\u00e9t\u00e9!": 3, "a1": 5, "\u65e5\u672c": 7, "...": 1, "b": 4, "\U0001F600": 1})
    want = np.zeros(toxicity._SIZE ** 3, np.int64)
    for word, n in words.items():
        codes = [toxicity._INDEX.get(c) for c in word.strip(".,;:!?|\"'()")]
        if codes and None not in codes:
            a = b = 0
            for c in [*codes, 0]:
                want[(a * toxicity._SIZE + b) * toxicity._SIZE + c] += n
                a, b = b, c
    assert (toxicity._word_trigrams(words) == want).all()
    assert toxicity._plain_words(words) == {"abba": 2, "\u00e9t\u00e9": 3, "b": 4}
