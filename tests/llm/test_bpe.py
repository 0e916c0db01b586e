import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from punctual.llm import bpe
from punctual.llm.queries import QUERIES, byte_bpe
from .util import CLASHING, ODD, SF, docs


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe()[0]


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(ranks, reference):
    codec, r = bpe.Codec(ranks, public_tokenizers.PATTERN), random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "\n", "é", "日", "0", "12", ".", "$$$", "\t", "'s", "ing", "ß", "\U0001F600",
             "x" * 30, " " * 40, "aaaa", "\x00", "​", "İ"]
    for _ in range(4000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        ids = codec.encode(s)
        assert ids == reference.encode_ordinary(s), s
        assert codec.decode_bytes(ids) == s.encode()
        assert "".join(codec.decode_stream(ids, 1)) == s
    for s in ("a" * 20_000, " " * 5000, "\U0001F600" * 3000, "".join(r.choice("abcdefgh") for _ in range(20_000))):
        assert codec.encode(s) == reference.encode_ordinary(s)


@pytest.mark.parametrize("arcs", [0, 50, 10 ** 9])
def test_machine_equals_merging_however_much_is_built(arcs, monkeypatch):
    """A small vocabulary with overlapping merges, where the longest token is often wrong."""
    monkeypatch.setattr(bpe, "MAX_ARCS", arcs)
    ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
    for t in (b"bc", b"ab", b"abc", b"ca", b"cab", b"aa", b"aab", b"bb", b"abcab", b"aaa"):
        if len(bpe.merge(t, {**ranks, t: 99})) == 1:
            ranks[t] = len(ranks)
    machine, r = bpe.Transducer(ranks), random.Random(2)
    for _ in range(5000):
        data = bytes(r.choice(b"abc") for _ in range(r.randint(1, 24)))
        assert list(machine.feed(data)) == [ranks[t] for t in bpe.merge(data, ranks)], data


def test_tokens_come_out_within_the_lookahead(ranks):
    machine = bpe.Transducer(ranks)
    s, text = machine.start, b"internationalisation and so on" * 40
    for b in text:
        s = (s.arcs.get(b) or machine._arc(s, b))[0]
        assert len(s.pending) <= 2 * machine.longest


def test_broken_utf8_is_held_back_or_replaced():
    stream = bpe.Utf8Stream()
    data = "é日\U0001F600".encode()
    out = [stream.feed(data[i:i + 1]) for i in range(len(data))]
    assert "".join(out) == "é日\U0001F600" and out[0] == "" and stream.close() == ""
    assert stream.feed(b"\xff\xc3") == "�" and stream.close() == "�"


def test_encode_decode_frames(spark, ranks, reference):
    frame = docs(spark, ODD, CLASHING)
    encoded = bpe.encode(frame, ranks, public_tokenizers.PATTERN)
    assert encoded.columns == [c for c in frame.columns if c != "ids"] + ["ids", "n_tokens"]
    rows = bpe.decode(encoded, ranks).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["ids"] == reference.encode_ordinary(r["text"] or "") and r["n_tokens"] == len(r["ids"])
        assert r["decoded"] == (r["text"] or "") and bytes(r["bytes"]) == (r["text"] or "").encode()
    assert bpe.encode(docs(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def test_query(spark, reference):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for r in QUERIES["op10_bpe"](spark, SF).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
