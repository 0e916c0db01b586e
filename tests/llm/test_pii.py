import hashlib
import random
import re

import pytest

from punctual.llm import pii
from punctual.llm.queries import QUERIES
from .util import CLASHING, ODD, SF, docs


def brute(text):
    """The contract's expressions as they stand."""
    out, text = [], text or ""
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        s = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def test_base_spans_equal_the_expressions():
    r = random.Random(3)
    parts = ["a", "b.", "@", "@x", ".com", "..", "-", "_", "%", "1", "22", "255", "256", ".", " ", "+", "(", ")",
             "4111111111111111", "4111-1111 1111 1111", "+1 (377) 555-0271", "1.2.3.4", "007.0.0.1", "é", "\n", "x@y.z"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(text) == brute(text), text
    for text in ("1" * 50_000, "1." * 30_000, "a@" * 20_000, "+1 " * 20_000, "1 " * 30_000):
        pii.base_spans(text)


def test_identifier_like_strings_in_linear_time():
    """The same strings as one backtracking expression finds, also where it would be quadratic."""
    import time
    plain = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9][A-Za-z0-9.-]*"
                       r"|\(?[0-9](?:[ ().-]{0,2}[0-9]){4,}+")
    r = random.Random(4)
    parts = ["a", "b.", "@", " @ ", "(at)", "[at]", " ", "x1", "12", "345 ", "(", ")", "-", ".", "é", "55555", "\n", "at"]
    for _ in range(30_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 16)))
        assert list(pii._loose(text)) == [m.span() for m in plain.finditer(text)], text
    for text in ("x1" * 500_000, "1@" * 300_000, "a" * 10 ** 6 + "@", "12 " * 300_000, "(1" * 300_000):
        start = time.time()
        list(pii._loose(text))
        assert time.time() - start < 5


def test_two_kinds_are_counted_apart(spark):
    found = pii.find(docs(spark, [(1, "a@b.com and c@d.org from 1.2.3.4")])).select("base").first().base
    assert [s.kind for s in found] == [0, 0, 1]


def test_query_digests(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op1_pii"](spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        spans = brute(text)
        r = rows[doc_id]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in spans) for i in range(4)]
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(filter(None, r["spans"].split(",")))


def test_contexts_find_unseen_identifiers(spark):
    seeds = [(i, f"please call the hotline +1 (377) 555-{1000 + i} before noon") for i in range(12)]
    loose = [(100, "please call the hotline 377 555 9999 before noon"), (101, "it was 377 555 9999 steps away"),
             (102, "room 55555 is free")]
    phones = [(200 + i, f"write to account bob{i}@mail.example.org or wait") for i in range(12)]
    hosts = [(300, "write to account eve@intranet or wait"), (301, "buy two @ home for all")]
    found = {r["doc_id"]: r for r in pii.find(docs(spark, seeds + loose + phones + hosts, CLASHING)).collect()}
    assert found[100]["spans"] and not found[100]["base"]
    assert found[300]["spans"][0]["kind"] == 0
    assert not found[102]["spans"] and not found[301]["spans"]
    assert all(len(found[i]["spans"]) == 1 for i, _ in seeds)


def test_hidden_identifiers_are_found(spark):
    """A tenth of the identifiers is written so that no base expression takes it; their contexts find them."""
    import random
    r = random.Random(8)
    words = "stone river lamp cloud paper green window market silver garden".split()
    forms = {0: ("send it to mailbox {} before", "{}@mail.example.org", "{} (at) mail"),
             1: ("login from the host {} was", "10.{}.1.2", "10.300.{}.2"),
             2: ("charged to credit card {} on", "411111111111{}", "511111111111{}"),
             3: ("please ring the hotline {} at", "+1 377 55{}", "377 55{}")}

    def card(prefix, i):
        body = prefix.format(f"{i:03d}")
        return next(body + str(d) for d in range(10) if pii.luhn(body + str(d)) == prefix.startswith("4"))
    rows, hidden = [], {}
    for i in range(800):
        kind, n = i % 4, i // 4
        context, base, loose = forms[kind]
        hide = n % 10 == 3
        value = card(loose if hide else base, n) if kind == 2 else (loose if hide else base).format(
            f"user{n}" if kind == 0 else n if kind == 1 else 10000 + n)
        fill = [" ".join(r.choices(words, k=6)) for _ in range(2)]
        rows.append((i, f"{fill[0]} {context.format(value)} {fill[1]}"))
        if hide:
            hidden[i] = kind
    found = {x["doc_id"]: x for x in pii.find(docs(spark, rows)).collect()}
    assert not any(found[i]["base"] for i in hidden)
    right = sum([s["kind"] for s in found[i]["spans"]] == [k] for i, k in hidden.items())
    assert right >= 0.9 * len(hidden) == 72
    assert all(len(found[i]["spans"]) == 1 for i, _ in rows if i not in hidden)


def test_redact_and_odd_rows(spark):
    rows = ODD + [(20, "mail a@b.com and 1.2.3.4 é"), (20, "mail c@d.com"), (None, "x 1.2.3.4")]
    frame = docs(spark, rows, CLASHING)
    out = pii.redact(frame)
    assert out.columns == frame.columns
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    want = [(i, t) for i, t in rows]
    want = sorted((i is not None, i or 0, (t or "").replace("a@b.com", "[EMAIL]").replace("c@d.com", "[EMAIL]")
                   .replace("1.2.3.4", "[IP]")) for i, t in want)
    assert got == want
    assert pii.find(docs(spark, [])).count() == 0


@pytest.mark.parametrize("spans,want", [([(0, 0, 2), (1, 1, 3)], "[EMAIL]d"), ([], "abcd"), ([(2, 3, 4)], "abc[CARD]")])
def test_overlapping_spans(spans, want):
    assert pii.redacted("abcd", spans) == want
