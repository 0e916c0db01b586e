import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from punctual.llm import conversation_repair as C
from punctual.llm.queries import QUERIES
from .util import SF

SCHEMA = "conv_id long, turn long, role string, text string, copies long"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """Rows of one conversation in order: forward search over (cost, audit, output) of every state, no runs, no matrices."""
    seen, kinds, tally = set(), [], [0, 0, 0]
    for _, _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else 3
        seen.add((role, text))
        kinds.append(fault)
        if fault < 3:
            tally[fault] += 1
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def better(states, key, value):
        if key not in states or value < states[key]:
            states[key] = value

    def closed(states):
        for _ in range(3):
            for s, (cost, audit, out) in list(states.items()):
                for r in "ua":
                    if (s, r) in step:
                        better(states, step[s, r], (cost + 2, audit + "I", out + ((names[r], ""),)))
        return states
    states = {"": (0, "", ())}
    for (_, _, role, text), fault in zip(rows, kinds):
        new = {}
        for s, (cost, audit, out) in closed(states).items():
            better(new, s, (cost + 3, audit + "D", out))
            if fault >= 2:
                late = fault == 2
                for r in "ua":
                    if (s, r) in step:
                        better(new, step[s, r], (cost + 2 + late, audit + "R", out + ((names[r], text),)))
                if (s, role[:1]) in step:
                    better(new, step[s, role[:1]], (cost + late, audit + "K", out + ((role, text),)))
        states = new
    states = closed(states)
    cost, audit, out = min(states[s] for s in ("", "a") if s in states)
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *tally, illegal, cost, audit, digest), out


def tie(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).extend(damaged([r]))
    for c in by:
        by[c].sort(key=lambda r: (r[1] is not None, r[1] or 0, tie(r[2], r[3])))
    return {c: brute(v) for c, v in by.items()}


def test_binary_powers_equal_steps():
    rng = np.random.default_rng(1)
    for symbol in range(9):
        for n in (1, 2, 3, 7, 64, 1000):
            vector = C.AT_END + rng.integers(0, 5, 4)
            want = vector
            for _ in range(n):
                want = C.advance(symbol, 1, want)
            assert (C.advance(symbol, n, vector) == want).all()


def test_every_short_conversation():
    """All words of up to five rows over roles and faults, against the forward search."""
    texts = {"k": "fine.", "t": "cut", "b": " \n"}
    for n in range(6):
        for word in itertools.product("sua", "ktb") if n == 1 else random.Random(n).sample(
                list(itertools.product(itertools.product("sux" if n > 3 else "suax", "ktb"), repeat=n)),
                min(400, (9 if n > 3 else 12) ** n)):
            word = [word] if n == 1 else word
            rows = [(1, i, r, texts[f] if f == "b" else f"{i} {texts[f]}") for i, (r, f) in enumerate(word)]
            repair = C._Repair(False)
            lines = [{"n": 1, "turn": i, "role": r, "text": t, "first": True, "blank": not t.strip(),
                      "cut": t[-1] not in ".!?"} for _, i, r, t in rows]
            seen = set()
            for x in lines:
                x["first"] = (x["role"], x["text"]) not in seen
                seen.add((x["role"], x["text"]))
            repair.play(lines, C.AT_END)
            repair.end()
            assert repair.summary() == brute(rows)[0]


def conversations(seed, n):
    r = random.Random(seed)
    texts = ["ok.", "yes!", "cut", "", " \t", "a?\n", "é.", "1. ", ".", None]
    rows = []
    for c in range(n):
        for t in range(r.randint(0, 12)):
            rows.append((r.choice([c, None]) if c == 3 else c, r.choice([t, t, t, t + 3, None]),
                         r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
                         r.choice(texts) if r.random() < 0.7 else f"row {t}."))
    return rows + [(900, 1, "user", "same."), (900, 1, "user", "same."), (900, 1, "user", "same."),
                   (901, 0, "assistant", "word " * 30_000)]


@pytest.mark.parametrize("rows_in_segment", [4096, 3])
def test_equals_brute_force(spark, monkeypatch, rows_in_segment):
    """The long conversation spans tasks and segments; equal rows, nulls and blanks everywhere."""
    rows = conversations(5, 60)
    rows += [(7777, t, "user" if t % 3 else "assistant", f"long {t % 400}{'.' if t % 5 else ''}") for t in range(3000)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows],
                                  "conv_id long, turn long, role string, text string, n string, pos string").repartition(5)
    if rows_in_segment != 4096:
        monkeypatch.setattr(C, "SEGMENT_ROWS", rows_in_segment)      # read on the driver: closures carry module globals
    got = C.repair(C.damage(frame)).collect()
    want = expected(rows)
    assert len(got) == len(want) == len({r.conv_id for r in got})
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r.conv_id][0], r.conv_id
    if rows_in_segment == 4096:
        out = {}
        for r in C.repaired_rows(C.damage(frame)).orderBy("conv_id", "at").collect():
            out.setdefault(r.conv_id, []).append((r.role, r.text))
        assert {c: tuple(v) for c, v in out.items()} == {c: v[1] for c, v in want.items() if v[1]}


def test_empty_table(spark):
    assert C.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_brute_force_and_sql(spark):
    import duckdb

    from punctual.llm.queries import ORACLE
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_conversation_repair"](spark, SF).collect()}
    assert got == {c: v[0] for c, v in want.items()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    sql = con.execute(f"SELECT conv_id, {', '.join(COLUMNS)} FROM ({ORACLE['op13_conversation_repair']})").fetchall()
    assert {r[0]: r[1:] for r in sql} == got
