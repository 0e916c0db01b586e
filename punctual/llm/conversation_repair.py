"""Conversation structure repair by run-length dynamic programming (operator 13).

Method: every row of a conversation is a symbol, its role class and its first
fault.  A conversation may be repaired when the initials of its roles read
``(s?(ua)+)?``.  Each symbol has a 4 x 4 min-plus transition over the states of
that language (start, after a system row, after a user row, after an assistant
row), in which an edit costs Keep 0, Rerole 2, Delete 3, Insert 2 and an
undeleted truncated row 1 more.  Equal consecutive symbols are one run; a run
of n advances the cost vector through the cached binary powers of its
transition.  The choices are then unrolled forward, least letter first.

Scale: equal rows of a turn are one row with a count.  Rows are ordered by
range, so a long conversation spans tasks.  A conversation that lies inside a
task is settled there; any other leaves it as segments of at most
``SEGMENT_ROWS`` rows or ``SEGMENT_CHARS`` characters.  Segments pass their
cost vectors backward and their states forward as streams sorted by position,
so no task holds more than a segment.  (The SHA-256 of one conversation is
sequential by definition: its last stream passes through one task.)

Defined results: a null role or text is one space; a null conv_id is a
conversation of its own; null turns come first; rows of one turn are in the
order of the SHA-256 of role and text; repeated rows are duplicates; roles are judged by their first character;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from punctual.llm._store import stored
from punctual.session import ship_package

SEGMENT_ROWS = 4096
SEGMENT_CHARS = 4 << 20

# --- min-plus transitions -------------------------------------------------------------------------------------------
_FAR = 1 << 50
# States: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row; 0 and 3 may end.
_TO = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_INSERTED = [2, 2, 3, 2]
_ROLES = "sua"
REQUIRED = 8      # the symbol of a row that must go; others are role class (s, u, a, other) + 4 if truncated


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


def _inserts() -> np.ndarray:
    c = np.full((4, 4), _FAR)
    for i in range(4):
        c[i, i] = 0
        c[i, _INSERTED[i]] = 2
    return _times(c, c)


def _edits(symbol: int) -> np.ndarray:
    m = np.full((4, 4), _FAR)
    np.fill_diagonal(m, 3)
    if symbol != REQUIRED:
        late = symbol // 4
        for role in "ua":
            for i, j in _TO[role].items():
                m[i, j] = min(m[i, j], 2 + late)
        if symbol % 4 < 3:
            for i, j in _TO[_ROLES[symbol % 4]].items():
                m[i, j] = min(m[i, j], late)
    return m


INSERTS = _inserts()
_EDITS = [_edits(s) for s in range(9)]
_POWERS: list[list[np.ndarray]] = [[_times(INSERTS, e)] for e in _EDITS]
#: Cost from each state once no row is left.
AT_END = np.minimum((INSERTS + np.array([0, _FAR, _FAR, 0])[None, :]).min(axis=1), _FAR)


def advance(symbol: int, n: int, after: np.ndarray) -> np.ndarray:
    """Cost from each state before a run of n equal symbols, given the cost from each state after it."""
    powers = _POWERS[symbol]
    k = 0
    while n:
        while len(powers) <= k:
            powers.append(_times(powers[-1], powers[-1]))
        if n & 1:
            after = np.minimum((powers[k] + after[None, :]).min(axis=1), _FAR)
        n >>= 1
        k += 1
    return after


def runs(symbols: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Equal consecutive symbols as one (symbol, n)."""
    out: list[list[int]] = []
    for s, n in symbols:
        if n and out and out[-1][0] == s:
            out[-1][1] += n
        elif n:
            out.append([s, n])
    return [(s, n) for s, n in out]


def costs_before(found: list[tuple[int, int]], after: np.ndarray) -> list[np.ndarray]:
    """Cost vectors before every run and after the last."""
    out = [after]
    for s, n in reversed(found):
        out.append(advance(s, n, out[-1]))
    return out[::-1]


_CHOICES: dict[tuple, tuple[str, int]] = {}


def _choice(symbol: int, state: int, after: np.ndarray) -> tuple[str, int]:
    """Letters for one row and the state behind it; of equal costs the ASCII-least letters."""
    # Beyond its least entry a vector only matters by differences, and those of finite entries are small.
    key = (symbol, state, tuple(np.minimum(after - after.min(), _FAR).tolist()))
    found = _CHOICES.get(key)
    if found is None:
        before = advance(symbol, 1, after)
        letters, s = "", state
        while True:
            left = int(before[s])
            if 3 + int(after[s]) == left:
                found = letters + "D", s
                break
            if 2 + int(before[_INSERTED[s]]) == left:
                letters, s = letters + "I", _INSERTED[s]
                continue
            late, role = symbol // 4, symbol % 4
            to = _TO[_ROLES[role]].get(s) if symbol != REQUIRED and role < 3 else None
            if to is not None and late + int(after[to]) == left:
                found = letters + "K", to
                break
            found = letters + "R", next(_TO[r][s] for r in "ua" if s in _TO[r])
            break
        if len(_CHOICES) < 1 << 16:
            _CHOICES[key] = found
    return found


_BLOCK = 1024


def unroll(found: list[tuple[int, int]], state: int, after: np.ndarray) -> Iterator[tuple[str, int]]:
    """(letters, state behind) of every row of the runs, from ``state``."""
    behind = costs_before(found, after)[1:]
    for (symbol, n), end in zip(found, behind):
        while n:
            block = min(n, _BLOCK)
            n -= block
            # the vectors inside a block of the run, from its end backward; the block's end by binary powers
            ahead = [advance(symbol, n, end)]
            for _ in range(block - 1):
                ahead.append(advance(symbol, 1, ahead[-1]))
            for vector in reversed(ahead):
                letters, state = _choice(symbol, state, vector)
                yield letters, state


def last_inserts(state: int) -> str:
    """Insertions after the last row."""
    out = ""
    while AT_END[state]:
        out, state = out + "I", _INSERTED[state]
    return out


# --- one conversation, line by line ---------------------------------------------------------------------------------
_NAME = {2: "user", 3: "assistant"}


class _Tally:
    """What is reported of a conversation besides its repair; lines come in order."""

    def __init__(self):
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None

    def add(self, line: dict) -> None:
        n = line["n"]
        if not n:
            return
        t = line["turn"]
        if t is not None:
            self.low, self.high = (t if self.low is None else self.low), t
            if t != self.turn:
                self.turns, self.turn = self.turns + 1, t
        if line["blank"]:
            self.blank += n
        else:
            self.duplicate += n - line["first"]
            self.truncated += line["first"] and line["cut"]
        initial = line["role"][:1]
        for copies in (1, n - 1):
            if copies and self.before is not None:
                self.illegal += copies * (self.before + initial not in ("su", "ua", "au"))
            self.before = initial

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _symbols(line: dict) -> list[tuple[int, int]]:
    if line["blank"] or not line["first"]:
        return [(REQUIRED, line["n"])]
    role = _ROLES.find(line["role"][:1]) if line["role"] else -1
    return [((role if role >= 0 else 3) + 4 * line["cut"], 1), (REQUIRED, line["n"] - 1)] if line["n"] else []


class _Repair:
    """Plays the edits of a conversation, segment after segment."""

    def __init__(self, with_rows: bool):
        self.with_rows = with_rows
        self.tally, self.state, self.cost = _Tally(), 0, None
        self.audit: list[str] = []
        self.digest, self.any, self.at = hashlib.sha256(), False, 0

    def _line(self, edit: str, turn, role: str, text: str) -> list[tuple]:
        if self.with_rows:
            self.at += 1
            return [(self.at, edit, turn, role, text)]
        self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True
        return []

    def play(self, lines: list[dict], after: np.ndarray) -> list[tuple]:
        """The repaired rows of the next lines; ``after`` is the cost from each state behind them."""
        per = [_symbols(x) for x in lines]
        found = runs([s for p in per for s in p])
        if self.cost is None:
            self.cost = int(costs_before(found, after)[0][0])
        out, steps = [], unroll(found, self.state, after)
        for line, symbols in zip(lines, per):
            self.tally.add(line)
            for _ in range(sum(n for _, n in symbols)):
                letters, behind = next(steps)
                self.audit.append(letters)
                for _ in letters[:-1]:
                    self.state = _INSERTED[self.state]
                    out += self._line("I", None, _NAME[self.state], "")
                if letters[-1] != "D":
                    role = line["role"] if letters[-1] == "K" else _NAME[behind]
                    out += self._line(letters[-1], line["turn"], role, line["text"])
                self.state = behind
        return out

    def end(self) -> list[tuple]:
        letters, out = last_inserts(self.state), []
        for _ in letters:
            self.state = _INSERTED[self.state]
            out += self._line("I", None, _NAME[self.state], "")
        self.audit.append(letters)
        return out

    def summary(self) -> tuple:
        return (*self.tally.result(), self.cost or 0, "".join(self.audit), self.digest.hexdigest())


# --- Spark ----------------------------------------------------------------------------------------------------------
_ORDER = ["__c0", "__c", "__t0", "__t", "__h"]
_RESULT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"),
           ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string")]
_ROW = [("at", "long"), ("edit", "string"), ("turn", "long"), ("role", "string"), ("text", "string")]
_LINE = [("turn", "long"), ("role", "string"), ("text", "string"), ("n", "long"), ("first", "boolean"),
         ("blank", "boolean"), ("cut", "boolean")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after the faults that crc32 of ``conv_id:turn`` deals out:
    0 drops a row (copies 0), 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def _lines(rows: DataFrame) -> DataFrame:
    """Distinct rows of each conversation and turn in order, with their counts and faults."""
    kind = rows.schema["conv_id"].dataType
    here = F.col("copies") > 0
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    keyed = rows.select(
        F.col("conv_id").isNull().alias("__c0"),
        F.coalesce("conv_id", F.lit("0").cast(kind)).alias("__c"),
        (here & F.col("turn").isNotNull()).alias("__t0"),
        F.when(here, F.coalesce(F.col("turn").cast("long"), F.lit(0))).otherwise(0).alias("__t"),
        F.when(here, role).otherwise("").alias("role"), F.when(here, text).otherwise("").alias("text"),
        F.greatest("copies", F.lit(0)).cast("long").alias("n")) \
        .withColumn("__h", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
                                          .cast("binary"), 256)))
    grouped = keyed.groupBy(*_ORDER).agg(F.sum("n").alias("n"), F.first("role").alias("role"),
                                         F.first("text").alias("text"))
    # role and text seen earlier: every (conversation, role, text) marks its first turn
    first = (keyed.where("n > 0").groupBy("__c0", "__c", "__h").agg(F.min(F.struct("__t0", "__t")).alias("f"))
             .select("__c0", "__c", "f.__t0", "f.__t", "__h", F.lit(True).alias("first")))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (grouped.join(first, _ORDER, "left")
            .repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER)
            .select("__c0", "__c", F.monotonically_increasing_id().alias("pos"),
                    F.when(F.col("__t0"), F.col("__t")).alias("turn"), "role", "text", "n",
                    F.coalesce("first", F.lit(False)).alias("first"),
                    (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
                    (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut")))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            yield from batch.slice(a, 1024).to_pylist()


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most 2048 rows or about 8 MB of text."""
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += sum(len(v) for v in r if isinstance(v, str))
        if len(held) >= 2048 or chars > 8 << 20:
            yield _batch(held, schema)
            held, chars = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _settled(rows: DataFrame, with_rows: bool) -> DataFrame:
    ship_package(rows.sparkSession)
    lines = _lines(rows)
    key_type = lines.schema["__c"].dataType
    wanted = _ROW if with_rows else _RESULT
    carried = [("seg", "long"), ("pos", "long"), *((f"l_{n}", t) for n, t in _LINE)]
    key_ddl = f"__c0 boolean, __c {key_type.simpleString()}"
    keys = [pa.field("__c0", pa.bool_()), to_arrow_schema(T.StructType([T.StructField("__c", key_type)])).field(0)]

    def ddl(columns):
        return ", ".join([key_ddl, *(f"{n} {t}" for n, t in columns)])

    def arrow(columns):
        return pa.schema([*keys, *(pa.field(n, _ARROW[t]) for n, t in columns)])

    def line_of(row: dict, prefix: str = "") -> dict:
        return {n: row[prefix + n] for n, _ in _LINE}

    def repaired(key: tuple, repair: _Repair, out: list[tuple]) -> Iterator[tuple]:
        yield from ((*key, *r) for r in out)
        if not with_rows:
            yield (*key, *repair.summary())

    def inside(batches):
        """Whole conversations settled, and the lines of those that reach the task's ends or are long."""
        none = (None,) * len(wanted)

        def leave(key, held):
            for x in held:
                yield (*key, *none, held[0]["pos"], x["pos"], *(x[n] for n, _ in _LINE))

        def settle(key, held):
            repair = _Repair(with_rows)
            out = repair.play([line_of(x) for x in held], AT_END)
            for r in repaired(key, repair, out + repair.end()):
                yield (*r, *(None,) * len(carried))

        def rows_out():
            key, held, chars, open_ = None, [], 0, True     # the task's first conversation may have begun elsewhere
            for line in _stream(batches):
                k = (line["__c0"], line["__c"])
                if key is not None and k != key:
                    yield from leave(key, held) if open_ else settle(key, held)
                    held, chars, open_ = [], 0, False
                elif len(held) >= SEGMENT_ROWS or chars > SEGMENT_CHARS:
                    yield from leave(key, held)
                    held, chars, open_ = [], 0, True
                key = k
                held.append(line)
                chars += len(line["text"]) + len(line["role"])
            if held:
                yield from leave(key, held)
        return _batches(rows_out(), arrow(wanted + carried))

    done = stored(lines.mapInArrow(inside, ddl(wanted + carried)), "conversations")
    open_ = done.where("seg IS NOT NULL")
    behind_cols = [("seg", "long"), *((f"b{i}", "long") for i in range(4))]

    def backward(batches):
        """Cost from each state behind every segment; lines come last first."""
        def rows_out():
            key, seg, vector, run = None, None, AT_END, [REQUIRED, 0]
            for x in _stream(batches):
                k = (x["__c0"], x["__c"])
                if k != key:
                    vector, run = AT_END, [REQUIRED, 0]
                if k != key or x["seg"] != seg:
                    vector, run = advance(*run, vector), [REQUIRED, 0]
                    key, seg = k, x["seg"]
                    yield (*k, seg, *vector.tolist())
                for s, n in reversed(_symbols(line_of(x, "l_"))):
                    if s != run[0]:
                        vector, run = advance(*run, vector), [s, 0]
                    run[1] += n
        return _batches(rows_out(), arrow(behind_cols))

    blank = F.lit("").alias("l_text")
    behind = (open_.select("__c0", "__c", "seg", "pos", F.substring("l_role", 1, 1).alias("l_role"), blank, "l_turn",
                           "l_n", "l_first", "l_blank", "l_cut").repartition("__c0", "__c")
              .sortWithinPartitions("__c0", "__c", F.col("pos").desc()).mapInArrow(backward, ddl(behind_cols)))

    def forward(batches):
        def rows_out():
            key, seg, repair, held, after = None, None, None, [], None
            for x in _stream(batches):
                k = (x["__c0"], x["__c"])
                if k != key or x["seg"] != seg:
                    if held:
                        yield from ((*key, *r) for r in repair.play(held, after))
                    if k != key:
                        if repair is not None:
                            yield from repaired(key, repair, repair.end())
                        repair = _Repair(with_rows)
                    key, seg, held, after = k, x["seg"], [], np.array([x[f"b{i}"] for i in range(4)])
                held.append(line_of(x, "l_"))
            if repair is not None:
                yield from ((*key, *r) for r in repair.play(held, after))
                yield from repaired(key, repair, repair.end())
        return _batches(rows_out(), arrow(wanted))

    rest = (open_.select("__c0", "__c", *(n for n, _ in carried)).join(behind, ["__c0", "__c", "seg"])
            .repartition("__c0", "__c").sortWithinPartitions("__c0", "__c", "pos").mapInArrow(forward, ddl(wanted)))
    names = [n for n, _ in wanted]
    return (done.where("seg IS NULL").select("__c0", "__c", *names).unionByName(rest)
            .select(F.when(~F.col("__c0"), F.col("__c")).alias("conv_id"), *names))


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text, copies): gaps, faults, cost and audit of
    the cheapest repair, SHA-256 of the repaired ``role:text`` lines.  A row of 0 copies only names its conversation."""
    return _settled(rows, False)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, at (1, 2, ..), edit (K, R or I), turn, role, text."""
    return _settled(rows, True)
