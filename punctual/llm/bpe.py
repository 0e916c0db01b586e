"""Byte-level BPE encoding and decoding as finite-state machines (operator 10).

Encoding: the merge ranks are compiled into a transducer over bytes.  It rests
on a property of rank-ordered merging: a token sequence is the encoding of its
bytes exactly when every adjacent pair is, so the last token of each prefix
follows from the last tokens of shorter prefixes.  A state is the last token
that is certain plus the bytes read since; a token is emitted as soon as no
continuation can change it, which is after fewer bytes than the longest token
has.  States and arcs are made when first needed (lazy determinisation): a
pre-token that leaves the part built so far adds the arc that it lacked, and a
search over compatible tokens finishes its bytes.

Decoding: token bytes are streamed through an incremental UTF-8 machine that
holds back at most three bytes of an unfinished character.

Pre-tokens are the matches of the given pattern, each encoded separately; a
pre-token that is itself a vocabulary entry is that token.

Defined results: a null text is an empty one, with no ids; repeated rows give
equal rows; an unknown id fails; bytes that are not UTF-8 decode to U+FFFD in
``text`` and stay as they are in ``bytes``; a vocabulary that lacks a byte of the
text fails; extra columns are kept.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from punctual.llm._kept import kept
from punctual.session import ship_package

#: Bounds of a worker's tables (memory, not the result): arcs of the machine, remembered pre-tokens and pairs.
MAX_ARCS, MAX_PIECES, MAX_PAIRS = 60_000, 300_000, 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file with a line ``base64 rank`` for each token."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in f if x.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Reference definition: merge the adjacent pair of least rank (the first one) until none is left."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


class _State:
    """``prev``: last certain token; ``pending``: bytes read since; ``last[i]``: length of the last token in
    the encoding of ``pending[:i]``, 0 where no encoding that can still win ends at i."""

    __slots__ = ("prev", "pending", "last", "arcs")

    def __init__(self, prev: bytes | None, pending: bytes, last: tuple[int, ...]):
        self.prev, self.pending, self.last = prev, pending, last
        self.arcs: dict[int, tuple[_State, tuple[int, ...]]] = {}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_pairs: int = MAX_PAIRS):
        self.ranks, self.most_pairs = ranks, most_pairs
        self.longest = max(map(len, ranks), default=1)
        self.starts = {t[:i] for t in ranks for i in range(1, len(t))}
        #: Length of the longest token that begins with these three bytes.
        self.reach: dict[bytes, int] = {}
        for t in ranks:
            if len(t) > self.reach.get(t[:3], 2):
                self.reach[t[:3]] = len(t)
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple[bytes | None, bytes], _State] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.n_arcs = 0
        self.start = self._state(None, b"", (0,))

    def _state(self, prev, pending, last) -> _State:
        key = (prev, pending)
        if key not in self.states:
            self.states[key] = _State(prev, pending, last)
        return self.states[key]

    def _parts(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens that the last merge of ``token`` joins."""
        if token not in self.halves:
            parts = merge(token, {t: r for i in range(len(token)) for j in range(i + 2, len(token) + 1)
                                  if (t := token[i:j]) != token and (r := self.ranks.get(t)) is not None})
            self.halves[token] = (parts[0], parts[1])
        return self.halves[token]

    def _pair(self, left: bytes, right: bytes) -> bool:
        """Whether ``left`` then ``right`` is the encoding of their bytes.

        Goes back in time over the merges that made the two, latest first, and
        asks at each moment whether the parts that then met at the boundary
        would have been merged before the next merge took one of them away.
        """
        key = (left, right)
        if key in self.pairs:
            return self.pairs[key]
        rank, until, ok = self.ranks, 1 << 60, True
        while True:
            across = rank.get(left + right)
            if across is not None and across < until:
                ok = False
                break
            late = rank[left] if len(left) > 1 else -1
            if late > (rank[right] if len(right) > 1 else -1):
                until, left = late, self._parts(left)[1]  # on equal rank the merge further left goes first
            elif len(right) > 1:
                until, right = rank[right] + 1, self._parts(right)[0]
            else:
                break
        self.pairs[key] = ok
        return ok

    def _boundaries(self, last, end: int) -> list[int]:
        out = [end]
        while out[-1]:
            out.append(out[-1] - last[out[-1]])
        return out[::-1]

    def _arc(self, s: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        text = s.pending + bytes([byte])
        n, last, ranks, starts = len(text), [*s.last, 0], self.ranks, self.starts
        for j in range(max(0, n - self.longest), n):
            token = text[j:]
            if token in ranks and (j == 0 or last[j]):
                left = text[j - last[j]:j] if j else s.prev
                if left is None or self._pair(left, token):
                    last[n] = n - j
                    break
        # a later token starts at n or at some j whose rest is the beginning of a vocabulary entry;
        # what the encodings up to all those places have in common is certain
        common = self._boundaries(last, n) if last[n] else None
        for j in range(max(0, n - self.longest), n):
            if (j == 0 or last[j]) and text[j:] in starts:
                if j == 0:
                    common = [0]
                    break
                b = self._boundaries(last, j)
                common = b if common is None else [x for x in common if x in b]
        bounds = common or [0]
        cut = bounds[-1]
        tokens = [text[a:b] for a, b in zip(bounds, bounds[1:])]
        rest = tuple(x if x <= i else 0 for i, x in enumerate([0, *last[cut + 1:]])) if cut else tuple(last)
        to = self._state(tokens[-1] if tokens else s.prev, text[cut:], rest)
        arc = s.arcs[byte] = (to, tuple([ranks[t] for t in tokens]))
        self.n_arcs += 1
        return arc

    def _rest(self, s: _State) -> list[int]:
        """Ids of the pending bytes when the pre-token ends."""
        n = len(s.pending)
        if n and s.last[n] == n:
            return [self.ranks[s.pending]]
        b = self._boundaries(s.last, n)
        return [self.ranks[s.pending[i:j]] for i, j in zip(b, b[1:])]

    def _finish(self, s: _State, more: bytes) -> list[int]:
        """Ids of the pending bytes and ``more``, the end of the pre-token: longest tokens first, one step back
        where no compatible token follows.  A place that led nowhere is not tried again, as only one sequence of
        compatible tokens leads to it."""
        text, ranks, pairs, reach = s.pending + more, self.ranks, self.pairs, self.reach
        end, at, path, dead, left = len(text), 0, [], set(), s.prev
        stop = min(end, reach.get(text[:3], 2))
        while at < end:
            while stop > at:
                token = text[at:stop]
                if token in ranks and stop not in dead:
                    if left is None:
                        break
                    ok = pairs.get((left, token))
                    if self._pair(left, token) if ok is None else ok:
                        break
                stop -= 1
            if stop > at:
                path.append(token)
                left, at = token, stop
                stop = min(end, at + reach.get(text[at:at + 3], 2))
            else:
                if not path:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead.add(at)
                stop = at - 1
                at -= len(path.pop())
                left = path[-1] if path else s.prev
        return [ranks[t] for t in path]

    def feed(self, data: bytes) -> list[int]:
        """Ids of one pre-token; each arc carries those that its byte makes certain."""
        if len(self.pairs) > self.most_pairs:
            self.pairs.clear()
        s, out = self.start, []
        for i, byte in enumerate(data):
            arc = s.arcs.get(byte)
            if arc is None:
                if self.n_arcs >= MAX_ARCS:
                    return out + self._finish(s, data[i:])
                arc = self._arc(s, byte)
                return out + list(arc[1]) + self._finish(arc[0], data[i + 1:])
            s = arc[0]
            if arc[1]:
                out += arc[1]
        return out + self._rest(s)


class _Pieces(dict):
    """Ids of the pre-tokens met lately: when the table is full it becomes the older one, from which pre-tokens
    that are met again come back."""

    def __init__(self, machine: Transducer, most: int = MAX_PIECES):
        super().__init__()
        self.machine, self.most, self.older = machine, most, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            data = piece.encode()
            whole = self.machine.ranks.get(data)
            ids = (whole,) if whole is not None else tuple(self.machine.feed(data))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Utf8Stream:
    """Incremental UTF-8 machine: characters as soon as they are whole, at most three bytes held back."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many of the last bytes begin a character that lacks bytes."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC2:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF5 else 1
                return back if need > back else 0
            if b < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = len(data) - self._unfinished(data)
        self.held = data[keep:]
        return data[:keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Encoder and decoder of one vocabulary; made once in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces: int = MAX_PIECES):
        self.split = regex.compile(pattern)
        self.pieces = _Pieces(Transducer(ranks, MAX_PAIRS * pieces // MAX_PIECES), pieces)
        self.token = {i: t for t, i in ranks.items()}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split.findall(text))))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def decode_stream(self, ids: list[int], step: int = 4096) -> Iterator[str]:
        """The text in order, a part for each ``step`` ids."""
        stream = Utf8Stream()
        for i in range(0, len(ids), step):
            yield stream.feed(self.decode_bytes(ids[i:i + step]))
        yield stream.close()


def _codec(key: str, ranks, pattern: str, pieces: int) -> Codec:
    return kept((key, pieces), lambda: Codec(ranks.value, pattern, pieces))


def _mapper(docs: DataFrame, ranks: dict[bytes, int], pattern: str, add, pieces: int = MAX_PIECES):
    """mapInArrow function that appends ``add(codec, batch)`` to the columns of a batch."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(ranks)  # the vocabulary: as large as its file
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()

    def run(batches):
        codec = _codec(key, shared, pattern, pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, *add(codec, part)], names=[
                    str(i) for i in range(part.num_columns)] + ["a", "b", "c"][:len(add.out)])
    return run


def _extend(docs: DataFrame, run, added: list[T.StructField], lead: list) -> DataFrame:
    """Columns are passed by place, so that clashing or odd names do no harm."""
    kept = [f for f in docs.schema.fields if f.name not in {a.name for a in added}]
    source = docs.select(*lead, *[docs[f"`{f.name}`"] for f in kept]).toDF(
        *[str(i) for i in range(len(lead) + len(kept))])
    schema = T.StructType([T.StructField(str(i), f.dataType) for i, f in enumerate(source.schema.fields)]
                          + [T.StructField(n, f.dataType) for n, f in zip("abc", added)])
    out = source.mapInArrow(run, schema).drop(*[str(i) for i in range(len(lead))])
    return out.toDF(*[f.name for f in kept], *[f.name for f in added])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, pieces: int = MAX_PIECES // 4) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``n_tokens`` of its text; a worker remembers ``pieces`` pre-tokens
    (twice: memory and time, not the result)."""
    def add(codec: Codec, batch: pa.RecordBatch):
        ids = [codec.encode(t) for t in batch.column(0).to_pylist()]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())]
    add.out = ["ids", "n_tokens"]
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    return _extend(docs, _mapper(docs, ranks, pattern, add, pieces), fields, [F.col("text").cast("string")])


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str = ".") -> DataFrame:
    """``encoded`` with ``bytes`` and ``decoded`` (text) of its ``ids``."""
    def add(codec: Codec, batch: pa.RecordBatch):
        rows = [x or [] for x in batch.column(0).to_pylist()]
        return [pa.array([codec.decode_bytes(x) for x in rows], pa.binary()),
                pa.array(["".join(codec.decode_stream(x)) for x in rows], pa.string())]
    add.out = ["bytes", "decoded"]
    fields = [T.StructField("bytes", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return _extend(encoded, _mapper(encoded, ranks, pattern, add), fields, [F.col("ids")])


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a round trip whose ids stay inside the task."""
    spelled = [str(i) for i in range(max(ranks.values(), default=0) + 1)]
    words = docs.sparkSession.sparkContext.broadcast(spelled)

    def add(codec: Codec, batch: pa.RecordBatch):
        number = words.value.__getitem__
        n, a, b = [], [], []
        for text in batch.column(0).to_pylist():
            ids = codec.encode(text)
            n.append(len(ids))
            a.append(hashlib.sha256(" ".join(map(number, ids)).encode()).hexdigest())
            h = hashlib.sha256()
            for at in range(0, len(ids), 1 << 16):
                h.update(codec.decode_bytes(ids[at:at + (1 << 16)]))
            b.append(h.hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
    add.out = ["n_tokens", "ids_sha256", "decoded_sha256"]
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    return _extend(docs.select("doc_id", "text"), _mapper(docs, ranks, pattern, add), fields,
                   [F.col("text").cast("string")]).drop("text")
