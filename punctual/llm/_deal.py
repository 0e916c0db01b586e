"""Packed exchanges: (holder, hash) pairs dealt out by hash range.

A row of an exchange stands for one slice of documents and one hash range and
carries 8 bytes for each pair, so a hash that very many holders share adds
8 bytes for each of them to one range, and no row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

REQUEST = "part int, holders int, head binary, hashes binary"
REQUEST_ARROW = pa.schema([("part", pa.int32()), ("holders", pa.int32()), ("head", pa.binary()),
                           ("hashes", pa.binary())])


def packed(ids: np.ndarray, doc: np.ndarray, hashes: np.ndarray, ranges: int) -> Iterator[tuple]:
    """(range, blob) of the (document, hash) pairs by hash range, repeats within a document dropped."""
    part = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    order = np.lexsort((hashes, doc, part))
    part, doc, hashes = part[order], doc[order], hashes[order]
    new = np.ones(len(part), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    part, doc, hashes = part[new], doc[new], hashes[new]
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(part)]):
        if a < b:
            holders, n = np.unique(doc[a:b], return_counts=True)
            yield int(part[a]), len(holders), head(ids[holders], n), hashes[a:b].tobytes()


def head(holders: np.ndarray, n: np.ndarray) -> bytes:
    """Documents and how many hashes each has."""
    return pa.compress(np.concatenate([holders, n]).astype(np.int64).tobytes(), codec="zstd", asbytes=True)


def request_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()),
                                       pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                                      names=["part", "holders", "head", "hashes"])


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, hash) pairs of a range."""
    ids, hashes = [], []
    for n, head, blob in zip(*(table.column(c).to_pylist() for c in ("holders", "head", "hashes"))):
        h = np.frombuffer(pa.decompress(head, 2 * n * 8, codec="zstd", asbytes=True), np.int64)
        ids.append(np.repeat(h[:n], h[n:]))
        hashes.append(np.frombuffer(blob, np.uint64))
    if not ids:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(ids), np.concatenate(hashes)


def prime(n: int) -> int:
    """The least prime from n on: bundles are doc_id modulo a prime, in tasks as in the plan."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


