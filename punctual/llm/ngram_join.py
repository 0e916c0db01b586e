"""N-gram Jaccard self-join with a token-group matrix (operator 2).

Method: the set of a document is its distinct k-word shingles.  Equal sets are
one node.  Nodes are partitioned into groups of similar sets (same most held
shingle among their first ones, similar size, at most about ``GROUP`` nodes);
the token-group matrix
holds, for each shingle, the groups whose union contains it.  A query set can
only reach the threshold within a group that contains one of the query's
first ``n - ceil(t n) + 1`` shingles (in any one order of all shingles), so
only those cells of the matrix are stored.  A cell is one row of a shingle and
a group, whatever number of the group's nodes it stands for, with their least
size and their greatest reach: the number of a node's shingles from this one
on.  Two sets whose first common shingle this is share no more than the lesser
reach, so a pair of groups is a candidate only if a common cell's reach is
enough for the sizes.  A group is shipped as its union with one bit for each
shingle and node: there the overlap of each set with the other group's whole
union is bounded, and only sets that can still hold a partner are opened and
compared.

The order of the shingles is the exact number of sets that hold them, rarest
first.  A set that holds that many shingles alone has no partner and leaves at
this point.

Two rounds: first every group with itself and with the head group of its
bucket, then all pairs of groups that share a cell whose nodes are not yet in
one component.  No list of partners is cut.

Words: ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  Fewer than k words:
the whole sequence is the one shingle.  Shingles and sets are compared by
64-bit hashes.

Defined results: null, empty and blank texts have an empty set and link with
nothing; repeated rows and equal sets share a component; component_id is the
smallest doc_id of the component (null ids aside); an empty table gives an
empty result; extra columns are ignored by ``components`` and kept by
``one_of_each``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm import _text
from punctual.llm._deal import REQUEST, packed, prime, request_batch, unpack
from punctual.llm._store import bitmap_bits, in_bitmap, membership_bitmap, stored
from punctual.llm.components import connected
from punctual.session import ship_package

K, PERCENT = 5, 80
#: Nodes of a group, and of a bundle in which cells are picked.
GROUP, NODES = 64, 4096


def _sets(texts: pa.Array, k: int):
    """Sorted distinct shingle hashes of each text."""
    for _, _, data, offsets in _text.slices(texts):
        words = _text.hash_words(data, offsets, _text.SPACE_FOLDED)
        grams, at = _text.ngrams(words, k)
        cut = np.searchsorted(at, words.first)
        for d in range(len(offsets) - 1):
            n = int(words.first[d + 1] - words.first[d])
            if n >= k:
                yield np.unique(grams[cut[d]:cut[d + 1]])
            elif n:
                part = words.hash[words.first[d]:words.first[d + 1]]
                yield _text.ngrams(_text.Words(part, np.array([0, n]), part, part, data), n)[0]
            else:
                yield _NOTHING


_NOTHING = np.empty(0, np.uint64)


def _node(s: np.ndarray) -> np.uint64:
    """Identity of a set."""
    sums = np.array([_text.mix(s).sum(dtype=np.uint64), _text.mix(~s).sum(dtype=np.uint64)])
    return _text.mix(sums[:1] ^ _text.mix(sums[1:]))[0]


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _keep(n, percent: int):
    """How many of the first shingles of a set of n must be looked at."""
    return n + (-percent * n // 100) + 1


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, content (a hash of the text), n and node of each row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            sets = [(len(s), _node(s)) if len(s) else (0, 0) for s in _sets(batch.column(1), k)]
            n, node = zip(*sets) if sets else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(_signed(node))],
                names=["doc_id", "content", "n", "node"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), _content()).mapInArrow(
        run, f"doc_id {kind}, content long, n long, node long")


def _content():
    return F.xxhash64(F.col("text").cast("string")).alias("content")


def _requests(docs: DataFrame, k: int, ranges: int) -> DataFrame:
    """All shingles of all sets, dealt out by hash; the holder of a shingle is its node."""
    def run(batches):
        for batch in batches:
            nodes, tokens, size = [], [], 0

            def rows():
                holder = np.repeat(np.arange(len(nodes)), [len(t) for t in tokens])
                return list(packed(_signed(nodes), holder, np.concatenate(tokens), ranges))
            for s in _sets(batch.column(0), k):
                if len(s):
                    nodes.append(_node(s))
                    tokens.append(s)
                    size += len(s)
                    if size > 1 << 19:
                        yield request_batch(rows())
                        nodes, tokens, size = [], [], 0
            if size:
                yield request_batch(rows())

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, REQUEST)


def _shared(requests: DataFrame, bundles: int) -> DataFrame:
    """By bundle of nodes: shingles that two or more nodes hold, with the number of nodes."""
    def run(table: pa.Table) -> pa.Table:
        nodes, tokens = unpack(table)
        order = np.lexsort((nodes, tokens))
        nodes, tokens = nodes[order], tokens[order]
        new = np.ones(len(nodes), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
        nodes, tokens = nodes[new], tokens[new]
        begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.empty(0, int)
        size = np.diff(np.append(begin, len(tokens)))
        held = np.repeat(size, size)
        nodes, tokens, held = nodes[held > 1], tokens[held > 1], held[held > 1]
        bundle = nodes % bundles
        order = np.argsort(bundle, kind="stable")
        bundle, nodes, tokens, held = bundle[order], nodes[order], tokens[order], held[order]
        cut = np.searchsorted(bundle, np.arange(bundles + 1))
        some = np.flatnonzero(np.diff(cut))
        return pa.table({"bundle": pa.array(some, pa.int64()), **{
            name: pa.array([pa.compress(x[cut[i]:cut[i + 1]].tobytes(), codec="zstd", asbytes=True) for i in some],
                           pa.binary()) for name, x in (("nodes", nodes), ("tokens", tokens), ("held", held.astype(np.int64)))},
            "size": pa.array(np.diff(cut)[some], pa.int64())})

    return requests.groupBy("part").applyInArrow(
        run, "bundle long, nodes binary, tokens binary, held binary, size long")


def _first_cells(nodes: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(token, node, held, reach): of the first shingles of each node those that others hold, too, by how many nodes, and
    how many of the node's shingles do not come before."""
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        holder, token, held = (np.frombuffer(b"".join(
            pa.decompress(x, 8 * n, codec="zstd", asbytes=True) for x, n in
            zip(answers.column(c).to_pylist(), answers.column("size").to_pylist())), t) for c, t in
            (("nodes", np.int64), ("tokens", np.uint64), ("held", np.int64)))
        order = np.lexsort((token, held, holder))
        holder, token, held = holder[order], token[order], held[order]
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(node)
        node, n = node[order], n[order]
        at = np.searchsorted(node, holder)
        begin = np.searchsorted(holder, node)
        mine = np.searchsorted(holder, node, side="right") - begin
        # its own shingles come first: they take up places but join with nothing
        places = _keep(n, percent) - (n - mine)
        rank = np.arange(len(holder)) - begin[at]
        pick = rank < places[at]
        return pa.table({"token": pa.array(_signed(token[pick])), "node": pa.array(holder[pick]),
                         "held": pa.array(held[pick]), "reach": pa.array((mine[at] - rank)[pick])})

    return nodes.groupBy("bundle").cogroup(shared.groupBy("bundle")).applyInArrow(
        run, "token long, node long, held long, reach long")


def _packed(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple:
    """A group: its nodes, the union of their sets and, node by node, one bit for each shingle of the union."""
    union = np.unique(np.concatenate(sets))
    bits = []
    for s in sets:
        mark = np.zeros(len(union), bool)
        mark[np.searchsorted(union, s)] = True
        bits.append(np.packbits(mark).tobytes())
    return nodes.tobytes(), union.tobytes(), pa.compress(b"".join(bits), codec="zstd", asbytes=True)


class _Group:
    """A group as ``_packed`` wrote it: ``place`` has the places in ``union`` of the shingles of each node in turn."""

    def __init__(self, nodes: bytes, union: bytes, bits: bytes):
        self.nodes, self.union = np.frombuffer(nodes, np.int64).tolist(), np.frombuffer(union, np.uint64)
        width = (len(self.union) + 7) // 8
        bits = np.frombuffer(pa.decompress(bits, width * len(self.nodes), codec="zstd", asbytes=True), np.uint8)
        place = [np.flatnonzero(np.unpackbits(x, count=len(self.union))) for x in bits.reshape(len(self.nodes), width)]
        self.sizes = np.array([len(x) for x in place])
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.place = np.concatenate(place)


def _opened(a: _Group, b: _Group, percent: int):
    """(i, j) of all qualifying sets of a and b: bound by the union of b first, then each set of b at once."""
    at = np.minimum(np.searchsorted(b.union, a.union), len(b.union) - 1)
    known = b.union[at] == a.union
    least = b.sizes.min()
    if (100 + percent) * np.count_nonzero(known) < percent * (a.sizes.min() + least):
        return  # the unions have too little in common
    for i, n in enumerate(a.sizes):
        mine = a.place[a.begin[i]:a.begin[i + 1]]
        hit = at[mine[known[mine]]]
        if 100 * len(hit) < percent * max(n, least):
            continue  # no set of this group can qualify
        mark = np.zeros(len(b.union), np.int64)
        mark[hit] = 1
        common = np.add.reduceat(mark[b.place], b.begin[:-1])
        yield from ((i, int(j)) for j in np.flatnonzero(100 * common >= percent * (n + b.sizes - common)))


def _compare(a: _Group, b: _Group, percent: int):
    """Spanning links between the nodes of one pair of groups (or inside one group)."""
    parent = {n: n for n in (*a.nodes, *b.nodes)}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n
    for i, j in _opened(a, b, percent):
        x, y = root(a.nodes[i]), root(b.nodes[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield x, y


_PACKED = ("nodes", "union", "bits")


def _inside(groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found inside each group."""
    def run(batches):
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c) for c in _PACKED)):
                group = _Group(*(x.as_py() for x in row))
                out += _compare(group, group, percent)
            yield _links(out)

    return groups.where("c > 1").select(*_PACKED).mapInArrow(run, "a long, b long")


def _verify(groups: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in the given pairs (g1, g2) of groups."""
    both = pairs
    for i in (1, 2):
        both = both.join(groups.select(F.col("group").alias(f"g{i}"), *[F.col(c).alias(f"{c}{i}") for c in _PACKED]),
                         f"g{i}")

    def run(batches):
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c) for c in range(6))):
                row = [x.as_py() for x in row]
                out += _compare(_Group(*row[:3]), _Group(*row[3:]), percent)
            yield _links(out)

    return both.select(*[f"{c}{i}" for i in (1, 2) for c in _PACKED]).mapInArrow(run, "a long, b long")


def _links(pairs) -> pa.RecordBatch:
    x = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], names=["a", "b"])


def _classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, named): doc_id, content, n and node of each row; doc_id and content of the first row of each node (of the
    least doc_id, null ids last, then the least content), and its component."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select("doc_id", "text")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(_profile(docs, k), "join-profile")
    nodes = rows.where("n > 0").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("row"), F.first("n").alias("n")) \
        .select("node", "n", "row.doc_id", "row.content")
    bundles = prime(-(-rows.count() // NODES))
    numbered = nodes.select("node", "n").withColumn("bundle", F.pmod("node", F.lit(bundles).cast("long")))
    cells = stored(_first_cells(numbered, _shared(_requests(docs, k, ranges), bundles), percent), "join-cells")
    # a shingle of one node only links nothing
    several = cells.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y")
    # sizes of linked sets lie at most one step apart
    size_step = F.floor(F.log("n") / math.log(100 / percent) + 1e-9) if percent < 100 else F.col("n")
    cells = stored(cells.join(several.select("token"), "token", "left_semi"), "join-shared")
    common = cells.groupBy("node").agg(F.max_by("token", F.struct("held", "token")).alias("common"))
    live = stored(nodes.join(common, "node").withColumn("step", size_step), "join-live")
    buckets = live.groupBy("common", "step").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).alias("chunks"))
    live = stored(live.join(buckets, ["common", "step"]).select(
        "node", "doc_id", "content", "n", "step",
        F.xxhash64("common", "step", F.pmod("node", "chunks")).alias("group"),
        F.xxhash64("common", "step", F.lit(0).cast("long")).alias("head")), "join-groups")
    groups = stored(_groups(docs, live, k), "join-sets")
    heads = live.where("group <> head").select(
        F.least("group", "head").alias("g1"), F.greatest("group", "head").alias("g2")).distinct()
    links = stored(_inside(groups, percent).union(_verify(groups, heads, percent)), "join-links")
    parts = stored(connected(links), "join-parts")
    component = F.coalesce("component", "node")
    matrix = stored(cells.join(live.select("node", "group", "step", "n"), "node").join(parts, "node", "left")
                    .groupBy("token", "group", "step").agg(
                        F.min(component).alias("least"), F.max(component).alias("most"),
                        F.max("reach").alias("reach"), F.min("n").alias("n")), "join-matrix")
    across = matrix.groupBy("token").agg(F.min("group").alias("x"), F.max("group").alias("y"),
                                         F.min("least").alias("least"), F.max("most").alias("most")) \
        .where("x <> y AND least <> most")
    matrix = matrix.join(across.select("token"), "token", "left_semi")
    left, right = (matrix.select("token", *[F.col(c).alias(f"{c}{i}") for c in matrix.columns[1:]]) for i in (1, 2))
    pairs = left.join(right, "token").where(
        "group1 < group2 AND abs(step1 - step2) <= 1 AND least(least1, least2) <> greatest(most1, most2)"
        f" AND {100 + percent} * least(reach1, reach2) >= {percent} * (n1 + n2)") \
        .select(F.col("group1").alias("g1"), F.col("group2").alias("g2")).distinct() \
        .join(heads, ["g1", "g2"], "left_anti")
    links = links.union(stored(_verify(groups, stored(pairs, "join-pairs"), percent), "join-links"))
    final = stored(connected(links), "join-components")
    named = nodes.select("node", "doc_id", "content").join(final, "node", "left").select(
        "node", "doc_id", "content", F.coalesce("component", "node").alias("component"))
    return rows, stored(named, "join-named")


def components(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``: documents link when
    100 * |intersection| >= percent * |union| of their shingle sets."""
    rows, named = _classes(docs, k, percent)
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(smallest, "component").select("node", "component_id")
    return rows.join(of_node, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _groups(docs: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """(group, c, nodes, union, bits): the c sets of each group in ``live``, from the text of each node's first row."""
    # the rows go through a bitmap first, so that an exchange takes the sets of these alone and not all texts
    row = F.xxhash64("doc_id", "content").alias("row")
    bitmap = docs.sparkSession.sparkContext.broadcast(
        membership_bitmap(live.select(row), "row", bitmap_bits(live.count())))

    def run(batches):
        last = None
        for batch in batches:
            some = pa.array(in_bitmap(bitmap.value, batch.column(0).to_numpy().view(np.uint64)))
            nodes, blobs = [], []
            for s in _sets(batch.column(1).filter(some), k):
                node = int(_signed([_node(s)])[0]) if len(s) else last
                if node != last:  # else a repeated row
                    last = node
                    nodes.append(node)
                    blobs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())],
                                             names=["node", "shingles"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), _content()).select(row, "text")
    sets = texts.mapInArrow(run, "node long, shingles binary").join(live.select("node", "group"), "node")

    def pack(table: pa.Table) -> pa.Table:
        # a repeated row may give its node again
        sets = dict(zip(table.column("node").to_pylist(), table.column("shingles")))
        row = _packed(np.array(list(sets), np.int64), [np.frombuffer(x.as_py(), np.uint64) for x in sets.values()])
        return pa.table({"group": table.column("group")[:1], "c": pa.array([len(sets)], pa.int64()),
                         **{c: pa.array([x], pa.binary()) for c, x in zip(_PACKED, row)}})

    return sets.groupBy("group").applyInArrow(
        pack, "group long, c long, nodes binary, union binary, bits binary")


def one_of_each(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest doc_id (null ids last), then of the least hash of
    the text; of rows equal in both any one.  Different texts of one id, or without an id, are judged apart.  Documents
    without words stay.  All columns stay."""
    _, named = _classes(docs, k, percent)
    text = F.col("text").cast("string")
    # ids and texts together are dealt out, so rows without an id are spread by their texts
    first = named.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("row")).select(
        F.xxhash64("row.doc_id", "row.none", "row.content").alias("__row"))
    words = text.isNotNull() & text.rlike(r"[^\x20\x09-\x0D]")
    # repeated rows meet before the exchange of the texts, which then serves the join, too
    kept = docs.where(words).withColumn("__row", F.xxhash64("doc_id", F.col("doc_id").isNull(), F.xxhash64(text))) \
        .dropDuplicates(["__row"]).join(first, "__row", "left_semi").drop("__row")
    return kept.union(docs.where(~words))
