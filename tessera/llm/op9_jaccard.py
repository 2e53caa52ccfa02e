"""N-gram Jaccard join on count vectors.

A text's set is that of its distinct shingles of k words. Shingles are dealt into groups by hash, and two things are made
of the groups. First, blocks: with similarity s, sets of at most n shingles differ in at most D = n (1 - s) / s, so of
more than D groups at least one is equal in both; sets that agree in a whole group of the same number of groups share a
block, and a linked pair can't miss all blocks. Second, points: the counts of groups are indexed in an R-tree whose
boxes bound a pair's overlap by the sum of coordinate minima. Pairs that survive both are verified on the sets. Counts of a
few large groups are alike for any two large sets, so larger sets have more groups, MOST_GROUPS at most, and points that
meet are folded to the fewest that one of them has: with the same number for all, the long texts of a corpus are one
component of ties, and its texts' copies for pairs of chunks grow with the square of the corpus.

Equal sets are one node from the start, whatever their number. Near copies share hundreds of blocks, so pairs of blocks of
FEW nodes at most are told once for all blocks of a task. Others' points are indexed, and the surviving pairs tie
nodes that could be linked. The components of these ties are small; each is indexed again with its sets at hand, and the
surviving pairs are verified. Where a block or a component has more than CHUNK nodes, pairs of chunks of it are searched
instead, each by a task. A search spreads from node to node and leaves out those that it has reached, so what comes out is
a spanning forest, and the components of the verified links are the result: no link between different texts is lost.

The sets are those of 52-bit hashes of shingles (a false match within a pair has a chance of about 1e-9), equal sets are
told by 64 bits.

Defined results. Null, empty and blank texts have no shingles and are linked with nothing. Texts of fewer than k words have
one, the whole sequence. Rows with equal sets are linked; a doc_id may repeat. A null doc_id names no component: its row
has a null component_id and links nothing. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, blocks, bound_arrow, few, free, partitions, utf8
from .graph import components
from .texthash import mix, shingles

#: The least and the most coordinates of a point, points of an R-tree leaf, and nodes of a chunk; a search compares those of two chunks at most.
GROUPS, MOST_GROUPS, LEAF, CHUNK = 64, 4_096, 16, 1_000
#: Nodes of a block whose pairs are told one by one.
FEW = 8
#: Postings that a mapper holds before it hands them on.
HOLD = 1_000_000
#: Bytes of text for each bucket of blocks: bounds what a task holds.
BUCKET_BYTES = 64 << 20
ROW_BITS = 12
_LOW = np.uint64((1 << (64 - ROW_BITS)) - 1)


def classes(percent: int, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size classes: the first size of each, its number of groups, and how many empty groups a set may leave out."""
    first, groups, spare, low = [], [], [], 1
    while low < most:
        high = max(low + 1, low * 5 // 4)
        differ = (high - 1) * (100 - percent) // percent  # the largest difference of a pair whose smaller set is in the class
        extra = 0 if not differ else 2 + differ // 16
        first.append(low)
        groups.append(differ + 1 + extra)
        spare.append(extra)
        low = high
    return np.array(first), np.array(groups), np.array(spare)


def sets(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of at most 2**ROW_BITS rows, sorted by row and hash, and where each row's begin."""
    h, row = shingles(raw, at, k)
    key = (row.astype(np.uint64) << np.uint64(64 - ROW_BITS)) | (h >> np.uint64(ROW_BITS))
    key = np.unique(key)
    first = np.searchsorted(key, np.arange(len(at), dtype=np.uint64) << np.uint64(64 - ROW_BITS)) if len(at) <= 1 << ROW_BITS else None
    if first is None:
        raise ValueError("too many rows at once")
    first[-1] = len(key)
    return key & _LOW, first


def widths(n: np.ndarray, percent: int) -> np.ndarray:
    """Coordinates of the points of sets of n shingles: so many that unrelated sets of one size fall below the similarity's bound.
    With l shingles a group they share, by counts, all but some 0.56 / sqrt(l) of them."""
    asked = np.maximum(np.asarray(n, np.int64) * (10 * (100 - percent) ** 2) // (100 + percent) ** 2, 1)
    return np.clip(1 << np.ceil(np.log2(asked)).astype(np.int64), GROUPS, MOST_GROUPS)


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit value for each row's set; 0 for an empty one."""
    out = np.zeros(len(first) - 1, np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = mix(np.add.reduceat(mix(h), first[some])) | np.uint64(1)
    return out


def postings(h: np.ndarray, first: np.ndarray, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Block keys of the given rows' sets, and each key's row."""
    lows, groups, spare = classes(percent, 1 << 32)
    n = np.diff(first)[rows]
    keys, owners = [], []
    mine = np.searchsorted(lows, n, "right") - 1
    least = np.searchsorted(lows, -(-n * percent // 100), "right") - 1  # the class of the smallest set that could be linked
    for back in range(int((mine - least).max(initial=-1)) + 1):
        chosen = np.flatnonzero(mine - back >= least)
        c, r = (mine - back)[chosen], rows[chosen]
        size = n[chosen]
        each = np.repeat(np.arange(len(r)), size)
        where = np.repeat(first[r] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        value = h[where]
        count = groups[c].astype(np.uint64)
        # A shingle's group by its upper bits: hashes come sorted, so those of a group stand together.
        group = ((value >> np.uint64(20)) * count[each]) >> np.uint64(32)
        turn = np.flatnonzero(np.concatenate([[True], (each[1:] != each[:-1]) | (group[1:] != group[:-1])])) if len(value) else np.zeros(0, int)
        owner = each[turn]
        body = np.add.reduceat(mix(value), turn) if len(turn) else np.zeros(0, np.uint64)
        tag = (c[owner].astype(np.uint64) << np.uint64(40)) | group[turn]
        keys.append(mix(body ^ mix(tag + np.uint64(1))))
        owners.append(r[owner])
        empty = count.astype(int) - np.bincount(owner, minlength=len(r))
        for i in np.flatnonzero(empty > spare[c]):  # too many empty groups to leave them out
            there = np.setdiff1d(np.arange(int(count[i])), group[turn[owner == i]].astype(int))
            keys.append(mix(mix((np.uint64(c[i]) << np.uint64(40) | there.astype(np.uint64)) + np.uint64(1))))
            owners.append(np.full(len(there), r[i]))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


#: A key keeps 40 bits on its way, which with its bucket tell blocks apart well enough: a false meeting costs a comparison.
KEY_BITS = 40


def _squeeze(node: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(node.tobytes())


def _upper(key: np.ndarray) -> bytes:
    """The bits of keys above the lower 32 that are kept, a byte each."""
    return ((key >> np.uint64(32)) & np.uint64((1 << KEY_BITS - 32) - 1)).astype("<u1").tobytes()


_MAPPED = "bucket int, a binary, b binary, c binary, d binary"


def _map(k: int, percent: int, buckets: int):
    """Rows with bucket -1 hold doc ids, sizes and nodes; those with -2 nodes, sizes and points; the others block keys and their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        seen: dict[int, None] = {}

        def flush() -> pa.RecordBatch:
            key, node = np.concatenate(keys), np.concatenate(nodes)
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cut))
            part = [order[cut[i] : cut[i + 1]] for i in some]
            return pa.record_batch(
                [pa.array(some, pa.int32()), pa.array([key[p].astype("<u4").tobytes() for p in part], pa.binary()), pa.array([_squeeze(node[p]) for p in part], pa.binary()), pa.array([_upper(key[p]) for p in part], pa.binary()), pa.nulls(len(part), pa.binary())],
                ["bucket", "a", "b", "c", "d"],
            )

        held = 0
        for batch in batches:
            raw_all, at_all = utf8(batch.column("text"))
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False).astype("<i8") for c in ("doc_id", "tag"))
            for i, j in blocks(at_all):
                at = at_all[i : j + 1]
                h, first = sets(raw_all[at[0] : at[-1]], at - at[0], k)
                node = signatures(h, first)
                yield pa.record_batch(
                    [pa.array([-1], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[i:j], np.diff(first).astype("<i8"), node, tags[i:j]))], ["bucket", "a", "b", "c", "d"]
                )
                fresh = [r for r, v in enumerate(node.tolist()) if v and v not in seen and not seen.update({v: None})]
                if len(seen) > HOLD:
                    seen.clear()
                if fresh:
                    new = np.array(fresh)
                    size = np.diff(first)[new]
                    width = widths(size, percent)
                    for groups in np.unique(width).tolist():
                        own = new[width == groups]
                        point = counts(np.concatenate([h[first[r] : first[r + 1]] for r in own]), np.concatenate([[0], np.cumsum(size[width == groups])]), groups)
                        point = zstandard.ZstdCompressor(level=1).compress(point.astype("<i4").tobytes())
                        yield pa.record_batch([pa.array([-2], pa.int32()), *(pa.array([x], pa.binary()) for x in (node[own].tobytes(), size[width == groups].astype("<i8").tobytes(), point)), pa.nulls(1, pa.binary())], ["bucket", "a", "b", "c", "d"])
                    key, owner = postings(h, first, new, percent)
                    keys.append(key)
                    nodes.append(node[owner])
                    held += len(key)
                    if held >= HOLD:
                        yield flush()
                        keys, nodes, held = [], [], 0
        if held:
            yield flush()

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.record_batch([pa.array(np.frombuffer(row[c], "<i8")) for c in "abcd"], ["doc_id", "n_shingles", "node", "tag"])


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points by node, a byte a coordinate where that holds all, else four."""
    for batch in batches:
        for row in batch.to_pylist():
            point = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["c"]), "<i4").reshape(len(row["a"]) // 8, -1)
            cells = [(p.astype("<u1") if most < 256 else p).tobytes() for p, most in zip(point, point.max(1).tolist(), strict=True)]
            yield pa.record_batch([pa.array(np.frombuffer(row["a"], "<i8")), pa.array(np.frombuffer(row["b"], "<i8")), pa.array(cells, pa.binary())], ["node", "n", "point"])


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return a[new], b[new]


_MET = "a long, b long, size long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks that more than one node is in. Rows with size 0 hold a pair of nodes that share a block of FEW at most; the others
    a larger block, a node of it, and how many it has."""
    keys, nodes = [], []
    for batch in batches:
        for row in batch.to_pylist():
            upper = np.frombuffer(row["c"], "<u1").astype(np.uint64) | np.uint64(row["bucket"] << KEY_BITS - 32)
            keys.append(np.frombuffer(row["a"], "<u4").astype(np.uint64) | upper << np.uint64(32))
            nodes.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(row["b"]), "<i8"))
    if not keys:
        return
    key, node = np.concatenate(keys), np.concatenate(nodes)
    keys, nodes = [], []
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
    key, node = key[new], node[new]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    held = np.diff(np.append(begins, len(key)))
    several = np.flatnonzero(np.repeat(held, held) > FEW)
    for i in range(0, len(several), 50_000):
        some = several[i : i + 50_000]
        yield pa.record_batch([pa.array(key[some].view("<i8")), pa.array(node[some]), pa.array(np.repeat(held, held)[some])], ["a", "b", "size"])

    def told() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(a), 50_000):
            yield pa.record_batch([pa.array(a[i : i + 50_000]), pa.array(b[i : i + 50_000]), pa.array(np.zeros(len(a[i : i + 50_000]), np.int64))], ["a", "b", "size"])

    a = b = np.zeros(0, np.int64)
    for size in range(2, FEW + 1):
        first = begins[held == size]
        for i, j in ((i, j) for j in range(size) for i in range(j)):  # nodes of a block are sorted
            a, b = _distinct(np.concatenate([a, node[first + i]]), np.concatenate([b, node[first + j]]))
            if len(a) > HOLD:
                yield from told()
                a = b = np.zeros(0, np.int64)
    yield from told()


class CountTree:
    """A packed R-tree over count vectors. Boxes keep the upper corner and the range of sizes, which is all the bound needs."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.points, self.sizes, self.open = points, sizes, np.ones(len(points), bool)
        self.order = np.concatenate(self._split(np.arange(len(points)), leaf)) if len(points) else np.zeros(0, int)
        # Levels from the leaves up: (upper corners, least size, largest size); a node's children are `leaf` in a row.
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        self.levels, self.fan = [], leaf
        while True:
            cut = np.arange(0, len(top), leaf)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))
            if len(top) == 1:
                break
        self.leaf_of = np.empty(len(points), np.int64)
        self.leaf_of[self.order] = np.arange(len(points)) // leaf
        self.live = np.bincount(self.leaf_of)  # open points of each leaf

    def close(self, rows: list[int]) -> None:
        """Leave points out from now on."""
        self.open[rows] = False
        np.subtract.at(self.live, self.leaf_of[rows], 1)

    def _split(self, rows: np.ndarray, leaf: int) -> list[np.ndarray]:
        """Halve along the size or the coordinate that spreads most, until a leaf is left."""
        todo, out = [rows], []
        while todo:
            rows = todo.pop()
            if len(rows) <= leaf:
                out.append(rows)
                continue
            spread = np.append(np.ptp(self.points[rows].astype(np.int64), axis=0), np.ptp(self.sizes[rows]))
            axis = int(spread.argmax())
            value = self.sizes[rows] if axis == self.points.shape[1] else self.points[rows, axis]
            half = -(-len(rows) // 2 // leaf) * leaf
            rows = rows[np.argsort(value, kind="stable")]
            todo += [rows[half:], rows[:half]]
        return out

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Open points whose overlap with this one could reach what the similarity asks of two sets of their sizes."""
        asked = lambda other: -(-percent * (size + other) // (100 + percent))
        fits = lambda low, high: (100 * high >= percent * size) & (100 * size >= percent * low)
        at = np.zeros(1, int)
        for depth in range(len(self.levels) - 1, -1, -1):
            if not depth:
                at = at[self.live[at] > 0]
            top, low, high = (x[at] for x in self.levels[depth])
            keep = fits(low, high) & (np.minimum(top, point).sum(1, dtype=np.int64) >= asked(low))
            at = (at[keep][:, None] * self.fan + np.arange(self.fan)).ravel()
            at = at[at < (len(self.levels[depth - 1][1]) if depth else len(self.order))]
        rows = self.order[at]
        rows = rows[self.open[rows] & fits(self.sizes[rows], self.sizes[rows])]
        return rows[np.minimum(self.points[rows], point).sum(1, dtype=np.int64) >= asked(self.sizes[rows])]


def counts(h: np.ndarray, first: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The point of each set: how many shingles each group has."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    group = ((mix(h) >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
    return np.bincount(row * groups + group.astype(np.int64), minlength=(len(first) - 1) * groups).reshape(-1, groups).astype(np.int32)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def spread(points: np.ndarray, sizes: np.ndarray, percent: int, test=None) -> list[tuple[int, int]]:
    """Pairs that survive the bound (and the test, if there is one) and span the components that all such pairs make.

    From each node reached, the search goes on to the open ones; one that it reaches is not open any more.
    """
    if len(points) == 2 and test is None:
        size = int(sizes[0] + sizes[1])
        return [(0, 1)] if np.minimum(points[0], points[1]).sum() * (100 + percent) >= percent * size else []
    tree, out = CountTree(points, sizes), []
    for start in range(len(points)):
        if not tree.open[start]:
            continue
        tree.close([start])
        todo = [start]
        while todo:
            i = todo.pop()
            near = tree.near(points[i], int(sizes[i]), percent)
            reached = near.tolist() if test is None else [j for j in near.tolist() if test(i, j)]
            if reached:
                tree.close(reached)
            todo += reached
            out += [(i, j) for j in reached]
    return out


def forest(own: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Linked pairs of these sets that span their components."""
    first = np.concatenate([[0], np.cumsum([len(s) for s in own])])
    return spread(counts(np.concatenate(own), first, int(widths(np.diff(first), percent).min())), np.diff(first), percent, lambda i, j: linked(own[i], own[j], percent))


def folded(points: list[bytes], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Points as rows of as many coordinates as the one with the fewest has: groups are halves of those twice as large."""
    width = widths(sizes, percent)
    least = int(width.min())
    out = np.empty((len(points), least), np.int32)
    for i, (p, w) in enumerate(zip(points, width.tolist(), strict=True)):
        row = np.frombuffer(p, "<u1" if len(p) == w else "<i4")
        out[i] = row if w == least else row.reshape(least, -1).sum(1, dtype=np.int64)
    return out


def _tie(percent: int):
    """Rows come sorted by search, a block, two chunks of one, or a pair; its points are indexed, and the ties that span its
    surviving pairs go out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        a, b = [], []

        def end() -> None:
            if len(held) > 1:
                nodes = list(held)
                sizes = np.array([n for n, _ in held.values()])
                for i, j in spread(folded([p for _, p in held.values()], sizes, percent), sizes, percent):
                    a.append(nodes[i])
                    b.append(nodes[j])

        for batch in batches:
            for search, node, n, point in zip(*(batch.column(c).to_pylist() for c in ("search", "node", "n", "point")), strict=True):
                if search != now:
                    end()
                    now, held = search, {}
                held[node] = (n, point)
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        end()
        if a:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _searches(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Rows with `search`: of a key with at most CHUNK rows the key, of others each pair of chunks that the row's is in."""
    chunks = F.ceil(F.col(size) / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64("node"), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda o: F.concat_ws("/", F.col(key).cast("string"), F.least(chunk, o).cast("string"), F.greatest(chunk, o).cast("string")))
    return rows.withColumn("search", F.explode(pairs))


def _search(k: int, percent: int):
    """Rows come sorted by search; each search's texts are compared, and its spanning links go out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, {}

        def end() -> Iterator[pa.RecordBatch]:
            nodes = list(own)
            pairs = forest(list(own.values()), percent) if len(own) > 1 else []
            if pairs:
                yield pa.record_batch([pa.array([nodes[i] for i, _ in pairs], pa.int64()), pa.array([nodes[j] for _, j in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            raw_all, at_all = utf8(batch.column("text"))
            search, asked = batch.column("search").to_pylist(), batch.column("node").to_pylist()
            for i, j in blocks(at_all):
                at = at_all[i : j + 1]
                h, first = sets(raw_all[at[0] : at[-1]], at - at[0], k)
                node = signatures(h, first).view("<i8").tolist()
                for r in range(i, j):
                    if search[r] != now:
                        yield from end()
                        now, own = search[r], {}
                    if node[r - i] == asked[r]:  # a doc_id may stand for other texts too
                        own[asked[r]] = h[first[r - i] : first[r - i + 1]]
        yield from end()

    return run


def join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, node (equal sets have one) and tag (the text's hash, xxhash64) of each row."""
    spark = docs.sparkSession
    bound_arrow(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    known = texts.where("doc_id is not null")
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-volume // BUCKET_BYTES))

    mapped = Written(known.select("*", F.xxhash64("text").alias("tag")).mapInArrow(_map(k, percent, buckets), _MAPPED), "jaccard-map")
    rows = Written(mapped.df.where("bucket = -1").select("a", "b", "c", "d").mapInArrow(_rows, "doc_id long, n_shingles long, node long, tag long"), "jaccard-rows", few(spark)).df
    points = mapped.df.where("bucket = -2").select("a", "b", "c").mapInArrow(_points, "node long, n long, point binary").dropDuplicates(["node"])
    told = Written(mapped.df.where("bucket >= 0").repartitionById(buckets, F.col("bucket")).mapInArrow(_meet, _MET), "jaccard-met", few(spark))
    free(spark)
    several = _searches(told.df.where("size > 0").select(F.col("a").alias("block"), F.col("b").alias("node"), "size"), "block", "size").select("search", "node")
    two = told.df.where("size = 0").select("a", "b").distinct().select(F.concat_ws("-", "a", "b").alias("search"), F.explode(F.array("a", "b")).alias("node"))
    met = several.union(two).join(points, "node")
    met = met.repartition(partitions(spark), "search").sortWithinPartitions("search")
    maybe = components(met.mapInArrow(_tie(percent), "a long, b long"), "jaccard-maybe")
    mapped.drop()
    told.drop()
    del points, several, two, met
    free(spark)

    reps = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"))
    sizes = maybe.df.groupBy("label").agg(F.count("*").alias("size"))
    asked = _searches(maybe.df.join(sizes, "label").join(reps, "node"), "label", "size").select("node", F.col("rep").alias("doc_id"), "search")
    ready = known.join(asked, "doc_id").select("search", "node", "text").repartition(partitions(spark), "search").sortWithinPartitions("search", "node")
    links = components(ready.mapInArrow(_search(k, percent), "a long, b long"), "jaccard")
    maybe.drop()

    named = links.df.join(reps, "node").groupBy("label").agg(F.min("rep").alias("component_id"))
    of_node = reps.join(links.df.join(named, "label").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    told = rows.join(of_node, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node", "tag")
    if texts.where("doc_id is null").limit(1).count():
        bare = texts.where("doc_id is null").mapInArrow(_sizes(k), "doc_id long, n_shingles long, component_id long, node long, tag long")
        told = told.unionByName(bare)
    return told


def _sizes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_all, at_all = utf8(batch.column("text"))
            for i, j in blocks(at_all):
                at = at_all[i : j + 1]
                _, first = sets(raw_all[at[0] : at[-1]], at - at[0], k)
                none = pa.nulls(j - i, pa.int64())
                yield pa.record_batch([none, pa.array(np.diff(first).astype(np.int64)), none, none, none], ["doc_id", "n_shingles", "component_id", "node", "tag"])

    return run
