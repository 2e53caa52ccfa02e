"""Media columns: copies of images, cropped or edited ones too, by local descriptors.

All corners above a response are found at several scales, however many an image has. Each gets an orientation from the
intensities around it, and 128 bits from comparisons of smoothed intensities at places that turn with it, so neither rotation
nor brightness changes them. A pair of images whose mutually nearest descriptors, DIFFER bits apart at most, vote LEAST_VOTES
times for one similarity (place, scale and angle) are copies. Classes are the components of all links.

Equal pixels are one image from the start. At first descriptors are tied, within a word of 32 bits, to the one of the first image,
so a logo that a third of all images show is one component after as many rows as there are descriptors. Then all descriptors
of each of SHORT_TABLES shorter keys, samples of SHORT bits, whose images are in different components are compared; two images
of which two descriptors or more meet within MEET bits have all of theirs compared, and vote. Images are dealt to blocks, and a
task has the points of two blocks, so what meets is told, counted and verified where it is found and only links are written.
Work grows with the square of the images that share keys and aren't copies; an image's points are sent once for each block.

The keys are an index: descriptors within MEET bits meet with a chance that the number of keys sets (0.94 at 3 bits, 0.6 at
8), and a copy has dozens of them. The tests compare its links with those of all pairs of images: 0.9 or more are found.

Defined results. A null image, one whose data don't have height * width bytes, or one without corners has no keypoints and
is copied only by equal data; null images are classes of their own. Rows with equal ids share a result each. A null id is
left out. An empty table gives an empty result. Other columns are ignored. Of equal distances all vote.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, blocks, bound_arrow, few, free
from .graph import components

BITS, TABLES, DIFFER = 128, 4, 20
#: Short keys and their bits; the bits that descriptors of two images differ in at most where they meet.
SHORT_TABLES, SHORT, MEET = 4, 24, 10
#: Scales, the step between them, and the smallest side of a scale.
SCALES, STEP, SIDE = 4, 1.41421356, 24
#: Half the side of what a descriptor sees: wide enough that smooth images of one kind differ in it.
RADIUS, LEAST_VOTES = 15, 5
#: Points of a block of images (at least BLOCKS blocks), and of a slice of it that is compared with another block at a time.
BLOCK_POINTS, BLOCKS, SLICE_POINTS = 1_000_000, 3, 100_000
#: Pairs of descriptors compared in one go (or all of one descriptor), and meetings held before they are put together by pairs of images.
CHUNK, MEETINGS = 1 << 20, 1 << 21
#: Bins of a vote: radians, octaves, and pixels of the smaller scale.
ANGLE_BIN, SCALE_BIN, PLACE_BIN = math.pi / 6, 0.7, 6.0

_draw = np.random.default_rng(7)
_POLAR = np.stack([RADIUS * np.sqrt(_draw.random((BITS, 2))), 2 * math.pi * _draw.random((BITS, 2))])
_DISC = np.array([(y, x) for y in range(-6, 7) for x in range(-6, 7) if y * y + x * x <= 36])

#: The bits of each short key, which overlap: four signed words of 32 bits.
_KEYS = [np.packbits(np.isin(np.arange(BITS), _draw.choice(BITS, SHORT, replace=False))).view("<i4").tolist() for _ in range(SHORT_TABLES)]

_POINTS = "node long, x float, y float, scale float, angle float, d0 int, d1 int, d2 int, d3 int"


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2 r + 1, edges repeated."""
    n = 2 * r + 1
    s = np.pad(np.cumsum(np.cumsum(np.pad(a, r, mode="edge"), 0), 1), ((1, 0), (1, 0)))
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / (n * n)


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear."""
    y, x = (np.arange(height) + 0.5) * a.shape[0] / height - 0.5, (np.arange(width) + 0.5) * a.shape[1] / width - 0.5
    y, x = y.clip(0, a.shape[0] - 1), x.clip(0, a.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], x - x0
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    return top * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keypoints (x, y, scale, angle) in the image's own pixels, and their bits as 16 bytes."""
    points, bits, scale = [], [], 1.0
    image = image.astype(np.float64)
    for _ in range(SCALES):
        h, w = round(image.shape[0] / scale), round(image.shape[1] / scale)
        if min(h, w) < SIDE:
            break
        a = _box(resize(image, h, w) if scale > 1 else image, 1)
        gy, gx = np.gradient(a)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        corner = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        around = np.pad(corner, 1, constant_values=-np.inf)
        peak = corner >= np.max([around[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
        peak &= corner > max(1e-6, 0.01 * corner.max())
        y, x = np.nonzero(peak)
        if len(y):
            disc = a[(y[:, None] + _DISC[:, 0]).clip(0, h - 1), (x[:, None] + _DISC[:, 1]).clip(0, w - 1)]
            angle = np.arctan2(disc @ _DISC[:, 0], disc @ _DISC[:, 1])
            turn = _POLAR[1][None] + angle[:, None, None]
            py = np.rint(y[:, None, None] + _POLAR[0] * np.sin(turn)).astype(int).clip(0, h - 1)
            px = np.rint(x[:, None, None] + _POLAR[0] * np.cos(turn)).astype(int).clip(0, w - 1)
            smooth = _box(a, 1)[py, px]
            bits.append(np.packbits(smooth[:, :, 0] < smooth[:, :, 1], axis=1))
            points.append(np.stack([x * scale, y * scale, np.full(len(x), scale), angle], 1))
        scale *= STEP
    if not points:
        return np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8)
    return np.concatenate(points), np.concatenate(bits)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            points, bits = describe(np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"]))
            if len(points):
                words = np.ascontiguousarray(bits).view("<i4")
                columns = [pa.array(np.full(len(points), row["node"])), *(pa.array(points[:, i].astype(np.float32)) for i in range(4)), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(4))]
                yield pa.record_batch(columns, ["node", "x", "y", "scale", "angle", "d0", "d1", "d2", "d3"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The points of an image as one row, or as a few: 16 bytes of place, scale and angle and 16 of words each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node = _numbers(batch, "node")
        spot = np.stack([_numbers(batch, c) for c in ("x", "y", "scale", "angle")], 1).astype("<f4")
        data = np.concatenate([spot.view(np.uint8), _bits(batch).view(np.uint8)], 1)
        at = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
        yield pa.record_batch([pa.array(node[at[:-1]]), pa.array([data[i:end].tobytes() for i, end in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["node", "points"])


def _numbers(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _bits(rows: pa.RecordBatch) -> np.ndarray:
    """The descriptors as two words of 64 bits."""
    return np.ascontiguousarray(np.stack([_numbers(rows, f"d{i}") for i in range(BITS // 32)], 1)).view(np.uint64)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    far = np.bitwise_count(a[:, :1] ^ b[:, 0])
    for i in range(1, a.shape[1]):
        far += np.bitwise_count(a[:, i : i + 1] ^ b[:, i])
    return far


def _often(values: np.ndarray) -> bool:
    """Whether a value is there LEAST_VOTES times."""
    own = np.sort(values)
    return bool((own[LEAST_VOTES - 1 :] == own[: len(own) - LEAST_VOTES + 1]).any())


def linked(p: tuple[np.ndarray, np.ndarray], q: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether the points (x, y, scale, angle) and words of two images have LEAST_VOTES votes for one similarity. Points vote
    that are the nearest of the other image to each other (equally near ones all do), as smooth images have many within DIFFER."""
    far = _far(p[1], q[1])
    least = far.min(1)
    rows = np.flatnonzero(least <= DIFFER)
    if len(rows) < LEAST_VOTES:  # a point has one vote
        return False
    own = far[rows]
    i, j = np.nonzero((own == least[rows, None]) & (own == far.min(0)))
    i = rows[i]
    if len(i) < LEAST_VOTES:
        return False
    (x, y, scale, angle), (to_x, to_y, to_scale, to_angle) = p[0][i].T.astype(float), q[0][j].T.astype(float)
    turn, grow = to_angle - angle, to_scale / scale
    around, octaves = turn % (2 * math.pi) / ANGLE_BIN, np.log2(grow) / SCALE_BIN
    place = None
    for grid in (0.0, 0.5):
        cell = (np.floor(around + grid).astype(np.int64) % round(2 * math.pi / ANGLE_BIN) << 56) + (np.floor(octaves + grid).astype(np.int64) + 32 << 50)
        if not _often(cell):  # few images that aren't copies agree in angle and scale
            continue
        if place is None:
            place = [(to_x - grow * (np.cos(turn) * x - np.sin(turn) * y)) / PLACE_BIN, (to_y - grow * (np.sin(turn) * x + np.cos(turn) * y)) / PLACE_BIN]
            spot = (np.floor(y / 2).astype(np.int64) << 24) + np.floor(x / 2).astype(np.int64)
        dx, dy = (np.floor(v + grid).astype(np.int64) for v in place)
        cell += (dx + (1 << 24) << 25) + dy + (1 << 24)
        if not _often(cell):
            continue
        order = np.lexsort((spot, cell))
        c, t = cell[order], spot[order]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (t[1:] != t[:-1])])
        if np.unique(c[new], return_counts=True)[1].max() >= LEAST_VOTES:
            return True
    return False


class _Block:
    """The images of a block: their nodes in order, where each one's points begin, and all points' image, place and words."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        rows.sort(key=lambda r: r[0])
        node, size = np.array([n for n, _ in rows], np.int64), np.array([len(p) for _, p in rows], np.int64) // 32
        self.node, image = np.unique(node, return_inverse=True)
        data = np.frombuffer(b"".join(p for _, p in rows), np.uint8).reshape(-1, 32)
        self.spot, self.words = np.ascontiguousarray(data[:, :16]).view("<f4"), np.ascontiguousarray(data[:, 16:]).view(np.uint64)
        self.image = np.repeat(image, size).astype(np.int32)
        self.at = np.searchsorted(self.image, np.arange(len(self.node) + 1))

    def points(self, image: int) -> tuple[np.ndarray, np.ndarray]:
        return self.spot[self.at[image] : self.at[image + 1]], self.words[self.at[image] : self.at[image + 1]]


def _key(words: np.ndarray, mask: list[int]) -> np.ndarray:
    """A number for the bits of a short key."""
    own = words & np.array(mask, "<i4").view(np.uint64)
    return own[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ own[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)


def _alike(words: np.ndarray, others: np.ndarray, order: np.ndarray, own: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Descriptors of `words` and of `others` with equal keys that are MEET bits apart at most. others[order] have the sorted `keys`."""
    rank = np.argsort(own)
    first, end = np.searchsorted(keys, own[rank]), np.searchsorted(keys, own[rank], "right")
    some = np.flatnonzero(end > first)
    rank, first, n = rank[some], first[some], (end - first)[some]
    at, k = np.concatenate([[0], np.cumsum(n)]), 0
    while k < len(n):
        stop = max(k + 1, int(np.searchsorted(at, at[k] + CHUNK, "right")) - 1)
        i = np.repeat(rank[k:stop], n[k:stop])
        j = order[np.arange(len(i)) + np.repeat(first[k:stop] - (at[k:stop] - at[k]), n[k:stop])]
        near = np.flatnonzero(np.bitwise_count(words[i, 0] ^ others[j, 0]) + np.bitwise_count(words[i, 1] ^ others[j, 1]) <= MEET)
        yield i[near], j[near]
        k = stop


def _together(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Each pair of images once, with the smallest and largest point."""
    pair, p, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(pair)
    pair, p, q = pair[order], p[order], q[order]
    at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, int)
    return (pair[at], np.minimum.reduceat(p, at), np.maximum.reduceat(q, at)) if len(at) else (pair, p, q)


def _links(left: _Block, right: _Block, labels: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Linked images (a < b), one of each block, that no links so far have put into one component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    of = lambda block: np.array([find(labels.get(n, n)) for n in block.node.tolist()], np.int64)
    index = []
    for mask in _KEYS:
        keys = _key(right.words, mask)
        order = np.argsort(keys).astype(np.int32)
        index.append((order, keys[order]))
    images = len(right.node)
    for first, end in blocks(left.at, SLICE_POINTS):
        begin = left.at[first]
        words, label, to_label, found, held = left.words[begin : left.at[end]], of(left), of(right), [], 0
        for mask, (order, keys) in zip(_KEYS, index, strict=True):
            if left is right:  # earlier images were compared with all
                later = right.image[order] >= first
                order, keys = order[later], keys[later]
            for i, j in _alike(words, right.words, order, _key(words, mask), keys):
                i = i + begin
                a, b = left.image[i], right.image[j]
                apart = np.flatnonzero((label[a] != to_label[b]) & ((a < b) | (left is not right)))
                a, b, i, j = a[apart], b[apart], i[apart], j[apart]
                # Two descriptors at least: the smallest and the largest point of the image with the smaller number differ.
                p = np.where(left.node[a] < right.node[b], i, j)
                found.append((a.astype(np.int64) * images + b, p, p))
                held += len(p)
                if held > MEETINGS:
                    found = [_together(found)]
                    held = 0
        if not found:
            continue
        pair, p, q = _together(found)
        for x in pair[p != q].tolist():
            a, b = divmod(x, images)
            one, other = (left, a), (right, b)
            if left.node[a] > right.node[b]:
                one, other = other, one
            m, n = int(one[0].node[one[1]]), int(other[0].node[other[1]])
            k, l = find(labels.get(m, m)), find(labels.get(n, n))
            if k != l and linked(one[0].points(one[1]), other[0].points(other[1])):
                root[max(k, l)] = min(k, l)
                yield m, n


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two blocks or in one, from rows sorted by group: packed points of the images of each side, and labels."""

    def links() -> Iterator[pa.RecordBatch]:
        labels, sides = dict(told), [_Block(rows) for rows in (here, there) if rows]
        told.clear(), here.clear(), there.clear()
        if sides and (alone or len(sides) == 2):
            out = list(_links(sides[0], sides[-1], labels))
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    group, alone, told, here, there = None, False, [], [], []
    for batch in batches:
        for g, one, side, node, label, points in zip(*(batch.column(c).to_pylist() for c in ("g", "alone", "side", "node", "label", "points")), strict=True):
            if g != group:
                yield from links()
                group, alone = g, one
            if points is None:
                told.append((node, label))
            else:
                (there if side else here).append((node, points))
    yield from links()


def _rest(points: DataFrame, links: DataFrame) -> DataFrame:
    """Links (a, b) between images of different components, from all pairs of descriptors under a short key."""
    n = max(BLOCKS, points.count() // BLOCK_POINTS + 1)
    packed = points.select("node", "x", "y", "scale", "angle", "d0", "d1", "d2", "d3").mapInArrow(_pack, "node long, points binary")
    rows = packed.select("node", F.lit(None).cast("bigint").alias("label"), "points").unionByName(links.select("node", "label", F.lit(None).cast("binary").alias("points")))
    own = F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    group = (lo * (2 * n + 1 - lo) / 2 + hi - lo).cast("int")  # numbers of the pairs of blocks, without gaps
    dealt = rows.select(group.alias("g"), (F.col("own") == F.col("other")).alias("alone"), (F.col("own") > F.col("other")).alias("side"), "node", "label", "points")
    return dealt.repartitionById(n * (n + 1) // 2, F.col("g")).sortWithinPartitions("g").mapInArrow(_compare, "a long, b long")


def joined(points: DataFrame) -> Written:
    """node and label of the components of images that are copies, from their points."""
    files = few(points.sparkSession)
    # Keys and point numbers alone are shuffled; points of an image have numbers in a row, so a key's smallest point is that
    # of the same image for all keys that some images share. What the points are like is fetched for pairs that met.
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("table"), F.col(f"d{i}").alias("key")) for i in range(TABLES)))).alias("k")
    met = points.select("point", keys).select((F.shiftleft(F.col("k.table").cast("bigint"), 32) + F.col("k.key")).alias("key"), "point")
    first = met.groupBy("key").agg(F.min("point").alias("q"), F.max("point").alias("last")).where("q <> last").drop("last")
    tied = Written(met.join(first, "key").where("point <> q").select(F.col("point").alias("p"), "q").distinct(), "media-tied", files)
    del met, first
    free(points.sparkSession)
    # Words first, places only for pairs within DIFFER: each step's shuffle files go before the next one.
    words = lambda c: points.select(F.col("point").alias(c), F.struct("node", "d0", "d1", "d2", "d3").alias("of_" + c))
    far = sum((F.bit_count(F.col(f"of_p.d{i}").bitwiseXOR(F.col(f"of_q.d{i}"))) for i in range(1, BITS // 32)), F.bit_count(F.col("of_p.d0").bitwiseXOR(F.col("of_q.d0"))))
    close = Written(tied.df.join(words("p"), "p").join(words("q"), "q").where((far <= DIFFER) & (F.col("of_p.node") != F.col("of_q.node"))).select("p", "q"), "media-close", files)
    tied.drop()
    free(points.sparkSession)
    spot = F.struct("node", "x", "y", "scale", "angle")
    one, other = points.select(F.col("point").alias("p"), spot.alias("a")), points.select(F.col("point").alias("q"), spot.alias("b"))
    pairs = close.df.join(one, "p").join(other, "q").select(F.col("a").alias("p"), F.col("b").alias("q"))
    turn, grow = F.col("q.angle") - F.col("p.angle"), F.col("q.scale") / F.col("p.scale")
    pairs = pairs.select(
        F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.pmod(turn, F.lit(2 * math.pi)).alias("turn"), F.log2(grow).alias("grow"),
        (F.col("q.x") - grow * (F.cos(turn) * F.col("p.x") - F.sin(turn) * F.col("p.y"))).alias("dx"), (F.col("q.y") - grow * (F.sin(turn) * F.col("p.x") + F.cos(turn) * F.col("p.y"))).alias("dy"),
        F.struct(F.floor(F.col("p.x") / 2).alias("x"), F.floor(F.col("p.y") / 2).alias("y")).alias("spot"),
    )
    # Bins on two grids, half a bin apart, so that votes near a border meet on one of them. Angles go round.
    grids = F.explode(F.array(F.lit(0.0), F.lit(0.5))).alias("grid")
    around = round(2 * math.pi / ANGLE_BIN)
    cell = [F.pmod(F.floor(F.col("turn") / ANGLE_BIN + F.col("grid")), F.lit(around)), *(F.floor(F.col(c) / s + F.col("grid")) for c, s in (("grow", SCALE_BIN), ("dx", PLACE_BIN), ("dy", PLACE_BIN)))]
    votes = pairs.select("*", grids).groupBy("a", "b", "grid", *(c.alias(f"c{i}") for i, c in enumerate(cell))).agg(F.size(F.collect_set("spot")).alias("votes"))
    links = Written(votes.where(F.col("votes") >= LEAST_VOTES).select("a", "b"), "media-links", files)
    close.drop()
    del one, other, pairs, votes
    free(points.sparkSession)
    parts = components(links.df, "media-first")
    out = components(links.df.union(_rest(points, parts.df)), "media")
    links.drop()
    parts.drop()
    return out


def classes(images: DataFrame) -> DataFrame:
    """image_id, n_keypoints and class_id (the smallest id among copies) of each row of image_id, pixels, height, width."""
    bound_arrow(images.sparkSession)
    files = few(images.sparkSession)
    fits = F.coalesce(F.octet_length("pixels") == F.col("height") * F.col("width"), F.lit(False)) & (F.col("height") > 0)
    rows = images.where("image_id is not null").select(F.col("image_id").cast("bigint").alias("image_id"), "pixels", "height", "width", fits.alias("fits"))
    rows = rows.withColumn("node", F.when(F.col("fits"), F.xxhash64("height", "width", "pixels")).when(F.col("pixels").isNotNull(), F.xxhash64("pixels", F.lit("odd"))))
    ids = Written(rows.select("image_id", "node"), "media-ids", files)
    of_id = ids.df.where("node is not null").groupBy("node", "image_id").agg(F.count("*").alias("held"))
    reps = of_id.groupBy("node").agg(F.min(F.struct("image_id", "held")).alias("r")).select("node", F.col("r.image_id").alias("rep"), F.col("r.held").alias("held"))
    # One image of each class of equal data is described (`held` times, if its row repeats).
    once = rows.where("fits").join(reps.select(F.col("rep").alias("image_id"), F.col("node").alias("n")), "image_id").where("node = n")
    points = Written(once.select("node", "pixels", "height", "width").mapInArrow(_describe, _POINTS).select(F.monotonically_increasing_id().alias("point"), "*"), "media-points", files)

    links = joined(points.df)
    named = links.df.join(reps, "node").groupBy("label").agg(F.min("rep").alias("class_id"))
    of_node = reps.join(links.df.join(named, "label").select("node", "class_id"), "node", "left").select("node", "held", F.coalesce("class_id", "rep").alias("class_id"))
    told = of_node.join(points.df.groupBy("node").agg(F.count("*").alias("n")), "node", "left").withColumn("n_keypoints", F.expr("n div held"))
    return ids.df.join(told, "node", "left").select("image_id", F.coalesce("n_keypoints", F.lit(0)).cast("bigint").alias("n_keypoints"), F.coalesce("class_id", "image_id").alias("class_id"))


def render(vectors: DataFrame, side: int = 64) -> DataFrame:
    """Vectors as images: their values on a square grid, drawn `side` pixels wide. For tables that hold no media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("embedding").to_pylist():
                if not v or any(x is None for x in v):
                    out.append(None)
                    continue
                n = math.isqrt(len(v) - 1) + 1
                a = np.resize(np.asarray(v, float), n * n).reshape(n, n)
                a = resize(np.nan_to_num(a), side, side)
                out.append(np.rint(255 * (a - a.min()) / max(np.ptp(a), 1e-9)).astype(np.uint8).tobytes())
            size = pa.array([side] * len(out), pa.int32())
            yield pa.record_batch([batch.column("vec_id"), pa.array(out, pa.binary()), size, size], ["image_id", "pixels", "height", "width"])

    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(run, "image_id long, pixels binary, height int, width int")


def edited(images: DataFrame, every: int = 100) -> DataFrame:
    """Copies of the images whose id is divisible by `every`, each cropped, turned, scaled, brightened or noisy; their ids are -1 - id.

    A stated set of planted copies with which a query shows what the operator finds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                a = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"]).astype(float)
                n, cut = row["image_id"] // every, max(1, min(a.shape) // 12)
                kinds = (a[cut:, cut:-cut], np.rot90(a), resize(a, round(a.shape[0] * 0.75), round(a.shape[1] * 0.75)), a * 0.8 + 25, a + np.random.default_rng(n).normal(0, 4, a.shape))
                b = np.rint(kinds[n % len(kinds)]).clip(0, 255).astype(np.uint8)
                out.append((-1 - row["image_id"], b.tobytes(), *b.shape))
            columns = zip(*out, strict=True) if out else ((),) * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], ["image_id", "pixels", "height", "width"])

    return images.where((F.col("image_id") % every == 0) & (F.octet_length("pixels") == F.col("height") * F.col("width"))).mapInArrow(run, "image_id long, pixels binary, height int, width int")
