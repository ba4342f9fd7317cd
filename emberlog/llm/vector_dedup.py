"""Near-duplicate vectors by an inverted multi-index with multi-sequence traversal.

Vectors are normalised and cut in two halves; each half has its own codebook of K centroids,
so K * K cells come from two small codebooks. A vector lies in the cell of its two nearest
centroids. It probes cells in the order of the sum of both squared distances (the
multi-sequence order) until the target recall, and what lies in a probed cell is compared
with it by cosine in double precision.

Fitted on a bounded sample (those of the smallest keyed hash), applied to every vector:

* the codebooks, by k-means on at most SAMPLE vectors or 64 for each centroid;
* the number of probes: sample vectors get a partner at exactly the threshold in a random
  direction, the hardest place for a link. Either end of a link finds it, so the probes are the cells
  that reach TARGET of the links from the nearer end; their number has no cap.

K grows with the square root of the rows, so a cell keeps about CELL_ROWS of them at every size.
Vectors with all components equal are one class, which goes through the index once. Cells of one left
centroid are one group: a vector goes once to each group that it probes, with the list of its cells there. A crowded group
is cut into blocks of at most BLOCK stored vectors, and the probing ones pass by as a stream. A batch returns
counts and local components, never pairs: at most one row for each of its vectors.

Cases: null, empty or zero vectors and those with null or non-finite components link with
nothing, as do rows without a vec_id, which have no component and are kept. Vectors of different lengths don't link; a length that few
vectors have is one cell. A vector is a distinct pair of vec_id and components: n_links counts the others linked with a
row's vector. Rows that repeat a vec_id with other components are vectors of their own and one component. Other
columns, labels too, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.common import Scratch, join_frequent, sized
from emberlog.llm.components import connected_components

SAMPLE = 16_384
CELL_ROWS = 200
TARGET = 0.99
#: Vectors of one length without an index.
FEW = 2048
BLOCK = 16_384
#: Comparisons that are held at a time.
HELD = 4_000_000


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.concatenate([_square_distances(x[at : at + 4096], centres).argmin(axis=1) for at in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[order], np.arange(k))
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        total[n > 0] = np.add.reduceat(x[order], starts[n > 0], axis=0)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _square_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]


def _rank(cells: np.ndarray, home: np.ndarray) -> np.ndarray:
    """The place of a home among each row's cells; their number if it isn't among them."""
    same = cells == home[:, None]
    return np.where(same.any(axis=1), same.argmax(axis=1), cells.shape[1])


class MultiIndex:
    """Two codebooks, the probes that reach the target recall, and the recall on the sample's partners."""

    def __init__(self, left: np.ndarray, right: np.ndarray, probes: int = 1):
        self.left, self.right, self.probes, self.recall = left, right, probes, 0.0

    @classmethod
    def fit(cls, sample: np.ndarray, n: int, threshold: float, target: float = TARGET, seed: int = 5) -> MultiIndex:
        rng = np.random.default_rng(seed)
        u = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        half = u.shape[1] // 2
        k = max(2, min(len(u), math.ceil(math.sqrt(n / CELL_ROWS))))
        index = cls(_kmeans(u[:, :half], k, rng), _kmeans(u[:, half:], k, rng))
        v = u[rng.choice(len(u), min(len(u), 2048), replace=False)]
        away = rng.standard_normal(v.shape)
        away -= (away * v).sum(1, keepdims=True) * v
        norm = np.linalg.norm(away, axis=1, keepdims=True)
        away = np.divide(away, norm, out=np.zeros_like(away), where=norm > 0)
        partner = threshold * v + math.sqrt(max(0.0, 1 - threshold * threshold)) * away
        limit = 64
        while True:
            index.probes = min(limit, k * k)
            one, two = index.cells(v), index.cells(partner)
            either = np.minimum(_rank(one, two[:, 0]), _rank(two, one[:, 0]))
            most = int(np.quantile(either, target, method="higher"))
            if most < index.probes or limit >= k * k:
                break
            limit *= 4
        index.probes = min(most, k * k - 1) + 1
        index.recall = float((either < index.probes).mean())
        return index

    def cells(self, u: np.ndarray) -> np.ndarray:
        """(n, probes) cells of unit vectors, nearest first.

        The cell at place t of the order pairs the a-th and b-th nearest centroids of the two
        halves with (a + 1)(b + 1) <= t + 1, because every pair of nearer ones comes before it.
        """
        half, k = len(self.left[0]), len(self.left)
        places = [(a, b) for a in range(min(k, self.probes)) for b in range(min(k, self.probes // (a + 1)))]
        a, b = np.array([p[0] for p in places]), np.array([p[1] for p in places])
        most = min(k, self.probes)
        near = []
        for x, centres in ((u[:, :half], self.left), (u[:, half:], self.right)):
            d = _square_distances(x, centres)
            order = np.argsort(d, axis=1, kind="stable")[:, :most]
            near.append((order, np.take_along_axis(d, order, axis=1)))
        (lo, ld), (ro, rd) = near
        first = np.argsort(ld[:, a] + rd[:, b], axis=1, kind="stable")[:, : self.probes]
        return (np.take_along_axis(lo[:, a], first, 1) * k + np.take_along_axis(ro[:, b], first, 1)).astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), -1).astype(np.float64)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, v, f1, f2): the components as bytes, null if they can't link, and their digests."""
    for batch in batches:
        vectors = []
        for v in batch.column(1):
            x = None
            if v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype("<f4") + np.float32(0)  # one zero
                x = x if np.isfinite(x).all() and x.any() else None
            vectors.append(None if x is None else x.tobytes())
        codes = np.array([(0, 0) if v is None else (xxhash.xxh64_intdigest(v, 1), xxhash.xxh3_64_intdigest(v, 2)) for v in vectors], np.uint64)
        codes = codes.reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(vectors, pa.binary()), pa.array(codes[:, 0]), pa.array(codes[:, 1])], ["vec_id", "v", "f1", "f2"]
        )


_PROBED = "cid long, size long, v binary, home long, groups array<long>, cells array<array<long>>"


def _probed(batches: Iterator[pa.RecordBatch], indexes: dict[int, MultiIndex], first: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Each vector with its home cell and its cells by group. Cells are numbered over all lengths."""
    for batch in batches:
        lengths = np.array([len(v.as_buffer()) for v in batch.column(2)], np.int64)
        for width in np.unique(lengths).tolist():
            part = batch.filter(pa.array(lengths == width))
            for at in range(0, len(part), 1024):
                rows = part.slice(at, 1024)
                if width in indexes:
                    index = indexes[width]
                    x, k = _units(_matrix(rows.column(2))), len(index.left)
                    x = np.repeat(x, 2, axis=1) if x.shape[1] < 2 else x
                    cells = index.cells(x) + first[width]
                    groups, lists = [], []
                    for row in cells.tolist():
                        of: dict[int, list[int]] = {}
                        for c in row:
                            of.setdefault((c - first[width]) // k * k + first[width], []).append(c)
                        groups.append(list(of))
                        lists.append(list(of.values()))
                    home = cells[:, 0]
                else:  # one cell for all of a length
                    home = np.full(len(rows), -width)
                    groups, lists = [[-width]] * len(rows), [[[-width]]] * len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), rows.column(1), rows.column(2), pa.array(home),
                        pa.array(groups, pa.list_(pa.int64())), pa.array(lists, pa.list_(pa.list_(pa.int64()))),
                    ],
                    ["cid", "size", "v", "home", "groups", "cells"],
                )


def link_block(
    q_ids: np.ndarray, q: np.ndarray, q_home: np.ndarray, s_ids: np.ndarray, s: np.ndarray, s_cells: np.ndarray, threshold: float,
    q_size: np.ndarray | None = None, s_size: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between probing and stored vectors: (ids, counts, local component labels).

    A link counts for its stored end only if that end doesn't probe the other's cell, where
    it would count again. It counts as often as the other end's class has vectors.
    """
    linked = (q @ s.T >= threshold) & (q_ids[:, None] != s_ids[None])
    qi, si = np.nonzero(linked)
    again = np.zeros(len(qi), bool)
    for at in range(0, len(qi), 65_536):
        part = slice(at, at + 65_536)
        again[part] = (s_cells[si[part]] == q_home[qi[part], None]).any(axis=1)
    q_n = np.bincount(qi, None if s_size is None else s_size[si], len(q_ids)).astype(np.int64)
    s_n = np.bincount(si[~again], None if q_size is None else q_size[qi[~again]], len(s_ids)).astype(np.int64)
    most = np.iinfo(np.int64).max
    ql, sl = q_ids.copy(), s_ids.copy()
    while len(qi):
        new_q = np.minimum(ql, np.where(linked, sl[None], most).min(axis=1))
        new_s = np.minimum(sl, np.where(linked, new_q[:, None], most).min(axis=0))
        if (new_q == ql).all() and (new_s == sl).all():
            break
        ql, sl = new_q, new_s
    ids, n, labels = np.r_[q_ids, s_ids], np.r_[q_n, s_n], np.r_[ql, sl]
    keep = (n > 0) | (ids != labels)
    return ids[keep], n[keep], labels[keep]


class _Group:
    """The stored vectors of a block, by cell; probing ones are compared batch by batch."""

    def __init__(self, rows: list[pa.RecordBatch], threshold: float):
        table = pa.Table.from_batches(rows)
        home = table.column("home").to_numpy()
        order = np.argsort(home, kind="stable")
        self.threshold, self.home = threshold, home[order]
        self.ids, self.size = (table.column(c).to_numpy()[order] for c in ("cid", "size"))
        self.x = _units(_matrix(table.column("v").combine_chunks()))[order]
        cells = table.column("all").to_pylist()
        self.cells = np.full((len(cells), max(map(len, cells))), np.iinfo(np.int64).min)
        for row, k in enumerate(order.tolist()):
            self.cells[row, : len(cells[k])] = cells[k]

    def probe(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(batch.schema.get_field_index("mine"))
        cell = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
        x = _units(_matrix(batch.column(batch.schema.get_field_index("v"))))
        ids, size, home = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("cid", "size", "home"))
        order = np.argsort(cell, kind="stable")
        cell, row = cell[order], row[order]
        starts = np.r_[0, np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell)]
        for at, end in zip(starts[:-1], starts[1:]):
            lo, hi = np.searchsorted(self.home, [cell[at], cell[at] + 1])
            step = max(1, HELD // max(1, min(hi - lo, BLOCK)))
            for s in range(lo, hi, BLOCK):
                stored = slice(s, min(s + BLOCK, hi))
                for k in range(at, end, step):
                    own = row[k : min(k + step, end)]
                    got = link_block(
                        ids[own], x[own], home[own], self.ids[stored], self.x[stored], self.cells[stored], self.threshold, size[own], self.size[stored]
                    )
                    if len(got[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(g) for g in got], ["cid", "n", "label"])


_KEYS = ("g", "s", "q")


def _linked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by _KEYS, in each block the stored ones first; one block of those is held."""
    held: list[pa.RecordBatch] = []
    group: _Group | None = None
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
        starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
        for at, end in zip(starts[:-1], starts[1:]):
            now, probing = tuple(keys[at, :3]), keys[at, 3]
            if now != last:
                held, group, last = [], None, now
            part = batch.slice(at, end - at)
            if not probing:
                held.append(part)
            elif held or group:
                if group is None:
                    group, held = _Group(held, threshold), []
                yield from group.probe(part)


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors`."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("e"))
    coded = source.mapInArrow(_coded, "vec_id long, v binary, f1 long, f2 long")
    of = ["f1", "f2"]
    narrow = scratch.put(coded.select("vec_id", *of, F.coalesce(F.length("v"), F.lit(0)).alias("width")), "narrow")
    rows = narrow.count()
    linkable = narrow.where("width > 0 and vec_id is not null").select("vec_id", *of, "width").distinct()
    classes = linkable.groupBy(*of, "width").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes = scratch.put(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = _links(coded, classes, threshold, scratch)

    label = classes.select(F.col("cid").alias("label"), F.col("rep").alias("b"))
    ends = found.where("cid <> label").join(label, "label").join(classes.select("cid", F.col("rep").alias("a")), "cid").select("a", "b")
    # Classes that share a vec_id are linked by it.
    shared = linkable.groupBy("vec_id").agg(F.count("*").alias("k")).where("k > 1").select("vec_id")
    same = linkable.join(shared, "vec_id").join(classes.select(*of, "rep"), of).select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    comps = connected_components(ends.union(same), scratch).toDF("rep", "c")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    done = classes.join(counts, "cid", "left").join(comps, "rep", "left").select(
        *of, "size", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"), F.coalesce("c", "rep").alias("component_id")
    )
    done = scratch.put(done, "classed")
    linked = join_frequent(narrow.where("width > 0 and vec_id is not null").select("vec_id", *of), done, of, rows, "size")
    linked = linked.select("vec_id", "n_links", "component_id")
    rest = narrow.where("width = 0 or vec_id is null").select("vec_id")
    other = scratch.put(linked.join(rest, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("component_id").alias("own")), "other")
    rest = rest.join(sized(other, other.count()), "vec_id", "left").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("own", "vec_id").alias("component_id")
    )
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def fitted(vectors: DataFrame, classes: DataFrame, threshold: float) -> dict[int, MultiIndex]:
    """An index for every length (in bytes) that more than FEW classes have."""
    out = {}
    for width, n in classes.groupBy("width").count().where(F.col("count") > FEW).orderBy("width").collect():
        size = max(SAMPLE, 64 * math.ceil(math.sqrt(n / CELL_ROWS)))
        share = F.lit(int(min(1.0, 1.2 * size / n) * 1_000_000) + 1)
        part = vectors.where((F.length("v") == width) & (F.pmod(F.xxhash64("f1", "f2"), F.lit(1_000_000)) < share))
        chosen = part.orderBy(F.xxhash64("f1", "f2", F.lit(1)), "f1", "f2").limit(size).select("v")
        sample = np.stack([np.frombuffer(r[0], "<f4").astype(np.float64) for r in chosen.collect()])
        sample = sample / np.abs(sample).max(axis=1, keepdims=True)
        if sample.shape[1] < 2:
            sample = np.repeat(sample, 2, axis=1)  # a vector of one component has no halves
        out[width] = MultiIndex.fit(sample, n, threshold)
    return out


def _links(coded: DataFrame, classes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(cid, n, label) from all blocks."""
    key = ["vec_id", "f1", "f2"]
    reps = classes.select(F.col("rep").alias("vec_id"), "f1", "f2", "cid", "size")
    vectors = coded.where("v is not null").join(reps, key).dropDuplicates(key).select("cid", "size", "v", "f1", "f2")
    vectors = scratch.put(vectors, "vectors")
    indexes = fitted(vectors, classes, threshold)
    first, n = {}, 0
    for width, index in indexes.items():
        first[width], n = n, n + len(index.left) ** 2
    probed = vectors.select("cid", "size", "v").mapInArrow(lambda it: _probed(it, indexes, first), _PROBED)
    probed = scratch.put(probed, "probed")
    own = F.filter(F.arrays_zip("groups", "cells"), lambda z: F.array_contains(z["cells"], F.col("home")))[0]["groups"]
    none = F.array().cast("array<long>")
    stored = probed.select(own.alias("g"), "cid", "size", "v", "home", F.flatten("cells").alias("all"), none.alias("mine"))
    probing = probed.select(F.explode(F.arrays_zip("groups", "cells")).alias("z"), "cid", "size", "v", "home").select(
        F.col("z.groups").alias("g"), "cid", "size", "v", "home", none.alias("all"), F.col("z.cells").alias("mine")
    )
    blocks = lambda df, name, most: df.groupBy("g").agg((F.floor((F.count("*") - 1) / most) + 1).cast("long").alias(name))
    shape = scratch.put(blocks(stored.select("g"), "sb", BLOCK).join(blocks(probing.select("g"), "qb", 16 * BLOCK), "g"), "shape")
    shape = sized(shape, shape.count())
    block = lambda col: F.pmod(F.xxhash64("cid", F.lit(1)), F.col(col))
    every = lambda col: F.explode(F.sequence(F.lit(0).cast("long"), F.col(col) - 1))
    s = stored.join(shape, "g").withColumn("s", block("sb")).withColumn("q", every("qb")).withColumn("probing", F.lit(0).cast("long"))
    q = probing.join(shape, "g").withColumn("q", block("qb")).withColumn("s", every("sb")).withColumn("probing", F.lit(1).cast("long"))
    columns = [*_KEYS, "probing", "cid", "size", "v", "home", "all", "mine"]
    both = s.select(*columns).union(q.select(*columns)).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "probing")
    return scratch.put(both.mapInArrow(lambda it: _linked(it, threshold), "cid long, n long, label long"), "found")
