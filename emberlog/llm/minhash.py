"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard checks.

A document's set holds its distinct word shingles, each as a 64-bit hash. Two keyed
permutations of the 32-bit ring give the whole signature: the first scatters an element,
the second, shifted circularly by k, gives coordinate k, so no K-fold family of
permutations is needed. Coordinates are grouped into bands; documents that share a band
are candidates, and a candidate becomes a link only after the full sets were compared.

Cost and completeness:

* Documents with equal sets are one class, formed by a grouped aggregate, and only one text of a class
  goes on. In the link graph a class is the vertex of its smallest doc_id. A third of the corpus in one class costs one partial
  aggregate per task, and its documents learn their component without meeting in a task. Links found later
  join the components found before, which aren't labelled anew.
* Within a band's bucket, members are compared with one hub, which is linear. Only what is
  still in different components is compared further: large buckets with a second hub,
  then every remaining pair of different components that can be a link by
  its counts. Members of large buckets also carry SKETCH one-bit coordinates of the same
  permutations. They are compared in blocks; a large component has blocks of its own, and two of them never
  meet, so a bucket of one large component and a few outsiders costs rows in proportion to its members. Only
  pairs that differ in no more bits than a link does (6.5 standard deviations) become rows, so groups of loosely
  similar documents never do. A pair that shares several bands is formed in the first only. Nothing is capped. For any
  pair at the threshold, sharing no band has probability (1 - t^4)^32, under 1e-7 for
  t = 0.8 and 1e-10 for t = 0.85.
* Before sets are moved, the number of equal signature coordinates must reach its mean at
  the threshold less 6.5 standard deviations, which a true link fails with a
  probability of about 1e-10.

Shingles are compared as 64-bit hashes; sets are one class if 128 bits of digest and their sizes agree.

Cases: null, empty and blank texts have the empty set and link with nothing. A
text with fewer words than a shingle is one shingle as a whole. Rows that repeat a doc_id
are one vertex, which has the links of all of its texts; each row has the size of its own set. Rows
without a doc_id link with nothing, have no component and are kept. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.common import Scratch, join_frequent, list_array, mix64, sized
from emberlog.llm.components import connected_components, merge_components

BANDS = 32
ROWS = 4
K = BANDS * ROWS
SLICE = 2048
#: Buckets with more members get new hubs before pairs are formed.
LARGE_BUCKET = 16
HUB_ROUNDS = 1
#: One-bit coordinates of members of large buckets.
SKETCH = 4096
#: Members of a large bucket that are compared with as many at a time.
BLOCK = 512

_SCATTER = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    if n < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), 7)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n)
    acc = h[: n - size + 1] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, size):
        acc = mix64(acc) + h[k : n - size + 1 + k]
    return np.unique(mix64(acc))


def _scatter(values: np.ndarray) -> np.ndarray:
    """The first permutation, of the ring of 32-bit integers."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    x = (x ^ (x >> np.uint32(15))) * _SCATTER[0]
    x = (x ^ (x >> np.uint32(13))) * _SCATTER[1]
    return x ^ (x >> np.uint32(16))


def _ring(x: np.ndarray) -> np.ndarray:
    """The second permutation, in place."""
    t = x >> np.uint32(16)
    x ^= t
    x *= np.uint32(0x7FEB352D)
    np.right_shift(x, np.uint32(15), out=t)
    x ^= t
    x *= np.uint32(0x846CA68B)
    np.right_shift(x, np.uint32(16), out=t)
    x ^= t
    return x


def signatures(sets: list[np.ndarray], k: int = K) -> np.ndarray:
    """(number of sets, k) uint32 signatures of non-empty sets.

    Memory is K x SLICE at a time, whatever k and the length of a set.
    """
    out = np.full((len(sets), k), 0xFFFFFFFF, np.uint32)
    shifts = np.arange(k, dtype=np.uint32)[:, None]
    if not sets:
        return out
    flat = _scatter(np.concatenate(sets))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    width = SLICE * K // k
    for at in range(0, len(flat), width):
        part, own = flat[at : at + width], owner[at : at + width]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        low = np.minimum.reduceat(_ring(part[None, :] - shifts), starts, axis=1)
        rows = own[starts]
        out[rows] = np.minimum(out[rows], low.T)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(number of sets, BANDS) int64 keys; the band's number is part of the key."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2])
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return key.view(np.int64)


def can_link_others(threshold: int, most: int = 100_000) -> int:
    """Smallest set size that can link with a different set at threshold percent."""
    for n in range(1, most):
        if 100 * n >= threshold * (n + 1):
            return n
    return most


def _signed(batches: Iterator[pa.RecordBatch], size: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at in range(0, len(ids), 256):
            sets = [shingle_set(t, size) for t in texts[at : at + 256].to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            big = [i for i, s in enumerate(sets) if len(s) >= least]
            sig = signatures([sets[i] for i in big])
            keys = np.zeros(len(sets), np.int64)
            keys[big] = BANDS
            eight = [None] * len(sets)
            for row, i in enumerate(big):
                eight[i] = (sig[row] & np.uint32(255)).astype(np.uint8).tobytes()
            raw = [s.tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    ids[at : at + 256].cast(pa.int64()),
                    pa.array(n),
                    pa.array(np.array([xxhash.xxh64_intdigest(r, 1) for r in raw], np.uint64).view(np.int64)),
                    pa.array(np.array([xxhash.xxh3_64_intdigest(r, 2) for r in raw], np.uint64).view(np.int64)),
                    list_array(band_keys(sig).ravel() if big else np.empty(0, np.int64), keys, pa.int64()),
                    pa.array(eight, pa.binary()),
                ],
                ["doc_id", "n", "f1", "f2", "bands", "sig"],
            )


def _agreeing(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose signatures agree in at least `least` coordinates."""
    for batch in batches:
        x, y = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, K) for c in (2, 3)
        )
        keep = pa.array((x == y).sum(axis=1) >= least)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)


def digests(raw: bytes) -> tuple[int, int]:
    """Two signed 64-bit digests of a set's bytes."""
    two = np.array([xxhash.xxh64_intdigest(raw, 1), xxhash.xxh3_64_intdigest(raw, 2)], np.uint64)
    return tuple(two.view(np.int64).tolist())


def _wanted_sets(batch: pa.RecordBatch, size: int) -> tuple[list[pa.Array], list[np.ndarray]]:
    """(doc, rep) and the sets of (doc, rep, text, f1, f2) rows whose text is the one meant: a doc_id can have several."""
    sets = [shingle_set(t, size) for t in batch.column(2).to_pylist()]
    keep = [
        digests(s.tobytes()) == f for s, f in zip(sets, zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()))
    ]
    return [batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], [s for s, k in zip(sets, keep) if k]


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            ids, sets = _wanted_sets(batch.slice(at, 256), size)
            yield pa.RecordBatch.from_arrays([*ids, pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "rep", "s"])


def _sketched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The lowest bits of SKETCH coordinates, 64 to an integer."""
    for batch in batches:
        for at in range(0, len(batch), 64):
            (docs, _), sets = _wanted_sets(batch.slice(at, 64), size)
            bits = (signatures(sets, SKETCH) & np.uint32(1)).astype(np.uint8)
            longs = np.packbits(bits, axis=1).view("<i8")
            yield pa.RecordBatch.from_arrays(
                [docs, list_array(longs.ravel(), [SKETCH // 64] * len(sets), pa.int64())], ["doc", "sketch"]
            )


def sketch_limit(threshold: int) -> int:
    """Bits in which a link at the threshold may differ: the mean and 6.5 standard deviations."""
    differ = (100 - threshold) / 200
    return math.ceil(SKETCH * differ + 6.5 * math.sqrt(SKETCH * differ * (1 - differ)))


def _block_pairs(key: int, rows: pa.Table, threshold: int) -> pa.RecordBatch:
    right, doc, c, n = (rows.column(x).to_numpy() for x in ("right", "doc", "c", "n"))
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    raw = rows.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, SKETCH // 64)
    signs = np.unpackbits(raw.view(np.uint8), axis=1).astype(np.float32) * 2 - 1
    one, two = np.flatnonzero(~right), np.flatnonzero(right)
    within = not len(two)  # a block with itself
    if within:
        two = one
    apart = (SKETCH - signs[one] @ signs[two].T) / 2
    nl, nr = n[one][:, None], n[two][None]
    possible = (apart <= sketch_limit(threshold)) & (100 * np.minimum(nl, nr) >= threshold * np.maximum(nl, nr))
    cl, cr = c[one][:, None], c[two][None]
    possible &= cl < cr if within else cl != cr
    x, y = np.nonzero(possible)
    x, y = one[x], two[y]
    shared = bands[x] == bands[y]
    here = bands[x, shared.argmax(axis=1)] == key  # of several shared bands, the first forms the pair
    x, y = doc[x[here]], doc[y[here]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


_BLOCK_KEY = ("key", "gi", "bi", "gj", "bj")


def _close_pairs(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Pairs of large buckets that sketches and counts allow to be links.

    Rows come sorted by _BLOCK_KEY; one pair of blocks is held at a time.
    """
    held: list[pa.RecordBatch] = []
    last: tuple[int, ...] | None = None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(x).to_numpy() for x in _BLOCK_KEY], axis=1)
        starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
        for at, end in zip(starts[:-1], starts[1:]):
            now = tuple(map(int, keys[at]))
            if held and now != last:
                yield _block_pairs(last[0], pa.Table.from_batches(held), threshold)
                held = []
            last = now
            held.append(batch.slice(at, end - at))
    if held:
        yield _block_pairs(last[0], pa.Table.from_batches(held), threshold)


def block_rows(members: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """The rows (key, gi, bi, gj, bj, right, doc) of every pair of blocks to compare.

    members: (key, doc, c), doc of component c in bucket `key`. A component of more than half a
    block has blocks (g = c, b); the others of a bucket share blocks with g = -1. Blocks of one
    component don't meet.
    """
    per = members.groupBy("key", "c").agg(F.count("*").alias("m")).withColumn("g", F.when(F.col("m") > block // 2, F.col("c")).otherwise(-1))
    per = scratch.put(per, "per")
    wide = per.groupBy("key", "g").agg((F.floor((F.sum("m") - 1) / block) + 1).cast("long").alias("nb"))
    wide = scratch.put(wide, "wide")
    placed = members.join(per.select("key", "c", "g"), ["key", "c"]).join(wide, ["key", "g"])
    placed = scratch.put(placed.select("key", "g", F.pmod(F.xxhash64("doc"), F.col("nb")).alias("b"), "doc"), "placed")
    blocks = wide.select("key", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("b"))
    one, two = blocks.toDF("key", "gi", "bi"), blocks.toDF("key", "gj", "bj")
    pairs = one.join(two, "key").where("struct(gi, bi) <= struct(gj, bj) and (gi <> gj or gi = -1)")
    pairs = scratch.put(pairs, "pairs")
    left = pairs.withColumns({"g": F.col("gi"), "b": F.col("bi"), "right": F.lit(False)})
    right = pairs.where("gi <> gj or bi <> bj").withColumns({"g": F.col("gj"), "b": F.col("bj"), "right": F.lit(True)})
    return placed.join(left.union(right), ["key", "g", "b"]).select(*_BLOCK_KEY, "right", "doc")


def _similar(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """The exact check: 100 * intersection >= threshold * union, on full sets."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([a, b])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= threshold * (len(both) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(
            pa.array(keep, pa.bool_())
        )


def near_duplicates(
    docs: DataFrame,
    shingle: int = 3,
    threshold: int = 85,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Return (doc_id, n_shingles, component_id, kept) for every row of `docs`.

    `threshold` is in percent. component_id is the smallest doc_id reachable by links.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    least = can_link_others(threshold)
    signed = scratch.put(
        texts.mapInArrow(
            lambda it: _signed(it, shingle, least),
            "doc_id long, n long, f1 long, f2 long, bands array<long>, sig binary",
        ),
        "signed",
    )
    rows = signed.count()
    of = ["f1", "f2", "n"]
    linkable = signed.where("n > 0 and doc_id is not null")
    classes = linkable.groupBy(*of).agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    classes = scratch.put(classes.withColumn("doc", F.monotonically_increasing_id()), "classes")
    reps = (
        linkable.where(F.size("bands") > 0)
        .join(classes.select(F.col("rep").alias("doc_id"), *of, "doc"), ["doc_id", *of])
        .dropDuplicates(["doc_id", *of]).select("doc", F.col("doc_id").alias("rep"), "n", "bands", "sig")
    )
    reps = scratch.put(reps, "reps")
    members = reps.select(F.explode("bands").alias("key"), "doc", "rep")
    hubs = scratch.put(
        members.groupBy("key").agg(F.min("doc").alias("hub"), F.count("*").alias("size")).where("size > 1"),
        "hubs",
    )
    shared = scratch.put(members.join(hubs, "key"), "shared")

    mean, spread = K * threshold / 100, math.sqrt(K * threshold * (100 - threshold)) / 100
    agree = math.floor(mean - 6.5 * spread)
    side = reps.select("doc", "n", "sig")

    def wanted(needed: DataFrame) -> DataFrame:
        """(doc, rep, text, f1, f2) of the classes of the one-column table `needed`; a text that isn't meant may come along."""
        found = scratch.put(classes.join(needed.toDF("doc"), "doc", "left_semi").select(F.col("rep").alias("doc_id"), "doc", "f1", "f2"), "wanted")
        return texts.join(sized(found, found.count(), 48), "doc_id").select("doc", "doc_id", "text", "f1", "f2")

    def confirm(pairs: DataFrame) -> DataFrame:
        """The vertices of the pairs (a, b) of classes that are links, by signature first and then by full sets."""
        near = (
            pairs.distinct()
            .join(side.toDF("a", "na", "sa"), "a")
            .join(side.toDF("b", "nb", "sb"), "b")
            .where(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
            .select("a", "b", "sa", "sb")
        )
        return compared(near.mapInArrow(lambda it: _agreeing(it, agree), "a long, b long"))

    def compared(pairs: DataFrame) -> DataFrame:
        """The vertices of the pairs of classes that are links, by their full sets."""
        near = scratch.put(pairs.distinct(), "near")
        sets = scratch.put(
            wanted(near.select("a").union(near.select("b")).distinct())
            .mapInArrow(lambda it: _sets(it, shingle), "doc long, rep long, s binary"),
            "sets",
        )
        full = near.join(sets.toDF("a", "ra", "x"), "a").join(sets.toDF("b", "rb", "y"), "b")
        links = scratch.put(
            full.select("ra", "rb", "x", "y").mapInArrow(lambda it: _similar(it, threshold), "a long, b long"),
            "found",
        )
        scratch.drop(sets, near)
        return links

    links = confirm(shared.where("doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")))
    comps = connected_components(links, scratch)
    for turn in range(HUB_ROUNDS + 1):
        placed = scratch.put(
            shared.join(comps.toDF("rep", "c"), "rep", "left").select(
                "key", "hub", "size", "doc", F.coalesce("c", "rep").alias("c")
            ),
            "placed",
        )
        split = scratch.put(
            placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key"),
            "split",
        )
        left = scratch.put(placed.join(split, "key"), "left")
        crowded = left.where(F.col("size") > LARGE_BUCKET)
        if turn == HUB_ROUNDS or not crowded.limit(1).count():
            break
        per = scratch.put(
            crowded.groupBy("key", "c").agg(
                F.count("*").alias("m"), F.min(F.struct(F.xxhash64("doc", F.lit(turn)), "doc")).alias("d")
            ),
            "per",
        )
        star = scratch.put(
            per.groupBy("key").agg(F.max(F.struct("m", "d", "c")).alias("t"))
            .select("key", F.col("t.d.doc").alias("b"), F.col("t.c").alias("bc")),
            "star",
        )
        more = left.join(star, "key").where("c <> bc").select(F.col("doc").alias("a"), "b")
        comps = merge_components(comps, confirm(more), scratch)
    # What no hub has joined: every pair of different components that shares a band and
    # which counts and sketches allow to be a link.
    small = left.where((F.col("doc") != F.col("hub")) & (F.col("size") <= LARGE_BUCKET)).select("key", "doc", "c")
    small = scratch.put(small.join(reps.select("doc", "n"), "doc"), "small")
    one, two = (small.select("key", *(F.col(x).alias(f"{x}{k}") for x in ("doc", "c", "n"))) for k in (1, 2))
    counts = 100 * F.least("n1", "n2") >= threshold * F.greatest("n1", "n2")
    pairs = one.join(two, (one["key"] == two["key"]) & (F.col("c1") < F.col("c2")) & counts)
    links = confirm(pairs.select(F.col("doc1").alias("a"), F.col("doc2").alias("b")))
    large = left.where((F.col("doc") != F.col("hub")) & (F.col("size") > LARGE_BUCKET)).select("key", "doc", "c")
    if large.limit(1).count():
        sketches = scratch.put(
            wanted(large.select("doc").distinct()).mapInArrow(lambda it: _sketched(it, shingle), "doc long, sketch array<long>")
            .join(reps.select("doc", "n", "bands"), "doc"),
            "sketches",
        )
        wide = block_rows(large, scratch, BLOCK).join(large.select("doc", "c").distinct(), "doc").join(sketches, "doc")
        close = wide.repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY).select(
            *_BLOCK_KEY, "right", "doc", "c", "n", "bands", "sketch"
        )
        links = links.union(compared(close.mapInArrow(lambda it: _close_pairs(it, threshold), "a long, b long")))

    # Classes that share a doc_id are linked by it.
    held = linkable.groupBy("doc_id").agg(F.min(F.struct(*of)).alias("lo"), F.max(F.struct(*of)).alias("hi")).where("lo <> hi")
    held = scratch.put(held.select("doc_id"), "held")
    if held.limit(1).count():
        mine = linkable.join(held, "doc_id").select("doc_id", *of).distinct().join(classes.select(*of, "rep"), of)
        links = links.union(mine.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    comps = merge_components(comps, links, scratch).toDF("rep", "c")
    found = classes.join(comps, "rep", "left").select(*of, "size", F.coalesce("c", "rep").alias("component_id"))
    found = scratch.put(found, "classed")
    narrow = signed.select("doc_id", *of)
    done = join_frequent(narrow.where("n > 0 and doc_id is not null"), found, of, rows, "size").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id"
    )
    rest = narrow.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"))
    other = scratch.put(done.join(rest, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("own")), "other")
    rest = rest.join(sized(other, other.count()), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("own", "doc_id").alias("component_id")
    )
    return done.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
