"""Reversible line dedup: exact reference counts behind sharded cuckoo filters.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased;
only keys of at least `min_chars` code points count. The exact table has one row for each
key with the number of documents that hold it and the largest such document. A key held by
`min_docs` documents loses its lines everywhere but in that largest document.

The keys that have reached `min_docs` also stand in cuckoo filters, one for each shard of
about SHARD_KEYS keys. Probing a filter is native integer and substring work next to the
lines, so lines that repeat nowhere are never shuffled for the exact check, which
follows for every line that passes. The filters are broadcast while their measured size
is at most FILTER_BYTES; beyond, the probe is a shuffle join on the shard.

The exact check never gathers a frequent line: see `join_frequent`.

Increments: `LineIndex.insert` and `LineIndex.delete` append. Occurrences are a list of written
tables and a list of deletions, each with its version; counts are a list of written tables, of which the
newest row of a key holds. Only the keys that a change touches are counted anew; a cuckoo filter can forget a
key, so only the shards of keys that cross the threshold are rewritten. After COMPACT changes the
lists are written as one table.

Keys are compared as 128-bit digests. A frequent line costs one partial count per task.

Cases: a null or empty text is one empty line and loses nothing. Rows that repeat a doc_id
count as one document, and each of them loses the same keys. Rows without a doc_id lose
nothing and count nowhere. A document that is inserted again adds to what the index holds of it. Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from emberlog.llm.common import SPACES, Scratch, join_frequent, sized

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 800
FILTER_BYTES = 32_000_000
#: Changes until the tables of an index are written as one.
COMPACT = 8

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ID, _MARK, _DROPS, _LINES = (f"__line_dedup_{x}" for x in ("id", "mark", "drops", "lines"))


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; supports insertion and deletion.

    A key comes as a signed 64-bit hash. Its fingerprint is the low 16 bits (0 counts as
    1), its first bucket the bits above, its second the first xor a multiple of the fingerprint.
    """

    SLOTS, KICKS, STEP = 4, 500, 40503

    def __init__(self, buckets: int, data: bytes | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, self.SLOTS), ">u2") if data is None else np.frombuffer(
            data, ">u2"
        ).reshape(buckets, self.SLOTS).copy()

    @classmethod
    def build(cls, hashes) -> CuckooFilter:
        buckets = 1
        while buckets * cls.SLOTS * 0.85 < len(hashes):
            buckets *= 2
        while True:
            made = cls(buckets)
            if all(made.insert(int(h)) for h in hashes):
                return made
            buckets *= 2

    def _places(self, h: int) -> tuple[int, int, int]:
        print_ = (h & 0xFFFF) or 1
        first = (h >> 16) & (self.buckets - 1)
        return print_, first, self._other(first, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return bucket ^ ((print_ * self.STEP >> 3) & (self.buckets - 1))

    def insert(self, h: int) -> bool:
        print_, first, second = self._places(h)
        for bucket in (first, second):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return True
        bucket = second
        for turn in range(self.KICKS):
            slot = turn % self.SLOTS
            print_, self.table[bucket, slot] = int(self.table[bucket, slot]), print_
            bucket = self._other(bucket, print_)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return True
        return False

    def delete(self, h: int) -> bool:
        print_, first, second = self._places(h)
        for bucket in (first, second):
            held = np.flatnonzero(self.table[bucket] == print_)
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False

    def __contains__(self, h: int) -> bool:
        print_, first, second = self._places(h)
        return bool((self.table[first] == print_).any() or (self.table[second] == print_).any())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()


def _probe(h: Column, buckets: Column, slots: Column) -> Column:
    """CuckooFilter.__contains__ as a native expression."""
    low = h.bitwiseAND(0xFFFF)
    print_ = F.when(low == 0, F.lit(1).cast("long")).otherwise(low)
    last = (buckets - 1).cast("long")
    first = F.shiftright(h, 16).bitwiseAND(last)
    second = first.bitwiseXOR(F.shiftright(print_ * CuckooFilter.STEP, 3).bitwiseAND(last))
    want = F.lpad(F.hex(print_), 4, "0")

    def held(bucket: Column) -> Column:
        found = F.hex(F.substring(slots, (bucket * 8 + 1).cast("int"), F.lit(8)))
        return (
            (F.substring(found, 1, 4) == want) | (F.substring(found, 5, 4) == want)
            | (F.substring(found, 9, 4) == want) | (F.substring(found, 13, 4) == want)
        )

    return held(first) | held(second)


def _key(line: Column, min_chars: int) -> Column:
    """Digest of a line's key; null if the key is short."""
    bare = F.trim(line, F.lit(SPACES))
    return F.when(F.length(bare) >= min_chars, F.unhex(F.md5(F.translate(bare, _UPPER, _UPPER.lower()))))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _mark(text: Column) -> Column:
    """Tells the rows of one doc_id apart."""
    return F.xxhash64(text)


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(key, h, doc_id, mark, line): the long lines of the documents; mark tells a row's text, line is its place."""
    keys = F.transform(_lines(F.col(text_col)), lambda x, i: F.struct(i.alias("line"), _key(x, min_chars).alias("key")))
    long = F.filter(keys, lambda k: k["key"].isNotNull())
    whole = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), _mark(F.col(text_col)).alias("mark"), long.alias("long")
    )
    # Apart, so the mark is taken once for each text; outer, so no inferred filter builds the array twice.
    rows = whole.select("doc_id", "mark", F.explode_outer("long").alias("k")).where("k is not null")
    return rows.select("k.key", F.xxhash64("k.key").alias("h"), "doc_id", "mark", "k.line")


def count_keys(held: DataFrame) -> DataFrame:
    """(key, h, n_docs, max_doc) of occurrences that may repeat."""
    return held.groupBy("key", "h").agg(
        F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc")
    )


_FILTER = "shard long, n_shards long, buckets int, slots binary"


def _shard(h: Column, n_shards: Column) -> Column:
    return F.pmod(F.shiftright(h, 32), n_shards)


def build_filters(hashes: DataFrame, n_shards: int) -> DataFrame:
    """One cuckoo filter for each shard of the table (h)."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.build(group["h"].sort_values().tolist())
        return pd.DataFrame(
            {"shard": [group["shard"].iloc[0]], "n_shards": [n_shards], "buckets": [made.buckets], "slots": [made.to_bytes()]}
        )

    return (
        hashes.select("h", _shard(F.col("h"), F.lit(n_shards)).alias("shard"))
        .groupBy("shard").applyInPandas(build, _FILTER)
    )


def _passing(held: DataFrame, filters: DataFrame, n_shards: int, filter_bytes: int) -> DataFrame:
    """The occurrences whose key the filters may hold."""
    side = F.broadcast(filters) if filter_bytes <= FILTER_BYTES else filters
    return (
        held.withColumn("shard", _shard(F.col("h"), F.lit(n_shards)))
        .join(side.drop("n_shards"), "shard")
        .where(_probe(F.col("h"), F.col("buckets"), F.col("slots")))
        .drop("shard", "buckets", "slots")
    )


@dataclass
class LineIndex:
    """Occurrences, exact counts and filters of a set of documents; all are tables."""

    scratch: Scratch
    #: Written occurrences, and deleted documents (doc_id), each with the version that added them.
    added: list[tuple[int, DataFrame]]
    gone: list[tuple[int, DataFrame]]
    #: Written counts; a key's row of the highest version holds.
    counted: list[tuple[int, DataFrame]]
    filters: DataFrame
    n_shards: int
    n_held: int
    id_col: str = "doc_id"
    text_col: str = "text"
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS
    version: int = field(default=0)

    @classmethod
    def build(
        cls,
        docs: DataFrame,
        min_chars: int = MIN_CHARS,
        min_docs: int = MIN_DOCS,
        id_col: str = "doc_id",
        text_col: str = "text",
    ) -> LineIndex:
        scratch = Scratch(docs.sparkSession, "lines")
        held = scratch.put(occurrences(docs, id_col, text_col, min_chars), "held")
        counts = scratch.put(count_keys(held), "counts")
        repeated = counts.where(F.col("n_docs") >= min_docs)
        n_shards = repeated.count() // SHARD_KEYS + 1
        filters = scratch.put(build_filters(repeated.select("h"), n_shards), "filters")
        return cls(scratch, [(0, held)], [], [(0, counts)], filters, n_shards, held.count(), id_col, text_col, min_chars, min_docs)

    @property
    def held(self) -> DataFrame:
        """(key, h, doc_id, mark, line) of the documents that are not deleted."""
        found = None
        for version, table in self.added:
            for later, ids in self.gone:
                if later > version:
                    table = table.join(ids, "doc_id", "left_anti")
            table = table.select("key", "h", "doc_id", "mark", "line")
            found = table if found is None else found.unionByName(table)
        return found

    @property
    def counts(self) -> DataFrame:
        """(key, h, n_docs, max_doc) of all keys."""
        if len(self.counted) == 1:
            return self.counted[0][1]
        found = None
        for version, table in self.counted:
            table = table.withColumn("version", F.lit(version))
            found = table if found is None else found.unionByName(table)
        newest = F.max_by(F.struct("n_docs", "max_doc"), "version").alias("c")
        return found.groupBy("key", "h").agg(newest).select("key", "h", "c.n_docs", "c.max_doc").where("n_docs > 0")

    def _changed(self, added: list, gone: list, keys: DataFrame, n_held: int) -> LineIndex:
        """The index with these occurrences, which differ from the present ones in the keys of `keys` only."""
        keys = self.scratch.put(keys.distinct(), "keys")
        version = self.version + 1
        new = LineIndex(
            self.scratch, added, gone, self.counted, self.filters, self.n_shards, n_held,
            self.id_col, self.text_col, self.min_chars, self.min_docs, version,
        )
        live = count_keys(new.held.join(keys, "key", "left_semi"))
        none = F.lit(0).cast("long")
        anew = self.scratch.put(
            keys.select("key", F.xxhash64("key").alias("h")).join(live.drop("h"), "key", "left")
            .select("key", "h", F.coalesce("n_docs", none).alias("n_docs"), "max_doc"),
            "counts",
        )
        over = F.col("n_docs") >= self.min_docs
        before = self.counts.where(over).join(keys, "key", "left_semi").select("key", "h", F.lit(-1).alias("step"))
        after = anew.where(over).select("key", "h", F.lit(1).alias("step"))
        steps = (
            before.union(after).groupBy("key", "h").agg(F.sum("step").alias("step")).where("step <> 0")
            .select(_shard(F.col("h"), F.lit(self.n_shards)).alias("shard"), "h", "step")
        )
        n_shards = self.n_shards

        def update(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            add = new["h"][new["step"] > 0].tolist()
            if len(old) and len(new):
                made = CuckooFilter(int(old["buckets"].iloc[0]), old["slots"].iloc[0])
                for h in new["h"][new["step"] < 0]:
                    made.delete(int(h))
                full = not all(made.insert(int(h)) for h in add)
            elif len(old):
                return old[["shard", "n_shards", "buckets", "slots"]]
            else:
                made, full = CuckooFilter.build(add), False
            return pd.DataFrame(
                {"shard": [key[0]], "n_shards": [n_shards], "buckets": [-1 if full else made.buckets], "slots": [made.to_bytes()]}
            )

        new.filters = self.scratch.put(
            self.filters.groupBy("shard").cogroup(steps.groupBy("shard")).applyInPandas(update, _FILTER), "filters"
        )
        new.counted = [*self.counted, (version, anew)]
        if new.filters.where("buckets < 0").limit(1).count():  # a shard is full: all are dealt anew
            repeated = new.counts.where(over)
            new.n_shards = repeated.count() // SHARD_KEYS + 1
            new.filters = self.scratch.put(build_filters(repeated.select("h"), new.n_shards), "filters")
        if len(new.counted) > COMPACT:
            held, counts = self.scratch.put(new.held, "held"), self.scratch.put(new.counts, "counts")
            new.added, new.gone, new.counted = [(version, held)], [], [(version, counts)]
        return new

    def insert(self, docs: DataFrame) -> LineIndex:
        new = self.scratch.put(occurrences(docs, self.id_col, self.text_col, self.min_chars), "new")
        return self._changed([*self.added, (self.version + 1, new)], self.gone, new.select("key"), self.n_held + new.count())

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents of the one-column table `ids`."""
        ids = self.scratch.put(ids.toDF("doc_id").distinct(), "ids")
        keys = self.held.join(ids, "doc_id", "left_semi").select("key")
        return self._changed(self.added, [*self.gone, (self.version + 1, ids)], keys, self.n_held)

    def drops(self) -> DataFrame:
        """(doc_id, mark, line, key): the lines that each document loses."""
        size = self.filters.agg(F.sum(F.length("slots"))).first()[0] or 0
        exact = self.counts.where(F.col("n_docs") >= self.min_docs).select("key", "n_docs", "max_doc")
        passing = _passing(self.held, self.filters, self.n_shards, size)
        return (
            join_frequent(passing.select("key", "doc_id", "mark", "line"), exact, ["key"], self.n_held, "n_docs")
            .where("doc_id <> max_doc").select("doc_id", "mark", "line", "key")
        )

    def _split(self, docs: DataFrame) -> DataFrame:
        """docs with a column _LINES: the text's lines and those that stay."""
        drops = self.scratch.put(self.drops().select("doc_id", "mark", "line").distinct(), "drops")
        per = drops.groupBy(F.col("doc_id").alias(_ID), F.col("mark").alias(_MARK)).agg(F.sort_array(F.collect_list("line")).alias(_DROPS))
        on = (docs[self.id_col].cast("long") == F.col(_ID)) & (_mark(docs[self.text_col]) == F.col(_MARK))
        out = docs.join(sized(per, drops.count(), 40), on, "left")
        lines = _lines(F.col(self.text_col))

        def left(every: Column) -> Column:
            """The runs of lines between dropped ones, so the work is linear in the text."""
            ends = F.concat(F.array(F.lit(-1)), F.col(_DROPS), F.array(F.size(every)))
            runs = F.zip_with(
                F.slice(ends, F.lit(1), F.size(ends) - 1), F.slice(ends, F.lit(2), F.size(ends) - 1),
                lambda a, b: F.slice(every, a + 2, b - a - 1),
            )
            return F.flatten(runs)

        # A lambda's argument is taken once; in a lambda, `lines` itself would split the text for each run.
        kept = F.when(F.col(_DROPS).isNull(), lines).otherwise(F.get(F.transform(F.array(lines), left), F.lit(0)))
        return out.withColumn(
            _LINES, F.struct(F.size(lines).cast("long").alias("n"), kept.alias("kept"))
        ).drop(_ID, _MARK, _DROPS)

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with the text column reduced to the lines that stay."""
        text = F.array_join(F.col(f"{_LINES}.kept"), "\n")
        return self._split(docs).withColumn(self.text_col, text).drop(_LINES)

    def report(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_lines, n_dropped, text) for every row of `docs`."""
        lines = F.col(_LINES)
        return self._split(docs.select(self.id_col, self.text_col)).select(
            F.col(self.id_col).alias("doc_id"),
            lines["n"].alias("n_lines"),
            (lines["n"] - F.size(lines["kept"])).alias("n_dropped"),
            F.array_join(lines["kept"], "\n").alias("text"),
        )


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs without repeated long lines; same columns."""
    return LineIndex.build(docs, **options).apply(docs)


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for the digest of LineIndex.report."""
    edge = r"[\x20\x09-\x0D]+"
    upper, lower = f"'{_UPPER}'", f"'{_UPPER.lower()}'"
    return f"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {table}
),
x AS (
  SELECT doc_id, i, line,
    translate(regexp_replace(regexp_replace(line, '^{edge}', ''), '{edge}$', ''), {upper}, {lower}) AS key
  FROM (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM l)
),
r AS (
  SELECT key, max(doc_id) AS max_doc FROM x WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
),
k AS (
  SELECT x.doc_id, x.i, x.line, (r.key IS NOT NULL AND r.max_doc <> x.doc_id) AS gone
  FROM x LEFT JOIN r ON r.key = x.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
