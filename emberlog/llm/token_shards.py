"""Token ids in training order, as fixed-stride binary shards.

Each document becomes token ids, an end mark, and sequences of `seq_len` ids; the last one
is padded. The number of a sequence is made of its document's place in the range of ids, COPIES values of the text's
hash and its part, so rows that share a doc_id, or have none, have numbers of their own as far as their texts differ. A keyed Feistel permutation of all such numbers, with
cycle-walking to stay in range, is the training order: the sequence with the k-th
smallest permuted number has slot k. Nothing is sorted as a whole and no list of the order
exists; permuted numbers are spread evenly, so equal ranges of them are the shards.

A shard is one file of records of one size,

    record = doc_id (int64) | part (uint32) | n_tokens (uint32) | ids (uint16 x seq_len)

in slot order; the manifest has each shard's first slot. Reading is sequential and can
resume at any slot by a seek. A shard is written under a name of its attempt and then renamed; its
content depends on the rows only, so a task that runs again after its executor was lost writes
the same file.

At scale: texts are read twice, for three sums and for their ids, and never shuffled. Ids are
made where the text is read and move once, to their shard, which holds about SHARD_SLOTS
records whatever the corpus or a document's size.

Files go to the folder all executors share, through pyarrow's file systems (local, HDFS, S3).

Cases: null and empty texts give one sequence with the end mark alone. Rows that repeat a
doc_id lie apart, unless their texts are the same too: then they follow each other. Null doc_ids are numbered after
the others and read back as null. An empty table gives no shard. Ids so wide apart that their
numbers pass 62 bits are numbered densely first, which adds a shuffle of the texts.
"""

from __future__ import annotations

import base64
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from emberlog.llm.common import Scratch, mix64, sized

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
SEQ_LEN = 256
SHARD_SLOTS = 16_384
CACHE = 400_000
HEADER = "<qII"
#: Numbers for texts of one doc_id, and of the rows without one.
COPIES = 256
#: What stands for a null doc_id in a record.
NO_DOC = -(2**63)

_WIDE_SPACE = re.compile(r"\s\s")


class Tokenizer:
    """A byte-level BPE over a rank file; remembers the ids of words.

    Without two white-space characters in a row, the pattern always parts a text before a
    space, so its words, each with its space, are encoded each for itself. Other texts are encoded whole.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.begins = np.zeros(max(ranks.values()) + 1, bool)
        self.begins[[i for token, i in ranks.items() if token.startswith(b" ")]] = True

    def _learn(self, words: list[str]) -> bool:
        """Put words, each with the space before it, in the cache: from the one it replaced, or all others encoded at once.

        A space begins a token and is nowhere else in one, so tokens that begin with a space part the words.
        False if that doesn't hold, because a word begins or ends with white space or has two of it in a row.
        """
        if len(self.known) >= CACHE:
            self.older, self.known = self.known, {}
        new = []
        for w in dict.fromkeys(words):
            ids = self.older.get(w)
            if ids is None:
                new.append(w)
            else:
                self.known[w] = ids
        if new:
            text = " " + " ".join(new)
            if text[-1].isspace() or _WIDE_SPACE.search(text):
                return False
            ids = np.array(self.encoding.encode_ordinary(text), "<u2")
            raw, ends = ids.tobytes(), np.flatnonzero(self.begins[ids]).tolist()
            for w, start, end in zip(new, ends, [*ends[1:], len(ids)], strict=True):
                self.known[w] = raw[2 * start : 2 * end]
        return True

    def encode(self, text: str) -> bytes:
        """uint16 ids, as bytes."""
        first, *rest = text.split(" ")
        if not rest or first and first[-1].isspace():
            return np.array(self.encoding.encode_ordinary(text), "<u2").tobytes()
        out = [np.array(self.encoding.encode_ordinary(first), "<u2").tobytes()]
        for at in range(0, len(rest), 4096):  # the cache may change hands in between
            words = rest[at : at + 4096]
            found = list(map(self.known.get, words))
            if None in found:
                if not self._learn([w for w, ids in zip(words, found) if ids is None]):
                    return np.array(self.encoding.encode_ordinary(text), "<u2").tobytes()
                get = self.known.get
                found = [get(w) if ids is None else ids for ids, w in zip(found, words)]
            out += found
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.encoding.decode(np.frombuffer(ids, "<u2").tolist())


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str = RANKS) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


# ---- the order


def _keys(key: int, rounds: int) -> np.ndarray:
    return mix64(np.uint64(key & (2**64 - 1)) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def slots(numbers: np.ndarray, size: int, key: int, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """Keyed bijection of range(size): a Feistel network over the next even power of two,
    applied again to results outside the range until they are inside."""
    x = numbers.astype(np.uint64)
    if size < 2:
        return x.astype(np.int64)
    half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = _keys(key, rounds)
    out = np.empty_like(x)
    left = np.arange(len(x))
    while len(left):
        a, b = x >> half, x & low
        for k in keys[::-1] if inverse else keys:
            if inverse:
                a, b = b ^ (mix64(a ^ k) & low), a
            else:
                a, b = b, a ^ (mix64(b ^ k) & low)
        x = a << half | b
        inside = x < np.uint64(size)
        out[left[inside]] = x[inside]
        left, x = left[~inside], x[~inside]
    return out.astype(np.int64)


# ---- tables and files


def _sequences(
    batches: Iterator[pa.RecordBatch], path: str, seq_len: int, parts: int, size: int, key: int, shards: int
) -> Iterator[pa.RecordBatch]:
    """(number, doc_id, text) rows -> one row for each sequence, with its shard and permuted number."""
    t = tokenizer(path)
    end = np.array([END], "<u2").tobytes()
    stride = 2 * seq_len
    for batch in batches:
        for at in range(0, len(batch), 128):
            part = batch.slice(at, 128)
            number, docs, place, n, ids = [], [], [], [], []
            for base, doc, text in zip(*(c.to_pylist() for c in part.columns)):
                raw = (t.encode(text) if text else b"") + end
                for k in range(-(-len(raw) // stride)):
                    piece = raw[stride * k : stride * (k + 1)]
                    number.append(base * parts + k)
                    docs.append(doc)
                    place.append(k)
                    n.append(len(piece) // 2)
                    ids.append(piece)
            order = slots(np.array(number, np.int64), size, key)
            width = -(-size // shards)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(order // width), pa.array(order), pa.array(docs, pa.int64()),
                    pa.array(place, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                ],
                ["shard", "place", "doc_id", "part", "n_tokens", "ids"],
            )


def _file_system(folder: str):
    """pyarrow's file system for a folder and the path in it."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    return fs.LocalFileSystem(), folder


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def record_size(seq_len: int) -> int:
    return struct.calcsize(HEADER) + 2 * seq_len


def _write(key: tuple, rows: pd.DataFrame, folder: str, seq_len: int) -> pd.DataFrame:
    """Write one shard; return its manifest row."""
    shard = int(key[0])
    rows = rows.sort_values(["place", "ids"], kind="stable")
    pad = np.array([END], "<u2").tobytes()
    raw = b"".join(
        struct.pack(HEADER, NO_DOC if pd.isna(d) else int(d), int(p), int(n)) + i + pad * (seq_len - int(n))
        for d, p, n, i in zip(rows["doc_id"].astype("Int64"), rows["part"], rows["n_tokens"], rows["ids"])
    )
    system, path = _file_system(folder)
    system.create_dir(path, recursive=True)
    own = posixpath.join(path, f".{shard_name(shard)}.{uuid.uuid4().hex}")
    with system.open_output_stream(own) as out:
        out.write(raw)
    system.move(own, posixpath.join(path, shard_name(shard)))
    return pd.DataFrame({"shard": [shard], "records": [len(rows)], "bytes": [len(raw)], "crc32": [zlib.crc32(raw)]})


def _parsed(batches: Iterator[pa.RecordBatch], seq_len: int, from_slot: int) -> Iterator[pa.RecordBatch]:
    """(shard, first_slot, content) rows -> records."""
    kind = np.dtype([("doc", "<i8"), ("part", "<u4"), ("n", "<u4"), ("ids", "<u2", (seq_len,))])
    for batch in batches:
        for shard, first, raw in zip(*(c.to_pylist() for c in batch.columns)):
            rows = np.frombuffer(raw, kind)
            skip = max(0, from_slot - first)
            for lo in range(skip, len(rows), 1024):
                r = rows[lo : lo + 1024]
                n = r["n"].astype(np.int64)
                inside = np.arange(seq_len)[None] < n[:, None]
                offsets = np.r_[0, np.cumsum(n)].astype(np.int32)
                doc = r["doc"].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(first + np.arange(lo, lo + len(r))), pa.array(np.full(len(r), shard)),
                        pa.array(doc, mask=doc == NO_DOC), pa.array(r["part"].astype(np.int64)), pa.array(n),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(r["ids"][inside].astype(np.int32))),
                    ],
                    ["slot", "shard", "doc_id", "part", "n_tokens", "ids"],
                )


_RECORD = "slot long, shard long, doc_id long, part long, n_tokens long, ids array<int>"


class Shards:
    """Written shards: their folder, geometry and manifest (shard, first_slot, records, bytes, crc32)."""

    def __init__(self, folder: str, manifest: DataFrame, seq_len: int):
        self.folder, self.manifest, self.seq_len = folder, manifest, seq_len

    def read(self, from_slot: int = 0) -> DataFrame:
        """(slot, shard, doc_id, part, n_tokens, ids) of all slots from `from_slot` on.

        Shards that end before it are not opened.
        """
        spark, seq_len = self.manifest.sparkSession, self.seq_len
        wanted = self.manifest.where(F.col("first_slot") + F.col("records") > from_slot).select("shard", "first_slot")
        if not wanted.limit(1).count():
            return spark.createDataFrame([], _RECORD)
        files = (
            spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(self.folder)
            .select(F.regexp_extract("path", r"shard-(\d+)\.bin", 1).cast("long").alias("shard"), "content")
        )
        return (
            files.join(sized(wanted, wanted.count()), "shard").select("shard", "first_slot", "content")
            .mapInArrow(lambda it: _parsed(it, seq_len, from_slot), _RECORD)
        )


def write_shards(
    docs: DataFrame,
    folder: str | None = None,
    key: int = 20240229,
    seq_len: int = SEQ_LEN,
    shard_slots: int = SHARD_SLOTS,
    path: str = RANKS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Shards:
    """Tokenise, order and write all documents; the folder is under the shared one by default."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    folder = folder or scratch.folder("files")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    octets = F.coalesce(F.octet_length("text"), F.lit(0))
    lowest, highest, longest, likely = texts.agg(
        F.min("doc_id"), F.max("doc_id"), F.max(octets), F.sum(octets / (2 * seq_len) + 1)
    ).first()
    if likely is None:
        empty = spark.createDataFrame([], "shard long, first_slot long, records long, bytes long, crc32 long")
        return Shards(folder, empty, seq_len)
    parts = longest // seq_len + 1  # a token has at least one byte, and the end mark is one more
    lowest, highest = (0, 0) if lowest is None else (lowest, highest)
    if (highest - lowest + 2) * parts * COPIES < 2**62:
        based = texts.select((F.coalesce("doc_id", F.lit(highest + 1)) - F.lit(lowest)).alias("base"), "doc_id", "text")
        ids = highest - lowest + 2
    else:
        based, ids = _numbered(texts, scratch)
    copy = F.pmod(F.xxhash64("text"), F.lit(COPIES))
    based = based.select((F.col("base") * COPIES + copy).alias("base"), "doc_id", "text")
    size = ids * COPIES * parts
    shards = max(1, -(-int(likely) // shard_slots))
    written = scratch.put(
        based.mapInArrow(
            lambda it: _sequences(it, path, seq_len, parts, size, key, shards),
            "shard long, place long, doc_id long, part long, n_tokens long, ids binary",
        )
        .groupBy("shard").applyInPandas(
            lambda k, rows: _write(k, rows, folder, seq_len), "shard long, records long, bytes long, crc32 long"
        ),
        "written",
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    first = F.coalesce(F.sum("records").over(before), F.lit(0)).alias("first_slot")
    manifest = scratch.put(written.select("shard", first, "records", "bytes", "crc32"), "manifest")
    return Shards(folder, manifest, seq_len)


def _numbered(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """texts with dense numbers of their ids as `base`, and how many there are."""
    ids = scratch.put(texts.select("doc_id").distinct(), "ids")
    n = ids.count()
    buckets = n // 2000 + 1
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")
    ranked = ids.select("doc_id", bucket).withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id")))
    ranked = scratch.put(ranked, "ranked")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranked.groupBy("bucket").agg(F.count("*").alias("k")).select(
        "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start")
    )
    numbers = ranked.join(starts, "bucket").select("doc_id", (F.col("start") + F.col("r") - 1).alias("base"))
    both = texts.join(numbers.withColumnRenamed("doc_id", "k"), F.col("doc_id").eqNullSafe(F.col("k")))
    return both.select("base", "doc_id", "text"), n
