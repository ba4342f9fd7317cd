"""The corpus pipeline: quality rules, line dedup, near-dedup, source mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; `run` writes each stage's rows as Parquet in the folder all executors share and
reads them again as the next one's documents. All stages but the last return the
columns of `documents`.

Part of the llm subpackage: it goes with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog import session
from emberlog.llm import line_dedup, minhash, mixing, quality, spm
from emberlog.llm.common import Scratch, scratch_closed, sized
from emberlog.llm.queries import MIX_LEVELS

#: The mixture's size and seed; its tree is that of op4.
MIX_FRACTION = (8, 10)
MIX_SEED = 17

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the full policy rejects."""
    session.ship(spark)
    return quality.keep_good(docs, "full-1")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without long lines that five or more share; n_chars follows the text."""
    session.ship(spark)
    done = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 5-word shingles, similarity of 0.8."""
    session.ship(spark)
    classes = minhash.near_duplicates(docs, shingle=5, threshold=80)
    gone = classes.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    gone = Scratch(spark, "gone").put(gone, "gone")
    return docs.join(sized(gone, gone.count()), docs["doc_id"] == F.col("__gone"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that an even mixture of 80 percent of the tokens takes."""
    session.ship(spark)
    levels = {name: F.expr(text) for name, text in MIX_LEVELS.items()}
    return mixing.keep_selected(docs, levels, seed=MIX_SEED, fraction=MIX_FRACTION)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document: doc_id, n_tokens, ids, round_trip."""
    session.ship(spark)
    return spm.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", token_ids),
]

#: MinHash near-dedup and SentencePiece ids are not expressible in SQL; the tests compare run()
#: with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch_closed():
            docs = scratch.put(stage(spark, docs, sf_dir), name.split()[0])
    return docs
