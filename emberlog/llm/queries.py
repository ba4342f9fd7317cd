"""The queries opN_<name> over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.llm import html_extract, line_dedup, minhash, mixing, pii, quality, spm, token_shards, toxicity, vector_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as shards in training order, and read back: one row for each slot."""
    return token_shards.write_shards(_table(spark, sf_dir, "documents")).read()


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 3-word shingles, Jaccard of 85 percent."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, threshold=85)


#: The mixture's tree as SQL that Spark and DuckDB share: three domains of sources.
MIX_LEVELS = {
    "domain": "CASE WHEN md5(source) < '5' THEN 'd0' WHEN md5(source) < 'a' THEN 'd1' ELSE 'd2' END",
    "lang": "lang",
    "source": "source",
}
MIX = {"fraction": (6, 10), "max_epochs": 3, "seed": 17}
#: Target weights by path; other nodes have weight 1.
MIX_WEIGHTS = {"d0": 5, "d1": 3, "d2": 2}
MIX_WEIGHTS |= {f"{domain}/{lang}": weight for domain in ("d0", "d1", "d2") for lang, weight in (("en", 6), ("de", 3), ("fr", 2))}
MIX_WEIGHTS |= {"d1/en/src1": 4, "d2/en/src7": 3, "d0/en/src5": 0}


def mix_weights(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{path}', {weight}L)" for path, weight in MIX_WEIGHTS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(path, weight)")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 percent of all tokens, dealt by MIX_WEIGHTS over domains, languages and sources."""
    levels = {name: F.expr(text) for name, text in MIX_LEVELS.items()}
    return mixing.select(_table(spark, sf_dir, "documents"), levels, weights=mix_weights(spark), **MIX)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents in the 32k vocabulary, and whether they decode to the text."""
    return spm.encode(_table(spark, sf_dir, "documents"))


def op6_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all vectors linked by a cosine of 0.95."""
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that repeat in five or more, but for the last document's."""
    docs = _table(spark, sf_dir, "documents")
    return line_dedup.LineIndex.build(docs).report(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data; the values themselves don't leave."""
    done = pii.pseudonymise_distinct(_table(spark, sf_dir, "documents"))
    bare = F.transform("entities", lambda e: F.struct(e["start"], e["end"], e["type"], e["surrogate"]))
    return done.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), bare.alias("entities"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of all documents under the full policy."""
    return quality.apply_policy(quality.build_ledger(_table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labelled ones outside the held-out fold."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), spans=False)


QUERIES = {
    "op1_token_shards": op1_token_shards,
    "op2_html_extraction": op2_html_extraction,
    "op3_minhash_neardup": op3_minhash_neardup,
    "op4_source_mixing": op4_source_mixing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_embedding_neardup": op6_embedding_neardup,
    "op7_line_dedup": op7_line_dedup,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op4_source_mixing": mixing.oracle(MIX_LEVELS, weights=MIX_WEIGHTS, **MIX),
    "op7_line_dedup": line_dedup.oracle(),
    "op9_quality_rules": quality.oracle(),
}
