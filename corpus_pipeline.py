"""A corpus pipeline of five stages over the operators of ``wavepanel.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and hands it to the next stage.  All
but the last return the columns that they were given, less or more rows, or
shorter texts:

1. quality rules drop the documents that the rules or the score reject;
2. line dedup removes repeated chunks of lines from the texts;
3. near-dedup keeps one document of each group (five-word shingles, 0.8);
4. mixing repeats or cuts sources to their weights within the corpus's budget;
5. BPE encodes every text and decodes it again: the rows to train on.

Null texts count as empty ones (the first stage drops them); repeated rows, extra
columns and empty tables pass as each operator states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavepanel.llm import bpe, line_dedup, mixing, near_dedup, quality
from wavepanel.llm.common import checked_broadcast, materialise
from wavepanel.llm.queries import trusted


def _columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    judged = quality.quality_rules(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")), trusted(spark, sf_dir))
    return judged.where("kept").select("_row.*")


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeated chunks of lines; a text may become empty."""
    rest = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"))
    cut = line_dedup.line_dedup(rest).select("text", "_row.*")
    return _columns(cut, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of the smallest doc_id (null after all others), then of the smallest MD5 of its text.

    Texts without shingles belong to no group; of such rows only repeats of the whole row go.
    """
    columns = ["doc_id", "text_key", "root", "kept"]
    judged = materialise(near_dedup.judged(docs).select(*columns), "pipeline-near")
    kept = judged.where("kept")
    # texts of one group that share the doc_id kept, or all lack one
    tied = kept.where("root is not null").groupBy("root").agg(F.min("text_key").alias("least"), F.max("text_key").alias("most")).where("least != most")
    tied = checked_broadcast(materialise(tied.select("root", "least"), "pipeline-tied"))
    gone = judged.where("not kept").unionByName(kept.join(tied, "root").where("text_key != least").select(*columns))
    gone = checked_broadcast(materialise(gone.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "pipeline-gone"))
    twice = kept.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.count("*").alias("n"), F.max("root").alias("root")).where("n > 1")
    twice = materialise(twice.select("_id", "_key", F.col("root").isNotNull().alias("_group")), "pipeline-twice")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key"))
    keyed = docs.select("doc_id", near_dedup.text_key(F.col("text")).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = keyed.join(gone, same, "left_anti")
    once = rows.join(checked_broadcast(twice.select("_id", "_key")), same, "left_anti").select("_row.*")
    grouped = rows.join(checked_broadcast(twice.where("_group").select("_id", "_key")), same, "left_semi")
    # rows of one doc_id and text: the least of their other columns, whatever order they come in
    grouped = grouped.groupBy("doc_id", "_text").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")
    bare = rows.join(checked_broadcast(twice.where("not _group").select("_id", "_key")), same, "left_semi").select("_row.*").dropDuplicates()
    return once.unionByName(grouped).unionByName(bare)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each pass of the mixture over them."""
    rest = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"))
    return _columns(mixing.mix(rest).select("text", "_row.*"), docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids (little-endian 32-bit), n_tokens, decoded of every row."""
    spec = bpe.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    out = bpe.round_trip(texts, spec)
    return out.select("doc_id", "source", "ids", F.expr("octet_length(ids) div 4").alias("n_tokens"), "decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_chunks),
    ("near_dedup", near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe", bpe_encode),
]

#: MinHash, the score's hashes and BPE have no form in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
