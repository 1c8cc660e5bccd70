"""The corpus pipeline: quality, exact and near duplicates, secrets, packing.

Each stage takes the documents its predecessor kept and returns documents again;
the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import exact_dedup, packing, quality_sites, secret_scan, simhash
from ledgerlens.llm.common import chosen, materialize, table


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row that stays when it is read again, and the number's column: rows stay or go by it, as ids may repeat.

    A row of files is numbered by its file and its place there; other rows are written with numbers of their own.
    """
    key = "row_key"
    while key in docs.columns:
        key += "_"
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(key), F.col("_metadata.row_index").alias(f"{key}_at"))
    except AnalysisException:  # no files
        return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-rows"), key
    # a row for each file: the numbers of files, which are few beside rows
    files = placed.select(key).distinct().withColumn("file", F.row_number().over(Window.orderBy(key)).cast("long") - 1)
    files = materialize(files.select(key, F.col("file").alias(f"{key}_file")), "pipeline-files")
    number = F.shiftleft(F.col(f"{key}_file"), 36) + F.col(f"{key}_at")
    return placed.join(files, key).select(*[F.col(f"`{c}`") for c in docs.columns], number.alias(key)), key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are rated like an empty text, null sources and languages as a site of
    their own, repeated rows one by one; an empty table stays empty; other columns pass through,
    whatever their names.
    """
    own = {c: f"{c} of the document" for c in docs.columns if c in quality_sites.RESULTS}
    rated = quality_sites.rated(docs.withColumnsRenamed(own), table(spark, sf_dir, "labels"))
    return rated.where("kept").select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal normalised text the one with the smallest (id, key) stays; null texts count as empty, null ids come first."""
    rows, key = keyed(docs)
    gone = materialize(exact_dedup.repeated(rows, key).withColumnRenamed("row_id", key), "pipeline-gone")
    return chosen(rows, gone, key, "left_anti").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates - five-word shingles, similarity 0.8 or more - the row with the smallest (id, key) stays.

    Texts without words, null ones among them, are duplicates of one another; null ids come first.
    """
    rows, key = keyed(docs)
    gone = simhash.groups(rows, width=5, similarity=0.8, key_col=key).where("not kept").select(F.col("row_key").alias(key))
    return chosen(rows, materialize(gone, "pipeline-gone"), key, "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by their kind, and its length is counted anew; null texts stay null."""
    found = secret_scan.redact(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else found


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens with their places in sequences; a null text is its end id alone."""
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, max_tokens=1024)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]

#: Fitted weights and tokenizers can't be put in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
