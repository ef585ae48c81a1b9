"""A training corpus from raw documents: quality, near copies, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and all rows its predecessor kept, and works on them alone. A row is told by its doc_id and
its text (nulls included), so rows that share one of the two are never mixed up; rows that share both share their fate. All
columns of the documents stay, whatever their names, until the last stage. Nulls and empty texts pass every stage but the
near-copy one, where they are copies of each other. An empty table passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import bpe, classifier, decontam, suffix_dedup
from claimloom.llm import near_copies as near
from claimloom.llm.common import inner_name, shared_folder, table


def _is_row(docs: DataFrame, c: str) -> Column:
    """Whether a row of docs is the one that columns c + k (key) and c + t (text hash) tell."""
    return docs["doc_id"].eqNullSafe(F.col(f"{c}k")) & (F.xxhash64(docs["text"]) == F.col(f"{c}t"))


def _told(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, str]:
    """found's doc_id and text_id, distinct, under names that docs does not have."""
    c = inner_name(docs)
    return found.select(F.col("doc_id").alias(f"{c}k"), F.col("text_id").alias(f"{c}t")).distinct(), c


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps."""
    gone, c = _told(docs, classifier.judge(docs, table(spark, sf_dir, "labels")).where("not kept"))
    return docs.join(gone, _is_row(docs, c), "left_anti")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of least doc_id, of those the one of least text hash. Documents link at a five-word shingle similarity of 0.8 or more."""
    groups = near.near_copies(docs)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("text_id").alias("text_id")).withColumnRenamed("component_id", "doc_id")
    stays, c = _told(docs, first)
    return docs.join(stays, _is_row(docs, c), "left_semi")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without byte strings that stand in an earlier one; n_chars follows the text, where there is such a column.

    Characters of which a byte is cut go whole. A row's other columns go through the operator with it, so nothing is joined back.
    Null texts stay null. doc_id is an integer; rows of one doc_id do not cut each other.
    """
    c, others = inner_name(docs), [n for n in docs.columns if n != "text"]
    rows = docs.select(F.col("doc_id").alias(f"{c}k"), F.col("text").alias(f"{c}t"), F.struct(*others, F.when(F.col("text").isNull(), True).alias(f"{c}null")).alias(f"{c}row"))
    out = suffix_dedup.remove_repeats(rows, f"{c}k", f"{c}t", keep=(f"{c}row",), characters=True)
    text = F.when(F.col(f"{c}row.{c}null").isNull(), F.col("kept").cast("string"))
    plain = {n: F.col(f"{c}row")[n] for n in others} | {"text": text}
    if "n_chars" in plain:
        plain["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text).cast(dict(docs.dtypes)["n_chars"])).otherwise(plain["n_chars"])
    return out.select(*[plain[n].alias(n) for n in docs.columns])


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document left."""
    return bpe.digests(bpe.encode_decode(docs, bpe.tokenizer_spec()))


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_copies), ("suffix-array dedup", repeats), ("benchmark decontamination", leaks), ("BPE encoding and decoding", tokens)]


def _drop(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder and read again; a stage's copy goes once the next is written."""
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{i}")
        docs = spark.read.parquet(f"{place}/{i}")
        if i:
            _drop(spark, f"{place}/{i - 1}")
    return docs


#: SimHash, suffix arrays and merges are beyond SQL: run() is tested against a brute-force version of all stages.
ORACLE_SQL = None
