"""A training-data pipeline over ``documents``: each stage's rows are written as Parquet and read by the next.

Counted with gradelake/llm, whose operators it applies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.decontamination import without_documents
from gradelake.llm.jaccard import similar
from gradelake.llm.line_dedup import cleaned
from gradelake.llm.packing import pack, public_vocabulary
from gradelake.llm.quality_rules import quality_rules
from gradelake.llm.shared import staged
from gradelake.llm.simhash import near_duplicates

#: Ids of documents to leave out that are sent to all executors at most; beyond, the documents are shuffled.
MOST_SENT = 500_000


def _rows(docs: DataFrame) -> DataFrame:
    """Each document as one struct beside its id and text, so that no column of its own can meet one of an operator."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns.

    Null and empty texts have no words and go. Repeated rows stay or go together; an empty table gives no rows.
    """
    return quality_rules(_rows(docs), out="quality").where("quality.kept").select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated three-line passages; documents that lose all their lines go. n_chars, if there, follows the text.

    Null texts stay null. The first place of a passage is that of the smallest id, then text hash, then line,
    nulls first; repeated rows lose the same lines. Other columns stay as they are; an empty table gives no rows.
    """
    kinds = {f.name: f.dataType for f in docs.schema}
    own = {"text": F.col("text").cast(kinds["text"])}
    if "n_chars" in kinds:
        own["n_chars"] = F.when(F.col("removed") > 0, F.length("text").cast(kinds["n_chars"])).otherwise(F.col("row.n_chars"))
    out = cleaned(docs, drop_emptied=True)
    return out.select(*(own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, five words at similarity 0.8: the one with the smallest id (then text hash).

    Groups of the fingerprints and min-wise keys propose the pairs, and both are checked by the whole sets of shingles.
    Wordless and null texts are one group. Of rows that repeat id and text one stays; a null id counts as the
    smallest. Other columns stay as they are; an empty table gives no rows.
    """
    rows = _rows(docs).withColumn("t", F.xxhash64("text"))
    named = rows.select(F.struct("doc_id", "t").alias("doc_id"), "text")
    alike = staged(near_duplicates(named).select(F.col("doc_id.t").alias("t"), F.xxhash64("component_id").alias("h")).distinct(), "alike")
    groups = staged(similar(named, proposed=alike), "groups")
    gone = groups.where("not (doc_id <=> component_id)").select("doc_id").distinct()
    gone = staged(gone.select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.t").alias("h")), "gone")
    if gone.count() <= MOST_SENT:
        gone = F.broadcast(gone)
    out = rows.join(gone, rows["doc_id"].eqNullSafe(gone["id"]) & (rows["t"] == gone["h"]), "left_anti")
    # Rows that repeat id and text are one group of equal rows; only where there are any, rows are shuffled for them.
    again = groups.where("doc_id <=> component_id").groupBy("doc_id").count().where("count > 1")
    return (out if again.isEmpty() else out.dropDuplicates(["doc_id", "text"])).select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than a twentieth stand in windows of the benchmark.

    Null and empty texts have no words and stay. Repeated rows stay or go together; an empty table gives no rows.
    """
    return without_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in sequences of 1024 tokens, and nothing else of their columns.

    Null and empty texts are one token; repeated rows and null ids are packed like any other; an empty table gives no rows.
    """
    return pack(docs, public_vocabulary(), with_ids=False)


STAGES = [
    ("quality rules", by_quality),
    ("line dedup", without_repeated_lines),
    ("near-dedup by min-wise hashing", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: Fingerprint groups and tokenizer ids have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
