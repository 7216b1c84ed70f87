"""Exact de-duplication: 128-bit content hash, one id kept, bytes compared inside each hash group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table, text_or_empty


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept and the SHA-256 of the text.

    Rows are grouped by MD5 *and* by the text itself, so two texts with one MD5 stay apart; the
    grouping is a hash aggregate, so copies within a task collapse before the shuffle and a text
    crosses the network once for each task that has it, however many copies there are. The rows
    that look up their group carry digests only; that join is one whose hot keys AQE can split.

    Null text counts as empty; a null id is never preferred to another (a group of null ids only
    has a null keep_id, and its rows are kept). Rows repeated with the same id and text all name
    that id and all count as kept. Other columns are ignored. An empty table gives no rows.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("h128", F.md5("text"))
    groups = (
        rows.groupBy("h128", "text")
        .agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h128", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    members = rows.select("doc_id", "h128", F.sha2("text", 256).alias("text_sha256"))
    return members.join(groups, ["h128", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_duplicates`` keeps, each text once: of equal texts the row with the smallest id.

    One grouping by MD5 and text, so texts cross the network once and are not joined back. Null text counts as empty and stays
    null in the row that is kept; a null id is kept only if no other row has the text. Of rows with one id and text
    that differ elsewhere, the least as JSON is kept. Columns may have any names and types.
    """
    text = text_or_empty(text_col)
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.col(text_col).isNull().alias("none"))
    turn = F.struct(F.col(id_col).isNull().alias("a"), F.col(id_col).alias("b"), F.to_json(row).alias("c"))
    kept = docs.select(F.md5(text).alias("h128"), text.alias("text"), row.alias("row"), turn.alias("turn")).groupBy("h128", "text").agg(F.min_by("row", "turn").alias("row"))
    place = {c: F.col(f"row.c{i}") for i, c in enumerate(others)} | {text_col: F.when(~F.col("row.none"), F.col("text"))}
    return kept.select(*[place[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
