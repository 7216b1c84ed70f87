"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, table

WORD = r"[^\x20\x09-\x0D]+"
#: Parts into which the documents of one size class of a source are dealt, so that none is in one task alone.
SALTS = 64
NO_SOURCE = "no source"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _size_class(size: Column) -> Column:
    """Grows with the size, four classes an octave."""
    bits = F.length(F.bin(size))
    return bits * 8 + F.call_function("shiftright", size, F.greatest(bits - 3, F.lit(0))).cast("int")


def _hex(column: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(column), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """Targets from one row a source (``source``, ``source_size``).

    The sources in code point order, null last, take ``weights`` in turn and share ``share`` times the
    total; a target stops at ``cap`` times its source's size and the excess goes to the others by
    weight until none is above. That is one level of water: sources are taken by rising cap / weight,
    and the first whose cap is not reached sets the level. One row a source crosses to one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * cap)
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.select(
        "*",
        F.row_number().over(fill).alias("turn"),
        (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))).alias("budget"),
        F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    )
    open_ = F.col("weight") * (F.col("budget") - F.col("before")) / F.col("rest") < F.col("most")
    rows = rows.withColumn("stop", F.min(F.when(open_, F.col("turn"))).over(Window.partitionBy()))
    at = lambda c: F.max(F.when(F.col("turn") == F.col("stop"), F.col(c))).over(Window.partitionBy())
    rows = rows.withColumn("b", at("before")).withColumn("r", at("rest"))
    level = F.col("weight") * (F.col("budget") - F.col("b")) / F.col("r")
    target = F.when(F.col("turn") >= F.col("stop"), level).otherwise(F.col("most").cast("double"))
    return rows.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", identity: Column | None = None) -> DataFrame:
    """Per row: doc_id, size, source_size, target, copies and taken (= copies * size), and ``identity`` if one is given.

    Each document of a source expects target / source_size copies. The source's documents stand in
    the order of size class, salt, size and id; the expected copies are summed along it from one random
    offset (fixed by ``seed`` and source), and a document is emitted once for each integer passed.
    As like sizes stand together, what a source gives stays near its target.

    The texts are read once: ids, sources and sizes are written to the shared folder. The prefix sum is in two steps: counts by (source, size class, salt) are summed within the source, and
    ranks are taken within such a part, so no task holds a whole source. Null text and text
    without words have size 0; a null source is a source of its own, last; a source of size 0 has target 0.
    Null ids stand first; rows that repeat are interchangeable. Other columns are ignored.
    """
    size = word_count(text_col)
    own = [identity.alias("identity")] if identity is not None else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), *own)
    rows = rows.select(
        "*",
        _size_class(F.col("size")).alias("part"),
        (_hex(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 4) % SALTS).cast("int").alias("salt"),
    )
    rows = materialise(rows, "sizes")
    keys = ["source", "part", "salt"]
    parts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    along = Window.partitionBy("source").orderBy("part", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("n").over(along), F.lit(0))).alias("p")
    t = targets.alias("t")
    starts = starts.join(t, F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.source", "p.part", "p.salt", "p.start", "t.source_size", "t.target")
    r, s = rows.alias("r"), starts.alias("s")
    on = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.part") == F.col("s.part")) & (F.col("r.salt") == F.col("s.salt"))
    placed = r.join(s, on).select("r.*", "s.start", "s.source_size", "s.target")
    within = Window.partitionBy(*keys).orderBy("size", F.col("doc_id").asc_nulls_first())
    placed = placed.withColumn("i", F.col("start") + F.row_number().over(within))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hex(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(NO_SOURCE))), 8) / F.lit(4294967296.0)
    placed = placed.withColumn("rate", rate).withColumn("offset", offset)
    passed = F.floor(F.col("i") * F.col("rate") + F.col("offset")) - F.floor((F.col("i") - 1) * F.col("rate") + F.col("offset"))
    copies = F.least(passed, F.ceil("rate"))
    named = ["identity"] if own else []
    return placed.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *named)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, as often as ``mix_sources`` takes each.

    Copies are joined to rows by id and a digest of source and text. Rows that are equal in these are numbered (only if there are any), so that
    each gets its own number of copies. Columns may have any names.
    """
    text, source = F.coalesce(F.col(text_col), F.lit("")), F.col(source_col)
    digest = F.md5(F.concat(F.when(source.isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce(source.cast("string"), F.lit("")), F.lit("\0"), text))
    taken = materialise(mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, identity=digest).select("doc_id", "identity", "copies", "size"), "taken")
    rows, names = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), digest.alias("digest")), docs.columns
    number, order = F.lit(1), F.lit(1)
    if not taken.groupBy("doc_id", "identity").count().where("count > 1").isEmpty():
        number = F.row_number().over(Window.partitionBy("id", "digest").orderBy(F.to_json("row")))
        order = F.row_number().over(Window.partitionBy("doc_id", "identity").orderBy("copies"))
    rows, taken = rows.withColumn("turn", number), taken.withColumn("order", order).where("copies > 0")
    same = rows["id"].eqNullSafe(taken["doc_id"]) & (rows["digest"] == taken["identity"]) & (rows["turn"] == taken["order"])
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return rows.join(taken, same).select("row", copies).select(*[F.col("row").getField(c).alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def sql(documents: str = "documents") -> str:
    """DuckDB SQL for the same rows, doc_id to taken; the mixture of the relation ``documents``."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {documents}
), rows_ AS (
  SELECT *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) AS part,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::BIGINT % {SALTS} AS salt
  FROM sized
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         source_size * 2 AS most, (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget
  FROM sums
), filled AS (
  SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS turn,
         coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
         (sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rest
  FROM weighed
), stopped AS (
  SELECT *, min(CASE WHEN weight * (budget - before) / rest < most THEN turn END) OVER () AS stop FROM filled
), levelled AS (
  SELECT *, max(CASE WHEN turn = stop THEN before END) OVER () AS b, max(CASE WHEN turn = stop THEN rest END) OVER () AS r FROM stopped
), targets AS (
  SELECT source, source_size, CASE WHEN turn >= stop THEN weight * (budget - b) / r ELSE most::DOUBLE END AS target FROM levelled
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         row_number() OVER (PARTITION BY d.source ORDER BY d.part, d.salt, d.size, d.doc_id NULLS FIRST) AS i,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(d.source, '{NO_SOURCE}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM rows_ d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (least(floor(i * rate + u) - floor((i - 1) * rate + u), ceil(rate)))::BIGINT * size AS taken
FROM placed
"""


ORACLE_SQL = sql()
