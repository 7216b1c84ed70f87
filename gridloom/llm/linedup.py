"""Line de-duplication by winnowing: window minima of line hashes are fingerprints whose matches are extended."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, materialise, table

RUN = 2
#: Lines in a window where single lines are asked for: runs of so many are found by their window minima, the lines between them after.
WINDOW = 4
#: Fingerprints that come more often than one in so many positions are at most so many; they are joined by broadcast.
HOT = 1 << 14
BLANK = " \t\n\r\x0b\x0c"


def winnow(hashes: list[int], window: int) -> Iterator[tuple[int, int, int]]:
    """(line, first window, windows) for each selected minimum: the leftmost least hash of each window of lines."""
    held = None
    for i in range(len(hashes) - window + 1):
        at = min(range(i, i + window), key=lambda j: (hashes[j], j))
        if held is not None and held[0] == at:
            held[2] += 1
            continue
        if held is not None:
            yield tuple(held)
        held = [at, i, 1]
    if held is not None:
        yield tuple(held)


def _lines(text: str) -> tuple[list[str], list[int]]:
    """All lines, and which of them are not blank."""
    lines = text.split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(BLANK)]


HASHED = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("hashes", pa.binary())])
POSITION = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("fingerprint", pa.int64()), ("at", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("content", pa.binary())])
POSITION_SQL = "doc_id long, version long, fingerprint long, at long, start long, windows long, content binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _fingerprint(content: bytes, line: int) -> int:
    return int.from_bytes(content[16 * line : 16 * line + 8], "little", signed=True)


def line_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the next, which tells apart texts under one id) and the 16-byte hashes of the lines that are not blank."""
    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines, own = _lines(text)
                hashes = b"".join(xxhash.xxh3_128_digest(lines[i]) for i in own)
                out.append((doc_id, int.from_bytes(xxhash.xxh3_128_digest(hashes)[8:], "little", signed=True), hashes))
            yield _batch(out, HASHED)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(scan, "doc_id long, version long, hashes binary")


def fingerprints(hashed: DataFrame, run: int = RUN) -> DataFrame:
    """Selected positions: doc_id, version, fingerprint, the line it is at, the first of its windows and their number, and content.

    With windows of ``run`` lines, any run of that many equal lines has a fingerprint at the same line. content is the 16-byte hashes of
    the lines around it that its windows span, as far as a match with it can extend both ways. ``hashed`` is that of ``line_hashes``.
    """

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, version, hashes in zip(*(c.to_pylist() for c in b.columns)):
                for at, start, n in winnow([_fingerprint(hashes, i) for i in range(len(hashes) // 16)], run):
                    out.append((doc_id, version, _fingerprint(hashes, at), at, start, n, hashes[16 * start : 16 * (start + n + run - 1)]))
            yield _batch(out, POSITION)

    return hashed.mapInArrow(select, POSITION_SQL)


def uncovered(hashed: DataFrame, runs: DataFrame) -> DataFrame:
    """Positions, one a line, of the lines of ``hashed`` that no run (doc_id, version, start, lines) of the same text covers."""
    key = ["doc_id", "version"]
    lists = runs.groupBy(*key).agg(F.collect_list(F.struct("start", "lines")).alias("runs"))
    both = hashed.join(lists.hint("merge"), key, "left").select(*key, "hashes", F.col("runs.start").alias("start"), F.col("runs.lines").alias("lines"))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, version, hashes, start, lines in zip(*(c.to_pylist() for c in b.columns)):
                gone = _covered(len(hashes) // 16, start, lines)
                out += [(doc_id, version, _fingerprint(hashes, i), i, i, 1, hashes[16 * i : 16 * (i + 1)]) for i in np.flatnonzero(~gone).tolist()]
            yield _batch(out, POSITION)

    return both.mapInArrow(left, POSITION_SQL)


def _covered(n: int, start: list[int] | None, lines: list[int] | None) -> np.ndarray:
    gone = np.zeros(n, bool)
    for s, k in zip(start or [], lines or []):
        gone[s : s + k] = True
    return gone


def extended(x: bytes, p: int, y: bytes, q: int) -> tuple[int, int]:
    """Lines before line p of x, and lines from it on, that equal those around line q of y (16 bytes a line)."""
    left, right = 0, 0
    while left < min(p, q) and x[16 * (p - left - 1) : 16 * (p - left)] == y[16 * (q - left - 1) : 16 * (q - left)]:
        left += 1
    while right < min(len(x) // 16 - p, len(y) // 16 - q) and x[16 * (p + right) : 16 * (p + right + 1)] == y[16 * (q + right) : 16 * (q + right + 1)]:
        right += 1
    return left, right


MATCH = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("fingerprint", pa.int64()), ("off", pa.int64()), ("lines", pa.binary())])


def repeated_runs(found: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, version, start and lines: lines in windows of ``run`` lines that also start earlier (by doc_id, then line).

    ``found`` are positions (see ``fingerprints``), as a written table.

    Positions are joined to the first position of their fingerprint, and the match is extended both ways from the line of the fingerprint as
    far as the lines are equal: the windows within are repeats. Windows that are not can only repeat others that
    differ from the first position's in the same way; they are joined among themselves by fingerprint, place and lines. Fingerprints
    that come once are done with. All groupings aggregate before they shuffle. Fingerprints that very many positions have are joined where the positions are (HOT rows of a few lines' hashes
    at most are broadcast); other joins are by sorting at every size, so that plans do not change with the input.
    """
    place = F.struct("doc_id", "at", "start", "content")
    first = materialise(found.groupBy("fingerprint").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    often = F.col("n") * HOT > found.count()
    hot, others = F.broadcast(first.where(often)), first.where(~often)
    cold = found.join(hot.select("fingerprint"), "fingerprint", "left_anti")
    later = F.struct("doc_id", "at") > F.struct("first.doc_id", "first.at")
    joined = found.join(hot, "fingerprint").union(cold.join(others.hint("merge"), "fingerprint")).where(later)
    joined = joined.select("doc_id", "version", "fingerprint", "at", "start", "windows", "content", (F.col("first.at") - F.col("first.start")).alias("q"), F.col("first.content").alias("other"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, version, fp, at, start, windows, content, q, other in zip(*(c.to_pylist() for c in b.columns)):
                p = at - start
                left, right = extended(content, p, other, q)
                lo, hi = (p - left, min(windows, p + right - run + 1)) if right else (0, 0)
                if lo < hi:
                    out.append((doc_id, version, start + lo, hi - lo, None, None, None))
                for i in [i for i in range(windows) if not lo <= i < hi]:
                    out.append((doc_id, version, start + i, 1, fp, p - i, content[16 * i : 16 * (i + run)]))
            yield _batch(out, MATCH)

    matches = materialise(joined.mapInArrow(extend, "doc_id long, version long, start long, windows long, fingerprint long, off long, lines binary"), "matches")
    rest, key = matches.where("lines is not null"), ["fingerprint", "off", "lines"]
    least = rest.groupBy(*key).agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    others = rest.join(least.hint("merge"), key).where(F.struct("doc_id", "start") > F.col("first"))
    runs = ["doc_id", "version", "start", (F.col("windows") + (run - 1)).alias("lines")]
    return matches.where("lines is null").select(*runs).union(others.select(*runs))


def repeated_lines(hashed: DataFrame, run: int = RUN, window: int = WINDOW) -> DataFrame:
    """doc_id, version, start and lines: what runs of ``run`` lines cover that also start earlier. ``hashed`` is a written table.

    A window of a single line selects nothing. So for those, runs of ``window`` lines are found first. What they cover comes earlier; the first
    place of a line is in none of them. Thus of the lines between, each that is not the first of its like is one more, and no others are.
    """
    wide = max(run, window) if run == 1 else run
    runs = repeated_runs(materialise(fingerprints(hashed, wide), "fingerprints"), wide)
    if wide == run:
        return runs
    runs = materialise(runs, "runs")
    return runs.union(repeated_runs(materialise(uncovered(hashed, runs), "between"), run))


KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_runs", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def dedup_lines(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, n_runs, kept_sha256 (and kept, the text that stays, if asked).

    Each line is deleted that a run of ``run`` lines covers which also starts earlier, in a document of smaller
    id or earlier in the same one. Lines are what LF parts. Blank lines are never deleted and are passed over, so that
    they do not part a run. Runs are judged on the input.

    Null text counts as empty (one blank line). Rows with a null id stay whole and are not compared. Rows that repeat
    an id and text come out alike; of different texts under one id, a run that is repeated in any of them is
    deleted at that place from all. Other columns are ignored. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = materialise(line_hashes(rows.where("doc_id is not null")), "lines")
    runs = repeated_lines(hashed, run, window).groupBy("doc_id").agg(F.collect_list(F.struct("start", "lines")).alias("runs"))
    both = rows.join(runs.hint("merge"), "doc_id", "left").select("doc_id", "text", F.col("runs.start").alias("start"), F.col("runs.lines").alias("lines"))
    schema = KEPT if with_kept else KEPT.remove(5)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, start, covered in zip(*(c.to_pylist() for c in b.columns)):
                lines, own = _lines(text)
                gone = _covered(len(own), start, covered)
                dropped = {own[i] for i in np.flatnonzero(gone)}
                kept = "\n".join(x for i, x in enumerate(lines) if i not in dropped)
                n_runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
                out.append((doc_id, len(lines), len(dropped), n_runs, hashlib.sha256(kept.encode()).hexdigest()) + ((kept,) if with_kept else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    return both.mapInArrow(cut, "doc_id long, n_lines long, n_removed long, n_runs long, kept_sha256 string" + ", kept string" * with_kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that is not blank and comes earlier is deleted, whatever its neighbours."""
    return dedup_lines(table(spark, sf_dir, "documents"), run=1)


def sql(run: int) -> str:
    """DuckDB SQL for the same rows."""
    return f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents
), own AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), windows AS (
  SELECT *, list(line) OVER here AS run, count(*) OVER here AS n FROM own
  WINDOW here AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {run - 1} FOLLOWING)
), ranked AS (
  SELECT *, n = {run} AND row_number() OVER (PARTITION BY run ORDER BY doc_id, k) > 1 AS again FROM windows
), gone AS (
  SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN {run - 1} PRECEDING AND CURRENT ROW) AS is_gone FROM ranked
), starts AS (
  SELECT *, is_gone AND NOT coalesce(lag(is_gone) OVER (PARTITION BY doc_id ORDER BY k), false) AS begins FROM gone
), marked AS (
  SELECT l.doc_id, l.i, l.line, coalesce(s.is_gone, false) AS is_gone, coalesce(s.begins, false) AS begins
  FROM lines l LEFT JOIN starts s ON l.doc_id = s.doc_id AND l.i = s.i
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (is_gone) AS n_removed, count(*) FILTER (begins) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT is_gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


ORACLE_SQL = sql(1)
