"""Periodic runs of words: midpoints of a divided text find the repetitions that cross them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import bounded_batches, table, text_or_empty
from gridloom.llm.spelling import CRC, crc_sql

LENGTH, TIMES = 24, 3
#: Letters of a candidate period that are compared before Z-functions are.
LOOK = 4


def z_function(x: list[int]) -> list[int]:
    """How far x from each place on agrees with its beginning."""
    n, lo, hi = len(x), 0, 0
    z = [n] + [0] * (n - 1)
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        if i + k > hi:
            lo, hi = i, i + k
        z[i] = k
    return z


def _promising(fore: np.ndarray, length: int, times: int) -> bool:
    """If ``fore`` agrees with itself, moved by any period, as far as the repetition that reaches further to this side must.

    Of a repetition of q words, at least max(length, times * q) / 2 lie on one side. With three periods that is more than one.
    """
    if times < 3:
        return True
    at = np.flatnonzero(fore[1:] == fore[0]) + 1
    for j in range(1, min(LOOK, len(fore))):
        if not at.size:
            return False
        need = np.maximum((np.maximum(length, times * at) + 1) // 2 - at, 1)
        at = at[at + need <= len(fore)]
        must = (np.maximum(length, times * at) + 1) // 2 - at > j
        at = at[~must | (fore[np.minimum(at + j, len(fore) - 1)] == fore[j])]
    return bool(at.size)


def _crossing(fore: np.ndarray, back: np.ndarray, length: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(words of back, words of fore, q), rising in q, of repetitions over the meeting point; both are read away from it.

    All with at least q words in fore are found.
    """
    f, b = fore.tolist(), back.tolist()
    on = np.array(z_function(f))
    before = np.array(z_function(b + [-1] + f[::-1] + b)[len(b) + 1 :][: len(f)])[::-1]  # place q - 1: agreement of back with itself after q words of fore
    q = np.arange(1, len(f) + 1)
    ahead = np.append(on[1:], 0)
    behind = np.minimum(before, len(b))
    for i in np.flatnonzero(behind + ahead + q >= np.maximum(length, times * q)):
        yield int(behind[i]), int(ahead[i] + q[i]), int(q[i])


def periodic_runs(ids: np.ndarray, length: int = LENGTH, times: int = TIMES) -> dict[tuple[int, int], int]:
    """The smallest period by (start, end) of all maximal runs of at least ``length`` items and ``times`` periods (2 or more).

    A part is halved until it is too short. A run is found whole at the first midpoint that it crosses, by the Z-functions of the
    halves; one that goes on beyond the part has crossed an earlier midpoint.
    """
    found: dict[tuple[int, int], int] = {}
    parts = [(0, len(ids))]
    while parts:
        lo, hi = parts.pop()
        if hi - lo < length:
            continue
        mid = (lo + hi) // 2
        parts += [(lo, mid), (mid, hi)]
        right, left = ids[mid:hi], ids[lo:mid][::-1]
        spans = []
        if _promising(right, length, times):
            spans += [(mid - b, mid + f, q) for b, f, q in _crossing(right, left, length, times)]
        if _promising(left, length, times):
            spans += [(mid - f, mid + b, q) for b, f, q in _crossing(left, right, length, times)]
        for start, end, q in spans:
            if start == lo and start and ids[start - 1] == ids[start - 1 + q] or end == hi and end < len(ids) and ids[end] == ids[end - q]:
                continue
            if q < found.get((start, end), q + 1):
                found[start, end] = q
    return found


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, from a place on repeated with a period if the id's CRC-32 says so. A null id changes nothing."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("collapsed", pa.string()),
])


def collapse(docs: DataFrame, length: int = LENGTH, times: int = TIMES, plant: bool = False, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_runs, the run of the most periods (start, length, period, exponent_milli), runs_sha256 and
    collapsed_sha256 (and collapsed, the text without repeated periods, if asked).

    Words are what ASCII white space parts. A run is a longest stretch with a smallest period q, of at least ``length`` words and
    ``times`` * q; its words after the first q are dropped. ``plant`` first makes some texts periodic, by their ids.

    Null and empty texts and texts without words have no run; four columns are then null, and both digests those of no bytes.
    Rows that repeat come out alike; rows with a null id are kept and nothing is planted in them. Of runs of like exponents the
    first counts, then the one of the smaller period. Texts may be of any length: time grows as n log n, memory as n.
    Other columns are ignored. An empty table gives no rows.
    """
    if times < 2 or length < 2:
        raise ValueError("runs have two periods and two words at least")
    bounded_batches(docs.sparkSession)
    schema = SCHEMA if with_text else SCHEMA.remove(8)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = text.as_py().encode().split()
                if plant:
                    words = planted(words, doc_id)
                known: dict[bytes, int] = {}
                runs = sorted((s, e - s, q) for (s, e), q in periodic_runs(np.array([known.setdefault(w, len(known)) for w in words], np.int64), length, times).items())
                best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
                if runs:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s, n, q in runs:
                        gone[s + q] += 1
                        gone[s + n] -= 1
                    words = [w for w, x in zip(words, np.cumsum(gone)) if not x]
                left = b" ".join(words)
                row = (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(left).hexdigest())
                out.append(row + ((left.decode(),) if with_text else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    kinds = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return rows.mapInArrow(scan, kinds + ", collapsed string" * with_text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "documents"), plant=True)


#: Equal words q apart, in stretches of consecutive places, make the runs of period q; a run's other periods are multiples of its smallest.
ORACLE_SQL = f"""{CRC}
, source AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS own, doc_id::VARCHAR AS id FROM documents
), hashed AS (
  SELECT doc_id, own, length(own) AS n, {crc_sql("list_transform(range(length(id)), lambda i: ascii(substr(id, i + 1, 1))::BIGINT)")} AS h FROM source, crc
), rules AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS parts FROM hashed
), texts AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN own ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN own[i + 1] ELSE own[a + (i - a) % (1 + (n - a) // parts) + 1] END) END AS words FROM rules
), placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(n)) AS i FROM texts
), equal AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM placed x JOIN placed y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest({LENGTH}, {TIMES} * q) GROUP BY doc_id, start, length
), summed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS text FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i WHERE g.i IS NULL GROUP BY p.doc_id
)
SELECT t.doc_id, coalesce(s.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
       sha256(coalesce(s.listed, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM texts t LEFT JOIN summed s ON t.doc_id = s.doc_id LEFT JOIN best b ON t.doc_id = b.doc_id LEFT JOIN kept k ON t.doc_id = k.doc_id
"""
