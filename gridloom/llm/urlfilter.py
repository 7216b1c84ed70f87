"""URL rules by Bloom filter cascades: exact membership over the corpus's key universe, without joins.

A cascade alternates: level 1 encodes the listed keys, level 2 the keys of the universe that level 1
takes wrongly, level 3 the listed keys that level 2 takes wrongly, and so on until none is left.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table

#: So few keys or less are listed as they are instead of in one more filter.
LISTED = 64


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits, eight a byte, ``probes`` places a key, and its number, which chooses the places."""

    data: bytes
    probes: int
    number: int

    @property
    def bits(self) -> int:
        return 8 * len(self.data)


SECOND = "second"


def _hashes(keys: list[str]) -> np.ndarray:
    """Two 64-bit hashes of each key, as Spark's xxhash64 gives them (seed 42, and the hash of ``SECOND`` as seed)."""
    other = xxhash.xxh64_intdigest(SECOND.encode(), 42)
    raw = [x.encode() for x in keys]
    return np.array([[xxhash.xxh64_intdigest(x, 42) for x in raw], [xxhash.xxh64_intdigest(x, other) for x in raw]], np.uint64)


def _positions(hashes: np.ndarray, bits: int, probes: int, number: int) -> np.ndarray:
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    start, step = low[0] + low[1] * np.uint64(number), high[0] + high[1] * np.uint64(number) | np.uint64(1)
    return (start + np.arange(probes, dtype=np.uint64)[:, None] * step) % np.uint64(bits)


def _level(hashes: np.ndarray, rate: float, number: int) -> Level:
    n = max(1, hashes.shape[1])
    size = math.ceil(max(64.0, n * math.log(1 / rate) / math.log(2) ** 2) / 8)
    probes = max(1, round(min(math.log2(1 / rate), 8 * size / n * math.log(2))))
    bits = np.zeros(8 * size, bool)
    bits[_positions(hashes, 8 * size, probes, number).ravel()] = True
    return Level(np.packbits(bits, bitorder="little").tobytes(), probes, number)


def _in(level: Level, hashes: np.ndarray) -> np.ndarray:
    at = _positions(hashes, level.bits, level.probes, level.number)
    data = np.frombuffer(level.data, np.uint8)
    return (data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)


def _holds(level: Level, key: Column) -> Column:
    """Whether the filter takes ``key``; built-in expressions only, the bits as one binary literal."""
    first, second = F.xxhash64(key), F.xxhash64(F.lit(SECOND), key)
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda h: F.shiftrightunsigned(h, 32)
    start, step = low(first) + low(second) * F.lit(level.number), (high(first) + high(second) * F.lit(level.number)).bitwiseOR(F.lit(1))
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(level.probes - 1).cast("long")), lambda i: (start + i * step) % F.lit(level.bits))

    def is_set(at: Column) -> Column:
        byte = F.ascii(F.decode(F.substring(F.lit(level.data), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
        return F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1

    return F.forall(places, is_set)


@dataclass(frozen=True)
class Cascade:
    """Levels, and the last keys (taken by all of them) for which the last level's answer is wrong."""

    levels: tuple[Level, ...]
    rest: tuple[str, ...] = ()

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over; false for a null key."""
        if not self.levels:
            return F.lit(False)
        answer = F.lit(len(self.levels) % 2 == 1)
        if self.rest:
            answer = key.isin(list(self.rest)) != answer
        for level in reversed(self.levels):
            answer = F.when(_holds(level, key), answer).otherwise(F.lit(level.number % 2 == 0))
        return F.coalesce(F.when(key.isNotNull(), answer), F.lit(False))


def build_cascades(universe: DataFrame, lists: dict[str, list[str]]) -> dict[str, Cascade]:
    """A cascade for each list of keys, exact over ``universe`` (a column ``key``).

    The first level's error rate is |listed| / (1.4 |universe|), so that fewer wrong keys are
    expected than there are listed ones; it is halved until at most 4 |listed| + 256 came, which
    bounds both what is brought to the driver and every later level by the length of the lists.
    There are as many levels as it takes until LISTED keys are left.
    """
    lists = {k: sorted(set(v)) for k, v in lists.items()}
    universe = universe.where("key is not null").distinct()
    total = universe.count()
    every = {x for v in lists.values() for x in v}
    listed = {k: (v, _hashes(v)) for k, v in lists.items()}
    rates = {k: min(0.5, max(1, len(v)) / (1.4 * max(1, total))) for k, v in lists.items()}
    bound = sum(4 * len(v) + 256 for v in lists.values()) + len(every)
    while True:
        first = {k: _level(h, rates[k], 1) for k, (_, h) in listed.items()}
        taken = F.lit(False)
        for level in first.values():
            taken = taken | _holds(level, F.col("key"))
        wrong = [r[0] for r in universe.where(taken).limit(bound + 1).collect()]
        if len(wrong) <= bound:
            break
        rates = {k: v / 2 for k, v in rates.items()}
    out = {}
    for name, (keys, hashes) in listed.items():
        if not keys:
            out[name] = Cascade(())
            continue
        levels, own = [first[name]], set(keys)
        inside = (np.array(keys, object), hashes)
        others = [x for x in wrong if x not in own]
        found = _hashes(others)
        took = _in(first[name], found)
        outside = (np.array(others, object)[took], found[:, took])
        while len(outside[0]) > LISTED:
            levels.append(_level(outside[1], 0.5, len(levels) + 1))
            took = _in(levels[-1], inside[1])
            inside, outside = outside, (inside[0][took], inside[1][:, took])
        out[name] = Cascade(tuple(levels), tuple(outside[0].tolist()))
    return out


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    part = lambda n: F.coalesce(F.regexp_extract(F.col(url), pattern, n), F.lit(""))
    return F.translate(part(1), upper, upper.lower()), part(2)


def _candidates(rules: list[Rule]) -> Column:
    """The keys by which a url could meet a rule: for each pair of host labels and path length that rules have."""
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    keys = [
        F.when(F.length("path") >= length, F.concat(F.substring_index("host", ".", -labels), F.substring(F.col("path"), 1, length)))
        for labels, length in shapes
    ]
    return F.filter(F.array(*keys), lambda x: x.isNotNull()) if keys else F.expr("cast(array() as array<string>)")


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest
    rule wins (of equally long ones the greatest by code points). Without one, the verdict is
    ``default``. A null url, and one without ``://``, has an empty host and path and meets no rule
    unless a rule is empty. Rows repeat as in the input; other columns are ignored. Of rules with one
    host and path, the first counts. Rules are a list in the driver; the filters built from it are binary literals of the plan, a few bytes a rule.
    """
    rules = list({r.key: r for r in reversed(rules)}.values())[::-1]
    host, path = url_parts(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("keys", _candidates(rules))
    lists: dict[str, list[str]] = {}
    for r in rules:
        lists.setdefault(r.verdict, []).append(r.key)
    cascades = build_cascades(rows.select(F.explode("keys").alias("key")), lists)

    def judged(key: Column) -> Column:
        verdict = F.lit(None).cast("string")
        for name, cascade in cascades.items():
            verdict = F.when(cascade.contains(key), F.lit(name)).otherwise(verdict)
        return F.struct(F.length(key).alias("n"), key.alias("rule"), verdict.alias("verdict"))

    best = F.array_max(F.filter(F.transform("keys", judged), lambda x: x["verdict"].isNotNull()))
    return rows.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


ORACLE_SQL = """
WITH cut AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM cut
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
