"""Spelling variants: words at distance one are found by walking tries with each word's automaton."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, table

RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
#: One run in so many loses a code point.
DAMAGE = 199
LENGTH, COUNT = 6, 5
#: A form is so many times as frequent as its variant.
FACTOR = 5
#: Nodes after which a trie is closed; a trie is at most a word larger. A node takes 13 bytes.
SHARD_NODES = 1 << 19
#: Bytes of tries that are broadcast at a time (and one trie more at most).
GROUP_BYTES = 32 << 20
#: Words that a task takes through the tries.
BLOCK = 1 << 15


def lower_ascii(word: Column) -> Column:
    """A-Z alone in lower case. Words without other letters, most by far, take the short way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))


def counted(docs: DataFrame) -> DataFrame:
    """word and n of the runs of letters of all texts, A-Z in lower case and one run in DAMAGE damaged."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.select("id", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    damaged = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    return runs.withColumns({"h": h, "at": at}).select(F.when(F.col("h") % DAMAGE == 0, damaged).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _transitions() -> list[list[int]]:
    """The automaton of distance one, for words of any length: next state by state and which of three letters was read.

    At depth d (letters read) bit 0 of a state says that they are the word's first d; the others that one edit made
    them its first d - 1, d or d + 1. A letter is told by bits: it is the word's letter d - 1, d or d + 1, from 0.
    """
    rows = []
    for state in range(16):
        exact, behind, even, ahead = (state >> i & 1 for i in range(4))
        row = []
        for seen in range(8):
            last, here, later = (seen >> i & 1 for i in range(3))
            on = exact & here
            row.append(on | (exact | behind & last) << 1 | (exact | even & here) << 2 | (ahead & later | on) << 3)
        rows.append(row)
    return rows


NEXT = _transitions()
#: Nothing read: the empty prefix, or the first letter left out.
START = 0b1001


def make_tries(words: Iterable[tuple[bytes, int]], most: int = SHARD_NODES) -> Iterator[tuple[bytes, bytes, bytes]]:
    """Tries of the sorted words as packed arrays: label, first child (those of a node stand together) and count, by node in breadth.

    A trie is closed once it has ``most`` nodes.
    """
    held, nodes, last = [], 1, b""
    for word, n in words:
        if nodes >= most:
            yield _packed(held)
            held, nodes, last = [], 1, b""
        same = 0
        for x, y in zip(word, last):
            if x != y:
                break
            same += 1
        nodes += len(word) - same
        held.append((word, n))
        last = word
    if held:
        yield _packed(held)


def _packed(words: list[tuple[bytes, int]]) -> tuple[bytes, bytes, bytes]:
    label, first, count = bytearray(1), array("I"), array("q")
    level, depth = [(0, len(words))], 0
    while level:
        below, at = [], len(label)
        for lo, hi in level:
            first.append(at)
            ends = len(words[lo][0]) == depth
            count.append(words[lo][1] if ends else 0)
            lo += ends
            while lo < hi:
                x, start = words[lo][0][depth], lo
                while lo < hi and words[lo][0][depth] == x:
                    lo += 1
                label.append(x)
                below.append((start, lo))
                at += 1
        level, depth = below, depth + 1
    first.append(len(label))
    return bytes(label), first.tobytes(), count.tobytes()


def unpacked(trie: tuple[bytes, bytes, bytes]) -> tuple[bytes, array, array]:
    first, count = array("I"), array("q")
    first.frombytes(trie[1])
    count.frombytes(trie[2])
    return trie[0], first, count


def near(word: bytes, trie: tuple[bytes, array, array]) -> tuple[int, int, bytes | None]:
    """How many words of the trie are at distance one, and the count and letters of the most frequent (of like ones the first).

    The trie is walked depth-first along the automaton's live states.
    """
    label, first, count = trie
    size, padded = len(word), b"\0" + word + b"\0\0\0"
    found, best_n, best = 0, 0, None
    stack, path = [(0, 0, START)], bytearray(size + 2)
    while stack:
        node, depth, state = stack.pop()
        if depth:
            path[depth - 1] = label[node]
            n = count[node]
            if n and -2 < depth - size < 2 and state >> size - depth + 2 & 1 and not (depth == size and state & 1):
                found += 1
                if n > best_n or n == best_n and path[:depth] < best:
                    best_n, best = n, bytes(path[:depth])
        if depth > size:
            continue
        last, here, later, row = padded[depth], padded[depth + 1], padded[depth + 2], NEXT[state]
        for child in range(first[node], first[node + 1]):
            x = label[child]
            after = row[(x == last) | (x == here) << 1 | (x == later) << 2]
            if after:
                stack.append((child, depth + 1, after))
    return found, best_n, best


TRIE = "size long, label binary, first binary, count binary"
PART = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def tries(words: DataFrame, most: int = SHARD_NODES) -> DataFrame:
    """shard and TRIE: the words (word, n) in ranges, each range as tries of at most ``most`` nodes and a word."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((w.encode("latin-1"), n) for b in batches for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for label, first, count in make_tries(rows, most):
            yield pa.RecordBatch.from_pydict({"size": pa.array([len(label) + len(first) + len(count)], pa.int64()), "label": pa.array([label], pa.binary()), "first": pa.array([first], pa.binary()), "count": pa.array([count], pa.binary())})

    built = words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word").mapInArrow(build, TRIE)
    return built.select(F.xxhash64("label", "first").alias("shard"), "*")


def neighbours(words: DataFrame, most: int = SHARD_NODES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """word, n_near, best_n, best: for each word (word, n) with words at distance one, how many, and the most frequent of them.

    Every word is taken through every trie. Tries are broadcast in groups of bounded size, one after the other; what a
    group finds is written, and at last reduced by word.
    """
    spark = words.sparkSession
    made = materialise(tries(words, most), "tries")
    sizes = sorted(tuple(r) for r in made.select("shard", "size").collect())
    groups, full = [], group_bytes
    for shard, size in sizes:
        if full >= group_bytes:
            groups.append([])
            full = 0
        groups[-1].append(shard)
        full += size
    blocks = max(spark.sparkContext.defaultParallelism, math.ceil(words.count() / BLOCK))
    queries = materialise(words.select("word").repartition(blocks, "word"), "words")
    found = None
    for group in groups:
        held = spark.sparkContext.broadcast([tuple(r) for r in made.where(F.col("shard").isin(group)).select("label", "first", "count").collect()])

        def walk(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = [unpacked(t) for t in held.value]
            for b in batches:
                out = []
                for word in b.column(0).to_pylist():
                    letters = word.encode("latin-1")
                    for trie in own:
                        n, best_n, best = near(letters, trie)
                        if n:
                            out.append((word, n, best_n, best.decode("latin-1")))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, PART)], schema=PART)

        part = materialise(queries.mapInArrow(walk, "word string, n_near long, best_n long, best string"), "near")
        held.unpersist()
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("least")).select("word", "n_near", (-F.col("least.m")).alias("best_n"), F.col("least.best").alias("best"))


def roots(words: DataFrame, longest: int) -> DataFrame:
    """word and root of the words that have a form: forms followed to their end by doubling, as often as chains of ``longest`` forms need."""
    up = materialise(words.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        over = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = materialise(up.join(over, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")
    return up


def variants(docs: DataFrame, length: int = LENGTH, least: int = COUNT, factor: int = FACTOR, most: int = SHARD_NODES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """word, n, form, root, n_near, form_n for every word of at least ``length`` letters that comes ``least`` times or more.

    Words are the maximal runs of letters of ``docs`` (doc_id, text), A-Z in lower case, one run in DAMAGE less a
    letter by a rule. Words are near at one letter inserted, deleted or replaced. form is the most frequent near word (of like
    ones the first in code-point order) if it comes ``factor`` (2 or more) times as often, root the end of the chain of forms.

    Null texts and texts without letters have no words. A null id counts as an empty one. Rows that repeat count each time.
    Texts and words may be of any length. Other columns are ignored. An empty table gives no rows.
    """
    if factor < 2:
        raise ValueError("forms must be more frequent than their variants")
    words = materialise(counted(docs).where((F.char_length("word") >= length) & (F.col("n") >= least)), "vocabulary")
    both = words.join(neighbours(words, most, group_bytes).withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    is_form = F.col("best_n") >= factor * F.col("n")
    both = both.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    both = materialise(both, "words-with-forms")
    low, high = both.agg(F.min("n"), F.max("n")).first()
    longest, n = 0, low or 0
    while n and n * factor <= high:
        longest, n = longest + 1, n * factor
    ends = roots(both, longest).withColumnRenamed("word", "w")
    return both.join(ends, F.col("word") == F.col("w"), "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: DuckDB: the unsigned CRC-32 of the ASCII or Latin-1 string expression, by the table ``crc`` (one list of 256).
CRC = """
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8)
"""


def crc_sql(octets: str) -> str:
    """SQL for the CRC-32 of a list of bytes, beside the table ``crc``."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE_SQL = f"""{CRC}
, runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents
), lowered AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL
), hexed AS (SELECT *, hex(encode(id || ':' || run)) AS x FROM lowered
), hashed AS (
  SELECT id, run, n, {crc_sql("list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 1 + 2 * i, 2))::BIGINT)")} AS h FROM hexed, crc
), counts AS (
  SELECT CASE WHEN h % {DAMAGE} = 0 THEN run[1:h % length(run)] || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1
), words AS (SELECT * FROM counts WHERE length(word) >= {LENGTH} AND n >= {COUNT}
), keys AS (  -- the word (at -1), and the word less each letter
  SELECT word, n, unnest(range(-1, length(word))) AS at, unnest(list_transform(range(-1, length(word)), lambda i: CASE WHEN i < 0 THEN word ELSE substr(word, 1, i) || substr(word, i + 2) END)) AS k FROM words
), pairs AS (  -- one letter replaced, or one more in either
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM keys a JOIN keys b ON a.k = b.k AND a.word <> b.word
  WHERE a.at = b.at OR (a.at < 0) <> (b.at < 0)
), ranked AS (
  SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM pairs
), formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.m >= {FACTOR} * w.n THEN r.other END AS form, CASE WHEN r.m >= {FACTOR} * w.n THEN r.m END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.k = 1
), chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.next = f.word
)
SELECT f.word, f.n, f.form, c.root, f.n_near, f.form_n FROM formed f JOIN chain c ON f.word = c.word AND c.next IS NULL
"""
