"""Best-fit packing of token sequences: length patterns fitted to the histogram by non-negative least squares."""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, materialise, table

LENGTH = 1024
END = 2
#: Pieces of one length that one task ranks, about.
RANKED = 1 << 18
#: Lengths in a generated pattern, rounds of generating them, rounds of filling what rounding left, the share of a count that one of those
#: uses, and after how many of them a filling may be a token less full.
FEW, ROUNDS, FILLS, SHARE, SLACK = 8, 4, 96, 6, 12
#: Distinct pre-tokens that a task remembers the ids of before it starts anew; freed at its end, as workers live on.
REMEMBERED = 300_000


#: Characters for which the standard library's re splits as the pattern does, and that split for them.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"[\t\n\r -~{LETTER}]*\Z")
PLAIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: visible Latin-1 characters as they are, the others from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}


BYTE_LETTERS = _byte_letters()


class Encoder:
    """A byte-level BPE of the tokenizers library that remembers the ids of pre-tokens, as bytes of two an id.

    Merges never cross pre-tokens, so the ids of a text are those of its pre-tokens in turn. The library's model is
    asked for those that are new, in the letters that stand for their bytes. A text that holds the literal of an added token
    is given to the library as it is, which looks for these first.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None:
            raise ValueError("pre-tokens are only remembered for tokenizers that do not normalise")
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of two bytes need a vocabulary of at most 65,536")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> np.ndarray:
        if any(x in text for x in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        known = self.known
        parts = PLAIN_SPLIT.findall(text) if PLAIN.match(text) else self.find(text)
        fresh = set(parts).difference(known)
        if fresh:
            if len(known) + len(fresh) > REMEMBERED:
                known.clear()
                fresh = set(parts)
            tokenize, letters = self.tokenizer.model.tokenize, BYTE_LETTERS
            for x in fresh:
                ids = [t.id for t in tokenize(x.encode().decode("latin-1").translate(letters))]
                known[x] = struct.pack(f"<{len(ids)}H", *ids)
        return np.frombuffer(b"".join(map(known.__getitem__, parts)), "<u2").astype("<u4")


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def tokenised_pieces(docs: DataFrame, tokenizer: str, pattern: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked): a document's ids and ``end``, cut only beyond ``length``.

    Only the first piece of a cut document is shorter than ``length``. Null text counts as empty and
    gives one piece, the end id. Repeated rows give repeated pieces. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    schema = PIECE.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else PIECE

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, pattern)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                at, n = 0, (len(ids) - 1) % length + 1
                for piece in range(-(-len(ids) // length)):
                    own = ids[at : at + n]
                    rows.append((doc_id, piece, at, n, zlib.crc32(own.tobytes())) + ((own.astype(np.int64),) if with_ids else ()))
                    at, n = at + n, length
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def patterns(lengths: list[int], total: int) -> np.ndarray:
    """All multisets of two or three of ``lengths`` that fill ``total``, as rows of three (0: none)."""
    have = np.zeros(total + 1, bool)
    have[[x for x in lengths if 0 < x < total]] = True
    a = np.flatnonzero(have)
    pairs = a[(a <= total - a) & have[total - a]]
    found = [np.stack([pairs, total - pairs, 0 * pairs], 1)]
    for x in a[a <= total // 3]:
        y = a[(a >= x) & (a <= (total - x) // 2)]
        y = y[have[total - x - y]]
        found.append(np.stack([0 * y + x, y, total - x - y], 1))
    return np.concatenate(found)


def nnls(rows: np.ndarray, wanted: np.ndarray, steps: int = 400, start: np.ndarray | None = None) -> np.ndarray:
    """Counts x >= 0 of the patterns ``rows`` (0: none) that bring ||A x - wanted|| near its least, by accelerated projected gradients."""
    size = len(wanted)
    owner, place = np.nonzero(rows)
    flat = rows[owner, place]

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, x[owner], size)

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(owner, r[flat], len(rows))

    v = np.ones(len(rows))
    for _ in range(20):
        v = back(used(v))
        v /= norm if (norm := np.linalg.norm(v)) else 1
    step = 1 / max(1e-9, 1.05 * np.linalg.norm(back(used(v))))
    x = y = np.zeros(len(rows)) if start is None else np.append(start, np.zeros(len(rows) - len(start)))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(used(y) - wanted))
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        x, y = new, new + (was - 1) / t * (new - x)
    return x


class Filling:
    """The multisets of lengths that are worth most, for each sum up to ``total``."""

    def __init__(self, lengths: np.ndarray, worth: np.ndarray, total: int):
        self.best, self.last = np.full(total + 1, -np.inf), np.zeros(total + 1, np.int64)
        self.best[0] = 0.0
        upto = np.searchsorted(lengths, np.arange(total + 1), "right")
        for c in range(1, total + 1):
            n = upto[c]
            if n:
                values = self.best[c - lengths[:n]] + worth[:n]
                i = int(values.argmax())
                self.best[c], self.last[c] = values[i], lengths[i]

    def lengths(self, c: int) -> list[int]:
        """Those of sum ``c``, which must be reachable."""
        out = []
        while c:
            out.append(int(self.last[c]))
            c -= out[-1]
        return out


def generated(lengths: np.ndarray, lacking: np.ndarray, total: int) -> list[list[int]]:
    """For each length, the pattern of at most FEW with it that fills ``total`` and covers most of what a fit lacks."""
    filling = Filling(lengths, lacking[lengths], total)
    found = {tuple(sorted((x, *filling.lengths(total - x)))) for x in lengths.tolist() if filling.best[total - x] > -np.inf}
    return [list(f) for f in found if 3 < len(f) <= FEW and lacking[list(f)].sum() > 0]


def fitted_patterns(have: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns that fill ``total`` and how often each is fitted: all of two or three lengths, then, ROUNDS times, those
    of more that the residual of the fit asks for."""
    lengths = np.flatnonzero(have[:total])
    rows = np.pad(patterns(lengths.tolist(), total), ((0, 0), (0, FEW - 3)))
    if not len(lengths):
        return rows, np.empty(0)
    scale = float(have[lengths].max())
    wanted = np.where(np.arange(total + 1) < total, have, 0) / scale
    fitted = nnls(rows, wanted) if len(rows) else np.empty(0)
    for _ in range(ROUNDS):
        lacking = wanted - np.bincount(rows[rows > 0], np.repeat(fitted, (rows > 0).sum(1)), total + 1)
        more = generated(lengths, lacking, total)
        if not more:
            break
        rows = np.concatenate([rows, [f + [0] * (FEW - len(f)) for f in more]])
        fitted = nnls(rows, wanted, 100, fitted)
    return rows, fitted * scale


def pack_histogram(counts: dict[int, int], total: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, number of such sequences), together using each count exactly.

    Patterns that fill a sequence are fitted to the histogram and rounded, to the nearest or down. What is left is filled
    in shares (see ``_fill``) or packed best fit, longest first. Of these plans, filling alone and best fit alone, that of the fewest
    sequences is taken. The work and the result are bounded by ``total``, not by the number of documents.
    """
    have = np.zeros(total + 1, np.int64)
    for k, v in counts.items():
        have[k] += v
    rows, fitted = fitted_patterns(have, total)
    plans = []
    for repeats in (np.floor(fitted + 0.5), np.floor(fitted), np.zeros(len(rows))):
        for fill in (False, True):
            out, left = _rounded(rows, repeats, have.copy())
            if fill:
                _fill(left, out)
            _best_fit(left, out)
            plans.append(out)
    return sorted(min(plans, key=lambda p: sum(p.values())).items())


def _take(lengths: list[int], n: int, left: np.ndarray, out: Counter[tuple[int, ...]]) -> bool:
    """Use ``lengths`` n times, or as often as the counts ``left`` allow; whether they do at all."""
    need = Counter(lengths)
    n = min([n, *(int(left[x]) // k for x, k in need.items())])
    if n < 1:
        return False
    for x, k in need.items():
        left[x] -= n * k
    out[tuple(sorted(lengths, reverse=True))] += n
    return True


def _rounded(rows: np.ndarray, repeats: np.ndarray, left: np.ndarray) -> tuple[Counter[tuple[int, ...]], np.ndarray]:
    """Patterns used so often, most used first and as far as the counts ``left`` go, and what is left."""
    out: Counter[tuple[int, ...]] = Counter()
    for i in np.argsort(-repeats, kind="stable"):
        if repeats[i] < 1:
            break
        _take([x for x in rows[i].tolist() if x], int(repeats[i]), left, out)
    return out, left


def _fill(left: np.ndarray, out: Counter[tuple[int, ...]]) -> None:
    """Repair: each length that is left, longest first, takes the fullest sequence with it, a share of its count at a time.

    Of sequences that are as full, that of the lengths with most left is taken, so that all run out together. A round looks once for the
    best fillings and uses each of them for a share; rounds end when one places nothing.
    """
    total = len(left) - 1
    for turn in range(FILLS):
        lengths = np.flatnonzero(left[:total])
        if not len(lengths):
            return
        filling = Filling(lengths, lengths * (1 + 0.002 * left[lengths] / left[lengths].max()), total)
        most = np.zeros(total + 1, np.int64)
        for c in range(1, total + 1):
            most[c] = c if filling.best[c] > filling.best[most[c - 1]] else most[c - 1]
        placed = False
        for x in lengths[::-1].tolist():
            if left[x]:
                rest = filling.lengths(int(most[total - x]))
                if total - x - sum(rest) <= turn // SLACK:
                    placed |= _take([x, *rest], max(1, int(left[x]) // SHARE), left, out)
        if not placed and turn // SLACK > lengths[0]:
            return


def _best_fit(left: np.ndarray, out: Counter[tuple[int, ...]]) -> None:
    """Add to ``out`` the counts ``left``, longest first, each into the least space that holds it.

    Whole groups of one length and one free space are placed at a time.
    """
    total = len(left) - 1
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []

    def put(lengths: tuple[int, ...], n: int, space: int) -> None:
        if space == 0:
            out[lengths] += n
            return
        if space not in open_:
            insort(spaces, space)
        open_.setdefault(space, []).append((lengths, n))

    for x in range(total, 0, -1):
        n = int(left[x])
        while n:
            k = bisect_left(spaces, x)
            if k < len(spaces):
                space = spaces[k]
                lengths, m = open_[space].pop()
                if not open_[space]:
                    del open_[space], spaces[k]
                use = min(n, m)
                if m > use:
                    put(lengths, m - use, space)
            else:
                lengths, use, space = (), max(1, n // (total // x)), total
            put((*lengths, x), use, space - x)
            n -= use
    for bins in open_.values():
        for lengths, n in bins:
            out[lengths] += n


def slots(plan: list[tuple[tuple[int, ...], int]], total: int = LENGTH) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: ranks at which intervals begin, the sequence of the first rank there, the place in it."""
    taken: Counter[int] = Counter()
    found: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for lengths, n in plan:
        at = 0
        for x in lengths:
            found.setdefault(x, []).append((taken[x], base, at))
            taken[x] += n
            at += x
        base += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in found.items()}


def pack(pieces: DataFrame, total: int = LENGTH) -> DataFrame:
    """``pieces`` with sequence_id and offset; each piece has one place and sequences have no gaps.

    Only the histogram of lengths comes to the driver and only its plan, at most a few hundred thousand
    intervals at 1024, goes out. Pieces that fill a sequence are one each, by their place in the table (numbers below 0); those of
    another length are ranked in as many parts as its count asks for, so that a length that very many have is in no single task.
    ``pieces`` must be a written table, so that it has the same rows in the same places whenever it is read.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = spark.sparkContext.broadcast(slots(pack_histogram({k: n for k, n in counts.items() if k < total}, total), total))
    whole = pieces.where(F.col("length") >= total).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    keys = ["length", "salt"]
    deal = spark.createDataFrame([(k, 1 + n // RANKED) for k, n in counts.items() if k < total], "length long, parts long")
    rows = pieces.where(F.col("length") < total).join(F.broadcast(deal), "length")  # a row for each length below ``total``
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")).cast("int"))
    parts = rows.groupBy(*keys).count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy(*keys).orderBy("doc_id", "piece")
    ranked = rows.join(starts, keys).withColumn("rank", F.col("first") + F.row_number().over(within) - 1)
    ranked = ranked.select(*pieces.columns, "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for x in np.unique(n):
                own = n == x
                lo, base, at = plan.value[int(x)]
                k = np.searchsorted(lo, rank[own], "right") - 1
                sequence[own], offset[own] = base[k] + rank[own] - lo[k], at[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long").union(whole)


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """Tokenise (once: the pieces are written to the shared folder) and pack."""
    return pack(materialise(tokenised_pieces(docs, tokenizer, pattern), "pieces"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


ORACLE_SQL = None
