"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

Only a shingle that several documents have can be shared. So each document keeps those and their exact document
frequencies; all others, its own, count as one element of their joint weight, which changes no similarity
and no sample's chance to be shared.

By TF-IDF the copies of a large group are less alike than lone pairs with as many edits: what all of them have is frequent and weighs
little, and each one's edits are rare. Where that is not wanted, ``plain`` takes links by the Jaccard similarity of distinct shingles too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_batches, materialise, table
from gridloom.llm.graph import components, merged

WORDS = 5
SIMILARITY = 0.8
#: Links at the threshold that no band may join, at most; those above it are missed more rarely.
MISS = 0.002
#: Documents and shingles that are counted together before they are sent, and bytes of text whose shingles one group counts.
CHUNK_DOCS, CHUNK_PAIRS, GROUP_BYTES = 1 << 16, 1 << 20, 4 << 20
#: Members of a group that are compared with all others in a round; eight times more in each later one, in blocks of so many.
LEADERS = 256
#: Cells of the sums by which pairs are ruled out, and members of a group that one task compares with a block of leaders.
SKETCH, PART = 256, 1000
REMEMBERED = 150_000
CHUNK = 1 << 15
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def banding(similarity: float, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows of each: pairs at ``similarity`` agree in a band at a chance of 0.41 at most, and in none at ``miss`` at most.

    12 bands of 4 at 0.8 (1 - (1 - 0.8^4)^12 = 0.998), 22 of 2 at 0.5. Rows are at most 16, where 0.41 cannot be had.
    """
    if not 0 < similarity <= 1 or not 0 < miss < 1:
        raise ValueError("similarity must lie in (0, 1] and miss in (0, 1)")
    rows = 16 if similarity == 1 else min(16, max(1, math.ceil(math.log(0.41) / math.log(similarity))))
    return (1 if similarity == 1 else max(1, math.ceil(math.log(miss) / math.log1p(-(similarity**rows))))), rows


class Shingles:
    """Text to the distinct hashes of its runs of five words and how often each comes.

    Words are what white space parts, in lower case. Shorter texts are one shingle; without words there is none.
    """

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words, known = text.lower().split(), self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(min(len(h), 1), len(h) - WORDS + 1)
        out = np.zeros(n, np.uint64)
        for i in range(WORDS):
            own = h[i : i + n]
            out[: len(own)] = (out[: len(own)] ^ own) * _ODD[i]
            out ^= out >> np.uint64(31)
        return np.unique(out, return_counts=True)


def _gamma2(cells: int) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 at the middles of equal cells."""
    u = (np.arange(cells) + 0.5) / cells
    lo, hi = np.zeros(cells), np.full(cells, 60.0)
    for _ in range(60):
        x = (lo + hi) / 2
        below = 1 - (1 + x) * np.exp(-x) < u
        lo, hi = np.where(below, x, lo), np.where(below, hi, x)
    return (lo + hi) / 2


class Sampler:
    """ICWS: for each of n hashes, the shingle k and level t with the least ln a, as one integer for both.

    r and c follow the gamma distribution of shape 2 and beta is uniform; all come from one hash of
    shingle and number. t = floor(ln S / r + beta), ln a = ln c - r (t - beta + 1).
    """

    def __init__(self, n: int):
        self.seeds = [np.uint64(xxhash.xxh64_intdigest(str(i))) for i in range(n)]
        self.r = _gamma2(1 << 12).astype(np.float32)
        self.ln_c = np.log(_gamma2(1 << 16)).astype(np.float32)

    def __call__(self, keys: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(documents, n) samples; ``starts`` are where the documents' shingles begin, none being empty."""
        out = np.empty((len(self.seeds), len(starts)), np.int64)
        ln_s = np.log(weights).astype(np.float32)
        for lo in range(0, len(keys), CHUNK):
            k, s = keys[lo : lo + CHUNK], ln_s[lo : lo + CHUNK]
            first = np.searchsorted(starts, lo, "right") - 1
            last = np.searchsorted(starts, lo + len(k), "left")
            at = np.maximum(starts[first:last] - lo, 0)
            goes_on = starts[first] < lo
            for i, seed in enumerate(self.seeds):
                x = (k ^ seed) * _ODD[1]
                x ^= x >> np.uint64(32)
                x *= _ODD[2]
                x ^= x >> np.uint64(29)
                y = x.view(np.int64)
                r = self.r[y & 0xFFF]
                beta = ((y >> 12) & 0xFFF).astype(np.float32) * np.float32(1 / 4096)
                t = np.floor(s / r + beta)
                ln_a = self.ln_c[(y >> 24) & 0xFFFF] - r * (t - beta + 1)
                level = ((ln_a + 512) * np.float32(1 << 14)).astype(np.int64)
                mine = (y >> 40 ^ t.astype(np.int64) * 0x9E3779B1) & 0xFFFFFFFF
                least = np.minimum.reduceat(level << 32 | mine, at)
                if goes_on:
                    least[0] = min(least[0], out[i, first])
                out[i, first:last] = least
        return out.T & 0xFFFFFFFF


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray, float], b: tuple[np.ndarray, np.ndarray, float]) -> float:
    """Sum of the lesser over sum of the greater weights; a and b are sorted distinct shingles, their weights, and the weight of all."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    total = a[2] + b[2] - shared
    return shared / total if total > 0 else 0.0


def plain_jaccard(a: np.ndarray, of_a: int, b: np.ndarray, of_b: int) -> float:
    """Shared over all distinct shingles; a and b are those that others have too, of_a and of_b the numbers of all."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    total = of_a + of_b - shared
    return shared / total if total > 0 else 0.0


def idf(df: np.ndarray, documents: int) -> np.ndarray:
    """1 + log10((1 + N) / (1 + df)): at least 1, as no shingle is in more than N documents."""
    return (1 + np.log10((1 + documents) / (1 + df.astype(np.float64)))).astype(np.float32)


SENT = pa.schema([("dest", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int64()), *((c, pa.binary()) for c in ("keys", "docs", "counts", "many", "df"))])
SENT_SQL = "dest long, chunk long, kind long, keys binary, docs binary, counts binary, many binary, df binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(SENT), SENT)], schema=SENT)


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple]]:
    """Rows that have one value in column ``by``, which the rows are sorted by."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[-1][by] != row[by]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _pack(a: np.ndarray, rising: bool = False) -> bytes:
    """The bytes of an array (of the steps of a rising one) by their place in the number, compressed."""
    if rising and len(a):
        a = np.append(a[:1], np.diff(a))
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind: str, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    a = np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(a, dtype=kind) if rising else a


def _all(parts: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _counted(rows: DataFrame, groups: int) -> DataFrame:
    """Shingles of chunks of documents, sent to the group that counts them (kind 0), and what the chunk itself needs (kind 1).

    A shingle that one document of the chunk has goes with that document and its count, one that more have only once
    with their number: these pairs stay with the chunk. So no group gets more than a row a chunk, however common a shingle is.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, part, chunk = Shingles(), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        known: list[tuple] = []
        pairs = 0

        def send() -> pa.RecordBatch:
            sizes = np.array([len(k) for k, _ in held], np.int64)
            keys, counts = (np.concatenate([h[j] for h in held]) for j in (0, 1))
            docs = np.repeat(np.arange(len(held)), sizes)
            totals = np.array([c.sum() for _, c in held], np.int64)
            order = np.argsort(keys, kind="stable")
            keys, counts, docs = keys[order], counts[order], docs[order]
            new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(keys)))
            direct = np.repeat((n > 1) | (counts[first] > 255), n)
            lone, once = ~direct, new & direct
            at = TaskContext.get().partitionId() << 32 | chunk
            ids = [(x is not None, x or 0, d, n) for x, d, n in known]
            own = (
                np.array([x[1] for x in ids], "<i8").tobytes(), np.array([x[0] for x in ids], "u1").tobytes() + b"".join(x[2] for x in ids) + np.array([x[3] for x in ids], "<i8").tobytes(),
                totals.astype("<i8").tobytes() + sizes.astype("<i8").tobytes(), keys[direct].astype("<u8").tobytes(), docs[direct].astype("<u4").tobytes() + counts[direct].astype("<u4").tobytes(),
            )
            out = [(-1 - at, at, 1, *own)]
            group = (keys >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
            cuts = np.searchsorted(group, np.arange(groups + 1, dtype=np.uint64))
            for g in np.flatnonzero(np.diff(cuts)).tolist():
                cut = slice(cuts[g], cuts[g + 1])
                a, b = lone[cut], once[cut]
                numbers = n[np.searchsorted(first, np.flatnonzero(b) + cuts[g])]
                out.append((g, at, 0, _pack(keys[cut][a], True), _pack(docs[cut][a].astype("<u2")), _pack(counts[cut][a].astype("u1")), _pack(keys[cut][b], True), _pack(numbers.astype("<u4"))))
            return _sent(out)

        for b in batches:
            for doc_id, digest, n, text in zip(*(b.column(c).to_pylist() for c in range(4))):
                held.append(shingles(text))
                known.append((doc_id, digest, n))
                pairs += len(held[-1][0])
                if pairs >= CHUNK_PAIRS or len(held) >= CHUNK_DOCS:
                    yield send()
                    held, known, pairs, chunk = [], [], 0, chunk + 1
        if held:
            yield send()

    return rows.select("doc_id", "digest", "n", "text").mapInArrow(scan, SENT_SQL)


def _answered(sent: DataFrame) -> DataFrame:
    """For each chunk, its shingles that several documents have, with the document frequency (kind 0); rows of kind 1 pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 0):
            if rows[0][2] == 1:
                yield _sent(rows)
                continue
            lones, manies = ([_unpack(r[c], "<u8", True) for r in rows] for c in (3, 6))
            lone = np.concatenate(lones)
            keys = np.concatenate((lone, *manies))
            n = np.concatenate((np.ones(len(lone), np.int64), *(_unpack(r[7], "<u4").astype(np.int64) for r in rows)))
            order = np.argsort(keys)
            new = np.append(True, keys[order][1:] != keys[order][:-1])[: len(keys)]
            df = np.empty(len(keys), np.int64)
            df[order] = np.add.reduceat(n[order], np.flatnonzero(new))[np.cumsum(new) - 1] if len(keys) else 0
            out, i, j = [], 0, len(lone)
            for r, one, more in zip(rows, lones, manies):
                a, b = len(one), len(more)
                shared = df[i : i + a] > 1
                if shared.any() or b:
                    found = np.concatenate((df[i : i + a][shared], df[j : j + b])).astype("<u8")
                    out.append((0, r[1], 0, _pack(one[shared], True), _pack(_unpack(r[4], "<u2")[shared]), _pack(_unpack(r[5], "u1")[shared]), r[6], _pack(found)))
                i, j = i + a, j + b
            yield _sent(out)

    return sent.repartition("dest").sortWithinPartitions("dest").mapInArrow(count, SENT_SQL)


SIGNED = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("shingles", pa.binary()), ("weights", pa.binary()), ("total", pa.float64()), ("kinds", pa.int64()), ("prefix", pa.list_(pa.int64()))])
SIGNED_SQL = "doc_id long, digest binary, n long, keys array<long>, shingles binary, weights binary, total double, kinds long, prefix array<long>"


def signatures(docs: DataFrame, similarity: float = SIMILARITY, miss: float = MISS, plain: bool = False) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text): digest and length of the text, a key for each band, and for
    verification the shingles that others have too, their weights (count x idf), the weight of all, how many are distinct, and the prefix.
    ``plain`` adds as many bands in which each distinct shingle weighs 1; keys and prefix then serve both similarities.

    Document frequencies are exact and of all documents. A document whose shared shingles weigh too little for any
    similarity to reach the threshold has no keys. The prefix is the rarest shingles, so many that without them the rest weighs less
    than the threshold asks: similar texts have one of it in common.
    """
    bounded_batches(docs.sparkSession)
    bands, rows = banding(similarity, miss)
    text = F.coalesce("text", F.lit(""))
    documents, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).collect()[0]
    own = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n"), text.alias("text"))
    answers = _answered(_counted(own, 1 + (size or 0) // GROUP_BYTES))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(bands * rows)
        rest_weight = float(idf(np.array([1]), documents)[0])
        for got in _groups(batches, 1):
            table_ = next(r for r in got if r[2] == 1)
            ids = np.frombuffer(table_[3], "<i8")
            m = len(ids)
            valid, digests, lengths = np.frombuffer(table_[4], "u1", m), table_[4][m : 33 * m], np.frombuffer(table_[4], "<i8", m, 33 * m)
            (totals, kinds), direct = np.frombuffer(table_[5], "<i8").reshape(2, m), np.frombuffer(table_[6], "<u8")
            answers = [r for r in got if r[2] == 0]
            lone, many, dfs = ([_unpack(r[c], "<u8", c < 7) for r in answers] for c in (3, 6, 7))
            many_key = _all(many, "<u8")
            many_df = _all([d[len(k) :] for d, k in zip(dfs, lone)], "<u8")
            order = np.argsort(many_key)
            direct_df = many_df[order][np.searchsorted(many_key[order], direct)] if len(direct) else np.empty(0, np.uint64)
            both = np.frombuffer(table_[7], "<u4")
            shared = direct_df > 1
            key = np.concatenate((*lone, direct[shared]))
            doc = np.concatenate((*(_unpack(r[4], "<u2").astype(np.int64) for r in answers), both[: len(direct)][shared].astype(np.int64)))
            count = np.concatenate((*(_unpack(r[5], "u1").astype(np.int64) for r in answers), both[len(direct) :][shared].astype(np.int64)))
            df = np.concatenate([d[: len(k)] for d, k in zip(dfs, lone)] + [direct_df[shared]])
            order = np.lexsort((key, doc))
            key, doc, count, df = key[order], doc[order], count[order], df[order]
            weight = (count * idf(df, documents)).astype(np.float32)
            rest = (totals - np.bincount(doc, count, m)) * rest_weight
            total = np.bincount(doc, weight, m) + rest
            measures = [(weight, rest, total)]
            if plain:
                measures.append((np.ones(len(key), np.float32), kinds - np.bincount(doc, minlength=m), kinds))
            near = np.any([of_all - own >= similarity * of_all * 0.999999 for _, own, of_all in measures], axis=0) & (total > 0) & (valid > 0)
            take, which = near[doc], np.flatnonzero(near)
            banded = []
            for number, (each, own, _) in enumerate(measures):
                # the samplers' input: the shared shingles of near documents, and one more of its own for each that has a rest
                has = near & (own > 0)
                mine = np.array([int.from_bytes(digests[32 * i : 32 * i + 8], "little") for i in np.flatnonzero(has).tolist()], np.uint64)
                all_doc = np.concatenate((doc[take], np.flatnonzero(has)))
                order = np.argsort(all_doc, kind="stable")
                all_key, all_weight = np.concatenate((key[take], mine))[order], np.concatenate((each[take], own[has].astype(np.float32)))[order]
                if len(which):
                    samples = sampler(all_key, all_weight, np.searchsorted(all_doc[order], which)).reshape(len(which), bands, rows).astype(np.uint64)
                    mixed = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(number * bands), (len(which), bands)) * _ODD[0]
                    for i in range(rows):
                        mixed = (mixed ^ samples[:, :, i]) * _ODD[1 + i % 4]
                        mixed = mixed ^ mixed >> np.uint64(29)
                    banded.append(mixed.view(np.int64))
            at = dict(zip(which.tolist(), np.hstack(banded))) if banded else {}
            cuts = np.searchsorted(doc, np.arange(m + 1))
            out = []
            for i in range(m):
                row = (int(ids[i]) if valid[i] else None, digests[32 * i : 32 * i + 32], int(lengths[i]))
                if i in at:
                    cut = slice(cuts[i], cuts[i + 1])
                    k, w = key[cut], weight[cut]
                    rare = np.lexsort((k, df[cut]))
                    without = [np.cumsum(each[cut][rare][::-1], dtype=np.float64)[::-1] >= similarity * of_all[i] * 0.999999 for each, _, of_all in measures]
                    row += (at[i], k.tobytes(), w.astype("<f4").tobytes(), float(total[i]), int(kinds[i]), k[rare][np.any(without, axis=0)].view(np.int64))
                else:
                    row += (None, None, None, None, None, None)
                out.append(row)
                if len(out) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SIGNED)], schema=SIGNED)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SIGNED)], schema=SIGNED)

    return answers.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(sign, SIGNED_SQL)


def _vector(shingles: bytes, weights: bytes, total: float) -> tuple[np.ndarray, np.ndarray, float]:
    return np.frombuffer(shingles, "<u8"), np.frombuffer(weights, "<f4"), total


def verified(pairs: DataFrame, vectors: DataFrame, similarity: float, plain: bool = False) -> DataFrame:
    """The pairs (leader, node) that are similar enough, as links (a, b, similarity), a < b; with ``plain`` the greater similarity counts.

    ``pairs`` has parts, in how many a leader's nodes are dealt: its vector goes to each of them, so that no task has to hold or sort
    all nodes of one leader.
    """
    pairs = materialise(pairs, "pairs")
    bounded_batches(pairs.sparkSession, 256)
    deal = F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int").alias("part")
    heads = pairs.groupBy("leader").agg(F.max("parts").alias("parts")).select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    heads = heads.join(vectors.toDF("leader", "s", "w", "t", "k").hint("merge"), "leader")
    both = pairs.select("leader", "node", deal).join(vectors.hint("merge"), "node").join(heads.hint("merge"), ["leader", "part"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            found = []
            for leader, node, s, w, t, k, *own, kinds in zip(*(c.to_pylist() for c in batch.columns)):
                if leader != last:
                    last, left = leader, _vector(s, w, t)
                right = _vector(*own)
                alike = weighted_jaccard(left, right)
                if plain:
                    alike = max(alike, plain_jaccard(left[0], k, right[0], kinds))
                if alike >= similarity:
                    found.append((min(leader, node), max(leader, node), alike))
            columns = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    return both.select("leader", "node", "s", "w", "t", "k", "shingles", "weights", "total", "kinds").mapInArrow(check, "a long, b long, similarity double")


def sketches(vectors: DataFrame, plain: bool = False) -> DataFrame:
    """node, and the weights of its shared shingles summed in SKETCH cells (``plain``: their numbers in as many more), and those of all."""
    bounded_batches(vectors.sparkSession)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = []
            for s, w in zip(b.column("shingles").to_pylist(), b.column("weights").to_pylist()):
                k = np.frombuffer(s, "<u8") & np.uint64(SKETCH - 1)
                sums = [np.frombuffer(w, "<f4"), None] if plain else [np.frombuffer(w, "<f4")]
                cells.append(b"".join(np.bincount(k.astype(np.int64), each, SKETCH).astype("<f4").tobytes() for each in sums))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(cells, pa.binary()), b.column("total"), b.column("kinds")], ["node", "cells", "total", "kinds"])

    return vectors.mapInArrow(sum_up, "node long, cells binary, total double, kinds long")


def possible(state: DataFrame, known: DataFrame, had: int, most: int, similarity: float, plain: bool = False) -> DataFrame:
    """Pairs (leader, node, parts) of one group but different classes that can be similar enough.

    Leaders of a group are the members whose hashed ids fall in its share most / size and not in had / size, those
    before. Two texts share at most the sum of their lesser cells; pairs whose similarity cannot reach the
    threshold by that (``plain``: neither of theirs) go no further. Members are dealt in parts of about PART, leaders in blocks of about LEADERS, and a task
    has one part and one block.
    """
    turn = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30) * F.col("size")
    rows = state.join(known, "node").where(turn >= had)
    leads, own_block = turn < most, F.floor((turn - had) / LEADERS).cast("int")
    parts = F.ceil(F.col("size") / PART).cast("int")
    blocks = F.greatest(F.ceil((F.least("size", F.lit(most)) - had) / LEADERS), F.lit(1)).cast("int")
    rows = rows.select("key", "node", "root", "cells", "total", "kinds", leads.alias("leads"), own_block.alias("own_block"), F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int").alias("own_part"), parts.alias("parts"), blocks.alias("blocks"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.col("own_part").alias("part"), b.alias("block"), F.lit(True).alias("member"), (F.col("leads") & (b == F.col("own_block"))).alias("leader")))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.col("leads") & (p != F.col("own_part")))
    as_leader = F.transform(others, lambda p: F.struct(p.alias("part"), F.col("own_block").alias("block"), F.lit(False).alias("member"), F.lit(True).alias("leader")))
    placed = rows.select("key", F.explode(F.concat(as_member, as_leader)).alias("at"), "node", "root", "cells", "total", "kinds").select("key", "at.part", "at.block", "at.member", "at.leader", "node", "root", "cells", "total", "kinds")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: list[tuple]) -> list[np.ndarray]:
            member, leader = (np.array([r[i] for r in rows], bool) for i in (3, 4))
            ids, roots = np.array([r[5] for r in rows], np.int64), np.array([r[6] for r in rows], np.int64)
            if not leader.any() or (roots == roots[0]).all():
                return []
            y = np.frombuffer(b"".join(r[7] for r in rows), "<f4").reshape(len(rows), -1)
            measures = [(y[:, SKETCH * j : SKETCH * (j + 1)], np.array([r[8 + j] for r in rows])) for j in range(1 + plain)]
            out = []
            for i in np.flatnonzero(leader).tolist():
                can = np.zeros(len(rows), bool)
                for cells, totals in measures:
                    both = (totals + totals[i]) * (similarity / (1 + similarity))
                    ok = np.flatnonzero(member & ~can & (roots != roots[i]) & (np.minimum(totals, totals[i]) >= both * 0.9999))
                    can[ok[np.minimum(cells[ok], cells[i]).sum(1) >= both[ok] * 0.9999]] = True
                ok = np.flatnonzero(can)
                out.append(np.stack([np.full(len(ok), ids[i]), ids[ok]]))
            return out

        def send(found: list[np.ndarray]) -> pa.RecordBatch:
            a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["leader", "node"])

        held: list[tuple] = []
        for b in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][:3] != row[:3]:
                    found += settle(held)
                    held = []
                held.append(row)
            yield send(found)
        if held:
            yield send(settle(held))

    dealt = placed.repartition("key", "part", "block").sortWithinPartitions("key", "part", "block")
    return dealt.mapInArrow(compare, "leader long, node long").distinct().withColumn("parts", F.lit(1))


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (key, node) of the groups that have more than one class, with root and the group's size."""
    rows = members.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("key", "size")
    return rows.join(mixed, "key")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text", plain: bool = False) -> DataFrame:
    """Per row: doc_id, class_id (smallest id of the class) and kept (whether the two are the same); see ``near_links``."""
    return near_links(docs, similarity, miss, id_col, text_col, plain)[0].drop("node")


def near_links(docs: DataFrame, similarity: float = SIMILARITY, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text", plain: bool = False) -> tuple[DataFrame, DataFrame]:
    """Classes (doc_id, node, class_id, kept: a row for each of ``docs``) and links (a, b, similarity) between nodes.

    A node is a text, named by its smallest id. Links are those that make the classes, each verified: all others join nodes that these
    join already, so that very many near copies cost a few links each. Bands and rows follow the threshold (``banding``).

    Classes are the components of links between texts at ``similarity`` or more: by TF-IDF, and with ``plain`` also by the Jaccard
    similarity of their distinct shingles, which the size of a group of copies does not lower. Equal texts are one node.
    A bucket (texts that share a band) is first compared with its most central member, that which has the
    most texts in its buckets; what these links join is one class. Members of buckets with more than one class are grouped
    anew, by each shingle of their prefixes, and groups with more than one class go on:
    LEADERS of their members, then eight times more and so on to all of them, are compared with every member of
    another class, but for pairs that a bound rules out. So no link of a bucket is missed
    and yet a bucket of very many near copies costs a few comparisons a member. Work grows with the square
    only of groups of different texts that have a rare shingle in common. Buckets, vectors and links stay distributed.

    Null text counts as empty; texts without words are alike only if equal. Rows with a null id have a null
    class and are kept, and count in document frequencies. Rows that share an id are one document: they get one class, and that of their texts
    with the least digest stands for it. Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialise(signatures(docs, similarity, miss, plain), "signatures")
    vector = ["keys", "shingles", "weights", "total", "kinds", "prefix"]
    nodes = signed.where("doc_id is not null").groupBy("digest", "n").agg(F.min("doc_id").alias("node"))
    nodes = materialise(nodes, "nodes")
    standing = nodes.groupBy("node").agg(F.min("digest").alias("digest"))
    full = signed.where("keys is not null").join(standing.withColumnRenamed("node", "doc_id"), ["doc_id", "digest"]).select(F.col("doc_id").alias("node"), *vector)
    full = full.dropDuplicates(["node"])  # equal rows of a repeated row
    placed = full.select("node", F.posexplode("keys").alias("band", "key"))
    shared = placed.groupBy("key", "band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    met = materialise(placed.drop("band").join(shared.select("key", "size"), "key"), "met")
    met = met.join(met.groupBy("node").agg(F.sum("size").alias("degree")), "node")
    central = met.groupBy("key", "size").agg(F.max(F.struct("degree", (-F.col("node")).alias("node"))).alias("first")).select("key", (-F.col("first.node")).alias("leader"))
    buckets = materialise(met.drop("degree").join(central, "key"), "buckets")
    vectors = materialise(full.join(buckets.select("node").distinct().hint("merge"), "node").drop("keys"), "vectors")
    lean = vectors.drop("prefix")
    pairs = buckets.where("node <> leader").groupBy("leader", "node").agg(F.ceil(F.max("size") / PART).cast("int").alias("parts"))
    links = materialise(verified(pairs, lean, similarity, plain), "links")
    roots = components(links)
    rest = _open(buckets, roots).select("node").distinct()
    groups = materialise(vectors.join(rest, "node", "left_semi").select("node", F.explode("prefix").alias("key")), "groups")
    members = groups.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("y"))
    once = members.where("size > 1").groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key")  # of groups with the same members, one
    groups = materialise(groups.join(once, "key"), "groups")
    had, most, known = 0, LEADERS, None
    while True:
        state = materialise(_open(groups, roots), "open")
        largest = state.agg(F.max("size")).collect()[0][0] or 0
        if had >= largest:
            break
        if known is None:
            known = materialise(sketches(lean.join(state.select("node").distinct(), "node", "left_semi"), plain), "sketches")
        near = materialise(verified(possible(state, known, had, most, similarity, plain), lean, similarity, plain), "links")
        if not near.isEmpty():
            links = links.union(near)
            roots = merged(roots, near)
        had, most = most, 8 * most
    classes = nodes.join(roots, "node", "left").select("digest", "node", F.coalesce("root", "node").alias("class_id"))
    rows_ = signed.select("doc_id", "digest").join(classes, "digest", "left")
    node, class_id = (F.when(F.col("doc_id").isNotNull(), F.col(c)) for c in ("node", "class_id"))
    return rows_.select("doc_id", node.alias("node"), class_id.alias("class_id"), F.col("doc_id").eqNullSafe(class_id).alias("kept")), links


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, md5(coalesce(text, '')) AS same, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, 1 + greatest(least(len(w), 1), len(w) - {WORDS - 1}))) AS i FROM worded
), counted AS (
  SELECT doc_id, md5_number(array_to_string(w[i : i + {WORDS - 1}], ' ')) AS g, count(*) AS c FROM places GROUP BY ALL
), frequent AS (
  SELECT g, count(*) AS df FROM counted GROUP BY g
), weighed AS (
  SELECT doc_id, g, df, c * (1 + log10((1 + (SELECT count(*) FROM documents)) / (1 + df))) AS weight FROM counted JOIN frequent USING (g)
), totals AS (
  SELECT doc_id, sum(weight) AS total FROM weighed GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.weight, b.weight)) AS both_
  FROM weighed a JOIN weighed b ON a.g = b.g AND a.doc_id < b.doc_id WHERE a.df > 1 GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN totals x ON a = x.doc_id JOIN totals y ON b = y.doc_id WHERE both_ >= {SIMILARITY} * (x.total + y.total - both_)
  UNION
  SELECT min(doc_id) OVER (PARTITION BY same) AS a, doc_id AS b FROM worded
), sides AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a WHERE s.b <> r.a
), classes AS (
  SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a
)
SELECT doc_id, class_id, doc_id = class_id AS kept FROM classes
"""
