"""Removal of repeated byte strings, found by suffix arrays of shards.

Every string of ``length`` bytes contains a minimizer, the k-gram with the least hash among its own, which equal
strings share. A document is cut into segments of successive strings with one minimizer; segments whose
minimizer comes once in the corpus cannot repeat, and those of one minimizer meet in one shard, whose suffix
array and permuted common prefixes tell which strings are equal. Of segments that are equal as a whole one goes there and
the others are removed, after their bytes were compared with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count as numbers

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import BATCH_ROWS, bounded_batches, materialise, table
from gridloom.llm.suffixsort import permuted_lcp, suffix_array

LENGTH = 100
#: Text positions that are hashed at a time, segments that a scan holds before it sends them, and bytes of a shard's suffix array.
CHUNK, HELD, SHARD = 1 << 17, 1 << 20, 1 << 17
#: Different segments of one minimizer beyond which they are parted by longer contexts, and how many offsets of the minimizer
#: within a string have one context in each round; with one, equal strings only.
CROWD, WIDTHS = 20_000, (16, 4, 1)
#: To deal segments evenly, one of so many documents is looked at for minimizers that come at least so often there.
LOOK, OFTEN = 16, 64
REMOVED, SEGMENT, CROWDED, REPEATED = 0, 1, 2, 3

_BASE = 0x9E3779B97F4A7C15


def _table(seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([i]), seed) for i in range(256)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _span_hashes(letters: np.ndarray, sizes: set[int]) -> dict[int, np.ndarray]:
    """Hashes of the spans of each of ``sizes`` letters at every position, by doubling."""
    found, need = {1: letters}, max(sizes)
    power = 1
    while 2 * power <= need:
        h = found[power]
        found[2 * power] = h[:-power] * np.uint64(pow(_BASE, power, 1 << 64)) + h[power:]
        power *= 2
    out = {}
    for size in sizes:
        h, at = None, 0
        for p in sorted(found, reverse=True):
            while at + p <= size:
                own = found[p][at:]
                if h is None:
                    h = own
                else:
                    m = min(len(h), len(own))
                    h = h[:m] * np.uint64(pow(_BASE, p, 1 << 64)) + own[:m]
                at += p
        out[size] = h
    return out


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    power = 1
    while 2 * power <= width:
        x = np.minimum(x[:-power], x[power:])
        power *= 2
    rest = width - power
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int = LENGTH, seed: int = 0) -> tuple[np.ndarray, ...]:
    """Segments of documents that lie behind each other in ``data``: document's number, start in it, strings,
    bytes from the start to the minimizer, minimizer, content hash."""
    gram = max(1, length // 5)
    width = length - gram + 1
    block = 1 << (min(length, 64).bit_length() - 1)
    places = -(-(2 * length - gram) // block)
    parts: list[tuple[np.ndarray, ...]] = []
    last = len(data) - length + 1
    owner_ends = starts + sizes
    letters = _table(seed)
    for lo in range(0, max(0, last), CHUNK):
        n = min(CHUNK, last - lo)
        piece = data[lo : lo + n + 2 * length]
        hashes = _span_hashes(letters[piece], {gram, block})
        grams, blocks = _mix(hashes[gram]), hashes[block]
        key = (grams >> np.uint64(24) << np.uint64(18)) | np.arange(len(grams), dtype=np.uint64)
        least = (_sliding_least(key, width)[:n] & np.uint64((1 << 18) - 1)).astype(np.int64)
        at = lo + np.arange(n)
        owner = np.searchsorted(starts, at, "right") - 1
        inside = at + length <= owner_ends[owner]
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new & inside)
        if not len(first):
            continue
        stop = np.flatnonzero(np.append(new | ~inside, True))
        count = stop[np.searchsorted(stop, first, "right")] - first
        span = count + length - 1
        content = span.astype(np.uint64)
        for i in range(places):
            content = _mix(content * np.uint64(_BASE) + blocks[first + (span - block) * i // max(1, places - 1)])
        parts.append((owner[first], lo + first - starts[owner[first]], count, least[first] - first, grams[least[first]].view(np.int64), content.view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.empty(0, np.int64),) * 6


def _later(*keys: np.ndarray) -> np.ndarray:
    """Rows are sorted by ``keys``: which have the keys of the row before."""
    out = np.zeros(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
    return out


def _rows(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Ids, starts and sizes of the texts of a batch that are not empty, and the texts behind each other."""
    texts = b.column(1).to_pylist()
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    some = sizes > 0
    return b.column(0).to_numpy()[some], starts[some], sizes[some], b"".join(texts)


def _often(docs: DataFrame, length: int, seed: int) -> np.ndarray:
    """Minimizers that a part of the documents has very often, at most 2^14. This decides only where segments are dealt."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, starts, sizes, text = _read(b)
            keys, n = np.unique(segments(np.frombuffer(text, np.uint8), starts, sizes, length, seed)[4], return_counts=True)
            yield _rows(["key", "n"], [keys, n])

    seen = docs.where(F.xxhash64("doc_id").bitwiseAND(F.lit(LOOK - 1)) == 0).mapInArrow(look, "key long, n long")
    seen = seen.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    return np.array(sorted(r.key for r in seen.orderBy(F.desc("n"), "key").limit(1 << 14).collect()), np.int64)


SCANNED = ["key", "content", "doc_id", "start", "span"]


def _scan(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """Segments of all documents (span: strings << 16 | bytes before the minimizer << 8 | kind).

    Of segments in a task that are equal, by hash and then by their bytes, all but the first are removed at
    once, as runs of strings. A segment at the same place of the same document, of a row that is repeated, is no other
    one and is left out. Segments of minimizers that come very often are dealt by their content."""
    hot = docs.sparkSession.sparkContext.broadcast(_often(docs, length, seed))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[bytes] = []
        base = 0

        def send() -> pa.RecordBatch:
            doc, start, count, off, key, content, at = (np.concatenate(c) for c in zip(*held))
            data = memoryview(b"".join(texts))
            held.clear()
            texts.clear()
            order = np.lexsort((start, doc, content, key))
            order = order[~_later(key[order], content[order], doc[order], start[order])]
            doc, start, count, off, key, content, at = (c[order] for c in (doc, start, count, off, key, content, at))
            again = _later(key, content)
            first = np.maximum.accumulate(np.where(again, 0, np.arange(len(key))))
            rows = np.flatnonzero(again)
            rows = rows[np.argsort(at[rows], kind="stable")]
            n, here, there = count[rows], at[rows], at[first[rows]]
            new = np.ones(len(rows), bool)
            new[1:] = (here[1:] != here[:-1] + n[:-1]) | (there[1:] != there[:-1] + n[:-1])
            begin = np.flatnonzero(new)
            total = np.add.reduceat(n, begin) if len(begin) else n
            equal = np.array([data[a : a + k] == data[b : b + k] for a, b, k in zip(here[begin].tolist(), there[begin].tolist(), (total + length - 1).tolist())], bool)
            again[rows[~np.repeat(equal, np.diff(np.append(begin, len(rows))))]] = False  # a collision: to be compared with all others
            runs, own = rows[begin[equal]], ~again
            crowded = np.isin(key, hot.value)
            route = np.where(crowded, _mix((key ^ content * _BASE_SIGNED).view(np.uint64)).view(np.int64), key)
            spread = _mix((doc * 1_000_003 + start).view(np.uint64)).view(np.int64)
            columns = [
                (spread[runs], route[own]), (0 * runs, content[own]), (doc[runs], doc[own]), (start[runs], start[own]),
                (total[equal] << 16 | REMOVED, count[own] << 16 | off[own] << 8 | np.where(crowded[own], CROWDED, SEGMENT)),
            ]
            return _rows(SCANNED, [np.concatenate(c) for c in columns])

        n = 0
        for b in batches:
            ids, starts, sizes, text = _read(b)
            owner, start, count, off, key, content = segments(np.frombuffer(text, np.uint8), starts, sizes, length, seed)
            held.append((ids[owner], start, count, off, key, content, base + starts[owner] + start))
            texts.append(text)
            base, n = base + len(text), n + len(owner)
            if n >= HELD:
                yield send()
                base = n = 0
        if n:
            yield send()

    return docs.mapInArrow(scan, ", ".join(f"{c} long" for c in SCANNED))


_BASE_SIGNED = np.int64(_BASE - (1 << 64))
SIFTED = ["kind", "key", "doc_id", "start", "strings", "off", "ref_doc", "ref_start"]


def _sift(scanned: DataFrame) -> DataFrame:
    """Drop segments whose minimizer has one content, once; let equal ones refer to the first; keep the rest to be compared.

    As in _scan, the same place of the same document counts once."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        crowded = last = None

        def settle(rows: np.ndarray) -> pa.RecordBatch:
            nonlocal last
            key, content, doc, start, span = rows
            kind = span & 255
            done = kind == REMOVED
            again = _later(key, content) & ~done
            same_place = _later(key, content, doc, start) & ~done
            goes_on = last is not None and last[:2] == (key[0], content[0]) and not done[0]
            if goes_on:
                again[0], same_place[0] = True, last[2:4] == (doc[0], start[0])
            first = np.maximum.accumulate(np.where(again, 0, np.arange(len(key))))
            ref_doc, ref_start = doc[first], start[first]
            if goes_on:
                lead = int(np.argmin(again)) if not again.all() else len(key)
                ref_doc[:lead], ref_start[:lead] = last[4:]
            last = (key[-1], content[-1], doc[-1], start[-1], ref_doc[-1], ref_start[-1])
            lone = ~again & ~done
            k = key[lone]
            beside = np.zeros(len(k), bool)
            if len(k) > 1:
                same = k[1:] == k[:-1]
                beside[1:] = same
                beside[:-1] |= same
            hot = (kind[lone] == CROWDED) | (k == crowded if crowded is not None else False)
            out = np.where(done, REMOVED, np.where(again & ~same_place, REPEATED, -1))
            out[lone] = np.where(hot, CROWDED, np.where(beside, SEGMENT, -1))
            keep = out >= 0
            return _rows(SIFTED, [x[keep] for x in (out, key, doc, start, span >> 16, span >> 8 & 255, ref_doc, ref_start)])

        held = 0
        for b in batches:
            rows = np.stack([b.column(c).to_numpy() for c in range(5)])
            if not rows.shape[1]:
                continue
            pending.append(rows)
            held += rows.shape[1]
            if held < CROWD:
                continue
            rows = np.concatenate(pending, axis=1)
            cut = int(np.flatnonzero(rows[0] != rows[0, -1])[-1] + 1) if rows[0, 0] != rows[0, -1] else 0
            if cut:
                yield settle(rows[:, :cut])
                crowded, rows = None, rows[:, cut:]
            if rows.shape[1] >= CROWD or crowded is not None:
                crowded = rows[0, -1]
                yield settle(rows)
                rows = rows[:, :0]
            pending, held = [rows], rows.shape[1]
        if held:
            yield settle(np.concatenate(pending, axis=1))

    return scanned.repartition("key").sortWithinPartitions("key", "content", "doc_id", "start").mapInArrow(sift, ", ".join(f"{c} long" for c in SIFTED))


def _runs(repeated: DataFrame) -> DataFrame:
    """Neighbouring segments that refer to neighbouring ones of one document, as one run each."""
    names = ["doc_id", "start", "strings", "ref_doc", "ref_start"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            doc, start, n, ref, at = (b.column(c).to_numpy() for c in names)
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1]) | (start[1:] != start[:-1] + n[:-1]) | (at[1:] != at[:-1] + n[:-1])
            first = np.flatnonzero(new)
            yield _rows(names, [doc[first], start[first], np.add.reduceat(n, first), ref[first], at[first]])

    rows = repeated.select(*names).repartition("doc_id").sortWithinPartitions("doc_id", "ref_doc", F.col("ref_start") - F.col("start"), "start")
    return rows.mapInArrow(merge, ", ".join(f"{c} long" for c in names))


COMPARED = pa.schema([("kind", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("strings", pa.int64()), ("off", pa.int64()), ("content", pa.binary())])
COMPARED_SQL = "kind long, key long, doc_id long, start long, strings long, off long, content binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(COMPARED), COMPARED)], schema=COMPARED)


def _split(crowded: DataFrame, length: int, width: int) -> DataFrame:
    """Segments cut into strings whose minimizer lies at ``width`` neighbouring offsets; all that these contain for sure is their key.

    Equal strings have the same offset and so the same key. Of equal pieces in a batch all but the first are removed at once."""
    furthest = length - max(1, length // 5)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for doc, start, strings, off, content in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "strings", "off", "content"))):
                for lo in range(max(0, off - strings + 1) // width * width, off + 1, width):
                    hi = min(lo + width - 1, furthest)
                    a, z = off - min(off, hi), off - max(off - strings + 1, lo)
                    key = xxhash.xxh3_64_intdigest(content[off - lo : off - hi + length], lo) - (1 << 63)
                    found.append((key, content[a : z + length], doc, start + a, z - a + 1, off - a))
            found.sort()
            rows = [
                (REMOVED, hash((x[2], x[3])), *x[2:], None) if i and found[i - 1][:2] == x[:2] else (SEGMENT, x[0], *x[2:], x[1])
                for i, x in enumerate(found)
            ]
            yield _batch(rows)

    return crowded.select("doc_id", "start", "strings", "off", "content").mapInArrow(split, COMPARED_SQL)


def _compare(contents: DataFrame, length: int, most: int) -> DataFrame:
    """Suffix arrays of whole minimizer groups, about SHARD bytes at a time: the strings that also start earlier (REMOVED).

    A group of more than ``most`` different segments is given back (CROWDED)."""

    def repeats(doc: np.ndarray, start: np.ndarray, texts: list[bytes]) -> list[tuple]:
        sizes = np.array([len(x) + 1 for x in texts], np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
        own = np.repeat(np.arange(len(texts)), sizes)
        sa = suffix_array(data)
        whole = sa + length < ends[own[sa]]
        sa_whole = sa[whole]
        joined = permuted_lcp(data, sa, length)[sa_whole] >= length
        group = np.cumsum(~joined) - 1
        at_doc, at_start = doc[own[sa_whole]], start[own[sa_whole]] + sa_whole - (ends - sizes)[own[sa_whole]]
        order = np.lexsort((at_start, at_doc, group))
        first = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))[group]
        later = (at_doc > at_doc[order][first]) | (at_start > at_start[order][first])
        again = np.sort(sa_whole[later])
        new = np.flatnonzero(np.append(True, np.diff(again) != 1)) if len(again) else np.empty(0, np.int64)
        piece = own[again[new]]
        columns = doc[piece], start[piece] + again[new] - (ends - sizes)[piece], np.diff(np.append(new, len(again)))
        return [(REMOVED, None, *x, None, None) for x in zip(*(c.tolist() for c in columns))]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = begun = 0
        last = content = crowded = None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                kind, key, doc, start, strings, off, x = row
                if kind == REMOVED:
                    out.append(row)
                    continue
                if key != last:
                    if size >= SHARD:
                        out += repeats(*_arrays(held))
                        held, size = [], 0
                    last, content, crowded, begun = key, None, None, len(held)
                if x == content:  # rows are sorted: the first of them is the earliest
                    out.append((REMOVED, None, doc, start, strings, None, None))
                    continue
                content = x
                if crowded is None and len(held) - begun >= most:
                    crowded = key
                    out += [(CROWDED, *h) for h in held[begun:]]
                    size -= sum(len(h[-1]) + 1 for h in held[begun:])
                    del held[begun:]
                if crowded is not None:
                    out.append((CROWDED, *row[1:]))
                else:
                    held.append(row[1:])
                    size += len(x) + 1
            yield _batch(out)
        if held:
            yield _batch(repeats(*_arrays(held)))

    return contents.repartition("key").sortWithinPartitions("key", "content", "doc_id", "start").mapInArrow(compare, COMPARED_SQL)


def _arrays(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int64), [h[-1] for h in held]


def repeated_strings(docs: DataFrame, length: int = LENGTH, seed: int = 0) -> DataFrame:
    """doc_id, start, strings and as: runs of positions whose ``length`` bytes also start earlier.

    ``docs`` has doc_id (once each) and text (binary). Earlier means a smaller doc_id, or the same one and an earlier start. Where
    ``as`` is not null, the run was found by hashes of ``seed``, and it is the earlier bytes that it must be equal to.
    """
    found = materialise(_sift(_scan(docs, length, seed)), "segments")

    def cut(rows: DataFrame, owner: str, at: str, name: str) -> DataFrame:
        piece = F.expr(f"substring(text, cast({at} as int) + 1, cast(strings as int) + {length - 1})").alias(name)
        return rows.join(docs.withColumnRenamed("doc_id", "id"), F.col(owner) == F.col("id")).select(*rows.columns, piece)

    def contents(kind: int) -> DataFrame:
        rows = found.where(F.col("kind") == kind).select(F.lit(SEGMENT).cast("long").alias("kind"), "key", "doc_id", "start", "strings", "off")
        return cut(rows, "doc_id", "start", "content")

    spans = ["doc_id", "start", "strings"]
    # _sift gives back no group of more than CROWD rows and those of a batch, but as CROWDED
    out = found.where(F.col("kind") == REMOVED).select(*spans).union(_compare(contents(SEGMENT), length, 2 * CROWD + BATCH_ROWS).select(*spans))
    crowd = found.where(F.col("kind") == CROWDED)
    if not crowd.isEmpty():
        crowd = contents(CROWDED)
        for width in WIDTHS:
            done = materialise(_compare(_split(crowd, length, width), length, CROWD), "crowd")
            out = out.union(done.where(F.col("kind") == REMOVED).select(*spans))
            crowd = done.where(F.col("kind") == CROWDED)
            if crowd.isEmpty():
                break
    runs = _runs(found.where(F.col("kind") == REPEATED))
    return out.withColumn("as", F.lit(None).cast("binary")).union(cut(runs, "ref_doc", "ref_start", "as").select(*spans, "as"))


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("collided", pa.bool_()), ("kept", pa.binary())])


def _without(rows: DataFrame, spans: DataFrame, standing: DataFrame | None, length: int, with_kept: bool) -> DataFrame:
    """``rows`` (doc_id, text) without the strings of ``spans``; collided where a span's bytes are not those it was taken for."""
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "strings", "as")).alias("spans"))
    both = rows.join(spans, "doc_id", "left")
    if standing is not None:
        digests = standing.select("doc_id", F.sha2("text", 256).alias("digest"))
        both = both.join(digests, "doc_id", "left").withColumn("spans", F.when(F.sha2("text", 256) == F.col("digest"), F.col("spans")))
    both = both.select("doc_id", "text", *(F.col(f"spans.{c}").alias(c) for c in ("start", "strings", "as")))
    schema = KEPT if with_kept else KEPT.remove(6)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (doc_id, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                kept, runs, collided = text, 0, False
                if b.column(2)[i].is_valid:
                    s, n, known = b.column(2)[i].values.to_numpy(), b.column(3)[i].values.to_numpy() + length - 1, b.column(4)[i].values
                    for at, size, x in zip(s.tolist(), n.tolist(), known):
                        collided |= x.is_valid and text[at : at + size] != x.as_py()
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, np.minimum(s, len(text)), 1)
                    np.add.at(edge, np.minimum(s + n, len(text)), -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((doc_id, len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest(), collided) + ((kept,) if with_kept else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    return both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, collided boolean" + ", kept binary" * with_kept)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay, if asked).

    Each byte is removed that a string of ``length`` bytes covers which also starts earlier in the corpus; all
    strings are judged on the input. Matches never cross documents, and may cut a UTF-8 character.
    Hashes only propose what is equal: bytes are compared before anything is removed, and if two different segments
    have one hash, all is done again with other hashes.

    Null text counts as empty. Rows with a null id stay whole and are not compared. Rows that repeat an id and its text are
    one document and come out alike; of different texts under one id the least (by bytes) is the document, and rows with
    the others stay whole. Other columns are ignored. An empty table gives no rows.
    """
    if not 8 <= length <= 255:
        raise ValueError("length must be from 8 to 255")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    own = rows.where("doc_id is not null")
    standing = None
    if not own.groupBy("doc_id").count().where("count > 1").isEmpty():
        standing = materialise(own.groupBy("doc_id").agg(F.min("text").alias("text")), "standing")
    nobody = rows.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("strings"), F.lit(None).cast("binary").alias("as")).limit(0)
    for seed in numbers():
        out = _without(own, repeated_strings(own if standing is None else standing, length, seed), standing, length, with_kept)
        out = materialise(out, "kept")
        if out.where("collided").isEmpty():
            return out.union(_without(rows.where("doc_id is null"), nobody, None, length, with_kept)).drop("collided")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH raw AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
  SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1}, 500)) AS base FROM raw WHERE length(h) // 2 >= {LENGTH}
), cut AS (
  SELECT doc_id, base, substr(h, 2 * base + 1, 2 * {499 + LENGTH}) AS part FROM blocks
), places AS (
  SELECT doc_id, base, part, unnest(range(length(part) // 2 - {LENGTH - 1})) AS k FROM cut
), ranked AS (
  SELECT doc_id, base + k AS i, row_number() OVER (PARTITION BY substr(part, 2 * k + 1, {2 * LENGTH}) ORDER BY doc_id, base + k) AS turn FROM places
), spans AS (
  SELECT doc_id, i, i > coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000) + {LENGTH} AS begins
  FROM ranked WHERE turn > 1
), numbered AS (
  SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM spans
), runs AS (
  SELECT doc_id, k, min(i) AS lo, max(i) + {LENGTH} AS hi FROM numbered GROUP BY doc_id, k
), kept AS (
  SELECT doc_id, lo AS hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY k), 0) AS lo FROM runs
  UNION ALL
  SELECT r.doc_id, length(r.h) // 2, coalesce(max(s.hi), 0) FROM raw r LEFT JOIN runs s USING (doc_id) GROUP BY r.doc_id, r.h
), joined AS (
  SELECT r.doc_id, string_agg(substr(r.h, 2 * k.lo + 1, 2 * (k.hi - k.lo)), '' ORDER BY k.lo, k.hi) AS rest
  FROM raw r JOIN kept k USING (doc_id) GROUP BY r.doc_id
)
SELECT r.doc_id, length(r.h) // 2 AS n_bytes, (length(r.h) - length(j.rest)) // 2 AS n_removed,
       (SELECT count(*) FROM runs s WHERE s.doc_id = r.doc_id) AS n_spans, sha256(unhex(j.rest)) AS kept_sha256
FROM raw r JOIN joined j USING (doc_id)
"""
