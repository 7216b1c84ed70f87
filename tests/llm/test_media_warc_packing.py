"""Round trips: what is stored is read back, archives are read by ranges, and packed pieces give the documents' ids."""

import hashlib
import io
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from edges import EDGES
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import media, packing, warczip


def test_media_round_trip(docs):
    rows = docs(EDGES).withColumns({"media": F.lit(1), "n_bytes": F.lit("x")})
    found = media.media_features(media.store_media(rows)).collect()
    texts = {i: (t or "").encode() for i, t in EDGES}
    assert len(found) == len(EDGES)
    for r in found:
        raw = texts[r.doc_id]
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(payload) + 44)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest()
    a, b = (r.fingerprints for r in found if r.doc_id in (3,)), (r.fingerprints for r in found if r.doc_id == 4)
    assert list(a)[0] == list(b)[0]
    assert media.store_media(rows.limit(0)).count() == 0


def test_fingerprints_find_a_tone():
    x = np.arange(4096)
    samples = (128 + 100 * np.sin(2 * np.pi * x * 16 / media.FRAME)).astype(np.uint8)
    found = media.fingerprints(samples)
    assert len(found) and {int(f) >> 14 & 255 for f in found} == {16}
    assert (np.diff(found >> 22) >= 0).all() and not len(media.fingerprints(np.full(64, 128, np.uint8)))


@pytest.mark.parametrize("chunk", [4096, 7])
@pytest.mark.parametrize("size", [64, 100, 1000, 3000])
def test_fingerprints_against_a_plain_transform(monkeypatch, size, chunk):
    """A discrete Fourier transform term by term, peaks by looking at each cell's surroundings, pairs by hand."""
    monkeypatch.setattr(media, "CHUNK", chunk)
    samples = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8)
    x = [(int(v) - 128) / 128 for v in samples]
    frames = 1 if size <= 128 else -(-(size - 128) // 64) + 1
    x += [0.0] * ((frames - 1) * 64 + 128 - size)
    k = np.arange(65)
    cells = np.zeros((frames, 65))
    for t in range(frames):
        windowed = [x[64 * t + j] * (0.5 - 0.5 * np.cos(2 * np.pi * j / 127)) for j in range(128)]
        cells[t] = abs(sum(v * np.exp(-2j * np.pi * k * j / 128) for j, v in enumerate(windowed)))
    assert np.allclose(np.concatenate([b for _, b in media.stft(samples)]), cells, atol=1e-4)
    cells[:, 0] = 0
    tops = [(t, f) for t in range(frames) for f in range(65) if cells[t, f] > max(1e-3, 0.1 * cells[t].max()) and cells[t, f] >= cells[max(0, t - 4) : t + 5, max(0, f - 8) : f + 9].max()]
    want = [t << 22 | f << 14 | f << 6 for t, f in tops]
    for i, (t, f) in enumerate(tops):
        want += [t << 22 | f << 14 | g << 6 | u - t for u, g in tops[i + 1 : i + 4] if 0 < u - t <= 63]
    assert media.fingerprints(samples).tolist() == sorted(want)


def reference_patterns(lengths, total):
    have = sorted({x for x in lengths if 0 < x < total})
    pairs = {(a, b) for a in have for b in have if a <= b and a + b == total}
    return pairs | {(a, b, c) for a in have for b in have for c in have if a <= b <= c and a + b + c == total}


def test_patterns_and_histogram_packing():
    rows = packing.patterns([1, 2, 3, 5, 6, 8, 9], 10)
    assert {tuple(sorted(x for x in r if x)) for r in rows.tolist()} == reference_patterns([1, 2, 3, 5, 6, 8, 9], 10)
    rng = np.random.default_rng(0)
    counts = dict(zip(*(x.tolist() for x in np.unique(rng.integers(1, 1025, 20_000), return_counts=True))))
    plan = packing.pack_histogram(counts)
    used = defaultdict(int)
    for lengths, n in plan:
        assert sum(lengths) <= 1024 and n > 0
        for x in lengths:
            used[x] += n
    assert used == counts
    bound = -(-sum(k * v for k, v in counts.items()) // 1024)
    assert sum(n for _, n in plan) <= 1.005 * bound
    assert packing.pack_histogram({}) == [] and packing.pack_histogram({1024: 3}) == [((1024,), 3)]


def fewest(pieces, total):
    """The least number of sequences for ``pieces`` (longest first), by trying all places."""
    best = len(pieces)

    def place(i, spaces):
        nonlocal best
        if len(spaces) >= best:
            return
        if i == len(pieces):
            best = len(spaces)
            return
        for space in set(spaces):
            if space >= pieces[i]:
                rest = list(spaces)
                rest.remove(space)
                place(i + 1, [*rest, space - pieces[i]])
        place(i + 1, [*spaces, total - pieces[i]])

    place(0, [])
    return best


def best_fit(counts, total):
    out = Counter()
    left = np.zeros(total + 1, np.int64)
    for k, v in counts.items():
        left[k] = v
    packing._best_fit(left, out)
    return sum(out.values())


def test_small_histograms_against_all_ways():
    rng = np.random.default_rng(3)
    above = 0
    for _ in range(60):
        total = int(rng.integers(7, 20))
        pieces = sorted(rng.integers(1, total, rng.integers(1, 11)).tolist(), reverse=True)
        n = sum(k for _, k in packing.pack_histogram(Counter(pieces), total))
        assert n <= best_fit(Counter(pieces), total)
        above += n - fewest(pieces, total)
    assert above <= 1


def least_needed(counts, total):
    """A lower bound: pieces above half are apart, and what of the smaller ones their sequences cannot take needs more; and by how many
    of the least pieces a sequence can hold at most."""
    need = 0
    for k in range(total // 2 + 1):
        alone = sum(v for x, v in counts.items() if x > total - k)
        large = [(x, v) for x, v in counts.items() if total / 2 < x <= total - k]
        small = sum(x * v for x, v in counts.items() if k <= x <= total / 2)
        space = sum((total - x) * v for x, v in large)
        need = max(need, alone + sum(v for _, v in large) + max(0, -(-(small - space) // total)))
    return max(need, -(-(sum(v for x, v in counts.items() if 4 * x > total) * 4 + counts[total // 4] * 3) // 12))


@pytest.mark.parametrize("low, high", [(1, 1023), (180, 299), (256, 419)])
def test_histograms_near_the_bound(low, high):
    counts = Counter(np.random.default_rng(0).integers(low, high + 1, 20_000).tolist())
    n = sum(k for _, k in packing.pack_histogram(counts))
    assert n <= best_fit(counts, 1024) and n <= 1.001 * least_needed(counts, 1024)


def test_nnls_reaches_an_exact_fit():
    rows = packing.patterns([2, 3, 5, 7, 8], 10)
    wanted = np.zeros(11)
    for r, n in zip(rows, (4, 1, 2)):
        for x in r:
            wanted[x] += n * (x > 0)
    x = packing.nnls(rows, wanted, 4000)
    used = np.bincount(rows.ravel(), np.repeat(x, 3), 11) * (np.arange(11) > 0)
    assert (x >= 0).all() and np.allclose(used, wanted, atol=0.05)


@pytest.mark.parametrize("ranked", [1 << 18, 2])
def test_packed_pieces_give_the_ids_back(docs, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*EDGES, (19, "a <|endoftext|> b"), (23, "<|endoftext|><|endoftext|>x " * 600), (24, "x " * 1022 + "x"), (25, "y" * 9000), (20, "It's 42²  naïve…\n\n  été 中文\u00a0x  "), (21, "a" * 5000), (22, "x " * 1023)]
    rows = packing.pack_documents(docs(texts).withColumns({"rank": F.lit(1), "salt": F.lit(2), "length": F.lit("z")}), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()
    want = defaultdict(list)
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at, n = 0, (len(ids) - 1) % 1024 + 1
        for piece in range(-(-len(ids) // 1024)):
            want[i].append((piece, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at, n = at + n, 1024
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack_documents(docs(EDGES).limit(0), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directory_reads_ranges(wide):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open("a/ü.bin", "w", force_zip64=wide) as f:
            f.write(b"0123456789")
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK trailing comment"
    d = warczip.ZipDirectory(warczip.FileRanges(out))
    assert set(d.members) == {"a/ü.bin", "packed"} and d.read("a/ü.bin", 3, 4) == b"3456" and d.read("a/ü.bin") == b"0123456789"
    with pytest.raises(ValueError):
        d.read("packed")
    with pytest.raises(ValueError):
        d.read("a/ü.bin", 8, 4)
    with pytest.raises(ValueError):
        warczip.ZipDirectory(warczip.BytesRanges(b"no archive"))


def test_zip64_end_of_directory():
    """Sizes, offsets and counts that only the ZIP64 records have."""
    import struct

    data, name = b"hello world", b"m"
    local = struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0x800, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 0) + name + data
    extra = struct.pack("<2H3Q", 1, 24, len(data), len(data), 0)
    central = struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0x800, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, len(local) + len(central), 1)
    end = struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    d = warczip.ZipDirectory(warczip.BytesRanges(local + central + end64 + locator + end))
    assert d.read("m", 6) == b"world"


@pytest.mark.parametrize("at_once", [1 << 20, 300])
def test_warc_round_trip(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(warczip, "READ_BYTES", at_once)
    rows = [(3, "http://a", "<p>x</p>"), (1, "http://b\r\nX: y", "<p>y</p>"), (2, None, "<p>x</p>"), (5, "u", None), (4, "u", ""), (None, "u", "<p>x</p>"), (6, "u", "é" * 200_000), (7, "u", "one"), (7, "u", "one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    written = [r.asDict() for r in warczip.write_archives(warczip.mark_revisits(pages), f"file://{tmp_path}/zips", 1000).collect()]
    assert sorted(x["archive"] for x in written) == sorted(f"file://{f}" for f in (tmp_path / "zips").iterdir()) and sum(x["records"] for x in written) == len(rows)
    archives = spark.createDataFrame(written)
    here = [fields["WARC-Record-ID"] for f in (tmp_path / "zips").iterdir() for fields, *_ in warczip.read_archive(warczip.FileRanges(open(f, "rb")))]
    assert sorted(here) == sorted(warczip._uri(r[0]) for r in rows)
    found = warczip.read_archives(archives, payloads=True).collect()
    texts = {3: 0, 1: 1, 2: 2, 5: 3, 4: 4, None: 5, 6: 6, 7: 7}
    assert len(found) == len(rows)
    first = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(r[2] or "", r[0])
    for r in found:
        payload = (rows[texts[r.page_id]][2] or "").encode()
        revisit = first[payload.decode()] != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(payload), warczip.base32_sha1(payload))
        assert (r.record_type, r.refers_to) == (("revisit", first[payload.decode()]) if revisit else ("response", None))
        assert r.payload == (None if revisit else payload)
    assert warczip.write_archives(warczip.mark_revisits(pages.limit(0)), f"{tmp_path}/none").count() == 0
    assert warczip.read_archives(archives.limit(0)).count() == 0


def test_damage_is_seen():
    record = warczip.warc_record(1, "u", b"payload", None)
    with pytest.raises(ValueError):
        warczip.parse_record(record.replace(b"payload", b"pay1oad"))


def test_a_repeated_write_meets_no_file_of_another_attempt(spark, tmp_path):
    """The same rows written twice to one folder, as a retried task does: each manifest names its own archives, whole ones."""
    pages = spark.createDataFrame([(i, f"http://x/{i}", "p" * i) for i in range(40)], "page_id long, url string, html string").coalesce(2)
    records = warczip.mark_revisits(pages)
    first = warczip.write_archives(records, f"file://{tmp_path}/zips", 500).collect()
    second = warczip.write_archives(records, f"file://{tmp_path}/zips", 500).collect()
    assert not {r.archive for r in first} & {r.archive for r in second}
    for manifest in (first, second):
        assert sorted(r.page_id for r in warczip.read_archives(spark.createDataFrame(manifest)).collect()) == list(range(40))
