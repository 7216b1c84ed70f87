"""Operators without SQL, against brute force or held-out rows."""

import hashlib
import random

import numpy as np
import pytest
from edges import EDGES
from pyspark.sql import functions as F

from gridloom.llm import graph, neardup, suffixdup, toxicity
from gridloom.llm.graph import components
from gridloom.llm.suffixsort import permuted_lcp, suffix_array


def corpus(seed, groups=12, size=6, words=120):
    rng = random.Random(seed)
    make = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for g in range(groups):
        base = make(words)
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(own))
    rows += [" ".join(make(40)) for _ in range(20)] + rows[:5]
    rng.shuffle(rows)
    return list(enumerate(rows))


def brute_links(rows, similarity=0.8):
    """Similarities of the pairs that are alike, by TF-IDF of the words' own five-word runs, all pairs compared; no part of the operator is used."""
    from collections import Counter
    from math import log10

    vectors = {}
    for i, t in rows:
        w = (t or "").lower().split()
        vectors[i] = Counter(tuple(w[j : j + 5]) for j in range(max(min(len(w), 1), len(w) - 4)))
    df = Counter(k for v in vectors.values() for k in v)
    weights = {i: {k: n * (1 + log10((1 + len(rows)) / (1 + df[k]))) for k, n in v.items()} for i, v in vectors.items()}
    totals = {i: sum(w.values()) for i, w in weights.items()}
    found = {}
    for i, a in rows:
        for j, b in rows:
            if j < i:
                both = sum(min(x, weights[j][k]) for k, x in weights[i].items() if k in weights[j])
                alike = both / (totals[i] + totals[j] - both) if both > 0 else 0.0
                if (a or "") == (b or "") or alike >= similarity:
                    found[j, i] = max(alike, float((a or "") == (b or "")))
    return found


def brute_classes(rows, similarity=0.8):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in brute_links(rows, similarity):
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def classes(df):
    return {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_by_brute_force(docs, monkeypatch, small):
    if small:
        for name, value in (("LEADERS", 2), ("PART", 3), ("CHUNK_DOCS", 7), ("GROUP_BYTES", 500)):
            monkeypatch.setattr(neardup, name, value)
    rows = corpus(1)
    found = classes(docs(rows))
    assert found == brute_classes(rows) and 20 < len(set(found.values())) < len(rows)


def test_near_duplicates_of_one_template(docs, monkeypatch):
    """Buckets of many different texts: most words are the same in all, groups of a few are near copies."""
    monkeypatch.setattr(neardup, "LEADERS", 3)
    monkeypatch.setattr(neardup, "PART", 4)
    rng = random.Random(12)
    frame = [f"f{i}" for i in range(150)]
    rows = []
    for g in range(30):
        own = [f"g{g}x{i}" for i in range(60)]
        rows += [" ".join(frame + own[: 60 - k] + [f"t{g}{k}"]) for k in range(rng.randrange(1, 4))]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    found = classes(docs(rows))
    assert found == brute_classes(rows) and 25 <= len(set(found.values())) <= 60


def test_bands_follow_the_threshold():
    assert neardup.banding(0.8) == (12, 4) and neardup.banding(0.5) == (22, 2)
    for similarity in (0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 0.99, 1.0):
        for miss in (0.5, 0.02, 1e-4):
            bands, rows = neardup.banding(similarity, miss)
            assert (1 - similarity**rows) ** bands <= miss and bands >= 1 <= rows
    for bad in ((0, 0.1), (1.1, 0.1), (0.8, 0), (0.8, 1)):
        with pytest.raises(ValueError):
            neardup.banding(*bad)


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9])
def test_links_and_membership_by_brute_force(docs, similarity):
    """Every link is a true one with its similarity, those of two texts lose none, and they alone give the classes."""
    rows = corpus(7)
    members, links = (x.collect() for x in neardup.near_links(docs(rows), similarity))
    want = brute_links(rows, similarity)
    assert links and all(abs(want[r.a, r.b] - r.similarity) < 1e-5 for r in links)
    of = {r.doc_id: r.class_id for r in members}
    assert sum(of[a] == of[b] for a, b in want) >= 0.98 * len(want)
    root = {i: i for i, _ in rows}
    for a, b in [*((r.a, r.b) for r in links), *((r.doc_id, r.node) for r in members)]:
        x, y = root[a], root[b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert root == of and all(r.kept == (r.doc_id == r.class_id) for r in members)


def large_group(copies=60, strangers=400):
    """A text of 100 words and copies with two words changed: 86 of 106 shingles are shared with it, but the copies' own are rare and weigh more."""
    rng = random.Random(15)
    base = [f"b{i}" for i in range(100)]
    rows = [" ".join(base)]
    for c in range(copies):
        own = list(base)
        for j in (10 + rng.randrange(30), 60 + rng.randrange(30)):
            own[j] = f"c{c}x{j}"
        rows.append(" ".join(own))
    rows += [" ".join(f"s{rng.randrange(10**6)}" for _ in range(30)) for _ in range(strangers)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def brute_plain_links(rows, similarity=0.8):
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(min(len(w), 1), len(w) - 4))} for i, t in rows for w in [t.lower().split()]}
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    return {p: x for p, x in alike.items() if x >= similarity}


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("make", [large_group, lambda: corpus(11, 8, 9)])
def test_plain_links_by_brute_force(docs, monkeypatch, make, small):
    """With ``plain`` the classes are those of the links of either similarity; without it those of TF-IDF alone."""
    if small:
        for name, value in (("LEADERS", 2), ("PART", 3), ("CHUNK_DOCS", 7), ("GROUP_BYTES", 500)):
            monkeypatch.setattr(neardup, name, value)
    rows = make()
    weighted, plain = brute_links(rows), brute_plain_links(rows)
    want = {p: max(weighted.get(p, 0), plain.get(p, 0)) for p in weighted | plain}
    assert len(want) > len(weighted)
    members, links = (x.collect() for x in neardup.near_links(docs(rows), plain=True))
    assert links and all(abs(want[r.a, r.b] - r.similarity) < 1e-5 for r in links)
    root = {i: i for i, _ in rows}
    for a, b in want:
        x, y = root[a], root[b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert {r.doc_id: r.class_id for r in members} == root
    assert classes(docs(rows)) == brute_classes(rows) != root


def test_merged_classes_are_those_of_all_links(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)]
    frame = lambda p: spark.createDataFrame(p, "a long, b long")
    all_ = {(r.node, r.root) for r in graph.components(frame(pairs)).collect()}
    for cut in (0, 1, 120, 240):
        first = graph.components(frame(pairs[:cut]))
        assert {(r.node, r.root) for r in graph.merged(first, frame(pairs[cut:])).collect()} == all_


def test_very_long_near_copies(docs):
    text = " ".join(f"w{i}" for i in range(400_000))
    rows = [(1, text), (2, text + " end"), (3, text + " end"), (4, "word " * 300_000), (5, "word " * 299_999), (6, "other " * 9)]
    assert classes(docs(rows)) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_rows_that_share_an_id_get_one_class(docs):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (5, b), (7, a), (8, b), (9, "c d"), (9, "c e")]
    want = [(5, 5), (5, 5), (5, 5), (7, 5), (8, 5), (9, 9), (9, 9)]
    for parts in (1, 4):
        assert sorted((r.doc_id, r.class_id) for r in neardup.near_duplicates(docs(rows, parts)).collect()) == want


def test_near_duplicates_match_their_sql(docs):
    import duckdb
    import pyarrow as pa

    rows = corpus(4, 6, 5, 90) + [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "  a  b c ")]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string())}))
    want = con.execute(neardup.ORACLE_SQL).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in neardup.near_duplicates(docs(rows)).collect())


def test_near_duplicates_edges(docs):
    rows = [*EDGES, (9, "a b c d e f g"), (10, "A B C D E F G"), (11, "one")]
    found = [(r.doc_id, r.class_id, r.kept) for r in neardup.near_duplicates(docs(rows).withColumns({"digest": F.lit(1), "node": F.lit(2)})).collect()]
    assert len(found) == len(rows)
    by = {i: (c, k) for i, c, k in found}
    assert by[9] == by[10] == (3, False) and by[11] == (8, False) and by[None] == (None, True) and by[2] == (1, False) and by[6] == (6, True)
    assert neardup.near_duplicates(docs(rows).limit(0)).count() == 0


def test_samples_collide_as_often_as_weights_overlap():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    a, b = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    b[:100] = a[:100]
    sampler = neardup.Sampler(1500)
    x, y = (sampler(keys, w, np.array([0]))[0] for w in (a, b))
    assert np.mean(x == y) == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_samples_do_not_depend_on_the_batch(monkeypatch):
    rng = np.random.default_rng(1)
    keys, weights, starts = rng.integers(0, 2**63, 500).astype(np.uint64), rng.uniform(1, 2, 500), np.array([0, 3, 200, 201, 450])
    whole = neardup.Sampler(6)(keys, weights, starts)
    monkeypatch.setattr(neardup, "CHUNK", 64)
    assert (neardup.Sampler(6)(keys, weights, starts) == whole).all()


def test_ruled_out_pairs_are_not_similar():
    rng = random.Random(3)
    shingles = neardup.Shingles()
    for _ in range(60):
        a = [str(rng.randrange(400)) for _ in range(80)]
        b = [x if rng.random() > 0.05 else str(rng.randrange(400)) for x in a]
        va, vb = ((k, n.astype(np.float32), float(n.sum())) for k, n in (shingles(" ".join(a)), shingles(" ".join(b))))
        ca, cb = (np.bincount((v[0] & np.uint64(255)).astype(np.int64), v[1], 256) for v in (va, vb))
        shared = np.minimum(ca, cb).sum()
        assert shared / (va[2] + vb[2] - shared) >= neardup.weighted_jaccard(va, vb) - 1e-9


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


@pytest.mark.parametrize("letters", [1, 2, 20])
def test_suffix_arrays(letters):
    rng = random.Random(letters)
    for n in (0, 1, 2, 3, 50, 200, 1500):
        text = bytes(97 + rng.randrange(letters) for _ in range(n))
        t = np.frombuffer(text * 2, np.uint8)
        sa = suffix_array(t)
        order = sorted(range(len(t)), key=lambda i: bytes(t[i:]))
        assert sa.tolist() == order
        shared = permuted_lcp(t, sa, 30)
        for x, y in zip(order, order[1:]):
            k = 0
            while k < 30 and x + k < len(t) and y + k < len(t) and t[x + k] == t[y + k]:
                k += 1
            assert shared[y] == k


def brute_repeats(rows, length):
    seen, want = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(raw[s : s + length])
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        want[i] = (len(raw), len(raw) - len(kept), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(kept).hexdigest())
    return want


@pytest.mark.parametrize("crowd,held", [(20_000, 1 << 20), (5, 40)])
def test_repeats_by_brute_force(docs, monkeypatch, crowd, held):
    monkeypatch.setattr(suffixdup, "CROWD", crowd)
    monkeypatch.setattr(suffixdup, "HELD", held)
    rng = random.Random(9)
    passages = ["".join(rng.choice("abé ") for _ in range(90)) for _ in range(4)]
    rows = [(i, "".join(rng.choice(passages + ["xy" * rng.randrange(40), "ab", "a" * 70]) for _ in range(rng.randrange(6)))) for i in range(60)]
    for length in (20, 100):
        found = {r.doc_id: tuple(r)[1:] for r in suffixdup.remove_repeats(docs(rows), length).collect()}
        assert found == brute_repeats(rows, length)


@pytest.mark.parametrize("crowd,often", [(20_000, 64), (4, 2)])
def test_one_line_in_very_many_surroundings(docs, monkeypatch, crowd, often):
    """A hot minimizer: its segments differ, so they are dealt by content and parted by longer contexts."""
    monkeypatch.setattr(suffixdup, "CROWD", crowd)
    monkeypatch.setattr(suffixdup, "OFTEN", often)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijk") for _ in range(n))
    line, most = noise(160), noise(92)
    rows = [(i, noise(rng.randrange(60)) + rng.choice([line, most]) + noise(rng.randrange(1, 60))) for i in range(120)]
    for parts in (1, 7):
        found = {r.doc_id: tuple(r)[1:] for r in suffixdup.remove_repeats(docs(rows, parts)).collect()}
        assert found == brute_repeats(rows, 100)


@pytest.mark.parametrize("partitions", [1, 5])
def test_colliding_hashes_remove_nothing(docs, monkeypatch, partitions):
    """All segments of one minimizer and size have one content hash at the first seed; bytes are compared, so results stay right."""
    real = suffixdup.segments

    def colliding(*args):
        found = real(*args)
        return (*found[:5], found[2] * (args[4] == 0) + found[5] * (args[4] != 0))

    monkeypatch.setattr(suffixdup, "segments", colliding)
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghijk") for _ in range(n))
    line = noise(95)
    rows = [(i, noise(30) + line + noise(30)) for i in range(30)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    found = {r.doc_id: tuple(r)[1:] for r in suffixdup.remove_repeats(docs(rows, partitions)).collect()}
    assert found == brute_repeats(rows, 100)


def test_different_texts_of_one_id(docs):
    rng = random.Random(6)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(2))
    low, high = sorted((a, b))
    rows = [(1, high), (1, low), (1, low), (2, low), (3, high), (4, high)]
    found = sorted((r.doc_id, r.n_bytes - r.n_removed, r.kept_sha256) for r in suffixdup.remove_repeats(docs(rows)).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert found == sorted([(1, 300, sha(high)), (1, 300, sha(low)), (1, 300, sha(low)), (2, 0, sha("")), (3, 300, sha(high)), (4, 0, sha(""))])


def test_repeats_match_their_sql(docs):
    import duckdb
    import pyarrow as pa

    rng = random.Random(2)
    passages = ["".join(rng.choice("abcé ") for _ in range(150)) for _ in range(5)]
    rows = [(i, rng.choice([None, "", "x" * 99, "".join(rng.choice(passages) + "y" * rng.randrange(3) for _ in range(rng.randrange(8)))])) for i in range(80)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string())}))
    want = con.execute(suffixdup.ORACLE_SQL).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in suffixdup.remove_repeats(docs(rows)).collect())


def test_repeats_edges(docs):
    found = suffixdup.remove_repeats(docs(EDGES).withColumns({"start": F.lit(1), "key": F.lit("k"), "spans": F.lit(0)}), with_kept=True).collect()
    assert len(found) == len(EDGES)
    by = {r.doc_id: r for r in found}
    assert by[1].n_bytes == 0 and by[None].n_removed == 0 and by[5].n_removed == 150_000 - 5 and by[5].n_spans == 1
    assert suffixdup.remove_repeats(docs(EDGES).limit(0)).count() == 0


@pytest.mark.parametrize("crowd,held", [(20_000, 1 << 20), (2, 3)])
@pytest.mark.parametrize("partitions", [1, 3])
def test_repeated_rows_are_one_document(docs, monkeypatch, crowd, held, partitions):
    monkeypatch.setattr(suffixdup, "CROWD", crowd)
    monkeypatch.setattr(suffixdup, "HELD", held)
    rng = random.Random(3)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(3))
    rows = [(1, a), (2, b + "x" + b), (3, "y" + a), (4, c)]
    found = [(r.doc_id, *tuple(r)[1:]) for r in suffixdup.remove_repeats(docs(rows + [rows[0], rows[1], rows[3], rows[3]], partitions)).collect()]
    want = brute_repeats(rows, 100)
    assert want[1][1] == want[4][1] == 0 and want[2][1] == want[3][1] == 400
    assert sorted(found) == sorted((i, *want[i]) for i in (1, 1, 2, 2, 3, 4, 4, 4))


def toxic_corpus(n=1200):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["awful", "nasty", "vile"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_ftrl_against_a_plain_one():
    """The update rule coordinate by coordinate, on dictionaries."""
    from math import exp, sqrt

    rng = random.Random(11)
    rows = [(sorted(rng.sample(range(60), rng.randrange(1, 12))), rng.random() < 0.4) for _ in range(400)]
    fast = toxicity.Ftrl(6, alpha=0.7, beta=1.3, l1=0.4, l2=0.2)
    z, n = {}, {}

    def weight(i):
        a = z.get(i, 0.0)
        return 0.0 if abs(a) <= 0.4 else -(a - (0.4 if a > 0 else -0.4)) / ((1.3 + sqrt(n[i])) / 0.7 + 0.2)

    for features, label in rows:
        fast.learn(np.array(features), int(label))
        at = [*features, 64]
        p = 1 / (1 + exp(-sum(weight(i) for i in at)))
        for i, w in [(i, weight(i)) for i in at]:
            g, had = p - label, n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (sqrt(had + g * g) - sqrt(had)) / 0.7 * w
            n[i] = had + g * g
    model = fast.model()
    want = {i: weight(i) for i in range(60) if weight(i)}
    assert dict(zip(model.index.tolist(), model.weight.tolist())) == pytest.approx(want, rel=1e-5) and model.bias == pytest.approx(weight(64)) and len(want) > 10


def test_features_are_words_neighbours_and_skips():
    words = "a b c a b".split()
    found = toxicity.Features(40)(" ".join(words))
    grams = {(w,) for w in words} | set(zip(words, words[1:])) | {(x, None, y) for x, y in zip(words, words[2:])}
    assert len(found) == len(grams) and len(toxicity.Features(40)("")) == 0 and len(toxicity.Features(40)("one")) == 1


def test_toxicity_on_held_out_rows(spark, docs):
    rows, labels = toxic_corpus()
    table = spark.createDataFrame(labels + [(None, 1, 1), (5000, 0, None), (5001, 1, 1)], "doc_id long, quality int, toxic int")
    df = docs(rows)
    model = toxicity.train(df, table)
    truth = {i: y for i, _, y in labels}
    scored = toxicity.score(df, model).withColumn("held", toxicity.fold() == toxicity.HELD_OUT).where("held").collect()
    right = [(r.score >= toxicity.THRESHOLD) == truth[r.doc_id] for r in scored]
    assert len(right) > 200 and np.mean(right) > 0.97
    again = toxicity.train(docs(rows, 1), table)
    assert (again.index == model.index).all() and np.allclose(again.weight, model.weight)


def test_toxicity_never_learns_from_held_out_labels(spark, docs):
    rows, labels = toxic_corpus(200)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = table.withColumn("toxic", F.when(toxicity.fold() == toxicity.HELD_OUT, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs(rows), table), toxicity.train(docs(rows), flipped)
    assert (a.index == b.index).all() and (a.weight == b.weight).all()


def test_toxicity_counts_an_id_once(spark, docs):
    rows, labels = toxic_corpus(200)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a, b = toxicity.train(docs(rows), table), toxicity.train(docs(rows + rows[:1] * 500 + [(1, "zzz")]), table)
    assert (a.index == b.index).all() and np.allclose(a.weight, b.weight)


def test_toxicity_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs(EDGES).withColumn("score", F.lit("clash"))
    model = toxicity.train(df, none)
    assert {r.score for r in toxicity.score(df, model).collect()} == {0.5}
    assert toxicity.scored(df, model).columns == [*[c for c in df.columns if c != "score"], "score"]
    assert toxicity.score(df.limit(0), model).count() == 0
