"""The operators whose queries have SQL: edge cases, and their SQL on a small table."""

import hashlib

import duckdb
import pyarrow as pa
import pytest
from edges import EDGES
from pyspark.sql import functions as F

from gridloom.llm import exactdup, linedup, mixing, urlfilter


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def same(df, sql, **tables):
    columns, want = sql_rows(sql, **tables)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


def arrow(rows):
    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[2] if len(r) > 2 else "s" for r in rows], pa.string())})


def test_exact_dedup_edges(docs):
    found = exactdup.exact_duplicates(docs(EDGES), keep="max")
    same(found, exactdup.ORACLE_SQL, documents=arrow(EDGES))
    by = {r.doc_id: r for r in found.collect()}
    assert by[1].keep_id == 2 and not by[1].kept and by[2].kept and by[3].group_size == 3
    assert by[8].text_sha256 == hashlib.sha256(b"one").hexdigest()
    assert exactdup.exact_duplicates(docs(EDGES).limit(0)).count() == 0


def test_exact_dedup_ignores_clashing_columns(docs):
    rows = docs([(1, "x"), (2, "x")]).withColumns({"keep_id": F.lit(9), "h128": F.lit("z"), "group_size": F.lit("q")})
    assert {r.keep_id for r in exactdup.exact_duplicates(rows).collect()} == {1}


URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "https://A.Example.NET/en/x?y#z", "http://xexample.net/en/", "http://example.net/EN/", "x://example.com/de/", "http://b.example.com/de", "http://q.org/fr/1", "http://org/fr/", "http://q.org/fr?/fr/", "http://u:p@h.net:80/", "http://a..net/\n/en/", "http://é.net/ü", "http://example.com/en/://x.net/"]


def test_url_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(0, None, None), (None, "http://x.net/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("keys", F.lit(1)).withColumn("host", F.lit("clash"))
    table = pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows], pa.string())})
    same(urlfilter.filter_urls(pages, urlfilter.RULES), urlfilter.ORACLE_SQL, pages=table)
    assert urlfilter.filter_urls(pages.limit(0), urlfilter.RULES).count() == 0
    assert {r.verdict for r in urlfilter.filter_urls(pages, []).collect()} == {"allow"}


@pytest.mark.parametrize("few", [0, 64])
def test_cascade_is_exact_over_its_universe(spark, monkeypatch, few):
    monkeypatch.setattr(urlfilter, "LISTED", few)
    listed = [f"k{i}" for i in range(0, 3000, 10)]
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    cascade = urlfilter.build_cascades(universe, {"x": listed})["x"]
    assert cascade.levels and (len(cascade.levels) > 1 or cascade.rest)
    found = {r.key for r in universe.where(cascade.contains(F.col("key"))).collect()}
    assert found == set(listed)


def test_hashes_are_spark_s(spark):
    keys = ["", "a", "é/ü", "x" * 100]
    df = spark.createDataFrame([(k,) for k in keys], "key string").select(F.xxhash64("key"), F.xxhash64(F.lit(urlfilter.SECOND), "key"))
    assert [[x % 2**64 for x in r] for r in df.collect()] == urlfilter._hashes(keys).T.tolist()


def test_cascades_of_very_many_keys():
    """Two million listed keys: as many levels as it takes, and exact at the end (the same arithmetic as the columns')."""
    import numpy as np

    rng = np.random.default_rng(0)
    inside, outside = rng.integers(0, 2**63, (2, 2, 2_000_000)).astype(np.uint64)
    everything, levels, own, other = (inside, outside), [], inside, outside
    while other.shape[1] > urlfilter.LISTED:
        levels.append(urlfilter._level(own, 0.5, len(levels) + 1))
        own, other = other[:, urlfilter._in(levels[-1], other)], own
    assert len(levels) > 30
    for hashes, member in zip(everything, (True, False)):
        answer, open_ = np.full(hashes.shape[1], len(levels) % 2 == 1), np.ones(hashes.shape[1], bool)
        for level in levels:
            out = open_ & ~urlfilter._in(level, hashes)
            answer[out], open_ = level.number % 2 == 0, open_ & ~out
        assert (answer != member).sum() <= urlfilter.LISTED


def test_first_of_equal_rules_counts(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    rules = [urlfilter.Rule("block", "net", "/"), urlfilter.Rule("allow", "net", "/")]
    for order, verdict in ((rules, "block"), (rules[::-1], "allow")):
        assert [(r.rule, r.verdict) for r in urlfilter.filter_urls(pages, order).collect()] == [("net/", verdict)]


def mixed_rows():
    rows = [(i, "w " * (i % 37 + 1), f"s{i % 5}") for i in range(600)] + [(1000 + i, "only five words are here", "hot") for i in range(900)]
    return rows + [(2000, None, "s1"), (2001, "", None), (2002, "three words here", None), (None, "no id", "s2"), (3, "w " * 4, "s3"), (2003, " ", "empty")]


def test_mixing_matches_sql_and_targets(docs):
    rows = mixed_rows()
    found = mixing.mix_sources(docs(rows).withColumn("size", F.lit("clash")))
    same(found.drop("copies"), mixing.ORACLE_SQL, documents=arrow(rows))
    got = found.collect()
    sizes, taken, targets = {}, {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        key = (r.source_size, r.target)
        taken[key] = taken.get(key, 0) + r.taken
        targets[key] = r.target
    assert sum(targets.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    assert all(abs(taken[k] - targets[k]) <= 80 for k in taken)
    assert mixing.mix_sources(docs(rows).limit(0)).count() == 0


def test_line_dedup_matches_sql(docs):
    rows = [(1, "a\nb\n\nc\nd"), (2, "x\na\n \nb\ny"), (3, "c\nd\nc\nd"), (4, "a"), (5, "b\nc"), (6, None), (7, ""), (8, "q\nq\nq\nq"), (9, "a\nb\n\nc\nd"), (10, "\n\n")]
    for run in (1, 2, 3):
        same(linedup.dedup_lines(docs(rows), run), linedup.sql(run), documents=arrow(rows))
    kept = {r.doc_id: r.kept for r in linedup.dedup_lines(docs(rows), with_kept=True).collect()}
    assert kept[2] == "x\n \ny" and kept[9] == "" and kept[1] == rows[0][1]
    clashing = docs(EDGES).withColumns({"start": F.lit("x"), "fingerprint": F.lit(1), "lines": F.lit(2)})
    found = {r.doc_id: r for r in linedup.dedup_lines(clashing, 1, with_kept=True).collect()}
    assert len(found) == len({i for i, _ in EDGES}) and found[4].kept == "" and found[3].kept == "a b c d e f g" and found[None].n_removed == 0
    assert linedup.dedup_lines(docs(EDGES).limit(0)).count() == 0


@pytest.mark.parametrize("collide", [False, True])
@pytest.mark.parametrize("run, window", [(1, 1), (1, 2), (1, 4), (2, 4), (3, 4), (4, 4)])
def test_line_dedup_by_brute_force(docs, monkeypatch, run, window, collide):
    """Also where all lines have one fingerprint, so that only the extension tells them apart."""
    import random

    if collide:
        import xxhash

        class Colliding:
            @staticmethod
            def xxh3_128_digest(x):
                return b"\0" * 8 + xxhash.xxh3_64_digest(x)

        monkeypatch.setattr(linedup, "xxhash", Colliding)

    rng = random.Random(run)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14)))) for i in range(40)]
    seen, want = set(), {}
    for i, text in rows:
        lines = text.split("\n")
        gone = [False] * len(lines)
        for s in range(len(lines) - run + 1):
            key = tuple(lines[s : s + run])
            if key in seen:
                gone[s : s + run] = [True] * run
            seen.add(key)
        want[i] = "\n".join(x for x, g in zip(lines, gone) if not g)
    assert {r.doc_id: r.kept for r in linedup.dedup_lines(docs(rows), run, with_kept=True, window=window).collect()} == want


def test_single_lines_come_through_window_minima(docs):
    """Long passages are found by few positions whose matches extend over lines; only what is between them is joined line by line."""
    passage = "\n".join(f"line {i}" for i in range(60))
    rows = [(i, f"own {i}\n{passage}\n\nmine {i}\nshared") for i in range(1, 21)]
    hashed = linedup.materialise(linedup.line_hashes(docs(rows)), "lines")
    found = linedup.materialise(linedup.fingerprints(hashed, linedup.WINDOW), "fingerprints")
    assert found.count() < 0.6 * 20 * 63
    runs = linedup.materialise(linedup.repeated_runs(found, linedup.WINDOW), "runs")
    covered = runs.selectExpr("doc_id", "explode(sequence(start, start + lines - 1)) as line").distinct()
    assert runs.agg(F.max("lines")).first()[0] > linedup.WINDOW and covered.count() == 19 * 60
    assert linedup.uncovered(hashed, runs).count() == 20 * 63 - 19 * 60
    want = {i: t if i == 1 else f"own {i}\n\nmine {i}" for i, t in rows}
    assert {r.doc_id: r.kept for r in linedup.dedup_lines(docs(rows), 1, with_kept=True).collect()} == want


def test_single_lines_of_texts_that_share_an_id(docs):
    """What is covered in one text of an id does not hide the lines of another."""
    rows = [(1, "a\nb\nc\nd"), (2, "a\nb\nc\nd"), (2, "w\nx\ny\nz"), (3, "x\nz"), (3, "x\nz")]
    got = sorted((r.doc_id, r.kept) for r in linedup.dedup_lines(docs(rows), 1, with_kept=True).collect())
    assert got == sorted((r.doc_id, r.kept) for r in linedup.dedup_lines(docs(rows), 1, with_kept=True, window=1).collect())
    assert got == [(1, "a\nb\nc\nd"), (2, ""), (2, ""), (3, ""), (3, "")]


def test_line_dedup_query_deletes_single_lines(spark, docs, tmp_path):
    notice = "one line of a licence, " * 12
    rows = [(1, f"a\n{notice}\nb"), (2, f"c\n{notice}\n\nd\n\nc"), (3, notice), (4, None), (5, f"{notice} \ne\na"), (None, notice)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_removed, r.kept_sha256) for r in linedup.query(spark, str(tmp_path)).collect()}
    want = {1: (0, rows[0][1]), 2: (2, "c\n\nd\n"), 3: (1, ""), 4: (0, ""), 5: (1, f"{notice} \ne"), None: (0, notice)}
    assert found == {i: (n, hashlib.sha256(x.encode()).hexdigest()) for i, (n, x) in want.items()}
