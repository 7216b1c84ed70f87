"""The pipeline's stages on a small table, each against what it must keep."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]
import corpus_pipeline  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, docs, tmp_path):
    clean = [(i, " ".join(f"w{(i * 31 + j * j) % 977}" for j in range(40 + i % 9)), f"s{i % 3}") for i in range(150)]
    toxic = [(1000 + i, f"vile nasty w{i} w{i + 1} vile awful w{i + 2}", "s0") for i in range(60)]
    near = [(2000 + i, clean[i][1].replace("w", "w", 1) + f" tail{i}", "s1") for i in range(5)]
    copies = [(3000 + i, clean[i][1], "s2") for i in range(7)]
    rows = clean + toxic + near + copies + [(4000, None, None), (4001, "", "s1"), (None, "a row without an id", "s1"), (3, clean[3][1], "s0")]
    labels = [(i, 1, 0) for i, *_ in clean] + [(i, 1, 1) for i, *_ in toxic]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), {i for i, *_ in clean}, {i for i, *_ in toxic}


def test_stages(spark, folder):
    path, clean, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
        assert k == 4 or docs.columns == COLUMNS
    after_toxicity, after_copies, after_near, mixed, packed = kept
    assert clean <= set(after_toxicity) and len(toxic & set(after_toxicity)) <= 3
    assert clean <= set(after_copies) and not set(range(3000, 3007)) & set(after_copies) and len(after_copies) == len(set(after_copies))
    assert clean <= set(after_near) and not set(range(2000, 2005)) & set(after_near) and after_near.count(None) == 1
    assert set(mixed) <= set(after_near) and len(mixed) > len(after_near) and all(mixed.count(i) <= 2 for i in set(mixed))
    assert set(packed) == set(mixed)


def clashing(df):
    """Columns called as the stages call their own."""
    names = ["score", "_score", "size", "copy", "copies", "text_sha256", "h128", "row", "turn", "digest", "identity", "node", "class_id"]
    return df.withColumns({n: F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})


def test_stages_against_plain_versions(spark, folder):
    """Each stage on what the one before kept, with clashing columns, against loops and SQL on the same rows."""
    import duckdb
    import public_tokenizers
    from test_near_suffix_toxicity import brute_classes
    from tokenizers import Tokenizer

    from gridloom.llm import mixing, toxicity

    path, *_ = folder
    docs = clashing(spark.read.parquet(f"{path}/documents.parquet"))
    steps = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], path).write.parquet(f"{path}/plain{k}")
        steps.append(spark.read.parquet(f"{path}/plain{k}"))
        if k < 4:
            assert steps[-1].columns == docs.columns
            assert all(r[c] == f"{c}:{'none' if r.doc_id is None else r.doc_id}" for r in steps[-1].collect() for c in docs.columns[5:])
    rows = [[(r.doc_id, r.text, r.source) for r in s.collect()] for s in steps[:5]]
    key = lambda r: tuple((x is None, x or 0 if not isinstance(x, str) else x) for x in r)
    order = lambda rs: sorted(rs, key=lambda r: repr(key(r)))
    scores = {r.text: r.score for r in toxicity.scored(docs.select("text"), toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet"))).collect()}
    assert order(rows[1]) == order(r for r in rows[0] if scores[r[1]] < 0.3)
    first = {}
    for r in sorted(rows[1], key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(r[1] or "", r)
    assert len(rows[2]) == len(first) and {r[0] for r in rows[2]} == {r[0] for r in first.values()} and {r[1] or "" for r in rows[2]} == set(first)
    # the id that is null counts in document frequencies only
    classes = brute_classes([(-1 if i is None else i, t) for i, t, _ in rows[2]])
    assert order(rows[3]) == order(r for r in rows[2] if r[0] is None or classes[r[0]] == r[0])
    con = duckdb.connect()
    con.register("documents", steps[3].select("doc_id", "text", "source").toArrow())
    want = {i: taken // size if size else None for i, size, *_, taken in con.execute(mixing.sql()).fetchall()}
    got = [r[0] for r in rows[4]]
    assert all(got.count(i) == n for i, n in want.items() if n is not None) and set(got) <= set(want)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = steps[5].collect()
    assert sum(r.length for r in pieces) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x, _ in rows[4])
    places = {}
    for r in pieces:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:])) and min(own)[0] == 0 and sum(n for _, n in own) <= 1024


def test_repeated_rows_are_mixed_each(spark, docs, tmp_path):
    rows = [(1, "a b c", "x")] * 3 + [(1, "d e f", "x"), (2, "a b c", "x"), (None, "a b c", "x"), (None, "a b c", "x")]
    found = corpus_pipeline.mix(spark, clashing(docs(rows)), str(tmp_path)).collect()
    assert 3 * len(found) == pytest.approx(1.5 * 3 * len(rows), abs=3)


def test_near_copies_of_a_large_group_go(spark, docs, tmp_path):
    from test_near_suffix_toxicity import large_group

    rows = large_group()
    group = [i for i, t in rows if t.startswith("b0 ")]
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs(rows), str(tmp_path)).collect()}
    assert len(group) == 61 and kept == {i for i, _ in rows} - set(group[1:])


def test_run_is_the_stages_in_turn(spark, folder):
    path, *_ = folder
    out = corpus_pipeline.run(spark, path)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_without_labels_all_documents_stay(spark, folder, tmp_path):
    path, *_ = folder
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, f"{tmp_path}/none").count() == docs.count()
