"""Spelling variants, periodic runs and quality rules: brute force, edge cases and SQL on small tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from edges import EDGES
from test_exact_url_mixing import arrow, same

from gridloom.llm import divergence, periodic, spelling

#: SQL and DataFrame rows that have the columns of documents, a null language and a source of their own name.
ROWS = [(1, "Wonderful wonderfull WONDERFUL wonderful wonderful wonderful × ÷ Ärger"), (2, "wonderfull wonderfull wonderfull wonderfull wonderfull"), (3, "wonderful " * 30), (4, "wonderfal " * 5), (5, "wanderfal " * 5)] + EDGES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", [4, 60, 10_000])
def test_tries_find_all_words_at_distance_one(most):
    r = random.Random(most)
    for trial in range(12):
        words = {bytes(r.choice(b"ab\xe9") for _ in range(r.randint(1 if trial % 3 else 6, 8))): r.randint(1, 9) for _ in range(70)}
        made = [spelling.unpacked(t) for t in spelling.make_tries(sorted(words.items()), most)]
        assert most < 100 and len(made) > 1 or len(made) == 1
        for w in words:
            found = [spelling.near(w, t) for t in made]
            want = [(-n, x) for x, n in words.items() if distance(w, x) == 1]
            assert sum(f[0] for f in found) == len(want)
            assert min(((-n, x) for _, n, x in found if x is not None), default=None) == min(want, default=None)


def spelled(rows, length=6, least=5, factor=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in "".join(c if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" else " " for c in text or "").split():
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= length and n >= least}
    near = {w: sorted((-m, x) for x, m in words.items() if distance(w, x) == 1) for w in words}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= factor * n else None for w, n in words.items()}
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, form[w], root, len(near[w]), form[w] and words[form[w]]))
    return out


def test_spelling_variants_as_by_brute_force(spark, docs):
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abé") for _ in range(r.choice([5, 6, 7]))) for _ in range(r.randint(0, 60))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + ROWS
    found = spelling.variants(docs(rows), most=30, group_bytes=400)
    assert {tuple(x) for x in found.select("word", "n", "form", "root", "n_near", "form_n").collect()} == spelled(rows)
    same(found, spelling.ORACLE_SQL, documents=arrow(rows))


def test_chains_of_forms(docs):
    """Forms of forms: the root is at the chain's end, however long."""
    words = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb"]
    rows = [(i, " ".join([w] * 5 * 6**i)) for i, w in enumerate(words)]
    by = {x.word: x for x in spelling.variants(docs(rows)).collect()}
    whole = spelled(rows)
    assert {tuple(x[c] for c in ("word", "n", "form", "root", "n_near", "form_n")) for x in by.values()} == whole
    assert by["aaaaaaa"].root == "aaabbbb" and by["aaaaaaa"].form == "aaaaaab"
    assert by["aaabbbb"].form is None and by["aaabbbb"].root == "aaabbbb"


def test_spelling_of_nothing_and_clashing_columns(spark, docs):
    assert spelling.variants(docs([(1, None), (2, ""), (3, "short w")])).count() == 0
    assert spelling.variants(docs(ROWS).limit(0)).count() == 0
    wide = docs(ROWS).selectExpr("*", "1 as n", "2 as word", "3 as run", "'x' as form", "4 as id", "5 as at", "6 as h")
    assert spelling.variants(wide).count() == spelling.variants(docs(ROWS)).count() > 0
    long = [(1, "q" * 200_000 + " ")] * 5 + [(2, "q" * 200_001)] * 30
    by = {len(x.word): x for x in spelling.variants(docs(long)).collect()}
    assert by[200_000].n_near == 1 and len(by[200_000].form) == 200_001


def brute_runs(x, length, times):
    n, out = len(x), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(length, times * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return out


def test_periodic_runs_as_by_brute_force():
    r = random.Random(3)
    for _ in range(1500):
        length, times = r.choice([(24, 3), (24, 3), (4, 2), (6, 3), (2, 2), (10, 2), (8, 4)])
        n, k = r.randint(0, 120), r.choice([1, 2, 2, 3, 5, 50])
        x = [r.randrange(k) for _ in range(n)]
        for _ in range(r.randint(0, 3) if n > 10 else 0):
            a, p = r.randrange(n), r.randint(1, 12)
            for i in range(a + p, min(n, a + r.randint(5, 80))):
                x[i] = x[i - p]
        assert periodic.periodic_runs(np.array(x, np.int64), length, times) == brute_runs(x, length, times)


PERIODIC = [(20, "a b c " * 9 + "d"), (21, "x " * 24), (22, "x " * 23), (23, "p q r s t u v w " * 3), (24, "p q r s t u v w " * 2 + "p q r s t u v"), (25, ("n " * 24 + "m ") * 3), (26, "é b é b " * 12)]


def test_periodic_runs_match_sql_and_edges(docs):
    rows = EDGES + PERIODIC + [(i, " ".join(f"w{(i * j) % 17}" for j in range(90))) for i in range(100, 160)]
    rows = [r for r in dict.fromkeys(rows) if r[0] is not None and r[0] != 5] + [(5, "word " * 400)]
    found = periodic.collapse(docs(rows), plant=True)
    same(found, periodic.ORACLE_SQL, documents=arrow(rows))
    by = {x.doc_id: x for x in periodic.collapse(docs(EDGES + PERIODIC), with_text=True).collect()}
    assert by[20].collapsed == "a b c d" and (by[20].start, by[20].length, by[20].period, by[20].exponent_milli) == (0, 27, 3, 9000)
    assert by[21].collapsed == "x" and by[22].n_runs == 0 and by[23].n_runs == 1 and by[24].n_runs == 0
    assert by[25].n_runs == 4 and (by[25].period, by[25].length) == (1, 24)
    assert by[None].n_runs == 0 and by[1].start is None and by[1].collapsed_sha256 == by[2].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[5].collapsed == "word" and by[5].exponent_milli == 30_000_000
    wide = docs(EDGES).selectExpr("*", "1 as start", "2 as length", "3 as collapsed", "4 as n_runs")
    assert periodic.collapse(wide).count() == len(EDGES) and periodic.collapse(wide.limit(0)).count() == 0


def test_planting_is_by_id_only():
    words = [str(i).encode() for i in range(100)]
    changed = [i for i in range(2000) if periodic.planted(words, i) != words]
    assert changed and all(zlib.crc32(str(i).encode()) % 10 == 0 for i in changed)
    assert periodic.planted(words, None) == words and periodic.planted([], changed[0]) == []


def repeated(words):
    counts = Counter(zip(words, words[1:], words[2:]))
    return len({i + j for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1 for j in range(3)})


def test_repeated_words_as_by_brute_force(monkeypatch):
    r = random.Random(2)
    for _ in range(500):
        words = [str(r.randrange(r.choice([2, 5, 40]))).encode() for _ in range(r.randint(0, 60))]
        assert divergence.repeated_words(words) == repeated(words)
    monkeypatch.setattr(divergence, "hash", lambda w: 7, raising=False)  # all windows collide
    for _ in range(50):
        words = [str(r.randrange(4)).encode() for _ in range(r.randint(4, 40))]
        assert divergence.repeated_words(words) == repeated(words)


def prose(r, n, words):
    out = [r.choice(words[:4]) if r.random() < 0.4 else r.choice(words) + str(r.randrange(9)) * (r.random() < 0.02) for _ in range(n)]
    return " ".join(w.capitalize() + "," if r.random() < 0.05 else w for w in out)


def quality_rows():
    r, rows = random.Random(7), []
    for lang in range(2):
        words = ["".join(r.choice("abcdefghij" if lang else "klmnopqrst") for _ in range(r.randint(2, 9))) for _ in range(300)]
        rows += [(1000 * lang + i, prose(r, r.randint(20, 400), words), str(lang)) for i in range(150)]
        rows += [(1000 * lang + 500 + i, prose(r, 200, words).upper(), str(lang)) for i in range(6)]
        rows += [(1000 * lang + 600 + i, " ".join(w + "&&&" for w in prose(r, 200, words).split()), str(lang)) for i in range(6)]
        rows += [(1000 * lang + 700 + i, " | ".join(r.choice(words[4:]) for _ in range(200)), str(lang)) for i in range(6)]
        rows += [(1000 * lang + 800 + i, "same line here\n" * 40, str(lang)) for i in range(3)]
    return rows


def test_quality_rules_match_sql_and_find_junk(spark, docs):
    rows = quality_rows() + [(-1 - i, text, None) for i, (_, text) in enumerate(EDGES)] + [(9000, prose(random.Random(1), 100, ["äö", "ß", "x"]), "rare")]
    table = spark.createDataFrame([(d, t, lang) for d, t, lang in rows], "doc_id long, text string, lang string").repartition(3)
    found = divergence.judged(table)
    import pyarrow as pa

    columns = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string())})
    same(found.select("doc_id", *divergence.COUNTS, "base_failed", "kept"), divergence.ORACLE_SQL, documents=columns)
    by = {x.doc_id: x for x in found.collect()}
    junk = [x for i, x in by.items() if i >= 0 and i % 1000 >= 500 and i != 9000]
    clean = [x for i, x in by.items() if 0 <= i % 1000 < 150 and i >= 0 and i != 9000 and not x.base_failed]
    assert not any(x.kept for x in junk) and len(clean) > 200 and all(x.kept for x in clean)
    assert by[9000].js_chars is None and by[9000].kept != by[9000].base_failed


def test_quality_rules_of_edges(docs):
    found = {x.doc_id: x for x in divergence.judged(docs(EDGES).selectExpr("*", "1 as c0", "2 as kept", "3 as rank", "4 as n")).collect()}
    assert found[1].n_words == 0 and found[1].base_failed and not found[1].kept
    assert found[5].n_repeat_words == 30_000 and found[5].base_failed and found[7].n_symbols == 4
    assert divergence.judged(docs(EDGES).limit(0)).count() == 0
    lines = docs([(1, "a\n \na\nb\na "), (2, "\n\n")])
    assert {x.doc_id: x.n_dup_lines for x in divergence.judged(lines).collect()} == {1: 1, 2: 0}


def test_rare_languages_are_judged_exactly_in_groups(spark, monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choice("uvwxyz") for _ in range(r.randint(2, 9))) for _ in range(300)]
    rows = quality_rows() + [(5000 + i, prose(r, 150, words), "rare") for i in range(20)] + [(5500, prose(r, 200, words).upper(), "rare")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    plain = lambda df: {x.doc_id: (x.n_words, x.base_failed, x.kept, x.js_chars and round(x.js_chars, 9), x.js_words and round(x.js_words, 9)) for x in df.collect()}
    want = plain(divergence.judged(table))
    assert not want[5500][2] and want[5500][3] is not None
    monkeypatch.setattr(divergence, "LANGUAGES", 2)
    assert plain(divergence.judged(table))[5500][3] is None
    assert plain(divergence.judged(table, rare=True)) == want
