"""Spelling variants against a brute-force version."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from lumen.llm import op13_spelling as op

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_words(rows, every=97, min_length=5):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= min_length:
                total[run] += 1
    return dict(total)


def brute_forms(counts):
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            holes[i, w[:i], w[i + 1:]].add(w)
            if (short := w[:i] + w[i + 1:]) in counts:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out


def result(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_equals_brute_force(spark, small_dir):
    rows = duckdb.sql(f"select doc_id, text from '{small_dir}/documents.parquet'").fetchall()
    want = brute_forms({w: n for w, n in brute_words(rows).items() if n >= 3})
    assert len(want) > 500 and any(v[1] != w for w, v in want.items())
    df = op.op13_spelling(spark, small_dir)
    assert dict(df.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint",
                               "n_near": "bigint", "form_n": "bigint"}
    assert result(df) == want


def test_words_of_awkward_documents(spark, awkward):
    long = "Straße×÷ÀÿŒuvre " * 90_000 + "y" * 300_000
    docs = awkward.union(spark.createDataFrame([(None, "Wordless wordless", None, None, None), (11, long, None, None, None),
                                                (12, "Häuser", None, None, None), (13, "user", None, None, None)],
                                               awkward.schema)).withColumn("n", F.lit(7)).withColumn("word", F.lit("x"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for every in (0, 2, 97):
        got = {r.word: r.n for r in op.count_words(docs, every=every).collect()}
        assert got == brute_words(rows, every)


def test_chains_ties_and_repeats(spark):
    counts = {"house": 100, "hause": 50, "hausen": 20, "hausens": 4, "mouse": 100, "mause": 60, "maaaase": 9,
              "maaase": 30, "maase": 70, "apple": 8, "applee": 4, "applea": 4, "éclair": 12, "eclair": 3,
              "é" * 60: 9, "é" * 59: 3, "x" * 200 + "y": 8, "x" * 201: 3, "x" * 202: 1}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("best", F.lit(1)).repartition(3)
    assert result(op.spelling_variants(df)) == brute_forms(counts)


def test_large_blocks_of_long_words_are_tiled(spark, monkeypatch):
    counts = {"ab" * 40 + a + b + c: 1 + (i * 7919) % 50 for i, (a, b, c) in enumerate(
        (a, b, c) for a in "pqrstuv" for b in "pqrstu" for c in ("", "p", "q", "rr"))}
    monkeypatch.setattr(op, "TILE", 16)
    monkeypatch.setattr(op, "PAIRS", 100)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert op._blocks(df).where("hi > 0").count() > 0
    assert result(op.spelling_variants(df)) == brute_forms(counts)


def test_empty(spark, nothing):
    words = op.count_words(nothing)
    assert words.count() == 0
    assert op.spelling_variants(words).count() == 0
    none = spark.createDataFrame([(None, 5), ("alone", 1)], "word string, n long")
    assert result(op.spelling_variants(none)) == {"alone": (None, "alone", 1, 0, None)}
