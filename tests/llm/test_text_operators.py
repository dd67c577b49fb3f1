import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumen.llm import op4_lm, op5_decontamination as op5, op6_tokens, op8_topk, op9_neardup
from lumen.llm.common import read_table


def words(text):
    return (text or "").encode().lower().split()


# --- near duplicates ---------------------------------------------------------------

def brute_components(rows, n, percent):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def edited(rng, base, share):
    return " ".join(rng.choice(["zu", "ka", "mo"]) + str(rng.randrange(999)) if rng.random() < share else w for w in base)


def test_components_match_all_pairs(spark, tables, awkward):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    for g in range(6):
        base = [rng.choice(vocab) for _ in range(120)]
        rows += [(100 + 50 * g + k, edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06]))) for k in range(25)]
        rows += [(5000 + g, " ".join(base).upper() + "  ")]
    rows += [(9000 + k, "a b") for k in range(3)] + [(9100, "A\tB"), (9101, "b a"), (9102, "solo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "'x' as txt", "2 as n")
    got = op9_neardup.op9_neardup(spark, tables(documents=docs)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] or 0)
    have = sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=key)
    assert have == sorted(brute_components(rows, 3, 85), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicate_stage_keeps_one_of_each_group(spark, awkward, nothing):
    rng = random.Random(5)
    base = [f"w{rng.randrange(200)}" for _ in range(150)]
    rows = [(1000 + i, edited(rng, base, 0.01), "en", "s", 1) for i in range(30)] + [(2000, " ".join(base), "en", "s", 1)] * 3
    docs = awkward.union(spark.createDataFrame(rows, awkward.schema))
    got = op9_neardup.without_near_duplicates(docs)
    out = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert got.columns == docs.columns
    every = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert set(out) <= set(every)
    with_words = [(d, t) for d, t in out if words(t)]
    groups = {}
    for (d, t), (_, size, c) in zip(every, brute_components(every, 5, 80)):
        if size:
            groups.setdefault(c if c is not None else t, set()).add((d, t))
    assert len(with_words) == len(groups)
    assert all(len(g & set(with_words)) == 1 for g in groups.values())
    assert sum(not words(t) for _, t in out) == sum(not words(t) for _, t in every)
    assert op9_neardup.without_near_duplicates(nothing).collect() == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        errors = []
        for _ in range(60):
            pool = rng.integers(0, 2 ** 63, 300, dtype=np.uint64)
            a, b = np.unique(pool[:220]), np.unique(pool[80:])
            sig = op9_neardup.superminhash(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), 64)
            errors.append((sig[0] == sig[1]).mean() - 140 / 300)
        one = op9_neardup.superminhash(np.array([5], np.uint64), np.array([0, 1, 1]), 64)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07
    assert sorted((one[0] >> np.uint64(48)).tolist()) == list(range(64))      # one element fills all positions
    assert (one[1] == np.iinfo(np.uint64).max).all()


# --- decontamination ---------------------------------------------------------------

def test_passages_exact_edited_and_awkward(spark, awkward, nothing):
    rng = random.Random(2)
    words_ = [f"{a}{b}" for a in ("thi", "ero", "lan", "mek", "sou") for b in ("ble", "ta", "nor", "vix")]
    passages = [" ".join(rng.choice(words_) for _ in range(30)) for _ in range(8)]
    filler = lambda: " ".join(rng.choice(words_) for _ in range(400))
    rows = []
    for i, p in enumerate(passages):
        x = list(p)
        for _ in range(4):
            x[rng.randrange(len(x))] = "q"
        rows += [(100 + i, f"{filler()} {p.upper()}\n {filler()}", "en", "s", 1),
                 (200 + i, filler() + " " + "".join(x) + " " + filler(), "en", "s", 1), (300 + i, filler(), "en", "s", 1)]
    rows.append((400, "lead " * 300_000 + passages[0] + " tail" * 300_000, "en", "s", 1))
    docs = awkward.union(spark.createDataFrame(rows, awkward.schema)).selectExpr("*", "1 as item_id", "2 as edits")
    bench = spark.createDataFrame(list(enumerate(passages)) + [(50, None), (51, ""), (52, "short one"), (0, passages[0])],
                                  "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in op5.find_passages(docs, bench).collect()}
    want = {(k + i, i) for i in range(8) for k in (100, 200)} | {(400, 0)}
    assert set(got) == want
    text = {r[0]: r[1] for r in rows}
    for (d, i), r in got.items():
        assert r["edits"] == 0 if d not in range(200, 300) else 1 <= r["edits"] <= 4
        span = text[d].encode()[r["start"]:r["end"]].decode()
        if r["edits"] == 0:
            assert span.lower().split() == passages[i].split()
    clean = op5.without_passages(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == docs.count() - 17
    assert op5.find_passages(nothing, bench).collect() == []
    assert op5.find_passages(docs, bench.limit(0)).collect() == []


def test_every_passage_in_budget_meets_the_bound():
    """The lemma against edit distance: random edits within the budget are found."""
    rng = random.Random(9)
    items = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randrange(8, 60))).encode())
             for i in range(30)]
    with np.errstate(over="ignore"):
        index = op5.PassageIndex(items)
        texts, want = [], []
        for k, (item, p) in enumerate(index.items):
            x = list(bytes(p).decode())
            for _ in range(int(index.budget[k])):
                at = rng.randrange(1, len(x) - 1)
                if rng.random() < 0.4:
                    x[at] = "z"
                elif rng.random() < 0.5 and x[at - 1] != " " and x[at + 1] != " ":
                    del x[at]
                else:
                    x.insert(at, "y")
            texts.append("before it " + "".join(x) + " after")
            want.append((k, k))
        found = index.search(pa.array(texts))
    assert set(want) <= set(found)


# --- token counts ------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece.SentencePieceProcessor(model_file=path), op6_tokens.vocabulary(path)


def test_tokens_equal_the_library(library):
    sp, vocab = library
    rng = random.Random(1)
    texts = ["", " ", "  a", "a  b", "a\nb", "<s>x</s>", "▁a▁ b", "\t", "a\x00b", "é é", "😀x", "x" * 700, " " * 90, "\r\n",
             "中文没有空格" * 80, "0123456789" * 40, "=-=-" * 50, "aaaabaab" * 40]
    texts += ["".join(rng.choice(vocab[0]) for _ in range(rng.randrange(40))).replace("▁", " ") for _ in range(300)]
    texts += ["".join(rng.choice("abcdeinorst \n") for _ in range(rng.randrange(200))) for _ in range(300)]
    with np.errstate(over="ignore"):
        got = op6_tokens.Counter(op6_tokens.Automaton(*vocab)).count(pa.array(texts))
    assert got.tolist() == [len(x) for x in sp.encode(texts, num_threads=1)]


def test_token_query(spark, awkward, nothing, tables, library):
    sp, _ = library
    rows = op6_tokens.op6_tokens(spark, tables(documents=awkward.selectExpr("*", "1 as n_bytes", "2 as n_tokens"))).collect()
    want = sorted((len((r["text"] or "").encode()), len(sp.encode(r["text"] or "", num_threads=1))) for r in awkward.collect())
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in rows)
    assert op6_tokens.op6_tokens(spark, tables(documents=nothing)).collect() == []


def test_full_table_is_emptied_and_counts_stay(library, monkeypatch):
    sp, vocab = library
    monkeypatch.setattr(op6_tokens, "MAX_STATES", 200)
    monkeypatch.setattr(op6_tokens, "KNOWN_SEGMENTS", 20)
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("etaoinsh") for _ in range(9)) for _ in range(30)) for _ in range(20)]
    with np.errstate(over="ignore"):
        counter = op6_tokens.Counter(op6_tokens.Automaton(*vocab))
        got = [int(counter.count(pa.array([t]))[0]) for t in texts]
    assert got == [len(x) for x in sp.encode(texts, num_threads=1)]


# --- language model ----------------------------------------------------------------

def test_base_score_and_gain(spark, awkward, tables):
    real = read_table(spark, "/root/testdata/sf0.01", "documents").select(*awkward.columns)
    docs = real.union(awkward.selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars"))
    got = op4_lm.op4_lm_score(spark, tables(documents=docs.selectExpr("*", "1 as tail", "2 as word", "3 as n"))).toPandas()
    rows = [(r["doc_id"], words(r["text"]) + [None]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter()
    for i, t in rows:
        if i is not None and not held(i):
            c.update(t)
    total, kinds = sum(c.values()), len(c)
    want = sorted((len(t), sum(c[w] > 0 for w in t),
                   round(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t), 3)) for _, t in rows)
    assert sorted(zip(got.n_tokens, got.n_known, got.base_score.round(3))) == want
    assert (got.train_tokens == total).all()
    out = got[got.held_out.astype(bool)]
    assert out.score.sum() > out.base_score.sum()


def test_classes_are_normalised():
    prior = np.full(op4_lm.CLASSES + 2, 1.0)
    model = op4_lm.Model(prior / prior.sum())
    a, b, z = model.tables()
    for c1, c2 in ((0, 5), (7, op4_lm.CLASSES + 2), (1, 1)):
        assert abs(np.exp((a[c1] + b[c2] - z[c1, c2]).astype(float)).sum() - 1) < 1e-4


def test_most_frequent_types(spark):
    rng = random.Random(6)
    rows = [(i, int(2 ** (rng.random() * 20))) for i in range(3000)] + [(5000 + i, 1) for i in range(900)]
    df = spark.createDataFrame(rows, "word long, n long")
    for most in (0, 1, 50, 700, 2999, 3899, 3900, 10_000):
        got = [r["n"] for r in op4_lm.most_frequent(df, most).collect()]
        want = sorted((n for _, n in rows), reverse=True)
        assert len(got) <= most and sorted(got, reverse=True) == want[:len(got)]
        if len(got) < min(most, len(rows)):        # the next counts tie within a cell
            nxt = want[len(got)]
            cell = max(1, 2 ** (nxt.bit_length() - 1) // 1024)
            assert len(got) + sum(n // cell == nxt // cell for n in want) > most
    assert op4_lm.most_frequent(df.limit(0), 5).collect() == []


def test_lm_empty_tables(spark, nothing, awkward):
    none = nothing.selectExpr("doc_id", "false as held_out", "text")
    assert op4_lm.score_texts(none, awkward).collect() == []
    got = op4_lm.score_texts(awkward.selectExpr("doc_id", "true as held_out", "text"), nothing).collect()
    assert len(got) == awkward.count() and all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)


# --- exact top-k -------------------------------------------------------------------

def brute_top(rows, k=10):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in ok if i % 100 == 0}):
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def test_top_k_brute_force(spark, tables):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=20).round(2 if i % 3 else 0).tolist()) for i in range(460)]
    rows += [(500, rows[7][1]), (501, rows[7][1]), (501, rows[7][1]), (600, None), (700, [None] * 20), (None, rows[3][1]),
             (701, [float("nan")] * 20), (702, [float("inf")] * 20), (703, []), (704, [1.0, 2.0]), (800, [0.0] * 20),
             (900, rows[9][1]), (900, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as query_id")
    got = op8_topk.op8_topk(spark, tables(embeddings=df)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(brute_top(rows))
    assert op8_topk.op8_topk(spark, tables(embeddings=df.limit(0))).collect() == []


def test_top_k_large_components_and_passes(spark, tables, monkeypatch):
    monkeypatch.setattr(op8_topk, "PASS_BYTES", 64)
    rows = [(100 * i, [1e4 * i, -3.0, 2.5e5, float(i % 4)]) for i in range(12)] + [(i, [float(i), 1.0, 0.5, 2.0]) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = op8_topk.op8_topk(spark, tables(embeddings=df)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(brute_top(rows))


def test_top_k_scores_beyond_64_bits(spark, monkeypatch):
    """Ranks by exact scores, negative and positive, scores held to a long; one pass's queries at a time."""
    monkeypatch.setattr(op8_topk, "PASS_BYTES", 64)
    monkeypatch.setattr(op8_topk, "BLOCK", 4)
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float64(x) * 10.0 ** s) for x, s in zip(rng.normal(size=3), rng.integers(0, 17, 3))]) for i in range(40)]
    rows += [(40, [1e150, -1e150, 1.0]), (41, [-1e160, 0.0, 0.0]), (42, [0.0] * 3), (43, [1e307, 1.0, 1.0]), (44, rows[3][1]), (45, [-1e17, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = op8_topk.top_k(df.where("vec_id % 5 = 0"), df).collect()
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows if all(math.isfinite(1024 * x) for x in v)}
    want = []
    for q in (i for i in whole if i % 5 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)[:10]
        want += [(q, r + 1, i, min(max(-s, -2 ** 63), 2 ** 63 - 1)) for r, (s, i) in enumerate(best)]
    assert any(w[3] == 2 ** 63 - 1 for w in want) and 43 not in {w[2] for w in want}
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_top_k_queries_that_are_not_candidates(spark):
    rng = np.random.default_rng(4)
    near = [(i, [float(x) for x in 10 + rng.normal(size=8)]) for i in range(40)]
    far = [(1000 + i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    schema = "vec_id long, embedding array<float>"
    got = op8_topk.top_k(spark.createDataFrame(near, schema), spark.createDataFrame(far, schema)).collect()
    cut = lambda v: [math.floor(1024 * float(np.float32(x))) for x in v]
    want = []
    for q, v in near:
        best = sorted((-sum(a * b for a, b in zip(cut(v), cut(w))), i) for i, w in far)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_language_model_hardly_depends_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    gains = []
    for parts in (1, 32):
        dealt = docs.repartition(parts)
        held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
        got = op4_lm.score_texts(dealt.select("doc_id", held.alias("held_out"), "text"), dealt.where(~held).select("doc_id", "text"))
        row = got.where("held_out").agg(F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).first()
        gains.append(row[0])
    assert min(gains) > 0.04 and max(gains) <= 1.2 * min(gains)


def test_tables_and_chunks_of_a_task_follow_the_bytes_scanned_at_once():
    import tracemalloc

    from lumen.llm import op10_secrets, textops as tx
    from lumen.llm.op4_lm import _words

    texts = pa.array([f"alpha{i} beta gamma token=Zx9{i:07d}kQw" + " word" * 200 for i in range(3000)])
    assert texts.nbytes > 2 * tx.CHUNK_BYTES
    with np.errstate(over="ignore"):
        tracemalloc.start()
        scanner = op10_secrets.Scanner(np.zeros((38, 38)), np.zeros(0, np.int64))
        assert scanner.coverage(np.frombuffer(b"passwordpassword", np.uint8)) == 0
        tables = tracemalloc.get_traced_memory()[1]
        held = 0
        hasher = tx.Hasher(tx.SCAN_BYTES)
        tracemalloc.reset_peak()
        small = [(f, h.copy(), b) for f, h, b in op9_neardup.shingle_sets(hasher, texts, 3)]
        held = sum(h.nbytes for _, h, _ in small)
        peak = tracemalloc.get_traced_memory()[1] - held
        tracemalloc.stop()
        assert tables < 1 << 20 and peak < 48 << 20
        one = np.concatenate([h for _, h, _, _ in _words(texts, tx.Hasher())])
        two = np.concatenate([h for _, h, _, _ in _words(texts, tx.Hasher(tx.SCAN_BYTES), tx.SCAN_BYTES)])
    assert (one == two).all()
    assert sum(len(b) - 1 for _, _, b in small) == 3000 and len(small) > texts.nbytes // tx.CHUNK_BYTES + 1


def test_workers_give_their_memory_back():
    from lumen.llm import textops as tx

    held = []

    def run(batches):
        for batch in batches:
            held.append(np.ones(6_000))                                   # 48 KB each, of the heap
            yield batch

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["a"])
    tidied = tx.tidy(run)(batch for _ in range(2_000))
    assert all(next(tidied).equals(batch) for _ in range(2_000))
    above = np.ones(6_000)                                                # what is below it stays with the process when freed
    held.clear()
    full = resident()
    assert list(tidied) == [] and full - resident() > 50_000_000 and above.all()
    closed = tx.tidy(run)(batch for _ in range(3))
    assert next(closed).equals(batch)
    closed.close()
