"""Language-model scores from a log-bilinear neural model trained with noise-contrastive
estimation in numpy.

Word counts cover the whole training part and are shuffled once. The model predicts the
class of the next token from the two before it: the ``CLASSES`` most frequent types, the
end of text, or "rare". Its score of a class is a bilinear form of learned vectors. One task
first trains on about ``WARM`` tokens, drawn by a hash of the rows; from there every task
trains its part of the corpus, with the step sizes reached, and the parameters are averaged
by tokens, so the model hardly depends on how the corpus is dealt to tasks. At scoring time the normaliser of every context pair is one batched matrix
product, exp(A) exp(B)^T, so each token's probability is exactly normalised for a
constant number of lookups. A rare token's probability is its class's, times its smoothed
share among the rare types, so all types and the unknown word together sum to one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm import textops as tx
from lumen.llm.common import crc_of_id, materialize, read_table

U = np.uint64
CLASSES, DIMS, NOISE, BATCH = 1022, 16, 64, 4096
#: Counts of so many most frequent types go to the tasks; the other tokens are joined.
LOCAL_TYPES = 1 << 17
#: Tokens of the first training, by one task, in so many passes.
WARM, PASSES = 2_000_000, 2
#: Distinct words a task holds before it passes its counts on.
HELD_WORDS = 2_000_000
SMOOTH = 0.1
#: Documents scored at a time: bounds what a task holds, whatever the size of an Arrow batch.
SLICE = 2000


def _words(column: pa.Array, hasher: tx.Hasher, max_bytes: int = tx.CHUNK_BYTES
           ) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, word hashes, bounds, last): ``last`` marks a document's final piece."""
    data, offsets = tx.column_bytes(column)
    done, seen = 0, -1
    for first, d, o in tx.chunks(data, offsets, max_bytes, piece=tx.CHUNK_BYTES):
        _, _, h, wb = hasher.words(d, o)
        done = done + len(d) if first == seen else len(d)
        seen = first
        whole = len(o) > 2 or done >= offsets[first + 1] - offsets[first]
        yield first, h.view(np.int64), wb, np.full(len(o) - 1, whole)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word hash, count) over all words of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, words, counts, pending = tx.Hasher(tx.SCAN_BYTES), np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h = np.concatenate([words] + [p[0] for p in pending])
            c = np.concatenate([counts] + [p[1] for p in pending])
            order = np.argsort(h)
            h, c = h[order], c[order]
            first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
            return h[first], np.add.reduceat(c, first) if len(c) else c

        with np.errstate(over="ignore"):
            for batch in batches:
                for _, h, _, _ in _words(batch.column("text"), hasher, tx.SCAN_BYTES):
                    pending.append(np.unique(h, return_counts=True))
                    if sum(len(p[0]) for p in pending) > 250_000:
                        words, counts = merged()
                        pending = []
                        if len(words) > HELD_WORDS:
                            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts)], names=["word", "n"])
                            words, counts = words[:0], counts[:0]
            words, counts = merged()
            for i in range(0, len(words), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i:i + 100_000]), pa.array(counts[i:i + 100_000])],
                                                 names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The types of ``counts`` (word, n) at or above the smallest count that at most
    ``most`` types reach, up to 1/1024 of a power of two. Two aggregations of at most 64
    and 1024 rows find the count, so no task merges sorted runs of all others."""
    power = F.floor(F.log2("n")).cast("int")
    above, least = 0, 1
    rows = {r["p"]: r["c"] for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("c")).collect()}
    for p in sorted(rows, reverse=True):
        if above + rows[p] > most:
            least = 2 ** (p + 1)
            width = max(1, 2 ** p // 1024)
            cell = F.floor((F.col("n") - 2 ** p) / width).cast("int")
            cells = {r["k"]: r["c"] for r in counts.where(power == p).groupBy(cell.alias("k"))
                     .agg(F.count("*").alias("c")).collect()}
            for k in sorted(cells, reverse=True):
                if above + cells[k] > most:
                    break
                above += cells[k]
                least = 2 ** p + k * width
            break
        above += rows[p]
    return counts.where(F.col("n") >= least)


class Types:
    """The most frequent types: class numbers and counts by word hash. Class 0 is the
    end of text, 1 "rare", 2.. the model's words; context CLASSES + 2 is "before the text"."""

    def __init__(self, words: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        number = np.arange(len(words)) + 2
        self.number = np.where(number < CLASSES + 2, number, 1)[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, count or -1 if the type is not among these)."""
        if not len(self.words):
            return np.ones(len(h), np.int64), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = self.words[at] == h
        return np.where(hit, self.number[at], 1), np.where(hit, self.counts[at], -1)


def contexts(cls: np.ndarray, bounds: np.ndarray, last: np.ndarray, before: tuple[int, int] | None
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token classes with ends, the two classes before each, and token bounds. ``before``
    carries the context into the next piece of a long document."""
    size = np.diff(bounds) + last
    out = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    tok = np.zeros(out[-1], np.int64)
    tok[np.arange(len(cls)) + np.repeat(out[:-1] - bounds[:-1], np.diff(bounds))] = cls
    start = CLASSES + 2
    c1, c2 = np.full(len(tok), start), np.full(len(tok), start)
    c1[1:], c2[2:] = tok[:-1], tok[:-2]
    heads = out[:-1][size > 0]
    c1[heads] = start
    c2[heads] = start
    two = out[:-1][size > 1] + 1
    c2[two] = start
    if before is not None and len(tok):
        c1[0], c2[0] = before
        if size[0] > 1:
            c2[1] = before[0]
    return tok, c1, c2, out


class Model:
    """Vectors of contexts (R) and of predicted classes (Q), position weights (C), biases (b)."""

    def __init__(self, prior: np.ndarray) -> None:
        rng = np.random.default_rng(11)
        self.prior = prior
        self.r = rng.normal(0, 0.3, (CLASSES + 3, DIMS))
        self.q = rng.normal(0, 0.3, (CLASSES + 2, DIMS))
        self.c = np.ones((2, DIMS)) * np.array([[1.0], [0.6]])
        self.b = np.log(prior)
        self.square = [np.full(x.shape, 0.1) for x in (self.r, self.q, self.c, self.b)]
        self.draws = np.cumsum(prior)
        self.rng = rng

    def _step(self, which: int, param: np.ndarray, rows: np.ndarray | slice, grad: np.ndarray, rate: float) -> None:
        self.square[which][rows] += grad * grad
        param[rows] -= rate * grad / np.sqrt(self.square[which][rows])

    @staticmethod
    def _by_row(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        return rows[first], np.add.reduceat(grad[order], first, axis=0)

    def train(self, tok: np.ndarray, c1: np.ndarray, c2: np.ndarray, rate: float = 0.2) -> None:
        """One noise-contrastive step: the true class against NOISE classes drawn from
        the unigram distribution, shared by the minibatch."""
        noise = np.minimum(np.searchsorted(self.draws, self.rng.random(NOISE)), len(self.prior) - 1)
        r1, r2 = self.r[c1], self.r[c2]
        h = r1 * self.c[0] + r2 * self.c[1]
        qt, qn = self.q[tok], self.q[noise]
        s_t = np.einsum("ij,ij->i", h, qt) + self.b[tok] - np.log(NOISE * self.prior[tok])
        s_n = h @ qn.T + self.b[noise] - np.log(NOISE * self.prior[noise])
        g_t = -1 / (1 + np.exp(np.clip(s_t, -30, 30)))
        g_n = 1 / (1 + np.exp(-np.clip(s_n, -30, 30)))
        scale = 1.0 / len(tok) * 64
        g_t, g_n = g_t * scale, g_n * scale
        dh = g_t[:, None] * qt + g_n @ qn
        rows = np.concatenate((tok, noise))
        grad = np.concatenate((g_t[:, None] * h, g_n.T @ h))
        bias = np.concatenate((g_t, g_n.sum(0)))
        rows, both = self._by_row(rows, np.column_stack((grad, bias)))
        ctx, gr = self._by_row(np.concatenate((c1, c2)), np.concatenate((dh * self.c[0], dh * self.c[1])))
        gc = np.stack(((dh * r1).sum(0), (dh * r2).sum(0)))
        self._step(0, self.r, ctx, gr, rate)
        self._step(1, self.q, rows, both[:, :-1], rate)
        self._step(3, self.b, rows, both[:, -1], rate)
        self._step(2, self.c, slice(None), gc / 64, rate)

    def state(self) -> bytes:
        """Parameters and their sums of squared gradients."""
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.c, self.b, *self.square)]).tobytes()

    def set_state(self, state: bytes) -> "Model":
        flat, at = np.frombuffer(state), 0
        for group in ([self.r, self.q, self.c, self.b], self.square):
            for x in group:
                x[...] = flat[at:at + x.size].reshape(x.shape)
                at += x.size
        return self

    def rows(self) -> np.ndarray:
        """All parameters as rows of DIMS + 1 numbers."""
        pad = lambda x: np.column_stack((x, np.zeros(len(x))))
        return np.concatenate((pad(self.r), np.column_stack((self.q, self.b)), pad(self.c)))

    def set_rows(self, rows: np.ndarray) -> None:
        n = len(self.r)
        m = n + len(self.q)
        self.r, self.q, self.b, self.c = rows[:n, :-1], rows[n:m, :-1], rows[n:m, -1], rows[m:, :-1]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A, B, log Z): log P(w | c1, c2) = A[c1, w] + B[c2, w] - log Z[c1, c2]."""
        a = ((self.r * self.c[0]) @ self.q.T + self.b).astype(np.float32)
        b = ((self.r * self.c[1]) @ self.q.T).astype(np.float32)
        top_a, top_b = a.max(1, keepdims=True), b.max(1, keepdims=True)
        z = np.exp(a - top_a) @ np.exp(b - top_b).T
        return a, b, (np.log(z) + top_a + top_b.T).astype(np.float32)


def _train(model: Model, types: Types, column: pa.Array, hasher: tx.Hasher, most: float = math.inf) -> int:
    """Trains on the texts of a batch, up to about ``most`` tokens; returns how many."""
    tokens, before = 0, None
    for _, h, wb, last in _words(column, hasher):
        tok, c1, c2, _ = contexts(types.find(h)[0], wb, last, before)
        before = None if last[-1] or not len(tok) else (int(tok[-1]), int(tok[-2]) if len(tok) > 1 else int(c1[-1]))
        for i in range(0, len(tok), BATCH):
            model.train(tok[i:i + BATCH], c1[i:i + BATCH], c2[i:i + BATCH])
        tokens += len(tok)
        if tokens >= most:
            break
    return tokens


def warm_start(texts: DataFrame, types: Types, prior: np.ndarray, total: int) -> bytes | None:
    """The state of a model trained by one task on rows of about ``WARM`` tokens, chosen and
    ordered by a hash of the whole row, whatever the layout; null without any row."""
    key = F.xxhash64(*texts.columns)
    share = min(1.0, WARM / max(1, total))
    chosen = texts.select("text", key.alias("k")).where((F.col("k").cast("double") + 2.0 ** 63) / 2.0 ** 64 <= share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, model, held, tokens = tx.Hasher(), Model(prior), [], 0
        with np.errstate(over="ignore"):
            for batch in batches:
                held.append(batch.column("text"))
                tokens += _train(model, types, held[-1], hasher, 2 * WARM - tokens)
                if tokens >= 2 * WARM:
                    break
            for _ in range(PASSES - 1):
                left = tokens
                for column in held:
                    left -= _train(model, types, column, hasher, left)
                    if left <= 0:
                        break
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([model.state()], pa.binary())], names=["state"])

    found = chosen.repartition(1).sortWithinPartitions("k").select("text").mapInArrow(run, "state binary").first()
    return found["state"] if found else None


def train_model(texts: DataFrame, types: Types, prior: np.ndarray, total: int) -> Model:
    """From the warm start every task makes one pass over its texts; parameters are averaged
    by tokens."""
    columns = [f"p{i}" for i in range(DIMS + 1)]
    schema = "row int, tokens double, " + ", ".join(f"{c} double" for c in columns)
    model, start = Model(prior), warm_start(texts, types, prior, total)
    if start is None:
        return model
    model.set_state(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own, tokens = tx.Hasher(), Model(prior).set_state(start), 0
        with np.errstate(over="ignore"):
            for batch in batches:
                tokens += _train(own, types, batch.column("text"), hasher)
        if tokens:
            rows = own.rows()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(np.full(len(rows), float(tokens)))]
                + [pa.array(rows[:, i].copy()) for i in range(DIMS + 1)], names=["row", "tokens"] + columns)

    mean = (texts.select("text").mapInArrow(run, schema).groupBy("row")
            .agg(*[(F.sum(F.col(c) * F.col("tokens")) / F.sum("tokens")).alias(c) for c in columns])
            .orderBy("row").collect())
    if mean:
        model.set_rows(np.array([[r[c] for c in columns] for r in mean]))
    return model


def score_texts(docs: DataFrame, train: DataFrame) -> DataFrame:
    """``docs`` (doc_id, held_out, text) scored by a model of ``train`` (text).

    Tokens are words with A-Z lowered, then one end. Returns doc_id, held_out, n_tokens,
    n_known (type seen in training), train_tokens, base_score (smoothed unigram log10
    probability) and score (the model's). Null and empty texts have the end alone;
    repeated rows score alike; with an empty training table every type is unknown and
    all probability is the unknown word's and the end's by smoothing. Every word of every
    text counts; extra columns are ignored.
    """
    counts = materialize(word_counts(train))
    ends = train.count()
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = row["n"] + ends, row["v"] + (ends > 0)
    top = most_frequent(counts, LOCAL_TYPES).toArrow()
    words, n = np.asarray(top.column("word"), np.int64), np.asarray(top.column("n"), np.int64)
    order = np.lexsort((words, -n))
    words, n = words[order], n[order]
    types = Types(words, n)
    rare_n = total - ends - int(n[:CLASSES].sum())
    rare_v = distinct - (ends > 0) - min(CLASSES, len(words))
    prior = np.full(CLASSES + 2, SMOOTH)
    prior[0] += ends
    prior[1] = rare_n + SMOOTH * (rare_v + 1)
    prior[2:2 + len(n[:CLASSES])] += n[:CLASSES]
    log_rare = math.log10(prior[1])
    prior[2 + len(n[:CLASSES]):] = 1e-9
    prior = prior / prior.sum()
    model = train_model(train, types, prior, total)
    base_z = math.log10(total + SMOOTH * (distinct + 1))
    log_end = math.log10(ends + SMOOTH) if ends else math.log10(SMOOTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tx.Hasher()
        a, b, z = model.tables()
        with np.errstate(over="ignore"):
            for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
                m = batch.num_rows
                n_tokens, known, logs, lm = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
                tails, tail_of, before = [], [], None
                for first, h, wb, last in _words(batch.column("text"), hasher):
                    cls, c = types.find(h)
                    tok, c1, c2, tb = contexts(cls, wb, last, before)
                    before = None if last[-1] or not len(tok) else (
                        int(tok[-1]), int(tok[-2]) if len(tok) > 1 else int(c1[-1]))
                    docs_ = np.arange(first, first + len(wb) - 1)
                    doc = np.repeat(docs_, np.diff(wb))
                    p = (a[c1, tok] + b[c2, tok] - z[c1, c2]).astype(np.float64) / math.log(10)
                    np.add.at(lm, np.repeat(docs_, np.diff(tb)), p)
                    here, rare = c >= 0, cls == 1
                    np.add.at(logs, doc[here], np.log10(c[here] + SMOOTH))
                    np.add.at(lm, doc[here & rare], np.log10(c[here & rare] + SMOOTH))
                    np.add.at(lm, doc[rare], -log_rare)
                    np.add.at(known, doc[here], 1)
                    n_tokens[docs_] += np.diff(tb)
                    tails.append(h[~here])
                    tail_of.append(doc[~here])
                logs += log_end
                known += ends > 0
                tail = np.concatenate(tails) if tails else np.zeros(0, np.int64)
                size = np.bincount(np.concatenate(tail_of) if tails else np.zeros(0, np.int64), minlength=m)
                bounds = np.zeros(m + 1, np.int32)
                np.cumsum(size, out=bounds[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens), pa.array(known),
                     pa.array(logs), pa.array(lm), pa.ListArray.from_arrays(pa.array(bounds), pa.array(tail))],
                    names=["doc_id", "held_out", "n_tokens", "known", "logs", "lm", "tail"])

    scored = materialize(docs.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, known long, logs double, lm double, tail array<long>")
        .withColumn("id", F.monotonically_increasing_id()))
    tail = (scored.select("id", F.explode("tail").alias("word")).join(counts, "word", "left")
            .groupBy("id").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("more"),
                               F.count("n").alias("seen")))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("tail").join(tail, "id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(base_z)).alias("base_score"),
        (F.col("lm") + more).alias("score"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rest = crc_of_id(F.col("doc_id")) % 10
    return score_texts(docs.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "text"),
                       docs.where(rest != 0).select("doc_id", "text"))
