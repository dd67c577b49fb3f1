"""Averaged hashed subword embeddings with a softmax output, trained by
stochastic gradient descent in numpy (shared by language ID and quality).

A text is three bags of hashed features: byte 3- and 4-grams, words, and
bigrams of word shapes (case, punctuation, digits, "same word as before").
Each bag's learned embeddings are averaged, the averages are added, and a
linear softmax gives class probabilities, sharpened by a fitted temperature.
Since the output layer is linear, scoring needs only ``embedding @ weights``,
one row of class scores per bucket: a text costs one gather per feature.

Fitting uses a bounded, seeded sample of labelled rows (``rows_per_class``);
its features, not its texts, reach the driver. Scoring covers every byte of
every text in bounded chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.llm import textops as tx
from lumen.llm.common import unit_hash

U = np.uint64
BUCKETS = 1 << 15
GROUPS = 3
#: Bytes of short texts whose features a task holds at once (some 50 bytes for each).
SCORE_BYTES = 1 << 18


def _shape_table() -> np.ndarray:
    t = np.full(256, 4, np.int64)          # other bytes: letters beyond ASCII
    t[33:127] = 3                          # punctuation
    t[48:58] = 2                           # digits
    t[65:91] = 1                           # upper case
    t[97:123] = 0                          # lower case
    return t


SHAPE = _shape_table()


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> U(49)).astype(np.int32)


class Features:
    """Bucket ids of a chunk, per group, with document bounds."""

    def __init__(self, fold_case: bool) -> None:
        self.fold_case = fold_case
        self.hasher = tx.Hasher(SCORE_BYTES)

    def groups(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        d = tx.LOWER[data] if self.fold_case else data
        n = len(d)
        grams = []
        if n >= 3:
            v = d.astype(U)
            g3 = v[:-2] | (v[1:-1] << U(8)) | (v[2:] << U(16))
            grams.append((3, g3))
            if n >= 4:
                grams.append((4, g3[:-1] | (v[3:] << U(24)) | U(1 << 40)))
        ids, bounds = [], []
        for width, g in grams:
            code = _slot(g * U(0x9E3779B97F4A7C15) ^ (g * U(0xC2B2AE3D27D4EB4F) << U(7)))
            keep = np.ones(len(code), bool)      # grams must not cross documents
            for k in range(1, width):
                cut = offsets[1:-1] - k
                keep[cut[(cut >= 0) & (cut < len(code))]] = False
            pos = np.flatnonzero(keep)
            ids.append(code[pos])
            bounds.append(np.searchsorted(pos, offsets))
        start, end, h, wb = self.hasher.words(data, offsets, lower=self.fold_case)
        size = np.diff(wb)
        shape = (SHAPE[data[start]] * 25 + SHAPE[data[end - 1]] * 5 + SHAPE[data[(start + end - 1) >> 1]] if len(h)
                 else np.zeros(0, np.int64))
        shape = shape * 4 + np.minimum((end - start) >> 2, 3)
        before = np.full(len(h), 511, np.int64)
        before[1:] = shape[:-1]
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        firsts = wb[:-1][size > 0]
        before[firsts], same[firsts] = 511, False
        pair = ((before * 512 + shape) * 2 + same).astype(U) + U(1 << 50)
        marker = np.where(same, U(3 << 50), pair)
        out = [self._join(ids, bounds, len(offsets) - 1), (_slot(tx.mix(h + U(17))), wb),
               (_slot(tx.mix(marker)), wb)]
        return out

    @staticmethod
    def _join(ids: list, bounds: list, docs: int) -> tuple[np.ndarray, np.ndarray]:
        if not ids:
            return np.zeros(0, np.int32), np.zeros(docs + 1, np.int64)
        if len(ids) == 1:
            return ids[0], bounds[0]
        total = bounds[0] + bounds[1]
        out = np.empty(int(total[-1]), np.int32)
        for k in (0, 1):
            size = np.diff(bounds[k])
            at = np.arange(len(ids[k])) + np.repeat(total[:-1] - bounds[k][:-1]
                                                    + (np.diff(bounds[0]) if k else 0), size)
            out[at] = ids[k]
        return out, total


@dataclass
class SubwordModel:
    labels: list
    table: np.ndarray          # group, bucket, class: embedding @ weights
    bias: np.ndarray
    temperature: float
    fold_case: bool
    reject_below: float        # evidence under which a text is rejected
    density: np.ndarray | None = None  # log density of the byte grams over all classes alike
    spread: float = 0.0        # deviation of one gram's log density

    def probabilities(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class probabilities, features seen, evidence) of every text."""
        data, offsets = tx.column_bytes(column)
        n, k = len(offsets) - 1, len(self.labels)
        feats = Features(self.fold_case)
        sums, seen, dense = np.zeros((n, GROUPS, k)), np.zeros((n, GROUPS), np.int64), np.zeros(n)
        with np.errstate(over="ignore"):
            for first, d, o in tx.chunks(data, offsets, SCORE_BYTES, piece=tx.CHUNK_BYTES):
                docs = len(o) - 1
                for g, (ids, bounds) in enumerate(feats.groups(d, o)):
                    size = np.diff(bounds)
                    some = np.flatnonzero(size > 0)
                    if len(some):
                        if g == 0 and self.density is not None:
                            dense[first + some] += np.add.reduceat(
                                np.take(self.density, ids), bounds[:-1][some], dtype=np.float64)
                        for c in range(k):
                            sums[first + some, g, c] += np.add.reduceat(
                                np.take(self.table[g, :, c], ids), bounds[:-1][some], dtype=np.float64)
                        seen[first:first + docs, g] += size
        logits = (sums / np.maximum(seen, 1)[:, :, None]).sum(1) + self.bias
        logits /= self.temperature
        logits -= logits.max(1, keepdims=True) if k else 0
        p = np.exp(logits)
        known = evidence(dense, seen[:, 0], self.spread) if self.density is not None else np.full(n, np.inf)
        return p / p.sum(1, keepdims=True) if k else p, seen.sum(1), known


def evidence(total: np.ndarray, n: np.ndarray, spread: float) -> np.ndarray:
    """Mean log density of a text's ``n`` grams and two standard errors, so that a short
    text is not rejected by chance; -inf without any gram. Class sizes play no part."""
    some = np.maximum(n, 1)
    return np.where(n > 0, total / some + 2 * spread / np.sqrt(some), -np.inf)


def calibrate_rejection(train: list[tuple], held: list[tuple], k: int, keep_share: float
                        ) -> tuple[np.ndarray, float, float]:
    """(log density, spread, threshold) from rows (class, ids, counts, totals). The grams'
    density is the mean of the classes'. Rows of ``held`` scored without their own class
    show what texts of an unlearned class look like; the threshold lies halfway between
    them and the known ones, but never rejects over 1 - ``keep_share`` of these."""
    share, drawn = np.zeros((k, BUCKETS)), np.zeros(k)

    def grams(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ids[ids < BUCKETS], counts[ids < BUCKETS].astype(np.float64)

    for y, ids, counts, _ in train:
        i, c = grams(ids, counts)
        share[y, i] += c / max(1.0, c.sum())
        drawn[y] += 1
    share = 0.99 * share / np.maximum(drawn, 1)[:, None] + 0.01 / BUCKETS
    density = np.log(share.mean(0))
    spread = float(np.sqrt(share.mean(0) @ (density - share.mean(0) @ density) ** 2))
    others = [np.log(np.delete(share, y, 0).mean(0)) for y in range(k)]
    known, foreign = [], []
    for y, ids, counts, _ in held:
        i, c = grams(ids, counts)
        if len(i):
            n = np.array([c.sum()])
            known.append(evidence(np.array([c @ density[i]]), n, spread)[0])
            foreign.append(evidence(np.array([c @ others[y][i]]), n, spread)[0])
    if not known:
        return density.astype(np.float32), spread, -np.inf
    low = float(np.quantile(known, 1 - keep_share))
    return density.astype(np.float32), spread, min(low, (low + float(np.median(foreign))) / 2)


def _collect_features(texts: DataFrame, fold_case: bool) -> list[tuple]:
    """(label, group sizes, bucket ids, counts) of the sampled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats = Features(fold_case)
        for batch in batches:
            data, offsets = tx.column_bytes(batch.column("text"))
            out = []
            for i in range(len(offsets) - 1):
                ids, counts, totals = [], [], []
                with np.errstate(over="ignore"):
                    per = [[], [], []]
                    for _, d, o in tx.chunks(data, offsets[i:i + 2]):
                        for g, (x, _) in enumerate(feats.groups(d, o)):
                            per[g].append(x)
                for g in range(GROUPS):
                    u, c = np.unique(np.concatenate(per[g]) if per[g] else np.zeros(0, np.int32), return_counts=True)
                    ids.append(u + g * BUCKETS)
                    counts.append(c)
                    totals.append(int(c.sum()))
                out.append((np.concatenate(ids).astype("<i4").tobytes(),
                            np.minimum(np.concatenate(counts), 65535).astype("<u2").tobytes(), totals))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([x[0] for x in out], pa.binary()),
                 pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.list_(pa.int64()))],
                names=["label", "ids", "counts", "totals"])

    # the arrays below are views of the Arrow buffers: the sample is held once
    table = texts.mapInArrow(tx.tidy(run), "label string, ids binary, counts binary, totals array<long>").toArrow()
    return [(lab.as_py(), np.frombuffer(i.as_buffer(), "<i4"), np.frombuffer(c.as_buffer(), "<u2"),
             np.maximum(t.as_py(), 1).astype(np.float32))
            for lab, i, c, t in zip(*(table.column(k) for k in ("label", "ids", "counts", "totals")))]


def fit(labelled: DataFrame, texts: DataFrame, fold_case: bool, rows_per_class: int, dims: int = 16,
        epochs: int = 5, rate: float = 0.5, keep_share: float = 0.999, seed: int = 7,
        rejection: bool = False) -> SubwordModel:
    """Fit on ``labelled`` (label, key) and ``texts`` (key, text). About
    ``rows_per_class`` rows of each class are used, those with the smallest seeded
    hash of their key; class priors come from counts over all labelled rows. The
    sample's keys are broadcast (``rows_per_class`` x classes), so texts are filtered
    where they lie. Every tenth sampled row calibrates the temperature and, with
    ``rejection``, the rejection threshold instead."""
    labelled = labelled.where(F.col("label").isNotNull()).select(
        F.col("label").cast("string").alias("label"), F.col("key"))
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    labels = sorted(sizes)
    k = len(labels)
    empty = SubwordModel(labels, np.zeros((GROUPS, BUCKETS, k), np.float32), np.zeros(k), 1.0, fold_case, 0.0)
    if k < 2:
        return empty
    share = F.lit(0.0)
    for lab, n in sizes.items():
        share = F.when(F.col("label") == lab, F.lit(min(1.0, rows_per_class / n))).otherwise(share)
    keys = labelled.where(unit_hash(F.col("key"), seed=f"fit{seed}") < share).dropDuplicates(["key"])
    sample = texts.select("key", "text").join(F.broadcast(keys), "key").select("label", "text")
    rows = sorted(_collect_features(sample, fold_case), key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    rng = np.random.default_rng(seed)
    rng.shuffle(rows)
    index = {lab: i for i, lab in enumerate(labels)}
    docs = [(index[lab], ids, counts, totals) for lab, ids, counts, totals in rows]
    held, train = docs[::10], [d for i, d in enumerate(docs) if i % 10]
    if not train:
        return empty
    emb = rng.uniform(-0.5 / dims, 0.5 / dims, (GROUPS * BUCKETS, dims)).astype(np.float32)
    out = np.zeros((dims, k), np.float32)
    out[:] = rng.normal(0, 0.5, out.shape)
    bias = np.zeros(k, np.float32)
    emb_sq, out_sq = np.full(GROUPS * BUCKETS, 1e-4, np.float32), np.full(out.shape, 1e-2, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(train)):
            y, ids, counts, totals = train[i]
            w = counts / totals[ids // BUCKETS]
            e = emb[ids]
            x = w @ e
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            dx = out @ p
            grad = np.outer(x, p)
            out_sq += grad * grad
            out -= step * 0.2 * grad / np.sqrt(out_sq)
            bias -= step * 0.02 * p
            emb_sq[ids] += w * w * float(dx @ dx) / dims
            emb[ids] = e - step * 0.2 * np.outer(w / np.sqrt(emb_sq[ids]), dx)
    drawn = np.bincount([d[0] for d in docs], minlength=k)
    bias = bias.astype(np.float64) + np.log([sizes[lab] for lab in labels]) - np.log(np.maximum(drawn, 1))
    density, spread, reject = calibrate_rejection(train, held, k, keep_share) if rejection else (None, 0.0, -np.inf)
    z = np.array([(c / t[ids // BUCKETS]) @ (emb[ids] @ out) + bias for _, ids, c, t in held] or [bias])
    y = np.array([d[0] for d in held] or [0])

    def nll(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    temperature = min(np.geomspace(0.5, 8, 33), key=nll)
    table = (emb @ out).reshape(GROUPS, BUCKETS, k)
    return SubwordModel(labels, table, bias, float(temperature), fold_case, reject, density, spread)
