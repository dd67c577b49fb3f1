"""Benchmark decontamination by the q-gram lemma.

A passage of m bytes that occurs with at most k edits shares at least
m + 1 - q(k + 1) of its q-grams with the text, all within k + 1 neighbouring
diagonals (text position minus passage position). Shared q-grams are counted in
diagonal bands of twice that width which overlap by half, so every window of k + 1
diagonals lies in one band; bands that meet the bound are verified by alignment
inside the band.

Documents are never shuffled: the benchmark is read in blocks of at most
``BLOCK_BYTES`` of passages, whose q-gram index goes to the tasks, and the documents
are scanned once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm import textops as tx
from lumen.llm.common import read_table

U = np.uint64
Q = 12
#: Edits allowed per byte of a passage (fewer where the lemma would have no force).
EDIT_RATE = 0.05
#: Passages shorter than this after normalisation are too short to be evidence.
MIN_PASSAGE = 32
#: Passages of one block; more passages are more blocks.
BLOCK_BYTES = 4 << 20


def normalized(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lowered, runs of white space as one space, none at the ends; and where
    each kept byte stood."""
    space = tx.SPACE[data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(keep)
    out = np.where(space[at], np.uint8(32), tx.LOWER[data[at]])
    return out, at


class PassageIndex:
    """Sorted q-gram hashes of a block of passages with their places."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.hasher = tx.Hasher()
        self.items = []
        for item, raw in items:
            p, _ = normalized(np.frombuffer(raw, np.uint8))
            p = p[1:] if len(p) and p[0] == 32 else p
            p = p[:-1] if len(p) and p[-1] == 32 else p
            if len(p) >= MIN_PASSAGE:
                self.items.append((item, p))
        self.length = np.array([len(p) for _, p in self.items], np.int64)
        self.budget = np.minimum((self.length * EDIT_RATE).astype(np.int64), (self.length - Q) // Q)
        self.need = self.length + 1 - Q * (self.budget + 1)
        self.width = self.budget + 1
        grams, item, place = [], [], []
        for k, (_, p) in enumerate(self.items):
            g = self.grams(p)
            grams.append(g)
            item.append(np.full(len(g), k, np.int64))
            place.append(np.arange(len(g)))
        g = np.concatenate(grams) if grams else np.zeros(0, U)
        order = np.argsort(g, kind="stable")
        self.sorted = g[order]
        self.item = np.concatenate(item)[order] if grams else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if grams else np.zeros(0, np.int64)
        self.bits = max(16, int(len(g) * 16).bit_length())
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(g >> U(64 - self.bits)).astype(np.int64)] = True
        self.window = int((self.length + self.budget).max()) if len(self.length) else 0

    def grams(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n < Q:
            return np.zeros(0, U)
        self.hasher._grow(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(self.hasher.table[data] * self.hasher.power[:n], out=total[1:])
        return (total[Q:] - total[:-Q]) * self.hasher.inverse[:n - Q + 1] * U(0x9E3779B97F4A7C15)

    def regions(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, passage, first diagonal) of the bands that meet the bound."""
        none = (np.zeros(0, np.int64),) * 3
        g = self.grams(data)
        if not len(g) or not len(self.items):
            return none
        pos = np.flatnonzero(self.maybe[(g >> U(64 - self.bits)).astype(np.int64)])
        lo = np.searchsorted(self.sorted, g[pos])
        hit = self.sorted[np.minimum(lo, len(self.sorted) - 1)] == g[pos]
        pos, lo = pos[hit], lo[hit]
        doc = np.searchsorted(offsets, pos, side="right") - 1
        inside = pos + Q <= offsets[doc + 1]
        pos, lo, doc = pos[inside], lo[inside], doc[inside]
        # a passage's window must hold enough hits whatever they belong to
        least, n = int(self.need.min()), len(pos)
        if n < least:
            return none
        tight = np.flatnonzero(pos[least - 1:] - pos[:n - least + 1] <= self.window)
        if not len(tight):
            return none
        near = np.zeros(n + 1, np.int64)
        np.add.at(near, tight, 1)
        np.add.at(near, tight + least, -1)
        use = np.cumsum(near[:-1]) > 0
        pos, lo, doc = pos[use], lo[use], doc[use]
        hi = np.searchsorted(self.sorted, g[pos], side="right")
        times = hi - lo
        entry = np.repeat(lo - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
        pos, doc = np.repeat(pos, times), np.repeat(doc, times)
        item = self.item[entry]
        diagonal = pos - self.place[entry] + self.window       # never negative
        band = diagonal // self.width[item]
        bands = int(band.max()) + 2
        key = (doc * len(self.items) + item) * bands + band
        key, count = np.unique(np.concatenate((key, key - 1)), return_counts=True)
        item = key // bands % len(self.items)
        enough = count >= self.need[item]
        key, item = key[enough], item[enough]
        return key // bands // len(self.items), item, key % bands * self.width[item] - self.window

    def align(self, data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, item: np.ndarray,
              first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, passage, edits, start, end) of the regions whose best alignment
        within the band stays in the passage's budget; cost and start travel as one
        number, so the minimum keeps both."""
        out = []
        if not len(doc):
            return out
        wide = int(2 * self.width[item].max())
        rows = int(self.length[item].max())
        pattern = np.full((len(doc), rows), 300, np.int16)
        text = np.full((len(doc), rows + wide), 301, np.int16)
        for k, (d, p, f) in enumerate(zip(doc.tolist(), item.tolist(), first.tolist())):
            pattern[k, :self.length[p]] = self.items[p][1]
            lo, hi = max(f, int(offsets[d])), min(f + rows + wide, int(offsets[d + 1]))
            if hi > lo:
                text[k, lo - f:hi - f] = data[lo:hi]
        one = 1 << 20
        step = np.arange(wide, dtype=np.int64) * one
        column = np.arange(wide)
        outside = column[None, :] >= 2 * self.width[item][:, None]
        cost = np.where(outside, one << 12, np.broadcast_to(column, (len(doc), wide)).astype(np.int64))
        for r in range(rows):
            run = cost + one * (pattern[:, r:r + 1] != text[:, r:r + wide])
            run[:, :-1] = np.minimum(run[:, :-1], cost[:, 1:] + one)
            new = np.minimum.accumulate(run - step, axis=1) + step
            cost = np.where((self.length[item] > r)[:, None], new, cost)
            cost[outside] = one << 12
        best = cost.argmin(1)
        for k in np.flatnonzero(cost.min(1) // one <= self.budget[item]):
            c, p = int(cost[k, best[k]]), int(item[k])
            out.append((int(doc[k]), p, c // one, int(first[k]) + c % one,
                        int(first[k]) + int(self.length[p]) + int(best[k])))
        return out

    def search(self, column: pa.Array) -> dict[tuple[int, int], tuple[int, int, int]]:
        """{(row, passage): (edits, start, end)}: the best occurrence of each passage
        in each text, as byte offsets of the text."""
        data, offsets = tx.column_bytes(column)
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        seen, base = -1, 0
        overlap = 4 * self.window + 64
        for first, d, o in tx.chunks(data, offsets, overlap=overlap):
            if len(o) == 2 and first == seen:
                base += last - overlap
            else:
                seen, base = first, 0
            last = len(d)
            text, at = normalized(d)
            cut = np.searchsorted(at, o)
            doc, item, diagonal = self.regions(text, cut)
            for i in range(0, len(doc), 256):
                for k, p, edits, lo, hi in self.align(text, cut, doc[i:i + 256], item[i:i + 256], diagonal[i:i + 256]):
                    lo, hi = max(lo, int(cut[k])), min(hi, int(cut[k + 1]))
                    span = (edits, base + int(at[lo] - o[k]), base + int(at[hi - 1] - o[k]) + 1)
                    found[first + k, p] = min(found.get((first + k, p), span), span)
        return found


def passage_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[list[tuple[int, bytes]]]:
    """The passages (item_id, text) in blocks of bounded size, by hash of the id; one
    block reaches the driver at a time. Null and short passages take no part."""
    items = benchmark.where(F.octet_length("text") >= MIN_PASSAGE).select("item_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for k in range(parts):
        rows = items.where(part == k).collect()
        yield sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"].encode()) for r in rows)


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start, end): each benchmark passage found in a text of
    ``docs`` (doc_id, text), with its best occurrence as byte offsets.

    Texts and passages compare with A-Z lowered and runs of white space as one space;
    a passage may differ by ``EDIT_RATE`` of its bytes. Null and empty texts hold
    nothing; repeated rows are reported each; a null item_id is reported as -1; extra
    columns are ignored; an empty table on either side gives no rows.
    """
    schema = "doc_id long, item_id long, edits int, start long, end long"

    def scan(block: list[tuple[int, bytes]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with np.errstate(over="ignore"):
                index = PassageIndex(block)
                for batch in batches:
                    found = index.search(batch.column("text"))
                    rows = pa.array([k[0] for k in found], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(rows), pa.array([index.items[k[1]][0] for k in found], pa.int64()),
                         pa.array([v[0] for v in found.values()], pa.int32()),
                         pa.array([v[1] for v in found.values()], pa.int64()),
                         pa.array([v[2] for v in found.values()], pa.int64())],
                        names=["doc_id", "item_id", "edits", "start", "end"])
        return docs.select("doc_id", "text").mapInArrow(tx.tidy(run), schema)

    return reduce(DataFrame.union, [scan(block) for block in passage_blocks(benchmark)])


def without_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark passage is found."""

    def scan(rows: DataFrame, block: list[tuple[int, bytes]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with np.errstate(over="ignore"):
                index = PassageIndex(block)
                for batch in batches:
                    clean = np.ones(batch.num_rows, bool)
                    clean[[k[0] for k in index.search(batch.column("text"))]] = False
                    yield batch.filter(pa.array(clean))
        return rows.mapInArrow(tx.tidy(run), rows.schema)

    return reduce(scan, passage_blocks(benchmark), docs)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a benchmark passage, same columns."""
    return without_passages(docs, read_table(spark, sf_dir, "benchmark"))
