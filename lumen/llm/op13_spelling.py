"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Two words are one edit apart (one code point inserted, deleted or replaced) exactly if they
differ and their common prefix plus their common suffix reaches the longer length L minus
one. The positions of the longer word are cut into windows of at most three (16 windows from
L = 49 on); an edit inside a window leaves everything left and right of it alone. So every
word goes, once as the longer and once as the shorter of a pair, to one block per window,
named by L, the window and the rest of the word, and only words of a block are compared:
their code points lie in padded matrices, one aligned left and one aligned right, and whole
columns of pairs are compared at once. A pair counts in the block whose window holds the end
of its common prefix, so it counts once and no list of pairs leaves a task.

A block of words up to 48 long has all but three code points fixed, so its size is bounded by
the alphabet. Longer words can share all but a wide window: blocks above ``TILE`` rows are cut
into tiles and every pair of tiles is a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm import textops as tx
from lumen.llm.common import materialize, read_table

MIN_LENGTH, MIN_COUNT, DAMAGE = 5, 3, 97
#: Window width and the most windows of a word; rows of one tile; pairs compared at once.
WIDTH, WINDOWS, TILE, PAIRS = 3, 16, 4096, 1 << 19
#: Types a task counts before it hands them on; rows of blocks compared together.
LOCAL_TYPES, ROWS = 1 << 18, 1 << 16

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: First byte of the UTF-8 form of U+00C0 to U+00FF; every second byte is in the range.
_LEAD = 0xC3


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the maximal runs of A-Z, a-z and U+00C0 to U+00FF."""
    inside = _LETTER[data] | (data == _LEAD)
    inside[1:] |= data[:-1] == _LEAD
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def run_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, seeds: np.ndarray,
             table: np.ndarray, steps: int = 64) -> np.ndarray:
    """CRC-32 of every run, carried on from the CRC-32 ``seeds`` of what stands before it."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    at, crc = start[order], ~seeds[order].astype(np.uint32)
    most = int(length.max(initial=0))
    left = np.searchsorted(-length[order], -np.arange(min(most, steps)), side="left")
    for k, m in enumerate(left):
        crc[:m] = table[(crc[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ (crc[:m] >> np.uint32(8))
    out = np.empty(len(start), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(length > steps):
        out[i] = zlib.crc32(data[start[i] + steps:end[i]].tobytes(), int(out[i]))
    return out


def run_hashes(hasher: tx.Hasher, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of the bytes of every run, from prefix sums (the hashes of ``Hasher.words``)."""
    hasher._grow(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(hasher.table[data] * hasher.power[:len(data)], out=total[1:])
    return tx.mix((total[end] - total[start]) * hasher.inverse[start] + (end - start).astype(np.uint64))


def count_words(docs: DataFrame, every: int = DAMAGE, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) with at least ``min_length`` code points.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. Where
    ``every`` divides the CRC-32 h of "<doc_id>:<word>", the word loses its code point
    h % length (0: no damage). Null texts have no words; a null doc_id is written as
    nothing. Texts are read whole, 1 MB at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hasher = _crc_table(), tx.Hasher()
        counts: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            raw, bounds = tx.column_bytes(batch.column("text"))
            seeds = np.array([zlib.crc32(b"%s:" % (b"" if i is None else b"%d" % i))
                              for i in batch.column("doc_id").to_pylist()], np.uint32)
            for doc, data, offsets in tx.chunks(raw, bounds):
                data = tx.LOWER[data]
                start, end, of = letter_runs(data, offsets)
                if not len(start):
                    continue
                second = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) == 0x80, out=second[1:])
                length = end - start - (second[end] - second[start])
                long = length >= min_length
                start, end, of, length = start[long], end[long], of[long], length[long]
                hurt = np.zeros(len(start), bool)
                if every and len(start):
                    h = run_crcs(data, start, end, seeds[doc + of], table)
                    hurt = h % every == 0
                    for i in np.flatnonzero(hurt & (length > min_length)):
                        word = data[start[i]:end[i]].tobytes().decode()
                        at = int(h[i]) % len(word)
                        word = (word[:at] + word[at + 1:]).encode()
                        counts[word] = counts.get(word, 0) + 1
                start, end = start[~hurt], end[~hurt]
                _, one, times = np.unique(run_hashes(hasher, data, start, end), return_index=True, return_counts=True)
                text = data.tobytes()
                for a, b, k in zip(start[one].tolist(), end[one].tolist(), times.tolist()):
                    word = text[a:b]
                    counts[word] = counts.get(word, 0) + k
                if len(counts) >= LOCAL_TYPES:
                    yield flush()
        if counts:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _windows(long: Column) -> Column:
    return F.least(F.ceil(long / WIDTH), F.lit(WINDOWS)).cast("int")


def _blocks(words: DataFrame) -> DataFrame:
    """Every word once per window, as the longer (length ``L``) and as the shorter of a pair."""
    size = F.length("word")
    rows = (words.select("word", "n", F.explode(F.array(size, size + 1)).alias("L"))
            .withColumn("W", _windows(F.col("L")))
            .select("*", F.explode(F.sequence(F.lit(0), F.col("W") - 1)).alias("j"))
            .withColumn("b", F.floor(F.col("j") * F.col("L") / F.col("W")).cast("int"))
            .withColumn("e", F.floor((F.col("j") + 1) * F.col("L") / F.col("W")).cast("int")))
    rest = F.col("L") - F.col("e")
    key = F.xxhash64(F.substring("word", F.lit(1), F.col("b")), F.substring(F.col("word"), size - rest + 1, rest))
    rows = rows.select("L", "j", "b", "e", key.alias("key"), "word", "n")
    wide = WIDTH * WINDOWS
    large = materialize(rows.where(F.col("L") > wide).groupBy("L", "j", "key").count()
                        .where(F.col("count") > TILE).withColumn("tiles", F.ceil(F.col("count") / TILE).cast("int")))
    if large.isEmpty():
        return rows.select("*", *[F.lit(0).alias(c) for c in ("t", "lo", "hi")])
    rows = rows.join(large.drop("count"), ["L", "j", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("t", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u")).select(
        "L", "j", "b", "e", "key", "word", "n", "t", F.least("t", "u").alias("lo"), F.greatest("t", "u").alias("hi"))


BLOCK = ["L", "j", "key", "lo", "hi"]
LINKS = "word string, n long, n_near long, best_n long, best string"


def _compare(rows: pa.Table) -> pa.RecordBatch | None:
    """The links of the blocks in ``rows`` (whole blocks, sorted by block)."""
    words = np.array(rows.column("word").to_pylist(), dtype=np.str_)
    n, L, b, e, t, lo, hi = (rows.column(c).to_numpy() for c in ("n", "L", "b", "e", "t", "lo", "hi"))
    count, width = len(words), max(1, words.dtype.itemsize // 4)
    left = np.ascontiguousarray(words).view(np.uint32).reshape(count, width)
    size = np.char.str_len(words)
    back = size[:, None] - 1 - np.arange(width)[None, :]
    right = np.where(back >= 0, np.take_along_axis(left, np.maximum(back, 0), 1), 0)
    change = np.ones(count, bool)
    ids = [rows.column(c).to_numpy() for c in BLOCK]
    change[1:] = np.any([c[1:] != c[:-1] for c in ids], axis=0)
    begin = np.flatnonzero(change)
    stop = np.repeat(np.append(begin[1:], count), np.diff(np.append(begin, count)))
    here = np.arange(count)
    # the longer word of a pair comes first, so rows of the shorter role have no partners after them
    partners = np.where(size == L, stop - here - 1, 0)
    total = np.concatenate(([0], np.cumsum(partners)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    i = 0
    while i < count:
        k = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, side="right")) - 1)
        x = np.repeat(here[i:k], partners[i:k])
        y = x + 1 + np.arange(len(x)) - np.repeat(total[i:k] - total[i], partners[i:k])
        i = k
        use = (lo[x] == hi[x]) | (t[x] != t[y])
        x, y = x[use], y[use]
        prefix, suffix = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for matrix, run, skip in ((left, prefix, b), (right, suffix, L - e)):
            live = np.arange(len(x))
            for step in range(int((e[x] - b[x]).max(initial=0))):
                at = skip[x[live]] + step
                same = (at < np.minimum(size[x[live]], size[y[live]])) & (step < (e - b)[x[live]])
                at = np.minimum(at, width - 1)
                same &= matrix[x[live], at] == matrix[y[live], at]
                live = live[same]
                run[live] += 1
        prefix, suffix = prefix + b[x], suffix + (L - e)[x]
        near = (prefix + suffix >= L[x] - 1) & (prefix < e[x])
        x, y, prefix = x[near], y[near], prefix[near]
        if not len(x):
            continue
        # the parts outside the window are named by a hash only; compare them in full
        col = np.arange(width)
        sure = (left[x] == left[y]) | (col >= b[x][:, None])
        sure &= (right[x] == right[y]) | (col >= (L - e)[x][:, None])
        sure = sure.all(1) & (words[x] != words[y])
        found.append((x[sure], y[sure]))
    if not found:
        return None
    x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    x, y = np.concatenate((x, y)), np.concatenate((y, x))
    if not len(x):
        return None
    rank = np.empty(count, np.int64)
    rank[np.argsort(words, kind="stable")] = here
    order = np.lexsort((rank[y], -n[y], x))
    x, y = x[order], y[order]
    one = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    times = np.diff(np.append(one, len(x)))
    return pa.RecordBatch.from_arrays(
        [pa.array(words[x[one]].tolist(), pa.string()), pa.array(n[x[one]]), pa.array(times),
         pa.array(n[y[one]]), pa.array(words[y[one]].tolist(), pa.string())],
        names=["word", "n", "n_near", "best_n", "best"])


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares whole blocks, ``ROWS`` rows at a time; a block not yet complete is carried on."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < ROWS:
            continue
        rows = pa.Table.from_batches(held)
        last = np.ones(rows.num_rows, bool)
        for c in BLOCK:
            v = rows.column(c).to_numpy()
            last &= v == v[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            out = _compare(rows.slice(0, cut).combine_chunks())
            if out is not None:
                yield out
            held = rows.slice(cut).combine_chunks().to_batches()
            size = rows.num_rows - cut
    if held:
        out = _compare(pa.Table.from_batches(held).combine_chunks())
        if out is not None:
            yield out


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n) for every row of ``words`` (distinct word, n): how many
    other words are one edit away, and the most frequent of them (ties: the smallest)."""
    blocks = _blocks(words).repartition(*BLOCK).sortWithinPartitions(*BLOCK, F.desc(F.length("word")))
    links = blocks.mapInArrow(_tile, LINKS)
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"),
                       F.lit(None).cast("string").alias("best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("down"), "best")))
    return (links.union(own).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n", "n_near", F.col("b.best").alias("best"), (-F.col("b.down")).alias("best_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form), where forms lead to no cycle: the end of each
    chain, by pointer doubling, so the joins grow with the logarithm of the longest chain."""
    reach = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        far = reach.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = materialize(reach.join(far, "root", "left").select(
            "word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return reach
        reach = step.drop("moved")


def spelling_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (distinct word, n).

    A word's form is its most frequent near word (ties: the smallest in code-point order) if
    that occurs at least twice as often, else null; its root is the end of the chain of forms.
    Null words are left out; extra columns are ignored; an empty table gives no rows.
    """
    words = materialize(words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")))
    taken = F.col("best_n") >= 2 * F.col("n")
    near = materialize(near_words(words).select(
        "word", "n", "n_near", F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n")))
    root = roots(near.where(F.col("form").isNotNull()))
    return near.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = count_words(read_table(spark, sf_dir, "documents"))
    return spelling_variants(words.where(F.col("n") >= MIN_COUNT))
