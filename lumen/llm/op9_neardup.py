"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full
shingle sets, and union-find.

Distinct shingle sets are the nodes. Each set's signature is a SuperMinHash: every
element walks its own random permutation of the signature's positions, step j
offering the value j + random, and a document stops as soon as all positions hold
values below the next step. Signature bands give buckets. In a bucket every member
is compared with one pivot, the member that shares the most buckets, which in a
group of edited copies is the least edited one; that is linear in the bucket.
Links are confirmed on full sets and contracted to components. Buckets that still
hold several components are compared exactly, block by block, but only members
outside the bucket's main component against the rest, so large groups of copies
cost no pairs among themselves and no link between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumen.llm import textops as tx
from lumen.llm.common import materialize, read_table, text_key
from lumen.llm.graph import components

U = np.uint64
POSITIONS = 64
#: Accepted chance that a pair exactly at the threshold shares no bucket, and that
#: its signatures agree so little that a pivot pair is not verified.
MISS_BANDS, MISS_ESTIMATE = 1e-5, 1e-6
BLOCK = 256


def banding(threshold: float, positions: int = POSITIONS) -> tuple[int, int]:
    """(bands, rows): the longest rows whose miss chance stays under MISS_BANDS."""
    rows = max([r for r in range(1, 9) if (1 - threshold ** r) ** (positions // r) <= MISS_BANDS] or [1])
    return positions // rows, rows


def least_agreement(threshold: float, positions: int = POSITIONS) -> int:
    """Agreeing positions below which a pair at the threshold is unlikelier than MISS_ESTIMATE."""
    total, c, p = 0.0, 0, (1 - threshold) ** positions
    while c < positions and total + p <= MISS_ESTIMATE:
        total += p
        p *= (positions - c) / (c + 1) * threshold / (1 - threshold)
        c += 1
    return c


def superminhash(elements: np.ndarray, bounds: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """Signatures (documents x positions) of the element sets between ``bounds``;
    an empty set has the largest value everywhere. All elements take step j
    together; documents whose positions are all below step j + 1 take no further."""
    docs = len(bounds) - 1
    sig = np.full(docs * positions, np.iinfo(np.uint64).max, U)
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    e = elements
    perm = None
    for j in range(positions):
        if not len(e):
            break
        rnd = tx.mix(e + U((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((rnd & U(0xFFFF)) * U(positions - j) >> U(16)).astype(np.int64)
        if perm is None:
            at = k
        else:
            row = np.arange(len(e))
            at = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
            perm[row, j] = at
        np.minimum.at(sig, doc * positions + at, (rnd >> U(16)) | U(j << 48))
        if j + 1 == positions:
            break
        open_ = sig.reshape(docs, positions).max(1) >= U((j + 1) << 48)
        go = open_[doc]
        left = int(go.sum())
        if perm is None:
            e, doc, k = e[go], doc[go], k[go]
            perm = np.tile(np.arange(positions, dtype=np.uint8), (left, 1))
            row = np.arange(left)
            perm[row, k] = 0
            perm[row, 0] = k
        elif left < 0.8 * len(e):
            e, doc, perm = e[go], doc[go], perm[go]
    return sig.reshape(docs, positions)


def distinct_sets(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct elements per document, and their bounds."""
    h = h.copy()
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo > 1:
            h[lo:hi].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    counts = np.zeros(len(h) + 1, np.int64)
    np.cumsum(new, out=counts[1:])
    return h[new], counts[bounds]


def shingle_sets(hasher: tx.Hasher, column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, elements, bounds) for runs of documents of a text column;
    the pieces of a very long document are joined at the level of word hashes."""
    data, offsets = tx.column_bytes(column)
    held: list[np.ndarray] = []
    done = 0
    for first, d, o in tx.chunks(data, offsets, tx.SCAN_BYTES, piece=tx.CHUNK_BYTES):
        _, _, words, wb = hasher.words(d, o)
        if len(o) == 2:
            held.append(words)
            done += len(d)
            if done < offsets[first + 1] - offsets[first]:
                continue
            words = np.concatenate(held)
            wb = np.array([0, len(words)])
        held, done = [], 0
        yield (first, *distinct_sets(*tx.shingle_hashes(words, wb, n)))


def sketches(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """Per row: doc_id, txt (text key), key (128-bit identity of the shingle set),
    n_shingles, bands, sig (16 bits a position). Null and empty texts: 0 shingles."""
    bands, rows = banding(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tx.Hasher(tx.SCAN_BYTES)
        for batch in batches:
            size, keys, band, sigs = [], [], [], []
            with np.errstate(over="ignore"):
                for _, h, b in shingle_sets(hasher, batch.column("text"), n):
                    docs_ = len(b) - 1
                    sums = []
                    for salt in (1, 2):
                        c = np.zeros(len(h) + 1, U)
                        np.cumsum(tx.mix(h + U(salt)), out=c[1:])
                        sums.append(c[b[1:]] - c[b[:-1]])
                    keys.append(np.stack([tx.mix(sums[0] + U(7)), tx.mix(sums[1] + np.diff(b).astype(U))], 1))
                    sig = superminhash(h, b)
                    mixed = tx.mix(sig)
                    sigs.append((mixed >> U(48)).astype("<u2"))
                    grouped = mixed[:, :bands * rows].reshape(docs_, bands, rows)
                    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (docs_, bands)).copy()
                    for r in range(rows):
                        acc = tx.mix(acc * U(0x9E3779B97F4A7C15) + grouped[:, :, r])
                    band.append(acc.view(np.int64))
                    size.append(np.diff(b))
            if not size:
                continue
            count = sum(map(len, size))
            key, band_, sig_ = np.concatenate(keys), np.concatenate(band), np.concatenate(sigs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("txt"), _binary(key, 16, count),
                 pa.array(np.concatenate(size)),
                 pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * bands),
                                          pa.array(band_.ravel())),
                 _binary(sig_, 2 * POSITIONS, count)],
                names=["doc_id", "txt", "key", "n_shingles", "bands", "sig"])

    return docs.select("doc_id", text_key(F.col("text")).alias("txt"), "text").mapInArrow(
        run, "doc_id long, txt binary, key binary, n_shingles long, bands array<long>, sig binary")


def _binary(values: np.ndarray, width: int, count: int) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), count, [
        None, pa.py_buffer((np.arange(count + 1, dtype=np.int32) * width).tobytes()),
        pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(key, elements) of ``wanted`` (key, doc_id, txt): whole sets from the texts."""
    rows = (docs.select("doc_id", text_key(F.col("text")).alias("txt"), "text").alias("d")
            .join(wanted.alias("w"), (F.col("d.txt") == F.col("w.txt"))
                  & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))
            .select("w.key", "d.text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tx.Hasher(tx.SCAN_BYTES)
        for batch in batches:
            with np.errstate(over="ignore"):
                for first, h, b in shingle_sets(hasher, batch.column("text"), n):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").slice(first, len(b) - 1),
                         pa.array([h[i:j].tobytes() for i, j in zip(b[:-1], b[1:])], pa.binary())],
                        names=["key", "elements"])

    return rows.mapInArrow(run, "key binary, elements binary").dropDuplicates(["key"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach ``percent`` Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                inter = int((q[at] == p).sum()) if len(p) else 0
                ok.append(100 * inter >= percent * (len(p) + len(q) - inter))
            keep = pa.array(ok, pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return (pairs.join(sets.select(F.col("key").alias("a"), F.col("elements").alias("x")), "a")
            .join(sets.select(F.col("key").alias("b"), F.col("elements").alias("y")), "b")
            .select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary"))


def cross_links(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact links between different components of a bucket. ``rest``: b, key, comp,
    main (the bucket's largest component), n and others (members in all, and outside
    main). Blocks of members outside main meet blocks of all members."""
    q_blocks = F.ceil(F.col("others") / BLOCK).cast("int")
    t_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.xxhash64("key", "b")
    rows = rest.join(sets, "key")
    asking = rows.where(F.col("comp") != F.col("main")).select(
        "b", F.pmod(own, q_blocks).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), t_blocks - 1)).alias("j"), "key", "comp", "elements", F.lit(True).alias("q"))
    told = rows.select(
        "b", F.explode(F.sequence(F.lit(0), q_blocks - 1)).alias("i"),
        F.pmod(own, t_blocks).cast("int").alias("j"), "key", "comp", "elements", F.lit(False).alias("q"))

    def run(group: pa.Table) -> pa.Table:
        q = group.column("q").to_numpy().astype(bool)
        key, comp = group.column("key").to_pylist(), group.column("comp").to_pylist()
        sets_ = [np.frombuffer(x, U) for x in group.column("elements").to_pylist()]
        size = np.array([len(s) for s in sets_])
        told_at = np.flatnonzero(~q)
        out_a, out_b = [], []
        if len(told_at) and q.any():
            flat = np.concatenate([sets_[i] for i in told_at])
            cuts = np.concatenate(([0], np.cumsum(size[told_at])))[:-1]
            universe, ids = np.unique(flat, return_inverse=True)
            mark = np.zeros(len(universe), np.int32)
            for i in np.flatnonzero(q):
                at = np.minimum(np.searchsorted(universe, sets_[i]), len(universe) - 1)
                at = at[universe[at] == sets_[i]]
                mark[at] = 1
                inter = np.add.reduceat(mark[ids], cuts)
                mark[at] = 0
                hit = 100 * inter >= percent * (size[i] + size[told_at] - inter)
                for t in told_at[hit]:
                    if comp[t] != comp[i]:
                        out_a.append(key[i])
                        out_b.append(key[t])
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return asking.unionByName(told).groupBy("b", "i", "j").applyInArrow(run, "a binary, b binary")


def near_duplicate_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Groups of the rows of ``docs`` (doc_id, text) whose word ``n``-shingle sets
    are linked, directly or through others, at ``percent`` Jaccard similarity.

    Returns (rows: doc_id, txt, key, n_shingles; classes: key, rep, root, component_id;
    rep is the class member's first row, as (doc_id is null, doc_id, txt)). Texts
    compare with A-Z lowered; a text of fewer than n words has its word sequence as
    its only shingle; null, empty and blank texts have none and are in no class.
    component_id is the smallest doc_id of the class, null ids last. Repeated rows
    share their class; extra columns are ignored; an empty table has no rows.
    """
    threshold = percent / 100
    sketch = materialize(sketches(docs, n, threshold))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "txt")
    nodes = materialize(sketch.where("n_shingles > 0").groupBy("key").agg(
        F.min(first).alias("rep"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    slots = nodes.select("key", F.explode("bands").alias("b"))
    # tables of one row a bucket are written first, so that the joins read plain shuffles on
    # both sides and adaptive execution can split a hot bucket
    shared = materialize(slots.groupBy("b").agg(F.count("*").alias("n")).where("n > 1"))
    buckets = materialize(slots.join(shared, "b"))
    central = buckets.groupBy("key").agg(F.sum("n").alias("central"))
    pivots = materialize(buckets.join(central, "key").groupBy("b").agg(
        F.max(F.struct("central", "key")).getField("key").alias("pivot")))
    pairs = (buckets.join(pivots, "b").where("key != pivot")
             .select(F.greatest("key", "pivot").alias("a"), F.least("key", "pivot").alias("b")).distinct())
    side = nodes.select("key", "n_shingles", "sig")
    agree = least_agreement(threshold)

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, POSITIONS)
                    for c in ("sx", "sy"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= agree))

    pairs = (pairs.join(side.toDF("a", "nx", "sx"), "a").join(side.toDF("b", "ny", "sy"), "b")
             .where("100 * least(nx, ny) >= " + str(percent) + " * greatest(nx, ny)")
             .select("a", "b", "sx", "sy").mapInArrow(plausible, "a binary, b binary"))
    pairs = materialize(pairs)
    # texts are needed of nodes in plausible pairs and in buckets of three or more
    wanted = (pairs.select(F.col("a").alias("key")).union(pairs.select("b"))
              .union(buckets.where("n > 2").select("key")).distinct()
              .join(nodes.select("key", "rep.doc_id", "rep.txt"), "key"))
    sets = materialize(full_sets(docs, wanted, n))
    links = materialize(verified(pairs, sets, percent))
    roots = components(links)
    placed = (buckets.where("n > 2").join(roots.withColumnRenamed("node", "key"), "key", "left")
              .select("b", "n", "key", F.coalesce("root", "key").alias("comp")))
    sizes = placed.groupBy("b", "comp").agg(F.count("*").alias("c"))
    main = materialize(sizes.groupBy("b").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps"),
                                   F.sum("c").alias("all"))
            .where("comps > 1").select("b", F.col("top.comp").alias("main"),
                                       (F.col("all") - F.col("top.c")).alias("others")))
    more = materialize(cross_links(materialize(placed.join(main, "b")), sets, percent).distinct())
    if more.limit(1).count():
        roots = components(links.union(more))
    named = nodes.select("key", "rep").join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "rep", F.coalesce("root", "key").alias("root"))
    least = named.groupBy("root").agg(F.min("rep.doc_id").alias("component_id"))
    classes = materialize(named.join(least, "root"))
    return sketch.select("doc_id", "txt", "key", "n_shingles"), classes


def without_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row of each class left: that of the smallest
    doc_id (null ids last), of identical rows one. Rows without words are in no class
    and stay. Columns are those of ``docs``."""
    _, classes = near_duplicate_groups(docs, n, percent)
    winners = classes.groupBy("root").agg(F.min("rep").alias("rep")).select(
        F.col("rep.doc_id").alias("__id"), F.col("rep.txt").alias("__txt"))
    has_word = F.coalesce(F.regexp_like(F.col("text"), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    key = text_key(F.col("text"))
    kept = (docs.where(has_word).withColumn("__key", key)
            .join(winners, (F.col("__key") == F.col("__txt")) & F.col("doc_id").eqNullSafe(F.col("__id")))
            .dropDuplicates(["__txt", "__id"]).select(*docs.columns))
    return kept.unionByName(docs.where(~has_word))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group, same columns."""
    return without_near_duplicates(docs)


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, classes = near_duplicate_groups(docs, n=3, percent=85)
    joined = rows.join(classes.select("key", "component_id"), "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"))
