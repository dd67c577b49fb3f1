"""Near-duplicate vectors by cosine: randomised-rotation binary codes with correction factors.

A unit vector o is rotated by a random orthogonal matrix P and kept as the signs of its
coordinates, the code vector o' = sign(Po) / sqrt(D), together with the factor c = <o', Po>.
<o', Pq> / c then is an unbiased estimate of <o, q>, and its error exceeds
``DEVIATIONS`` * sqrt((1 - c^2) / (c^2 (D - 1))) only with the chance of as many standard
deviations. Pairs whose estimate plus this bound stays under the threshold are left; all
others are computed again in double precision, and only that decides.

Pairs meet in buckets of further random rotations: ``bits`` signs are one band, and bands are
added until a pair at the threshold shares none with a chance under ``MISS``. A pair counts in
the first band it shares, so links are counted per task and no list of pairs is shuffled.

Copies cost no pairs. Equal vectors (up to a power of two) are one node; nodes within a small
angle of a pivot are one group, in which all pairs are linked by the triangle inequality.
Groups are compared by their pivots: the angle of the pivots plus or minus both radii links
all pairs or none, and only groups in between are compared member by member, in tiles.
A bucket that is large nevertheless is cut into tiles, and every pair of tiles is a task's group.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumen.llm.common import materialize, read_table
from lumen.llm.graph import components

COSINE = 0.9
#: Chance that a pair at the threshold shares no bucket; standard deviations of the bound.
MISS, DEVIATIONS = 1e-3, 4.5
#: Nodes of a bucket on average; rows of a tile; rows and pairs compared at once.
BUCKET, TILE, ROWS, PAIRS = 512, 2048, 512, 1 << 17
#: Radius of a group (radians); sign bits of the two rounds that look for pivots.
RADIUS, PIVOT_BITS = math.radians(3), (32, 16)
SEED = 20_251


def planes(dims: int, count: int, seed: int) -> np.ndarray:
    """(dims x count): the columns of as many random rotations as it takes."""
    rng, parts = np.random.default_rng((SEED, seed)), []
    for _ in range(-(-count // dims)):
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        parts.append(q * np.where(np.diag(r) < 0, -1.0, 1.0))
    return np.hstack(parts)[:, :count] if parts else np.zeros((dims, 0))


def banding(nodes: int, cosine: float) -> tuple[int, int]:
    """(bands, bits): buckets of about ``BUCKET`` nodes, bands for a miss under ``MISS``."""
    bits = min(31, max(0, math.ceil(math.log2(max(1, nodes) / BUCKET))))
    same = 1 - min(math.pi, math.acos(cosine) + RADIUS) / math.pi
    return (1, 0) if not bits else (math.ceil(math.log(MISS) / math.log1p(-same ** bits)), bits)


def scaled(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors as rows, zeros at the end of shorter ones, divided by a power of two
    (exact) so that the largest component is between 1/2 and 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.float64)
    out = np.zeros((len(column), dims))
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    _, power = np.frexp(np.abs(out).max(1, initial=0))
    return np.ldexp(out, -power[:, None]) + 0.0


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows ** 2).sum(1)), 1e-300)[:, None]


def _matrix(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims).astype(np.float64)


def _angle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Angle of unit rows, exact for small angles."""
    d = np.sqrt(((x - y) ** 2).sum(1))
    return 2 * np.arcsin(np.minimum(d / 2, 1))


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


class Space:
    """What tasks need to know of the vectors: how they are stored and rotated."""

    def __init__(self, dims: int, kind: str, cosine: float) -> None:
        self.dims, self.kind, self.cosine, self.angle = dims, kind, cosine, math.acos(cosine)
        self.rotation = planes(dims, dims, 0)

    def read(self, column: pa.Array) -> np.ndarray:
        return _matrix(column, self.kind, self.dims)

    def codes(self, x: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Sign codes of unit rows and their factors."""
        y = x @ self.rotation
        return [r.tobytes() for r in np.packbits(y >= 0, axis=1)], np.abs(y).sum(1) / math.sqrt(self.dims)

    def signs(self, column: pa.Array) -> np.ndarray:
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
        return np.unpackbits(raw, axis=1)[:, :self.dims].astype(np.float64) * 2 - 1


def _valid(rows: DataFrame) -> DataFrame:
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    return F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(
        F.exists(x, lambda v: v.cast("double") != 0), F.lit(False))


def _nodes(rows: DataFrame, space: Space) -> DataFrame:
    """(vec_id, node, vec): the vector, scaled, and the 128-bit digest of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled(batch.column("embedding"), space.dims).astype(space.kind) + np.dtype(space.kind).type(0)
            raw = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()),
                 pa.array(raw, pa.binary())], names=["vec_id", "node", "vec"])

    return rows.mapInArrow(run, "vec_id long, node binary, vec binary")


def _pivot_round(reps: DataFrame, space: Space, bits: int, turn: int, reach: float) -> DataFrame:
    """(node, pivot, off) of ``reps`` (node, vec, radius): nodes of equal sign bits look at the
    bucket's first node and join it if they lie, with all they hold, within ``reach``."""
    matrix = planes(space.dims, bits, 1 + turn)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = space.read(batch.column("vec")) @ matrix >= 0
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "vec", "radius")), pa.array(on @ (1 << np.arange(bits, dtype=np.int64)))],
                names=["node", "vec", "radius", "b"])

    def off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = _angle(unit(space.read(batch.column("vec"))), unit(space.read(batch.column("pv"))))
            a = a + batch.column("radius").to_numpy()
            own = np.array(batch.column("node").to_pylist(), object) == np.array(batch.column("pivot").to_pylist(), object)
            near = pa.array(own | (a + 1e-9 <= reach))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("pivot"), pa.array(np.where(own, batch.column("radius").to_numpy(), a + 1e-9))],
                names=["node", "pivot", "off"]).filter(near)

    keyed = materialize(reps.mapInArrow(key, "node binary, vec binary, radius double, b long"))
    first = materialize(keyed.groupBy("b").agg(F.min(F.struct("node", "vec")).alias("p"), F.count("*").alias("n"))
                        .where("n > 1").select("b", F.col("p.node").alias("pivot"), F.col("p.vec").alias("pv")))
    return keyed.join(first, "b").select("node", "vec", "radius", "pivot", "pv").mapInArrow(
        off, "node binary, pivot binary, off double")


def _groups(base: DataFrame, space: Space) -> tuple[DataFrame, DataFrame]:
    """(node, g) and (g, vec, w, radius, least): groups of nodes within ``RADIUS`` of a pivot."""
    named = base.select("node", F.col("node").alias("g"))
    reps = base.select("node", "vec", F.lit(0.0).alias("radius"))
    for turn, bits in enumerate(PIVOT_BITS):
        moves = materialize(_pivot_round(reps, space, bits, turn, RADIUS * (turn + 1) / len(PIVOT_BITS)))
        joined = moves.where(F.col("node") != F.col("pivot")).select(F.col("node").alias("g"), "pivot")
        named = named.join(joined, "g", "left").select("node", F.coalesce("pivot", "g").alias("g"))
        radius = moves.groupBy(F.col("pivot").alias("node")).agg(F.max("off").alias("r"))
        reps = materialize(reps.join(joined.select(F.col("g").alias("node")), "node", "left_anti")
                           .join(radius, "node", "left")
                           .select("node", "vec", F.greatest("radius", F.coalesce("r", F.lit(0.0))).alias("radius")))
    named = materialize(named)
    size = named.join(base.select("node", "copies", "least"), "node").groupBy("g").agg(
        F.sum("copies").alias("w"), F.min("least").alias("least"), F.count("*").alias("members"))
    return named, materialize(reps.withColumnRenamed("node", "g").join(size, "g"))


LINKS = "kind string, a binary, b binary, w long"


def _links(kind: list[str], a: list, b: list, w: list) -> pa.Table:
    return pa.table({"kind": pa.array(kind, pa.string()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()),
                     "w": pa.array(w, pa.int64())})


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest linked row of every row, through any number of links."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _bucket(group: pa.Table, space: Space) -> pa.Table:
    """Compares the pivots of one bucket: link counts ('n'), edges ('e') and pairs of groups
    to be compared by their members ('u')."""
    g = group.column("g").to_pylist()
    x = unit(space.read(group.column("vec")))
    signs, y = space.signs(group.column("code")), x @ space.rotation
    c, r = group.column("factor").to_numpy(), group.column("radius").to_numpy()
    keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.int32).reshape(len(g), -1)
    w, t = group.column("w").to_numpy(), group.column("t").to_numpy()
    band, both = group.column("band")[0].as_py(), group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
    slack = DEVIATIONS * np.sqrt(np.maximum(1 - c ** 2, 0) / (c ** 2 * max(space.dims - 1, 1))) + 1e-9
    add, ends, undecided = np.zeros(len(g), np.int64), [], []
    least = None if r.any() else space.cosine
    for i in range(0, len(g), ROWS):
        estimate = signs[i:i + ROWS] @ y.T / (math.sqrt(space.dims) * c[i:i + ROWS, None])
        if least is None:
            most = np.cos(np.minimum(space.angle + r[i:i + ROWS, None] + r[None, :], math.pi))
        else:
            most = least
        maybe = estimate + slack[i:i + ROWS, None] >= most
        maybe &= np.arange(len(g))[None, :] > np.arange(i, min(i + ROWS, len(g)))[:, None]
        if not both:
            maybe &= t[i:i + ROWS, None] != t[None, :]
        p, q = np.nonzero(maybe)
        p = p + i
        for k in range(0, len(p), PAIRS):
            a, b = p[k:k + PAIRS], q[k:k + PAIRS]
            here = (keys[a] == keys[b]).argmax(1) == band
            a, b = a[here], b[here]
            cosine, wide = _cosine(x[a], x[b]), r[a] + r[b]
            angle = _angle(x[a], x[b])
            link = np.where(wide == 0, cosine >= space.cosine, angle + wide + 1e-9 <= space.angle)
            open_ = ~link & (wide > 0) & (angle - wide - 1e-9 <= space.angle)
            np.add.at(add, a[link], w[b[link]])
            np.add.at(add, b[link], w[a[link]])
            ends.append((a[link], b[link]))
            undecided.append((a[open_], b[open_]))
    i, j = (np.concatenate([e[k] for e in ends] or [np.zeros(0, np.int64)]) for k in (0, 1))
    u, v = (np.concatenate([e[k] for e in undecided] or [np.zeros(0, np.int64)]) for k in (0, 1))
    root = _forest(len(g), i, j)
    count, hung = np.flatnonzero(add), np.flatnonzero(root != np.arange(len(g)))
    a = [*(g[k] for k in count), *(g[k] for k in hung), *(g[k] for k in u)]
    b = [*(None for _ in count), *(g[root[k]] for k in hung), *(g[k] for k in v)]
    return _links(["n"] * len(count) + ["e"] * len(hung) + ["u"] * len(u), a, b, [*add[count].tolist(), *[0] * (len(hung) + len(u))])


def _tiles(rows: DataFrame, count: str, *keep: str) -> DataFrame:
    """Deals the rows of a key with ``count`` rows to pairs (lo, hi) of tiles."""
    tiles = F.ceil(F.coalesce(F.col(count), F.lit(1)) / TILE).cast("int")
    rows = rows.withColumn("t", F.pmod(F.xxhash64("g"), tiles).cast("int"))
    return rows.select(*keep, "t", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("u")).select(
        *keep, "t", F.least("t", "u").alias("lo"), F.greatest("t", "u").alias("hi"))


def _bucket_links(groups: DataFrame, space: Space) -> DataFrame:
    bands, bits = banding(groups.count(), space.cosine)
    matrix = planes(space.dims, bands * bits, 9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int32)
        for batch in batches:
            x = unit(space.read(batch.column("vec")))
            keys = ((x @ matrix >= 0).reshape(len(x), bands, bits) @ weights).astype(np.int32)
            code, factor = space.codes(x)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("g", "vec", "w", "radius")), pa.array(code, pa.binary()), pa.array(factor),
                 pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(list(keys), pa.list_(pa.int32()))],
                names=["g", "vec", "w", "radius", "code", "factor", "keys", "key"])

    coded = materialize(groups.select("g", "vec", "w", "radius").mapInArrow(
        run, "g binary, vec binary, w long, radius double, code binary, factor double, keys binary, key array<int>"))
    hot = materialize(coded.select(F.posexplode("key").alias("band", "key")).groupBy("band", "key").count()
                      .where(F.col("count") > TILE))
    rows = coded.select("g", "vec", "w", "radius", "code", "factor", "keys", F.posexplode("key").alias("band", "key"))
    keep = ["g", "vec", "w", "radius", "code", "factor", "keys", "band", "key"]
    dealt = _tiles(rows.join(hot, ["band", "key"], "left"), "count", *keep)
    return dealt.groupBy("band", "key", "lo", "hi").applyInArrow(lambda group: _bucket(group, space), LINKS)


def _member_links(pairs: DataFrame, members: DataFrame, sizes: DataFrame, space: Space) -> DataFrame:
    """Links between the members (g, node, vec, copies) of the pairs (a, b) of groups, all in
    double precision: counts of members ('m') and an edge ('e') where any two are linked."""
    size = sizes.select("g", F.ceil(F.col("members") / TILE).cast("int").alias("tiles"))
    both = (pairs.join(size.toDF("a", "ta"), "a").join(size.toDF("b", "tb"), "b"))

    def side(own: str, n_own: str, n_other: str, first: bool) -> DataFrame:
        rows = both.select("a", "b", F.col(own).alias("g"), n_own, n_other).join(members, "g")
        mine = F.pmod(F.xxhash64("node"), F.col(n_own)).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))
        i, j = (mine, theirs) if first else (theirs, mine)
        return rows.select("a", "b", i.alias("i"), j.alias("j"), "node", "vec", "copies", F.lit(first).alias("first"))

    def run(group: pa.Table) -> pa.Table:
        first = group.column("first").to_numpy().astype(bool)
        node, x = group.column("node").to_pylist(), space.read(group.column("vec"))
        copies = group.column("copies").to_numpy()
        p, q = np.flatnonzero(first), np.flatnonzero(~first)
        add = np.zeros(len(node), np.int64)
        for i in range(0, len(p), ROWS):
            at = p[i:i + ROWS]
            link = unit(x[at]) @ unit(x[q]).T >= space.cosine
            add[at] += (link * copies[None, q]).sum(1)
            add[q] += (link * copies[at, None]).sum(0)
        count = np.flatnonzero(add)
        if not len(count):
            return _links([], [], [], [])
        return _links(["m"] * len(count) + ["e"], [*(node[k] for k in count), group.column("a")[0].as_py()],
                      [*(None for _ in count), group.column("b")[0].as_py()], [*add[count].tolist(), 0])

    rows = side("a", "ta", "tb", True).union(side("b", "tb", "ta", False))
    return rows.groupBy("a", "b", "i", "j").applyInArrow(run, LINKS)


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows`` (vec_id, embedding).

    Rows are linked if the cosine of their vectors is at least ``cosine`` (0 < cosine < 1);
    n_links counts the other rows linked directly, component_id is the smallest vec_id
    reachable. Pairs at the threshold are missed with a chance of about ``MISS``; no pair
    below it is linked. Vectors that are null, zero or empty, or hold null or non-finite
    components link with nothing, and so do rows without vec_id (their component_id is null,
    they are not kept). Shorter vectors count as ending in zeros. Repeated rows are rows of
    their own, linked with each other. Extra columns are ignored; an empty table has no rows.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    element = rows.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    valid = rows.where(_valid(rows))
    alone = rows.where(~_valid(rows)).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    dims = valid.agg(F.max(F.size("embedding"))).first()[0]
    if dims is None:
        return alone
    space = Space(dims, kind, cosine)
    named = materialize(_nodes(valid, space))
    base = materialize(named.groupBy("node").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec")))
    member, groups = _groups(base, space)
    found = materialize(_bucket_links(groups, space))
    pairs = materialize(found.where("kind = 'u'").select("a", "b").distinct())
    if not pairs.isEmpty():
        members = member.join(base.select("node", "vec", "copies"), "node")
        found = found.union(materialize(_member_links(pairs, members, groups, space)))
    roots = components(found.where("kind = 'e'").select("a", "b")).select(F.col("node").alias("g"), "root")
    # written first, so that the join reads plain shuffles and adaptive execution splits a hot root
    linked = materialize(groups.select("g", "least", "w").join(roots, "g", "left").withColumn("root", F.coalesce("root", "g")))
    lowest = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    count = found.where("kind = 'n'").groupBy(F.col("a").alias("g")).agg(F.sum("w").alias("more"))
    whole = linked.join(lowest, "root").join(count, "g", "left").select("g", "w", "more", "component_id")
    single = found.where("kind = 'm'").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("own"))
    zero = F.lit(0).cast("long")
    result = materialize(member.join(whole, "g").join(single, "node", "left").select(
        "node", (F.col("w") - 1 + F.coalesce("more", zero) + F.coalesce("own", zero)).alias("n_links"), "component_id"))
    return named.select("vec_id", "node").join(result, "node").select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).union(alone)


def op12_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS s FROM v),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id
         WHERE list_inner_product(p.e, q.e) / (p.s * q.s) >= {COSINE}),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(deg.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(low.m, e.vec_id)) AS component_id,
       coalesce(e.vec_id = least(e.vec_id, coalesce(low.m, e.vec_id)), false) AS kept
FROM embeddings e LEFT JOIN deg ON deg.a = e.vec_id LEFT JOIN low ON low.a = e.vec_id
"""
