"""Sharding by balanced label propagation.

Linked documents (here: equal texts) start in shards of equal sizes and then, round
by round, move to the shard that holds most of their neighbours, found by joins of
the members with counts per (link, shard). A shard takes moves only while it is under
its quota of bytes, and its room is taken anew every round, with what its leavers gave
back. One that could take nothing for some rounds is closed until its room grows; what it
cannot take turns to the next shards with room, so even a group larger than a shard fills
few shards. Documents without links then level the
shards: they cut no edge wherever they go. Order of moves and of levelling comes from
seeded hashes, summed over a bounded number of hash cells, so no step sorts or gathers
documents.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumen.llm.common import materialize, read_table, text_key

SHARDS = 16
#: A shard may exceed the mean by this share while linked documents move.
SLACK = 0.005
ROUNDS = 2 * SHARDS
#: Rounds in a row without an accepted move after which a shard that refuses is closed.
IDLE_ROUNDS = 2
#: Hash cells: per size class when levelling; per shard, and within, when accepting moves.
LEVEL_CELLS, MOVE_CELLS, MOVE_PARTS = 1024, 1024, 32
#: Rows numbered together when slots are dealt.
SLOT_ROWS = 8192


def _u(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def level(nodes: DataFrame, loads: list[int]) -> DataFrame:
    """``nodes`` (id, size, ...) with ``shard``: cells of equal size class (power of
    two) and hash go, largest class first, to the least loaded shard. The cells are
    at most 64 x LEVEL_CELLS rows whatever the input, so the driver may deal them."""
    celled = (nodes.withColumn("__class", F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)))).cast("int"))
              .withColumn("__cell", F.pmod(F.xxhash64("id"), F.lit(LEVEL_CELLS)).cast("int")))
    cells = celled.groupBy("__class", "__cell").agg(F.sum("size").alias("bytes")).collect()
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    dealt = []
    for r in sorted(cells, key=lambda r: (-r["__class"], -r["bytes"], r["__cell"])):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + r["bytes"], s))
        dealt.append((r["__class"], r["__cell"], s))
    # an Arrow table needs no Python worker on the executors, as a list of rows would
    columns = [pa.array([d[i] for d in dealt], pa.int32()) for i in range(3)]
    table = nodes.sparkSession.createDataFrame(pa.table(columns, names=["__class", "__cell", "shard"]))
    return celled.join(F.broadcast(table), ["__class", "__cell"]).drop("__class", "__cell")


def shard_loads(state: DataFrame, shards: int) -> list[int]:
    loads = [0] * shards
    for r in state.groupBy("shard").agg(F.sum("size").alias("bytes")).collect():
        loads[r["shard"]] = r["bytes"]
    return loads


def propagate(members: DataFrame, state: DataFrame, cap: float, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """Move linked nodes towards their neighbours. ``members``: id, hub (each hub with
    two members or more); ``state``: id, size, shard. Every round, for every node the
    shard with most neighbours among those with room, or its own, is its aim (ties by a
    hash of link and shard, the same for all members); moves to a shard are accepted in
    the order of a hash of link and round while they fit, so the members of a link move
    together and large links in parts, and no link stands first in every round."""
    idle, closed = [0] * shards, {}                    # closed: the shard's room at that time
    for turn in range(rounds):
        room = [cap - x for x in shard_loads(state, shards)]
        closed = {s: r for s, r in closed.items() if room[s] <= r}
        open_ = F.element_at(F.array(*[F.lit(r > 0 and s not in closed) for s, r in enumerate(room)]), F.col("to") + 1)
        placed = members.join(state, "id")
        counts = placed.groupBy("hub", "shard").agg(
            (F.count("*") + 0.5 * F.max(_u(F.col("hub"), F.col("shard")))).alias("weight"))
        votes = (members.join(counts, "hub").groupBy("id", "shard")
                 .agg(F.sum("weight").alias("weight"), F.min(F.xxhash64("hub")).alias("link")))
        aims = (votes.withColumnRenamed("shard", "to").join(state, "id").where((F.col("to") == F.col("shard")) | open_)
                .groupBy("id", "size", "shard").agg(F.max(F.struct("weight", "to", "link")).alias("aim"))
                .select("id", "size", "shard", F.col("aim.to").alias("to"), F.col("aim.link").alias("link")))
        place = (F.pmod(F.xxhash64("link", F.lit(turn)), F.lit(MOVE_CELLS)) * MOVE_PARTS
                 + F.pmod(F.xxhash64("id"), F.lit(MOVE_PARTS))).cast("int")
        aims = materialize(aims.withColumn("place", place))
        cells = aims.where("to != shard").groupBy("to", "place").agg(F.sum("size").alias("bytes"))
        order = Window.partitionBy("to").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        fits = F.sum("bytes").over(order) <= F.element_at(F.array(*[F.lit(float(r)) for r in room]), F.col("to") + 1)
        taken = (cells.withColumn("fits", fits).groupBy("to")
                 .agg(F.max(F.when(F.col("fits"), F.col("place"))).alias("last"),
                      F.max(~F.col("fits")).alias("refused")).collect())
        if not taken:
            break
        for r in taken:
            idle[r["to"]] = idle[r["to"]] + 1 if r["refused"] and r["last"] is None else 0
        closed |= {s: room[s] for s in range(shards) if idle[s] >= IDLE_ROUNDS and s not in closed}
        upto = {r["to"]: r["last"] for r in taken if r["last"] is not None}
        last = F.element_at(F.array(*[F.lit(upto.get(s, -1)) for s in range(shards)]), F.col("to") + 1)
        state = materialize(aims.select("id", "size", F.when(F.col("place") <= last, F.col("to"))
                                        .otherwise(F.col("shard")).alias("shard")))
    return state


def balanced_shards(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, slack: float = SLACK,
                    rounds: int = ROUNDS) -> DataFrame:
    """(id, size, shard) for ``nodes`` (id unique, size >= 0) and ``links`` (id, hub):
    nodes with a common hub are neighbours. Hubs of one member and null hubs link
    nothing; nodes without links are free. An empty table stays empty."""
    total = nodes.agg(F.sum("size")).first()[0] or 0
    # written first: a join of plain shuffles lets adaptive execution split a hot hub
    shared = materialize(links.where(F.col("hub").isNotNull()).groupBy("hub").agg(F.count("*").alias("n")).where("n > 1"))
    members = materialize(links.join(shared, "hub").select("id", "hub"))
    linked_ids = members.select("id").distinct()
    linked = materialize(nodes.select("id", "size").join(linked_ids, "id"))
    state = materialize(level(linked, [0] * shards).select("id", "size", "shard"))
    state = propagate(members, state, total / shards * (1 + slack), shards, rounds)
    free = nodes.select("id", "size").join(linked_ids, "id", "left_anti")
    return state.unionByName(level(free, shard_loads(state, shards)).select("id", "size", "shard"))


def with_slots(placed: DataFrame, rows: int) -> DataFrame:
    """``slot``: gapless numbers from 0 in each shard, in hashed order. Rows are
    numbered within parts of a shard of about SLOT_ROWS; a part's offset is the sum of
    those before it."""
    parts = max(1, -(-rows // SLOT_ROWS // SHARDS))
    parted = placed.withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts)).cast("int"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parted.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id"))
    return (parted.withColumn("rank", rank).join(offsets, ["shard", "part"])
            .withColumn("slot", (F.col("before") + F.col("rank") - 1).cast("long")).drop("part", "rank", "before"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes and 1), text_crc32, law
    (``bytes``), shard, slot, grown_shard (null), then the columns ``keep``.

    Equal texts are linked. Null texts count as empty ones (size 1, CRC 0); null ids and
    repeated rows are rows like others (each gets its own slot); an empty table gives no
    rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = materialize(docs.select(
        F.monotonically_increasing_id().alias("id"), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), text_key(F.col("text")).alias("hub"), *keep))
    placed = materialize(balanced_shards(base.select("id", "size"), base.select("id", "hub"), shards).select("id", "shard"))
    rows = base.drop("hub").join(placed, "id")
    return with_slots(rows, placed.count()).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), *keep)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the shard and slot of every document of the mix."""
    return shard_documents(docs, keep=("lang", "source", "n_chars"))
