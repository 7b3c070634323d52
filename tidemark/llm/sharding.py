"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

The shard of a row is a function of its key and the number of shards: there is no ring table, and
with one more shard a key either stays or moves into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import written

#: Fixed value: the multiplier of the generator in the published algorithm.
JUMP_MULTIPLIER = 2862933555777941757
#: Runs that the rows of a shard are cut into, whatever their number.
RUNS = 1024
#: Equal rows that are laid open together.
PIECE = 10_000


def _next_state(state: Column) -> Column:
    """``state * JUMP_MULTIPLIER + 1`` modulo 2**64, in 16-bit limbs so that no product overflows a long."""
    a = [F.shiftrightunsigned(state, 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    c = [(JUMP_MULTIPLIER >> (16 * i)) & 0xFFFF for i in range(4)]
    out, carry = None, F.lit(1).cast("long")
    for limb in range(4):
        total = carry
        for i in range(limb + 1):
            total = total + a[i] * F.lit(c[limb - i]).cast("long")
        part = F.shiftleft(total.bitwiseAND(0xFFFF), 16 * limb)
        out = part if out is None else out.bitwiseOR(part)
        carry = F.shiftrightunsigned(total, 16)
    return out


def jump_path(key: Column, shards: int) -> Column:
    """``struct(shard, grown)``: the shard of ``key`` among ``shards`` and among ``shards + 1``.

    The jumps of a key do not depend on the number of shards; one walk gives both answers: the last
    landing place below ``shards`` and the last one below ``shards + 1``.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("at"), zero.alias("shard"), zero.alias("grown"), key.cast("long").alias("state"))

    def jump(acc: Column, _: Column) -> Column:
        state = _next_state(acc["state"])
        draw = F.shiftrightunsigned(state, 33).cast("double") + 1.0
        nxt = F.floor((acc["at"].cast("double") + 1.0) * (F.lit(float(1 << 31)) / draw)).cast("long")
        moved = F.struct(
            nxt.alias("at"),
            F.when(nxt < shards, nxt).otherwise(acc["shard"]).alias("shard"),
            F.when(nxt < shards + 1, nxt).otherwise(acc["grown"]).alias("grown"),
            state.alias("state"),
        )
        return F.when(acc["at"] > shards, acc).otherwise(moved)

    # each jump goes at least one place on, so shards + 1 jumps always leave the range
    steps = F.array_repeat(F.lit(0), shards + 1)
    return F.aggregate(steps, start, jump, lambda acc: F.struct(acc["shard"].cast("int").alias("shard"), acc["grown"].cast("int").alias("grown")))


def jump_shards(df: DataFrame, key: str, shards: int, shard_col: str = "shard", grown_col: str | None = None) -> DataFrame:
    """Append the shard of each row.

    The key column is cast to long if it is integral, else hashed. A null key goes where key 0 goes
    (one defined place). Rows with equal keys share a shard. An empty table gives an empty table.
    Columns of ``df`` that have the new names are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    integral = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    k = F.when(F.col(key).isNull(), F.lit(0).cast("long")).otherwise(F.col(key).cast("long") if integral else F.xxhash64(key))
    path = jump_path(k, shards)
    out = df.withColumn(shard_col, path["shard"])
    return out.withColumn(grown_col, path["grown"]) if grown_col else out


def shard_table(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard assignment with gapless positions: id, size, text_crc32, law, shard, slot, grown_shard.

    A slot is a position inside the shard. A shard may hold 1/16 of 100 TB, so no window covers a
    shard: rows are cut into ``RUNS`` runs by a hash of what they hold, equal rows are counted, groups
    of equal rows are placed inside the run, and runs are shifted by the rows in the runs before. At
    the end a group is laid open into its slots.

    Null text: size 1, crc 0. Null ids: shard of key 0. Repeated rows get slots of their own. Ids may
    have any type.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    groups = rows.groupBy(*rows.columns).agg(F.count("*").alias("many"))
    # a large group goes in pieces of its own runs, so no task lays it open alone
    groups = groups.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(many - 1) div {PIECE}"))))
    groups = groups.withColumn("many", F.least(F.lit(PIECE), F.col("many") - F.col("piece") * PIECE))
    groups = groups.withColumn("run", F.pmod(F.xxhash64(*rows.columns, "piece"), F.lit(RUNS)).cast("int"))
    groups = written(jump_shards(groups, id_col, shards, "shard", "grown_shard"))
    counts = groups.groupBy("shard", "run").agg(F.sum("many").alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # RUNS rows a shard
    offsets = counts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "run").orderBy(id_col, "text_crc32", "size", "piece").rowsBetween(Window.unboundedPreceding, 0)
    placed = groups.withColumn("past", F.sum("many").over(inside)).join(offsets, ["shard", "run"]).withColumn("past", F.col("past") + F.col("offset"))
    slots = F.explode(F.sequence(F.col("past") - F.col("many"), F.col("past") - 1))
    return placed.withColumn("slot", slots).select(F.col(f"`{id_col}`"), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
