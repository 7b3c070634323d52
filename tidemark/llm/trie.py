"""Prefix trie of conversations in double arrays (Aoe, 1989), built in shards.

A conversation is a sequence of turns, a turn the pair of its role and text. Every distinct sequence
of first turns is a node. Its key is its depth with two 64-bit values, each the exclusive or of one
hash per (depth, turn): such keys need no order of evaluation, so they are running values inside
segments of a conversation, carried over its segments, and a conversation of any length is no task's
burden.

Equal conversations are one sequence with a count. A node is an *upper* node if more than ``SHARD``
turns lie under it in its segment, or if it ends a segment; so the trie falls apart into subtrees of
bounded size that hang from upper nodes, and subtrees are dealt into shards. A shard numbers its
turns densely, packs its subtrees into BASE and CHECK arrays and walks every sequence through them:
that gives its nodes, their members, children, leaves and sums. What lies under an upper node comes
from several shards and is merged over them, from the deepest upper node to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import written

#: Turns of a shard; turns of a segment of a conversation; ids that are joined to one string.
SHARD, SEGMENT, IDS = 4096, 1024, 4096
#: Upper nodes up to which their table is sent to all executors.
SENT_ROWS = 100_000
#: Free places that are tried for the children of a node before they go behind all others.
TRIES = 16
NODE = ["depth", "pa", "pb"]


def numbered(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, depth (from 1), ta, tb (hashes of the turn) and chars of every turn, in order of turn numbers.

    Null numbers come first, equal ones in the order of the turns' hashes; a null role or text is empty.
    Rows without a conversation are left out.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("ta"), F.xxhash64(F.lit(1), text, role).alias("tb"), F.length(text).cast("long").alias("chars"))
    rows = rows.withColumn("span", F.coalesce(F.expr(f"turn div {SEGMENT}"), F.lit(-(1 << 63))))
    spans = rows.groupBy("conv_id", "span").agg(F.count("*").alias("many"))
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("conv_id", "span", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "span").orderBy(F.asc_nulls_first("turn"), "ta", "tb")
    rows = rows.join(spans, ["conv_id", "span"]).withColumn("depth", F.row_number().over(inside) + F.col("before"))
    return rows.select("conv_id", "depth", "ta", "tb", "chars")


def rebuilt(turns: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation starts with the first h turns of the one at the hundred below it.

    Its own first h turns go; h is crc32 of its decimal id modulo ``heads``. Where the conversation at
    the hundred is missing, none take their place. Conversations may be left without turns.
    """
    convs = turns.groupBy("conv_id").agg(F.max("depth").alias("length"))
    roots = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("root"), F.col("length").alias("root_length"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = convs.withColumn("root", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(roots, "root", "left")
    convs = written(convs.select("conv_id", "root", "h", F.least("h", F.coalesce("root_length", F.lit(0))).alias("head")))
    own = turns.join(convs.select("conv_id", "h", "head"), "conv_id").where("depth > h").withColumn("depth", F.col("depth") - F.col("h") + F.col("head"))
    first = turns.where((F.col("conv_id") % every == 0) & (F.col("depth") < heads)).withColumnRenamed("conv_id", "root")
    head = first.join(convs.where("head > 0").select("conv_id", "root", "head"), "root").where("depth <= head")
    names = ["conv_id", "depth", "ta", "tb", "chars"]
    return own.select(names).unionByName(head.select(names)), convs.select("conv_id")


class DoubleArray:
    """BASE and CHECK of a forest; the child of s by symbol c is BASE[s] + c if CHECK there names s."""

    FREE, ROOT = -2, -1

    def __init__(self, roots: int):
        self.base = np.zeros(roots, np.int64)
        self.check = np.full(roots, self.ROOT, np.int64)

    def _grow(self, size: int) -> None:
        more = size - len(self.check)
        if more > 0:
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, self.FREE, np.int64))

    def add(self, parents: np.ndarray, symbols: np.ndarray) -> None:
        """Children of nodes that have none yet; both in order of (parent, symbol), without repeats."""
        starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        ends = np.r_[starts[1:], len(parents)]
        for start, end in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            offsets = symbols[start:end] - symbols[start]
            for place in [*np.flatnonzero(self.check == self.FREE)[:TRIES].tolist(), len(self.check)]:
                self._grow(place + int(offsets[-1]) + 1)
                if (self.check[place + offsets] == self.FREE).all():
                    break
            self.check[place + offsets] = parents[start]
            self.base[parents[start]] = place - symbols[start]
        single = starts[ends - starts == 1]
        free = np.flatnonzero(self.check == self.FREE)[: len(single)]
        if len(free) < len(single):
            size = len(self.check)
            self._grow(size + len(single) - len(free))
            free = np.append(free, np.arange(size, len(self.check)))
        self.check[free] = parents[single]
        self.base[parents[single]] = free - symbols[single]

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children by the symbols; -1 where there is none."""
        at = self.base[states] + symbols
        inside = (at >= 0) & (at < len(self.check))
        return np.where(inside & (self.check[np.where(inside, at, 0)] == states), at, -1)


def pack(roots: np.ndarray, starts: np.ndarray, lengths: np.ndarray, turn: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """The double array of sequences (``turn[start : start + length]`` below ``root``) and each turn's symbol.

    Symbols are dense and are given level by level, so the children of a node get neighbouring ones.
    """
    trie = DoubleArray(int(roots.max()) + 1)
    symbol, given = np.full(int(turn.max()) + 1, -1, np.int64), 0
    state = roots.astype(np.int64)
    for depth in range(int(lengths.max())):
        going = np.flatnonzero(lengths > depth)
        own = turn[starts[going] + depth]
        order = np.lexsort((own, state[going]))
        parents, turns = state[going][order], own[order]
        new = np.r_[True, (parents[1:] != parents[:-1]) | (turns[1:] != turns[:-1])]
        parents, turns = parents[new], turns[new]
        unseen = turns[symbol[turns] < 0]
        unseen = unseen[np.sort(np.unique(unseen, return_index=True)[1])]
        symbol[unseen] = np.arange(given, given + len(unseen))
        given += len(unseen)
        order = np.lexsort((symbol[turns], parents))
        trie.add(parents[order], symbol[turns][order])
        state[going] = trie.step(state[going], symbol[own])
    return trie, symbol


_SHARD_SCHEMA = "partial boolean, depth long, pa long, pb long, upper boolean, up_depth long, ua long, ub long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long"


def _nodes(rows: pa.Table) -> pa.Table:
    """Nodes of a shard, and for every upper node over it what the shard adds to it (``partial``)."""
    of = {c: rows[c].to_numpy(zero_copy_only=False) for c in rows.column_names}
    order = np.lexsort((of["depth"], of["conv_id"], of["ub"], of["ua"], of["up_depth"]))
    of = {c: x[order] for c, x in of.items()}
    changes = lambda *names: np.r_[True, np.any([of[c][1:] != of[c][:-1] for c in names], axis=0)]
    over, starts = changes("up_depth", "ua", "ub"), np.flatnonzero(changes("up_depth", "ua", "ub", "conv_id"))
    lengths, roots = np.diff(np.r_[starts, len(order)]), (np.cumsum(over) - 1)[starts]
    _, turn = np.unique(np.stack([of["ta"], of["tb"]]), axis=1, return_inverse=True)
    trie, symbol = pack(roots, starts, lengths, turn.ravel())
    size, n_roots = len(trie.check), int(roots.max()) + 1
    row, n, low = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    state, levels = roots.astype(np.int64), []
    for depth in range(int(lengths.max())):
        going = np.flatnonzero(lengths > depth)
        at = starts[going] + depth
        state[going] = trie.step(state[going], symbol[turn.ravel()[at]])
        if (state[going] < 0).any():
            raise AssertionError("a sequence has no path in its double array")
        row[state[going]] = at  # all rows of a node agree in what is read of them
        np.add.at(n, state[going], of["many"][at])
        np.minimum.at(low, state[going], of["conv_id"][at])
        levels.append(np.unique(state[going]))
    children, leaves, saved = (np.zeros(size, np.int64) for _ in range(3))
    for level in reversed(levels):
        leaves[level] += (children[level] == 0) & ~of["upper"][row[level]]
        saved[level] += (n[level] - 1) * of["chars"][row[level]]
        for total, own in ((children, 1), (leaves, leaves[level]), (saved, saved[level])):
            np.add.at(total, trie.check[level], own)
    node = np.concatenate(levels)
    at, parent = row[node], trie.check[node]
    top = np.flatnonzero(over)
    join = lambda a, b, kind=pa.int64(), mask=None: pa.array(np.concatenate([a, b]), kind, mask=mask)
    zeros = np.zeros(n_roots, np.int64)
    out = {"partial": join(np.zeros(len(node), bool), np.ones(n_roots, bool), pa.bool_())}
    for name, up in (("depth", "up_depth"), ("pa", "ua"), ("pb", "ub")):
        out[name] = join(of[name][at], of[up][top])
    out["upper"] = join(of["upper"][at], np.ones(n_roots, bool), pa.bool_())
    for name in ("up_depth", "ua", "ub"):
        out[name] = join(of[name][at], of[name][top])
    out["conv_id"] = join(low[node], zeros, mask=np.r_[np.zeros(len(node), bool), np.ones(n_roots, bool)])
    out["parent_conv_id"] = join(low[parent], zeros, mask=np.r_[parent < n_roots, np.ones(n_roots, bool)])
    for name, total in (("n_convs", n), ("n_children", children), ("n_leaves", leaves), ("saved", saved)):
        out[name] = join(total[node], total[:n_roots])
    return pa.table(out)


def _ends(sequences: DataFrame) -> DataFrame:
    """Per sequence (depth, pa, pb) the SHA-256 of its conversations' ids, ascending and joined by commas.

    Ids are joined to strings in spans of ``IDS``; a sequence's strings then run through one hash in order.
    """
    spans = sequences.withColumn("span", F.expr(f"conv_id div {IDS}")).groupBy(*NODE, "span").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    spans = spans.select(*NODE, "span", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")).repartition(*NODE).sortWithinPartitions(*NODE, "span")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for batch in batches:
            found: list[tuple] = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if node == last:
                    sha.update(b",")
                else:
                    found += [] if last is None else [(*last, sha.hexdigest())]
                    last, sha = node, hashlib.sha256()
                sha.update(ids.encode())
            yield _digests(found)
        yield _digests([] if last is None else [(*last, sha.hexdigest())])

    return spans.mapInArrow(digest, "depth long, pa long, pb long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], names=[*NODE, "ends_sha256"])


def trie_nodes(turns: DataFrame, convs: DataFrame, shard: int = SHARD, segment: int = SEGMENT) -> DataFrame:
    """Nodes of the prefix trie of ``turns`` (as ``numbered`` gives them); ``convs`` names all conversations.

    Per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. The root has depth 0 and all conversations, also those without
    turns; without conversations there are no nodes.
    """
    spark = turns.sparkSession
    rows = turns.withColumn("seg", F.expr(f"(depth - 1) div {segment}")).withColumns({"za": F.xxhash64("depth", "ta"), "zb": F.xxhash64("tb", "depth")})
    segs = rows.groupBy("conv_id", "seg").agg(F.bit_xor("za").alias("xa"), F.bit_xor("zb").alias("xb"), F.count("*").alias("n"))
    segs = written(segs)
    whole = segs.groupBy("conv_id").agg(F.sum("n").alias("depth"), F.bit_xor("xa").alias("pa"), F.bit_xor("xb").alias("pb"))
    sequences = written(convs.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in NODE]))
    all_convs, least_conv = sequences.agg(F.count("*"), F.min("conv_id")).first()
    # one conversation stands for all equal ones
    reps = sequences.where("depth > 0").groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("many")).select("conv_id", F.col("depth").alias("length"), "many")
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = segs.join(reps, "conv_id").select("conv_id", "seg", "length", "many", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(c) for x, c in (("xa", "ca"), ("xb", "cb"))])
    part = Window.partitionBy("conv_id", "seg").orderBy("depth")
    sofar = part.rowsBetween(Window.unboundedPreceding, 0)
    paths = rows.join(carried, ["conv_id", "seg"])
    paths = paths.withColumns({c: F.bit_xor(z).over(sofar).bitwiseXOR(F.col(k)) for c, z, k in (("pa", "za", "ca"), ("pb", "zb", "cb"))})
    below = F.least("length", (F.col("seg") + 1) * segment) - F.col("depth")
    paths = written(paths.select("conv_id", "seg", *NODE, "ta", "tb", "chars", "many", "ca", "cb", below.alias("below")))
    upper = paths.groupBy(*NODE).agg(F.sum("below").alias("all_below"), F.min("conv_id").alias("low")).where(f"all_below > {shard} or depth % {segment} = 0")
    upper = written(upper.select(*NODE, "low"))
    n_upper, n_rows = upper.count(), paths.count()
    sent = F.broadcast if n_upper <= SENT_ROWS else lambda x: x
    flagged = paths.join(sent(upper.select(*NODE, F.lit(True).alias("upper"))), NODE, "left").withColumn("upper", F.coalesce("upper", F.lit(False)))
    # a subtree starts with a segment or behind an upper node
    starts = (F.col("depth") == F.col("seg") * segment + 1) | F.lag("upper").over(part)
    flagged = flagged.withColumns({"start": F.coalesce(starts, F.lit(False)), "la": F.coalesce(F.lag("pa").over(part), "ca"), "lb": F.coalesce(F.lag("pb").over(part), "cb")})
    at_start = lambda x: F.last(F.when(F.col("start"), x), ignorenulls=True).over(sofar)
    flagged = flagged.withColumns({"up_depth": at_start(F.col("depth") - 1), "ua": at_start(F.col("la")), "ub": at_start(F.col("lb")), "ka": at_start(F.col("pa")), "kb": at_start(F.col("pb"))})
    shards = F.pmod(F.xxhash64("up_depth", "ka", "kb"), F.lit(max(1, -(-n_rows // shard))))
    flagged = written(flagged.select("conv_id", *NODE, "ta", "tb", "chars", "many", "upper", "up_depth", "ua", "ub", shards.alias("shard")))
    nodes = written(flagged.groupBy("shard").applyInArrow(lambda rows: _nodes(rows.drop_columns(["shard"])), _SHARD_SCHEMA))

    # what shards have found under upper nodes, then what upper nodes add to those over them
    names = ["n_children", "n_leaves", "saved"]
    merged = nodes.where("partial").groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in names])
    own = nodes.where("not partial")
    root_sums = merged.where("depth = 0")
    if n_upper:
        tops = own.where("upper").select(*NODE, "conv_id", "up_depth").join(merged, NODE, "left")
        childless = F.coalesce("n_children", F.lit(0)) == 0
        tops = written(tops.select(*NODE, "conv_id", "up_depth", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.when(childless, 1).otherwise(F.col("n_leaves")).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved")))
        paths_of = lambda top, which: top.select("conv_id", F.col("depth").alias("deep"), F.col("up_depth").alias("of"), "n_leaves", "saved").join(flagged.where(which).select("conv_id", *NODE, "up_depth"), "conv_id").where("depth < deep")
        sums = lambda x: x.groupBy(*NODE).agg(F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        over = paths_of(tops, "upper").withColumn("n_children", F.lit(0))
        whole_tops = written(sums(tops.select(*NODE, *names).unionByName(over.select(*NODE, *names))))
        inside = tops.select(*NODE, "conv_id", "up_depth").join(whole_tops, NODE)
        inside = paths_of(inside, "not upper").where("up_depth = of").withColumn("n_children", F.lit(0))
        added = whole_tops.unionByName(sums(inside.select(*NODE, *names)))
        root_sums = sums(root_sums.unionByName(tops.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("pa"), F.lit(0).cast("long").alias("pb"), F.lit(0).cast("long").alias("n_children"), "n_leaves", "saved")))
        own = own.join(added.toDF(*NODE, *[f"more_{c}" for c in names]), NODE, "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in names})
        first = F.col("parent_conv_id").isNull() & (F.col("up_depth") > 0)
        parents = upper.toDF("up_depth", "ua", "ub", "low")
        known = own.where(~first)
        own = known.drop("low").unionByName(own.where(first).join(sent(parents), ["up_depth", "ua", "ub"]).withColumn("parent_conv_id", F.col("low")).drop("low"))
    least = F.lit(least_conv).cast("long")
    own = own.select(*NODE, "conv_id", F.coalesce("parent_conv_id", least).alias("parent_conv_id"), "n_convs", *names)
    found = root_sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    zero = F.lit(0).cast("long")
    root = found.select(zero.alias("depth"), zero.alias("pa"), zero.alias("pb"), least.alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(all_convs).cast("long").alias("n_convs"), "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).alias("n_leaves"), "saved")
    out = own.unionByName(root.where(F.lit(all_convs > 0))).join(_ends(sequences), NODE, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", heads: int | None = None, shard: int = SHARD, segment: int = SEGMENT) -> DataFrame:
    """One row per distinct sequence of first turns of the conversations in ``df``: the nodes of their trie.

    Turns go by their numbers, nulls first; null roles and texts are empty, so equal to empty ones.
    Equal turn numbers and repeated rows are turns of their own, in the order of their hashes. Rows
    without a conversation id are left out. Texts of any length are one turn. An empty table gives no
    nodes; other columns are not read. With ``heads`` the conversations are first ``rebuilt``.
    """
    turns = written(numbered(df, conv_col, turn_col, role_col, text_col))
    turns, convs = (turns, turns.select("conv_id").distinct()) if heads is None else rebuilt(turns, heads=heads)
    return trie_nodes(turns, convs, shard, segment)
