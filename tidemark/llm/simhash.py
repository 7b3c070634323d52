"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into so few segments that two linked fingerprints have one segment that
differs by at most one bit. Each segment is indexed once per bit position with that bit left out,
so such a segment of both has an equal variant: candidates come from one equality join and are then
verified on all bits.

Only distinct fingerprints are indexed; exact copies meet in a group-by. A variant that is shared by
more than ``SMALL`` fingerprints is not joined with itself, as the pairs would grow with the square
of the group. With up to two differing bits its fingerprints get the exact linear way: two of them
link if and only if some bit string lies within one bit of both, so all 65 strings around each are
grouped, and every group is a star. With more bits they are compared in blocks of bounded size whose
components meet again, and only the links of spanning forests leave a block.

With a least Jaccard similarity the fingerprints only search: they are those of the sets of distinct
shingles, their links make clusters of candidates, and inside each cluster the sets themselves are
compared. Only sets that are similar enough link, and only these links make components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .util import free_name, written

#: Fingerprints that may share a variant and still be joined pair by pair.
SMALL = 32
#: Fingerprints in a block of a larger variant.
BLOCK = 2048
#: Random fingerprints that share a variant of a segment, about.
GROUP = 16
#: Shingles whose bits are added at once.
CHUNK = 1 << 18
#: Shingles in a block of a cluster of candidates.
SHINGLES = 1 << 19
#: Rows up to which a table is sent to all executors.
SENT_ROWS = 200_000
#: Width of a length band, in steps of 1.25; a step at its upper end lies in the next one too.
BAND = 4


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words of ``text`` (A-Z lower-cased, single spaces), repeats included.

    A text of fewer words has one run; a text without words has none.
    """
    parts = text.encode("utf-8").lower().split() if text else []  # bytes: only A-Z change, only ASCII space splits
    if not parts:
        return np.empty(0, ">u8")
    joined, words = b" ".join(parts), min(words, len(parts))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], ">u8")


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits; a bit is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The hashes for another 64 bits of fingerprint: each is mixed again, lane 0 is as it is."""
    if not lane:
        return hashes
    x = hashes.astype(np.uint64) + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(">u8")


def fingerprints(text: Column, words: int = 3, lanes: int = 1) -> Column:
    """``struct(f0.., n)``: per lane a 64-bit SimHash as a long, and the number of shingles."""
    names = [f"f{i}" for i in range(lanes)]

    @F.pandas_udf(", ".join(f"{c} long" for c in names) + ", n long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = np.zeros((len(texts), lanes + 1), np.uint64)
            for k, text in enumerate(texts):
                found = shingle_hashes(text, words, 42)
                for lane in range(lanes):
                    rows[k, lane] = fingerprint(_mixed(found, lane))
                rows[k, lanes] = len(found)
            yield pd.DataFrame(rows.view(np.int64), columns=[*names, "n"])

    return of(text)


def shingle_sets(text: Column, words: int, lanes: int) -> Column:
    """``struct(f0.., n, s)``: as ``fingerprints`` of the distinct shingles, with a hash ``s`` of their set."""
    names = [f"f{i}" for i in range(lanes)]

    @F.pandas_udf(", ".join(f"{c} long" for c in names) + ", n long, s long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = np.zeros((len(texts), lanes + 2), np.uint64)
            for k, text in enumerate(texts):
                own = np.unique(shingle_hashes(text, words, 42))
                for lane in range(lanes):
                    rows[k, lane] = fingerprint(_mixed(own, lane))
                rows[k, lanes:] = len(own), xxhash.xxh64_intdigest(own.tobytes())
            yield pd.DataFrame(rows.view(np.int64), columns=[*names, "n", "s"])

    return of(text)


def _variants(prints: DataFrame, lanes: int, segment_bits: int, banded: bool) -> DataFrame:
    """One row per fingerprint, segment and left-out bit, with a long ``key`` that is equal for equal variants."""
    per_lane = 64 // segment_bits
    segments = lanes * per_lane
    pos = prints.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(segments * segment_bits - 1))))
    pos = pos.withColumn("seg", F.expr(f"pos div {segment_bits}")).withColumn("bit", F.expr(f"cast(pos % {segment_bits} as int)"))
    lane = F.col("f0")
    for i in range(1, lanes):
        lane = F.when(F.col("seg") >= i * per_lane, F.col(f"f{i}")).otherwise(lane)
    pos = pos.withColumn("lane", lane)
    value = F.expr(f"shiftrightunsigned(lane, cast((seg % {per_lane}) * {segment_bits} as int)) & {(1 << segment_bits) - 1}L")
    left_out = value.bitwiseAND(F.expr("~shiftleft(1L, bit)"))
    key = left_out.bitwiseOR(F.shiftleft(F.col("bit").cast("long"), 32)).bitwiseOR(F.shiftleft(F.col("seg").cast("long"), 38))
    if banded:  # sets at a Jaccard similarity of 0.8 or more have counts at most one step of 1.25 apart and share a band
        step = F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / float(np.log(1.25))
        pos = pos.withColumn("band", F.explode(F.array_distinct(F.array(F.floor(step / BAND), F.floor((step + 1 + 1e-9) / BAND)))))
        key = key.bitwiseOR(F.shiftleft(F.col("band").cast("long"), 48))
    return pos.select(key.alias("key"), *[f"f{i}" for i in range(lanes)], *(["id"] if lanes > 1 else []))


def _far(left: str, right: str, lanes: int) -> Column:
    out = F.lit(0)
    for i in range(lanes):
        out = out + F.bit_count(F.col(f"{left}.f{i}").bitwiseXOR(F.col(f"{right}.f{i}")))
    return out


def _ball_links(hot: DataFrame) -> DataFrame:
    """Links of fingerprints at up to two bits: stars around every string within one bit of several."""
    near = hot.select("f0", F.explode(F.concat(F.array("f0"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("f0").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("z"))
    stars = near.groupBy("z").agg(F.min("f0").alias("low"), F.count("*").alias("many")).where("many > 1")
    return near.join(stars, "z").where("f0 <> low").select(F.col("f0").alias("a"), F.col("low").alias("b")).distinct()


def _explored(n: int, near: Callable[[int, np.ndarray], np.ndarray], asks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) among ``n`` members; ``near(i, open)`` are the open ones that i links with.

    Without ``asks`` a spanning forest: each member meets only those that are in no tree yet. With it
    every link of the members that ask.
    """
    a, b = [], []
    if asks is not None:
        for i in np.flatnonzero(asks):
            found = near(i, np.arange(n) != i)
            a.append(np.full(len(found), i))
            b.append(found)
    else:
        open_ = np.ones(n, bool)
        for seed in range(n):
            queue = [seed] if open_[seed] else []
            open_[queue] = False
            for i in queue:  # a component, breadth first
                found = near(i, open_)
                open_[found] = False
                queue += found.tolist()
                a.append(np.full(len(found), i))
                b.append(found)
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return join(a), join(b)


def _near_prints(names: list[str], max_bits: int):
    def link(block: pd.DataFrame, asks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        prints = np.ascontiguousarray(block[names].to_numpy(np.int64)).view(np.uint64)

        def near(i: int, open_: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(open_)
            return at[np.bitwise_count(prints[at] ^ prints[i]).sum(axis=1, dtype=np.int32) <= max_bits]

        return _explored(len(block), near, asks)

    return link


def _near_sets(least: float):
    def link(block: pd.DataFrame, asks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        own = block["hashes"].tolist()
        n, sizes = len(own), np.array([len(h) for h in own])
        _, full = np.unique(np.concatenate(own), return_inverse=True)
        of, mark = np.repeat(np.arange(n), sizes), np.zeros(len(full), bool)
        starts = np.cumsum(sizes) - sizes
        state = [full, of, n]

        def near(i: int, open_: np.ndarray) -> np.ndarray:
            word, of, left = state
            if 2 * open_.sum() < left:  # what is in a tree is compared no more
                keep = open_[of]
                word, of = word[keep], of[keep]
                state[:] = word, of, int(open_.sum())
            mine = full[starts[i] : starts[i] + sizes[i]]
            mark[mine] = True
            common = np.bincount(of[mark[word]], minlength=n)
            mark[mine] = False
            return np.flatnonzero(open_ & (common >= least * (sizes + sizes[i] - common) - 1e-9) & (common > 0))

        return _explored(n, near, asks)

    return link


def links_in_groups(rows: DataFrame, payload: list[str], link, limit: int) -> DataFrame:
    """Links (a, b) that make the components of each group's members (group, id, weight, parts, ``payload``).

    A group of several ``parts`` (its weight over ``limit``) is never one task: its parts find their
    own components, whose first members meet again in parts of bounded weight until they are one part
    or no longer get fewer. What is then outside the group's largest component is compared with every
    member of the group, block by block, so no link between components is lost, and a group whose
    members are alike costs no more than its rows.
    """
    names = ["group", "id", "weight", "parts"]
    rows = rows.select(*names, *payload)

    def own(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates("id").sort_values("id", ignore_index=True)
        label, (a, b) = np.arange(len(block)), link(block, None)
        label[b] = a  # a forest, its parents come first in each tree
        while (label[label] != label).any():
            label = label[label]
        return pd.DataFrame({"group": block["group"], "id": block["id"], "weight": block["weight"], "parts": block["parts"], "root": block["id"].to_numpy()[label]})

    def part(n: str):
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    schema = "group long, id long, weight long, parts int, root long"
    inside = lambda x: written(x.withColumn("part", part("parts")).groupBy("group", "part").applyInPandas(lambda block: own(block.drop(columns="part")), schema))
    first = found = inside(rows)
    links = found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    large = first.where("parts > 1")
    members = large.count()
    if not members:
        return links
    met, before = [links], members
    while True:  # first members of components, in fewer parts
        heads = found.where("parts > 1 and id = root").select("group", "id", "weight")
        total = heads.groupBy("group").agg(F.greatest(F.lit(1), F.ceil(F.sum("weight") / limit)).cast("int").alias("parts"))
        heads = written(heads.join(total, "group"))
        n = heads.count()
        if not n or 2 * n > before:
            break
        found, before = inside(heads.join(rows.drop("weight", "parts"), ["group", "id"])), n
        met.append(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = written(reduce(DataFrame.unionByName, met))
    roots = components(links)
    placed = large.select("group", "id", "weight", "parts").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = written(placed)
    largest = placed.groupBy("group", "root").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    rest = placed.join(largest, "group").where("root <> largest").select("group", "id", "weight")
    asking = rest.groupBy("group").agg(F.ceil(F.sum("weight") / limit).cast("int").alias("r_parts"))
    rest = written(rest.join(asking, "group"))
    if not rest.count():
        return links
    blocks = rows.where("parts > 1").join(asking, "group")
    asked = blocks.join(rest.select("group", "id"), ["group", "id"]).select("group", "id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), part("r_parts").alias("r_part"), F.lit(True).alias("asks"), *payload)
    others = blocks.select("group", "id", part("parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("r_parts") - 1)).alias("r_part"), F.lit(False).alias("asks"), *payload)

    def across(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["id", "asks"], ascending=[True, False]).drop_duplicates("id", ignore_index=True)
        a, b = link(block, block["asks"].to_numpy(bool))
        ids = block["id"].to_numpy()
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    more = asked.unionByName(others).groupBy("group", "part", "r_part").applyInPandas(across, "a long, b long")
    return links.unionByName(more.distinct())


def _print_groups(hot: DataFrame, lanes: int, max_bits: int) -> DataFrame:
    """Links inside large variants (key, id, f0..)."""
    names = [f"f{i}" for i in range(lanes)]
    counts = hot.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rows = hot.join(counts, "key").select(F.col("key").alias("group"), "id", F.lit(1).cast("long").alias("weight"), "parts", *names)
    return links_in_groups(rows, names, _near_prints(names, max_bits), BLOCK)


def _searched(keyed: DataFrame, lanes: int, max_bits: int) -> DataFrame:
    """Links (a, b, many = 0) inside variants of at most ``SMALL``, and the rows (key, many, a = id, f0..) of larger ones.

    One shuffle: the variants are read in order. A variant gives at most one link a row, which keep its components.
    """
    names = [f"f{i}" for i in range(lanes)]

    def found(rows: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        counts = np.diff(np.r_[starts, len(rows)])
        many, nth = np.repeat(counts, counts), np.arange(len(rows)) - np.repeat(starts, counts)
        prints, label = rows[:, 2:].view(np.uint64), np.arange(len(rows))
        links = [np.empty((2, 0), np.int64)]
        for d in range(1, SMALL):
            at = np.flatnonzero((many <= SMALL) & (nth + d < many))
            near = at[np.bitwise_count(prints[at] ^ prints[at + d]).sum(axis=1, dtype=np.int32) <= max_bits]
            links.append(np.stack([near, near + d]))
        low, high = np.concatenate(links, axis=1)
        while True:  # rows are in order of ids: the smallest id is the root
            last = label.copy()
            np.minimum.at(label, high, last[low])
            np.minimum.at(label, low, last[high])
            label = label[label]
            if (label == last).all():
                break
        linked, hot = np.flatnonzero(label != np.arange(len(rows))), np.flatnonzero(many > SMALL)
        take, zero = np.r_[linked, hot], np.zeros(len(linked), np.int64)
        out = [rows[take, 1], rows[label[take], 1], rows[take, 0], np.r_[zero, many[hot]], *(rows[take, 2 + i] for i in range(lanes))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["a", "b", "key", "many", *names])

    def large(rows: np.ndarray) -> pa.RecordBatch:
        out = [rows[:, 1], rows[:, 1], rows[:, 0], np.full(len(rows), SMALL + 1), *(rows[:, 2 + i] for i in range(lanes))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["a", "b", "key", "many", *names])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, passing = [], 0, None  # ``passing``: a variant that fills a chunk goes on as it comes
        for batch in batches:
            held.append(np.column_stack([c.to_numpy() for c in batch.columns]))
            size += batch.num_rows
            if size < CHUNK:
                continue
            rows = np.concatenate(held)
            if passing is not None:
                end = int(np.searchsorted(rows[:, 0], passing, "right"))
                if end:
                    yield large(rows[:end])
                passing, rows = passing if end == len(rows) else None, rows[end:]
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0])) if len(rows) else 0  # the last variant may go on
            if cut:
                yield found(rows[:cut])
            rows = rows[cut:]
            if len(rows) > CHUNK // 2:
                yield large(rows)
                passing, rows = rows[-1, 0], rows[:0]
            held, size = [rows], len(rows)
        rows = np.concatenate(held) if held else np.empty((0, 2 + lanes), np.int64)
        end = int(np.searchsorted(rows[:, 0], passing, "right")) if passing is not None else 0
        if end:
            yield large(rows[:end])
        if len(rows) > end:
            yield found(rows[end:])

    ordered = keyed.select("key", "id", *names).repartition("key").sortWithinPartitions("key", "id")
    return ordered.mapInArrow(search, "a long, b long, key long, many long, " + ", ".join(f"{c} long" for c in names))


def simhash_links(prints: DataFrame, lanes: int, segment_bits: int, max_bits: int, banded: bool = False) -> DataFrame:
    """Links (a, b) between ids of distinct fingerprints (id, f0.., n) that differ in at most ``max_bits`` bits.

    With ``lanes * 64 / segment_bits`` segments that exceed half of ``max_bits`` every such pair is
    found; with fewer the search is a likely one. The links keep the components, not every pair.
    """
    names = [f"f{i}" for i in range(lanes)]
    keyed = _variants(prints, lanes, segment_bits, banded)
    if lanes > 1:
        found = written(_searched(keyed, lanes, max_bits))
        hot = found.where("many > 0").select("key", F.col("a").alias("id"), *names)
        return found.where("many = 0").select("a", "b").unionByName(_print_groups(hot, lanes, max_bits)).distinct()
    # one shuffle: distinct fingerprints that agree in a whole variant are few enough for a window
    keyed = keyed.withColumn("many", F.count("*").over(Window.partitionBy("key"))).where("many > 1")
    keyed = written(keyed).withColumn("id", F.col("f0"))  # the fingerprint names itself
    few = keyed.where(F.col("many") <= SMALL)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (_far("a", "b", lanes) <= max_bits)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    hot = keyed.where(F.col("many") > SMALL)
    if max_bits <= 2:
        more = _ball_links(hot.select("f0").distinct())
        if max_bits < 2:
            more = more.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    else:
        more = _print_groups(hot, lanes, max_bits)
    return pairs.unionByName(more).distinct()


def similar_links(df: DataFrame, id_col: str, text_col: str, rows: DataFrame, clusters: DataFrame, words: int, least: float) -> DataFrame:
    """Links (a, b) between shingle sets of one cluster (node, root) whose Jaccard similarity is at least ``least``.

    ``rows`` has row_key, n and s of the rows of ``df``. All sets of a cluster that no link joins yet
    are compared; the links keep the components, not every pair.
    """
    members = rows.groupBy(F.col("s").alias("node")).agg(F.min("row_key").alias("row_key"), F.first("n").alias("n")).join(clusters, "node")
    members = written(members)
    sizes = members.groupBy("root").agg(F.sum("n").alias("total"))
    parts = F.ceil(F.greatest("total", F.lit(1)) / SHINGLES).cast("int")
    members = written(members.join(sizes, "root").select("row_key", "root", F.col("node").alias("id"), F.greatest("n", F.lit(1)).alias("weight"), parts.alias("parts")))
    few = F.broadcast(members) if members.count() <= SENT_ROWS else members

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, words, 42).astype(np.uint64)).view(np.int64) for t in texts], dtype=object)

    texts = df.select(F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text")).join(few, "row_key")
    sets = written(texts.select(F.col("root").alias("group"), "id", "weight", "parts", hashes("text").alias("hashes")))
    return links_in_groups(sets, ["hashes"], _near_sets(least), SHINGLES).distinct()


def segments(rows: int, words: int = 5, least: float = 0.8, recall: float = 0.925) -> tuple[int, int, int]:
    """(lanes, bits of a segment, bits that may differ) for a table of ``rows``.

    A segment is so long that about ``GROUP`` random fingerprints share a variant of it, so the work
    grows with the rows; and there are as many segments as let a pair whose sets are similar by
    ``least`` meet with chance ``recall``. At a similarity J, equally large sets differ in a share
    acos(2J / (1 + J)) / pi of their bits.
    """
    bits = min(32, max(16, math.ceil(math.log2(max(1, rows) / GROUP)) + 1))
    p = math.acos(2 * least / (1 + least)) / math.pi
    meets = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    many = math.ceil(math.log(1 - recall) / math.log(1 - meets))
    lanes = -(-many // (64 // bits))
    return lanes, bits, 16 * lanes


def simhash_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, lanes: int = 1, segment_bits: int = 32, max_bits: int = 2, banded: bool = False, least: float | None = None
) -> DataFrame:
    """One row per row of ``df``: id, row_key, f0.. (longs), n (shingles), component_id.

    Texts whose fingerprints link, directly or through others, form a component; its id is the
    smallest id in it (null if all are null). Null, empty and wordless texts have fingerprint zero
    and are linked like any other. Repeated rows are rows of their own in one component. An empty
    table gives an empty table. ``row_key`` is a hash of id and text. With ``least`` texts link only
    if the Jaccard similarity of their sets of shingles is at least that, and there is a hash ``s`` of
    the set.
    """
    if max_bits == 1 and lanes == 1:
        raise ValueError("links at one bit are not transitive through stars; use max_bits 0, 2 or more")
    names = [f"f{i}" for i in range(lanes)]
    prints = fingerprints(F.col(text_col), words, lanes) if least is None else shingle_sets(F.col(text_col), words, lanes)
    same = names if least is None else [*names, "s"]
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row_key"), prints.alias("p"))
    rows = written(rows.select("id", "row_key", "p.*"))
    prints = rows.groupBy(*same).agg(F.min("id").alias("low"), F.min("n").alias("n"))
    key = F.col("s") if least is not None else F.col("f0") if lanes == 1 else F.xxhash64(*names)
    prints = written(prints.withColumn("id", key))
    roots = components(simhash_links(prints.select("id", "n", *names), lanes, segment_bits, max_bits, banded))
    if least is not None:
        roots = components(similar_links(df, id_col, text_col, rows, written(roots), words, least))
    rooted = prints.join(roots, prints["id"] == roots["node"], "left").select(*same, "low", F.coalesce("root", "id").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    if least is not None:
        lows = lows.withColumn("component_root", F.col("root"))
    named = written(rooted.join(lows, "root").select(*same, "component_id", *([] if least is None else ["component_root"])))
    return rows.join(named, same).select(F.col("id").alias(id_col), "row_key", *same, "n", "component_id", *([] if least is None else ["component_root"]))


def one_of_each(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, plan: tuple[int, int, int] | None = None
) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component one row stays, with all columns.

    By default five-word shingles: texts link if their sets of shingles have a Jaccard similarity of
    at least 0.8. Candidates are found by fingerprints cut as ``segments`` says for the number of rows
    (or as ``plan`` does). The row with the smallest id stays (null ids last, then the smallest row
    key); of repeated rows one. Null, empty and wordless texts are one group, of which one row stays.
    An empty table stays empty; other columns, whatever their names, are kept.
    """
    lanes, segment_bits, max_bits = plan or segments(df.count(), words, least)
    banded = True
    groups = simhash_groups(df, id_col, text_col, words, lanes, segment_bits, max_bits, banded, least)
    first = groups.select(F.col("component_root").alias("whole"), F.col(id_col).alias("id"), "row_key")
    kept = first.groupBy("whole").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key")).alias("first"))
    key, nth = free_name(df, "row_key"), free_name(df, "row_nth")
    kept = kept.select(F.col("first.row_key").alias(key))
    rows = df.withColumn(key, F.xxhash64(id_col, text_col)).join(kept, key)
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key))).where(F.col(nth) == 1)
    return rows.select(*[F.col(f"`{c}`") for c in df.columns])
