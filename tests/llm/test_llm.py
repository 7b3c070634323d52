"""The training-data operators against brute force, on odd rows and on the given tables."""

import collections
import hashlib
import html
import os
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import graph, langid, media, mixing, pieces, pii, sharding, simhash, token_count, vafile, wrappers

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, run string"
LONG = "word " * 20_000
ODD = [
    (1, "The same text here today.", "en", "a", 1, 0.5, "x"), (2, "The same text here today.", "en", "a", 1, None, "y"), (2, "The same text here today.", "en", "a", 1, None, "y"),
    (3, None, None, None, None, None, None), (4, "", "en", "b", 0, 0.1, "x"), (5, "   \n\t ", "fr", "b", 3, 0.1, "x"), (6, LONG, "en", "a", 9, 0.1, "x"), (None, "no id", "de", "c", 5, 0.1, "x"),
    (7, "x" * 30_000, None, "c", 1, 0.1, "x"), (8, "mail a.b@c.de, 10.0.0.1 and 4111 1111 1111 1111 or +1 (884) 555-7752", "en", "c", 1, 0.1, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{DATA}/documents.parquet")


def jump(key, n):
    b, j, key = -1, 0, key & (2**64 - 1)
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_sharding(odd, none, docs):
    for df in (odd, docs):
        got = sharding.shard_table(df, 16).collect()
        assert len(got) == df.count()
        by = collections.defaultdict(list)
        for r in got:
            assert r["shard"] == jump(r["doc_id"] or 0, 16) and r["grown_shard"] == jump(r["doc_id"] or 0, 17)
            by[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
    crc = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.shard_table(odd, 16).collect()}
    assert crc[3] == (1, 0) and crc[1] == (26, zlib.crc32(b"The same text here today."))
    assert sharding.shard_table(none, 16).count() == 0
    spark = odd.sparkSession
    hot = spark.createDataFrame([("k", "same", 1)] * 3000 + [(None, f"t{k}", 2) for k in range(200)] + [(f"id {k}", None, 3) for k in range(50)], "doc_id string, text string, SIZE int")
    rows = sharding.shard_table(hot, 5).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == 3250 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {r["shard"] for r in rows if r["doc_id"] is None} == {jump(0, 5)} and len({r["shard"] for r in rows if r["doc_id"] == "k"}) == 1


def test_a_large_group_is_laid_open_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 7)
    hot = spark.createDataFrame([(5, "same")] * 500 + [(k, "x") for k in range(40)], "doc_id long, text string")
    rows = sharding.shard_table(hot, 3).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == 540 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1


def test_shards_of_negative_and_large_keys(spark):
    keys = [-(2**63), -1, 0, 1, 2**63 - 1, *(random.Random(1).randint(-(2**63), 2**63 - 1) for _ in range(200))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 7, 100):
        assert all(r["shard"] == jump(r["k"], n) for r in sharding.jump_shards(df, "k", n).collect())


def test_token_counts(odd, none, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for df in (odd.limit(8), docs):
        for r in token_count.with_token_counts(df, path).collect():
            assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
            assert r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 2048)
    mine, rng = token_count.counter(path), random.Random(3)
    parts = [*"aAsSΣσςİı\t\n\x85 éÉßẞ漢12²½_-—!<|>😀ﬁ한", "<|endoftext|>", "'ll", "the", " "]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert mine.count(t) == len(library.encode(t, add_special_tokens=False).ids), t
    assert token_count.with_token_counts(none, path).count() == 0


def test_mixing(odd, none, docs):
    for df in (odd, docs):
        rows = mixing.mix_table(df).collect()
        assert len(rows) == df.count()
        source = {r["doc_id"]: r["source"] for r in df.collect()}
        text = {r["doc_id"]: r["text"] for r in df.collect()}
        taken, target, size = collections.Counter(), {}, collections.Counter()
        for r in rows:
            s = source[r["doc_id"]]
            assert r["size"] == len(WORD.findall(text[r["doc_id"]] or "")) and 0 <= r["taken"] <= 3 * r["size"]
            taken[s] += r["taken"]
            size[s] += r["size"]
            target[s] = r["target"]
        names = sorted(target, key=lambda s: (s is None, s))
        share, open_, left = {}, dict(zip(names, [1, 2, 3] * len(names))), sum(size.values())
        while open_:  # the rule, step by step
            level = left / sum(open_.values())
            full = [s for s in open_ if 3 * size[s] < level * open_[s] - 1e-9]
            if not full:
                share |= {s: level * w for s, w in open_.items()}
                break
            for s in full:
                share[s] = 3 * size[s]
                left -= share[s]
                del open_[s]
        assert all(target[s] == pytest.approx(share[s]) for s in names)
        if df is docs:
            assert all(abs(taken[s] / target[s] - 1) < 0.02 for s in names)
            again = {r["doc_id"]: r["taken"] for r in mixing.mix_table(df.repartition(3)).collect()}
            assert again == {r["doc_id"]: r["taken"] for r in rows}
            copies = {r["doc_id"]: r["copies"] for r in rows if r["copies"]}
            assert {r["doc_id"]: r["count"] for r in mixing.mixed(df).groupBy("doc_id").count().collect()} == copies
    assert mixing.mix_table(none).count() == 0 and mixing.mixed(odd).columns == odd.columns


def brute_print(text, n=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    runs = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(odd, none, docs):
    for df in (odd, docs):
        got = simhash.simhash_groups(df).collect()
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        assert len(got) == df.count()
        ids, prints = [r["doc_id"] for r in got], [r["f0"] & (2**64 - 1) for r in got]
        assert all(brute_print(texts[i]) == p for i, p in list(zip(ids, prints))[:150])
        p, parent = np.array(prints, np.uint64), list(range(len(ids)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(ids)):
            for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= 2):
                a, b = find(i), find(int(j))
                parent[max(a, b)] = min(a, b)
        low = {}
        for i, x in enumerate(ids):
            if x is not None:
                low[find(i)] = min(low.get(find(i), x), x)
        assert [r["component_id"] for r in got] == [low.get(find(i)) for i in range(len(ids))]
    assert simhash.simhash_groups(none).count() == 0


def test_large_groups_of_near_prints(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 3)]
    prints = {b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (150, 2))}
    df = spark.createDataFrame([(p, p, 9) for p in prints], "id long, f0 long, n long")
    roots = {r["node"]: r["root"] for r in graph.components(simhash.simhash_links(df, 1, 32, 2)).collect()}
    p, parent = sorted(prints), {x: x for x in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(p):
        for b in p[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert all(roots.get(x, x) == find(x) for x in p)


def test_blocks_find_links_of_wide_prints(spark):
    rng = np.random.default_rng(2)
    b0, b1 = (int(x) for x in rng.integers(0, 2**63, 2))
    rows = [(i, b0 ^ (1 << int(rng.integers(0, 63))), b1 ^ (1 << int(rng.integers(0, 63))), 100) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, f0 long, f1 long, n long").dropDuplicates(["f0", "f1"])
    got = graph.components(simhash.simhash_links(df, 2, 16, 22, True))
    assert got.select("root").distinct().count() == 1 and got.count() == df.count()


def test_lengths_at_the_ratio_of_copies_meet(spark):
    rng, rows = np.random.default_rng(3), []
    for k, n in enumerate(range(4, 604, 4)):  # the longer copy has 1.25 times as many shingles, or 1.18 times
        f0, f1 = (int(x) for x in rng.integers(0, 2**63, 2))
        rows += [(3 * k, f0, f1, n), (3 * k + 1, f0 ^ 0b11, f1 ^ 0b10100, n * 5 // 4), (3 * k + 2, f0 ^ 0b11, f1 ^ 0b1000100, int(n * 1.18))]
    got = {r["node"]: r["root"] for r in graph.components(simhash.simhash_links(spark.createDataFrame(rows, "id long, f0 long, f1 long, n long"), 2, 16, 22, True)).collect()}
    assert got == {r[0]: r[0] - r[0] % 3 for r in rows}


def test_one_of_each(odd, docs):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3, 6, 7, 8]  # blank texts are one group
    left = simhash.one_of_each(docs).collect()
    texts = [r["text"] for r in left]
    assert len(texts) == len(set(texts)) and {r["text"] for r in docs.collect()} >= set(texts) and len(texts) > 850


def shingle_set(text, n=5):
    w = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = WORD.findall(w)
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_roots(sets, least=0.8):
    """Links (i, j) of sets of shingles, and the first member of each one's component."""
    where, parent, links = collections.defaultdict(list), list(range(len(sets))), []

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        common = collections.Counter(j for s in own for j in where[s])
        links += [(j, i) for j, c in common.items() if c >= least * (len(own) + len(sets[j]) - c)]
        for s in own:
            where[s].append(i)
    blank = [i for i, s in enumerate(sets) if not s]
    links += [(blank[0], i) for i in blank[1:]]
    for i, j in links:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("rows", [1_000, 15_000_000, 1_000_000_000])
def test_near_duplicates_against_brute_force(spark, docs, rows):
    """With the segments of tables of any size no link is false and over 0.9 of them are found."""
    plan = simhash.segments(rows)
    rng, made = random.Random(11), []
    for _ in range(300):  # a text, a copy with words added at its end, and one with words changed
        w = [f"w{rng.randrange(50_000)}" for _ in range(rng.randint(80, 600))]
        n, j = len(w) - 4, rng.uniform(0.8, 0.9)
        more = [f"v{rng.randrange(50_000)}" for _ in range(int(n / j - n))]
        changed = list(w)
        for k in rng.sample(range(len(w)), int(len(w) * rng.uniform(0.01, 0.12))):
            changed[k] = "x"
        made += [" ".join(x) for x in (w, w + more, changed)]
    for texts in (made, [r["text"] for r in docs.orderBy("doc_id").collect()]):
        lanes, bits, most = plan
        got = simhash.simhash_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=5, lanes=lanes, segment_bits=bits, max_bits=most, banded=True, least=0.8).collect()
        comp = {r["doc_id"]: r["component_id"] for r in got}
        links, root = brute_roots([shingle_set(t) for t in texts])
        assert len(comp) == len(texts)
        assert all(root[i] == root[c] for i, c in comp.items())  # no false link
        found = sum(comp[i] == comp[j] for i, j in links)
        print(plan, "found", found, "of", len(links))
        assert found >= 0.9 * len(links)


def test_segments_follow_the_rows():
    assert simhash.segments(0) == simhash.segments(500_000) == (2, 16, 32)
    for rows in (10**6, 10**8, 10**10):
        lanes, bits, most = simhash.segments(rows)
        assert rows / 2 ** (bits - 1) <= simhash.GROUP or bits == 32
        assert 64 // bits * lanes >= 8 and most == 16 * lanes


def test_groups_in_parts_lose_no_link(spark):
    """Families in one group far over the limit: mostly one, some others that only a few members join."""
    rng = np.random.default_rng(9)
    prints = [int(x) for x in rng.integers(0, 2**62, 6)]
    rows = []
    for k in range(400):
        family = 0 if k < 300 else 1 + k % 5
        bits = rng.choice(60, 2, replace=False)
        rows.append((1, k, 1, 400 // 16, prints[family] ^ (1 << int(bits[0])) ^ (1 << int(bits[1]))))
    chain = prints[0]
    for k in range(400, 420):  # a chain that leads out of the first family
        chain ^= 7 << (3 * (k - 400))
        rows.append((1, k, 1, 25, chain))
    df = spark.createDataFrame(rows, "group long, id long, weight long, parts int, f0 long")
    got = {r["node"]: r["root"] for r in graph.components(simhash.links_in_groups(df, ["f0"], simhash._near_prints(["f0"], 4), 16)).collect()}
    parent = list(range(420))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(420):
        for j in range(i):
            if (rows[i][4] ^ rows[j][4]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert [got.get(i, i) for i in range(420)] == [find(i) for i in range(420)]


def test_a_variant_longer_than_a_chunk_passes_in_pieces(spark, monkeypatch):
    """Workers read CHUNK from the module, so the search runs here on batches of its own."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    keys = np.sort(np.r_[np.full(900, 5), np.repeat(np.arange(10, 200), 3)])
    f0 = rng.integers(0, 2**62, len(keys))
    monkeypatch.setattr(simhash, "CHUNK", 128)
    held = {}

    class Keyed:
        def select(self, *_):
            return self

        repartition = sortWithinPartitions = select

        def mapInArrow(self, run, schema):
            table = pa.table({"key": keys, "id": np.arange(len(keys)), "f0": f0})
            held["rows"] = pa.Table.from_batches(run(iter(table.to_batches(max_chunksize=50)))).to_pandas()

    simhash._searched(Keyed(), 1, 3)
    rows = held["rows"]
    assert sorted(rows.loc[rows["many"] > 0, "a"]) == list(range(900)) and set(rows.loc[rows["many"] > 0, "key"]) == {5}


def test_large_clusters_link_by_sets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES", 2000)  # several blocks
    rng = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(120):
        w = list(base)
        for at in rng.sample(range(200), 3 if k < 90 else 12):
            w[at] = f"x{k}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links, root = brute_roots([shingle_set(t) for t in texts])
    rows = df.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.col("doc_id").alias("s"), F.lit(196).alias("n"))
    clusters = df.select(F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("root"))
    got = {r["node"]: r["root"] for r in graph.components(simhash.similar_links(df, "doc_id", "text", rows, clusters, 5, 0.8)).collect()}
    assert links and [got.get(i, i) for i in range(120)] == root and len(set(root)) > 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 160))


def test_media_round_trip(odd, none):
    for r in media.media_table(odd).collect():
        raw = (r["text"] or "").encode()
        full = raw + bytes((-len(raw)) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(full))
        assert r["payload_sha256"] == hashlib.sha256(full).hexdigest() and r["tail_crc32"] == zlib.crc32(full[-64:])
    files = [bytes(r[0]) for r in odd.select(media.avi_store(F.col("text"))).collect()]
    assert all(f[:4] == b"RIFF" and int.from_bytes(f[4:8], "little") == len(f) - 8 and {b"hdrl", b"movi", b"idx1"} <= {*media.chunks_of(f)} for f in files)
    clips = media.clip_rows(odd.where("doc_id = 6"), media.avi_store(F.col("text"))).orderBy("clip").collect()
    assert clips[0]["start_ms"] == 0 and all(a["end_ms"] == b["start_ms"] for a, b in zip(clips, clips[1:])) and sum(c["frames"] for c in clips) == -(-100_032 // media.FRAME)
    assert media.media_table(none).count() == 0
    assert media.shot_starts([0.01] * 10 + [0.9] + [0.01] * 5) == [0, 11]


def test_vector_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[100:140] = x[0]  # a class of equal vectors
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(3, [float(v) for v in x[3]]), (900, None), (950, [1.0, None]), (1000, [float("nan")] * 8), (1050, []), (1100, [1.0, 2.0]), (1101, [3.0, 1.0]), (None, [1.0] * 8)]
    got = collections.defaultdict(list)
    for r in vafile.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    v = np.floor(x.astype(np.float64) * 256).astype(np.int64)
    for q in range(0, 400, 50):
        s = v @ v[q]
        assert got[q] == [(int(j), int(s[j])) for j in np.lexsort((np.arange(400), -s)) if j != q][:5]
    assert got[1100] == [(1101, 256 * 256 * 5)] and set(got) == {*range(0, 400, 50), 1100}
    assert vafile.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    huge = [(0, [1e15, -3.0, 0.5]), (1, [1e15, 2.0, 0.0]), (2, [-1e15, 1.0, 0.0]), (3, [1e18, 0.0, 0.0]), (4, [1e15, 3.0, 0.0]), (5, [1e15, 2.5, 0.0]), (6, [0.0, 1.0, 1.0])]
    found = vafile.top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), k=6).orderBy("rank").collect()
    w = {i: [int(np.floor(max(-(2.0**61), min(2.0**61, x * 256.0)))) for x in v] for i, v in huge}
    exact = {i: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(w[0], w[i])))) for i in range(1, 7)}
    assert [(r["vec_id"], r["score"]) for r in found] == sorted(exact.items(), key=lambda x: (-x[1], x[0]))


def test_pieces_lossless_and_reproducible(odd, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lattice, rng = pieces.PieceLattice(path), random.Random(2)
    texts = ["".join(rng.choice([*"abcdeéß漢😀 ▁\n\t ", "the", "▁▁", "<0x0A>", "\x00"]) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["a" * 3000, " " * 3000, "", "▁"]
    ids = lattice.sample(texts, np.arange(len(texts), dtype=np.uint64))
    assert [lattice.decode(i.tolist()) for i in ids] == texts
    for df in (odd, docs.limit(200)):
        assert all(r["lossless"] for r in pieces.round_trip_table(df, path).collect())
    a, b = ({r["doc_id"]: r["ids_hash"] for r in pieces.round_trip_table(d, path).collect()} for d in (docs, docs.repartition(5)))
    assert a == b


def test_pieces_follow_their_weights():
    lattice = pieces.PieceLattice(public_tokenizers.path("piece_bpe_32k.model"))
    n = 40_000
    got = collections.Counter(tuple(i.tolist()) for i in lattice.sample(["there"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919)))
    weight = {int(i): w for i, w in zip(lattice.numbers, lattice.weights)}
    p = {s: np.exp(sum(weight[i] for i in s)) for s in got}
    assert all(abs(got[s] / n - p[s] / sum(p.values())) < 0.01 for s in got)


def test_pages(spark):
    if os.path.isdir(DATA):
        pages = spark.read.parquet(f"{DATA}/pages.parquet")
        got = {r["page_id"]: r["text"] for r in wrappers.with_main_text(pages).collect()}
        for r in pages.collect():
            inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
            blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
            assert got[r["page_id"]] == "\n".join(b for b in blocks if b)
    site = "<html><body><div id='top'><a href=/>Home</a></div><div class='w'><div class='c1'><h2>Title {0}</h2><p>Text {0} of &eacute;t&eacute; &amp; more.</p>{1}</div><div class='sidebar'>side</div></div><div class='comments'>bad</div><div>Footer Inc.</div></body></html>"
    rows = [(k, "http://h.example/a", site.format(k, f"<p>Extra {k}</p>" if k % 2 else ""), "t") for k in range(6)]
    rows += [(10, None, None, "t"), (11, "x", "", "t"), (12, "http://o.example/", "<p>alone<br>b &nbsp; c", "t"), (None, "http://h.example/", "<script>x", "t"), (12, "http://o.example/", "<p>alone<br>b &nbsp; c", "t")]
    got = wrappers.with_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r["page_id"]].append(r["text"])
    assert by[1] == ["Title 1\nText 1 of été & more.\nExtra 1"] and by[2] == ["Title 2\nText 2 of été & more."]
    assert by[10] == [""] and by[11] == [""] and by[12] == ["alone\nb c"] * 2 and by[None] == [""]


def test_language(odd, none, docs):
    got = langid.with_language(docs).collect()
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.98 and all(0 <= r["score"] <= 1 for r in got)
    strange = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.with_language(odd).collect()}
    assert strange[3] == strange[4] == strange[5] == ("und", 0.0)
    assert langid.with_language(none).count() == 0
    assert langid.keep_identified(docs).count() > 0.97 * docs.count() and langid.keep_identified(odd).columns == odd.columns


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_personal_data(spark, odd, none, docs):
    rng = random.Random(5)
    parts = [*"ab1 0.9-@+_%()é😀\n", "4111 1111-1111 1111", "a@b.c", "1.2.3.4", "+1 (884) 555-7752", "007.000255.1.2", "378282246310005"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(600)] + ["1" * 20_000, "a" * 20_000, "1 " * 8_000, "a@" + "b." * 8_000 + "c", "1.2.3.4 " * 1_500]
    for df in (spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string"), docs, odd):
        for r in pii.pii_table(df).collect():
            spans = base_spans(r["text"])
            assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()
            assert [r[f"n_{k}"] for k in KINDS] == [sum(k == s[2] for s in spans) for k in KINDS]
    extra = spark.createDataFrame([("iban DE89370400440532013000 x",), ("DE89370400440532013001",), ("my ssn is 123-45-6789",), ("12 123-45-6789",)], "text string")
    assert [r["spans"] for r in pii.pii_table(extra).collect()] == ["iban:5:27", "", "ssn:10:21", ""]
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(odd).collect()}
    assert clean[8] == "mail [EMAIL], [IP] and [CARD] or [PHONE]" and clean[6] == LONG and clean[3] is None
    assert pii.redacted(none).count() == 0


def test_pipeline(spark, odd, none):
    import corpus_pipeline

    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (docs, odd, none):
        now = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = spark.createDataFrame(stage(spark, now, DATA).collect(), df.schema)
            assert now.columns == df.columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, now, DATA)
        assert {"piece_ids", "n_pieces"} <= {*out.columns} and out.count() == now.count()
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and not any(re.search(r"[a-z0-9]@mail", r["text"]) for r in got.collect())
