"""The registered queries on the smallest tables: columns, types, rows and laws of their results."""

import collections
import hashlib
import re
import zlib

import duckdb
import pytest

from tidemark.llm import queries, simhash

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_jump_sharding": ("documents", "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"),
    "op2_heap_pair_counts": ("documents", "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"),
    "op3_entropy_mix": ("documents", "doc_id bigint, size bigint, source_size bigint, target double, taken bigint"),
    "op4_simhash_variants": ("documents", "doc_id bigint, fingerprint string, component_id bigint"),
    "op5_avi_frames": ("documents", "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"),
    "op6_va_file_search": (None, "query_id bigint, rank int, vec_id bigint, score bigint"),
    "op7_piece_sampling": ("documents", "doc_id bigint"),
    "op8_wrapper_text": ("pages", "page_id bigint, url string, text string, n_chars bigint"),
    "op9_bitmask_language": ("documents", "doc_id bigint, held_out boolean, lang_pred string, score double"),
    "op10_pii_spans": ("documents", "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"),
    "op11_double_array_trie": (None, "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"),
    "op12_hyperplane_neighbours": ("embeddings", "vec_id bigint, n_links bigint, component_id bigint, kept boolean"),
    "op13_hybrid_ranking": (None, "item_id bigint, rank int, doc_id bigint, score bigint"),
}


@pytest.fixture(scope="module")
def results(spark):
    held = {}

    def of(name):
        if name not in held:
            df = queries.queries()[name](spark, DATA)
            held[name] = dict(df.dtypes), [r.asDict() for r in df.collect()]
        return held[name]

    return of


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_every_query_is_here():
    assert set(queries.queries()) == set(COLUMNS) and set(queries.oracle_sql()) <= set(COLUMNS)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_types_and_rows(spark, results, name):
    table, columns = COLUMNS[name]
    types, rows = results(name)
    for column in columns.split(", "):
        c, kind = column.split()
        assert types[c] == kind, (name, c, types[c])
    if table:
        assert len(rows) == spark.read.parquet(f"{DATA}/{table}.parquet").count()


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_results_are_those_of_the_sql(results, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    names = want.columns
    _, rows = results(name)
    assert sorted(names) == sorted(rows[0]) and sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in rows)


def test_laws_of_shards_tokens_and_mixes(results, texts):
    slots = collections.defaultdict(list)
    for r in results("op1_jump_sharding")[1]:
        assert 0 <= r["shard"] < 16 and r["law"] == "key" and r["grown_shard"] in (r["shard"], 16)
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for r in results("op2_heap_pair_counts")[1]:
        assert r["n_bytes"] == len(texts[r["doc_id"]].encode()) and r["over_limit"] == (r["n_tokens"] > 2048) and (r["n_tokens"] > 0) == bool(texts[r["doc_id"]])
    mix = results("op3_entropy_mix")[1]
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])) for r in mix)
    assert sum(r["taken"] for r in mix) == pytest.approx(sum(r["size"] for r in mix), rel=0.05)


def test_laws_of_groups_and_media(results, texts):
    groups = {r["doc_id"]: r for r in results("op4_simhash_variants")[1]}
    for d, r in groups.items():
        assert re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) and r["component_id"] <= d and groups[r["component_id"]]["component_id"] == r["component_id"]
        assert int(r["fingerprint"], 16) == simhash.fingerprint(simhash.shingle_hashes(texts[d], 3, 42))
    for r in results("op5_avi_frames")[1]:
        data = texts[r["doc_id"]].encode()
        data += bytes(-len(data) % 64 or (0 if data else 64))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])) and r["media_bytes"] >= len(data)


def test_laws_of_texts(results, texts):
    for r in results("op9_bitmask_language")[1]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    for r in results("op8_wrapper_text")[1]:
        assert r["n_chars"] == len(r["text"]) and "<p" not in r["text"]
    for r in results("op10_pii_spans")[1]:
        spans = [s.split(":") for s in r["spans"].split(",")] if r["spans"] else []
        base = [":".join(s) for s in spans if s[0] in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and r["n_email"] == sum(s[0] == "email" for s in spans)
        assert all("@" in texts[r["doc_id"]][int(a) : int(b)] for k, a, b in spans if k == "email")


def test_pipeline_stage_by_stage(spark):
    """What each stage keeps and changes, against what it was given."""
    import corpus_pipeline

    from .test_llm import brute_roots, shingle_set

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages, given = dict(corpus_pipeline.STAGES), {r["doc_id"]: r for r in docs.collect()}
    now = {}
    for name, stage in corpus_pipeline.STAGES:
        df = spark.createDataFrame(stage(spark, docs, DATA).collect(), None if name == "SentencePiece" else docs.schema)
        rows = df.collect()
        if name == "language ID":
            assert all(r["text"] == given[r["doc_id"]]["text"] and r["lang"] for r in rows) and len(rows) > 0.8 * len(given)
        if name == "SimHash near-dedup":
            names = sorted(now)
            _, root = brute_roots([shingle_set(now[d][0]["text"]) for d in names])
            firsts = {names[r] for r in root}
            kept = {r["doc_id"] for r in rows}
            assert firsts <= kept and len(kept - firsts) <= 0.1 * (len(names) - len(firsts)) + 1
        if name == "PII":
            assert {r["doc_id"] for r in rows} == set(now) and all(r["n_chars"] == len(r["text"]) for r in rows)
            assert not any(re.search(r"[\w.+-]+@[\w-]+\.\w", r["text"]) for r in rows) and any("[EMAIL]" in r["text"] for r in rows)
        if name == "source mixing":
            copies = collections.Counter(r["doc_id"] for r in rows)
            assert max(copies.values()) <= 3 and set(copies) <= set(now) and all(r["text"] == now[r["doc_id"]][0]["text"] for r in rows)
        if name == "SentencePiece":
            assert collections.Counter(r["doc_id"] for r in rows) == {d: len(x) for d, x in now.items()} and all(len(r["piece_ids"]) == r["n_pieces"] for r in rows)
        now = collections.defaultdict(list)
        for r in rows:
            now[r["doc_id"]].append(r)
        docs = df
    assert len(stages) == 5
