"""The language filter against exact sets of n-grams, and odd tables."""

import collections
import zlib

import public_tokenizers
import pytest

from tidemark.llm import langid, token_count

DATA = "/root/testdata/sf0.001"


def grams(text):
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    return [s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " "]


def test_predictions_equal_those_of_exact_sets(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    texts, held = collections.Counter(), collections.defaultdict(collections.Counter)
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            texts[r["lang"]] += 1
            held[r["lang"]].update(set(grams(r["text"])))
    sets = {k: {g for g, n in own.items() if n >= max(1, texts[k] * langid.SHARE)} for k, own in held.items()}
    got = {r["doc_id"]: r for r in langid.with_language(docs).collect()}
    for r in rows:
        own = grams(r["text"] or "")
        counts = {k: sum(g in s for g in own) for k, s in sets.items()}
        p = got[r["doc_id"]]
        if not own:
            assert (p["lang_pred"], p["score"]) == ("und", 0.0)
        else:
            assert counts[p["lang_pred"]] == max(counts.values()) and p["score"] == pytest.approx(counts[p["lang_pred"]] / len(own), abs=0.01)


def test_labels_that_are_no_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 5)
    df = spark.createDataFrame([(k, "some text", f"label {k}") for k in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="labels"):
        langid.with_language(df)


def test_a_long_text_is_counted_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(1, "the quick brown fox " * 50, "en"), (3, "der schnelle braune fuchs " * 50, "de"), (2, "the quick brown fox " * 400, None)], "doc_id long, text string, lang string")
    whole = langid.with_language(df).collect()
    monkeypatch.setattr(langid, "PART", 64)
    assert whole == langid.with_language(df).collect() and whole[2]["lang_pred"] == "en"


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "the text", "en", "x", 1), (3, None, None, None, None), (3, None, None, None, None)], "doc_id long, text string, lang string, SCORE string, N_Tokens int")
    got = langid.with_language(df)
    assert len(got.columns) == 7 and got.count() == 3
    counts = token_count.with_token_counts(df, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert [r["n_tokens"] for r in counts] == [2, 0, 0]


def test_other_vocabulary_files_are_refused(tmp_path):
    import json

    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"byte_fallback": True}}):
        path = tmp_path / "x.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError, match="unsupported"):
            token_count.WordPairCounter(str(path))
