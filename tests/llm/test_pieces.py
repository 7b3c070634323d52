"""Sampling over the piece lattice: enumerated lattices, long texts, and draws that no grouping changes."""

import collections
import math
import random

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORDS = ["a", "the", "there", "ing", "été", "ß", "of.", "x1", "12", "漢", "a\nb", "no", "and,", "Ré,", "to.\nN", "日本", "##", "\x00", "😀a", "ble"]


@pytest.fixture(scope="module")
def lattice():
    return pieces.PieceLattice(PATH)


def enumerated(lattice, text):
    """Every segmentation of a text (with its leading space) with its probability, by trying all pieces."""
    weight, name = dict(zip(lattice.numbers.tolist(), lattice.weights.tolist())), {}
    for i in lattice.numbers.tolist():
        name[lattice.raw[i].decode()] = i
    whole, out = " " + text, {}

    def go(at, ids, total):
        if at == len(whole):
            out[tuple(ids)] = math.exp(total)
            return
        for end in range(at + 1, min(len(whole), at + lattice.longest) + 1):
            i = name.get(whole[at:end])
            if i is not None:
                go(end, [*ids, i], total + weight[i])
            elif end == at + 1:
                go(end, ids + [lattice.bytes[b] for b in whole[at].encode()], total + lattice.lowest)

    go(0, [], 0.0)
    norm = sum(out.values())
    return {k: v / norm for k, v in out.items()}


def close(got, want, n):
    assert set(got) <= set(want)  # nothing outside the lattice
    for ids, p in want.items():  # and everything in it, as often as it should be drawn
        assert abs(got[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 2 / n, (ids, p)


def test_draws_follow_the_whole_lattice(lattice):
    n = 20_000
    seeds = np.arange(n, dtype=np.uint64) * np.uint64(7919)
    for word in WORDS:
        close(collections.Counter(tuple(i.tolist()) for i in lattice.sample([word] * n, seeds)), enumerated(lattice, word), n)


def test_long_parts_follow_the_lattice_too(lattice, monkeypatch):
    monkeypatch.setattr(pieces, "LONG", 2)
    monkeypatch.setattr(pieces, "BLOCK", 3)
    n = 1_200
    for word in ("there", "to.\nN", "été漢"):
        drawn = [lattice.sample([word], np.array([k * 104_729], np.uint64))[0] for k in range(n)]
        close(collections.Counter(tuple(i.tolist()) for i in drawn), enumerated(lattice, word), n)


def test_draws_do_not_depend_on_groups(lattice, monkeypatch):
    rng = random.Random(7)
    texts = [" " * rng.randint(0, 2) + "".join(rng.choice(["the ", "a", "ing ", "x" * 90, "é", "漢字", "\n", "  ", "😀"]) for _ in range(rng.randint(0, 300))) for _ in range(40)]
    seeds = np.arange(len(texts), dtype=np.uint64)
    whole = lattice.sample(texts, seeds)
    for k, (ids, text) in enumerate(zip(whole, texts)):
        assert lattice.decodes_to(ids, text) and lattice.decode(ids.tolist()) == text
        assert (lattice.sample([text], seeds[k : k + 1])[0] == ids).all()
    for group, part in ((50, 20), (1000, 100)):
        monkeypatch.setattr(pieces, "GROUP", group)
        monkeypatch.setattr(pieces, "SLICE", part)
        assert all((a == b).all() for a, b in zip(lattice.sample(texts, seeds), whole))
    assert not lattice.decodes_to(whole[0], texts[0] + "x") and not lattice.decodes_to(whole[1][:-1], texts[1])


@pytest.mark.parametrize("unit", ["some words of a text, ", "Aa0+/bXq9"])
def test_texts_of_twenty_megabytes(spark, unit):
    rng = random.Random(3)
    text = "".join(rng.choice([unit, unit.upper(), unit[::-1]]) for _ in range(20_000_000 // len(unit)))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None), (None, ""), (2, "short")], "doc_id long, text string")
    got = pieces.round_trip_table(df, PATH).collect()
    assert all(r["lossless"] for r in got) and got[0]["n_bytes"] == len(text) and got[1] == got[4]
    assert [r["n_pieces"] for r in got[2:4]] == [0, 0]


def test_odd_rows_and_no_rows(spark):
    rows = [(1, None, "x", 7), (2, "", "y", None), (2, "", "y", None), (None, "no id ▁ 漢", "z", 1), (4, "a b", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string, N_Pieces long")
    out = pieces.with_pieces(df, PATH)
    got = out.withColumn("back", pieces.decoded(out["piece_ids"], PATH)).collect()
    assert [c.lower() for c in out.columns] == ["doc_id", "text", "piece_ids", "n_pieces"]
    assert [r["back"] for r in got] == [r[1] for r in rows] and [r[3] for r in got][:3] == [0, 0, 0] and got[0]["piece_ids"] is None
    trip = {r["doc_id"]: r for r in pieces.round_trip_table(df, PATH).collect()}
    assert all(trip[r["doc_id"]]["n_pieces"] == r[3] for r in got)
    none = spark.createDataFrame([], df.schema)
    assert pieces.with_pieces(none, PATH).collect() == [] and pieces.round_trip_table(none, PATH).collect() == []
