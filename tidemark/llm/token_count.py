"""Token counts of a word-level byte-pair vocabulary, without making token ids.

A word's symbols form a doubly linked list; a heap holds the ranks of adjacent pairs. The lowest
rank is popped and merged until no pair of the list has a rank. The number of tokens is the number
of first symbols minus the number of merges. Words repeat, so each Python worker keeps the counts
of the words it has met in a table of bounded size.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A worker forgets its word table when it holds this many words; longer words are not kept.
KEPT_WORDS, KEPT_LENGTH = 400_000, 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the other bytes take the code points from 256 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _check(spec: dict) -> None:
    """Refuses files that ask for more than this counter does, instead of counting them wrongly."""
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
    if steps != [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]:
        raise ValueError("unsupported normalizer")
    pre = spec["pre_tokenizer"].get("pretokenizers", [])
    level = pre[1] if len(pre) == 2 else {}
    if [p["type"] for p in pre] != ["Split", "ByteLevel"] or pre[0]["behavior"] != "Removed" or not pre[0]["invert"] or level.get("add_prefix_space") or level.get("use_regex"):
        raise ValueError("unsupported pre-tokenizer")
    model = spec["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
        raise ValueError("unsupported model")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("unsupported added token")


class WordPairCounter:
    """Counts the tokens of texts for a ``tokenizers`` file with a word-level byte-pair model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        _check(spec)
        suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        symbols = byte_symbols()
        self.inner = [self.ids.get(s) for s in symbols]
        self.final = [self.ids.get(s + suffix) for s in symbols]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        # the file's \s is Unicode white space
        self.find = regex.compile(split.replace(r"[^\s", r"[^\p{White_Space}")).findall
        self.find_ascii = re.compile(split.replace(r"\p{L}", "a-z").replace(r"[\p{N}]", "[0-9]").replace(r"\p{N}", "0-9"), re.ASCII).findall
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        firsts = {t[0] for t in special}
        self.first = firsts.pop() if len(firsts) == 1 else None  # a character that every special string starts with
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.kept = _Kept(self.word)

    def word(self, word: str) -> int:
        """Tokens of one word."""
        raw = word.encode("utf-8")
        ids = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        ids = [i for i in ids if i is not None]
        n = len(ids)
        if n < 2:
            return n
        after, before, merges = [*range(1, n), -1], [-1, *range(n - 1)], self.merges
        heap = [(*found, i) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        merged = 0
        while heap:
            rank, new, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or merges.get((ids[i], ids[j])) != (rank, new):
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            merged += 1
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], new))):
                heapq.heappush(heap, (*found, h))
            if (k := after[i]) >= 0 and (found := merges.get((new, ids[k]))):
                heapq.heappush(heap, (*found, i))
        return n - merged

    def _plain(self, text: str) -> int:
        if text.isascii():
            found = self.find_ascii(text.lower())
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() would treat a final sigma apart
            found = self.find(text.lower())
        return sum(map(self.kept.__getitem__, found))

    def count(self, text: str | None) -> int:
        """Tokens of ``text``; a special token's string in it is one token, null counts as empty."""
        if not text:
            return 0
        if self.special is None or (self.first is not None and self.first not in text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


class _Kept(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> int:
        n = self.make(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> WordPairCounter:
    return WordPairCounter(path)


def token_count(text: Column, vocabulary: str) -> Column:
    """Number of tokens of a string column; ``vocabulary`` is the path of a ``tokenizers`` JSON file."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = counter(vocabulary).count
        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype="int64")

    return count(text)


def with_token_counts(df: DataFrame, vocabulary: str, text_col: str = "text", over: int = 2048) -> DataFrame:
    """Append n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``over``).

    No row is moved: the count is a column of the scan. Null and empty text count 0 tokens and 0
    bytes; repeated rows count alike; an empty table stays empty; columns of ``df`` that have the
    new names are replaced.
    """
    return df.withColumns({"n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"), "n_tokens": token_count(F.col(text_col), vocabulary)}).withColumn("over_limit", F.col("n_tokens") > over)
