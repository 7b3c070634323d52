"""Ranked lexical search by hybrid term-at-a-time and document-at-a-time evaluation.

One pass over the documents writes, for each, its length and the frequencies of the terms that any
query asks for; the statistics of the collection are sums over that table. A second pass scores it
without a shuffle: each task lays chunks of its documents out as posting lists, and evaluates every
query on a chunk in two steps. Short lists are summed term at a time into accumulators. These then
stand for one list whose values are known and bounded, beside the long lists, in document order:
blocks of documents whose bounds cannot reach the k-th best score so far are skipped, and in the
others a document leaves as soon as its sum and the bounds of the lists still to come cannot reach
it. A task's best scores stay from chunk to chunk, so later chunks skip more. Only the k best
documents of each query and task are shuffled.

Queries are a stated set. They are worked in blocks of bounded text, one pass over the documents for
each, and a block's terms and weights go along with the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import written

#: Characters of a block of queries: what is collected of the query set at once.
QUERY_CHARS = 1 << 23
#: Documents and postings of a chunk; documents of a block, which is skipped or read as a whole.
CHUNK_DOCS, CHUNK_POSTINGS, BLOCK_DOCS = 1 << 14, 1 << 21, 128
#: A list is short if it holds at most this share of a chunk's documents.
SHORT = 1 / 16
#: Blocks that are read at once.
WAVE = 32
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20

_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_FOLD = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))


def terms(text: str | None) -> Counter:
    """Terms of ``text`` with their frequencies: runs of ASCII letters, digits and all characters past ASCII, A-Z lower-cased."""
    found: Counter = Counter()
    if text:
        data = text.encode("utf-8", "surrogatepass").translate(_FOLD)
        at = 0
        while at < len(data):
            end = data.find(b" ", at + PIECE)
            end = len(data) if end < 0 else end
            found.update(data[at:end].split(b" "))
            at = end
        del found[b""]
    return found


@dataclass
class Queries:
    """A block of queries: ids, and per query the vocabulary numbers and repeats of its terms."""

    ids: list
    vocabulary: dict[bytes, int]
    numbers: list[np.ndarray]
    repeats: list[np.ndarray]

    @classmethod
    def of(cls, rows: list) -> Queries:
        vocabulary: dict[bytes, int] = {}
        numbers, repeats = [], []
        for _, text in rows:
            own = sorted(terms(text).items())
            numbers.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t, _ in own], np.int64))
            repeats.append(np.array([n for _, n in own], np.int64))
        return cls([r[0] for r in rows], vocabulary, numbers, repeats)


def _frequencies(docs: DataFrame, id_type: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs (of the vocabulary) of every document with a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n, numbers, tfs = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = terms(text)
                if own:
                    known = [(vocabulary[t], f) for t, f in own.items() if t in vocabulary]
                    at.append(i)
                    n.append(own.total())
                    numbers.append([t for t, _ in known])
                    tfs.append([f for _, f in known])
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(numbers, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(count, f"doc_id {id_type}, n long, terms array<int>, tfs array<long>")


class _Chunk:
    """Posting lists of a chunk of documents in order of their ids, with the score each posting gives."""

    def __init__(self, n: np.ndarray, lengths: np.ndarray, numbers: np.ndarray, tfs: np.ndarray, weights: np.ndarray, all_docs: int, all_terms: int):
        self.docs = len(n)
        if 75 * int(n.max()) * all_docs < 1 << 63:
            share = 75 * n * all_docs // all_terms
        else:  # beyond 64 bits on the way
            share = np.array([75 * int(x) * all_docs // all_terms for x in n], np.int64)
        doc = np.repeat(np.arange(self.docs), lengths)
        score = weights[numbers] * (1_000_000_000 * tfs // (1000 * tfs + 8 * (25 + share)[doc]))
        order = np.argsort(numbers, kind="stable")
        numbers, self.doc, self.score = numbers[order], doc[order], score[order]
        self.terms, starts = np.unique(numbers, return_index=True)
        self.starts = np.append(starts, len(numbers))
        self.blocks = -(-self.docs // BLOCK_DOCS)
        self.highest: dict[int, np.ndarray] = {}

    def lists(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms have a list here, and where."""
        at = np.minimum(np.searchsorted(self.terms, numbers), len(self.terms) - 1)
        have = np.flatnonzero(self.terms[at] == numbers)
        return have, at[have]

    def postings(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[at], self.starts[at + 1])
        return self.doc[part], self.score[part]

    def bounds(self, at: int) -> np.ndarray:
        """Highest score of the list in each block of documents."""
        if at not in self.highest:
            doc, score = self.postings(at)
            high = np.zeros(self.blocks, np.int64)
            np.maximum.at(high, doc // BLOCK_DOCS, score)
            self.highest[at] = high
        return self.highest[at]


def _best(chunk: _Chunk, numbers: np.ndarray, repeats: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) that hold the chunk's ``k`` best documents of a query, as far as they reach ``floor``."""
    have, at = chunk.lists(numbers)
    repeats, sizes = repeats[have], chunk.starts[at + 1] - chunk.starts[at]
    short = sizes <= max(1, chunk.docs * SHORT)
    sums = np.zeros(chunk.blocks * BLOCK_DOCS, np.int64)
    for i in np.flatnonzero(short):  # term at a time; a list names a document once
        doc, score = chunk.postings(at[i])
        sums[doc] += score * repeats[i]
    if len(sums) > k:
        floor = max(floor, int(np.partition(sums, -k)[-k]))  # sums so far are scores at least
    floor = max(floor, 1)
    per_block = sums.reshape(chunk.blocks, BLOCK_DOCS)
    long = np.flatnonzero(~short)
    limits = np.stack([chunk.bounds(at[i]) * repeats[i] for i in long]) if len(long) else np.zeros((0, chunk.blocks), np.int64)
    order = np.argsort(-limits.max(axis=1), kind="stable") if len(long) else long
    long, limits = long[order], limits[order]
    ahead = np.vstack([np.cumsum(limits[::-1], axis=0)[::-1], np.zeros((1, chunk.blocks), np.int64)])  # of list i and those after it
    reach = per_block.max(axis=1) + ahead[0]
    found, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    promising = np.argsort(-reach, kind="stable")
    first = max(1, -(-k // BLOCK_DOCS))
    waves = [promising[:first], *np.array_split(np.sort(promising[first:]), max(1, -(-len(promising) // WAVE)))]
    for wave in waves:
        wave = wave[reach[wave] >= floor]  # the other blocks are skipped
        if not len(wave):
            continue
        doc = (wave[:, None] * BLOCK_DOCS + np.arange(BLOCK_DOCS)).ravel()
        score = sums[doc]
        for i in range(len(long) + 1):
            stay = score + ahead[i][doc // BLOCK_DOCS] >= floor
            doc, score = doc[stay], score[stay]
            if i == len(long) or not len(doc):
                break
            listed, value = chunk.postings(at[long[i]])
            there = np.minimum(np.searchsorted(listed, doc), len(listed) - 1)
            score = score + np.where(listed[there] == doc, value[there], 0) * repeats[long[i]]
        found.append(doc)
        scores.append(score)
        so_far = np.concatenate(scores)
        if len(so_far) >= k:
            floor = max(floor, int(np.partition(so_far, -k)[-k]))
    return np.concatenate(found), np.concatenate(scores)


def _searched(frequencies: DataFrame, queries: Queries, weights: np.ndarray, all_docs: int, all_terms: int, k: int, item_type: str, id_type: str) -> DataFrame:
    """item_no, doc_id and score: the ``k`` best documents of every query among those of each task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[pa.Table | None] = [None] * len(queries.ids)
        floors = [0] * len(queries.ids)

        def work(table: pa.Table) -> None:
            table = table.take(pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending")]))  # nulls come last
            column = lambda c: table[c].combine_chunks()
            numbers = column("terms").flatten().to_numpy().astype(np.int64)
            if not len(numbers):
                return
            lengths = pa.compute.list_value_length(column("terms")).to_numpy().astype(np.int64)
            chunk = _Chunk(column("n").to_numpy(), lengths, numbers, column("tfs").flatten().to_numpy(), weights, all_docs, all_terms)
            for q in range(len(queries.ids)):
                doc, score = _best(chunk, queries.numbers[q], queries.repeats[q], k, floors[q])
                if len(doc):
                    own = pa.table({"doc_id": table["doc_id"].take(pa.array(doc)), "score": pa.array(score)})
                    own = own if best[q] is None else pa.concat_tables([best[q], own])
                    own = own.take(pa.compute.sort_indices(own, sort_keys=[("score", "descending"), ("doc_id", "ascending")])[:k])
                    best[q] = own.combine_chunks()
                    if own.num_rows == k:
                        floors[q] = own["score"][k - 1].as_py()

        held, docs, postings = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                docs += part.num_rows
                postings += len(part.column("terms").flatten())
                if docs >= CHUNK_DOCS or postings >= CHUNK_POSTINGS:
                    work(pa.Table.from_batches(held))
                    held, docs, postings = [], 0, 0
        if docs:
            work(pa.Table.from_batches(held))
        for q, own in enumerate(best):
            if own is not None:
                yield from own.add_column(0, "item_no", pa.array([q] * own.num_rows, pa.int32())).to_batches()

    return frequencies.mapInArrow(search, f"item_no int, doc_id {id_type}, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", query_chars: int = QUERY_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each query, equal scores by ascending id.

    Scores are integers: a term's weight floor(1000 ln((2N+2)/(2df+1))) times a saturated frequency
    that falls with the document's length, summed over the query's terms, repeats included. Documents
    with null, empty or termless text take no part, nor in the statistics; a query without terms has
    no result. Null ids are ids that come last. Repeated documents are ranked each; repeated queries
    (equal id and text) count once, and texts that share an id are ranked apart. Empty tables give an
    empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    schema = f"item_id {items.schema[item_col].dataType.simpleString()}, rank int, doc_id {docs.schema[id_col].dataType.simpleString()}, score long"
    item_type, id_type = items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    items = items.select(F.col(item_col).alias("item_id"), F.col(query_col).alias("text")).where("text is not null").distinct()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // query_chars)
    parts = []
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        queries = Queries.of(own.collect())  # a block of the query set, of bounded size
        if not queries.vocabulary:
            continue
        frequencies = written(_frequencies(rows, id_type, queries.vocabulary))
        all_docs, all_terms = frequencies.agg(F.count("*"), F.sum("n")).first()
        if not all_docs:
            continue
        held = np.zeros(len(queries.vocabulary), np.int64)
        for t, df in frequencies.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's vocabulary
            held[t] = df
        weights = np.array([math.floor(1000 * math.log((2 * all_docs + 2) / (2 * int(df) + 1))) for df in held], np.int64)
        found = _searched(frequencies, queries, weights, all_docs, all_terms, k, item_type, id_type)
        order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, q) for i, q in enumerate(queries.ids)], f"item_no int, item_id {item_type}")
        parts.append(found.join(names, "item_no").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
