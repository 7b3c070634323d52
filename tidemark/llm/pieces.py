"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The pieces that match a text form a lattice over its characters. Forward filtering gives each place
the total weight of the ways that lead to it; backward sampling then draws a segmentation from the
end, each with its probability under the piece weights. Draws are a function of the row key, the
word's place in the row and the step, so a row is always segmented alike, on any executor.

No piece of the model has a space mark behind another character, so the lattice falls apart into
words, and a long word (or a text without spaces) further into parts that no piece spans. A worker
filters the distinct words of a group of texts as a tree of their beginnings, as the weight of a place
follows from what stands before it, one numpy step per level, and samples all their occurrences
together, one numpy step per piece. A part that is still long is filtered place by place in blocks: only the weights before each block are kept, and a block is
filtered again when sampling comes to it. Memory follows neither the longest text nor the longest word.

Lossless: a character without a piece becomes its UTF-8 byte pieces, and so does a literal U+2581,
which the model would else turn into a space.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Stands for a literal U+2581 inside a word; a lone surrogate never occurs in valid text.
_ESCAPED = "\ud800"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Characters of text that are sampled together, and of distinct words that are filtered together.
GROUP, SLICE = 1 << 19, 1 << 17
#: Characters from which a word is cut where no piece spans, and from which a part is filtered place by place.
CUT, LONG = 64, 512
#: Rows of an Arrow batch that are sampled at once.
ROWS = 250
#: Places of a long part that are filtered at once, ids that are decoded at once.
BLOCK, DECODED = 1 << 14, 1 << 17
#: Where a text may be cut: a character before a space.
_BREAK = re.compile("[^ ] ")
_MASK, _TABLE_BITS, _MARK_BITS = (1 << 64) - 1, 21, 20
#: Odd multipliers of the hashes and counters.
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _hashes(piece: str) -> list[int]:
    """Polynomial hashes of a piece's ends, from its last character to the whole piece."""
    out, h = [], 0
    for c in reversed(piece):
        h = (h * int(_STEP) + ord(c)) & _MASK
        out.append(h)
    return out


class _Numbered(dict):
    """Numbers its keys in the order of their first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class PieceLattice:
    """The pieces of a model with their log weights.

    A unigram model has log probabilities. A byte-pair model's scores are only an order; its weights
    follow Zipf's law over that order. ``sharpness`` multiplies the log weights.
    """

    def __init__(self, path: str, sharpness: float = 1.0):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in ids]
        self.bytes = {int(pieces[i][3:5], 16): i for i in ids if model.is_byte(i)}
        if len(self.bytes) < 256:
            raise ValueError("lossless encoding needs byte pieces")
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in plain}
        order = sorted(plain, key=lambda i: (-scores[i], i))
        zipf = min(scores.values()) < -1000  # an order, not log probabilities
        names = [pieces[i] for i in order]
        if any(SPACE in p.lstrip(SPACE) for p in names):
            raise ValueError("a piece spans words")
        self.longest = max(map(len, names))
        self.numbers = np.array(order, np.int32)
        self.weights = sharpness * np.array([-math.log(rank + 2) if zipf else scores[i] for rank, i in enumerate(order)])
        self.lowest = float(self.weights.min())
        # pieces by hash: a first and a second place in two tables; the last entry matches nothing
        self.sizes = np.array([*map(len, names), 0])
        hashes = [_hashes(p) for p in names]
        self.keys = np.array([h[-1] for h in hashes] + [0], np.uint64)
        self.ends = np.zeros(1 << _MARK_BITS, bool)  # where the end of some piece hashes to
        self.ends[np.array([h for own in hashes for h in own], np.uint64) * _SPREAD >> np.uint64(64 - _MARK_BITS)] = True
        self.table, self.second = (np.full(1 << _TABLE_BITS, len(names), np.int32) for _ in range(2))
        for k, key in enumerate(self.keys[:-1].tolist()):
            spread = key * int(_SPREAD) & _MASK
            one, two = spread >> 64 - _TABLE_BITS, (spread << _TABLE_BITS & _MASK) >> 64 - _TABLE_BITS
            if self.table[one] == len(names):
                self.table[one] = k
            elif self.second[two] == len(names):
                self.second[two] = k
            else:
                raise ValueError("the piece table is too small for this model")
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.int32)
        self.raw = [b""] * len(pieces)
        for i in plain:
            self.raw[i] = pieces[i].replace(SPACE, " ").encode("utf-8")
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])

    def _edges(self, char: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All piece matches in a tree of texts: source, target and piece, by target.

        Place 0 is the root; each other place follows ``parent`` by ``char``. A character without a
        piece gets an edge of its own whose piece is -1 - code point.
        """
        sources, targets, found = [], [], []
        at = np.arange(1, len(char), dtype=np.int32)
        back, hashes = at, np.zeros(len(at), np.uint64)
        for length in range(1, self.longest + 1):
            hashes = hashes * _STEP + char[back]
            spread = hashes * _SPREAD
            alive = self.ends[spread >> np.uint64(64 - _MARK_BITS)]
            if length == 1:
                lost, all_at = np.ones(len(char), bool), at
            at, back, hashes, spread = at[alive], parent[back[alive]], hashes[alive], spread[alive]
            hit = self.table[spread >> np.uint64(64 - _TABLE_BITS)]
            hit = np.where(self.keys[hit] == hashes, hit, self.second[(spread << np.uint64(_TABLE_BITS)) >> np.uint64(64 - _TABLE_BITS)])
            good = np.flatnonzero((self.keys[hit] == hashes) & (self.sizes[hit] == length))
            sources.append(back[good])
            targets.append(at[good])
            found.append(hit[good])
            if length == 1:
                lost[at[good]] = False
                none = all_at[lost[1:]]
                sources.append(parent[none])
                targets.append(none)
                found.append(-1 - char[none].astype(np.int32))
            inside = back > 0
            at, back, hashes = at[inside], back[inside], hashes[inside]
        target = np.concatenate(targets)
        order = np.argsort(target, kind="stable")
        return np.concatenate(sources)[order], target[order], np.concatenate(found)[order]

    def _tree(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """The beginnings of words as a tree: character and parent of each place, the place of each word's end, where levels begin."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        code = _codes("".join(words)).astype(np.int64)
        at = np.cumsum(size) - size
        last, alive, place = at + size, np.arange(len(words)), np.zeros(len(words), np.int64)
        chars, parents, levels = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [1]
        while len(alive):
            own, which = np.unique(place[alive] << 21 | code[at[alive]], return_inverse=True)
            chars.append(own & (1 << 21) - 1)
            parents.append(own >> 21)
            place[alive] = which + levels[-1]
            levels.append(levels[-1] + len(own))
            at += 1
            alive = alive[at[alive] < last[alive]]
        return np.concatenate(chars).astype(np.uint64), np.concatenate(parents).astype(np.int32), place.astype(np.int32), levels

    def filtered(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward filter of distinct words, all together.

        Returns the last place of each word, the last edge into each place, and per edge place +
        cumulative probability, the place that it comes from (0 before all words) and its piece.
        """
        char, parent, end, levels = self._tree(words)
        source, target, found = self._edges(char, parent)
        begin = np.searchsorted(target, np.arange(len(char) + 1))
        weight = np.where(found >= 0, self.weights[np.maximum(found, 0)], self.lowest)
        total = np.zeros(len(char))
        for a, b in zip(levels[:-1], levels[1:], strict=True):
            own = slice(begin[a], begin[b])
            value = total[source[own]] + weight[own]
            runs = begin[a:b] - begin[a]
            top = np.maximum.reduceat(value, runs)
            value -= top[target[own] - a]
            total[a:b] = top + np.log(np.add.reduceat(np.exp(value), runs))
        weight += total[source]
        weight -= total[target]
        chance = np.exp(weight)
        ladder = np.cumsum(chance)
        ladder -= (ladder - chance)[begin[target]]
        np.clip(ladder, 0.0, 1.0 - 2.0**-20, out=ladder)
        ladder += target
        return end, begin[1:] - 1, ladder, source, found

    def _parts(self, word: str) -> Iterator[str]:
        """A long word in parts: it is cut at all places that no piece of two or more characters spans."""
        held, n = 0, len(word)
        for at in range(0, n, SLICE):
            low, high = max(0, at - self.longest + 1), min(n, at + SLICE + self.longest - 1)
            source, target, _ = self._edges(*_line(_codes(word[low:high])))
            over = np.cumsum(np.bincount(source + 1, minlength=high - low + 2) - np.bincount(target, minlength=high - low + 2))
            free = np.flatnonzero(over[: high - low + 1] == 0) + low
            for cut in free[(free > at) & (free <= at + SLICE)].tolist():
                yield word[held:cut]
                held = cut

    def _runs(self, text: str) -> Iterator[list[str]]:
        """The words of a text in order, in lists of about GROUP characters."""
        text = text.replace(SPACE, _ESCAPED)
        at, n = 0, len(text)
        while at < n:
            found = _BREAK.search(text, at + GROUP - 1) if n - at > GROUP else None
            end = found.start() + 1 if found else n
            words = _WORD.findall(("" if at else SPACE) + text[at:end].replace(" ", SPACE))
            at = end
            if max(map(len, words)) <= CUT:
                yield words
                continue
            held, size = [], 0
            for part in chain.from_iterable(self._parts(w) if len(w) > CUT else (w,) for w in words):
                held.append(part)
                size += len(part)
                if size >= GROUP:
                    yield held
                    held, size = [], 0
            if held:
                yield held

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """A segmentation of each text as piece ids; ``seeds`` are uint64, one per text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, int, list[str]]] = []
        size = 0

        def draw() -> None:
            for (k, _, _), ids in zip(held, self._drawn([h[2] for h in held], seeds[[h[0] for h in held]], [h[1] for h in held]), strict=True):
                out[k].append(ids)

        for k, text in enumerate(texts):
            nth = 0
            for words in self._runs(text):
                held.append((k, nth, words))
                nth += len(words)
                size += sum(map(len, words))
                if size >= GROUP:
                    draw()
                    held, size = [], 0
        if held:
            draw()
        none = np.empty(0, np.int32)
        return [own[0] if len(own) == 1 else np.concatenate(own) if own else none for own in out]

    def _drawn(self, runs: list[list[str]], seeds: np.ndarray, nth: list[int]) -> list[np.ndarray]:
        """Piece ids of each run of words; a draw follows the run's seed and the word's number, ``nth`` for the first."""
        index = _Numbered()
        count = np.fromiter(map(len, runs), np.int64, len(runs))
        words = np.fromiter(chain.from_iterable(map(index.__getitem__, r) for r in runs), np.int32, int(count.sum()))
        distinct = list(index)
        size = np.fromiter(map(len, distinct), np.int64, len(distinct))
        by_size = np.argsort(size, kind="stable")  # words of like length are filtered in one slice
        rank = np.empty(len(distinct), np.int32)
        rank[by_size] = np.arange(len(distinct), dtype=np.int32)
        words, size = rank[words], size[by_size]
        starts = np.concatenate([[0], np.cumsum(count)])
        of = np.repeat(np.arange(len(runs), dtype=np.int32), count)
        number = np.arange(len(words)) - starts[of] + np.array(nth, np.int64)[of] + 1
        stream = seeds[of] + number.astype(np.uint64) * _STEP
        del of, number
        order = np.argsort(words, kind="stable").astype(np.int32)
        first = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=len(distinct)))])
        taken, length = [], np.zeros(len(words), np.int32)
        short, a = int(np.searchsorted(size, LONG, side="right")), 0
        upto = np.cumsum(size)
        while a < short:
            b = min(short, max(a + 1, int(np.searchsorted(upto, upto[a] - size[a] + SLICE, side="right"))))
            here = order[first[a] : first[b]]
            end, last_edge, ladder, source, piece = self.filtered([distinct[i] for i in by_size[a:b].tolist()])
            at, own, step = end[words[here] - a], stream[here], 0
            while len(here):
                edge = np.minimum(np.searchsorted(ladder, at + _uniform(own), side="right"), last_edge[at])
                taken.append((here, step, piece[edge]))
                length[here] += 1
                at = source[edge]
                more = np.flatnonzero(at)
                here, at, own = here[more], at[more], own[more] + _SPREAD
                step += 1
            a = b
        for w in range(short, len(distinct)):
            for which in order[first[w] : first[w + 1]].tolist():
                found = self._one(distinct[by_size[w]], stream[which])
                taken.append((which, np.arange(len(found)), found))
                length[which] = len(found)
        upto = np.cumsum(length, dtype=np.int64)
        ids = np.empty(upto[-1], np.int32)
        for which, step, what in taken:
            ids[upto[which] - 1 - step] = what
        del taken
        cuts = np.concatenate([[0], upto])[starts]
        return self._ids(ids, cuts)

    def _one(self, word: str, stream: np.uint64) -> np.ndarray:
        """A segmentation of one long word, from its end: the filter keeps what it knows before each block and is run again."""
        code = _codes(word)
        window, windows = [0.0], []
        for at in range(0, len(code), BLOCK):
            windows.append(window)
            window = self._block(code, at, window)[0][-self.longest :]
        at, out, number = len(code), [], 0
        for k in range(len(windows) - 1, -1, -1):
            start = k * BLOCK
            total, begin, source, weight, found = self._block(code, start, windows[k])
            shift = start - len(windows[k]) + 1  # place of total[0]
            draws = _uniform(stream + np.arange(number, number + BLOCK, dtype=np.uint64) * _SPREAD).tolist()
            base = number
            while at > start:
                here, left = at - shift, draws[number - base]
                for edge in range(begin[at - start - 1], begin[at - start]):
                    left -= math.exp(total[source[edge]] + weight[edge] - total[here])
                    if left < 0:
                        break
                out.append(found[edge])
                at = source[edge] + shift
                number += 1
        return np.array(out, np.int32)

    def _block(self, code: np.ndarray, at: int, window: list[float]) -> tuple[list[float], list[int], list[int], list[float], list[int]]:
        """Log weights of the places of ``window`` and the block after it; edges by the place they lead to, sources as numbers of places."""
        low = at - len(window) + 1
        source, target, found = self._edges(*_line(code[low : at + BLOCK]))
        first = int(np.searchsorted(target, len(window)))
        source, target, found = source[first:], target[first:], found[first:]
        weight = np.where(found >= 0, self.weights[np.maximum(found, 0)], self.lowest).tolist()
        begin = np.searchsorted(target, np.arange(len(window), min(len(code), at + BLOCK) - low + 2)).tolist()
        source, total = source.tolist(), list(window)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            values = [total[source[e]] + weight[e] for e in range(a, b)]
            top = max(values)
            total.append(top + math.log(sum(math.exp(v - top) for v in values)))
        return total, begin, source, weight, found.tolist()

    def _ids(self, found: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
        """Piece ids between cuts; characters without a piece become their byte pieces."""
        ids = self.numbers[np.maximum(found, 0)]
        if len(found) and found.min() < 0:
            char = np.where(found < 0, -1 - found, 0)
            char[char == ord(_ESCAPED)] = ord(SPACE)
            n = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
            place = np.concatenate([[0], np.cumsum(n)])
            out = np.empty(place[-1], np.int32)
            out[place[:-1]] = ids
            some = np.flatnonzero(found < 0)
            char, n, place_of = char[some], n[some], place[some]
            for k in range(4):  # the k-th byte from the end
                has = n > k
                lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n] if k else 0
                low = (char >> 6 * k) & 0x3F | 0x80
                top = (char >> 6 * k) | lead
                byte = np.where(n == 1, char, np.where(n == k + 1, top, low))
                out[(place_of + n - 1 - k)[has]] = self.byte_ids[byte[has]]
            ids, cuts = out, place[cuts]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids) -> str:
        """The text of piece ids."""
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode("utf-8", errors="replace")

    def decodes_to(self, ids: np.ndarray, text: str) -> bool:
        """Whether the ids decode to ``text``, a bounded number of them at a time."""
        want, at, raw = b" " + text.encode("utf-8") if text else b"", 0, self.raw
        for k in range(0, len(ids), DECODED):
            part = b"".join([raw[i] for i in ids[k : k + DECODED].tolist()])
            if not want.startswith(part, at):
                return False
            at += len(part)
        return at == len(want)


def _codes(text: str) -> np.ndarray:
    """Code points as uint64."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _line(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One text as a tree."""
    return np.concatenate([np.zeros(1, np.uint64), code]), np.arange(-1, len(code), dtype=np.int32)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from counters, by the splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


@lru_cache(maxsize=2)
def lattice(path: str, sharpness: float) -> PieceLattice:
    return PieceLattice(path, sharpness)


def _sampled(own: PieceLattice, texts: pa.Array, seeds: pa.Array) -> Iterator[tuple[list[str | None], list[np.ndarray]]]:
    """Texts and their ids, ROWS rows of an Arrow batch at a time."""
    for at in range(0, len(texts), ROWS):
        some = texts.slice(at, ROWS).to_pylist()
        seed = seeds.slice(at, ROWS).to_numpy(zero_copy_only=False).view(np.uint64)
        yield some, own.sample([t or "" for t in some], seed)


def sampled_pieces(text: Column, key: Column, model: str, sharpness: float = 1.0) -> Column:
    """Piece ids (array of int) of a sampled segmentation of ``text``, seeded by ``key``.

    Null gives null, the empty text an empty array. Equal keys and texts give equal ids.
    """

    def encode(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        parts, sizes = [], []
        for some, ids in _sampled(lattice(model, sharpness), texts, seeds):
            parts += ids
            sizes += [None if t is None else len(i) for t, i in zip(some, ids, strict=True)]
        offsets = np.concatenate([[0], np.cumsum([n or 0 for n in sizes])]).astype(np.int32)
        values = np.concatenate([np.empty(0, np.int32), *parts])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=pa.array([n is None for n in sizes], pa.bool_()))

    return F.arrow_udf(encode, "array<int>")(text, F.xxhash64(key))


def round_trip(text: Column, key: Column, model: str, sharpness: float = 1.0) -> Column:
    """``struct(n_pieces, ids_hash, lossless)`` of a sampled segmentation; the ids themselves stay in the worker."""

    def encode(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        own, rows = lattice(model, sharpness), []
        for some, ids in _sampled(own, texts, seeds):
            rows += [(len(i), xxhash.xxh64_intdigest(i.tobytes()) >> 1, own.decodes_to(i, t or "")) for t, i in zip(some, ids, strict=True)]
        n, hashes, same = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(hashes, pa.int64()), pa.array(same, pa.bool_())], ["n_pieces", "ids_hash", "lossless"])

    return F.arrow_udf(encode, "n_pieces long, ids_hash long, lossless boolean")(text, F.xxhash64(key))


def decoded(ids: Column, model: str) -> Column:
    """The text of piece ids; null gives null."""

    def decode(rows: pa.Array) -> pa.Array:
        own = lattice(model, 1.0)
        return pa.array([own.decode(r.as_py()) if r.is_valid else None for r in rows], pa.string())

    return F.arrow_udf(decode, "string")(ids)


def with_pieces(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", sharpness: float = 1.0) -> DataFrame:
    """``df`` with piece_ids and n_pieces; rows do not move. Columns with these names are replaced.

    A null text has null ids and 0 pieces, an empty text no ids. Repeated rows are segmented alike; a
    null id is a key like any other. An empty table stays empty. Texts and words of any length are
    sampled whole, in memory that follows one text and its ids.
    """
    ids = sampled_pieces(F.col(f"`{text_col}`"), F.col(f"`{id_col}`"), model, sharpness)
    return df.withColumn("piece_ids", ids).withColumn("n_pieces", F.when(F.col("piece_ids").isNull(), 0).otherwise(F.size("piece_ids")))


def round_trip_table(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_pieces, ids_hash (of the id array), lossless (decoding gives the text; null counts as empty)."""
    n = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = df.select(id_col, n.alias("n_bytes"), round_trip(F.col(f"`{text_col}`"), F.col(f"`{id_col}`"), model).alias("trip"))
    return rows.select(id_col, "n_bytes", F.col("trip.n_pieces").cast("int").alias("n_pieces"), "trip.ids_hash", "trip.lossless")
