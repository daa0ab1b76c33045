"""Benchmark decontamination by embedding edit distance into Hamming distance.

The random walk of Chakraborty, Goldenberg and Koucky reads a word sequence: at every step it
writes the word it stands on and goes on to the next if a random bit of step and word says
so. Sequences at a small edit distance agree at most steps. A signature samples some steps;
windows of a document, from every word on, whose signature is that of a benchmark item are
candidates if the two walks agree at enough of all steps. The walk is repeated with other bits
and steps, from anchors over the item's full length, and each candidate is verified by its
exact edit distance to the item, after a lower bound of it, the item's words that are missing.
Walks start only where a match can be: its edits leave a run of the item's words whole, so windows
far from every such run are left out, which loses none that the exact distance would let pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from winnow.llm.common import Rolling, chunks, mixed, slices, text_buffers, word_spans

REPEATS, SAMPLED, MOST_STEPS, SHARE = 8, 3, 32, 0.2
#: The share of all steps at which a candidate's walk agrees with the item's.
AGREE = 0.45
#: The most words of a run that a match has to share with its item.
MOST_RUN = 4
#: Items that are searched together; more are searched in several passes over the documents.
BLOCK_ITEMS = 20_000
#: Bytes that part words: ASCII but letters and digits.
_APART = np.ones(256, bool)
_APART[48:58] = _APART[97:123] = _APART[65:91] = False
_APART[128:] = False

_MATCH = "doc_id long, item_id long, start long, n_words long, distance long"
_MATCH_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "item_id", "start", "n_words", "distance")])


def word_keys(column) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of lower-cased texts, and where each text's words begin."""
    data, starts, ends = text_buffers(column)
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, stop in chunks(starts, ends):
        base = starts[first]
        own = data[base:ends[stop - 1]]
        begin, end, counts = word_spans(own, starts[first:stop] - base, ends[first:stop] - base, _APART)
        parts.append(mixed(Rolling(own).spans(begin, end)) if len(begin) else np.zeros(0, np.uint64))
        sizes.append(counts)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def edit_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int]:
    """Least edit distance between the item and any run of the text, and where that run ends.

    The end is the first of the best; distances over ``most`` are given as ``most + 1``.
    """
    size, high = len(item), 1 << max(len(item) - 1, 0)
    every = (1 << size) - 1
    places: dict[int, int] = {}
    for k, word in enumerate(item.tolist()):
        places[word] = places.get(word, 0) | 1 << k
    # Bit-parallel columns: where the table rises or falls by one from row to row, as bits of two integers.
    rises, falls, score = every, 0, size
    best, end = (score, 0) if score <= most else (most + 1, 0)
    for at, word in enumerate(text.tolist() if size else []):
        same = places.get(word, 0)
        up = same | falls
        across = (((same & rises) + rises) ^ rises) | same
        more, less = falls | (every & ~(across | rises)), rises & across
        score += bool(more & high) - bool(less & high)
        more, less = more << 1, less << 1
        rises, falls = (less | ~(up | more)) & every, more & up & every
        if score < best:
            best, end = score, at + 1
    return best, end


def _anchors(size: int) -> list[int]:
    """The words of an item that walks start from: so close that a walk of at most 32 steps, about
    16 words, overlaps the next, and that a part without edits has one wherever it is. Items of 5
    to 7 words may have one edit: every part behind it has a walk, and so has the part before it.
    Shorter ones may have none.
    """
    if size < 8:
        return list(range(4 if size >= 5 else min(size, 1)))
    apart, least = (2, 4) if size < 16 else (4, 8) if size < 32 else (8, 8)
    return sorted({*range(0, size - least + 1, apart), size // 2})


_NEXT = np.uint64(0xD6E8FEB86659FD93)


def _folded(signatures: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Signatures with one more sampled word, as 64-bit hashes."""
    with np.errstate(over="ignore"):
        return mixed(signatures * _NEXT + codes.astype(np.uint64))


def _run_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words."""
    size = max(0, len(codes) - width + 1)
    hashes = np.zeros(size, np.uint64)
    for k in range(width):
        hashes = _folded(hashes, codes[k:k + size])
    return hashes


@dataclass
class Index:
    """Signatures of a block of items. Word 0 stands for every word that no item has."""

    ids: list[int]
    vocabulary: np.ndarray
    items: list[np.ndarray]
    bits: np.ndarray  # per repeat and word: the walk's bit of each step
    #: repeat, sampled steps, and by entry: signature, item number, offset in the item, words walked
    passes: list[tuple[int, tuple[int, ...], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    kept_runs: dict[float, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=dict)

    @classmethod
    def build(cls, ids: list[int], texts: list[str], *, repeats: int = REPEATS, sampled: int = SAMPLED,
              seed: int = 3) -> Index:
        keys, edges = word_keys(pa.array([t.lower() for t in texts], pa.string()))
        vocabulary = np.unique(keys)
        codes = np.searchsorted(vocabulary, keys) + 1
        items = [codes[a:b] for a, b in zip(edges, edges[1:])]
        rng = np.random.default_rng(seed)
        bits = rng.integers(1 << 63, size=(repeats, len(vocabulary) + 1), dtype=np.uint64)
        starts: dict[int, list[tuple[int, int]]] = {}
        for number, item in enumerate(items):
            for offset in _anchors(len(item)):
                steps = min(MOST_STEPS, 1 << (len(item) - offset).bit_length() - 1)
                starts.setdefault(steps, []).append((number, offset))
        passes = []
        for repeat in range(repeats):
            for steps, entries in sorted(starts.items()):
                picked = tuple(sorted(rng.choice(steps, min(sampled, steps), replace=False).tolist()))
                rows = np.array(entries, np.int64).T
                walks = np.empty((steps, len(entries)), np.int64)
                for column, (number, offset) in enumerate(entries):
                    at, item = offset, items[number]
                    for step in range(steps):
                        walks[step, column] = item[at]
                        at += int(bits[repeat, item[at]] >> np.uint64(step)) & 1
                signatures = np.zeros(len(entries), np.uint64)
                for step in picked:
                    signatures = _folded(signatures, walks[step])
                order = np.lexsort((rows[1], rows[0], signatures))
                passes.append((repeat, picked, signatures[order], *rows[:, order], walks[:, order]))
        return cls(ids, vocabulary, items, bits, passes)

    def runs(self, share: float) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of words of which every match of an item holds one, by their width.

        Of ``most`` edits and the ``most + 1`` equal parts of an item, one part has no edit. With the
        width come the hashes, how far from such a run the item's words may be, and a bitmap of the hashes.
        """
        if share not in self.kept_runs:
            sizes = np.array([len(i) for i in self.items], np.int64)
            most = (share * sizes).astype(np.int64)
            widths = np.repeat(np.minimum(sizes // (most + 1), MOST_RUN), sizes)
            codes, room = np.concatenate(self.items), np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())
            reach, out = np.repeat(sizes + most, sizes), []
            for width in np.unique(widths).tolist():
                at = np.flatnonzero((widths == width) & (room >= max(width, 1)))
                hashes, which = np.unique(_run_hashes(codes, width)[at], return_inverse=True)
                far = np.zeros(len(hashes), np.int64)
                np.maximum.at(far, which, reach[at])
                maybe = np.zeros(1 << min(24, len(hashes).bit_length() + 6), bool)
                maybe[hashes & np.uint64(len(maybe) - 1)] = True
                out.append((width, hashes, far, maybe))
            self.kept_runs[share] = out
        return self.kept_runs[share]

    def near_runs(self, codes: np.ndarray, share: float) -> np.ndarray:
        """The words, by place, that may be of a match: those near a run that it would share."""
        turns = np.zeros(len(codes) + 1, np.int64)
        for width, hashes, far, maybe in self.runs(share):
            if not width:  # a match need not share a word
                return np.arange(len(codes), dtype=np.int32)
            found = _run_hashes(codes, width)
            at = np.flatnonzero(maybe[found & np.uint64(len(maybe) - 1)])
            entry = np.minimum(np.searchsorted(hashes, found[at]), len(hashes) - 1)
            hit = hashes[entry] == found[at]
            at, far = at[hit], far[entry[hit]]
            turns += np.bincount(np.maximum(at - far, 0), minlength=len(turns))
            turns -= np.bincount(np.minimum(at + far + 1, len(codes)), minlength=len(turns))
        return np.flatnonzero(np.cumsum(turns[:-1]) > 0).astype(np.int32)

    def candidates(self, codes: np.ndarray, near: np.ndarray | None = None) -> np.ndarray:
        """Distinct (item number, start of the item in the words), from all repeats.

        Walks start from the words ``near`` alone, if given.
        """
        found, base = [np.zeros((0, 2), np.int64)], len(self.vocabulary) + 1
        size = len(codes)
        near = np.arange(size, dtype=np.int32) if near is None else near
        # Past the end stand words that no item has, so that no walk leaves the array.
        codes = np.concatenate([codes, np.zeros(MOST_STEPS, codes.dtype)])
        walked, walk, reached = -1, codes, []

        def moved(at: np.ndarray, step: int) -> np.ndarray:
            ahead = walk[at]
            ahead >>= np.uint64(step)
            ahead &= np.uint64(1)
            return at + ahead.astype(np.int32)

        for repeat, picked, signatures, numbers, offsets, walks in self.passes:
            if walked != repeat:
                walked, walk = repeat, self.bits[repeat][codes]
                reached = [near]  # of all windows, by step
            while len(reached) <= picked[0]:
                reached.append(moved(reached[-1], len(reached) - 1))
            first = np.zeros(base, bool)
            first[walks[picked[0]]] = True
            here = np.flatnonzero(first[codes[reached[picked[0]]]])
            start, at = near[here], reached[picked[0]][here]
            signature = _folded(np.zeros(len(at), np.uint64), codes[at])
            for before, goal in zip(picked, picked[1:]):
                for step in range(before, goal):
                    at = moved(at, step)
                signature = _folded(signature, codes[at])
            # A bitmap of signatures spares most of the searches.
            maybe = np.zeros(1 << 16, bool)
            maybe[signatures >> np.uint64(48)] = True
            keep = maybe[signature >> np.uint64(48)]
            start, signature = start[keep], signature[keep]
            low = np.searchsorted(signatures, signature, "left")
            n = np.searchsorted(signatures, signature, "right") - low
            hit = n > 0
            if hit.any():
                low, n, start = low[hit], n[hit], start[hit]
                entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(start, n)
                agree, at = np.zeros(len(start)), start
                for step, words in enumerate(walks):
                    agree += codes[at] == words[entry]
                    at = moved(at, step)
                alike = agree >= AGREE * len(walks)
                found.append(np.stack([numbers[entry[alike]], start[alike] - offsets[entry[alike]]], axis=1))
        # As one number each: what lies before the text's first word, too, has a place of its own.
        before = max(map(len, self.items), default=0)
        row = np.concatenate(found)
        place = np.unique(row[:, 0] * np.int64(size + before + 1) + row[:, 1] + before)
        return np.stack([place // (size + before + 1), place % (size + before + 1) - before], axis=1)

    def missing(self, codes: np.ndarray, numbers: np.ndarray, starts: np.ndarray, spare: np.ndarray) -> np.ndarray:
        """At least how many words of each item its window, widened by ``spare``, doesn't have."""
        base = np.int64(len(self.vocabulary) + 1)
        long = np.array([len(i) for i in self.items], np.int64)
        pairs = np.unique(np.repeat(np.arange(len(long)), long) * base + np.concatenate(self.items))
        sizes = np.bincount(pairs // base, minlength=len(long))
        out = np.zeros(len(numbers), np.int64)
        # As many windows at once as have about a million words together.
        at_once = max(1, (1 << 20) // int((long[numbers] + 2 * spare).max(initial=1)))
        for k in range(0, len(numbers), at_once):
            part = slice(k, k + at_once)
            low = np.maximum(starts[part] - spare[part], 0)
            n = np.maximum(np.minimum(starts[part] + long[numbers[part]] + spare[part], len(codes)) - low, 0)
            row = np.repeat(np.arange(len(n)), n)
            at = np.repeat(low, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            key = numbers[part][row] * base + codes[at]
            hit = pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key
            # As many words of the item as the window lacks at least, repeats not told apart; then by distinct words.
            lacks = long[numbers[part]] - np.bincount(row[hit], minlength=len(n))
            hit &= (lacks <= spare[part])[row]
            there = np.unique(row[hit] * (base * len(self.items)) + key[hit])
            apart = sizes[numbers[part]] - np.bincount(there // (base * len(self.items)), minlength=len(n))
            out[part] = np.maximum(lacks, apart)
        return out

    def matches(self, codes: np.ndarray, edges: np.ndarray, share: float) -> list[tuple[int, int, int, int, int]]:
        """(text, item number, start, words, distance): per text and item the best verified match."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        found = self.candidates(codes, self.near_runs(codes, share))
        numbers, starts = found[:, 0], found[:, 1]
        if not len(found):
            return []
        sizes = np.array([len(i) for i in self.items], np.int64)[numbers]
        spare = (share * sizes).astype(np.int64)
        near = self.missing(codes, numbers, starts, spare) <= spare
        numbers, starts, sizes = numbers[near], starts[near], sizes[near]
        # The middle of the window says which text it is of.
        texts = np.searchsorted(edges, starts + sizes // 2, "right") - 1
        for number, start, text in zip(numbers.tolist(), starts.tolist(), texts.tolist()):
            if not 0 <= text < len(edges) - 1:
                continue
            item = self.items[number]
            most = int(share * len(item))
            known = best.get((text, number))
            if known and known[0] == 0:
                continue
            low = max(int(edges[text]), start - most)
            high = min(int(edges[text + 1]), start + len(item) + most)
            exact = codes[start:start + len(item)] if start >= edges[text] and start + len(item) <= edges[text + 1] else codes[:0]
            if len(exact) == len(item) and np.array_equal(exact, item):
                distance, end = 0, start - low + len(item)
            else:
                distance, end = edit_distance(item, codes[low:high], most)
            if distance <= most and (known is None or distance < known[0]):
                best[text, number] = (distance, max(0, low - int(edges[text]) + end - len(item)), len(item))
        return [(text, number, start, size, distance) for (text, number), (distance, start, size) in sorted(best.items())]


def _matches(index: Index, texts, share: float) -> Iterator[tuple[int, int, int, int, int]]:
    """Verified matches of a column of lower-cased texts, some texts at a time."""
    codes, edges = _codes(index, texts)
    for first, stop in chunks(edges[:-1], edges[1:], 1 << 17):
        own = codes[edges[first]:edges[stop]].astype(np.int64)
        for text, *match in index.matches(own, edges[first:stop + 1] - edges[first], share):
            yield first + text, *match


def _codes(index: Index, texts) -> tuple[np.ndarray, np.ndarray]:
    """The number of every word of a column of texts in the index, and where each text's words begin.

    Hashes are those of a slice of the texts at a time, so a batch takes four bytes a word.
    """
    parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for _, own in slices(texts):
        keys, edges = word_keys(own)
        at = np.minimum(np.searchsorted(index.vocabulary, keys), len(index.vocabulary) - 1)
        parts.append(np.where(index.vocabulary[at] == keys, at + 1, 0).astype(np.int32))
        sizes.append(np.diff(edges))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def _search(docs: DataFrame, index: Index, share: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[text], index.ids[number], start, size, distance)
                    for text, number, start, size, distance in _matches(index, batch.column("text"), share)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)], schema=_MATCH_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(run, _MATCH)


def _clean(index: Index, share: float):
    @F.arrow_udf(BooleanType())
    def clean(texts: pa.Array) -> pa.Array:
        held = np.zeros(len(texts), bool)
        held[[text for text, *_ in _matches(index, texts, share)]] = True
        return pa.array(~held)

    return clean


def _indexes(benchmark: DataFrame, block_items: int) -> Iterator[Index]:
    """An index per block of items; what the driver holds is one block."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-items.count() // block_items))
    for block in range(blocks):
        of_block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = of_block.orderBy("item_id", "text").collect()  # about block_items rows
        index = Index.build([r.item_id for r in rows], [r.text for r in rows])
        if len(index.vocabulary):
            yield index


def leaks(docs: DataFrame, benchmark: DataFrame, *, share: float = SHARE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Benchmark items that documents hold: one row per document and item, the best match.

    A match is a run of words whose edit distance to the item is at most ``share`` of the
    item's words; ``start`` is the word it starts at, about, where words were put in or left
    out. Words are runs of letters and digits, in lower case. Null and empty texts and items
    match nothing. Repeated rows and items, and null ids, are matched like others; other
    columns are left out; an empty table on either side gives no rows.
    """
    parts = [_search(docs, index, share) for index in _indexes(benchmark, block_items)]
    if not parts:
        return docs.sparkSession.createDataFrame([], _MATCH)
    return reduce(DataFrame.unionByName, parts)


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, share: float = SHARE,
                  block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows, with all columns, whose text holds no benchmark item; matches as in :func:`leaks`."""
    for index in _indexes(benchmark, block_items):
        docs = docs.where(_clean(index, share)(F.lower(F.coalesce("text", F.lit("")))))
    return docs
