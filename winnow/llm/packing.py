"""Packing: documents become token sequences, cut by order-preserving dynamic programming.

The tokens of all documents, in the order of the input, are one stream per task. Sequences
are runs of the stream; the cuts between them lie at document or sentence ends where they
can. The cost of a sequence is its padding (to ``size``, none at a power of two) and of a cut
inside a document its truncation penalty. As padding is linear in the cut, the best earlier
cut is the front of a monotone queue; the lengths that need no padding are tried beside it.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 4096
END_ID = 2
SENTENCE_CUT, HARD_CUT = 16, 64
#: Tokens that are packed together before sequences are given out.
SEGMENT = 1 << 20

_SENTENCE = re.compile(r"[.!?]+(</w>)?")
#: Letters whose lower case is one letter and already composed, then ASCII signs without those that
#: begin an ending (') or a special token (<).
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")
#: Words remembered, at most; about 50 MB of a worker's memory.
_CACHE_WORDS = 250_000

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary (a fixed rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(plain)))}


class _Words(dict):
    """Token ids of white-space separated runs as bytes, found when first asked for."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer, self.pieces = tokenizer, tokenizer.model.tokenize
        letters = _byte_letters()
        self.spelling = ["".join(letters[b] for b in chr(code).encode()) for code in range(256)]
        self.written = [np.array([i], "<u4").tobytes() for i in range(max(tokenizer.get_vocab().values()) + 1)]
        self.letters, self.tails = {}, {}

    def forget(self) -> None:
        self.clear()
        self.letters.clear()
        self.tails.clear()

    def _whole(self, run: str) -> bytes:
        return b"".join([self.written[i] for i in self.tokenizer.encode(run, add_special_tokens=False).ids])

    def __missing__(self, run: bytes) -> bytes:
        text = run.decode()
        found = _PLAIN.fullmatch(text)
        if found is None:
            ids = self._whole(text)
        else:
            # Letters, then signs: the split pattern parts them, and lower case has no exceptions.
            word, tail = found.groups()
            word = word.lower()
            ids = self.letters.get(word)
            if ids is None:
                spelled = word if word.isascii() else word.translate(self.spelling)
                ids = self.letters[word] = b"".join([self.written[t.id] for t in self.pieces(spelled)])
            if tail:
                end = self.tails.get(tail)
                if end is None:
                    end = self.tails[tail] = self._whole(tail)
                ids += end
        self[run] = ids
        return ids


class WordTokenizer:
    """Token ids of whole texts, by a memory of the words seen; the same as the tokenizer gives.

    The tokenizer never joins what ASCII white space parts, and drops that space, so the runs
    between can be encoded alone and remembered. The memory is emptied when full and at the end
    of a task, as the worker process lives on and serves other stages.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.tokenizer)
        ends = [i for t, i in self.tokenizer.get_vocab().items() if _SENTENCE.fullmatch(t)]
        self.sentence_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.sentence_end[ends] = True

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """This process's tokenizer for a file."""
        kept = vars(sys).setdefault("_winnow_tokenizers", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def encode(self, text: str) -> np.ndarray:
        if len(self.words) > _CACHE_WORDS:
            self.words.forget()
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.encode().split())), "<u4")


def padding(length: int, size: int = SIZE) -> int:
    return 0 if length & (length - 1) == 0 else size - length


def best_cuts(places: list[int], penalties: list[int], size: int = SIZE) -> list[int]:
    """The places to cut a stream at, from 0 to its end, at the least cost.

    ``places`` rise from 0, no two further apart than ``size``; ``penalties`` has what a cut
    at each costs. Of equal costs the earlier cut is taken.
    """
    at = np.array(places)
    ends, begins = [], []
    for power in (1 << b for b in range(size.bit_length()) if 1 << b <= size):
        k = np.searchsorted(at, at - power)
        hit = np.flatnonzero(at[k] == at - power)
        ends.append(hit)
        begins.append(k[hit])
    ends, begins = np.concatenate(ends), np.concatenate(begins)
    order = np.lexsort((begins, ends))
    edges = np.searchsorted(ends[order], np.arange(len(places) + 1)).tolist()
    begins = begins[order].tolist()
    cost, back = [0] * len(places), [0] * len(places)
    queue = deque([0])  # of rising places with rising cost + place
    for k in range(1, len(places)):
        place = places[k]
        while places[queue[0]] < place - size:
            queue.popleft()
        best = queue[0]
        least = cost[best] + size - (place - places[best])
        for j in begins[edges[k]:edges[k + 1]]:
            if cost[j] < least or (cost[j] == least and j < best):
                best, least = j, cost[j]
        cost[k], back[k] = least + penalties[k], best
        value = cost[k] + place
        while queue and cost[queue[-1]] + places[queue[-1]] > value:
            queue.pop()
        queue.append(k)
    cuts, k = [places[-1]], len(places) - 1
    while k:
        k = back[k]
        cuts.append(places[k])
    return cuts[::-1]


def cut_places(stream: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, size: int = SIZE):
    """Where a stream may be cut, and what each cut costs.

    Sentence ends are tokens of only full stops, question or exclamation marks. Where two
    places are more than a quarter of ``size`` apart, places inside are added at a higher cost.
    """
    inside = np.flatnonzero(sentence_end[np.minimum(stream, len(sentence_end) - 1)]) + 1
    places = np.unique(np.concatenate([[0], inside, doc_ends]))
    cost = np.full(len(places), SENTENCE_CUT)
    cost[np.isin(places, doc_ends)] = 0
    cost[0] = 0
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > size // 4)
    if len(wide):
        more = np.concatenate([np.arange(places[w] + size // 4, places[w + 1], size // 4) for w in wide])
        places = np.concatenate([places, more])
        cost = np.concatenate([cost, np.full(len(more), HARD_CUT)])
        order = np.argsort(places, kind="stable")
        places, cost = places[order], cost[order]
    return places.tolist(), cost.tolist()


def split_tail(start: int, end: int, size: int = SIZE) -> list[int]:
    """Ends of the last sequences of a stream: powers of two where that costs less than padding."""
    length = end - start
    if padding(length, size) <= HARD_CUT * (bin(length).count("1") - 1):
        return [end]
    ends, at = [], start
    for bit in reversed(range(length.bit_length())):
        if length >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


class _Packer:
    """Documents of one task; gives out the pieces of finished sequences."""

    def __init__(self, task: int, sentence_end: np.ndarray, size: int) -> None:
        self.docs: list[tuple[int | None, np.ndarray, int, int]] = []  # id, ids, place in document, its tokens
        self.waiting, self.sequence, self.sentence_end, self.size = 0, task << 40, sentence_end, size

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.waiting += len(ids)

    def pack(self, last: bool) -> list[tuple]:
        if not self.docs:
            return []
        stream = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        cuts = best_cuts(*cut_places(stream, ends, self.sentence_end, self.size), self.size)
        if last:
            cuts = cuts[:-1] + split_tail(cuts[-2], cuts[-1], self.size)
        else:
            cuts = cuts[:-1]
        rows, doc, at = [], 0, 0  # at: where the document begins in the stream
        for first, stop in zip(cuts, cuts[1:]):
            place = first
            while place < stop:
                while ends[doc] <= place:
                    at = int(ends[doc])
                    doc += 1
                doc_id, _, before, total = self.docs[doc]
                to = min(stop, int(ends[doc]))
                rows.append((doc_id, before + place - at, to - place, zlib.crc32(stream[place:to].tobytes()),
                             total, self.sequence, place - first))
                place = to
            self.sequence += 1
        rest, kept, at = cuts[-1], [], 0
        for doc_id, ids, before, total in self.docs:
            if at + len(ids) > rest:
                skip = max(0, rest - at)
                kept.append((doc_id, ids[skip:], before + skip, total))
            at += len(ids)
        self.docs, self.waiting = ([], 0) if last else (kept, len(stream) - rest)
        return rows


def pack(docs: DataFrame, tokenizer: str, *, size: int = SIZE, segment: int = SEGMENT) -> DataFrame:
    """Pieces of the documents in sequences of at most ``size`` tokens.

    A document's tokens are those of its whole text and then id 2; null and empty texts are
    that id alone. Documents keep the order of the input; rows that repeat are packed again.
    ``sequence_id`` is unique, with the task's number in its upper bits. ``doc_id`` may be
    null; other columns are left out; no rows give none. ``tokenizer`` is a file's path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer.of(tokenizer)
        packer = _Packer(TaskContext.get().partitionId(), words.sentence_end, size)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PIECES.split(", ")])

        try:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    packer.add(doc_id, words.encode(text.as_py() or ""))
                    if packer.waiting >= segment and (rows := packer.pack(last=False)):
                        yield table(rows)
            if rows := packer.pack(last=True):
                yield table(rows)
        finally:
            words.words.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)
