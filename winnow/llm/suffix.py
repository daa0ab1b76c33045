"""Removal of long repeated byte strings, by prefix-free parsing of the corpus.

A rolling hash over ``trigger`` bytes cuts every text into phrases at the same places in the
same surroundings, wherever they occur. A window of ``width`` bytes belongs to the first cut
that its own bytes decide; the bytes that all windows of a cut share are its dictionary
entry. Entries are counted over the corpus, and only windows whose entry occurs again are
compared, by 64-bit fingerprints: first the dictionary orders the corpus, then the windows
inside of repeated entries. Windows without a cut in their first ``gap`` bytes are compared
directly, so text without cuts, such as one repeated byte, is treated alike.

Equal texts are one text with a count. Counts come from :mod:`winnow.llm.exchange`: a passage
that a third of the corpus repeats is one entry per block, and no task sees its places.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import exchange
from winnow.llm.common import Rolling, chunks, mixed, text_buffers, text_id

WIDTH = 400
TRIGGER, GAP, SPARSE = 16, 192, 5
ENTRY, DIRECT, WINDOW = 1, 2, 3
BITS = {ENTRY: 40, DIRECT: 64, WINDOW: 64}
BLOCK_BYTES = 8 << 20

_RESULT = "id binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_RESULT_ARROW = pa.schema([("id", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                           ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


@dataclass
class Parse:
    """Of some adjoining texts: entries with their windows' first and last start, and direct starts."""

    roll: Rolling
    entries: np.ndarray
    low: np.ndarray
    high: np.ndarray
    direct: np.ndarray
    width: int

    def windows(self, starts: np.ndarray) -> np.ndarray:
        return mixed(self.roll.spans(starts, starts + self.width))


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from each ``low`` to its ``high``, both included."""
    sizes = np.maximum(high - low + 1, 0)
    low, sizes = low[sizes > 0], sizes[sizes > 0]
    if not len(sizes):
        return np.zeros(0, np.int64)
    step = np.ones(sizes.sum(), np.int64)
    step[0] = low[0]
    at = np.cumsum(sizes)[:-1]
    step[at] = low[1:] - (low[:-1] + sizes[:-1] - 1)
    return np.cumsum(step)


def parse(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WIDTH, trigger: int = TRIGGER,
          gap: int = GAP, sparse: int = SPARSE) -> Parse:
    """Cut adjoining texts into phrases; ``width`` is more than ``trigger + gap``.

    A cut lies behind ``trigger`` bytes whose hash has ``sparse`` leading zero bits. A window
    from ``s`` belongs to the first cut from ``s + trigger`` to ``s + trigger + gap``.
    """
    roll = Rolling(data)
    hashes = mixed(roll.windows(trigger))
    cuts = np.flatnonzero(hashes >> np.uint64(64 - sparse) == 0) + trigger
    doc = np.searchsorted(ends, cuts, "left")
    inside = cuts - trigger >= starts[np.minimum(doc, len(starts) - 1)] if len(cuts) else np.zeros(0, bool)
    cuts, doc = cuts[inside], doc[inside]
    # Every text ends with a cut out of reach.
    far = np.int64(1) << 40
    owner = np.concatenate([doc, np.arange(len(starts))])
    order = np.argsort(owner, kind="stable")
    cut = np.concatenate([cuts, np.full(len(starts), far)])[order]
    owner = owner[order]
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    before = np.concatenate([[0], cut[:-1]])
    free = np.where(first, starts[owner], before - trigger + 1)  # the first window that isn't an earlier cut's
    last = ends[owner] - width
    low, high = np.maximum(free, cut - trigger - gap), np.minimum(cut - trigger, last)
    own = low <= high
    key = cut[own] - trigger
    entries = mixed(roll.spans(key, key + width - gap))
    direct = ranges(free, np.minimum(cut - trigger - gap - 1, last))
    return Parse(roll, entries, low[own], high[own], direct, width)


def _texts(table: pa.Table) -> tuple[list[bytes], np.ndarray, pa.Array]:
    """Ids, how often each text occurs, and the texts of a block; repeats come without their text."""
    counts = Counter()
    for key, n in zip(table.column("id").to_pylist(), table.column("n").to_pylist()):
        counts[key] += n
    rows = table.filter(pa.compute.is_valid(table.column("text")))
    seen, keep = set(), []
    for k, key in enumerate(rows.column("id").to_pylist()):
        if key not in seen:
            seen.add(key)
            keep.append(k)
    rows = rows.take(pa.array(keep, pa.int64()))
    ids = rows.column("id").to_pylist()
    return ids, np.array([counts[i] for i in ids], np.int64), rows.column("text").combine_chunks()


def _parsed(table: pa.Table) -> Iterator[tuple[Parse, list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parses of a block's texts, some at a time, with ids, counts, bytes and bounds."""
    ids, counts, texts = _texts(table)
    data, starts, ends = text_buffers(texts)
    for first, stop in chunks(starts, ends):
        base = starts[first]
        own = data[base:ends[stop - 1]]
        s, e = starts[first:stop] - base, ends[first:stop] - base
        yield parse(own, s, e), ids[first:stop], counts[first:stop], own, s, e


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their summed counts."""
    keys = np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in found]])
    counts = np.concatenate([np.zeros(0, np.int64), *[n for _, n in found]])
    keys, place = np.unique(keys, return_inverse=True)
    return keys, np.bincount(place, weights=counts, minlength=len(keys)).astype(np.uint64)


def _sum_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(keys, return_inverse=True)
    return keys, np.bincount(place, weights=counts, minlength=len(keys)).astype(np.int64)


def _held(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ones."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def _dictionary(table: pa.Table, bits: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    entries, direct = [], []
    for found, _, counts, _, _, ends in _parsed(table):
        of = np.searchsorted(ends, found.low, "right")
        entries.append(_sum_up(exchange.narrowed(found.entries, bits, BITS[ENTRY]), counts[of]))
        of = np.searchsorted(ends, found.direct, "right")
        direct.append(_sum_up(exchange.narrowed(found.windows(found.direct), bits, BITS[DIRECT]), counts[of]))
    return {ENTRY: _merged(entries), DIRECT: _merged(direct)}


def _again(table: pa.Table, replies: pa.Table, kind: int, keys: np.ndarray) -> np.ndarray:
    """Those of a block's keys that the corpus has twice or more."""
    sums = exchange.answers(replies, kind)
    return keys[sums[0] > 1] if sums is not None else keys[:0]


def _inside(table: pa.Table, replies: pa.Table, bits: int, dictionary) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of repeated entries, with counts."""
    again = _again(table, replies, ENTRY, dictionary[ENTRY][0])
    rows = []
    for found, _, counts, _, _, ends in _parsed(table):
        hit = _held(again, exchange.narrowed(found.entries, bits, BITS[ENTRY]))
        starts = ranges(found.low[hit], found.high[hit])
        of = np.searchsorted(ends, starts, "right")
        rows.append(_sum_up(exchange.narrowed(found.windows(starts), bits, BITS[WINDOW]), counts[of]))
    return _merged(rows)


def _removed(table: pa.Table, replies: pa.Table, bits: int) -> pa.Table:
    """What is left of each text of a block."""
    dictionary = _dictionary(table, bits)
    entries = _again(table, replies, ENTRY, dictionary[ENTRY][0])
    direct = _again(table, replies, DIRECT, dictionary[DIRECT][0])
    windows = _again(table, replies, WINDOW, _inside(table, replies, bits, dictionary)[0])
    rows = []
    for found, ids, _, data, starts, ends in _parsed(table):
        hit = _held(entries, exchange.narrowed(found.entries, bits, BITS[ENTRY]))
        inner = ranges(found.low[hit], found.high[hit])
        inner = inner[_held(windows, exchange.narrowed(found.windows(inner), bits, BITS[WINDOW]))]
        outer = found.direct[_held(direct, exchange.narrowed(found.windows(found.direct), bits, BITS[DIRECT]))]
        open_ = np.zeros(len(data) + found.width + 1, np.int32)
        open_[inner] = 1
        open_[outer] = 1
        sums = np.concatenate([[0], np.cumsum(open_)])
        at = np.arange(len(data))
        covered = sums[at + 1] > sums[np.maximum(at + 1 - found.width, 0)]
        runs = np.concatenate([[False], covered[1:] & covered[:-1]]) if len(data) else covered
        runs[starts[(starts < len(data))]] = False  # a run ends with its text
        begun = np.concatenate([[0], np.cumsum(covered & ~runs)])
        gone = np.concatenate([[0], np.cumsum(covered)])
        for key, a, b in zip(ids, starts.tolist(), ends.tolist()):
            removed = int(gone[b] - gone[a])
            left = data[a:b][~covered[a:b]] if removed else data[a:b]
            rows.append((key, b - a, removed, int(begun[b] - begun[a]), hashlib.sha256(left.tobytes()).hexdigest()))
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT_ARROW)], schema=_RESULT_ARROW)


def _distinct(docs: DataFrame, blocks: int) -> DataFrame:
    """Texts with an id and a block; a text that a task meets again is only counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = Counter()
        seen = set()
        names = ["id", "text", "n"]
        for batch in batches:
            ids, keep = batch.column("id").to_pylist(), []
            for k, key in enumerate(ids):
                if key in seen:
                    more[key] += 1
                else:
                    seen.add(key)
                    keep.append(k)
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("id"), kept.column("text"), pa.array([1] * len(keep), pa.int64())], names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(more), pa.binary()), pa.array([None] * len(more), pa.string()),
             pa.array(list(more.values()), pa.int64())], names)

    rows = docs.mapInArrow(run, "id binary, text string, n long")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    return rows.withColumn("block", block).repartition(blocks, "block")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of every row.

    A byte goes if a string of 400 bytes that covers it starts anywhere else, in the same text
    or another; strings never cross texts. Null is empty, shorter texts lose nothing, equal
    rows lose all from 400 bytes on. Ids may be null or repeat; other columns are left out; no
    rows give none.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", text_id().alias("id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, bits = max(1, -(-total // BLOCK_BYTES)), exchange.part_bits(total)
    texts = _distinct(rows.select("id", "text"), blocks)

    def first(table: pa.Table) -> list[dict]:
        block = table.column("block")[0].as_py()
        return [row for kind, (keys, counts) in _dictionary(table, bits).items() if len(keys)
                for row in exchange.requests(block, kind, keys, counts[None, :], bits, BITS[kind])]

    def second(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return exchange.REQUEST_ARROW.empty_table()
        keys, counts = _inside(table, replies, bits, _dictionary(table, bits))
        asked = exchange.requests(table.column("block")[0].as_py(), WINDOW, keys, counts[None, :], bits, BITS[WINDOW])
        return pa.Table.from_pylist(asked, exchange.REQUEST_ARROW)

    def last(table: pa.Table, replies: pa.Table) -> pa.Table:
        return _removed(table, replies, bits) if table.num_rows else _RESULT_ARROW.empty_table()

    known = exchange.totals(exchange.ask(texts, first), most=2)
    asked = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(second, exchange.REQUEST)
    windows = exchange.totals(asked, most=2)
    results = texts.groupBy("block").cogroup(known.unionByName(windows).groupBy("block")).applyInArrow(last, _RESULT)
    return rows.select("doc_id", "id").join(results, "id").drop("id")
