"""Corpus-wide counts of 64-bit keys, brought back to the blocks of text that hold them.

A block sends each key it holds once, with how often it holds it; keys are dealt out by their
upper bits, added up, and the sums go back to the blocks in the keys' order. A key that a
third of the corpus repeats is one entry per block, so no task gets more than its share.
Only numbers travel: sorted keys as byte planes of their differences, counts deflated.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

REQUEST = "block int, kind int, part int, keys binary, counts binary"
REPLY = "block int, kind int, part int, totals binary, stats array<long>"
REQUEST_ARROW = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()),
                           ("keys", pa.binary()), ("counts", pa.binary())])
_REPLY_ARROW = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()),
                          ("totals", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _planes(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8).T
    used = int(values.max()).bit_length() + 7 >> 3 if len(values) else 0
    return bytes([used]) + planes[:used].tobytes()


def _values(packed: bytes, size: int) -> np.ndarray:
    used = packed[0]
    planes = np.zeros((size, 8), np.uint8)
    planes[:, :used] = np.frombuffer(packed, np.uint8, used * size, 1).reshape(used, size).T
    return planes.view(np.uint64).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return len(keys).to_bytes(8, "little") + _planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_values(packed[8:], int.from_bytes(packed[:8], "little")), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Rows of counts, all of one length."""
    rows, size = counts.shape
    return bytes([rows]) + size.to_bytes(8, "little") + zlib.compress(_planes(counts.ravel()), 1)


def unpack_counts(packed: bytes) -> np.ndarray:
    rows, size = packed[0], int.from_bytes(packed[1:9], "little")
    return _values(zlib.decompress(packed[9:]), rows * size).reshape(rows, size)


def narrowed(keys: np.ndarray, part_bits: int, width: int) -> np.ndarray:
    """Keys cut to ``part_bits`` that choose the part and ``width`` more bits."""
    return keys >> np.uint64(max(0, 64 - part_bits - width))


def requests(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, part_bits: int,
             width: int) -> list[dict]:
    """What a block asks about its distinct narrowed keys, sorted; ``counts`` has a row per count."""
    width = min(width, 64 - part_bits)
    edges = np.searchsorted(keys, np.arange(1, 1 << part_bits, dtype=np.uint64) << np.uint64(width))
    edges = np.concatenate([[0], edges, [len(keys)]])
    rows = []
    for part in np.flatnonzero(np.diff(edges)):
        a, b = edges[part], edges[part + 1]
        rows.append({"block": block, "kind": kind, "part": int(part),
                     "keys": pack_keys(keys[a:b] - (np.uint64(part) << np.uint64(width))),
                     "counts": pack_counts(counts[:, a:b])})
    return rows


def totals(asked: DataFrame, most: int | None = None) -> DataFrame:
    """The sums over all blocks for every request, in the order of its keys.

    ``stats`` of one reply per part holds how many keys have a count and the sum of each
    count; of the others it is null. ``most`` caps the sums that are sent back, where only
    small ones matter.
    """

    def add(table: pa.Table) -> pa.Table:
        keys = [unpack_keys(k) for k in table.column("keys").to_pylist()]
        counts = [unpack_counts(c) for c in table.column("counts").to_pylist()]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        every = np.concatenate(counts, axis=1)
        sums = np.stack([np.bincount(place, weights=row) for row in every.astype(np.float64)]).astype(np.uint64)
        stats = [int((sums.sum(axis=0) > 0).sum()), *(int(s) for s in sums.sum(axis=1))]
        sent = sums if most is None else np.minimum(sums, np.uint64(most))
        edges = np.cumsum([0, *map(len, keys)])
        packed = [pack_counts(sent[:, place[a:b]]) for a, b in zip(edges, edges[1:])]
        return pa.Table.from_arrays([
            *[table.column(c).combine_chunks() for c in ("block", "kind", "part")],
            pa.array(packed, pa.binary()),
            pa.array([stats] + [None] * (len(packed) - 1), pa.list_(pa.int64()))], schema=_REPLY_ARROW)

    return asked.groupBy("kind", "part").applyInArrow(add, REPLY)


def answers(table: pa.Table, kind: int) -> np.ndarray | None:
    """The sums for all of a block's keys of a kind, a row per count, from its replies."""
    rows = table.filter(pa.compute.equal(table.column("kind"), kind)).sort_by("part")
    found = [unpack_counts(t) for t in rows.column("totals").to_pylist()]
    return np.concatenate(found, axis=1) if found else None


def ask(texts: DataFrame, make: Callable[[pa.Table], list[dict]]) -> DataFrame:
    """Requests of every block; ``make`` gets a block's rows."""

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(make(table), REQUEST_ARROW)

    return texts.groupBy("block").applyInArrow(run, REQUEST)


def part_bits(total_bytes: int, per_part: int = 16 << 20) -> int:
    """Bits that deal out keys so that a part's share of the text is about ``per_part`` bytes."""
    return max(0, (max(total_bytes, 1) - 1) // per_part).bit_length()
