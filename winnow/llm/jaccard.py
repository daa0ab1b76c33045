"""Exact Jaccard join of shingle sets with adaptive multi-match prefixes.

All sets are ordered alike, by how many texts hold a shingle, rarest first. Two sets that have
``T`` shingles in common have ``l`` of them among the first ``size - T + l`` of each, for every
``l``. So a text with requirement ``l`` sends that prefix, and two texts are compared if their
prefixes share as many shingles as the lesser of both requirements. Each text picks its own:
a longer prefix costs more rows and leaves fewer candidates. Shingles that no other text has
are never sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from winnow.llm import exchange, linking
from winnow.llm.common import (
    LOWER, Rolling, block_count, chunks, mixed, once_per_task, slices, stored, text_buffers, text_id, word_spans)
from winnow.llm.minhash import components

SHINGLE, PERCENT = 5, 80
#: Requirements that a text picks from, and what comparing a shingle costs in joined rows.
LEVELS, VERIFY = (1, 2, 3, 4, 6, 8), 1 / 16
TOKEN, TOKEN_BITS = 1, 40
BLOCK_BYTES = 8 << 20
#: Shingles whose prefixes are made at once, unless one text has more.
SLICE = 1 << 17
_STEPS = mixed(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_PREFIX = pa.schema([("token", pa.int64()), ("id", pa.binary()), ("size", pa.int64()), ("room", pa.int64()), ("least", pa.int32()),
                     *[(b, pa.int64()) for b in linking.BITS]])
_PREFIX_DDL = f"token long, id binary, size long, room long, least int, {', '.join(f'{b} long' for b in linking.BITS)}"


def shingle_sets(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted within each, and where each text's begin.

    A text of fewer words than a shingle has all its words as one; a text without words none.
    """
    data, starts, ends = text_buffers(column)
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, stop in chunks(starts, ends):
        base = starts[first]
        lowered = LOWER[data[base:ends[stop - 1]]]
        begin, end, counts = word_spans(lowered, starts[first:stop] - base, ends[first:stop] - base)
        words = mixed(Rolling(lowered).spans(begin, end)) if len(begin) else np.zeros(0, np.uint64)
        n = np.where(counts == 0, 0, np.maximum(counts - SHINGLE + 1, 1))
        text = np.repeat(np.arange(len(counts)), n)
        edges = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + edges[text]
        total = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(SHINGLE):
                inside = at + k < edges[text + 1]
                total[inside] += words[at[inside] + k] * _STEPS[k]
        total = mixed(total)
        order = np.lexsort((total, text))
        total, text = total[order], text[order]
        new = np.concatenate([[True], (total[1:] != total[:-1]) | (text[1:] != text[:-1])]) if len(total) else np.zeros(0, bool)
        parts.append(total[new])
        sizes.append(np.bincount(text[new], minlength=len(counts)))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def requirements(held: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's requirement and the length of its prefix, by estimated cost.

    ``held`` tells of all sets' shingles, rarest first, how many texts hold each. A prefix
    costs a row per other holder. Of the holders of its most frequent shingle, as many are
    compared as have enough of the others too, taken as independent; at most all rows over ``l``.
    """
    common = np.concatenate([[0], np.cumsum(np.where(held > 1, held, 0))]).astype(np.float64)
    need = -(-PERCENT * sizes // 100)
    best, least, length = np.full(len(sizes), np.inf), np.ones(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for level in LEVELS:
        prefix = np.minimum(sizes - need + level, sizes)
        rows = common[starts + prefix] - common[starts]
        most = held[starts + prefix - 1].astype(np.float64)
        rate, term, fewer = np.maximum(rows / np.maximum(most, 1) - 1, 0), 1.0, 0.0
        for k in range(level - 1):
            term = np.exp(-rate) if k == 0 else term * rate / k
            fewer = fewer + term
        candidates = np.minimum(rows / level, most * (1 - fewer)) if level > 1 else rows
        cost = rows + VERIFY * sizes * candidates
        better = (need >= level) & (cost < best)
        best[better], least[better], length[better] = cost[better], level, prefix[better]
    return least, length


def _sets(table: pa.Table):
    """A block's ids and sets, each text once."""
    seen, keep = set(), []
    for k, key in enumerate(table.column("id").to_pylist()):
        if key not in seen:
            seen.add(key)
            keep.append(k)
    rows = table.take(pa.array(keep, pa.int64()))
    return rows.column("id").combine_chunks(), *shingle_sets(rows.column("text"))


def _prefixes(table: pa.Table, replies: pa.Table, bits: int) -> pa.Table:
    """The prefix of each text of a block, a row a shingle, and one without for the text itself."""
    ids, found, edges = _sets(table)
    totals = exchange.answers(replies, TOKEN)
    totals = totals[0].astype(np.int32) if totals is not None else np.zeros(0, np.int32)
    keys = np.unique(exchange.narrowed(found, bits, TOKEN_BITS))
    parts = []
    # Only shingles, keys and totals are held for the whole block; all else some texts at a time.
    for first, stop in chunks(edges[:-1], edges[1:], SLICE):
        own = found[edges[first]:edges[stop]]
        held = totals[np.searchsorted(keys, exchange.narrowed(own, bits, TOKEN_BITS))].astype(np.int64)
        parts.append(_sent(ids.slice(first, stop - first), own, edges[first:stop + 1] - edges[first], held))
    return pa.concat_tables([_PREFIX.empty_table(), *parts])


def _sent(ids: pa.Array, found: np.ndarray, edges: np.ndarray, held: np.ndarray) -> pa.Table:
    """Prefixes of some texts; ``held`` tells of each shingle how many texts hold it."""
    sizes, owner = np.diff(edges), np.repeat(np.arange(len(ids)), np.diff(edges))
    order = np.lexsort((found, held, owner))
    room = np.bincount(owner, weights=held > 1, minlength=len(ids)).astype(np.int64)
    full = np.flatnonzero(sizes > 0)
    least, length = requirements(held[order], edges[full], sizes[full])
    sent = np.zeros(len(ids), np.int64)
    sent[full] = np.where(100 * room[full] >= PERCENT * sizes[full], length, 0)
    needs = np.ones(len(ids), np.int64)
    needs[full] = least
    flips = np.zeros((len(ids), linking.WORDS), np.int64)
    flips[full] = linking.parity(found, edges[full])
    rank = np.arange(len(order)) - edges[owner]  # the order keeps texts together
    picked = np.flatnonzero((rank < sent[owner]) & (held[order] > 1))
    text = np.concatenate([np.arange(len(ids)), owner[picked]])
    tokens = np.concatenate([np.zeros(len(ids), np.int64), found[order[picked]].view(np.int64)])
    return pa.Table.from_arrays([
        pa.array(tokens, mask=np.arange(len(text)) < len(ids)), ids.take(pa.array(text)), pa.array(sizes[text]),
        pa.array(room[text]), pa.array(needs[text], pa.int32()), *[pa.array(flips[text, k]) for k in range(linking.WORDS)]], schema=_PREFIX)


@F.arrow_udf(BooleanType())
def _alike(left: pa.Array, right: pa.Array) -> pa.Array:
    found = []
    for _, *pair in slices(left, right):
        (a, a_edges), (b, b_edges) = map(shingle_sets, pair)
        for i, j, k, m in zip(a_edges, a_edges[1:], b_edges, b_edges[1:]):
            both = len(np.intersect1d(a[i:j], b[k:m], assume_unique=True))
            found.append(bool(both and 100 * both >= PERCENT * (j - i + m - k - both)))
    return pa.array(found, pa.bool_())


def prefixes(texts: DataFrame, total_bytes: int) -> DataFrame:
    """``token``, ``id``, ``size``, ``room``, ``least`` and parity bits of each text's prefix; without token once per text."""
    blocks = max(1, -(-total_bytes // BLOCK_BYTES))
    bits = exchange.part_bits(total_bytes)
    placed = texts.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def wanted(table: pa.Table) -> list[dict]:
        _, found, _ = _sets(table)
        keys, counts = np.unique(exchange.narrowed(found, bits, TOKEN_BITS), return_counts=True)
        return exchange.requests(table.column("block")[0].as_py(), TOKEN, keys, counts[None, :].astype(np.uint64), bits, TOKEN_BITS)

    def sent(table: pa.Table, replies: pa.Table) -> pa.Table:
        return _prefixes(table, replies, bits) if table.num_rows else _PREFIX.empty_table()

    totals = exchange.totals(exchange.ask(placed, wanted))
    return placed.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(sent, _PREFIX_DDL)


def jaccard_join(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    Two rows link if 80 % or more of the five-word shingles of either are shingles of both;
    the component is named by its least id. Fewer words are one shingle. A null text is
    empty; rows without words are alone, whatever else is empty. Null ids take part, and name a
    component only if it has no other. Rows that repeat count each; other columns are left out;
    no rows give none.
    """
    rows = docs.select("doc_id", text_id().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sent = stored(prefixes(once_per_task(rows), total), "prefixes")
    members = sent.where("token is not null").withColumn("central", F.col("room") / F.col("size"))
    roots = components(linking.links(rows, members, ["token"], PERCENT, _alike))
    sizes = sent.where("token is null").select("id", "size")
    # Ids first, so that a group of copies counts once.
    named = rows.groupBy("id").agg(F.min("doc_id").alias("first")).join(sizes, "id").join(roots, "id", "left").select(
        "id", "size", "first", F.coalesce("root", "id").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(least, "root").select("id", "size", "component")
    alone = F.col("size") == 0
    return rows.select("doc_id", "id").join(named, "id").select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
