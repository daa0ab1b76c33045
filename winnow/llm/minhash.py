"""Near-duplicate groups by Order MinHash.

The items of a text are its five-word shingles, each labelled with how often it came before.
A sketch takes the items with the smallest hashes and keeps them in the order of the text, so
two texts share it if they share the items and their order. Texts that share one of several
sketches are candidates, and compared by a banded alignment of their items unless links already
join them or bounds on their items rule it out (:mod:`winnow.llm.linking`). The groups are the
connected components of the confirmed links. Equal texts are one text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from winnow.llm import linking
from winnow.llm.common import (
    LOWER,
    Rolling,
    chunks,
    mixed,
    slices,
    stored,
    text_buffers,
    text_id,
    word_spans,
)

#: Texts at a similarity s share a sketch in 1 - (1 - s**PICKED)**SKETCHES of cases: 0.998 at 0.8, 0.04 at 0.3.
SHINGLE, SKETCHES, PICKED, PERCENT = 5, 16, 5, 80
LEAST = PERCENT / 100
#: Longs of parity bits: texts of 700 items that share a long passage fill fewer.
WORDS = 32
BITS = linking.bit_names(WORDS)
_STEPS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_LABEL = np.uint64(0xA0761D6478BD642F)


def items(column, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingles of all texts in order, and where each text's begin.

    Words are lower-cased. A text of fewer words than a shingle has one item, all its words;
    a text without words has none.
    """
    data, starts, ends = text_buffers(column)
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, stop in chunks(starts, ends):
        base = starts[first]
        lowered = LOWER[data[base:ends[stop - 1]]]
        begin, end, counts = word_spans(lowered, starts[first:stop] - base, ends[first:stop] - base)
        words = mixed(Rolling(lowered).spans(begin, end)) if len(begin) else np.zeros(0, np.uint64)
        n = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
        text = np.repeat(np.arange(len(counts)), n)
        edges = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + edges[text]
        with np.errstate(over="ignore"):
            total = np.zeros(len(at), np.uint64)
            for k in range(size):
                inside = at + k < edges[text + 1]
                total[inside] += words[at[inside] + k] * _STEPS[k]
            total = mixed(total)
            order = np.argsort(mixed(total + text.astype(np.uint64) * _LABEL), kind="stable")
            same = np.concatenate([[False], (total[order][1:] == total[order][:-1]) & (text[order][1:] == text[order][:-1])])
            place = np.arange(len(order))
            label = np.empty(len(order), np.uint64)
            label[order] = place - np.maximum.accumulate(np.where(same, 0, place))
            parts.append(mixed(total + label * _LABEL))
        sizes.append(n)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def sketches(found: np.ndarray, edges: np.ndarray, count: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """``count`` keys of each text that has items, one row per text.

    A key is made of the ``picked`` items of least hash, in the order of the text; of fewer
    items, of all.
    """
    full = np.flatnonzero(np.diff(edges) > 0)
    starts, sizes = edges[full], np.diff(edges)[full]
    keys = np.zeros((len(full), count), np.uint64)
    if not len(full):
        return keys
    owner = np.repeat(np.arange(len(full)), sizes)
    # Few items have a hash so low that it can be among the least; a text with too few of them is searched whole.
    low = np.where(sizes > 8 * picked, 2.0**64 * 4 * picked / sizes, 2.0**64 - 2048).astype(np.uint64)[owner]
    for r in range(count):
        hashes = mixed(found ^ _STEPS[r + 16])
        near = hashes <= low
        short = np.bincount(owner[near], minlength=len(full)) < np.minimum(sizes, picked)
        if short.any():
            near |= short[owner]
        near = np.flatnonzero(near)
        order = near[np.lexsort((hashes[near], owner[near]))]
        new = np.concatenate([[True], owner[order][1:] != owner[order][:-1]])
        place = np.arange(len(order))
        rank = place - np.maximum.accumulate(np.where(new, place, 0))
        chosen = np.sort(order[rank < picked])
        many = np.minimum(sizes, picked)
        at = np.cumsum(many) - many
        key = np.full(len(full), _STEPS[r], np.uint64)
        with np.errstate(over="ignore"):
            for k in range(picked):
                has = many > k
                key[has] = mixed(key[has] * _LABEL + found[chosen[at[has] + k]])
        keys[:, r] = key
    return keys


def similarity(left: np.ndarray, right: np.ndarray, least: float = LEAST) -> float:
    """Items that a monotone alignment matches, over all items of both; 0 where it is under ``least``.

    Labelled items are distinct within a text, so the best alignment is a longest increasing
    run of places. The band is as wide as ``least`` lets two matched places lie apart.
    """
    if not len(left) or not len(right):
        return float(len(left) == len(right))
    most = int(min(len(left), len(right)))
    if most < least * max(len(left), len(right)):
        return 0.0
    order = np.argsort(right)
    at = np.minimum(np.searchsorted(right, left, sorter=order), len(right) - 1)
    there = order[at]
    hit = right[there] == left
    band = int((len(left) + len(right)) * (1 - 2 * least / (1 + least))) + 1
    place = np.flatnonzero(hit)
    there = there[hit]
    there = there[np.abs(there - place) <= band]
    need = least / (1 + least) * (len(left) + len(right))
    if len(there) < need - 1e-9:
        return 0.0
    if np.all(there[1:] > there[:-1]):
        matched = len(there)
    else:
        tails: list[int] = []
        for k in there.tolist():
            spot = bisect_left(tails, k)
            tails[spot:spot + 1] = [k]
        matched = len(tails)
    share = matched / (len(left) + len(right) - matched)
    return share if share >= least - 1e-12 else 0.0


_SKETCHED = f"id binary, size long, keys array<long>, {', '.join(f'{b} long' for b in BITS)}"


def _sketched(rows: DataFrame) -> DataFrame:
    """``id``, item count ``size``, parity bits and sketch ``keys`` of each text with items; a text that a task meets again is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            ids_ = batch.column("id").to_pylist()
            new = [k for k, key in enumerate(ids_) if not (key in seen or seen.add(key))]
            batch = batch.take(pa.array(new, pa.int64())) if len(new) < len(ids_) else batch
            for row, texts in slices(batch.column("text")):
                found, edges = items(texts)
                keys = sketches(found, edges)
                full = np.flatnonzero(np.diff(edges) > 0)
                bits = linking.parity(found, edges[full], WORDS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(row + full)), pa.array(np.diff(edges)[full], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * SKETCHES, pa.int32()), pa.array(keys.view(np.int64).ravel())),
                     *[pa.array(bits[:, k]) for k in range(WORDS)]], ["id", "size", "keys", *BITS])

    return rows.mapInArrow(run, _SKETCHED)


@F.arrow_udf(BooleanType())
def _alike(left: pa.Array, right: pa.Array) -> pa.Array:
    found = []
    for _, *pair in slices(left, right):
        (a, a_edges), (b, b_edges) = map(items, pair)
        found += [similarity(a[i:j], b[k:m]) > 0 for i, j, k, m in zip(a_edges, a_edges[1:], b_edges, b_edges[1:])]
    return pa.array(found, pa.bool_())


def _links(rows: DataFrame) -> DataFrame:
    """Confirmed pairs ``a``, ``b`` of text ids: chains of them join all texts that share a sketch and are alike."""
    sketched = stored(_sketched(rows), "sketches")
    buckets = sketched.select("id", F.posexplode("keys").alias("number", "key"))
    crowded = buckets.groupBy("number", "key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    members = stored(buckets.join(crowded.select("number", "key"), ["number", "key"]).distinct(), "members")
    marks = sketched.drop("keys").join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    members = members.join(marks, "id").withColumns({"room": F.col("size"), "least": F.lit(1)})
    return linking.links(rows, members, ["number", "key"], PERCENT, _alike)


def components(links: DataFrame) -> DataFrame:
    """``id`` and the least id ``root`` of its connected component, for every linked id.

    Every round hangs the larger neighbours of a node under its least one, then the node
    itself and its smaller neighbours, until nothing changes.
    """

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    before = None
    while True:
        edges = stored(edges, "edges")
        now = state(edges)
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        larger = stored(larger.distinct(), "edges")
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = smaller.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def text_groups(docs: DataFrame) -> DataFrame:
    """``id`` (of a text) and ``root`` for the texts that are near-duplicates of another."""
    rows = docs.select(text_id().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return components(_links(rows))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``class_id`` (the least id of its group) and ``class_size`` of every row.

    Texts are near-duplicates if their five-word shingles, in order, agree to 0.8 or more.
    Null is empty; texts without words are alike only if equal; repeated rows are one group.
    Null ids count in their group; a group of null ids has a null class. Other columns are
    left out; no rows give none.
    """
    rows = docs.select("doc_id", text_id().alias("id"))
    # Ids first, so that a group of copies counts once.
    texts = rows.groupBy("id").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).join(
        text_groups(docs), "id", "left").withColumn("root", F.coalesce("root", "id"))
    classes = texts.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    named = texts.select("id", "root").join(classes, "root").select("id", "class_id", "class_size")
    return rows.join(named, "id").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of the least id of each group, all columns; of rows that repeat, one.

    Rows that share both id and text are one row here. Null ids are least.
    """
    own = text_id().alias("_id")
    counted = docs.select("doc_id", own).groupBy("doc_id", "_id").agg(F.count("*").alias("n"))
    texts = counted.groupBy("_id").agg(F.min(F.struct("doc_id", "n")).alias("least")).join(
        text_groups(docs).withColumnRenamed("id", "_id"), "_id", "left")
    kept = texts.groupBy(F.coalesce("root", "_id")).agg(F.min(F.struct("least.doc_id", "_id", "least.n")).alias("kept")).select(
        F.col("kept.doc_id").alias("_doc"), F.col("kept._id").alias("_text"), F.col("kept.n").alias("_n"))

    # All columns as one, so that none of theirs meets one of ours.
    whole = docs.select(F.struct("*").alias("_row"), text_id().alias("_id"), F.col("doc_id").alias("_own"))

    def rows_of(wanted: DataFrame) -> DataFrame:
        return whole.join(
            wanted.hint("shuffle_hash"), (F.col("_id") == F.col("_text")) & F.col("_own").eqNullSafe(F.col("_doc")))

    alone, repeated = rows_of(kept.where("_n = 1")), rows_of(kept.where("_n > 1")).dropDuplicates(["_id", "_doc"])
    return alone.unionByName(repeated).select("_row.*")
