"""Phrases whose words occur together more than apart, from a weighted de Bruijn graph.

Every place of a text starts an edge: its next four words, or fewer where its piece ends. An
edge of four words joins two overlapping nodes of three; a shorter one is a piece-end
correction. How often a shorter phrase occurs is the flow through its node: the sum of the
edges that begin with it, corrections included. So one table of edges holds all counts.

Only phrases of ``LEAST`` occurrences matter, so an edge also ends where the phrase it would
become is rarer; phrases are counted by hashes first, which never count too few. Each block of text
adds its edges up and compacts unary paths (edges of one count whose inner nodes have one edge
in and one out) to runs of words, so a passage leaves a block once, not once per place.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm import exchange
from winnow.llm.common import LOWER, Rolling, block_count, chunks, mixed, spread, stored, text_buffers, word_spans

LONGEST, LEAST, TOP = 4, 30, 2000
#: A phrase inside a longer one with at least this share of its occurrences is part of that one.
PART = 80
SCALE = 2_000_000
#: Hashes of phrases, beside the bits that choose their part: about one in a hundred meets another by chance.
HASH_BITS = 28
BLOCK_BYTES = 6 << 20
#: Places that are hashed at once, so that only what outlives a step takes memory for each of a block's places.
STEP = 1 << 16
_BREAKS = np.isin(np.arange(256), list(b".,;:!?\n\v\f\r"))
_APART = _BREAKS | np.isin(np.arange(256), list(b" \t"))
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_PATHS = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("n", pa.int64())])


def words_of(table: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Distinct words and each place's word, languages and each place's language, and where a piece goes on."""
    langs = table.column("lang").combine_chunks().dictionary_encode()
    data, starts, ends = text_buffers(table.column("text"))
    parts, lang, more = [], [np.zeros(0, np.int32)], [np.zeros(0, bool)]
    for first, stop in chunks(starts, ends):
        base = starts[first]
        own = LOWER[data[base:ends[stop - 1]]]
        begin, end, sizes = word_spans(own, starts[first:stop] - base, ends[first:stop] - base, _APART)
        text = np.repeat(np.arange(stop - first), sizes)
        breaks = np.cumsum(_BREAKS[own], dtype=np.int32)
        follows = np.zeros(len(begin), bool)
        follows[:-1] = (breaks[begin[1:]] == breaks[begin[:-1]]) & (text[1:] == text[:-1])
        offsets = np.concatenate([[0], np.cumsum(end - begin)])
        parts.append(pa.LargeStringArray.from_buffers(
            len(begin), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(own[~_APART[own]]))))
        lang.append(np.asarray(langs.indices)[first:stop][text])
        more.append(follows)
    parts = parts or [pa.array([], pa.large_string())]
    coded = pa.chunked_array(parts, pa.large_string()).dictionary_encode().unify_dictionaries()
    at = np.concatenate([np.asarray(chunk.indices) for chunk in coded.chunks])
    return coded.chunk(coded.num_chunks - 1).dictionary, at, langs.dictionary, np.concatenate(lang), np.concatenate(more)


def _hashes(strings: pa.Array) -> np.ndarray:
    data, starts, ends = text_buffers(strings)
    found = [np.zeros(0, np.uint64)]
    for first, stop in chunks(starts, ends, 4 * STEP):
        base = starts[first]
        found.append(mixed(Rolling(data[base:ends[stop - 1]]).spans(starts[first:stop] - base, ends[first:stop] - base)))
    return np.concatenate(found)


def _hashed(words: pa.Array, at: np.ndarray, langs: pa.Array, lang: np.ndarray, more: np.ndarray, bits: int):
    """For each size from two words on, the places whose piece goes on so far, and the hashes of these phrases."""
    of_word, of_lang, size = _hashes(words), _hashes(langs), len(at)
    total, reach = np.empty(size, np.uint64), np.ones(size, bool)
    with np.errstate(over="ignore"):
        for a in range(0, size, STEP):
            total[a:a + STEP] = mixed(of_lang[lang[a:a + STEP]] + of_word[at[a:a + STEP]] * _LEFT)
        for k in range(1, LONGEST):
            inside = max(size - k + 1, 0)
            reach[:inside] &= more[k - 1:]
            reach[inside:] = False
            first = np.flatnonzero(reach).astype(np.int32)
            keys = np.empty(len(first), np.uint64)
            for a in range(0, len(first), STEP):
                own = first[a:a + STEP]
                keys[a:a + STEP] = total[own] = mixed(total[own] * _RIGHT + of_word[at[own + k]] * _LEFT)
            yield k + 1, first, exchange.narrowed(keys, bits, HASH_BITS)


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """A number for each row, equal for rows that are equal in all columns, by rising rows."""
    place, most = np.zeros(len(columns[0]), np.int64), 1
    for column in columns:
        width = int(column.max(initial=0)) + 2
        if most * width > 1 << 62:
            found, place = np.unique(place, return_inverse=True)
            most = len(found)
        place *= width
        place += column
        place += 1
        most *= width
    return place


def _coded(*columns: np.ndarray) -> np.ndarray:
    """Such a number, from 0 on without gaps."""
    return np.unique(_numbered(*columns), return_inverse=True)[1]


def compacted(edges: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Languages of all paths, their words in a row, how many words each has, and its count.

    ``edges`` are distinct rows of a language and four words. Two join if one's last three
    words are the other's first, no other edge enters or leaves there, and both counts are
    equal. A path that closes on itself stays in edges.
    """
    size = len(edges)
    nodes = _coded(*np.concatenate([edges[:, :-1], edges[:, [0, 2, 3, 4]]]).T)
    start, end = nodes[:size], nodes[size:]
    most = int(nodes.max(initial=-1)) + 1
    enters, leaves, by_start = np.bincount(end, minlength=most), np.bincount(start, minlength=most), np.full(most, -1)
    by_start[start] = np.arange(size)
    after = np.where((enters[end] == 1) & (leaves[end] == 1), by_start[end], -1)
    after = np.where((after >= 0) & (counts[after] == counts), after, -1)
    before = np.full(size, -1)
    before[after[after >= 0]] = np.flatnonzero(after >= 0)
    # Every edge finds its path's head by doubling; what finds none lies on a circle.
    head, steps = np.where(before >= 0, before, np.arange(size)), (before >= 0).astype(np.int64)
    for _ in range(size.bit_length()):
        steps, head = steps + steps[head], head[head]
    circle = before[head] >= 0
    head[circle], steps[circle] = np.flatnonzero(circle), 0
    order = np.lexsort((steps, head))
    opens = steps[order] == 0
    kept = np.where(opens, LONGEST, 1)
    ends_at = np.cumsum(kept)
    words = np.empty(int(ends_at[-1]) if size else 0, np.int64)
    words[ends_at - 1] = edges[order, LONGEST]
    for k in range(1, LONGEST):
        words[ends_at[opens] - 1 - LONGEST + k] = edges[order[opens], k]
    sizes = np.add.reduceat(kept, np.flatnonzero(opens)) if size else kept
    return edges[order[opens], 0], words, sizes, counts[order[opens]]


def _paths(table: pa.Table, replies: pa.Table, bits: int) -> pa.Table:
    """A block's paths, and its shorter edges."""
    words, at, langs, lang, more = words_of(table)
    # The next words of each place, -1 from where its edge ends.
    rows, reach = [lang, at], np.ones(len(at), bool)
    for size, first, keys in _hashed(words, at, langs, lang, more, bits):
        totals, often = exchange.answers(replies, size), np.zeros(len(at), bool)
        if totals is not None:
            frequent = np.sort(keys)  # quicker than a search for distinct keys
            frequent = frequent[np.append(True, frequent[1:] != frequent[:-1])][totals[0] >= LEAST]
            for a in range(0, len(keys) if len(frequent) else 0, STEP):
                own = keys[a:a + STEP]
                found = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                often[first[a:a + STEP]] = frequent[found] == own
        reach &= often
        own = np.flatnonzero(reach)
        following = np.full(len(at), -1, np.int32)
        following[own] = at[own + size - 1]
        rows.append(following)
    _, sample, counts = np.unique(_numbered(*rows), return_index=True, return_counts=True)
    found = np.stack([row[sample] for row in rows], axis=1).astype(np.int64)
    whole = found[:, -1] >= 0
    own, flat, sizes, n = compacted(found[whole], counts[whole])
    rest = found[~whole]
    sizes = np.concatenate([sizes, (rest[:, 1:] >= 0).sum(axis=1)])
    flat = np.concatenate([flat, rest[:, 1:][rest[:, 1:] >= 0]])
    return pa.Table.from_arrays([
        langs.take(pa.array(np.concatenate([own, rest[:, 0]]))).cast(pa.string()),
        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), words.take(pa.array(flat)).cast(pa.string())),
        pa.array(np.concatenate([n, counts[~whole]]), pa.int64())], schema=_PATHS)


def edges(docs: DataFrame) -> DataFrame:
    """``lang``, ``w1`` to ``w4`` (null from where the edge ends) and ``n``: all places, added up.

    An edge is the longest phrase from its place that its language has ``LEAST`` times, by hashes.
    """
    own = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = block_count(own, BLOCK_BYTES)
    bits = exchange.part_bits(blocks * BLOCK_BYTES)
    placed = spread(own, blocks).select("block", "lang", "text")

    def wanted(table: pa.Table) -> list[dict]:
        block, found = table.column("block")[0].as_py(), []
        for size, _, keys in _hashed(*words_of(table), bits):
            keys, counts = np.unique(keys, return_counts=True)
            found += exchange.requests(block, size, keys, counts[None, :].astype(np.uint64), bits, HASH_BITS)
        return found

    def paths(table: pa.Table, replies: pa.Table) -> pa.Table:
        return _paths(table, replies, bits) if table.num_rows else _PATHS.empty_table()

    totals = exchange.totals(exchange.ask(placed, wanted), most=LEAST)
    found = placed.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(paths, "lang string, words array<string>, n long")
    place = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - LONGEST, F.lit(0))))
    return found.select("lang", "words", "n", place.alias("at")).groupBy(
        "lang", *[F.get("words", F.col("at") + k).alias(f"w{k + 1}") for k in range(LONGEST)]).agg(F.sum("n").alias("n"))


def _phrase(first: int, last: int) -> Column:
    return F.concat_ws(" ", *[f"w{k}" for k in range(first, last + 1)])


def _wide(column: Column | str) -> Column:
    return F.col(column).cast("decimal(20,0)") if isinstance(column, str) else column.cast("decimal(20,0)")


def counts(edges: DataFrame) -> DataFrame:
    """``lang``, words ``w1`` to ``w4``, their number ``size`` and occurrences ``f`` of every phrase with ``LEAST`` or more.

    The flow through a node is the sum over the next longer phrases, and over the edges that end with it.
    """
    names, found = [f"w{k}" for k in range(1, LONGEST + 1)], []
    for size in range(LONGEST, 0, -1):
        flow = edges.where(F.col(names[size - 1]).isNotNull()).groupBy("lang", *names[:size]).agg(F.sum("n").alias("f"))
        found.append(flow.where(F.col("f") >= LEAST).select(
            "lang", *names[:size], *[F.lit(None).cast("string").alias(w) for w in names[size:]], F.lit(size).alias("size"), "f"))
    return reduce(DataFrame.unionByName, found)


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """``lang rank phrase a l r n score`` of each language's ``top`` phrases of two to four words.

    ``a`` is how often the phrase occurs, 30 times at least; ``l`` and ``r`` how often its
    parts do, at the cut that binds it least; ``score`` is ``floor(2000000 a / (l + r))`` and
    ``n`` the words of the language. Phrases of which 80 % or more lie in one longer phrase
    are left out. ASCII letters are lower-cased; pieces end at ``. , ; : ! ?`` and line ends.
    A null text is empty, a null language ``und``; null ids don't matter, repeated rows count
    each time, other columns are left out; no rows give none. Equal scores go by ``a``, then
    by the phrase's bytes.
    """
    flows = stored(edges(docs), "edges")
    known = stored(counts(flows), "phrases")
    every = known.select("lang", F.col("size"), _phrase(1, LONGEST).alias("phrase"), "f")
    phrases = known.where("size > 1").withColumn("phrase", _phrase(1, LONGEST))

    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    words = F.array(*[f"w{k}" for k in range(1, LONGEST + 1)])
    cuts = phrases.select("lang", "phrase", "f", "size", words.alias("words"), cut.alias("k")).select(
        "lang", "phrase", "f", "k", F.concat_ws(" ", F.slice("words", F.lit(1), F.col("k"))).alias("left"),
        F.concat_ws(" ", F.slice("words", F.col("k") + 1, F.col("size") - F.col("k"))).alias("right"))
    part = every.where(F.col("size") < LONGEST)
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    bound = F.expr(f"(cast(f as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + r)")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(bound.alias("score"), "k", "l", "r")).alias("best"), F.first("f").alias("a"))

    def inside(size: int) -> Column:
        """All phrases of ``size`` words that lie in a longer one."""
        starts = F.sequence(F.lit(1), F.greatest(F.col("size") - size + 1, F.lit(1)))
        held = F.transform(starts, lambda at: F.concat_ws(" ", F.slice("words", at, size)))
        return F.when(F.col("size") > size, held).otherwise(F.array().cast("array<string>"))

    inner = F.explode(F.flatten(F.array(*map(inside, range(2, LONGEST)))))
    longer = phrases.where("size > 2").select("lang", "f", "size", words.alias("words")).select("lang", "f", inner.alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    alone = best.join(longer, ["lang", "phrase"], "left").where(
        F.col("within").isNull() | (_wide("within") * 100 < _wide("a") * PART))

    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sizes = flows.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"),
        F.col("best.r").alias("r"), "n", F.col("best.score").cast("long").alias("score"))
