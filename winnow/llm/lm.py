"""LM scoring by deleted interpolation.

The probability of a token is a mixture of its maximum-likelihood estimates given the two
tokens before it, given one, given nothing, and of the uniform one. The weights depend on the
longest context that was seen and how often it was, in buckets of powers of two, and are
learned by expectation-maximisation on a part of the training documents that the estimates
leave out (the deleted part). Then the counts of both parts are added up and every document
is scored.

N-grams are 64-bit hashes; those of two and three tokens travel as 40 bits beside the bits
that choose their part, whose size doesn't grow with the corpus, so one meets another by
chance about once in a million.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm import exchange
from winnow.llm.common import LOWER, Rolling, chunks, mixed, remainder, stored, text_buffers, word_spans

#: Keys of the end token, and of what stands before a text's first token.
_END, _BEGIN = np.uint64(0x5EED0000000000E1), np.uint64(0x5EED0000000000B1)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
WIDTHS = {1: 64, 2: 40, 3: 40}
ORDER = 3
BLOCK_BYTES = 12 << 20
#: crc32(doc_id) mod 10: scored only, and left out of the estimates that set the weights.
HELD_OUT, DELETED = 0, 1
BASE_ADD = 0.1
MOST_BUCKETS = 48

SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
_SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                           ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all texts' tokens, each text closed by the end token, and where each text begins."""
    data, starts, ends = text_buffers(column)
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, stop in chunks(starts, ends):
        base = starts[first]
        lowered = LOWER[data[base:ends[stop - 1]]]
        begin, end, counts = word_spans(lowered, starts[first:stop] - base, ends[first:stop] - base)
        found = mixed(Rolling(lowered).spans(begin, end)) if len(begin) else np.zeros(0, np.uint64)
        parts.append(np.insert(found, np.cumsum(counts), _END))
        sizes.append(counts + 1)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


@dataclass
class Grams:
    """A block's n-grams: each token's place among the distinct keys of a length.

    ``keys`` and ``counts`` are empty where a block only reads its replies.
    """

    edges: np.ndarray
    keys: dict[int, np.ndarray]
    counts: dict[int, np.ndarray]
    places: dict[int, np.ndarray]
    begins: np.ndarray


def grams(table: pa.Table, bits: int, order: int, count: bool = False) -> Grams:
    """N-grams of up to ``order`` tokens that end at each token; at a text's first, those of two at most."""
    found, edges = tokens(table.column("text"))
    group = np.asarray(table.column("remainder").combine_chunks())
    by_token = np.repeat(group, np.diff(edges))
    keys, counts, places, gram = {}, {}, {}, found
    for kind in range(1, order + 1):
        rows, groups = gram, by_token
        if kind == 1:
            rows, groups = np.append(found, np.full(len(group), _BEGIN)), np.append(by_token, group)
        else:
            before = np.empty_like(gram)
            before[1:] = gram[:-1]
            before[edges[:-1]] = _BEGIN
            with np.errstate(over="ignore"):
                rows = gram = mixed(before * _PAIR + found)
        distinct, place = np.unique(exchange.narrowed(rows, bits, WIDTHS[kind]), return_inverse=True)
        places[kind] = place.astype(np.int32)
        if not count:
            continue
        keys[kind] = distinct
        fit = (groups != HELD_OUT) & (groups != DELETED)
        counts[kind] = np.stack([np.bincount(places[kind][m], minlength=len(distinct))
                                 for m in (fit, groups == DELETED)]).astype(np.uint64)
    begins = places[1][len(found):]
    places[1] = places[1][:len(found)]
    return Grams(edges, keys, counts, places, begins)


def estimates(found: Grams, counts: dict[int, np.ndarray], size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each token's bucket and its estimates, given nothing first, then given ever more tokens.

    ``counts`` are those of the block's distinct keys, ``size`` is the number of all tokens.
    """
    bucket = np.zeros(len(found.places[1]), np.int64)
    own = counts[1][found.places[1]].astype(np.float64)
    chances = [own / max(size, 1)]
    for kind in range(2, len(counts) + 1):
        context = np.empty_like(own)
        context[1:] = own[:-1]
        context[found.edges[:-1]] = counts[1][found.begins]
        own = counts[kind][found.places[kind]].astype(np.float64)
        chances.append(np.minimum(own / np.maximum(context, 1), 1.0))
        longer = (kind - 2) * MOST_BUCKETS + bucket_of(context)
        bucket = longer if kind == 2 else np.where(context > 0, longer, bucket)
    return bucket, chances


def bucket_of(context_count: np.ndarray) -> np.ndarray:
    """The bucket of a context's count: its binary length."""
    return np.minimum(np.frexp(context_count.astype(np.float64))[1], MOST_BUCKETS - 1)


def learn_weights(seen: DataFrame, order: int, rounds: int = 12) -> np.ndarray:
    """Mixture weights per bucket by expectation-maximisation; uniform, single and longer.

    ``seen`` has ``bucket``, the estimates ``p0`` to ``p<order>`` and how often each such token
    was seen, ``n``. Buckets without a token keep the even start.
    """
    names = [f"p{k}" for k in range(order + 1)]
    weights = np.full(((order - 1) * MOST_BUCKETS, order + 1), 1 / (order + 1))
    for _ in range(rounds):
        share = [F.get(F.array(*map(F.lit, weights[:, k].tolist())), F.col("bucket")) * F.col(name)
                 for k, name in enumerate(names)]
        shared = seen.select("bucket", "n", *[s.alias(name) for s, name in zip(share, names)])
        total = sum((F.col(name) for name in names[1:]), F.col("p0"))
        rows = shared.groupBy("bucket").agg(*[F.sum(F.col("n") * F.col(name) / total).alias(name) for name in names])
        new = weights.copy()
        for row in rows.collect():  # at most MOST_BUCKETS for each length
            sums = np.array([row[name] for name in names])
            new[row.bucket] = sums / sums.sum()
        done = np.abs(new - weights).max() < 1e-3
        weights = new
        if done:
            break
    return weights


def _blocks(docs: DataFrame, total: int) -> DataFrame:
    """Documents dealt out into blocks; the deleted part has blocks of its own."""
    of_all = max(1, -(-total * 9 // 10 // BLOCK_BYTES))
    of_deleted = max(1, -(-total // 10 // BLOCK_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       remainder("doc_id", 10).cast("int").alias("remainder"))
    number = F.xxhash64("doc_id", "text")
    block = F.when(F.col("remainder") == DELETED, of_all + F.pmod(number, F.lit(of_deleted))).otherwise(
        F.pmod(number, F.lit(of_all))).cast("int")
    return rows.withColumn("block", block)


def score(docs: DataFrame, *, rounds: int = 12, order: int = ORDER) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens`` and both log10 scores.

    Documents with crc32(doc_id) mod 10 = 0 are held out of training. A null text is empty:
    its one token is the end. A null id counts as empty text for the remainder. Repeated rows
    count and are scored each; other columns are left out; no rows give none. Without any
    training token both scores are those of the uniform distribution over the end token.
    ``order`` is 2 or 3, the most tokens of an n-gram.
    """
    kinds = range(1, order + 1)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = exchange.part_bits(total)
    placed = _blocks(docs, total)

    def wanted(table: pa.Table) -> list[dict]:
        block, found = table.column("block")[0].as_py(), grams(table, bits, order, count=True)
        return [row for kind in kinds for row in exchange.requests(
            block, kind, found.keys[kind], found.counts[kind], bits, WIDTHS[kind])]

    replies = stored(exchange.totals(exchange.ask(placed, wanted)), "ngrams")
    sums = (replies.where("kind = 1 and stats is not null")
            .agg(*[F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(3)]).first())
    groups = placed.groupBy((F.col("remainder") == HELD_OUT).alias("out"), (F.col("remainder") == DELETED).alias(
        "deleted")).count().collect()
    fit_docs = sum(r["count"] for r in groups if not r.out and not r.deleted)
    deleted_docs = sum(r["count"] for r in groups if r.deleted)
    # The mark before a text is no token: each training document has one.
    fit_tokens = (sums.s1 or 0) - fit_docs
    train_tokens = fit_tokens + (sums.s2 or 0) - deleted_docs
    distinct = (sums.s0 or 0) - (1 if fit_docs + deleted_docs else 0)
    uniform = 1 / (distinct + 1)

    names = [f"p{k}" for k in kinds]
    seen_schema = pa.schema([("bucket", pa.int32()), *[(name, pa.float64()) for name in names], ("n", pa.int64())])

    def seen(text: pa.Table, reply: pa.Table) -> pa.Table:
        if not text.num_rows:
            return seen_schema.empty_table()
        found = grams(text, bits, order)
        bucket, chances = estimates(found, {k: exchange.answers(reply, k)[0] for k in kinds}, fit_tokens)
        columns = [bucket, *chances]
        by = np.lexsort(columns[::-1])
        columns = [c[by] for c in columns]
        new = np.flatnonzero(np.append(True, np.any([np.diff(c) != 0 for c in columns], axis=0)))
        n = np.diff(np.append(new, len(bucket)))
        return pa.Table.from_arrays([pa.array(c[new], f.type) for c, f in zip(columns, seen_schema)]
                                    + [pa.array(n, pa.int64())], schema=seen_schema)

    of_all = max(1, -(-total * 9 // 10 // BLOCK_BYTES))
    tuples = placed.where(F.col("remainder") == DELETED).groupBy("block").cogroup(
        replies.where(F.col("block") >= of_all).groupBy("block")).applyInArrow(
            seen, f"bucket int, {', '.join(f'{name} double' for name in names)}, n long")
    tuples = stored(tuples, "deleted").withColumn("p0", F.lit(uniform))
    weights = learn_weights(tuples, order, rounds)

    def rate(text: pa.Table, reply: pa.Table) -> pa.Table:
        if not text.num_rows:
            return _SCORES_ARROW.empty_table()
        found = grams(text, bits, order)
        counts = {k: exchange.answers(reply, k).sum(axis=0) for k in kinds}
        bucket, chances = estimates(found, counts, train_tokens)
        model = weights[bucket, 0] * uniform
        for k, chance in enumerate(chances, 1):
            model += weights[bucket, k] * chance
        model = np.log10(model)
        own = counts[1][found.places[1]].astype(np.float64)
        base = np.log10((own + BASE_ADD) / (train_tokens + BASE_ADD * (distinct + 1)))
        first = found.edges[:-1]
        return pa.Table.from_arrays([
            text.column("doc_id").combine_chunks(),
            pa.array(np.asarray(text.column("remainder").combine_chunks()) == HELD_OUT),
            pa.array(np.diff(found.edges), pa.int64()), pa.array(np.add.reduceat((own > 0).astype(np.int64), first)),
            pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(model, first))], schema=_SCORES_ARROW)

    scored = placed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(rate, SCORES)
    return scored.withColumn("train_tokens", F.lit(train_tokens).cast("long"))
