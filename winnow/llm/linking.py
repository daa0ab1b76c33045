"""Links between texts that share buckets, without all pairs of a bucket.

Members of a bucket first meet one leader, so copies of one original become one group with a
link each. After two such rounds only members of different groups can still need a link. Those
outside a bucket's largest group meet all others of it, and most pairs end in the join's own
condition: two set sizes and the parity bits of two sets bound what they can share, so a pair
that can't be alike is never a row. The bounds never lose a pair that is alike.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import mixed, once_per_task, stored

#: Longs of parity bits of a set, unless an operator asks for more; a power of two.
WORDS = 8
_SALT = np.uint64(0x8EBC6AF09C88C6E3)


def bit_names(words: int = WORDS) -> list[str]:
    return [f"bits{k}" for k in range(words)]


BITS = bit_names()


def parity(found: np.ndarray, starts: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Parity bits of sets that lie one after another, none empty, a row of longs each.

    Every element flips one bit. Two sets differ in as many elements as bits at least.
    """
    spot = mixed(found ^ _SALT)
    word, bit = spot >> np.uint64(65 - words.bit_length()), np.uint64(1) << (spot & np.uint64(63))
    rows = [np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), starts) if len(starts) else np.zeros(0, np.uint64)
            for k in range(words)]
    return np.stack(rows, axis=1).view(np.int64)


def possible(percent: int, left: str = "x", right: str = "y", bits: Sequence[str] = BITS) -> Column:
    """Whether two sets can have ``percent`` of their union in common.

    Each side has ``size``, ``room`` (how many elements another set can have too) and ``bits``.
    """
    def of(side: str, name: str) -> Column:
        return F.col(f"{side}_{name}")

    both = of(left, "size") + of(right, "size")
    apart = reduce(add, [F.bit_count(of(left, b).bitwiseXOR(of(right, b))) for b in bits])
    room = F.least(of(left, "room"), of(right, "room"))
    return ((100 + percent) * room >= percent * both) & ((100 - percent) * both >= (100 + percent) * apart)


_MEMBER = ("id", "root", "main", "size", "room", "least")


def _named(rows: DataFrame, side: str, keys: Sequence[str], bits: Sequence[str]) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in (*_MEMBER, *bits)])


def _unsettled(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members of buckets that hold two groups or more, with the largest group ``main``."""
    roots = rows.groupBy(*keys, "root").agg(F.count("*").alias("n"))
    main = roots.groupBy(*keys).agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    return rows.drop("main").join(main.select(*keys, F.col("top.root").alias("main")), list(keys))


def _regrouped(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the least root within two links of theirs: texts of one root are linked, the reverse takes more rounds."""
    both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    labels = both.join(least.select(F.col("x").alias("y"), "m"), "y").groupBy(F.col("x").alias("root")).agg(F.min("m").alias("label"))
    return rows.join(labels, "root", "left").withColumn("root", F.coalesce("label", "root")).drop("label")


def links(texts: DataFrame, members: DataFrame, keys: Sequence[str], percent: int, alike: Callable) -> DataFrame:
    """Pairs ``a``, ``b`` of ids that ``alike`` confirms; every two that share buckets are linked by a chain if they are alike.

    ``texts`` has ``id`` and ``text``. ``members`` has the bucket's ``keys``, ``id``, ``size``, ``room`` and
    bits of its set, and ``least``: of how many buckets two members must share the lesser number.
    A bucket is led by the highest ``central``; without that column, by who meets most others.
    """
    bits = [c for c in members.columns if c.startswith("bits")]
    can = possible(percent, bits=bits)
    sizes = members.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    crowded = stored(members.join(sizes, list(keys)).withColumn("root", F.col("id")), "buckets")
    if "central" not in crowded.columns:
        crowded = crowded.join(crowded.groupBy("id").agg(F.sum("n").alias("central")), "id")
    # Hashing the ids spares a sort of the texts.
    wanted = crowded.select("id").distinct().hint("shuffle_hash")
    bodies = stored(once_per_task(texts).join(wanted, "id", "left_semi").dropDuplicates(["id"]), "candidates")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        checked = pairs.join(bodies.select(F.col("id").alias("a"), F.col("text").alias("left")), "a").join(
            bodies.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
        return stored(checked.select("a", "b", "x", "y", alike("left", "right").alias("alike")).where("alike").drop("alike"), name)

    def pair(*more: Column) -> list[Column]:
        return [F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"),
                F.least("x_root", "y_root").alias("x"), F.greatest("x_root", "y_root").alias("y"), *more]

    found, rows = [], _unsettled(crowded, keys)
    for number in range(2):
        # At first any member leads; then one that no link joins to most of the bucket.
        leads = rows if number == 0 else rows.where(F.col("root") != F.col("main"))
        first = leads.groupBy(*keys).agg(F.max(F.struct("central", *_MEMBER, *bits)).alias("first")).select(
            *keys, "first.*")
        pairs = _named(rows, "x", keys, bits).join(_named(first, "y", keys, bits), list(keys)).where(
            (F.col("x_root") != F.col("y_root")) & can).select(*pair()).distinct()
        found.append(confirmed(pairs, "links"))
        rows = stored(_unsettled(_regrouped(rows.drop("main"), found[-1].select("x", "y")), keys), "buckets")
    outside = rows.where(F.col("root") != F.col("main"))
    once = (F.col("y_root") == F.col("y_main")) | (F.col("x_id") < F.col("y_id"))
    pairs = _named(outside, "x", keys, bits).join(_named(rows, "y", keys, bits), list(keys)).where(
        (F.col("x_root") != F.col("y_root")) & once & can).select(*pair(F.least("x_least", "y_least").alias("least")))
    shared = pairs.groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"), F.first("least").alias("least"))
    found.append(confirmed(shared.where("n >= least").drop("n", "least"), "links"))
    return reduce(DataFrame.unionByName, found).select("a", "b")
