"""Quality rules: fixed counts of each text, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into buckets. Two multinomials over the buckets, of the
trusted documents and of all documents, give each bucket a log-likelihood ratio. A document's
score is the mean ratio of its words and pairs. The threshold lies ``deviations`` standard
deviations under the trusted documents' mean score. All of it is DataFrame expressions; the
ratios are one array of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
BUCKETS = 1 << 16
#: Mixes a word's number with that of the word before it.
PAIR = 1_000_003


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_chars(found: Column) -> Column:
    return F.length(F.array_join(found, "")).cast("long")


def symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SYMBOL)), F.lit(0)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: line.rlike(WORD))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def triples(found: Column) -> Column:
    """A hash of the three words from each place on."""
    last = F.size(found) - 3
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)))


def repeated_words(hashes: Column) -> Column:
    """Words inside a window of three that is found twice or more; ``hashes`` from :func:`triples`.

    Windows sorted by hash have their equals beside them. Most texts end at the first test.
    """
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0)).otherwise(
        _covered(pairs)).cast("long")


def _covered(pairs: Column) -> Column:
    # The sorted pairs are bound once as the only element of an array.
    def places(rows: Column) -> Column:
        kept = F.filter(rows, lambda row, k: (
            F.coalesce(F.get(rows, k - 1)["h"] == row["h"], F.lit(False))
            | F.coalesce(F.get(rows, k + 1)["h"] == row["h"], F.lit(False))))
        return F.transform(kept, lambda row: row["i"])

    def count(starts: Column) -> Column:
        second, third = F.transform(starts, lambda i: i + 1), F.transform(starts, lambda i: i + 2)
        return F.size(F.array_union(F.array_union(starts, second), third))

    starts = F.transform(F.array(pairs), places)
    return F.get(F.transform(starts, count), F.lit(0))


def codes(found: Column) -> Column:
    """A number of 32 bits for each word."""
    return F.transform(found, lambda w: F.crc32(w.cast("binary")))


def features(numbers: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the words, then of the pairs of adjoining words; ``numbers`` from :func:`codes`."""
    single = F.transform(numbers, lambda c: (c % buckets).cast("int"))
    firsts = F.slice(numbers, 1, F.greatest(F.size(numbers) - 1, F.lit(0)))
    double = F.transform(firsts, lambda c, i: ((c * PAIR + F.get(numbers, i + 1)) % buckets).cast("int"))
    return F.concat(single, double)


def _counts(docs: DataFrame, buckets: int) -> DataFrame:
    rows = docs.select(words(F.col("text")).alias("words")).select(codes(F.col("words")).alias("codes"))
    rows = rows.select(F.explode(features(F.col("codes"), buckets)).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"))


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with ``ratios``, the log-likelihood ratio of each bucket, with add-one smoothing.

    ``docs`` has ``doc_id`` and ``text``; ``trusted`` has the distinct ids of the trusted
    documents, which a task of the join holds its part of; the texts aren't sorted.
    """
    raw = _counts(docs, buckets).withColumnRenamed("n", "raw")
    target = _counts(docs.join(trusted.hint("shuffle_hash"), "doc_id", "left_semi"), buckets).withColumnRenamed("n", "target")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw, "bucket", "left").join(target, "bucket", "left").select(
        "bucket", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("raw", "target")])
    rows = both.agg(
        F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"),
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("rows"))
    return rows.select(F.transform("rows", lambda r: (
        F.log((r["target"] + 1.0) / (F.col("all_target") + float(buckets)))
        - F.log((r["raw"] + 1.0) / (F.col("all_raw") + float(buckets))))).alias("ratios"))


def with_quality(docs: DataFrame, trusted: DataFrame, *, deviations: float = 6.0,
                 buckets: int = BUCKETS) -> DataFrame:
    """``doc_id``, ``n_words``, the base counts, ``base_failed``, ``score`` and ``kept`` of each row.

    ``trusted`` has the ``doc_id`` of trusted documents; its other columns and repeated ids
    don't matter. A text without words (or null) scores 0 and fails the base rules. Without
    any trusted document the threshold is absent and the base rules alone decide. Repeated
    rows and null ids are scored like others; other columns are left out; no rows give none.
    """
    parts = docs.select("doc_id", "text", words(F.col("text")).alias("words"))
    trusted = trusted.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    table = ratios(docs.select("doc_id", "text"), trusted, buckets)
    counted = parts.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), word_chars(F.col("words")).alias("word_chars"),
        symbols(F.col("text")).alias("n_symbols"), duplicate_lines(F.col("text")).alias("n_dup_lines"),
        triples(F.col("words")).alias("triples"), codes(F.col("words")).alias("codes"))
    counted = counted.withColumn("features", features(F.col("codes"), buckets)).drop("codes")
    scored = counted.withColumn("ratios", table.scalar()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        repeated_words(F.col("triples")).alias("n_repeat_words"),
        (F.aggregate("features", F.lit(0.0), lambda total, f: total + F.get(F.col("ratios"), f))
         / F.greatest(F.size("features"), F.lit(1))).alias("score"))
    scored = stored(scored, "quality")
    bound = scored.join(trusted, "doc_id", "left_semi").agg(
        (F.avg("score") - deviations * F.stddev_pop("score")).alias("least"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    least = F.coalesce(bound.scalar(), F.lit(float("-inf")))
    return scored.select("*", failed.alias("base_failed"),
                         (~failed & (F.col("score") >= least)).alias("kept"))
