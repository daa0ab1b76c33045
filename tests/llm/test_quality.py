import collections
import math
import re
import zlib

from pyspark.sql import functions as F

from odd_docs import texts
from winnow.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    triples = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen, covered = collections.Counter(triples), set()
    for i, t in enumerate(triples):
        if seen[t] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


def brute(rows, trusted, buckets, deviations):
    def features(text):
        codes = [zlib.crc32(w.encode()) for w in WORD.findall(text or "")]
        return [c % buckets for c in codes] + [(a * quality.PAIR + b) % buckets for a, b in zip(codes, codes[1:])]

    raw, target, found = collections.Counter(), collections.Counter(), [features(t) for _, t in rows]
    for f, (doc_id, _) in zip(found, rows):
        raw.update(f)
        if doc_id in trusted:
            target.update(f)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    score = [sum(math.log((target[b] + 1) / (n_target + buckets)) - math.log((raw[b] + 1) / (n_raw + buckets))
                 for b in f) / max(len(f), 1) for f in found]
    good = [s for s, (doc_id, _) in zip(score, rows) if doc_id in trusted]
    mean = sum(good) / len(good) if good else 0
    sd = math.sqrt(sum((s - mean) ** 2 for s in good) / len(good)) if good else 0
    least = mean - deviations * sd if good else -math.inf
    out = []
    for s, (doc_id, text) in zip(score, rows):
        b = base(text)
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        out.append((doc_id, *b, failed, not failed and s >= least, round(s, 9)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
                    r.kept, round(r.score, 9)) for r in df.collect()), key=str)


def test_equals_brute_force(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    trusted = {r.doc_id for r in labels.collect()}
    got = quality.with_quality(documents, labels, deviations=2.0)
    assert rows_of(got) == brute(texts(documents), trusted, quality.BUCKETS, 2.0)


def test_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(1, "x"), (1, "x"), (6, "y"), (None, "z")], "doc_id long, text string")
    assert rows_of(quality.with_quality(odd, labels)) == brute(texts(odd), {1, 6}, quality.BUCKETS, 6.0)
    nobody = labels.where(F.lit(False))
    got = quality.with_quality(odd, nobody)
    assert got.where("kept = base_failed").count() == 0
    assert quality.with_quality(none, labels).count() == 0
