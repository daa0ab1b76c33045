import collections
import math
import re
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
import numpy as np

from odd_docs import texts
from winnow.llm import exchange, lm


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40, unique=True), st.integers(0, 6))
def test_requests_hold_keys_and_counts(keys, bits):
    keys = np.unique(exchange.narrowed(np.array(sorted(keys), np.uint64), bits, 64))
    counts = np.stack([np.arange(len(keys)), np.full(len(keys), 7)]).astype(np.uint64)
    rows = exchange.requests(3, 1, keys, counts, bits, 64)
    shift = np.uint64(min(64, 64 - bits))
    back = [exchange.unpack_keys(r["keys"]) + (np.uint64(r["part"]) << shift if bits else np.uint64(0)) for r in rows]
    assert np.concatenate([np.zeros(0, np.uint64), *back]).tolist() == keys.tolist()
    got = [exchange.unpack_counts(r["counts"]) for r in rows]
    assert not rows or np.array_equal(np.concatenate(got, axis=1), counts)


def tokens(text):
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [0]


def ngrams(words, order):
    """For each token, its n-grams from one token up, shortest first; none longer than the text so far."""
    marked = [None, *words]
    return [[tuple(marked[max(0, i - k + 1):i + 1]) for k in range(1, order + 1)] for i in range(1, len(marked))]


def brute(rows, rounds=12, order=3):
    held = [(zlib.crc32(str("" if d is None else d).encode()) % 10, tokens(t)) for d, t in rows]
    counts = {part: collections.Counter() for part in ("fit", "deleted")}
    for r, words in held:
        if r:
            counter = counts["deleted" if r == 1 else "fit"]
            counter.update([(None,)])
            for found in ngrams(words, order):
                counter.update(set(found))
    fit, every = counts["fit"], counts["fit"] + counts["deleted"]
    size = {k: sum(n for g, n in c.items() if len(g) == 1 and g != (None,)) for k, c in (("fit", fit), ("all", every))}
    distinct = len([g for g in every if len(g) == 1 and g != (None,)])
    uniform = 1 / (distinct + 1)

    def estimates(c, n, found):
        p, bucket = [uniform, c[found[0]] / max(n, 1)], None
        for k, gram in enumerate(found[1:]):
            context = c[gram[:-1]]
            p.append(c[gram] / max(context, 1))
            if k == 0 or context:
                bucket = k * lm.MOST_BUCKETS + lm.bucket_of(np.array([context]))[0]
        return bucket, np.array(p)

    weights = np.full(((order - 1) * lm.MOST_BUCKETS, order + 1), 1 / (order + 1))
    seen = [estimates(fit, size["fit"], g) for r, words in held if r == 1 for g in ngrams(words, order)]
    for _ in range(rounds):
        sums = collections.defaultdict(lambda: np.zeros(order + 1))
        for b, p in seen:
            share = weights[b] * p
            sums[b] += share / share.sum()
        new = weights.copy()
        for b, s in sums.items():
            new[b] = s / s.sum()
        done = np.abs(new - weights).max() < 1e-3
        weights = new
        if done:
            break
    out = []
    for (doc_id, _), (r, words) in zip(rows, held):
        model = 0.0
        for found in ngrams(words, order):
            bucket, p = estimates(every, size["all"], found)
            model += math.log10(weights[bucket] @ p)
        base = sum(math.log10((every[w,] + 0.1) / (size["all"] + 0.1 * (distinct + 1))) for w in words)
        out.append((doc_id, r == 0, len(words), sum(every[w,] > 0 for w in words), size["all"],
                    pytest.approx(base, rel=1e-9), pytest.approx(model, rel=1e-6)))
    return sorted(out, key=lambda x: str(x[:5]))


def rows_of(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                   for r in df.collect()), key=lambda x: str(x[:5]))


@pytest.mark.parametrize("order", [2, 3])
def test_equals_brute_force(documents, order):
    assert rows_of(lm.score(documents, order=order)) == brute(texts(documents), order=order)


def test_many_blocks_give_the_same(documents, monkeypatch):
    one = rows_of(lm.score(documents))
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(exchange, "part_bits", lambda total: 3)
    many = rows_of(lm.score(documents))
    assert [r[:5] for r in one] == [r[:5] for r in many]
    assert all(a[6] == pytest.approx(b[6], rel=1e-9) for a, b in zip(one, many))


def test_odd_documents(odd, none):
    assert rows_of(lm.score(odd)) == brute(texts(odd))
    assert lm.score(none).count() == 0


def test_triples_beat_pairs_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    two, three = (lm.score(docs, order=k).where("held_out").agg({"score": "sum"}).first()[0] for k in (2, 3))
    assert three > two


def test_the_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.score(docs).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert r[0] > 0.8 * r[1]
