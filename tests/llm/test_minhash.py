import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from odd_docs import texts
from winnow.llm import minhash


def items(text):
    words = (text or "").encode().lower().split()
    rows = [tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    seen, out = collections.Counter(), []
    for row in rows:
        out.append((row, seen[row]))
        seen[row] += 1
    return out


def longest(a, b):
    where = {x: k for k, x in enumerate(b)}
    best = []
    for k in (where[x] for x in a if x in where):
        best.append(1 + max([n for n, j in zip(best, seen) if j < k], default=0)) if best else best.append(1)
        seen = [*(seen if len(best) > 1 else []), k]
    return max(best, default=0)


def alike(a, b):
    if not a or not b:
        return a == b == []
    m = longest(a, b)
    return m / (len(a) + len(b) - m) >= 0.8


def brute(rows):
    """Least id of each row's group, by comparing all pairs."""
    shingles = [items(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in itertools.combinations(range(len(rows)), 2):
        same = (rows[i][1] or "") == (rows[j][1] or "")
        if same or (shingles[i] and len(set(shingles[i]) & set(shingles[j])) > 0 and alike(shingles[i], shingles[j])):
            parent[find(j)] = find(i)
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        out += [(i, min(known) if known else None, len(ids)) for i in ids]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.class_size) for r in df.collect()), key=str)


def test_equals_all_pairs(documents):
    assert got(minhash.near_duplicates(documents)) == brute(texts(documents))


def test_odd_documents(odd, none):
    assert got(minhash.near_duplicates(odd)) == brute(texts(odd))
    kept = minhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((str(r.doc_id), (r.text or "")[:20]) for r in kept.collect()) == sorted(
        (str(d), (t or "")[:20]) for d, t in [(1, dict(texts(odd))[1]), (5, " \n\t "), (None, "orphan text here"), (None, None),
                                              *[(d, t) for d, t in texts(odd) if d and d > 5]])
    assert minhash.near_duplicates(none).count() == 0 and minhash.one_of_each(none).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 500, 300)]
    rows = []
    for k in range(150):
        words = list(base)
        words[int(rng.integers(300))] = f"edit{k}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"v{i}" for i in rng.integers(0, 500, 300))) for k in range(20)]
    classes = collections.Counter(c for _, c, _ in got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert sorted(classes.values()) == [1] * 20 + [150]


@pytest.mark.parametrize("copies, edits", [(60, 3), (150, 3), (60, 4)])
def test_copies_that_only_the_original_links(spark, copies, edits):
    rng, rows = np.random.default_rng(copies + edits), []
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(200)]
        rows.append((1000 * group, " ".join(base)))
        for k in range(1, copies + 1):
            words = list(base)
            for at in rng.choice(edits * 12, edits, replace=False):
                words[5 + 195 // (edits * 12) * int(at)] = f"edit{k}_{at}"
            rows.append((1000 * group + k, " ".join(words)))
    # What shares a sketch is compared, so groups equal those of all pairs that share one.
    found, edges = minhash.items(pa.array([t for _, t in rows]))
    keys = minhash.sketches(found, edges)
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    shingles = [found[i:j] for i, j in zip(edges, edges[1:])]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (keys[i] == keys[j]).any() and minhash.similarity(shingles[i], shingles[j]) > 0:
            parent[find(j)] = find(i)
    want = collections.Counter(find(k) for k in range(len(rows)))
    classes = collections.Counter(c for _, c, _ in got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert sorted(classes.values()) == sorted(want.values())
    assert max(want.values()) == copies + 1


@pytest.mark.parametrize("share", [0.0, 0.01, 0.02, 0.03])
def test_similarity_is_the_ordered_share(share):
    rng = np.random.default_rng(7)
    for _ in range(20):
        a = [f"w{i}" for i in rng.integers(0, 60, 120)]
        b = [w if rng.random() >= share else "x" for w in a]
        if rng.random() < 0.3:
            b = b[60:] + b[:60]
        found, edges = minhash.items(pa.array([" ".join(a), " ".join(b)]))
        left, right = items(" ".join(a)), items(" ".join(b))
        m = longest(left, right)
        want = m / (len(left) + len(right) - m)
        value = minhash.similarity(found[: edges[1]], found[edges[1]:])
        assert value == (pytest.approx(want) if want >= 0.8 else 0.0)


def test_components(spark):
    links = [(f"{a:02d}".encode(), f"{b:02d}".encode()) for a, b in [(k, k + 1) for k in range(1, 30)] + [(40, 41), (42, 41), (40, 42)]]
    rows = minhash.components(spark.createDataFrame(links, "a binary, b binary")).collect()
    assert {(bytes(r.id), bytes(r.root)) for r in rows} == {(f"{k:02d}".encode(), b"01") for k in range(2, 31)} | {
        (b"41", b"40"), (b"42", b"40")}


def test_texts_that_share_a_long_passage_are_ruled_out_by_their_bits(spark):
    """600 items in common of 720 are too few; pairs of such texts must not become rows of a join."""
    rng = random.Random(12)
    passage = " ".join(f"p{k}" for k in range(604))
    docs = spark.createDataFrame([(bytes([k]) * 16, passage + " " + " ".join(f"w{rng.random()}" for _ in range(120))) for k in range(40)],
                                 "id binary, text string")
    rows = minhash._sketched(docs).collect()
    bits = [[v for name, v in r.asDict().items() if name.startswith("bits")] for r in rows]
    passed = sum(180 * sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b)) <= 20 * 1440
                 for k, a in enumerate(bits) for b in bits[:k])
    assert {r["size"] for r in rows} == {720} and passed == 0
