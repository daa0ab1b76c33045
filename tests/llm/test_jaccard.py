import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from odd_docs import texts
from winnow.llm import exchange, jaccard, linking, queries


def shingles(text):
    words = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    """Row for row: the id, how many shingles it has, and the least id of its component."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for k, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(doc_id)
    least = {k: min([x for x in ids if x is not None], default=None) for k, ids in groups.items()}
    return sorted(((d, len(s), least[find(k)]) for k, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, documents, sf_dir):
    assert got(queries.LLM_QUERIES["op12_jaccard_join"](spark, sf_dir)) == brute(texts(documents))


def test_odd_documents(odd, none):
    assert got(jaccard.jaccard_join(odd)) == brute(texts(odd))
    assert jaccard.jaccard_join(none).count() == 0


def edited(rng, words, edits):
    words = list(words)
    for k in rng.sample(range(len(words)), edits):
        words[k] = rng.choice(["", "x", words[k] + ".", f"n{rng.randint(0, 40)}", rng.choice(words)])
    return " ".join(words)


@pytest.mark.parametrize("verify, blocks", [(1 / 16, 1), (1000.0, 4), (0.0, 3)])
def test_groups_of_near_copies(spark, monkeypatch, verify, blocks):
    """Copies around one original, copies of copies, a shared passage, few words that all use."""
    monkeypatch.setattr(jaccard, "VERIFY", verify)
    if blocks > 1:
        monkeypatch.setattr(jaccard, "BLOCK_BYTES", 20_000)
        monkeypatch.setattr(exchange, "part_bits", lambda total: 2)
    rng = random.Random(4)
    original = [f"w{rng.randint(0, 300)}" for _ in range(150)]
    rows = [(k, edited(rng, original, rng.choice([1, 2, 3, 3, 4, 6, 9]))) for k in range(90)]
    chain = original[:100]
    for k in range(40):
        chain = edited(rng, chain, 2).split()
        rows.append((100 + k, " ".join(chain)))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(200 + k, passage + " " + " ".join(f"q{rng.randint(0, 99)}" for _ in range(rng.choice([5, 12, 20, 40])))) for k in range(40)]
    rows += [(300 + k, " ".join(rng.choice("ab") for _ in range(rng.choice([8, 30, 90])))) for k in range(60)]
    rows += [(400, rows[3][1].upper()), (401, rows[3][1]), (402, "  " + rows[5][1] + "\\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert got(jaccard.jaccard_join(docs)) == want and len({r[2] for r in want}) < len(rows) - 60


def test_prefixes_share_enough():
    """Any two alike sets share as many prefix shingles as the lesser requirement, whatever each chose."""
    rng = random.Random(9)
    levels = set()
    for trial in range(60):
        base = rng.sample(range(400), rng.randint(3, 90))
        sets = [sorted({*rng.sample(base, max(1, len(base) - rng.randint(0, 6))), *rng.sample(range(400, 700), rng.randint(0, 5))}) for _ in range(12)]
        held = {x: sum(x in s for s in sets) * rng.choice([1, 9]) for s in sets for x in s}
        order = [sorted(s, key=lambda x: (held[x], x)) for s in sets]
        sizes = np.array([len(s) for s in order])
        starts = np.cumsum(sizes) - sizes
        jaccard_verify, jaccard.VERIFY = jaccard.VERIFY, rng.choice([0.0, 1 / 16, 5.0, 1000.0])
        least, length = jaccard.requirements(np.array([held[x] for s in order for x in s]), starts, sizes)
        jaccard.VERIFY = jaccard_verify
        levels |= set(least.tolist())
        for i in range(12):
            for j in range(i):
                a, b = set(order[i]), set(order[j])
                if 100 * len(a & b) >= 80 * len(a | b):
                    assert len(set(order[i][:length[i]]) & set(order[j][:length[j]])) >= min(least[i], least[j])
    assert len(levels) > 2


def test_parity_never_passes_the_difference():
    rng = np.random.default_rng(2)
    base = rng.integers(1 << 62, size=700, dtype=np.uint64)
    for extra in (0, 1, 5, 60, 600):
        sets = [base, np.concatenate([base[extra:], rng.integers(1 << 62, size=extra, dtype=np.uint64)])]
        bits = linking.parity(np.concatenate(sets), np.array([0, 700]))
        apart = sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64))
        assert apart <= 2 * extra and (extra > 5 or apart >= extra)
    assert linking.parity(np.zeros(0, np.uint64), np.zeros(0, np.int64)).shape == (0, linking.WORDS)


def test_shingle_sets_are_sorted_and_distinct():
    found, edges = jaccard.shingle_sets(pa.array(["a b c d e " * 4, None, "one two", "A b C d E f"]))
    assert np.diff(edges).tolist() == [5, 0, 1, 2]
    assert set(found[edges[3]:edges[4]]) & set(found[:5]) and np.all(np.diff(found[:5].astype(object)) > 0)


def test_prefixes_of_a_block_take_little_memory(monkeypatch):
    """What a block holds at once is a few numbers a shingle, and slices of texts give the same rows."""
    rng = np.random.default_rng(2)
    words = np.array([f"w{k}" for k in range(5000)])
    texts = [" ".join(words[rng.integers(0, 5000, 600)]) for _ in range(800)]
    texts += [t + " more" for t in texts[:200]] + ["", "one"]
    table = pa.table({"id": pa.array([b"%05d" % k for k in range(len(texts))], pa.binary()), "text": pa.array(texts)})
    _, found, _ = jaccard._sets(table)
    keys, counts = np.unique(found, return_counts=True)
    replies = pa.Table.from_pylist([{"block": 0, "kind": jaccard.TOKEN, "part": 0, "totals": exchange.pack_counts(
        counts[None, :].astype(np.uint64)), "stats": None}], exchange._REPLY_ARROW)
    tracemalloc.start()
    rows = jaccard._prefixes(table, replies, 24)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 65 * len(found), peak / len(found)
    order = [("id", "ascending"), ("token", "ascending")]
    for size in (1, 10_000):
        monkeypatch.setattr(jaccard, "SLICE", size)
        assert jaccard._prefixes(table, replies, 24).sort_by(order) == rows.sort_by(order)
