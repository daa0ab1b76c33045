import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from odd_docs import texts
from winnow.llm import decontam

ITEMS = "item_id long, text string, start long"


def brute(item, text):
    """Least edit distance between the item and any run of the text."""
    best = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(best[j - 1] + (w != t), best[j] + 1, row[j - 1] + 1))
        best = row
    return min(best)


def test_edit_distance_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(200):
        item, text = rng.integers(0, 4, rng.integers(1, 8)), rng.integers(0, 4, rng.integers(0, 14))
        want = brute(item.tolist(), text.tolist())
        assert decontam.edit_distance(item, text, 99)[0] == want
        assert decontam.edit_distance(item, text, 2)[0] == min(want, 3)


def test_finds_all_items_in_documents(spark, documents, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(documents, bench).where("distance = 0").collect()}
    want = {(d, i) for d, t in texts(documents) for i, b in items if b in (t or "")}
    assert want and want <= got


@pytest.mark.parametrize("share, recall", [(0.1, 0.98), (0.2, 0.95)])
def test_recall_of_edited_items(spark, sf_dir, share, recall):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rng, rows = np.random.default_rng(2), []
    for r in bench.collect():
        for copy in range(5):
            words = r.text.split()
            for _ in range(int(share * len(words))):
                at, kind = rng.integers(len(words)), rng.integers(3)
                words[at:at + (kind != 1)] = [] if kind == 2 else ["otherword"]
            rows.append((r.item_id * 10 + copy, "before it " * 30 + " ".join(words) + " after it" * 30))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert sum((d, d // 10) in got for d, _ in rows) >= recall * len(rows)
    # Twice as many edits as allowed are no match.
    far = docs.selectExpr("doc_id", r"regexp_replace(text, '(\\w+) (\\w+)', '$1 zz')")
    assert decontam.leaks(far.toDF("doc_id", "text"), bench).count() == 0


@pytest.mark.parametrize("size", [5, 6, 7, 10, 30, 57, 100, 200])
def test_recall_wherever_the_edits_are(size):
    rng, most, count = np.random.default_rng(size), size // 5, 20
    items = [[f"w{w}" for w in rng.integers(0, 3000, size)] for _ in range(count)]
    index = decontam.Index.build(list(range(count)), [" ".join(i) for i in items])
    for step in (1, 2):
        for places in ([0], [0.5], [1], [0, 0.5], [0, 1], [0.5, 1]):
            docs = []
            for item in items:
                words = list(item)
                for n, place in enumerate(places):
                    edits = len(range(n, most, len(places)))
                    first = min(int(place * size), size - step * (edits - 1) - 1)
                    for at in range(first, first + step * edits, step):
                        words[at] = "otherword"
                docs.append(" ".join(["before", "it"] * 9 + words + ["after", "it"] * 9))
            got = {(text, number) for text, number, *_ in decontam._matches(index, pa.array(docs), 0.2)}
            assert sum((k, k) in got for k in range(count)) >= 0.95 * count, (step, places)


def test_odd_documents_and_items(spark, odd, none):
    bench = spark.createDataFrame(
        [(1, "the quick brown fox jumps over the lazy dog and runs far", 0), (1, None, 0), (2, "", 0), (None, "orphan TEXT", 0),
         (3, "nowhere to be found in any of these", 0), (3, "nowhere to be found in any of these", 0)], ITEMS)
    got = decontam.leaks(odd, bench)
    assert sorted(((r.doc_id, r.item_id) for r in got.collect()), key=str) == [(1, 1), (1, 1), (2, 1), (None, None)]
    kept = decontam.without_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    in_blocks = decontam.leaks(odd, bench, block_items=1)
    assert got.exceptAll(in_blocks).count() == 0 and in_blocks.count() == got.count()
    assert decontam.leaks(none, bench).count() == 0 and decontam.without_leaks(none, bench).count() == 0
    empty = bench.where("false")
    assert decontam.leaks(odd, empty).count() == 0 and decontam.without_leaks(odd, empty).count() == odd.count()


def table_distance(item, text, most):
    """Least edit distance to any run of the text, by the whole table."""
    row = list(range(len(item) + 1))
    best, end = (row[-1], 0) if row[-1] <= most else (most + 1, 0)
    for at, word in enumerate(text):
        new = [0]
        for k, other in enumerate(item, 1):
            new.append(min(row[k - 1] + (word != other), row[k] + 1, new[k - 1] + 1))
        row = new
        if row[-1] < best:
            best, end = row[-1], at + 1
    return best, end


def test_bit_parallel_distance_equals_the_table():
    rng = np.random.default_rng(8)
    for size in (0, 1, 2, 3, 7, 40, 63, 64, 65, 130, 200):
        for words in (2, 5, 60):
            item = rng.integers(1, words + 1, size)
            text = np.concatenate([rng.integers(0, words + 1, 9), np.delete(item, slice(3, 5)), rng.integers(0, words + 1, 5)])
            for most in (0, size // 5, size):
                assert decontam.edit_distance(item, text, most) == table_distance(item.tolist(), text.tolist(), most)


def test_an_item_of_20000_words(spark):
    rng = np.random.default_rng(3)
    item = [f"w{k}" for k in rng.integers(0, 30_000, 20_000)]
    edited = list(item)
    for at in rng.choice(20_000, 1500, replace=False):
        edited[at] = "edited"
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "short item of words here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " * 50 + " ".join(edited)), (2, " ".join(item[:9000])), (3, None)], "doc_id long, text string")
    (row,) = decontam.leaks(docs, bench).collect()
    assert (row.doc_id, row.item_id, row.n_words) == (1, 1, 20_000) and 1000 < row.distance <= 1500


def test_vocabulary_beyond_63_bits_of_signature():
    texts = [" ".join(f"v{k * 1500 + j}" for j in range(1500)) for k in range(1500)]
    index = decontam.Index.build(list(range(1500)), texts, repeats=1)
    assert len(index.vocabulary) > 2_097_151
    codes = index.items[7]
    assert (7, 0) in {tuple(row) for row in index.candidates(np.concatenate([codes, codes[:9]])).tolist()}


@pytest.mark.parametrize("share", [0, 0.1, 0.2, 0.5, 1])
def test_walks_near_shared_runs_lose_no_match(monkeypatch, share):
    rng = np.random.default_rng(4)
    items = [[f"w{w}" for w in rng.integers(0, 40, size)] for size in (1, 2, 4, 5, 6, 9, 10, 14, 15, 24, 25, 60)]
    index = decontam.Index.build(list(range(len(items))), [" ".join(i) for i in items])
    docs = [None, "", "w1"]
    for item in items * 6:
        words = list(item)
        for _ in range(rng.integers(0, int(share * len(item)) + 2)):
            at, kind = rng.integers(len(words) + 1), rng.integers(3)
            words[at:at + (kind != 1)] = [] if kind == 2 else [f"w{rng.integers(0, 50)}"]
        docs.append(" ".join([f"w{w}" for w in rng.integers(0, 60, rng.integers(0, 30))] + words))
    got = list(decontam._matches(index, pa.array(docs), share))
    everywhere = decontam.Index.candidates
    monkeypatch.setattr(decontam.Index, "candidates", lambda self, codes, near=None: everywhere(self, codes))
    assert got and got == list(decontam._matches(index, pa.array(docs), share))


def test_only_windows_near_a_shared_run_are_walked(monkeypatch):
    rng = np.random.default_rng(5)
    items = [" ".join(f"w{w}" for w in rng.integers(0, 3000, 40)) for _ in range(50)]
    index = decontam.Index.build(list(range(50)), items)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 3000, 2000)) for _ in range(10)]
    texts[3] += " " + items[7]
    walked, search = [], decontam.Index.candidates

    def spied(self, codes, *near):
        walked.append(len(near[0]) if near else len(codes))
        return search(self, codes, *near)

    monkeypatch.setattr(decontam.Index, "candidates", spied)
    assert [(text, number) for text, number, *_ in decontam._matches(index, pa.array(texts), 0.2)] == [(3, 7)]
    assert 40 <= sum(walked) < 400


def test_a_batch_takes_little_memory():
    index = decontam.Index.build([1], ["one two three four five six seven eight"])
    texts = pa.array(["a b c d " * 500] * 1000)  # two million words
    few = pa.array(["a b c d " * 500, "now one two three four five six seven eight"])
    assert [text for text, *_ in decontam._matches(index, few, 0.2)] == [1]
    tracemalloc.start()
    try:
        assert not list(decontam._matches(index, texts, 0.2))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    print("MB", peak / 1e6)
    assert peak < 60e6
