import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from winnow.llm import collocations, exchange, queries

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, rank int"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least=30, top=2000):
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", lowered(text)):
            words = re.findall(r"[^ \t]+", piece)
            for size in range(1, 5):
                counts[lang or "und"].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        cands = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        rows_ = []
        for g, a in cands.items():
            within = [b for h, b in cands.items() if len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h)))]
            if within and 100 * max(within) >= 80 * a:
                continue
            score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            rows_.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (s, a, g, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n, -s))
    return sorted(out)


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_query_equals_brute_force(spark, documents, sf_dir):
    rows = got(queries.LLM_QUERIES["op13_phrase_collocations"](spark, sf_dir))
    assert rows == brute([(r.text, r.lang) for r in documents.collect()]) and rows


def prose(seed, size):
    rng = random.Random(seed)
    words = ["the", "of", "a", "New", "York", "city", "Über", "x", "日本"]
    return "".join(rng.choices(words, [9, 7, 5, 3, 3, 2, 2, 1, 1])[0] + rng.choices([" ", "\t  ", ". ", ",", "\n", "! "], [20, 2, 2, 1, 1, 1])[0]
                   for _ in range(size))


@pytest.mark.parametrize("blocks", [1, 5])
def test_odd_documents(spark, monkeypatch, blocks):
    if blocks > 1:
        monkeypatch.setattr(collocations, "BLOCK_BYTES", 8000)
        monkeypatch.setattr(exchange, "part_bits", lambda total: 3)
    passage = " ".join(f"w{k % 50} u{k}" for k in range(60))
    rows = [(k, prose(k, 300), ["en", "de", None][k % 3]) for k in range(40)]
    rows += [(None, None, None), (90, "", "en"), (91, " .,;\t\n", "fr"), (92, "one", "fr"), (93, "again " * 3000, "en"),
             (93, "again " * 3000, "en"), (None, "x", "zz")]
    rows += [(100 + k, f"{passage} t{k}", "en") for k in range(35)]
    docs = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA)
    want = brute([(t, lang) for _, t, lang in rows])
    assert got(collocations.collocations(docs)) == want and {r[0] for r in want} == {"de", "en", "und"}
    assert got(collocations.collocations(docs, top=3)) == [r for r in want if r[1] <= 3]
    assert collocations.collocations(docs.where("doc_id < 0")).count() == 0


def test_paths_hold_all_edges():
    rng = np.random.default_rng(3)
    for most in (2, 4, 40):
        edges = np.unique(np.concatenate([rng.integers(0, 2, (60, 1)), rng.integers(0, most, (60, 4))], axis=1), axis=0)
        circle = np.stack([np.zeros(9, int), *[(np.arange(9) + k) % 9 + 100 for k in range(4)]], axis=1)
        line = np.stack([np.ones(30, int), *[np.arange(30) + 200 + k for k in range(4)]], axis=1)
        edges = np.concatenate([edges, circle, line])
        counts = np.concatenate([rng.integers(1, 3, len(edges) - 30), np.full(30, 7)])
        langs, words, sizes, n = collocations.compacted(edges, counts)
        found, at = {}, 0
        for lang, size, times in zip(langs, sizes, n):
            for k in range(at, at + size - 3):
                found[(lang, *words[k:k + 4])] = times
            at += size
        assert found == {tuple(e): c for e, c in zip(edges.tolist(), counts)} and at == len(words)
        assert 33 in sizes.tolist()
    assert all(len(x) == 0 for x in collocations.compacted(np.zeros((0, 5), np.int64), np.zeros(0, np.int64)))


def test_a_block_takes_little_memory():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in row) for row in rng.integers(0, 30_000, (100, 4000))]
    docs = pa.table({"block": pa.array([0] * len(texts), pa.int32()), "lang": ["en"] * len(texts), "text": texts})
    places = 400_000

    def asked():
        return [row for size, _, keys in collocations._hashed(*collocations.words_of(docs), 3)
                for keys, counts in [np.unique(keys, return_counts=True)]
                for row in exchange.requests(0, size, keys, counts[None, :].astype(np.uint64), 3, collocations.HASH_BITS)]

    def peak(run):
        tracemalloc.start()
        try:
            run()
            return tracemalloc.get_traced_memory()[1] / places
        finally:
            tracemalloc.stop()

    answer = [{"block": 0, "kind": r["kind"], "part": r["part"], "totals": exchange.pack_counts(exchange.unpack_counts(r["counts"])),
               "stats": None} for r in asked()]
    replies = pa.Table.from_pylist(answer, exchange._REPLY_ARROW)
    asking, counting = peak(asked), peak(lambda: collocations._paths(docs, replies, 3))
    print("bytes a place", asking, counting)
    assert asking < 90 and counting < 100
