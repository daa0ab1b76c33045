import collections
import itertools
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from odd_docs import texts
from winnow.llm import packing
from winnow.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def words():
    return packing.WordTokenizer(tokenizer_path())


def check(spark, docs, words, size=4096, **options):
    rows = packing.pack(docs, tokenizer_path(), size=size, **options).collect()
    whole = collections.Counter()
    for doc_id, text in texts(docs):
        ids = np.append(np.array(words.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4"), np.uint32(2)).astype("<u4")
        whole[doc_id, ids.tobytes()] += 1
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
    for (doc_id, raw), n in whole.items():
        ids = np.frombuffer(raw, "<u4")
        own = [r for r in pieces[doc_id] if r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())]
        seen = np.zeros(len(ids), int)
        for r in own:
            seen[r.start:r.start + r.length] += 1
        assert (seen == n).all()
    assert sum(r.length for r in rows) == sum(n * len(raw) // 4 for (_, raw), n in whole.items())
    return [sum(r.length for r in s) for s in sequences.values()]


def test_all_tokens_are_packed_with_little_padding(spark, documents, words):
    sizes = check(spark, documents.coalesce(1), words)
    assert sum(map(packing.padding, sizes)) < 0.02 * sum(sizes)


def test_segments_join(spark, documents, words):
    check(spark, documents.coalesce(1), words, size=256, segment=1000)


def test_odd_documents(spark, odd, none, words):
    check(spark, odd, words)
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_words_alone_give_the_tokens_of_the_text(words):
    hard = ["It's <|endoftext|> ok", "İstanbul ΣΑΣ ½ ²x", "a\x1cb\x85c d", "''s 'll don't 12.5 — “q” é", "naïve Ǆ ß ﬁ", "", "日本語 text",
            "Ärger, ÀÉß ÿ÷ø. a×b µm ªº", "it'S THE... end!?", "x<|startoftext|>y z", "éa É", "a b　c", "K ſ"]
    for text in hard:
        assert words.encode(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(0, 3)), min_size=1, max_size=9))
def test_cuts_cost_the_least(steps):
    size = 8
    places = [0, *np.cumsum([s for s, _ in steps]).tolist()]
    penalties = [0, *[p for _, p in steps]]

    def cost(cuts):
        return sum(packing.padding(b - a, size) + penalties[places.index(b)] for a, b in zip(cuts, cuts[1:]))

    inner = places[1:-1]
    every = [[0, *c, places[-1]] for n in range(len(inner) + 1) for c in itertools.combinations(inner, n)]
    best = min(cost(c) for c in every if all(b - a <= size for a, b in zip(c, c[1:])))
    assert cost(packing.best_cuts(places, penalties, size)) == best


@settings(deadline=None, max_examples=300)
@given(st.text(st.sampled_from([*map(chr, range(33, 127)), *"ÀÖßàöÿ×÷éEl |<>'***\x1c½́"]), max_size=24))
def test_signs_after_letters_give_the_tokens_of_the_text(text):
    words = packing.WordTokenizer.of(tokenizer_path())
    for run in (text, f"don{text}", f"Élan{text} it's_{text}"):
        assert words.encode(run).tolist() == words.tokenizer.encode(run, add_special_tokens=False).ids


def test_signs_after_letters_are_tokenized_once(monkeypatch):
    words, whole, calls = packing.WordTokenizer(tokenizer_path()), packing._Words._whole, []
    monkeypatch.setattr(packing._Words, "_whole", lambda self, run: calls.append(run) or whole(self, run))
    runs = [f"{a}b{b}{sign}" for a in "cdefgh" for b in "ijklmn" for sign in ("***", "###", "%.", "")]
    assert words.encode(" ".join(runs)).tolist() == words.tokenizer.encode(" ".join(runs), add_special_tokens=False).ids
    assert len(calls) == 3


def test_what_is_remembered_stays_bounded(monkeypatch):
    monkeypatch.setattr(packing, "_CACHE_WORDS", 50)
    words = packing.WordTokenizer(tokenizer_path())
    for k in range(1, 120):
        text = f"word{'.' * k} w{'*' * k} {'a' * k}"
        assert words.encode(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
        assert max(map(len, (words.words, words.words.letters, words.words.tails))) <= 53

def test_the_memory_of_words_ends_with_the_task(spark):
    docs = spark.createDataFrame([(k, " ".join(f"word{k}x{j}" for j in range(300))) for k in range(16)], "doc_id long, text string").repartition(4)
    assert packing.pack(docs, tokenizer_path()).count() >= 16

    def kept(batches):
        for _ in batches:
            pass
        words = [w.words for w in vars(sys).get("_winnow_tokenizers", {}).values()]
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(w) + len(w.letters) + len(w.tails) for w in words)], pa.int64())], ["n"])

    assert spark.range(64).repartition(16).mapInArrow(kept, "n long").agg({"n": "sum"}).first()[0] == 0
