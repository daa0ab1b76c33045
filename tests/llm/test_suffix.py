import collections
import hashlib
import random

import pytest

from odd_docs import texts
from winnow.llm import exchange, queries, suffix


def brute(rows):
    rows = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(t[i:i + 400] for _, t in rows for i in range(len(t) - 399))
    out = []
    for doc_id, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i:i + 400]] > 1:
                gone[i:i + 400] = b"\1" * 400
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, documents, sf_dir):
    rows = got(queries.LLM_QUERIES["op10_suffix_array"](spark, sf_dir))
    assert rows == brute(texts(documents)) and sum(r[2] for r in rows) > 0


@pytest.mark.parametrize("blocks", [1, 7])
def test_odd_documents(odd, none, monkeypatch, blocks):
    rows = odd.where("doc_id is null or doc_id <> 6")
    if blocks > 1:
        monkeypatch.setattr(suffix, "BLOCK_BYTES", 700)
        monkeypatch.setattr(exchange, "part_bits", lambda total: 3)
    assert got(suffix.without_repeats(rows)) == brute(texts(rows))
    assert suffix.without_repeats(none).count() == 0


def test_passages_in_all_places(spark):
    rng = random.Random(5)

    def prose(n):
        return "".join(rng.choice("abcdefghij klmno") for _ in range(n))

    passage, other = prose(900), prose(500)
    rows = []
    for k in range(40):
        a = rng.randint(0, 400)
        part = passage[a:a + rng.choice([399, 400, 401, 450, 500])]
        rows.append((k, prose(rng.randint(0, 700)) + part + prose(rng.randint(0, 700)) + (other if k % 5 == 0 else "")))
    rows += [(50, "ab" * 900), (51, "ab" * 300 + "x"), (52, "z" * 400), (53, "z" * 399), (54, ("é" + "q" * 30) * 40),
             (55, passage[:400]), (56, passage[:400]), (57, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffix.without_repeats(docs)) == brute(rows)
