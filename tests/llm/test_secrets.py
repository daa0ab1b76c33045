import hashlib
import random
import re
import time

from odd_docs import texts
from winnow.llm import queries, secrets

RULES = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
         ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def brute(text):
    spans = [(m.start(), k, kind, m.end()) for k, (kind, rule, group, least) in enumerate(RULES)
             for m in rule.finditer(text or "") if len(m[group]) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(spans)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans_equal_the_rules():
    random.seed(1)
    parts = ["token", "secret", "API_key", "passwd", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef" * 2,
             "ab", "é", "\n", "-", ".", "ſecret", "apiKey"]
    for _ in range(5000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert [(k, a, b) for a, _, k, b in secrets.base_spans(text)] == brute(text)


def test_query_keeps_all_base_spans(spark, documents, sf_dir):
    got = {r.doc_id: r for r in queries.LLM_QUERIES["op7_secret_scan"](spark, sf_dir).collect()}
    for doc_id, text in texts(documents):
        base = brute(text)
        r = got[doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _, _ in base) for kind, *_ in RULES]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(joined(base).split(",")) <= set(r.spans.split(","))


def test_the_field_finds_what_the_rules_miss():
    rng, rows = random.Random(3), []
    for k in range(300):
        word = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        access = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        rows.append(f'some words token = "{word}" and {access} then mail bob{k}@site{k % 9}.org on 2024-05-{k % 28 + 1:02d} or http://a.b/{k}1234567/index.html')
    field = secrets.train(rows)
    assert [s[0] for s in secrets.find("an id AKXA7Q2M5N8P3R6T9V2W in text", field)] == ["crf"]
    for clean in ("on 2024-05-07 at 10:15", "mail bob12@site3.org", "see http://a.b/91234567/index.html"):
        assert secrets.find(clean, field) == []


def test_a_pattern_hides_no_other_secret_of_its_word():
    rng, rows = random.Random(3), []
    for k in range(300):
        word = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        access = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        rows.append(f'some words {{"token":"{word}","sig":"{access}","n":"{k}"}} and {access} then http://a.b/{k}1234567/index.html')
    field = secrets.train(rows)
    text = '{"token":"abcdef1","sig":"AKXA7Q2M5N8P3R6T9V2W"}'
    spans = secrets.find(text, field)
    assert ("assign", 2, 17) in spans
    assert [text[a:b] for k, a, b in spans if k == "crf"] == ["AKXA7Q2M5N8P3R6T9V2W"]
    assert "AKXA7Q2M5N8P3R6T9V2W" not in secrets.redact(text, spans)


def test_words_in_question():
    for word in ("abcdefg1", "xyzQRSTabcd", "ABcdefghij", "abc_DEF_ghi"):
        assert secrets.words_in_question(f"of {word} then") == [(3, 3 + len(word))]
    for word in ("President", "abcdefghij", "ABCDEFGHIJ", "aB1", "on"):
        assert secrets.words_in_question(f"of {word} then") == []


def test_the_sample_is_of_distinct_texts(spark, monkeypatch):
    monkeypatch.setattr(secrets, "train", lambda texts: texts)
    docs = spark.range(4000).selectExpr("concat('key a1b2c3d4e5f6 ', id % 5) as text")
    assert len(set(secrets.fit_field(docs, most=3))) == len(secrets.fit_field(docs, most=3)) == 3
    assert sorted(secrets.fit_field(docs)) == [f"key a1b2c3d4e5f6 {k}" for k in range(5)]


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    field = secrets.Field(rng.normal(size=(secrets._BUCKETS, 3)), rng.normal(size=(3, 3)))
    field.move[secrets.OUTSIDE, secrets.INSIDE] = -np.inf
    for n in range(1, 6):
        rows = [rng.integers(0, secrets._BUCKETS, 4) for _ in range(n)]
        emit = field.scores(rows)
        value = lambda tags: -np.inf if tags[0] == 2 else sum(emit[k, t] for k, t in enumerate(tags)) + sum(
            field.move[a, b] for a, b in zip(tags, tags[1:]))
        assert tuple(field.viterbi(rows)) == max(itertools.product(range(3), repeat=n), key=value)


def test_odd_documents(odd, none):
    field = secrets.fit_field(odd)
    rows = secrets.with_secrets(odd, field).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert [tuple(s) for s in r.secret_spans if s.kind != "crf"] == brute(r.text)
    clean = secrets.redacted(odd, field)
    assert clean.columns == odd.columns
    assert [r.text for r in clean.where("doc_id = 11 and text like 'key%'").collect()] == ["key [SECRET] [SECRET]"]
    assert clean.where("text is null").count() == 2
    assert secrets.with_secrets(none, secrets.fit_field(none)).count() == 0


def test_redaction_of_overlapping_spans():
    assert secrets.redact("abcdefgh", [("x", 1, 3), ("y", 2, 5), ("z", 6, 7)]) == "a[SECRET]f[SECRET]h"


def test_long_runs_of_signs_take_linear_time(spark):
    signs = spark.createDataFrame([(1, "=" * 1_000_000), (2, "-" * 1_000_000), (3, "token = abc123abc123")], "doc_id long, text string")
    start = time.time()
    field = secrets.fit_field(signs)
    assert [[s.kind for s in r.secret_spans] for r in secrets.with_secrets(signs, field).orderBy("doc_id").collect()] == [[], [], ["assign"]]
    assert time.time() - start < 30


def test_every_word_is_decoded():
    """Also words without digits, of one case, or short: nothing is left out before the field is asked."""
    import numpy as np

    field = secrets.Field(np.zeros((secrets._BUCKETS, 3)), np.zeros((3, 3)))
    field.move[secrets.OUTSIDE, secrets.INSIDE] = -np.inf
    field.emit[:, secrets.BEGIN] = 1
    text = "of President abcdefghij ABCDEFGHIJ\naB1 \u00e9t\u00e9 x, on"
    starts = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]", text)]
    assert secrets.find(text, field) == [("crf", a, b) for a, b in starts]


def test_secrets_of_one_case_and_without_digits_are_found():
    rng, rows = random.Random(5), []
    for k in range(300):
        value = "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(18, 30)))
        rows.append(f"the service at site{k} then says password = {value} and goes on with many other plain words of {k}1234567 things")
    field = secrets.train(rows)
    text = "the service then says pasword = zxkcwqvbnmlkjhgfdspt and goes on"
    assert [text[a:b] for _, a, b in secrets.find(text, field)] == ["zxkcwqvbnmlkjhgfdspt"]
    assert secrets.find("and goes on with many other plain words of things", field) == []


def test_the_tagger_gives_the_best_paths():
    import numpy as np

    rng = np.random.default_rng(4)
    field = secrets.Field(rng.normal(size=(secrets._BUCKETS, 3)), rng.normal(size=(3, 3)))
    field.move[secrets.OUTSIDE, secrets.INSIDE] = -np.inf
    field.emit[:, secrets.OUTSIDE] += 0.3
    parts = ["-", "a", "key", "Abc", "x=y", "a1b2c3d4e5", "\u00e9", ",", "it's", "x" * 90, "=="]
    for _ in range(300):
        text = " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(rng.integers(0, 9)))
        got = {r[2]: r[5] for r in secrets.Tagger(field).tagged(text)}
        for second, before, start, word, after in secrets._in_context(text):
            tags = field.viterbi(secrets._features(second, before, word, after, secrets._file(text)))
            assert got.pop(start, [0] * len(tags)) == tags
        assert not got


def _trained():
    rng, rows = random.Random(3), []
    for k in range(200):
        word = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        access = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        rows.append(f'some words token = "{word}" and {access} then mail bob{k}@site{k % 9}.org on 2024-05-{k % 28 + 1:02d} or http://a.b/{k}1234567/index.html')
    return secrets.train(rows), rows


def test_few_words_are_decoded_one_by_one(monkeypatch):
    """Distinct words cost a bound each; all scores are summed for those alone that may hold a secret."""
    field, _ = _trained()
    rng, asked, real = random.Random(6), [], secrets.Tagger._facts
    monkeypatch.setattr(secrets.Tagger, "_facts", lambda self, word: asked.append(word) or real(self, word))
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ",", "."]) for _ in range(20_000)]
    words[9_000] = "AKXA7Q2M5N8P3R6T9V2W"
    text = " ".join(words)
    assert [text[a:b] for _, a, b in secrets.find(text, field)] == ["AKXA7Q2M5N8P3R6T9V2W"]
    assert len(asked) < 2_000


def test_pieces_of_a_text_give_the_best_paths(monkeypatch):
    field, rows = _trained()
    rng = random.Random(8)
    parts = [w for row in rows[:40] for w in row.split()] + ["x", "é,", "AKXA7Q2M5N8P3R6T9V2W", "aB3" * 40, "a-b", "--"]
    monkeypatch.setattr(secrets, "_REMEMBERED", 20)
    monkeypatch.setattr(secrets, "_DECODED", 5)
    for size in (1, 7, 40, 1 << 18):
        monkeypatch.setattr(secrets, "_PIECE", size)
        tagger = secrets.Tagger(field)
        for _ in range(100):
            text = rng.choice(["", " ", "\n\t "]) + "".join(rng.choice(parts) + rng.choice([" ", "  ", "\n", " "]) for _ in range(rng.randint(0, 8)))
            got = {r[2]: r for r in tagger.tagged(text)}
            for second, before, start, word, after in secrets._in_context(text):
                tags = field.viterbi(secrets._features(second, before, word, after, secrets._file(text)))
                found = got.pop(start, None)
                assert found == (second, before, start, word, after, tags) if found else not any(tags)
            assert not got
