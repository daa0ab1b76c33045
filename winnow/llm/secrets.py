"""Secret scans: fixed patterns, and a linear-chain conditional random field beside them.

The field tags the tokens of a word (runs of letters and digits, and single other
characters) as begin, inside or outside of a secret. Its features are a token's shape,
length and variety, its neighbours, the words around, and two shares of the file. It is
trained by stochastic gradient descent on a bounded sample, where the patterns' spans are
the labels, and decodes every word by Viterbi. Weights are summed once per distinct word, and
what stands around it is added per occurrence.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from winnow.llm.common import bounded_sample, once_per_task, stored, text_id

#: Kinds in order, with the group whose length counts and the least length.
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
#: Of the hexadecimal runs, the ones that can count; a run is maximal, so no shorter one hides it.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = (*PATTERNS, "crf")

#: What a run must have: a digit, or small and capital letters that are no mere capitalised word.
_ASKS = re.compile(r"[0-9]|[a-z][+/_.=-]*[A-Z]|[A-Z][+/_.=-]*[A-Z][+/_.=-]*[a-z]")
_SPACE_BEFORE, _SPACE_AFTER = re.compile(r"\s"), re.compile(r"\s|$")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_WORD = re.compile(r"\S+")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
_BUCKETS = 1 << 14
#: Words that a tagger remembers at a time, those it remembers with all scores, and the longest of them.
_REMEMBERED, _DECODED, _LONGEST = 1 << 17, 1 << 13, 64
#: Characters of a text that are decoded at a time, up to the next white space.
_PIECE = 1 << 18
OUTSIDE, BEGIN, INSIDE = 0, 1, 2

SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()),
                              StructField("end", LongType())]))


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank of the kind, kind, end) of the fixed patterns' matches, in order."""
    found = []
    lowered = text.lower()  # a text without any of these has no match of the slow pattern
    named = any(part in lowered for part in ("passw", "secret", "token", "api"))
    for rank, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        if kind == "assign" and not named:
            continue
        for m in (_LONG_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, kind, m.end()))
    return sorted(found)


def words_in_question(text: str) -> list[tuple[int, int]]:
    """Spans of the words that look like a secret: the field learns from them in every epoch."""
    found, at = [], 0
    while m := _ASKS.search(text, at):
        start = m.start()
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        end = _SPACE_AFTER.search(text, m.end()).start()
        if any(_ASKS.search(run[0]) for run in _RUN.finditer(text, start, end)):
            found.append((start, end))
        at = max(end, m.end())
    return found


_RUNS = re.compile(r"(.)\1+", re.DOTALL)
_KINDS_OF_SIGN = str.maketrans({chr(c): "0" if chr(c).isdigit() else "A" if chr(c).isupper() else "a"
                                for c in range(128) if chr(c).isalnum()})


def _shape(token: str) -> str:
    if token.isascii():
        if token.isalpha() and token.islower():
            return "a"
        kinds = token.translate(_KINDS_OF_SIGN)
    else:
        kinds = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token)
    return _RUNS.sub(r"\1", kinds)[:8]


@lru_cache(_DECODED)
def _entropy(counts: tuple[int, ...]) -> int:
    shares = np.array(counts) / sum(counts)
    return int(-(shares * np.log2(shares)).sum() * 2)


#: All that can come out for letters and digits.
_VARIETIES = range(12)


def _variety(token: str) -> int:
    return _entropy(tuple(sorted(map(token.count, set(token)))))


_HEX = re.compile(r"[0-9a-f]+")


def _look(token: str) -> tuple:
    """What the features of a token alone are made of."""
    shape = _shape(token)
    return (shape, min(len(token), 48) // 4, _variety(token), _HEX.fullmatch(token) is not None,
            token[:4] if shape[:1] == "A" else shape[:1])


@lru_cache(_DECODED)
def _own(shape: str, size: int, variety: int, is_hex: bool, head: str) -> list[int]:
    """Features of the token alone."""
    return list(map(_number, (
        "bias", f"shape={shape}", f"size={size}", f"mixed={shape}:{size // 2}", f"variety={variety}",
        f"hex={is_hex}:{size // 2}", f"head={head}")))


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) % _BUCKETS


_LEFT, _LEFT2 = zlib.crc32(b"left="), zlib.crc32(b"left2=")


def _start(word: str) -> str:
    return word[:40].lower()[:12]


def _left(before: str) -> int:
    return zlib.crc32(_start(before).encode(), _LEFT) % _BUCKETS


def _left2(second: str, before: str | None) -> int:
    return zlib.crc32(f"{_start(second)}:{before and before[:24]}"[:18].encode(), _LEFT2) % _BUCKETS


@lru_cache(_DECODED)
def _at_right(shape: str) -> int:
    return _number(f"right={shape}")


def _right(after: str) -> int:
    return _at_right(_shape(after[:40]))


def _in_context(text: str) -> Iterator[tuple[str, str, int, str, str]]:
    """Second word before, word before, start, word and word after, for every word; ``-`` where there is none.

    The only word before counts as the second one, too.
    """
    second = before = "-"
    word, start = None, 0
    for k, m in enumerate(_WORD.finditer(text)):
        after = m[0]
        if word is not None:
            yield second, before, start, word, after
            second, before = before if k > 1 else word, word
        word, start = after, m.start()
    if word is not None:
        yield second, before, start, word, "-"


def _features(second: str, before: str, word: str, after: str, file: tuple[str, ...]) -> list[np.ndarray]:
    """The hashed features of each token of a word; the last three tell what stands around it."""
    tokens = _TOKEN.findall(word)
    rows = []
    for k, token in enumerate(tokens):
        near = [
            _left(tokens[k - 1] if k else before),
            _left2(tokens[k - 2] if k > 1 else second, tokens[k - 1] if k else None),
            _right(tokens[k + 1] if k + 1 < len(tokens) else after.lower()),
        ]
        at_file = [_number(f"{f}:{len(token) >= 8}") for f in file]
        rows.append(np.array([*_own(*_look(token)), *at_file, *near]))
    return rows


def _file(text: str) -> tuple[str, ...]:
    """Features of the whole file: shares of digits and of quotes and signs, in powers of two."""
    size = max(len(text), 1)
    digits = sum(map(text.count, "0123456789"))
    signs = sum(map(text.count, "=\"':;{}"))
    return tuple(f"{name}={int(math.log2(n / size + 1e-4))}" for name, n in (("digits", digits), ("signs", signs)))


@dataclass
class Field:
    """Emission weights by feature and tag, and transition weights; outside to inside is barred."""

    emit: np.ndarray
    move: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.stack([self.emit[row].sum(axis=0) for row in rows])

    def viterbi(self, rows: list[np.ndarray]) -> list[int]:
        """The best tags; of equal ones, the lowest."""
        emit = self.scores(rows)
        best, back = emit[0] + np.array([0, 0, -np.inf]), []
        for row in emit[1:]:
            through = best[:, None] + self.move
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + row
        tags = [int(best.argmax())]
        for row in reversed(back):
            tags.append(int(row[tags[-1]]))
        return tags[::-1]


def _gradient(field: Field, rows: list[np.ndarray], tags: list[int], rate: float) -> None:
    """One step up the log-likelihood of a tagged word, by forward and backward sums."""
    emit = field.scores(rows)
    n = len(rows)
    first = np.array([0, 0, -1e9])
    move = np.maximum(field.move, -1e9)
    forward, backward = np.zeros((n, 3)), np.zeros((n, 3))
    forward[0] = emit[0] + first
    for k in range(1, n):
        forward[k] = np.logaddexp.reduce(forward[k - 1][:, None] + move, axis=0) + emit[k]
    for k in range(n - 2, -1, -1):
        backward[k] = np.logaddexp.reduce(move + (emit[k + 1] + backward[k + 1])[None, :], axis=1)
    total = np.logaddexp.reduce(forward[-1])
    chance = np.exp(forward + backward - total)
    chance[np.arange(n), tags] -= 1
    for k, row in enumerate(rows):
        np.subtract.at(field.emit, row, rate * chance[k])
    for k in range(1, n):
        pair = np.exp(forward[k - 1][:, None] + move + (emit[k] + backward[k])[None, :] - total)
        pair[tags[k - 1], tags[k]] -= 1
        field.move -= rate * pair
    field.move[OUTSIDE, INSIDE] = -np.inf


class Tagger:
    """Decodes every word of a text by a field that stays as it is.

    A table holds of every distinct word an upper bound of what begin or inside can win over outside, and what
    the word adds at most to those around it. Words whose sum stays below zero are all outside on their best
    path; the others are decoded one by one.
    """

    def __init__(self, field: Field):
        self.emit, self.move = list(map(tuple, field.emit.tolist())), field.move.tolist()
        self.begins = (field.emit[:, BEGIN] - field.emit[:, OUTSIDE]).tolist()
        self.gains = (field.emit[:, 1:] - field.emit[:, :1]).max(axis=1).tolist()
        self.plain = self.gains[_at_right("a")]
        (oo, ob, _), (bo, bb, bi), (io, ib, ii) = self.move
        #: What a token after the first can win by its unknown second neighbour and the step to it, and a way back to outside.
        self.later, self.back = max(self.gains) + max(ob, bb, bi, ib, ii) - oo, max(bo - oo, io - oo, 0.0)
        self.words: dict[str, int] = {}
        self.table, self.filled = np.zeros((1 << 10, 4)), 0
        self.facts: dict[str, tuple] = {}
        self.looks: dict[tuple, tuple[float, float, float]] = {}
        self.tokens: dict[str, tuple[float, float, float]] = {}
        self.parts: dict[str, tuple[float, float, float]] = {}
        self.rough: dict[tuple, float] = {}

    def _sum(self, numbers: Iterable[int]) -> tuple[float, float, float]:
        a = b = c = 0.0
        for x, y, z in map(self.emit.__getitem__, numbers):
            a, b, c = a + x, b + y, c + z
        return a, b, c

    def _alone(self, token: str) -> tuple[float, float, float]:
        """Scores of a token by itself."""
        found = self.tokens.get(token)
        if found is None:
            look = _look(token)
            found = self.looks.get(look)
            if found is None:
                if len(self.looks) >= _DECODED:
                    self.looks.clear()
                found = self.looks[look] = self._sum(_own(*look))
            if len(token) <= _LONGEST:
                if len(self.tokens) >= _DECODED:
                    self.tokens.clear()
                self.tokens[token] = found
        return found

    def _inner(self, tokens: list[str]) -> Iterator[tuple[float, float, float]]:
        """Scores of the tokens by what stands in their word."""
        last, emit = len(tokens) - 1, self.emit
        if last == 0:
            yield self._alone(tokens[0])
            return
        for k, token in enumerate(tokens):
            a, b, c = self._alone(token)
            if k:
                x, y, z = emit[_left(tokens[k - 1])]
                a, b, c = a + x, b + y, c + z
            if k > 1:
                x, y, z = emit[_left2(tokens[k - 2], tokens[k - 1])]
                a, b, c = a + x, b + y, c + z
            if k < last:
                x, y, z = emit[_right(tokens[k + 1])]
                a, b, c = a + x, b + y, c + z
            yield a, b, c

    def _facts(self, word: str) -> tuple:
        """Of a word: its tokens, their scores, the start it is known by, what it adds as the word before, second
        before and after, and by how much begin beats outside: at its first token, before, second before, after."""
        tokens = [word] if word.isascii() and word.isalnum() else _TOKEN.findall(word)
        plain = word.isascii() and word.isalpha() and word.islower()
        start = word[:12] if plain else _start(word)
        known = start.encode()
        left = self.emit[zlib.crc32(known, _LEFT) % _BUCKETS]
        left2 = self.emit[zlib.crc32(known + b":None", _LEFT2) % _BUCKETS]
        right = self.emit[_right("a" if plain else word.lower())]
        short = len(word) <= _LONGEST
        inner = list(self._inner(tokens)) if short else None
        own = inner[0][1] - inner[0][0] if short else 0.0
        found = tokens, inner, start, left, left2, right, own, left[1] - left[0], left2[1] - left2[0], right[1] - right[0]
        if short:
            if len(self.facts) >= _DECODED:
                self.facts.clear()
            self.facts[word] = found
        return found

    def _rough(self, token: str, shape: str) -> float:
        """What begin can win over outside by the token alone, whatever its variety."""
        look = shape, min(len(token), 48) // 4, _HEX.fullmatch(token) is not None, token[:4] if shape[:1] == "A" else shape[:1]
        found = self.rough.get(look)
        if found is None:
            if len(self.rough) >= _DECODED:
                self.rough.clear()
            found = self.rough[look] = max(
                sum(map(self.begins.__getitem__, _own(*look[:2], variety, *look[2:]))) for variety in _VARIETIES)
        return found

    def _part(self, token: str) -> tuple[float, float, float]:
        """What a token of several can win by itself, and what it adds to the next and to the one before."""
        found = self.parts.get(token)
        if found is None:
            a, b, c = self._alone(token)
            found = max(b, c) - a, self.gains[_left(token)], self.gains[_right(token)]
            if len(self.parts) >= _REMEMBERED:
                self.parts.clear()
            self.parts[token] = found
        return found

    def _bounds(self, word: str) -> tuple[float, float, float, float]:
        """What a word's tokens can win at most, and what it adds at most as the word before, second before and after."""
        gains, whole = self.gains, word.isascii() and word.isalnum()
        plain = whole and word.isalpha() and word.islower()
        known = (word[:12] if plain else _start(word)).encode()
        left, left2 = gains[zlib.crc32(known, _LEFT) % _BUCKETS], gains[zlib.crc32(known + b":None", _LEFT2) % _BUCKETS]
        right = self.plain if plain else gains[_right(word.lower())]
        if len(word) > _LONGEST:
            return math.inf, left, left2, right
        tokens = [word] if whole else _TOKEN.findall(word)
        if len(tokens) == 1:
            return self._rough(word, "a" if plain else _shape(word)), left, left2, right
        most, own, beside = -math.inf, None, 0.0
        for token in tokens:
            now, to_right, to_left = self.parts.get(token) or self._part(token)
            if own is None:
                own = now
            else:
                if own + to_left > most:
                    most = own + to_left
                own = now + beside + self.later
            beside = to_right
        return max(most, own) + self.back, left, left2, right

    def _places(self, words: list[str]) -> np.ndarray:
        """The table's rows of these words."""
        if self.filled > _REMEMBERED:
            self.words.clear()
            self.filled = 0
        places = list(map(self.words.get, words))
        if None in places:
            new = {word: self.filled + k for k, word in enumerate(dict.fromkeys(w for w, p in zip(words, places) if p is None))}
            self.filled += len(new)
            if self.filled > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((self.filled, 4))])
            self.table[self.filled - len(new):self.filled] = list(map(self._bounds, new))
            places = [new[w] if p is None else p for w, p in zip(words, places)]
            self.words.update(new if max(map(len, new)) <= _LONGEST else {w: p for w, p in new.items() if len(w) <= _LONGEST})
        return np.array(places)


    def _path(self, tokens: list[str], inner: Iterable[tuple], left: tuple, left2: tuple, right: tuple, second: str,
              file: tuple[tuple, tuple]) -> list[int] | None:
        """The best tags of a word, None if all are outside; of equal ones, the lowest."""
        (oo, ob, _), (bo, bb, bi), (io, ib, ii) = self.move
        back, last, o, b, i = bytearray(), len(tokens) - 1, 0.0, 0.0, -math.inf
        for k, (x, y, z) in enumerate(inner):
            added = [file[len(tokens[k]) >= 8]]
            if k == 0:
                added += [left, left2]
            if k == 1:
                added.append(self.emit[_left2(second, tokens[0])])
            if k == last:
                added.append(right)
            for p, q, r in added:
                x, y, z = x + p, y + q, z + r
            if k == 0:
                o, b = x, y
                continue
            # Outside after outside, begin or inside; so for begin. Inside comes after these two only.
            to_o, from_o = o + oo, 0
            if b + bo > to_o:
                to_o, from_o = b + bo, 1
            if i + io > to_o:
                to_o, from_o = i + io, 2
            to_b, from_b = o + ob, 0
            if b + bb > to_b:
                to_b, from_b = b + bb, 1
            if i + ib > to_b:
                to_b, from_b = i + ib, 2
            to_i, from_i = b + bi, 1
            if i + ii > to_i:
                to_i, from_i = i + ii, 2
            back.append(from_o + 3 * from_b + 9 * from_i)
            o, b, i = to_o + x, to_b + y, to_i + z
        tag = OUTSIDE if o >= b and o >= i else BEGIN if b >= i else INSIDE
        if tag == OUTSIDE and not any(step % 3 for step in back):
            return None
        tags = [tag]
        for step in reversed(back):
            tags.append(step // (1, 3, 9)[tags[-1]] % 3)
        return tags[::-1] if any(tags) else None

    def tagged(self, text: str) -> Iterator[tuple[str, str, int, str, str, list[int]]]:
        """The words, with what stands around them and the tags of their tokens, that aren't all outside."""
        by_length = [self._sum(_number(f"{f}:{long}") for f in _file(text)) for long in (False, True)]
        least = -max(max(e[BEGIN], e[INSIDE]) - e[OUTSIDE] for e in by_length) - 1e-6  # sums in another order differ a little
        second = before = "-"
        at, is_first = 0, True
        while at < len(text):
            stop = _SPACE_AFTER.search(text, min(at + _PIECE, len(text))).start()
            words = text[at:stop].split()
            if words:
                coming = _WORD.search(text, stop)
                line = [second, before, *words, coming[0] if coming else "-"]
                places = self._places(line)
                own, seconds = places[2:-1], places[:-3].copy()
                if is_first and len(words) > 1:  # the only word before counts as the second one, too
                    seconds[1] = places[2]
                table = self.table
                most = table[own, 0] + np.maximum(table[places[1:-2], 1], 0) + np.maximum(table[seconds, 2], 0) + np.maximum(
                    table[places[3:], 3], 0)
                starts = None
                for k in np.flatnonzero(most > least).tolist():
                    further = line[2] if is_first and k == 1 else line[k]
                    if tags := self._tags(further, *line[k + 1:k + 4], by_length):
                        starts = starts or [m.start() for m in _WORD.finditer(text, at, stop)]
                        yield further, line[k + 1], starts[k], line[k + 2], line[k + 3], tags
                second, before = (words[0], words[0]) if is_first and len(words) == 1 else (line[-3], line[-2])
                is_first = False
            at = stop

    def _tags(self, second: str, before: str, word: str, after: str, by_length: list[tuple]) -> list[int] | None:
        """The best tags of a word among others, None if all are outside."""
        at_second, at_before, at_word, at_after = (self.facts.get(w) or self._facts(w) for w in (second, before, word, after))
        tokens, inner = at_word[0], at_word[1]
        if inner and len(tokens) == 1:
            e = by_length[len(word) >= 8]
            return [BEGIN] if at_word[6] + (e[BEGIN] - e[OUTSIDE]) + at_before[7] + at_second[8] + at_after[9] > 0 else None
        return self._path(tokens, inner or self._inner(tokens), at_before[3], at_second[4], at_after[5], second, by_length)


def train(texts: list[str], *, epochs: int = 6, rate: float = 0.1, near_dropout: float = 0.3, seed: int = 7,
          margin: float = 4.0) -> Field:
    """Fit on the patterns' spans in these texts.

    Words that touch a span or look like a secret are learned in every epoch. After each epoch
    all words of a part of the texts are decoded, every text once, and those that the field would take for a
    secret if ``margin`` were taken from outside are learned, too. In a share ``near_dropout`` of the words, what stands around a token is
    left out, so that secrets without a tell-tale word before them are learned by their shape.
    """
    field = Field(np.zeros((_BUCKETS, 3)), np.zeros((3, 3)))
    field.move[OUTSIDE, INSIDE] = -np.inf
    examples, learned = [], []
    for text in texts:
        base, file = base_spans(text), _file(text)
        starts, reach = [s[0] for s in base], list(accumulate((s[3] for s in base), max))
        asked = {start for start, _ in words_in_question(text)}
        learned.append(set())
        for second, before, start, word, after in _in_context(text):
            near = base[bisect_right(reach, start):bisect_left(starts, start + len(word))]
            if not near and start not in asked:
                continue
            learned[-1].add(start)
            tags, inside = [], False
            for m in _TOKEN.finditer(word):
                a, b = start + m.start(), start + m.end()
                hit = [s for s in near if s[0] <= a and b <= s[3] and not (s[2] == "assign" and _before_value(text, s, a))]
                tags.append(OUTSIDE if not hit else INSIDE if inside else BEGIN)
                inside = bool(hit)
            examples.append((_features(second, before, word, after, file), tags))
    rng = np.random.default_rng(seed)

    def learn(rows: list[np.ndarray], tags: list[int], epoch: int) -> None:
        if rng.random() < near_dropout:
            rows = [row[:-3] for row in rows]
        _gradient(field, rows, tags, rate / (1 + epoch))

    for epoch in range(epochs):
        for k in rng.permutation(len(examples)):
            learn(*examples[k], epoch)
        stricter = field.emit.copy()
        stricter[_number("bias"), OUTSIDE] -= margin
        tagger = Tagger(Field(stricter, field.move))
        close = [(_features(second, before, word, after, _file(text)), [OUTSIDE] * len(tags))
                 for text, known in zip(texts[epoch::epochs], learned[epoch::epochs])
                 for second, before, start, word, after, tags in tagger.tagged(text) if start not in known]
        for k in rng.permutation(len(close)):
            learn(*close[k], epoch)
    return field


def _before_value(text: str, span: tuple[int, int, str, int], at: int) -> bool:
    m = PATTERNS["assign"][0].match(text, span[0])
    return m is not None and at < m.start(2)


def fit_field(docs: DataFrame, *, most: int = 3000, seed: int = 7, **options) -> Field:
    """Train on at most ``most`` distinct texts among those with a word of digits and other signs."""
    rows = docs.where(F.col("text").rlike(r"[0-9][A-Za-z0-9+/_.=-]{7}")).select(
        text_id().alias("id"), "text")
    ids = stored(rows.select("id").distinct(), "sample")  # a text counts once, however many copies it has
    chosen = bounded_sample(ids, most, seed)
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, ids.schema))
    texts = once_per_task(rows.join(wanted, "id", "left_semi")).dropDuplicates(["id"])
    return train([r.text for r in sorted(texts.collect(), key=lambda r: bytes(r.id))], **options)


def find(text: str | None, field: Field | Tagger) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind: the patterns' spans, and those the field adds.

    Places are code points, ends exclusive. The field's spans that touch a pattern's are left
    out. Null and empty texts have none. Give a tagger for many texts.
    """
    if not text:
        return []
    tagger = field if isinstance(field, Tagger) else Tagger(field)
    found = base_spans(text)
    starts, reach = [s[0] for s in found], list(accumulate((s[3] for s in found), max))
    added = []
    for _, _, at, word, _, tags in tagger.tagged(text):
        spans = [(at + m.start(), at + m.end()) for m in _TOKEN.finditer(word)]
        for k, tag in enumerate(tags):
            if tag == BEGIN:
                last = k
                while last + 1 < len(tags) and tags[last + 1] == INSIDE:
                    last += 1
                first, stop = spans[k][0], spans[last][1]
                near = bisect_left(starts, stop) - 1  # of the patterns' spans that start before this one's end
                if near < 0 or reach[near] <= first:
                    added.append((first, len(PATTERNS), "crf", stop))
    return [(kind, start, end) for start, _, kind, end in sorted(found + added)]


def with_secrets(docs: DataFrame, field: Field, name: str = "secret_spans") -> DataFrame:
    """Add the spans of every whole text as an array of (kind, start, end); replaces ``name``."""

    @F.arrow_udf(SPANS)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = Tagger(field)
        for texts in batches:
            rows = [[dict(zip(("kind", "start", "end"), s)) for s in find(text.as_py(), tagger)] for text in texts]
            yield pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    return docs.withColumn(name, spans(F.col("text")))


def redact(text: str | None, spans: list, mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by one mark."""
    if not text or not spans:
        return text
    parts, at = [], 0
    for _, start, end in sorted(((k, s, e) for k, s, e in spans), key=lambda s: s[1:]):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """The same rows and columns, with the secrets in ``text`` replaced by a mark."""

    @F.arrow_udf(StringType())
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = Tagger(field)
        for texts in batches:
            yield pa.array((redact(text, find(text, tagger)) for text in map(pa.StringScalar.as_py, texts)), pa.string())

    return docs.withColumn("text", clean(F.col("text")))
