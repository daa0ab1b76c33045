"""Language ID: averaged hashed subword embeddings with a linear softmax.

Subwords are runs of three and four bytes of the lower-cased text that begin with a letter.
Each has one of ``buckets`` rows of an embedding table; a text is the mean of its subwords'
rows, and a linear softmax over the mean gives the language. Both tables are trained by
stochastic gradient descent in numpy on a bounded sample of labelled texts. A second part of
the sample sets the temperature that calibrates the probability, and the probability below
which a prediction is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from winnow.llm.common import bounded_sample, chunks, remainder, text_buffers

SIZES = (3, 4)
UNDETERMINED = "und"
_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = True
_LETTERS[128:] = True


@dataclass
class LanguageModel:
    """Logits per subword bucket (embedding times softmax weights), and the calibration."""

    languages: list[str]
    table: np.ndarray
    temperature: float
    least: float


def subwords(data: np.ndarray, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the subword of ``size`` bytes at each place, and whether one starts there."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int32), np.zeros(0, bool)
    packed = data[:n].astype(np.uint32)
    for k in range(1, size):
        packed |= data[k:n + k].astype(np.uint32) << np.uint32(8 * k)
    with np.errstate(over="ignore"):
        packed = packed * np.uint32(2654435761 + 2 * size)
    return (packed >> np.uint32(32 - int(buckets).bit_length() + 1)).astype(np.int32), _LETTERS[data[:n]]


def _clean(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes, everything but letters as a space."""
    return np.where(_LETTERS[data], data, np.uint8(32))


def _mean_logits(data, starts, ends, table) -> tuple[np.ndarray, np.ndarray]:
    """Mean logits of each text, and how many subwords it has; texts adjoin."""
    total = np.zeros((len(starts), table.shape[1]))
    count = np.zeros(len(starts))
    for size in SIZES:
        bucket, valid = subwords(data, size, len(table))
        at = np.flatnonzero(valid)
        at = at[at + size <= ends[np.searchsorted(ends, at, "right")]] if len(at) else at
        edges = np.searchsorted(at, starts), np.searchsorted(at, ends)
        bucket, sums = bucket[at], np.zeros(len(at) + 1)
        for column in range(table.shape[1]):
            np.cumsum(table[bucket, column], out=sums[1:])
            total[:, column] += sums[edges[1]] - sums[edges[0]]
        count += edges[1] - edges[0]
    return total / np.maximum(count, 1)[:, None], count


def _softmax(logits: np.ndarray) -> np.ndarray:
    high = np.exp(logits - logits.max(axis=1, keepdims=True))
    return high / high.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], *, buckets: int = 1 << 15, width: int = 16, epochs: int = 8,
          rate: float = 4.0, rejected_share: float = 0.001, seed: int = 1) -> LanguageModel:
    """Fit on four fifths of the sample, calibrate on the rest.

    ``rejected_share`` of the calibration texts that were predicted right fall under the
    probability below which predictions are rejected. Ties and repeated rows are ordinary
    examples. Without any example every text is undetermined; with one language, all are it.
    """
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((buckets, 1)), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    target = np.array([languages.index(x) for x in labels])
    found = []
    for text in texts:
        data = _clean(np.frombuffer(text.lower().encode(), np.uint8))
        parts = [bucket[valid] for bucket, valid in (subwords(data, size, buckets) for size in SIZES)]
        found.append(np.concatenate(parts))
    order = [k for k in rng.permutation(len(texts)) if len(found[k])]
    held = order[: len(order) // 5]
    fit = order[len(order) // 5:]
    table = rng.normal(0, 0.1, (buckets, width))
    weights = rng.normal(0, 0.1, (width, len(languages)))
    steps, batch = 0, 32
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in range(0, len(fit), batch):
            rows = fit[k:k + batch]
            ids = np.stack([rng.choice(found[r], 256) for r in rows])
            mean = table[ids].mean(axis=1)
            error = _softmax(mean @ weights)
            error[np.arange(len(rows)), target[rows]] -= 1
            error /= len(rows)
            back = error @ weights.T
            weights -= step * mean.T @ error
            np.add.at(table, ids.ravel(), np.repeat(-step * back / ids.shape[1] * 8, ids.shape[1], axis=0))
            steps += 1
    table = table @ weights
    temperature, least = 1.0, 0.0
    if held:
        logits = np.stack([table[found[k]].mean(axis=0) for k in held])
        truth = target[held]

        def loss(t: float) -> float:
            return -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()

        temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        chance = _softmax(logits / temperature)
        right = np.sort(chance.max(axis=1)[chance.argmax(axis=1) == truth])
        if len(right):
            least = float(min(right[int(rejected_share * len(right))], 0.9))
    return LanguageModel(languages, table.astype(np.float32), temperature, least)


def fit_model(docs: DataFrame, *, most: int = 4000, seed: int = 6, **options) -> LanguageModel:
    """Train on at most ``most`` texts with a language, whose crc32(doc_id) mod 4 is not 2."""
    rows = docs.where((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = bounded_sample(rows.select("doc_id", F.col("lang").cast("string").alias("lang"), "text"), most, seed)
    return train([r.text for r in found], [r.lang for r in found], **options)


def _guess(model: LanguageModel, lowered: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
    data, starts, ends = text_buffers(lowered)
    clean = _clean(data)
    best, score = np.full(len(starts), -1), np.zeros(len(starts))
    if model.languages:
        for first, stop in chunks(starts, ends):
            base = starts[first]
            logits, count = _mean_logits(clean[base:ends[stop - 1]], starts[first:stop] - base,
                                         ends[first:stop] - base, model.table)
            chance = _softmax(logits / model.temperature)
            # Texts too short for a subword have equal logits; they get the first language.
            best[first:stop] = chance.argmax(axis=1)
            score[first:stop] = chance.max(axis=1)
    return [model.languages[k] if k >= 0 else UNDETERMINED for k in best], score, score < model.least


def with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected``, replacing columns of these names.

    Only the whole text is read. Null texts and texts without a letter are ``und`` with
    score 0 and rejected. ``rejected`` is also true below the calibrated probability; the
    best language is still given then. Repeated rows get the same result; no rows, none.
    """
    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()),
                       StructField("rejected", BooleanType())])

    @F.arrow_udf(kind)
    def guess(lowered: pa.Array) -> pa.Array:
        languages, score, rejected = _guess(model, lowered)
        return pa.StructArray.from_arrays(
            [pa.array(languages, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
            ["lang_pred", "score", "rejected"])

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    names = [n for n in docs.columns if n not in ("lang_pred", "score", "rejected")]
    guessed = docs.select(*names, has_letter.alias("_letter"), guess(F.lower("text")).alias("_guess"))
    return guessed.select(
        *names,
        F.when(F.col("_letter"), F.col("_guess.lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("_letter"), F.col("_guess.score")).otherwise(0.0).alias("score"),
        (~F.col("_letter") | F.col("_guess.rejected")).alias("rejected"))
