"""Text helpers that several operators share: byte buffers, words, rolling hashes, scratch folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once, unless one text alone is longer.
CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A random odd number per byte value.
_CODES = np.random.default_rng(20).integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place that ``spark.checkpoint.dir`` names.

    Only a local session without that setting gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="winnow-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared scratch folder and read again, which cuts the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(docs: DataFrame, blocks: int, name: str = "block") -> DataFrame:
    """Rows with a block number, by a hash of id and text, dealt out by it."""
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    return docs.withColumn(name, number).repartition(blocks, name)


def block_count(docs: DataFrame, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` the texts fill."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def sha256_hex(column: Column) -> Column:
    return F.sha2(column, 256)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column, and where each text starts and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.string())
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    if len(at) == 0:
        at = np.zeros(1, np.int64)
    raw = raw[at[0]:at[-1]]
    at = at - at[0]
    return raw, at[:-1], at[1:]


def chunks(starts: np.ndarray, ends: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows, first and after the last, whose texts have at most ``most`` bytes together."""
    row = 0
    while row < len(starts):
        stop = max(row + 1, int(np.searchsorted(ends, starts[row] + most, "right")))
        yield row, stop
        row = stop


def slices(*columns, most: int = CHUNK) -> Iterator[tuple]:
    """String columns of a batch a few rows at a time, about ``most`` bytes of each."""
    bounds = [text_buffers(column)[1:] for column in columns]
    row, size = 0, len(columns[0])
    while row < size:
        stops = [int(np.searchsorted(ends, starts[row] + most, "right")) for starts, ends in bounds]
        stop = max(row + 1, min(stops))
        yield (row, *(column.slice(row, stop - row) for column in columns))
        row = stop


def mixed(keys: np.ndarray) -> np.ndarray:
    """Keys with every bit depending on every other."""
    with np.errstate(over="ignore"):
        keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return keys ^ (keys >> np.uint64(31))


class Rolling:
    """64-bit hashes of any spans of a byte buffer, from one prefix sum modulo 2**64."""

    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    @classmethod
    def _grow(cls, size: int) -> None:
        if len(cls._powers) < size:
            size = max(size, 1 << 16)
            with np.errstate(over="ignore"):
                for name, step in (("_powers", _BASE), ("_inverses", _INVERSE)):
                    row = np.full(size, step, np.uint64)
                    row[0] = 1
                    setattr(cls, name, np.multiply.accumulate(row))

    def __init__(self, data: np.ndarray) -> None:
        self._grow(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_CODES[data] * self._powers[: len(data)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each span's bytes."""
        with np.errstate(over="ignore"):
            return (self.sums[ends] - self.sums[starts]) * self._inverses[starts]

    def windows(self, width: int) -> np.ndarray:
        """A hash of every span of ``width`` bytes."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return (self.sums[width:] - self.sums[:n]) * self._inverses[:n]


def word_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, apart: np.ndarray = SPACES):
    """Where the words of adjoining texts start and end, and how many words each text has."""
    gap = np.ones(len(data) + 2, np.int8)
    gap[1:-1] = apart[data]
    turns = np.diff(gap)
    first, last = np.flatnonzero(turns == -1), np.flatnonzero(turns == 1)
    # A word may run over the border of two texts: cut it there.
    inner = starts[(starts > 0) & (starts < len(data))]
    inner = np.unique(inner[(gap[inner] == 0) & (gap[inner + 1] == 0)]) if len(inner) else inner
    if len(inner):
        first, last = np.sort(np.concatenate([first, inner])), np.sort(np.concatenate([last, inner]))
    counts = np.searchsorted(first, ends, "left") - np.searchsorted(first, starts, "left")
    return first, last, counts


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def bounded_sample(rows: DataFrame, most: int, seed: int) -> list:
    """At most ``most`` rows, the first by a hash of all columns; the same on every run.

    A share of about twice as many is filtered first, so that no task sends many rows.
    """
    total = rows.count()
    hashed = rows.withColumn("_hash", F.xxhash64(F.lit(seed), *rows.columns))
    if total > 2 * most:
        cut = int(-(1 << 63) + (1 << 64) * (2 * most / total))
        hashed = hashed.where(F.col("_hash") < cut)
    return hashed.orderBy("_hash", *rows.columns).limit(most).drop("_hash").collect()


def text_id() -> Column:
    """The text's identity: half of its SHA-256; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), 1, 16)


def once_per_task(rows: DataFrame) -> DataFrame:
    """``id`` and ``text`` of every text a task meets, without those it has given out before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keep = []
            for k, key in enumerate(batch.column("id").to_pylist()):
                if key not in seen:
                    seen.add(key)
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    return rows.select("id", "text").mapInArrow(run, "id binary, text string")
