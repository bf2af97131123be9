"""Helpers shared by the corpus operators: tables, stored intermediates, Arrow batches, hashed words."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path

# White space of the word rule [^\\x20\\x09-\\x0D]+, which is also what bytes.split() splits on.
SPACE = b"\x09\x0a\x0b\x0c\x0d\x20"
WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_SCOPES: list[list[str]] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, statistics are known, columns can be pruned,
    and a lost executor costs only the tasks it ran. Inside `scratch` the table goes when the scope ends."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables stored inside are deleted at the end. What is given to the yielded function is stored too and outlives the scope, so
    only such tables may be used after it."""
    mine: list[str] = []
    _SCOPES.append(mine)

    def keep(df: DataFrame, label: str) -> DataFrame:
        out, path = stored(df, label), mine.pop()
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(path)
        return out

    try:
        yield keep
    finally:
        _SCOPES.pop()
        for path in mine:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


# Rows of a broadcast table of ids and a few numbers: tens of MB at most.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored narrow table with a broadcast hint if a count shows that it is small; else unhinted."""
    return F.broadcast(df) if df.count() <= most else df


def binary(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def map_texts(df: DataFrame, keep: list[str], text: str, make: Callable[[], Callable[[list], list]], schema: str, most: int = 2_000_000,
              count: int = 2_000) -> DataFrame:
    """`keep` columns and what a function gives for each text. `make` runs once per task and returns the function, which takes
    a list of UTF-8 texts (None for null) and returns a list of Arrow arrays in the order of `schema`. It gets about `most` bytes and at most
    `count` texts at once, and only those are Python objects."""
    src = df.select(*[F.col(k) for k in keep], F.col(text).cast("string").alias("_text"))
    fields = ", ".join(f"{k} {t}" for k, t in src.select(*keep).dtypes)
    out = f"{fields}, {schema}" if fields else schema
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, names = None, None
        for b in batches:
            fn = fn or make()
            texts = b.column(n)
            for at, size in spans(pc.binary_length(texts).to_pylist(), most, count):
                cols = fn(binary(texts.slice(at, size)))
                names = names or [f"c{i}" for i in range(n + len(cols))]
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(at, size) for i in range(n)], *cols], names)

    return src.mapInArrow(run, out)


def spans(sizes: list[int | None], most: int, count: int) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts of about `most` bytes and at most `count` texts, so that working arrays stay small; a longer text
    is a run of its own."""
    at, total = 0, 0
    for i, k in enumerate(sizes):
        k = k or 0
        if i > at and (total + k > most or i - at == count):
            yield at, i - at
            at, total = i, 0
        total += k
    if at < len(sizes):
        yield at, len(sizes) - at


def pieces(texts: list, most: int = 2_000_000, count: int = 2_000) -> Iterator[tuple[int, list]]:
    """The same of a list of texts."""
    for at, n in spans([len(t) if t else 0 for t in texts], most, count):
        yield at, texts[at:at + n]


U = np.uint64
_MUL = U(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D          # odd, so it has an inverse modulo 2^64
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing function (two multiply-shift rounds)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=U)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, and where each text's words begin (one more entry than texts).
    A word's hash is its polynomial in the byte values, taken from prefix sums, so no word becomes a Python object."""
    joined = b" ".join((t or b"").translate(LOWER) for t in texts)
    if not joined:
        return np.zeros(0, U), np.zeros(len(texts) + 1, np.int64)
    buf = np.frombuffer(joined, dtype=np.uint8)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum((buf.astype(U) + U(1)) * up[:len(buf)], out=prefix[1:])
    h = mix((prefix[ends] - prefix[starts]) * down[starts] + _MUL * (ends - starts).astype(U))
    sizes = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    return h, np.searchsorted(starts, begins).astype(np.int64)


def shingles(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Per text, its distinct k-word shingles as sorted 64-bit hashes. With fewer words the whole sequence is one shingle;
    without words the set is empty."""
    h, at = word_hashes(texts)
    out = []
    for i in range(len(texts)):
        w = h[at[i]:at[i + 1]]
        if not len(w):
            out.append(w)
            continue
        n = min(k, len(w))
        s = np.full(len(w) - n + 1, n, dtype=U)
        for j in range(n):
            s = mix(s * _MUL + w[j:len(w) - n + 1 + j])
        out.append(np.unique(s))
    return out


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrow lists of numpy arrays."""
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int64), type=kind))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
