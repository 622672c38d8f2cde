"""Shared helpers: checkpoint folder, vectorised word hashing, packed integer blobs."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at once; it takes about 40 times as much memory.
SLICE_BYTES = 1 << 19

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []
_libc = None
with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim(0)


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own; a cluster is refused one."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarry-checkpoint-"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written under the checkpoint folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Return freed memory of this worker to the system; workers are reused and would keep their largest size."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def cut(df: DataFrame) -> DataFrame:
    """Materialise into the reliable checkpoint folder and drop the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write a table of its own into the checkpoint folder and read it back: smaller than a checkpoint, and columns can be pruned."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Total UTF-8 bytes of a text column (one scan of that column)."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 12))
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.full(size, p, np.uint64)) for p in (_P, _PINV)]
    return _powers[0], _powers[1]


def string_buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of rows whose texts together take about ``limit`` bytes (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _cut_after(data: np.ndarray, stop: int, edges: np.ndarray) -> int:
    """The first place from ``stop`` on that is no place inside a word: a separator or the edge of a row."""
    k = int(np.searchsorted(edges, stop))
    last = int(edges[k]) if k < len(edges) else len(data)
    while stop < last:
        found = np.flatnonzero(_SPACE[data[stop : min(stop + 4096, last)]])
        if len(found):
            return stop + int(found[0])
        stop = min(stop + 4096, last)
    return last


def word_hashes(offsets: np.ndarray, data: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of texts, with ``fold`` A-Z-lower-cased, and each word's row.

    Works through the bytes in runs of about ``SLICE_BYTES`` that end between words, however long a text is.
    """
    hashes, rows, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        stop = len(data) if at + SLICE_BYTES >= len(data) else _cut_after(data, at + SLICE_BYTES, offsets)
        low = _LOWER[data[at:stop]] if fold else data[at:stop]
        n = len(low)
        word = ~_SPACE[low]
        edge = np.zeros(n + 1, bool)
        edge[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop, side="right")] - at] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = word[:-1]
        start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = word[1:]
        end = np.flatnonzero(word & (~after | edge[1:])) + 1
        power, inverse = power_tables(n)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[low] * power[:n], out=total[1:])
            hashes.append(mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)))
        rows.append(np.searchsorted(offsets, start + at, side="right") - 1)
        at = stop
    return np.concatenate(hashes), np.concatenate(rows)


_ROLE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)


def ngram_hashes(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one row, in order of place, and their rows."""
    if n == 1:
        return h, row
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = len(h) - n + 1
    with np.errstate(over="ignore"):
        out = np.full(last, n, np.uint64)
        for k in range(n):
            out += h[k : k + last] * _ROLE[k]
        out = mix(out)
    same = row[:last] == row[n - 1 :]
    return out[same], row[:last][same]


def shingle_sets(offsets: np.ndarray, data: np.ndarray, n: int) -> list[np.ndarray]:
    """For each row the sorted distinct n-word shingles; fewer words count as one shingle, none as no set."""
    out: list[np.ndarray] = []
    for i, j in slices(offsets):
        part = offsets[i : j + 1] - offsets[i]
        h, row = word_hashes(part, data[offsets[i] : offsets[j]])
        words = np.bincount(row, minlength=j - i)
        first = np.zeros(j - i + 1, np.int64)
        np.cumsum(words, out=first[1:])
        grams, _ = ngram_hashes(h, row, n)
        at = 0
        for k in range(j - i):
            w = int(words[k])
            if w >= n:
                own = grams[at : at + w - n + 1]
                at += w - n + 1
                own = np.sort(own)
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                out.append(own[keep])
            elif w:
                with np.errstate(over="ignore"):
                    x = np.full(1, 0xABCD00 + w, np.uint64)
                    for m in range(w):
                        x += h[first[k] + m] * _ROLE[m]
                    out.append(mix(x))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def shrink(values: bytes) -> bytes:
    """Bytes of few different values, by their frequencies."""
    return pa.Codec("zstd", compression_level=1).compress(values, asbytes=True)


def grow(blob: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(blob, decompressed_size=size, asbytes=True)


def squeeze(values: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted unsigned integers as differences, byte by byte: the low five bytes, of which nothing can be saved, and the shrunk high three."""
    planes = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return planes[:5].tobytes(), shrink(planes[5:].tobytes())


def unsqueeze(low: bytes, high: bytes) -> np.ndarray:
    n = len(low) // 5
    planes = np.empty((n, 8), np.uint8)
    planes[:, :5] = np.frombuffer(low, np.uint8).reshape(5, n).T
    planes[:, 5:] = np.frombuffer(grow(high, 3 * n), np.uint8).reshape(3, n).T
    return np.cumsum(planes.view("<u8").ravel(), dtype=np.uint64)
