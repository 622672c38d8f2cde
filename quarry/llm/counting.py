"""Corpus counts of hashed tokens, with a bounded fan-out.

Groups of documents send their sorted distinct tokens, cut at the edges of equal ranges of the hash space; a range sums
what it gets and answers each group. A group cuts into at most ``FAN`` ranges (or the square root of all ranges, if that
is more), so messages don't grow with the square of the groups. Where more ranges are needed, the groups' messages to a
range are first merged in families of ``FAN`` groups, the merged runs are cut again, and answers go back the same way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import give_back, grow, shrink, squeeze, unsqueeze

#: Text that one group holds; a range is as wide as the tokens of so much text.
GROUP_BYTES = 8 << 20
#: Ranges that a group sends to, and groups in a family.
FAN = 256
#: Text of the groups that one task handles, one after the other.
TASK_BYTES = 32 << 20
_U = np.uint64
SENT = "g int, n int, b int, low binary, high binary, counts binary"
ANSWER = "g int, n int, b int, counts binary"


@dataclass(frozen=True)
class Shape:
    """How many groups, ranges that a group sends to, ranges that each of those is cut into, and tasks."""

    groups: int
    wide: int
    deep: int
    tasks: int

    @staticmethod
    def of(total_bytes: int, partitions: int) -> Shape:
        """One group a partition at least, so that small inputs spread, too."""
        groups = max(partitions, math.ceil(total_bytes / GROUP_BYTES))
        wide = min(groups, max(FAN, math.isqrt(groups)))
        return Shape(groups, wide, math.ceil(groups / wide), max(partitions, math.ceil(total_bytes / TASK_BYTES)))


def cuts(tokens: np.ndarray, parts: int, start: int = 0, span: int = 1 << 64) -> list[int]:
    """Edges of ``parts`` equal ranges of [start, start + span) in sorted tokens."""
    edges = np.array([start + span * k // parts for k in range(1, parts)], _U)
    return [0, *np.searchsorted(tokens, edges).tolist(), len(tokens)]


def _counts(values: np.ndarray) -> bytes:
    """A byte each, shrunk, after the length of that; 255 stands for larger ones, which follow in eight bytes each."""
    small = shrink(np.minimum(values, 255).astype(np.uint8).tobytes())
    return len(small).to_bytes(4, "little") + small + values[values >= 255].astype("<u8").tobytes()


def read_counts(blob: bytes, size: int) -> np.ndarray:
    stop = 4 + int.from_bytes(blob[:4], "little")
    out = np.frombuffer(grow(blob[4:stop], size), np.uint8).astype(np.int64)
    if len(blob) > stop:
        out[out == 255] = np.frombuffer(blob, "<u8", offset=stop).astype(np.int64)
    return out


class Sender:
    """Collects what one group sends."""

    def __init__(self, shape: Shape, group: int):
        self.shape, self.group, self.rows = shape, group, []

    def add(self, n: int, tokens: np.ndarray, counts: np.ndarray) -> None:
        """Sorted distinct tokens of kind ``n``."""
        at = cuts(tokens, self.shape.wide)
        for b, (i, j) in enumerate(zip(at[:-1], at[1:])):
            if i < j:
                self.rows.append((self.group, n, b, *squeeze(tokens[i:j]), _counts(counts[i:j])))

    def table(self) -> pa.Table:
        return pa.table([pa.array(x, t) for x, t in zip(zip(*self.rows) if self.rows else [()] * 6, [pa.int32()] * 3 + [pa.binary()] * 3)], names=["g", "n", "b", "low", "high", "counts"])


def _read(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    runs = [unsqueeze(a, b) for a, b in zip(table.column("low").to_pylist(), table.column("high").to_pylist())]
    return runs, [read_counts(c, len(r)) for c, r in zip(table.column("counts").to_pylist(), runs)]


def _sum(runs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All tokens of sorted runs, their summed counts, and the places of each run's tokens."""
    every = np.sort(np.concatenate(runs))
    keep = np.empty(len(every), bool)
    keep[:1] = True
    np.not_equal(every[1:], every[:-1], out=keep[1:])
    every = every[keep]
    total, places = np.zeros(len(every), np.int64), []
    for run, count in zip(runs, counts):
        at = np.searchsorted(every, run).astype(np.int32)
        total[at] += count
        places.append(at)
    return every, total, places


def _answered(table: pa.Table, keys: list[str], blobs: list[bytes]) -> pa.Table:
    return pa.table([*(table.column(k).cast(pa.int32()) for k in keys), pa.array(blobs, pa.binary())], names=[*keys, "counts"])


def answer(sent: DataFrame, shape: Shape) -> DataFrame:
    """For each row of ``sent`` (``SENT``) the corpus counts of its tokens, in their order (``ANSWER``). Empty in, empty out."""

    def judge(table):
        _, total, places = _sum(*_read(table))
        out = _answered(table, ["g", "n", "b"], [_counts(total[at]) for at in places])
        give_back()
        return out

    if shape.deep == 1:
        return sent.repartition(shape.tasks, "n", "b").groupBy("n", "b").applyInArrow(judge, ANSWER)

    family = sent.withColumn("s", F.floor(F.col("g") / FAN).cast("int")).repartition(shape.tasks, "n", "b", "s")
    keys = ["n", "b", "s"]
    whole = 1 << 64

    def merge(key, table):
        every, total, _ = _sum(*_read(table))
        n, b, s = (k.as_py() for k in key)
        start, stop = whole * b // shape.wide, whole * (b + 1) // shape.wide
        at, rows = cuts(every, shape.deep, start, stop - start), []
        for c, (i, j) in enumerate(zip(at[:-1], at[1:])):
            if i < j:
                rows.append((s, n, b, c, *squeeze(every[i:j]), _counts(total[i:j])))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32()] * 4 + [pa.binary()] * 3)], names=["s", "n", "b", "c", "low", "high", "counts"])

    def settle(table):
        _, total, places = _sum(*_read(table))
        return _answered(table, ["s", "n", "b", "c"], [_counts(total[at]) for at in places]).append_column("size", pa.array([len(p) for p in places], pa.int64()))

    def spread(left, right):
        _, _, places = _sum(*_read(left))
        right = right.sort_by("c")
        total = np.concatenate([read_counts(c, m) for c, m in zip(right.column("counts").to_pylist(), right.column("size").to_pylist())])
        return _answered(left, ["g", "n", "b"], [_counts(total[at]) for at in places])

    merged = family.groupBy(*keys).applyInArrow(merge, "s int, n int, b int, c int, low binary, high binary, counts binary")
    settled = merged.repartition(shape.tasks, "n", "b", "c").groupBy("n", "b", "c").applyInArrow(settle, "s int, n int, b int, c int, counts binary, size long")
    return family.groupBy(*keys).cogroup(settled.repartition(shape.tasks, *keys).groupBy(*keys)).applyInArrow(spread, ANSWER)


def whole_counts(answers: pa.Table, n: int, sizes: list[int]) -> np.ndarray:
    """The counts of a group's sorted tokens of kind ``n`` from its answers; ``sizes``: of its ranges that hold tokens."""
    if not answers.num_rows:  # a side of a cogroup that has no rows may lack its columns, too
        return np.zeros(0, np.int64)
    mine = answers.filter(pa.array(answers.column("n").to_numpy() == n)).sort_by("b")
    blobs = mine.column("counts").to_pylist()
    return np.concatenate([read_counts(c, m) for c, m in zip(blobs, sizes, strict=True)]) if blobs else np.zeros(0, np.int64)
