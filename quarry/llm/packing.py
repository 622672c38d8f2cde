"""Best-fit packing of token pieces by bin completion.

Only the histogram of piece lengths (at most ``capacity`` classes) is planned on the driver. The plan is a list of
segments: a range of ranks of one length goes to a range of sequences at one offset. Every piece finds its place by
its length and its rank among pieces of that length, so no task holds more than its own pieces.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, give_back
from quarry.llm.tokens import encoder

Segment = tuple[int, int, int, int, int, int]  # length, first rank, count, first sequence, pieces a sequence, offset


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's bound: items over half a bin need bins of their own, the rest fills what they leave."""
    c = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        c[size] = n
    below = np.concatenate([[0], np.cumsum(c)])  # of [0, s)
    weight = np.concatenate([[0], np.cumsum(c * np.arange(capacity + 1))])
    half = capacity // 2
    k = np.arange(half + 1)
    alone = below[capacity + 1] - below[capacity - k + 1]
    paired = below[capacity - k + 1] - below[half + 1]
    room = capacity * paired - (weight[capacity - k + 1] - weight[half + 1])
    small = weight[half + 1] - weight[k]
    return int(max(-(-weight[-1] // capacity), (alone + paired + np.maximum(0, -(-(small - room) // capacity))).max()))


class _Bins:
    """Open sequences by room left, each entry a run of consecutive sequences that hold equally much."""

    def __init__(self, capacity: int, used: int = 0):
        self.capacity, self.used, self.rooms, self.runs = capacity, used, [], {}

    def add(self, room: int, start: int, count: int) -> None:
        if room and count:
            if room not in self.runs:
                bisect.insort(self.rooms, room)
                self.runs[room] = []
            self.runs[room].append((start, count))

    def best(self, length: int) -> tuple[int, int, int] | None:
        k = bisect.bisect_left(self.rooms, length)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        start, count = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room]
            del self.rooms[k]
        return room, start, count


def best_fit(counts: dict[int, int], capacity: int, used: int = 0, ranks: dict[int, int] | None = None) -> tuple[int, list[Segment]]:
    """Best-fit decreasing over a histogram: sequences used in the end, and the segments."""
    bins, out = _Bins(capacity, used), []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], (ranks or {}).get(length, 0)
        while left:
            found = bins.best(length)
            if found is None:
                each = capacity // length
                found = capacity, bins.used, -(-left // each)
                bins.used += found[2]
            room, start, count = found
            each, offset = room // length, capacity - room
            full = min(count, left // each)
            if full:
                out.append((length, rank, full * each, start, each, offset))
                bins.add(room - each * length, start, full)
                rank, left = rank + full * each, left - full * each
            if left and full < count:
                part = left if left < each else 0
                if part:
                    out.append((length, rank, part, start + full, part, offset))
                    bins.add(room - part * length, start + full, 1)
                    rank, left, full = rank + part, 0, full + 1
            bins.add(room, start + full, count - full)
    return bins.used, out


def _sums(counts: dict[int, int], sizes: list[int], room: int) -> list[int]:
    """For each k, the sums up to ``room`` that sizes[k:] can make, as bits of an integer."""
    full, out = (1 << (room + 1)) - 1, [1]
    for s in reversed(sizes):
        bits, left, step = out[-1], min(counts[s], room // s), 1
        while left:
            take = min(step, left)
            bits |= bits << (take * s) & full
            left, step = left - take, step * 2
        out.append(bits)
    return out[::-1]


def by_waste(counts: dict[int, int], sizes: list[int], room: int) -> Iterator[tuple[int, ...]]:
    """All multisets of ``sizes`` (largest first) that fit into ``room``, those that waste least first."""
    sums = _sums(counts, sizes, room)

    def exactly(at: int, left: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not left:
            yield chosen
            return
        while at < len(sizes) and sums[at] >> left & 1:
            s = sizes[at]
            at += 1
            for n in range(min(counts[s], left // s), 0, -1):
                if sums[at] >> (left - n * s) & 1:
                    yield from exactly(at, left - n * s, (*chosen, *[s] * n))

    for total in range(room, -1, -1):
        if sums[0] >> total & 1:
            yield from exactly(0, total, ())


def fillings(counts: dict[int, int], room: int, most: int, examine: int) -> list[tuple[int, ...]]:
    """The first ``most`` undominated multisets of lengths that fit into ``room``, least waste first.

    A filling is dominated if one item outside could stand for some of its items, or none, and waste less room.
    """
    if room in counts:
        return [(room,)]
    sizes = sorted((s for s in counts if s <= room), reverse=True)

    def dominated(chosen: tuple[int, ...]) -> bool:
        slack, sums = room - sum(chosen), 1
        for s in chosen:
            sums |= sums << s
        return slack > 0 and any(chosen.count(s) < counts[s] and sums >> max(s - slack, 0) & (1 << min(s, slack)) - 1 for s in sizes)

    whole = list(itertools.islice(by_waste(counts, sizes, room), 1))
    kept = itertools.islice((c for c in itertools.islice(by_waste(counts, sizes, room), examine) if not dominated(c)), most)
    return list(kept) or whole


def _take(left: dict[int, int], ranks: dict[int, int], used: int, whole: tuple[int, ...]) -> tuple[dict, dict, int, list[Segment]]:
    """Sequences filled by ``whole`` as often as the histogram allows: what is left, its ranks, how many, the segments."""
    need: dict[int, int] = {}
    for s in whole:
        need[s] = need.get(s, 0) + 1
    times = min(left[s] // n for s, n in need.items())
    now, then, offset, steps = dict(left), dict(ranks), 0, []
    for s, n in need.items():
        steps.append((s, then.get(s, 0), n * times, used, n, offset))
        offset += s * n
        then[s] = then.get(s, 0) + n * times
        now[s] -= n * times
        if not now[s]:
            del now[s]
    return now, then, times, steps


def dive(counts: dict[int, int], capacity: int, examine: int) -> tuple[int, list[Segment]]:
    """Sequences and segments where the largest piece left always gets the filling that wastes least, to the last piece."""
    left, ranks, used, out = counts, {}, 0, []
    while left:
        top = max(left)
        rest = {s: c - (s == top) for s, c in left.items() if c > (s == top)}
        left, ranks, times, steps = _take(left, ranks, used, (top, *fillings(rest, capacity - top, 1, examine)[0]))
        used += times
        out += steps
    return used, out


def plan(counts: dict[int, int], capacity: int, nodes: int = 200, branch: int = 4, examine: int = 500) -> tuple[int, list[Segment]]:
    """Sequences used and segments for a histogram of lengths from 1 to ``capacity``.

    Best-fit decreasing is the first incumbent; if it meets the lower bound it is optimal. Otherwise a dive to the last
    piece by least waste is the second. Where it misses the bound, too, bin completion branches on the fillings around
    the largest piece, each repeated as often as the histogram allows, prunes a node whose waste so far leaves it no
    better than the incumbent, and completes every node by best fit for a new incumbent. ``nodes`` bounds the search,
    not the pieces: the incumbent always places every piece.
    """
    counts = {s: c for s, c in counts.items() if c}
    if not counts:
        return 0, []
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    if best[0] > bound:
        best = min(best, dive(counts, capacity, examine), key=lambda p: p[0])
    stack: list[tuple[dict, dict, int, list]] = [(counts, {}, 0, [])]
    while stack and nodes > 0 and best[0] > bound:
        left, ranks, used, done = stack.pop()
        nodes -= 1
        if not left or used + lower_bound(left, capacity) >= best[0]:
            continue
        top = max(left)
        rest = left | {top: left[top] - 1}
        children = []
        for chosen in fillings({s: c for s, c in rest.items() if c}, capacity - top, branch, examine):
            now, then, times, steps = _take(left, ranks, used, (top, *chosen))
            total, tail = best_fit(now, capacity, used + times, then)
            if total < best[0]:
                best = total, [*done, *steps, *tail]
            children.append((now, then, used + times, [*done, *steps]))
        stack.extend(reversed(children))
    return best


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: key, piece, start, length, ids_crc32 (and ids).

    Each text's ids are followed by ``end_id``; null counts as empty, so it gives one piece of one id. Longer
    documents are cut from the end into whole pieces; the first piece takes the remainder. Repeated rows and null
    keys are kept as rows of their own. Other columns are ignored; an empty table gives no pieces.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def split(batches):
        encode = encoder(path).encode
        for batch in batches:
            keys, size, i = batch.column(0), batch.num_rows, 0
            lengths = np.diff(batch.column(1).cast(pa.large_string()).offsets.to_numpy()) if hasattr(batch.column(1), "offsets") else np.array([len(x) for x in batch.column(1).to_pylist()])
            stops = np.cumsum(lengths)
            while i < size:
                j = max(i + 1, int(np.searchsorted(stops, (stops[i - 1] if i else 0) + (1 << 20), side="right")))
                at, piece, start, length, crc, whole = [], [], [], [], [], []
                for k, ids in enumerate(encode(batch.column(1).slice(i, j - i).to_pylist()), i):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    n = len(ids)
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                        own = ids[a:b]
                        at.append(k), piece.append(p), start.append(a), length.append(b - a), crc.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            whole.append(own.astype(np.int32))
                cols = [keys.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(whole, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
                i = j
                give_back()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(split, schema)


def pack(pieces: DataFrame, capacity: int = 2048, nodes: int = 200) -> DataFrame:
    """``pieces`` (with a column ``length`` from 1 to ``capacity``) with sequence_id and offset.

    Sequences are gapless from offset 0 and number from 0. The pieces are checkpointed first, as ranks rest on their
    order in partitions; an empty input gives an empty result.
    """
    fixed = cut(pieces).withColumn("_part", F.spark_partition_id())
    sums = cut(fixed.groupBy("_part", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    _, segments = plan(counts, capacity, nodes)
    before = sums.withColumn("_base", F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("_part", "length").orderBy(*[c for c in fixed.columns if c in ("doc_id", "piece")] or ["_part"]))
    ranked = fixed.withColumn("_rank", inside).join(before, ["_part", "length"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_base"))
    segments.sort()
    table = np.array(segments, np.int64).reshape(-1, 6)
    names = pieces.columns
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        code = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            own = table[np.searchsorted(code, (length.astype(np.int64) << 48) + rank, side="right") - 1]
            at = rank - own[:, 1]
            cols = [batch.column(c) for c in names] + [pa.array(own[:, 3] + at // own[:, 4]), pa.array(own[:, 5] + at % own[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(place, schema)
