"""Stupid-backoff scores from n-gram count tables partitioned by hash.

Documents are dealt into groups of bounded bytes. A group sends its distinct n-grams with counts to the partitions of
the count tables; a partition sums them over the corpus and answers; the groups join the answers to their exploded
n-grams and sum per document. Longer n-grams are sent only if both (n-1)-grams in them occur outside the group, too:
what is left out occurs in no other group, so its count in the group is its count in the corpus. Text is shuffled once
(later readings reuse it). Hashes have 64 bits at every size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import give_back, ngram_hashes, partitions, string_buffers, text_bytes, word_hashes
from quarry.llm.counting import SENT, Sender, Shape, answer, cuts, whole_counts

_U = np.uint64
#: Orders that are sent at once, before anything is known.
FIRST = 2


class _Group:
    """The n-grams of one group of texts, order by order, and what the corpus holds of them."""

    def __init__(self, column, shape: Shape):
        self.offsets, data = string_buffers(column)
        self.words, self.word_rows = word_hashes(self.offsets, data)
        self.shape = shape
        self.wanted: np.ndarray | None = None

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return ngram_hashes(self.words, self.word_rows, n)

    def send(self, n: int, sender: Sender) -> None:
        h, _ = self.grams(n)
        sender.add(n, *np.unique(h if self.wanted is None else h[self.wanted], return_counts=True))

    def totals(self, n: int, answers: pa.Table) -> np.ndarray:
        """The corpus counts of all n-grams of order ``n``; then ``wanted`` says which of the next order may be elsewhere."""
        h, row = self.grams(n)
        tokens, at, own = np.unique(h, return_inverse=True, return_counts=True)
        if self.wanted is None:
            sent = tokens
        else:
            sent = np.unique(h[self.wanted])
        got = whole_counts(answers, n, [x for x in np.diff(cuts(sent, self.shape.wide)).tolist() if x])
        total = own.astype(np.int64)
        total[slice(None) if self.wanted is None else np.searchsorted(tokens, sent)] = got
        elsewhere = (total > own)[at]
        self.wanted = (elsewhere[:-1] & elsewhere[1:])[row[:-1] == row[1:]] if n >= FIRST else None
        return total[at]


def _others(h: np.ndarray, row: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How often each n-gram occurs in other rows of the corpus."""
    out = np.zeros(len(h), np.int64)
    more = np.flatnonzero(total > 1)  # the others occur here alone
    with np.errstate(over="ignore"):
        _, at, n = np.unique((h[more] + _U(1)) * _U(0x9E3779B97F4A7C15) ^ row[more].astype(_U) * _U(0xD6E8FEB86659FD93), return_inverse=True, return_counts=True)
    out[more] = total[more] - n[at]
    return out


def backoff(grams: list[tuple[np.ndarray, np.ndarray]], totals: list[np.ndarray], rows: int, alpha: float, corpus: int, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed log scores of each row; ``totals`` are the corpus counts of the n-grams."""
    order = len(grams)
    words = np.bincount(grams[0][1], minlength=rows)
    first = np.cumsum(words) - words
    place = np.arange(len(grams[0][1])) - first[grams[0][1]]  # of each word in its row
    counts = [_others(h, r, t) if leave_out else t for (h, r), t in zip(grams, totals)]
    size = np.maximum(corpus - (words if leave_out else 0), 1)[grams[0][1]]
    score = np.log(np.maximum(counts[0], 1) / size)
    for n in range(2, order + 1):
        at = np.flatnonzero(place >= n - 1)  # words that end an n-gram, in the order of the n-grams
        before = at - 1 if n == 2 else np.searchsorted(ends, at - 1)  # the context: the (n-1)-gram that ends a word before
        context = counts[n - 2][before]
        hit = counts[n - 1] > 0
        now = math.log(alpha) + score[at]
        now[hit] = np.log(counts[n - 1][hit] / context[hit])
        score[at] = now
        ends = at
    return words, np.bincount(grams[0][1], score, minlength=rows)


def lm_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, leave_out: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_words, log_score (sum over words), mean_score.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A word scores count(n-gram) / count(context) of the
    longest n-gram up to ``order`` that the corpus holds, times ``alpha`` for each order backed off; an unseen word
    counts as seen once. With ``leave_out`` a document's own occurrences are taken from all counts. Null and empty
    texts have no words and score 0 (mean null). Repeated rows count as documents of their own. Empty in, empty out.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shape = Shape.of(text_bytes(rows), partitions(docs.sparkSession))
    parted = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shape.groups)).cast("int")).repartition(shape.tasks, "g")

    def known(own: _Group, answers: pa.Table, upto: int) -> list[np.ndarray]:
        return [own.totals(n, answers) for n in range(1, upto + 1)]

    def begin(key, table):
        own, sender = _Group(table.column("text"), shape), Sender(shape, key[0].as_py())
        for n in range(1, min(FIRST, order) + 1):
            own.send(n, sender)
        give_back()
        return sender.table()

    def further(n):
        def send(key, left, right):
            own, sender = _Group(left.column("text"), shape), Sender(shape, key[0].as_py())
            known(own, right, n - 1)
            own.send(n, sender)
            give_back()
            return sender.table()

        return send

    def judge(left, right):
        own = _Group(left.column("text"), shape)
        totals = known(own, right, order)
        words, score = backoff([own.grams(n) for n in range(1, order + 1)], totals, len(own.offsets) - 1, alpha, corpus, leave_out)
        give_back()
        return pa.table({"doc_id": left.column("doc_id").cast(pa.int64()), "n_words": pa.array(words, pa.int64()), "log_score": pa.array(score, pa.float64())})

    corpus = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    answers = answer(parted.groupBy("g").applyInArrow(lambda key, table: begin(key, table), SENT), shape).select("g", "n", "b", "counts")
    for n in range(FIRST + 1, order + 1):
        back = answers.repartition(shape.tasks, "g").groupBy("g")
        answers = answers.unionByName(answer(parted.groupBy("g").cogroup(back).applyInArrow(further(n), SENT), shape))
    out = parted.groupBy("g").cogroup(answers.repartition(shape.tasks, "g").groupBy("g")).applyInArrow(judge, "doc_id long, n_words long, log_score double")
    return out.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
