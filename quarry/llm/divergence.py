"""Quality rules by distribution divergence: character classes and common words of a text against its language's.

A first pass measures every whole text. References are mean histograms of the texts of a language, taken over all of
them and then again over those that the first means don't reject. A text is rejected where the Jensen-Shannon distance
(base 2, so at most 1) of one of its histograms passes a bound and the text is long enough for the histogram to mean
something. Fixed rules on words, symbols and repetitions come first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import _ROLE, give_back, mix, ngram_hashes, slices, stored, string_buffers, word_hashes

# The most frequent function words of four languages, from common knowledge.
COMMON = {
    "en": "the of and to in a is that for it was on are as with be by at from this or an not which have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er war".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus pas avec ne se ce sont".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
SYMBOLS = b"#*$%&|<>"

#: Character classes: other letters and signs (by code point), a-z, A-Z, 0-9 (not compared: numbers and keys say nothing
#: about the language), space, line ends and tabs, .,;:'- , symbols, the rest.
CLASSES, DIGITS = 9, 3
_CLASS = np.full(256, 8, np.uint8)
_CLASS[0xC0:] = 0
_CLASS[0x80:0xC0] = CLASSES  # inside a code point
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[9:14] = 1, 2, 3, 4, 5
_CLASS[np.frombuffer(b".,;:'-", np.uint8)] = 6
_CLASS[np.frombuffer(SYMBOLS, np.uint8)] = 7
_RUN = 1 << 20


def _bins(words: dict[str, list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Sorted hashes of all common words, alone or before a comma or full stop, and the word's number in the sorted vocabulary."""
    vocabulary = sorted({w for own in words.values() for w in own})
    forms = [(k, w + end) for k, w in enumerate(vocabulary) for end in ("", ",", ".")]
    h, row = word_hashes(*string_buffers(pa.array([f for _, f in forms])))
    order = np.argsort(h)
    return h[order], np.array([forms[r][0] for r in row])[order], vocabulary


def repeated(h: np.ndarray, row: np.ndarray, rows: int, n: int = 3) -> np.ndarray:
    """Per row the number of words that lie in an n-word window which the row holds twice or more."""
    last = len(h) - n + 1
    if last < 1:
        return np.zeros(rows, np.int64)
    grams, of = ngram_hashes(h, row, n)
    with np.errstate(over="ignore"):
        key = mix(grams ^ (of.astype(np.uint64) * _ROLE[1]))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    start = np.flatnonzero(row[:last] == row[n - 1 :])[count[inverse] > 1]
    hit = np.zeros(len(h), bool)
    for k in range(n):
        hit[start + k] = True
    return np.bincount(row[hit], minlength=rows)


def measures(offsets: np.ndarray, data: np.ndarray, bins: tuple) -> dict[str, np.ndarray]:
    """Per text: words, their code points, symbols, repeated lines, words in repeated windows, and both histograms as counts."""
    hashes, number, vocabulary = bins
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "words")}
    for i, j in slices(offsets):
        at, part = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        classes = np.zeros((j - i, CLASSES + 1), np.int64)
        lines = np.zeros(j - i, np.int64)
        for k in range(j - i):
            for a in range(at[k], at[k + 1], _RUN):
                classes[k] += np.bincount(_CLASS[part[a : min(a + _RUN, at[k + 1])]], minlength=CLASSES + 1)
            if classes[k, 5]:
                own = [x for x in part[at[k] : at[k + 1]].tobytes().split(b"\n") if x and not x.isspace()]
                lines[k] = len(own) - len(set(own))
        h, row = word_hashes(at, part, fold=False)
        low, _ = word_hashes(at, part)
        place = np.minimum(np.searchsorted(hashes, low), len(hashes) - 1)
        known = hashes[place] == low
        common = np.bincount(row[known] * len(vocabulary) + number[place[known]], minlength=(j - i) * len(vocabulary))
        out["n_words"].append(np.bincount(row, minlength=j - i))
        out["word_chars"].append(classes[:, :CLASSES].sum(1) - classes[:, 4] - classes[:, 5])
        out["n_symbols"].append(classes[:, 7])
        out["n_dup_lines"].append(lines)
        out["n_repeat_words"].append(repeated(h, row, j - i))
        out["classes"].append(classes[:, :CLASSES])
        out["words"].append(common.reshape(j - i, len(vocabulary)))
    return {k: np.concatenate(v) for k, v in out.items()}


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms that sum to 1 each."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2, F.lit(0.0)))


def shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: c / total)


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", words: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, lang, the base counts, p: shares of character classes, w: shares of common words and of all others)."""
    bins = _bins(words or COMMON)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = docs.select(F.col(key).alias("doc_id"), (F.col(lang) if lang in docs.columns else F.lit(None)).cast("string").alias("lang"), F.col(text).alias("text"))

    def measure(batches):
        for b in batches:
            if len(b):
                got = measures(*string_buffers(b.column("text")), bins)
                lists = [pa.array(list(got[k].astype(np.int64)), pa.list_(pa.int64())) for k in ("classes", "words")]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *(pa.array(got[k].astype(np.int64)) for k in counts), *lists], names=schema.names)
            give_back()

    schema = rows.select("doc_id", "lang", *(F.lit(0).cast("long").alias(c) for c in counts), *(F.array().cast("array<long>").alias(c) for c in ("classes", "words"))).schema
    out = rows.mapInArrow(measure, schema)
    out = out.withColumn("classes", F.filter("classes", lambda c, i: i != DIGITS))
    length = F.aggregate("classes", F.lit(0).cast("long"), lambda s, c: s + c)
    known = F.aggregate("words", F.lit(0).cast("long"), lambda s, c: s + c)
    return out.select("doc_id", "lang", *counts, length.alias("n_chars"), shares(F.col("classes"), F.greatest(length, F.lit(1))).alias("p"), shares(F.concat("words", F.array(F.col("n_words") - known)), F.greatest(F.col("n_words"), F.lit(1))).alias("w"))


def references(texts: DataFrame, languages: list[str]) -> dict[str, tuple[list[float], list[float]]]:
    """Mean histograms of each language that has texts; one row a language comes to the driver."""
    first = texts.select(F.size("p").alias("p"), F.size("w").alias("w")).first()
    if first is None:
        return {}
    means = [F.avg(F.get(k, F.lit(i))) for k in ("p", "w") for i in range(first[k])]
    rows = texts.where(F.col("lang").isin(languages)).groupBy("lang").agg(*means).collect()
    return {r[0]: (list(r[1 : 1 + first["p"]]), list(r[1 + first["p"] :])) for r in rows}


def judged(texts: DataFrame, refs: dict, class_bound: float, word_bound: float, min_chars: int, min_words: int) -> DataFrame:
    """With class_distance and word_distance to the nearest language (null below the least length) and whether either is too large.

    The bounds are those of long texts; short ones are allowed what chance adds, by the root of their length.
    """
    def nearest(column: str, which: int) -> Column:
        found = [distance(F.col(column), F.array(*map(F.lit, r[which]))) for _, r in sorted(refs.items())]
        return F.least(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("double")

    out = texts.withColumns({"class_distance": F.when(F.col("n_chars") >= min_chars, nearest("p", 0)), "word_distance": F.when(F.col("n_words") >= min_words, nearest("w", 1))})
    far = (F.col("class_distance") > class_bound + 0.6 / F.sqrt("n_chars")) | (F.col("word_distance") > word_bound + 1.3 / F.sqrt("n_words"))
    return out.withColumn("far", F.coalesce(far, F.lit(False)))


def rules(docs: DataFrame, words: dict[str, list[str]] | None = None, class_bound: float = 0.13, word_bound: float = 0.25, min_chars: int = 200, min_words: int = 50) -> DataFrame:
    """One row per row of ``docs``: the base counts, base_failed, kept, class_distance and word_distance.

    base_failed: fewer than 50 words, or more than half of them in repeated windows of three. Other texts are kept unless a
    histogram is too far from every language's. References are the means over all texts of a known language that pass the
    base rules, each different measurement once, so copies don't pull them; the second means leave out what the first
    reject. Without such texts nothing but the base rules decides. Null texts are empty; texts of unknown or null language
    are judged but shape no reference; repeated rows are judged each; other columns are ignored. Empty in, empty out.
    """
    words = words or COMMON
    bounds = class_bound, word_bound, min_chars, min_words
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    texts = stored(measured(docs, words=words)).withColumn("base_failed", failed)
    sound = texts.where(~F.col("base_failed") & F.col("lang").isin(list(words))).dropDuplicates(["lang", "n_words", "word_chars", "p", "w"])
    sound = stored(sound.select("lang", "n_words", "n_chars", "p", "w"))
    refs = references(sound, list(words))
    refs = references(judged(sound, refs, *bounds).where("NOT far"), list(words)) or refs
    out = judged(texts, refs, *bounds)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("far")).alias("kept"), "class_distance", "word_distance")
