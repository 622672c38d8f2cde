"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Four exact generators find base spans, which always stay. Looser generators propose more spans, overlapping ones too:
runs of digits, what base spans leave of them, and parts of base runs that fail their check (every window of 13 to 19
digits, every phone number that a run starts with). Boosted trees over binned format and context features are fitted
on the driver from a histogram of all candidates and proposals of all documents (at most ``2 * _CODES`` rows) and come
back as CASE expressions. The trees see the counts of one half of the documents; a threshold for each kind, calibrated
for precision on the other half, selects what is added.

Spans are found by putting two private-use characters around each match and adding up lengths, so places are code
points. Patterns have no repeated groups and start only where a run starts: they take linear time and no recursion.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
_OPEN, _CLOSE, _JOINT = "", "", ""
_SPAN = "array<struct<start:int,end:int,text:string>>"
#: Bins of each feature; a feature's code is below its number.
BINS = {"kind": 4, "digits": 8, "seps": 3, "dots": 3, "before": 4, "after": 4, "luhn": 2, "plus": 2, "form": 4}
#: Forms of a card: a window that cuts a group of digits, one group, groups of four, other whole groups. Others are "one".
_CUT, _ONE, _FOURS, _MIXED = range(4)
_CODES = int(np.prod(list(BINS.values())))


def _spans(parts: Column) -> Column:
    """Spans of a text that was split at _OPEN, each match ended by _CLOSE; null parts have none."""
    zero = F.struct(F.length(F.element_at(parts, 1)).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc, part):
        size = F.instr(part, _CLOSE) - 1
        span = F.struct(acc["at"].alias("start"), (acc["at"] + size).cast("int").alias("end"), F.substring(part, F.lit(1), size).alias("text"))
        return F.struct((acc["at"] + F.length(part) - 1).cast("int").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(parts.isNull(), F.array().cast(_SPAN)).otherwise(F.aggregate(rest, zero, step, lambda acc: acc["out"]))


def _where(gate: Column, marked: Column) -> Column:
    return F.when(gate, F.split(marked, _OPEN))


def _mark(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}"))


def clean(text: Column) -> Column:
    """The text with the three characters that this module uses as marks replaced, length kept; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    odd = (F.instr(text, _OPEN) > 0) | (F.instr(text, _CLOSE) > 0) | (F.instr(text, _JOINT) > 0)
    return F.when(odd, F.translate(text, _OPEN + _CLOSE + _JOINT, "")).otherwise(text)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of 12 to 19 digits passes the mod-10 check; others don't."""
    doubled = lambda x, k: F.when(k % 2 == 1, x.cast("int") * 2 - F.when(x > "4", 9).otherwise(0)).otherwise(x.cast("int"))
    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), doubled), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)


def matches(text: Column) -> dict[str, Column]:
    """The text split at the matches of each base pattern, before validation."""
    joint = F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _JOINT)
    local = rf"A-Za-z0-9._%+\-{_JOINT}"
    email = rf"(?:\G|(?<![{local}]))[{local}]++@[A-Za-z0-9-]++{_JOINT}[A-Za-z0-9{_JOINT}-]++"
    runs = F.regexp_replace(text, r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9])", _OPEN)
    runs = F.regexp_replace(runs, r"(?<=[0-9])(?![0-9])(?![\x20-][0-9])", _CLOSE)
    return {
        "email": _where(F.instr(text, "@") > 0, _mark(joint, email)),
        "ip": _where(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _mark(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")),
        "card": _where(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), runs),
        "phone": _where(text.rlike(r"\+[0-9]"), _mark(text, r"\+[0-9][\x20().0-9-]+[0-9]")),
    }


def valid(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(text, r"\."), lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255")))
    digits = _digits(text)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def proposals(text: Column) -> dict[str, Column]:
    """The text split at the matches of looser generators: spelt-out addresses, and runs of digits with separators."""
    spelt = text.rlike(r"(?i)[(\[{<]\x20?at\x20?[)\]}>]")
    loose = _where(spelt, _mark(text, r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[{<]\x20?at\x20?[)\]}>]\x20?[A-Za-z0-9-]{1,63}+(?:\.|\x20?[(\[{<]\x20?dot\x20?[)\]}>]\x20?)[A-Za-z0-9.-]{1,63}"))
    numbers = _where(text.rlike(r"[0-9][0-9().\x20/-]{6}"), _mark(text, r"(?<![A-Za-z0-9+])[0-9(][0-9().\x20/-]{5,38}[0-9](?![A-Za-z0-9])"))
    return {"spelt": loose, "numbers": numbers}


def _digits_at(runs: Column) -> Column:
    """Spans with their characters and, for each digit, its place in the span."""
    chars = F.transform(runs, lambda s: F.struct(s["start"].alias("start"), F.split(s["text"], "").alias("chars")))
    at = lambda x: F.filter(F.transform(x["chars"], lambda c, i: F.when(c.rlike("^[0-9]$"), i)), lambda i: i.isNotNull())
    return F.transform(chars, lambda x: F.struct(x["start"].alias("start"), x["chars"].alias("chars"), at(x).alias("at")))


def _part(x: Column, first: Column, last: Column, whole: Column) -> Column:
    """The span from the digit numbered ``first`` to the one numbered ``last``, with the characters beside it."""
    a, b = F.get(x["at"], first), F.get(x["at"], last)
    return F.struct(
        (x["start"] + a).cast("int").alias("start"),
        (x["start"] + b + 1).cast("int").alias("end"),
        F.array_join(F.slice(x["chars"], a + 1, b - a + 1), "").alias("text"),
        whole.alias("whole"),
        F.get(x["chars"], a - 1).alias("before"),
        F.get(x["chars"], b + 1).alias("after"),
    )


def _ends_group(x: Column, k: Column) -> Column:
    return F.coalesce(F.get(x["at"], k + 1) != F.get(x["at"], k) + 1, F.lit(True))


def windows(failed: Column) -> Column:
    """All windows of 13 to 19 digits of card runs that fail."""

    def each(x, first):
        fits = F.filter(F.array(*(F.lit(n) for n in range(13, 20))), lambda n: first + n <= F.size(x["at"]))
        starts = (first == 0) | _ends_group(x, first - 1)
        return F.transform(fits, lambda n: _part(x, first, first + n - 1, starts & _ends_group(x, first + n - 1)))

    firsts = lambda x: F.when(F.size(x["at"]) >= 13, F.sequence(F.lit(0), F.size(x["at"]) - 13)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.flatten(F.transform(_digits_at(failed), lambda x: F.transform(firsts(x), lambda k: each(x, k)))))


def prefixes(failed: Column) -> Column:
    """What phone runs that fail start with: their first groups of digits, 8 to 15 digits together."""

    def each(x):
        ends = F.filter(F.array(*(F.lit(n) for n in range(8, 16))), lambda n: (n <= F.size(x["at"])) & _ends_group(x, n - 1))
        parts = F.transform(ends, lambda n: _part(x, F.lit(0), n - 1, F.lit(True)))
        # the plus sign stands before the first digit
        return F.transform(parts, lambda s: F.struct((s["start"] - 1).alias("start"), s["end"].alias("end"), F.concat(F.lit("+"), s["text"]).alias("text"), s["whole"].alias("whole"), F.lit(None).cast("string").alias("before"), s["after"].alias("after")))

    return F.flatten(F.transform(_digits_at(failed), each))


def pieces(numbers: Column, base: Column) -> Column:
    """What is left of spans that base spans overlap, from its first digit or bracket to its last digit."""

    def each(s):
        inner = F.array_sort(F.transform(F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
        zero = F.struct(s["start"].alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        step = lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), b["start"].alias("end")))).alias("out"))
        gaps = F.aggregate(inner, zero, step, lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), s["end"].alias("end")))))
        raw = F.transform(F.when(F.size(inner) > 0, F.filter(gaps, lambda g: g["start"] < g["end"])).otherwise(F.array().cast("array<struct<start:int,end:int>>")), lambda g: F.struct(g["end"].alias("end"), F.substring(s["text"], g["start"] - s["start"] + 1, g["end"] - g["start"]).alias("text")))
        head = F.transform(raw, lambda g: F.struct((g["end"] - F.length(F.regexp_replace(g["text"], "^[^0-9(]+", ""))).alias("start"), F.regexp_replace(F.regexp_replace(g["text"], "^[^0-9(]+", ""), "[^0-9]+$", "").alias("text")))
        return F.transform(head, lambda g: F.struct(g["start"].cast("int").alias("start"), (g["start"] + F.length(g["text"])).cast("int").alias("end"), g["text"].alias("text")))

    return F.flatten(F.transform(numbers, each))


def _shapes(numbers: Column) -> dict[int, Column]:
    """Runs of digits by the kind that their shape suggests."""
    shape = lambda s: F.length(_digits(s["text"]))
    dotted = lambda s: s["text"].rlike(r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$")
    return {1: F.filter(numbers, dotted), 2: F.filter(numbers, lambda s: ~dotted(s) & (shape(s) >= 13)), 3: F.filter(numbers, lambda s: ~dotted(s) & shape(s).between(7, 12))}


def _side(char: Column) -> Column:
    return F.when(F.coalesce(char, F.lit("")).rlike(r"^\s?$"), 0).when(char.rlike(r"\p{L}"), 1).when(char.rlike("[0-9]"), 2).otherwise(3)


def _form(s: Column, whole: Column) -> Column:
    fours = s["text"].rlike(r"^[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{1,4}([\x20-][0-9]{1,3})?$")
    return F.when(~whole, _CUT).when(s["text"].rlike("^[0-9]+$"), _ONE).when(fours, _FOURS).otherwise(_MIXED)


def _features(kind: int, text: Column, s: Column, part: bool = False, right: Column | None = None) -> Column:
    """``part``: ``s`` is part of a run, and has the characters beside it that are in the run. ``right`` replaces the validator's word."""
    digits = F.length(_digits(s["text"]))
    bins = F.when(digits == 0, 0).when(digits < 7, 1).when(digits < 8, 2).when(digits < 11, 3).when(digits < 13, 4).when(digits < 16, 5).when(digits < 20, 6).otherwise(7)
    dots = F.length(s["text"]) - F.length(F.replace(s["text"], F.lit("."), F.lit("")))
    seps = F.length(F.regexp_replace(s["text"], "[^\\x20()/-]", ""))
    before = F.when(s["start"] > 0, F.substring(text, s["start"], F.lit(1))).otherwise("")
    after = F.substring(text, s["end"] + 1, F.lit(1))
    if part:
        inside = lambda c: F.when(F.length(c) > 0, c)
        before, after = F.coalesce(inside(s["before"]), before), F.coalesce(inside(s["after"]), after)
    return F.struct(
        s["start"].alias("start"),
        s["end"].alias("end"),
        F.lit(kind).alias("kind"),
        bins.alias("digits"),
        F.least(seps, F.lit(2)).alias("seps"),
        F.when(dots == 0, 0).when(dots == 3, 2).otherwise(1).alias("dots"),
        _side(before).alias("before"),
        _side(after).alias("after"),
        luhn(_digits(s["text"])).cast("int").alias("luhn"),
        s["text"].startswith("+").cast("int").alias("plus"),
        (_form(s, s["whole"] if part else F.lit(True)) if kind == 2 else F.lit(_ONE)).alias("form"),
        F.coalesce(valid(KINDS[kind], s["text"]) if right is None else right, F.lit(False)).alias("valid"),
    )


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _text, _half, _base, _parts and _loose: arrays of spans with features.

    Base spans and parts that pass their check are valid; a loose span is if a base span of its kind covers just as much.
    """
    df = docs.withColumn("_text", clean(F.col(text)))
    df = df.withColumn("_half", F.pmod(F.xxhash64("_text"), F.lit(2)))
    t = F.col("_text")
    parts = {f"_{k}": c for k, c in (matches(t) | proposals(t)).items()}
    df = df.withColumns(parts)
    df = df.withColumns({k: _spans(F.col(k)) for k in parts})
    dots = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.translate(s["text"], _JOINT, ".").alias("text"))
    df = df.withColumn("_email", F.transform("_email", dots))
    of = lambda kind, spans: F.transform(spans, lambda s: _features(kind, t, s))
    base = F.concat(*(of(i, F.col(f"_{k}")) for i, k in enumerate(KINDS)))
    df = df.withColumn("_base", base)
    failing = lambda k: F.filter(f"_{KINDS[k]}", lambda s: (F.length(_digits(s["text"])) >= (13, 16)[k == 3]) & ~valid(KINDS[k], s["text"]))
    df = df.withColumn("_numbers", F.concat("_numbers", pieces(F.col("_numbers"), F.filter("_base", lambda s: s["valid"]))))
    seen = lambda i, s: F.exists("_base", lambda b: b["valid"] & (b["kind"] == i) & (b["start"] == s["start"]) & (b["end"] == s["end"]))
    proposed = {0: F.col("_spelt"), **_shapes(F.col("_numbers"))}
    checked = lambda kind: lambda s: _features(kind, t, s, right=seen(kind, s))
    loose = F.concat(*(F.transform(c, checked(i)) for i, c in proposed.items()))
    cuts = F.concat(F.transform(windows(failing(2)), lambda s: _features(2, t, s, True)), F.transform(prefixes(failing(3)), lambda s: _features(3, t, s, True)))
    return df.withColumns({"_loose": loose, "_parts": cuts}).drop(*parts)


class Forest:
    """Gradient boosted trees of depth 3 over binned features, with a threshold for each kind."""

    def __init__(self, trees: list, thresholds: dict[int, float]):
        self.trees, self.thresholds = trees, thresholds

    def logit(self, x: dict[str, np.ndarray]) -> np.ndarray:
        def walk(node):
            if not isinstance(node, tuple):
                return np.full(len(x["kind"]), node)
            return np.where(x[node[0]] <= node[1], walk(node[2]), walk(node[3]))

        return sum((walk(t) for t in self.trees), np.zeros(len(x["kind"])))

    def column(self, s: Column) -> Column:
        def walk(node):
            return F.lit(float(node)) if not isinstance(node, tuple) else F.when(s[node[0]] <= node[1], walk(node[2])).otherwise(walk(node[3]))

        total = F.lit(0.0)
        for tree in self.trees:
            total = total + walk(tree)
        return total

    def selects(self, s: Column) -> Column:
        limit = F.lit(float("inf"))
        for kind, value in self.thresholds.items():
            limit = F.when(s["kind"] == kind, float(value)).otherwise(limit)
        return self.column(s) >= limit


def boost(x: dict[str, np.ndarray], y: np.ndarray, weight: np.ndarray, held: np.ndarray | None = None, rounds: int = 20, depth: int = 3, rate: float = 0.4, precision: float = 0.95) -> Forest:
    """Second-order boosting of the logistic loss on weighted feature tuples, then one threshold for each kind.

    Thresholds are calibrated on the weights ``held``; a kind that these lack, and any kind without them, on ``weight``.
    """
    f = np.zeros(len(y))

    def grow(rows, g, h, deep):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if deep:
            for name, bins in BINS.items():
                v = x[name][rows]
                for c in range(bins - 1):
                    left = v <= c
                    if left.all() or not left.any():
                        continue
                    gl, hl = g[rows][left].sum(), h[rows][left].sum()
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    if gain > best[0]:
                        best = gain, (name, c, rows[left], rows[~left])
        if best[1] is None:
            return float(-rate * gs / (hs + 1))
        name, c, a, b = best[1]
        return name, c, grow(a, g, h, deep - 1), grow(b, g, h, deep - 1)

    trees = []
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-f))
        tree = grow(np.arange(len(y)), weight * (p - y), weight * p * (1 - p), depth)
        trees.append(tree)
        f += Forest([tree], {}).logit(x)
    thresholds = {}
    for kind in range(len(KINDS)):
        own = np.flatnonzero(x["kind"] == kind) if len(y) else []
        if not len(own):
            continue
        order = own[np.argsort(-f[own], kind="stable")]
        w = weight if held is None or not held[order].sum() else held
        good, total = np.cumsum(w[order] * y[order]), np.cumsum(w[order])
        last = np.append(f[order][1:] < f[order][:-1] - 1e-12, True)
        enough = np.flatnonzero((good >= precision * total) & (total > 0) & last)
        if len(enough):
            thresholds[kind] = max(float(f[order][enough[-1]]), 0.0) - 1e-9  # nothing that is rather wrong
    return Forest(trees, thresholds)


def labels(x: dict[str, np.ndarray], y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How likely each cell of the histogram is right: its validator's verdict, less what passes by chance.

    A card is taken at its check digit's word where it is one group or groups of four. Other windows overlap each
    other, and one in ten passes by chance: of those that pass, the share beyond a ninth of those that fail is right.
    """
    out = y.copy()
    odd = (x["kind"] == 2) & np.isin(x["form"], (_CUT, _MIXED))
    cells: dict[tuple, np.ndarray] = {}
    keys = list(zip(*(x[k] for k in BINS if k != "luhn")))
    for k in np.flatnonzero(odd):
        cells.setdefault(keys[k], np.zeros(2))[int(y[k])] += n[k]
    for k in np.flatnonzero(odd & (y > 0)):
        fail, good = cells[keys[k]]
        out[k] = max(0.0, 1 - (fail / 9 + 1) / good)
    return out


def train(found: DataFrame) -> Forest:
    """Fit on the histogram of all base candidates, parts of failed runs and loose proposals; ``labels`` tells what is right."""
    each = found.select("_half", F.explode(F.concat("_base", "_parts", "_loose")).alias("s")).select("_half", *(F.col(f"s.{n}") for n in BINS), F.col("s.valid").cast("int").alias("y"))
    rows = each.groupBy(*BINS, "y").agg(F.count("*").alias("n"), F.sum("_half").alias("held")).orderBy(*BINS, "y").collect()  # at most 2 * _CODES
    x = {k: np.array([r[k] for r in rows], np.int64) for k in BINS}
    n = np.array([r["n"] for r in rows], float)
    held = np.array([r["held"] for r in rows], float)
    return boost(x, labels(x, np.array([r["y"] for r in rows], float), n), n - held, held)


def select(found: DataFrame, forest: Forest) -> DataFrame:
    """Adds base and spans (kind, start, end; sorted) to rows that have _base, _parts and _loose; what is added may overlap."""
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("_base", lambda s: s["valid"]), plain))
    df = found.withColumn("base", base)
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.transform(F.filter(F.concat("_parts", "_loose"), lambda s: free(s) & forest.selects(s)), plain)
    return df.withColumn("spans", F.array_sort(F.array_distinct(F.concat("base", added))))


def joined(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, base and spans as arrays of (kind, start, end); kind indexes ``KINDS``, places are code points.

    Null text counts as empty and has no spans. Repeated rows and null keys give rows of their own; other columns are
    ignored. An empty table gives an empty result and a forest without trees.
    """
    found = cut(candidates(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "_half", "_base", "_parts", "_loose"))
    return select(found, train(found)).select("doc_id", "base", "spans")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every selected span of ``text`` replaced by its kind in brackets; null stays null.

    Overlapping spans are replaced together, by the kind of the first. Other columns are returned as they are, whatever
    their names. Repeated rows are rows of their own; an empty table stays empty.
    """
    seen = cut(candidates(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_own")), "_own").drop("_own", "_text"))  # read twice
    forest = train(seen)
    df = select(seen, forest).select("_row", "spans")
    own = F.col("_row")[text]
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.coalesce(own, F.lit(""))

    def step(acc, s):
        gap = F.substring(whole, acc["at"] + 1, s["start"] - acc["at"])
        more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.element_at(kinds, s["kind"] + 1)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    built = F.aggregate("_order", zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(whole, acc["at"] + 1, F.length(whole))))
    df = df.withColumn("_order", order)
    return df.select(*(F.when(F.size("_order") > 0, built).otherwise(own).alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns))
