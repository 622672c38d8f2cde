"""Mixing to target weights by soft membership, in DataFrame expressions only.

A softmax classifier learnt from a labelled table gives each document a posterior over domains, to a fixed resolution.
Document rates r >= 0 minimise the weighted squares of (expected domain tokens - target) by accelerated projected
gradient: one aggregate a step makes the residual of all documents, and a document's rate is a fold over the few
residuals so far, so rates are never stored, joined or collected. Documents of equal posteriors have equal rates, so
the steps run on the tokens summed by posterior.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut

_SYMBOLS = "[#$%&*|!<>{}=~^]"
_NUMERIC = 4
#: Posteriors are whole parts of about this number.
RESOLUTION = 256


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """docs with _words (runs of letters and digits of the whole text, lower-cased) and _tokens, their number."""
    df = docs.withColumn("_words", F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"))
    empty = F.when(F.element_at("_words", 1) == "", 1).otherwise(0) + F.when((F.size("_words") > 1) & (F.element_at("_words", -1) == ""), 1).otherwise(0)
    return df.withColumn("_tokens", (F.size("_words") - empty).cast("long"))


def _numeric(text: Column) -> list[Column]:
    """A few shares of the whole text, each from 0 to about 1."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    return [
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) / size * 2,
        (F.length(text) - F.length(F.regexp_replace(text, _SYMBOLS, ""))) / size * 5,
        F.least(size / F.greatest(F.col("_tokens"), F.lit(1)), F.lit(20.0)) / 10,
        F.log1p(size) / 10,
    ]


@dataclass
class Domains:
    """Softmax over numeric shares and the presence of at most ``len(words)`` words."""

    names: list[str]
    words: list[str]
    weights: np.ndarray  # (words + numeric + 1) x domains


def fit_softmax(x: np.ndarray, y: np.ndarray, domains: int, steps: int = 1500, penalty: float = 1e-4) -> np.ndarray:
    """Multinomial logistic regression by accelerated gradient; the last input is the constant."""
    w = momentum = np.zeros((x.shape[1], domains))
    if not len(x):
        return w
    rate = 4.0 / max(np.linalg.norm(x, 2) ** 2 / len(x), 1e-9)
    onehot = np.eye(domains)[y]
    for k in range(steps):
        z = x @ momentum
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = momentum - rate / 2 * (x.T @ (p - onehot) / len(x) + penalty * momentum)
        momentum = new + k / (k + 3) * (new - w)
        w = new
    return w


def learn(docs: DataFrame, labels: DataFrame, domain: str, key: str = "doc_id", text: str = "text", words: int = 32, most: int = 20_000) -> Domains:
    """Fit the posterior from ``labels`` (key, ``domain``) on at most ``most`` rows, those whose keys hash lowest.

    The words are those whose presence differs most between a domain and the rest, in standard errors. Null keys,
    domains and texts of no label are left out; a key labelled more than once counts with its smallest label, one of
    several texts with the smallest. Without labels there is one domain named 'all'.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(domain).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.col(domain).cast("string")).alias("_domain"))
    sample = known.orderBy(F.xxhash64("_key"), "_key").limit(most)
    own = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(sample), "_key")
    own = own.groupBy("_key", "_domain").agg(F.min("_text").alias("_text"))  # a key has one row, however often it is repeated
    own = cut(_measured(own, "_text").select("_domain", "_tokens", "_words", *(c.cast("double").alias(f"_n{k}") for k, c in enumerate(_numeric(F.col("_text")))), F.array_distinct("_words").alias("_bare")))
    sizes = {r["_domain"]: r["n"] for r in own.groupBy("_domain").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes) or ["all"]
    total = sum(sizes.values())
    seen = own.select("_domain", F.explode("_bare").alias("w")).where("w != ''").groupBy("w").pivot("_domain", names).count().fillna(0) if total else None
    chosen: list[str] = []
    if total:
        all_ = sum((F.col(f"`{n}`") for n in names), F.lit(0))
        inside, outside = [F.col(f"`{n}`") / sizes[n] for n in names], [(all_ - F.col(f"`{n}`")) / max(total - sizes[n], 1) for n in names]
        spread = all_ / total * (1 - all_ / total) + 1e-9
        gaps = [F.abs(a - b) / F.sqrt(spread * (1 / sizes[n] + 1 / max(total - sizes[n], 1))) for a, b, n in zip(inside, outside, names)]
        ranked = seen.where(all_ >= 5).withColumn("gap", F.greatest(*gaps, F.lit(0.0))).orderBy(F.desc("gap"), "w").limit(words)
        chosen = sorted(r["w"] for r in ranked.select("w").collect())
    inputs = [F.array_contains("_bare", w).cast("double") for w in chosen] + [F.col(f"_n{k}") for k in range(_NUMERIC)]
    rows = own.select("_domain", F.array(*inputs).alias("x")).collect() if total else []
    order = {n: k for k, n in enumerate(names)}
    pairs = sorted((order[r["_domain"]], r["x"]) for r in rows)
    x = np.array([[*p[1], 1.0] for p in pairs]).reshape(len(pairs), len(inputs) + 1)
    return Domains(names, chosen, fit_softmax(x, np.array([p[0] for p in pairs], int), len(names)))


def posteriors(docs: DataFrame, model: Domains, text: str = "text") -> DataFrame:
    """docs with _tokens and _p, the posterior over ``model.names`` (sums to 1)."""
    d, k = len(model.names), len(model.words)
    df = _measured(docs, text)
    own = [F.col(c) for c in docs.columns]
    plain = F.coalesce(F.col(text), F.lit(""))
    weight = model.weights
    table = F.create_map(*(x for i, w in enumerate(model.words) for x in (F.lit(w), F.array(*(F.lit(float(v)) for v in weight[i]))))) if k else None
    df = df.select(*own, "_tokens", "_words", F.array(*(c.cast("double") for c in _numeric(plain))).alias("_n"))
    if k:
        known = F.array(*(F.lit(w) for w in model.words))
        df = df.withColumn("_hits", F.array_intersect("_words", known))
    df = df.drop("_words")

    def logit(j):
        total = F.lit(float(weight[-1][j]))
        for i in range(_NUMERIC):
            total = total + F.element_at("_n", i + 1) * float(weight[k + i][j])
        if k:
            total = total + F.aggregate("_hits", F.lit(0.0), lambda a, w: a + F.element_at(F.element_at(table, w), j + 1))
        return total

    df = df.withColumn("_z", F.array(*(logit(j) for j in range(d))))
    df = df.withColumn("_e", F.transform("_z", lambda z: F.exp(z - F.array_max("_z"))))
    share = F.transform("_e", lambda e: e / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b))
    df = df.withColumn("_k", F.transform(share, lambda p: F.floor(p * max(RESOLUTION, 4 * d) + 0.5).cast("double")))
    df = df.withColumn("_p", F.transform("_k", lambda k: k / F.aggregate("_k", F.lit(0.0), lambda a, b: a + b)))
    return df.select(*own, "_tokens", "_p")


def _walk(steps: list[np.ndarray], floor: str) -> Column:
    """The rate r after the projected steps, and y, from which the next step starts.

    A step holds the change of each domain and, last, its momentum: r' = max(floor, y - p . step), y' = r' + m (r' - r).
    """
    start = "named_struct('r', 1D, 'y', 1D)"
    if not steps:
        return F.expr(start)
    moves = ", ".join("array(" + ", ".join(f"{float(v)!r}D" for v in s) + ")" for s in steps)
    d = len(steps[0]) - 1
    new = f"greatest({floor}, a.y - (" + " + ".join(f"_p[{j}] * s[{j}]" for j in range(d)) + "))"
    return F.expr(f"aggregate(array({moves}), {start}, (a, s) -> named_struct('r', {new}, 'y', {new} + s[{d}] * ({new} - a.r)))")


@dataclass
class Mix:
    """What the fit found: the steps, the least rate, and expected against wanted tokens of each domain."""

    steps: list[np.ndarray]
    floor: str
    tokens: np.ndarray
    target: np.ndarray
    expected: np.ndarray

    @property
    def residual(self) -> float:
        """The largest miss of a domain, as a share of all wanted tokens; above the tolerance if the steps ran out or targets are out of reach."""
        return float(np.abs(self.expected - self.target).max() / max(self.target.sum(), 1e-9)) if len(self.target) else 0.0

    def rate(self) -> Column:
        return _walk(self.steps, self.floor)["r"]


def solve(rows: DataFrame, weights: np.ndarray, total: float | None = None, hold: int | None = None, margin: float = 1.0, keep: float | None = None, fill: bool = True, most: int = 60, tolerance: float = 1e-4) -> Mix:
    """Fit rates for ``rows`` (_tokens, _p) to ``weights`` (non-negative, sum 1) of ``total`` tokens.

    ``total`` defaults to all tokens; ``hold`` instead sets it so that this domain keeps ``margin`` times its tokens.
    With ``keep``, rows whose posterior of the held domain is at least that have rates of 1 or more; then targets may
    be out of reach, and the fit comes as near as it can. Without ``fill`` the targets of other domains than the held
    one are limits: a domain that has fewer tokens is not repeated to reach its share. Domains are scaled by their own second moments; momentum is
    dropped where the squares grow.
    """
    d = len(weights)
    groups = cut(rows.groupBy("_p").agg(F.sum("_tokens").alias("_tokens")).coalesce(8))
    p = [F.element_at("_p", j + 1) for j in range(d)]
    sums = groups.agg(*(F.sum(F.col("_tokens") * p[i]).alias(f"a{i}") for i in range(d)), *(F.sum(F.col("_tokens") * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d))).first()
    tokens = np.array([sums[f"a{i}"] or 0.0 for i in range(d)])
    gram = np.array([[sums[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
    if total is None:
        total = tokens.sum() if hold is None or not weights[hold] else margin * tokens[hold] / weights[hold]
    target = weights * total
    if not fill:
        target = np.where(np.arange(d) == hold, target, np.minimum(target, tokens))
    floor = "0D" if hold is None or keep is None else f"if(_p[{hold}] >= {float(keep)!r}D, 1D, 0D)"
    if not tokens.sum():
        return Mix([], floor, tokens, target, tokens)
    scale = np.maximum(np.diag(gram), 1e-9 * tokens.sum())
    top = np.linalg.eigvalsh(gram / np.sqrt(np.outer(scale, scale)))[-1]
    steps, expected, ahead, speed, before = [], tokens, tokens, 1.0, np.inf
    for _ in range(most):
        if np.abs(expected - target).max() <= tolerance * total:
            break
        error = ((expected - target) ** 2 / scale).sum()
        if error > before:
            speed = 1.0
        before, faster = error, (1 + np.sqrt(1 + 4 * speed**2)) / 2
        steps.append(np.append((ahead - target) / scale / top, (speed - 1) / faster))
        speed = faster
        walked = groups.select("_tokens", "_p", _walk(steps, floor).alias("w"))
        got = walked.agg(*(F.sum(F.col("_tokens") * F.col(f"w.{x}") * p[i]).alias(f"{x}{i}") for x in "ry" for i in range(d))).first()
        expected, ahead = (np.array([got[f"{x}{i}"] or 0.0 for i in range(d)]) for x in "ry")
    return Mix(steps, floor, tokens, target, expected)


def _copies(rate: Column, *identity: Column) -> Column:
    """Whole copies: the floor of the rate, and one more with the probability of what is left, by hash."""
    draw = F.pmod(F.xxhash64(*identity, F.lit("copies")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def quality_domains(labels: DataFrame) -> DataFrame:
    """The labels table with a column domain: 'toxic', 'poor' or 'good'."""
    return labels.withColumn("domain", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good"))


#: Production targets: shares of tokens by domain.
TARGETS = {"good": 0.98, "poor": 0.015, "toxic": 0.005}


def _weights(model: Domains, targets: dict[str, float]) -> np.ndarray:
    w = np.array([max(0.0, targets.get(n, 0.0)) for n in model.names])
    return w / w.sum() if w.sum() else np.full(len(w), 1 / len(w))


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str = "domain", key: str = "doc_id", text: str = "text", hold: str | None = None, margin: float = 1.0) -> DataFrame:
    """Per row: key, tokens, domain_p (posterior by domain name), rate, copies.

    Tokens are runs of letters and digits; null and empty texts have none and still get a posterior.
    Repeated rows and null keys are rows of their own; other columns are ignored; an empty table stays empty. Targets
    of domains that no label names are left out and the rest scaled to 1.
    """
    model = learn(docs, labels, domain, key, text)
    rows = cut(posteriors(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text")), model, "_text").select("doc_id", "_tokens", "_p"))
    weights = _weights(model, targets)
    mix = solve(rows, weights, hold=model.names.index(hold) if hold in model.names else None, margin=margin)
    rate = mix.rate()
    named = F.map_from_arrays(F.array(*(F.lit(n) for n in model.names)), F.col("_p"))
    out = rows.select("doc_id", F.col("_tokens").alias("tokens"), named.alias("domain_p"), rate.alias("rate"))
    return out.withColumn("copies", _copies(F.col("rate"), F.coalesce(F.col("doc_id"), F.lit(-1))))


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str = "domain", key: str = "doc_id", text: str = "text", hold: str | None = None, margin: float = 1.0, keep: float | None = None, fill: bool = True) -> DataFrame:
    """``docs`` with each row repeated by its copies (none: the row goes). Columns stay as they are.

    Rows whose posterior of ``hold`` is at least ``keep`` all stay; for ``fill`` see ``solve``. Null and empty texts
    have no tokens; repeated rows count each; extra columns may have any names; an empty table stays empty.
    """
    model = learn(docs, labels, domain, key, text)
    names = docs.columns
    plain = docs.select(F.struct(*names).alias("_row"), F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    scored = cut(posteriors(plain, model, "_text").select("_row", "_id", "_tokens", "_p"))  # read by the fit and after it
    mix = solve(scored.select("_tokens", "_p"), _weights(model, targets), hold=model.names.index(hold) if hold in model.names else None, margin=margin, keep=keep, fill=fill)
    copies = _copies(mix.rate(), F.coalesce(F.col("_id"), F.lit(-1)))
    df = scored.select("_row", copies.alias("_copies")).where("_copies > 0")
    return df.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_n")).select("_row.*")
