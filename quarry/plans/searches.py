"""Searches inside SQL: vec_ops('...') and keyword('...') as tables that a query joins like any other.

The calls are found in the parsed plan. Each becomes a DataFrame plan; a temporary table function of the call's name selects
among them by the arguments, so Spark runs the text as it was written, strings and comments untouched, and optimises search
and query as one plan: other calls' branches fall away as their constants don't match.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import lexical, semantic
from quarry.plans import policy, programs

NAMES = frozenset({"vec_ops", "keyword"})
_defining = threading.Lock()


@dataclass
class Searches:
    """What can be searched. ``embed`` turns a text into a vector of the stored space; without it queries name stored ids.

    ``tokens`` are further modifiers: called with the candidates (id, score) and the value after the colon, each returns
    rows (id, _column, ...) that join the result.
    """

    spark: SparkSession
    vectors: DataFrame | None = None
    docs: DataFrame | None = None
    vector_key: str = "vec_id"
    column: str = "embedding"
    ts: str | None = None
    as_of: str | None = None
    doc_key: str = "doc_id"
    text: str = "text"
    index: lexical.Index | None = None
    embed: Callable[[str], np.ndarray] | None = None
    tokens: dict[str, Callable[[DataFrame, str], DataFrame]] = field(default_factory=dict)

    def scope(self, sql: str | None) -> DataFrame | None:
        """The keys that a pre-filter selects; it is a query of one column under the read-only policy, without searches."""
        if not sql:
            return None
        policy.read_only(self.spark, sql)
        keys = self.spark.sql(sql)
        if len(keys.columns) != 1:
            raise ValueError(f"a pre-filter selects one column of keys, not {len(keys.columns)}")
        return keys.distinct()

    def _target(self, word: str):
        """A stored id, or the vector of a text."""
        if word.lstrip("-").isdigit():
            return int(word)
        if self.embed is None:
            raise ValueError(f"{word!r} is no stored id, and no embedder is set")
        return np.asarray(self.embed(word), float)

    def vec_ops(self, text: str, scope: str | None = None) -> DataFrame:
        """(id, score, _z and what tokens add) of the best rows; ``pool:`` bounds them, 500 if it isn't given."""
        if self.vectors is None:
            raise ValueError("this corpus has no vectors")
        if wrong := programs.complaints(text, self.tokens):
            raise ValueError("; ".join(wrong))
        asked = programs.modifiers(text)
        if not asked["centroid"] and asked["similar"] is None:
            raise ValueError("say what to search for: similar:text or centroid:id,id")
        pool = asked["pool"] or 500
        m = semantic.Modulation(
            centroid=[int(i) for i in asked["centroid"]] or [self._target(asked["similar"])],
            blend=self._target(asked["similar"]) if asked["centroid"] and asked["similar"] is not None else None,
            suppress=[self._target(w) for w in asked["suppress"]],
            toward=(self._target(asked["from"]), self._target(asked["to"])) if asked["from"] and asked["to"] else None,
            half_life=None if asked["decay"] is None else 30.0 if asked["decay"] == "default" else float(asked["decay"]),
            as_of=self.as_of, diverse=asked["diverse"], pool=pool, limit=pool,
        )
        found = semantic.vec_ops(self.vectors, m, self.scope(scope), self.vector_key, self.column, self.ts)
        out = found.select(F.col(self.vector_key).alias("id"), "score", F.col("z").alias("_z"))
        candidates = out.select("id", "score")
        for word in asked["extra"]:
            name, mark, value = word.partition(":")
            if not mark or name not in self.tokens:
                raise ValueError(f"unknown modifier {word!r}")
            more = self.tokens[name](candidates, value)
            if bad := [c for c in more.columns if c != "id" and not c.startswith("_") or c in out.columns and c != "id"]:
                raise ValueError(f"{name} returns {', '.join(bad)}: columns of tokens start with _ and are new")
            out = out.join(more, "id", "left")
        return out

    def keyword(self, text: str, scope: str | None = None) -> DataFrame:
        """(id, rank in [0, 1], _bm25, _matched, _dropped) of the best 200 rows; from the written index, if there is one."""
        keys = self.scope(scope)
        if self.index is not None:
            found = lexical.ranked(self.index, text, keys, self.doc_key)
        elif self.docs is not None:
            found = lexical.keyword(self.docs, text, keys, self.doc_key, self.text)
        else:
            raise ValueError("this corpus has no texts")
        return found.select(F.col(self.doc_key).alias("id"), "rank", F.col("bm25").alias("_bm25"), F.col("matched_tokens").alias("_matched"), F.col("dropped_tokens").alias("_dropped"))

    def sql(self, text: str, args: dict | None = None) -> DataFrame:
        """Run one query, under the read-only policy, that may use searches as tables. Named parameters come from ``args``."""
        args = args or {}
        if programs.bare_text(text):
            quoted = " ".join(text.split()).replace("'", "''")
            raise ValueError(f"these are plain words, not SQL; to search for them: SELECT * FROM keyword('{quoted}')")
        policy.read_only(self.spark, text, NAMES)
        asked: dict[str, dict[tuple[str, str], DataFrame]] = {}
        for name, values, named in policy.calls(policy.parsed(self.spark, text), NAMES, args):
            if len(values) > 2 or set(named) - {"query", "scope"}:
                raise ValueError(f"{name}(query, scope) takes two texts")
            given = dict(zip(("query", "scope"), values)) | named
            if not given.get("query"):
                raise ValueError(f"{name}() needs a text to search for")
            key = given["query"], given.get("scope") or ""
            own = asked.setdefault(name, {})
            if key not in own:
                own[key] = getattr(self, name)(*key)
        used = {k: v for k, v in args.items() if any(policy._kind(n) == "NamedParameter" and n.name() == k for n, _ in policy.walk(policy.parsed(self.spark, text)))}
        with _defining:
            views = []
            try:
                for name, own in asked.items():
                    marked = [df.withColumns({"_query": F.lit(q), "_scope": F.lit(s)}) for (q, s), df in own.items()]
                    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
                    views.append((name, f"_{name}_{uuid.uuid4().hex}"))
                    rows.createOrReplaceTempView(views[-1][1])
                    kept = [f for f in rows.schema if f.name not in ("_query", "_scope")]
                    returns, columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), ", ".join(f"`{f.name}`" for f in kept)
                    self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(query STRING, scope STRING DEFAULT '') RETURNS TABLE ({returns}) RETURN SELECT {columns} FROM {views[-1][1]} WHERE _query = query AND _scope = coalesce(scope, '')")
                return self.spark.sql(text, args=used)
            finally:
                for name, view in views:
                    self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
                    self.spark.catalog.dropTempView(view)
