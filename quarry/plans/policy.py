"""What a query text may do: its parsed plan is walked whole, and only what is listed here passes.

Plan nodes, functions and relations are each allowed by name; anything else is refused, so a new command or a function that
reaches outside the tables needs no rule of its own. Expressions, subqueries and common table expressions are walked too.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

NODES = set(
    """Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Union Intersect Except Distinct SubqueryAlias OneRowRelation Generate
    WithWindowDefinition Pivot Unpivot UnresolvedHaving UnresolvedWith UnresolvedSubqueryColumnAliases UnresolvedInlineTable UnresolvedRelation
    UnresolvedTableValuedFunction UnresolvedTVFAliases Sample UnionLoop ResolvedInlineTable LocalRelation AsOfJoin""".split()
)
TABLE_FUNCTIONS = {"explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "json_tuple", "stack", "range", "variant_explode", "variant_explode_outer"}
#: Functions of the engine that call code by name, read files beside the tables or tell about the machine.
REFUSED = set(
    """reflect java_method try_reflect from_protobuf to_protobuf from_avro to_avro schema_of_avro input_file_name input_file_block_start input_file_block_length
    current_user session_user user current_catalog current_database current_schema version raise_error assert_true""".split()
)
_SUBQUERIES = {"ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}
_known: dict[int, set[str]] = {}


def _each(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def parsed(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def walk(plan) -> Iterator[tuple[object, bool]]:
    """Every node of a parsed plan and whether it is a relation (rather than an expression), subqueries and named parts included."""
    stack = [(plan, True)]
    while stack:
        node, relation = stack.pop()
        yield node, relation
        stack += [(c, relation) for c in _each(node.children())]
        if relation:
            stack += [(e, False) for e in _each(node.expressions())]
            if _kind(node) == "UnresolvedWith":
                stack += [(t._2(), True) for t in _each(node.cteRelations())]
            if _kind(node) == "UnresolvedTableValuedFunction":
                stack += [(e, False) for e in _each(node.functionArgs())]
        elif _kind(node) in _SUBQUERIES:
            stack.append((node.plan(), True))


def _functions(spark: SparkSession) -> set[str]:
    """Names of the engine's own functions; asked for once a session."""
    at = id(spark._jsparkSession)
    if at not in _known:
        _known[at] = {r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()} - REFUSED
    return _known[at]


def read_only(spark: SparkSession, sql: str, searches: frozenset[str] = frozenset(), functions: frozenset[str] = frozenset()) -> None:
    """Raise PermissionError unless the text is one query over registered views that calls nothing but listed functions.

    ``searches`` are table functions, ``functions`` scalar ones that the caller registered and vouches for.
    """
    plan = parsed(spark, sql)
    named = {t._1().lower() for n, relation in walk(plan) if relation and _kind(n) == "UnresolvedWith" for t in _each(n.cteRelations())}
    views = None
    for node, relation in walk(plan):
        kind = _kind(node)
        if relation and kind not in NODES:
            raise PermissionError(f"{kind} is not allowed in a query")
        if kind == "UnresolvedRelation":
            parts = [p for p in _each(node.multipartIdentifier())]
            if views is None:
                views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
            if len(parts) != 1 or parts[0].lower() not in named | views:
                raise PermissionError(f"{'.'.join(parts)} is no table of this corpus")
        elif kind == "UnresolvedTableValuedFunction":
            name = ".".join(_each(node.name())).lower()
            if name not in TABLE_FUNCTIONS | searches:
                raise PermissionError(f"{name}() is not allowed as a table")
        elif kind == "UnresolvedFunction":
            name = ".".join(_each(node.nameParts())).lower()
            if name in searches:
                raise PermissionError(f"{name}() is a table: write FROM {name}('...') or JOIN {name}('...'), not a value")
            if name not in _functions(spark) | functions:
                raise PermissionError(f"{name}() is not allowed in a query")
        elif not relation and ("WithUnresolvedIdentifier" in kind or "Reflect" in kind or "Invoke" in kind):
            raise PermissionError(f"{kind} is not allowed in a query")


def literal(expression, args: dict) -> str | None:
    """The text of a call's argument: a literal, or a parameter of ``args``."""
    kind = _kind(expression)
    if kind == "Literal":
        value = expression.value()
        return None if value is None else str(value if isinstance(value, (int, float, str)) else value.toString())
    if kind == "NamedParameter" and expression.name() in args:
        value = args[expression.name()]
        return None if value is None else str(value)
    raise ValueError("a search takes literal texts or parameters, which must be known before the query runs")


def calls(plan, names: frozenset[str], args: dict) -> list[tuple[str, list[str | None], dict[str, str | None]]]:
    """The table functions of ``names`` that a parsed plan calls: name, positional and named arguments."""
    out = []
    for node, relation in walk(plan):
        if relation and _kind(node) == "UnresolvedTableValuedFunction":
            name = ".".join(_each(node.name())).lower()
            if name in names:
                given = _each(node.functionArgs())
                by_name = {a.key(): literal(a.value(), args) for a in given if _kind(a) == "NamedArgumentExpression"}
                out.append((name, [literal(a, args) for a in given if _kind(a) != "NamedArgumentExpression"], by_name))
    return out
