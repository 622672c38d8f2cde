"""Named query programs: annotated SQL texts with parameters, run under a read-only policy; modifiers; attached corpora."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.ordered import running_total
from quarry.plans.policy import parsed, read_only, walk

_NOTE = re.compile(r"--\s*@(\w+):\s*(.+)")
_DEFAULT = re.compile(r"(\w+)\s*\(default:\s*(.+?)\)")


@dataclass
class Program:
    name: str
    description: str = ""
    params: list[str] = field(default_factory=list)
    defaults: dict = field(default_factory=dict)
    multi: bool = False
    queries: list[tuple[str, str]] = field(default_factory=list)


def _number(x: str):
    return int(x) if re.fullmatch(r"-?\d+", x) else x


def parse(text: str, name: str) -> Program:
    """Notes -- @name, @description, @params (with defaults), @multi and @query; a text without @query is one query 'default'."""
    out, blocks = Program(name), [["default", []]]
    for line in text.splitlines():
        note = _NOTE.match(line.strip())
        if note is None:
            if line.strip() != "--":
                blocks[-1][1].append(line)
            continue
        key, value = note[1], note[2].strip()
        if key == "query":
            blocks.append([value, []])
        elif key in ("param", "params"):
            out.params = [re.match(r"\w+", p.strip())[0] for p in re.split(r",(?![^(]*\))", value) if re.match(r"\w+", p.strip())]
            out.defaults = {k: _number(v.strip()) for k, v in _DEFAULT.findall(value)}
        elif key == "multi":
            out.multi = value.lower() == "true"
        elif key in ("name", "description"):
            setattr(out, key, value)
    out.queries = [(n, sql) for n, lines in blocks if (sql := "\n".join(lines).strip())]
    return out


def invocation(text: str) -> tuple[str, list, dict]:
    """Name, positional and named arguments of '@name a=1 b'; help, info and about mean orient."""
    words = text.strip().removeprefix("@").split()
    name = {"help": "orient", "info": "orient", "about": "orient"}.get(words[0], words[0])
    named = dict(w.split("=", 1) for w in words[1:] if "=" in w)
    return name, [_number(w) for w in words[1:] if "=" not in w], {k: _number(v) for k, v in named.items()}


def run(spark: SparkSession, program: Program, *values, **named) -> list[tuple[str, DataFrame | str]]:
    """Results of each query by name; a query that fails gives its message and the others go on."""
    args = program.defaults | dict(zip(program.params, values)) | named
    if lacking := [p for p in program.params if p not in args]:
        raise ValueError(f"{program.name} needs {', '.join(lacking)}")
    out = []
    for name, sql in program.queries:
        try:
            read_only(spark, sql)
            used = {k: v for k, v in args.items() if re.search(rf"(?<!:):{k}\b", sql)}
            out.append((name, spark.sql(sql, args=used)))
        except Exception as e:  # noqa: BLE001
            out.append((name, f"{type(e).__name__}: {str(e).splitlines()[0]}"))
    return out


def bare_text(query: str) -> bool:
    """Whether a query is plain words rather than SQL or the name of a program."""
    return not re.match(r"\s*(@|select\b|with\b|from\b|values\b|attach\b|explain\b|show\b|describe\b|--)", query, re.I)


def prelude(sql: str) -> tuple[list[tuple[str, str]], str]:
    """(corpus, alias) of the ATTACH statements that a text starts with, and the rest; an alias follows from the name where none is given."""
    out = []
    while m := re.match(r"\s*ATTACH\s+'([^']+)'(?:\s+AS\s+(\w+))?\s*;", sql, re.I):
        out.append((m[1], m[2] or re.sub(r"\W+", "_", m[1]).strip("_").lower()))
        sql = sql[m.end() :]
    if len({a for _, a in out}) < len(out):
        raise ValueError("an alias is used twice")
    return out, sql.strip()


def federated(spark: SparkSession, sql: str, corpora: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Run a text that attaches corpora: alias.table reads that corpus's table, under a view name of its own.

    Relations are found in the parsed plan and replaced where it says they stand, from the last to the first, so strings and
    comments that look alike stay. The views are dropped once the query is analysed.
    """
    attached, rest = prelude(sql)
    alias_of = {}
    for corpus, alias in attached:
        if corpus not in corpora:
            raise KeyError(f"no corpus {corpus!r}")
        alias_of[alias.lower()] = corpora[corpus]
    places = []
    for node, relation in walk(parsed(spark, rest)):
        if relation and node.getClass().getSimpleName() == "UnresolvedRelation":
            names = node.multipartIdentifier()
            if names.size() == 2 and names.apply(0).lower() in alias_of:
                at = node.origin()
                places.append((at.startIndex().get(), at.stopIndex().get() + 1, names.apply(0).lower(), names.apply(1)))
    made = {}
    try:
        for start, stop, alias, name in sorted(set(places), reverse=True):
            tables = {t.lower(): df for t, df in alias_of[alias].items()}
            if name.lower() not in tables:
                raise KeyError(f"{alias} has no table {name!r}")
            if (alias, name.lower()) not in made:
                made[alias, name.lower()] = f"_{alias}_{name}_{uuid.uuid4().hex}"
                tables[name.lower()].createOrReplaceTempView(made[alias, name.lower()])
            rest = rest[:start] + made[alias, name.lower()] + re.sub(r"^\s*[`\w]+\s*\.\s*[`\w]+", "", rest[start:stop]) + rest[stop:]
        read_only(spark, rest)
        return spark.sql(rest)
    finally:
        for view in made.values():
            spark.catalog.dropTempView(view)


#: Names of modifiers, older names of them, and which take whole numbers.
MODIFIERS = ("similar", "centroid", "diverse", "decay", "suppress", "from", "to", "pool")
OLDER = {"unlike": "suppress", "like": "centroid", "limit": "pool", "recent": "decay"}
WHOLE = ("decay", "pool")


#: Modifiers that begin a text which runs on to the next of those that end texts.
TEXTS = ("similar", "suppress", "from", "to")
ENDING = ("similar", "suppress", "from", "centroid", "decay", "pool")


def modifiers(text: str) -> dict:
    """What a modifier text asks for, word by word from the left; unknown words are kept apart.

    A text belongs to the modifier before it and ends at the next one with a colon, or at 'diverse'; 'to:' ends only the text
    of 'from:', and the two count together or not at all. A bare 'decay' ends no text, as it may be a word of it. Words before
    any modifier are what to search for, unless some of them have a colon. Of several similar texts the first counts.
    """
    out: dict = {"similar": None, "centroid": [], "diverse": False, "decay": None, "suppress": [], "from": None, "to": None, "pool": None, "extra": []}
    spoken: list[tuple[str, list[str]]] = []  # texts begun, in order
    open_text: list[str] | None = None
    for word in (text or "").split():
        name, mark, value = word.partition(":")
        name = OLDER.get(name, name) if mark or name == "recent" else name
        if word == "diverse":
            open_text, out["diverse"] = None, True
        elif mark and (name in ENDING or name == "to" and open_text is not None and spoken[-1][0] == "from"):
            open_text = None
            if name in TEXTS:
                open_text = [value] if value else []
                spoken.append((name, open_text))
            elif name == "centroid":
                out["centroid"] = value.split(",")
            elif value.isdigit():
                out[name] = int(value)
            elif name == "decay":
                out["decay"] = "default"
            else:
                out["extra"].append(word)
        elif open_text is not None:
            open_text.append(word)
        elif name == "decay":
            out["decay"] = "default"
        else:
            out["extra"].append(word)
    for k, (name, words) in enumerate(spoken):
        said = " ".join(words)
        if name == "similar" and out["similar"] is None:
            out["similar"] = said
        elif name == "suppress" and said:
            out["suppress"].append(said)
        elif name == "from" and k + 1 < len(spoken) and spoken[k + 1][0] == "to":
            out["from"], out["to"] = said, " ".join(spoken[k + 1][1])
    if out["similar"] is None and out["extra"] and not any(":" in w for w in out["extra"]):
        out["similar"], out["extra"] = " ".join(out["extra"]), []
    return out


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def complaints(text: str, known: Iterable[str] = ()) -> list[str]:
    """What is wrong with a modifier text: numbers that are none, and names of five letters or more that are close to a known one."""
    out = []
    for word in (text or "").split():
        name, mark, value = word.partition(":")
        if not mark:
            continue
        if name in WHOLE and not value.isdigit():
            out.append(f"{name} takes a whole number, not {value!r}")
        if name not in MODIFIERS and name not in OLDER and name not in known and len(name) >= 5:
            near = [m for m in (*MODIFIERS, *OLDER) if distance(name, m) <= 2]
            if near:
                out.append(f"{name}: is it {min(near, key=lambda m: (distance(name, m), m))}?")
    return out


def shipped(spark: SparkSession, entries: list, stock: set[str]) -> tuple[dict[str, Program], list[str]]:
    """Programs that a corpus brings along, and why others were refused: each entry stands or falls by itself.

    An entry is {name, sql}; its name is a plain word that no stock program has, and each of its queries only reads.
    """
    good, refused = {}, []
    for k, e in enumerate(entries):
        try:
            if not isinstance(e, dict) or not isinstance(e.get("name"), str) or not isinstance(e.get("sql"), str):
                raise ValueError("needs a name and sql")
            if not re.fullmatch(r"[a-z][a-z0-9-]*", e["name"]) or e["name"] in stock or e["name"] in good:
                raise ValueError(f"the name {e['name']!r} is not free")
            found = parse(e["sql"], e["name"])
            if not found.queries:
                raise ValueError("holds no query")
            for _, sql in found.queries:
                read_only(spark, sql)
            good[e["name"]] = found
        except Exception as x:  # noqa: BLE001
            refused.append(f"{k}: {str(x).splitlines()[0]}")
    return good, refused


#: Characters a token of a result, and the most tokens of one window and of a whole result.
CHARS_A_TOKEN, WINDOW_TOKENS, MOST_TOKENS = 3.5, 10_000, 100_000


def gated(df: DataFrame, order: list, window: int = WINDOW_TOKENS, most: int = MOST_TOKENS) -> DataFrame:
    """A result as it may be handed out: its rows as JSON with tokens, the tokens up to each, the window each falls in, and whether it is within ``most``.

    Tokens are estimated from the characters of the JSON. Rows are numbered in the order by ranges, so no task and not the
    driver holds the result; a caller fetches window after window. The first row is always within.
    """
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    rows = df.select(*order, text.alias("json"), F.ceil(F.length(text) / CHARS_A_TOKEN).cast("long").alias("tokens"))
    run = running_total(rows, order, F.col("tokens"), "so_far")
    before = F.col("so_far") - F.col("tokens")
    return run.select(*order, "json", "tokens", "so_far", F.floor(before / window).cast("int").alias("window"), ((F.col("so_far") <= most) | (before == 0)).alias("within"))
