"""Scalars over events, dates, paths, URLs, tool calls and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of tools across providers.
TOOLS = {"exec_command": "Bash", "apply_patch": "Edit", "spawn_agent": "Task", "update_plan": "TodoWrite", "view_image": "Read", "local_shell": "Bash", "web_search": "WebSearch"}


def canonical_tool(name: Column) -> Column:
    """One name for a tool whatever the provider calls it; others stay, none is 'unknown'."""
    table = F.create_map(*(F.lit(x) for pair in TOOLS.items() for x in pair))
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(F.coalesce(table[name], name))


def patch_paths(patch: Column) -> Column:
    """Files that the lines *** Update, Add or Delete File of a patch name."""
    return F.transform(F.regexp_extract_all(F.coalesce(patch, F.lit("")), F.lit(r"(?m)^\*\*\* (?:Update|Add|Delete) File: (.*)$"), 1), lambda x: F.trim(x))


def strip_line_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^[ \t]*\d+\t", "")


def normalise_path(path: Column, cwd: Column) -> Column:
    """An absolute path without . and .. parts and doubled slashes; relative ones start at ``cwd`` where that is known."""
    bare = F.trim(path)
    whole = F.when(bare.startswith("/") | cwd.isNull() | (cwd == ""), bare).otherwise(F.concat(cwd, F.lit("/"), bare))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((p == "..") & whole.startswith("/"), acc).otherwise(F.concat(acc, F.array(p)))
    left = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")
    out = F.when(whole.startswith("/"), F.concat(F.lit("/"), left)).when(left == "", ".").otherwise(left)
    return F.when(F.coalesce(bare, F.lit("")) != "", out)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def search_url(query: Column) -> Column:
    """A pseudo-address for a search: lower case, single blanks, percent-encoded."""
    plain = F.lower(F.trim(F.regexp_replace(query, r"\s+", " ")))
    return F.when(F.coalesce(query, F.lit("")) == "", "").otherwise(F.concat(F.lit("search://web?q="), F.replace(F.replace(F.url_encode(plain), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))))


def file_date(value: Column, today: Column) -> Column:
    """The token if it is a calendar date in one of four shapes and at most a day ahead of ``today``, else null."""
    raw = F.trim(value)
    day = (
        F.when(raw.rlike(r"^\d{6}$"), F.concat(F.lit("20"), raw))
        .when(raw.rlike(r"^\d{6}-([01]\d|2[0-3])[0-5]\d$"), F.concat(F.lit("20"), F.substring(raw, 1, 6)))
        .when(raw.rlike(r"^20\d{6}$"), raw)
        .when(raw.rlike(r"^20\d{2}-\d{2}-\d{2}"), F.translate(F.substring(raw, 1, 10), "-", ""))
    )
    return F.when(F.try_to_date(day, "yyyyMMdd") <= F.date_add(today, 1), raw)


def show_date(token: Column) -> Column:
    """A calendar token as year-month-day with the time where it has one; other text stays."""
    cut = lambda k, n: F.substring(token, k, n)
    short = F.concat(F.lit("20"), cut(1, 2), F.lit("-"), cut(3, 2), F.lit("-"), cut(5, 2))
    return (
        F.when(token.rlike(r"^\d{6}-\d{4}$"), F.concat(short, F.lit(" "), cut(8, 2), F.lit(":"), cut(10, 2)))
        .when(token.rlike(r"^\d{6}$"), short)
        .when(token.rlike(r"^\d{8}$"), F.concat_ws("-", cut(1, 4), cut(5, 2), cut(7, 2)))
        .otherwise(token)
    )


def name_date(name: Column) -> Column:
    """The calendar token that a file name starts with."""
    found = F.regexp_extract(name, r"^(\d{6}-\d{4}|20\d{6}|\d{6})(?=[_\- .])", 1)
    return F.when(found != "", found)


def name_title(name: Column) -> Column:
    """A file name without extension and leading date, its separators blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"^(\d{6}-\d{4}|20\d{6}|\d{6})[_\- .]+", ""), r"[_\-]+", " "))


def coerce_timestamp(value: Column) -> Column:
    """Epoch seconds of a number, a numeric text or one of four written forms (a weekday in brackets is ignored), else null."""
    raw = F.trim(F.regexp_replace(value, r"\s*\([^)]*\)", ""))
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd")
    return F.coalesce(F.when(raw.rlike(r"^-?\d+(\.\d+)?$"), raw.try_cast("double").cast("long")), *(F.unix_seconds(F.try_to_timestamp(raw, F.lit(f))) for f in forms))


def noise(text: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a text is runtime telemetry: empty, two of its first eight lines start like it, or one where there are three lines at most."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    starts = lambda x: F.greatest(*(x.startswith(p) for p in (*prefixes, "\0")))
    n = F.size(F.filter(F.slice(lines, 1, 8), starts))
    return (F.size(lines) == 0) | (n >= 2) | ((n == 1) & (F.size(lines) <= 3))


def clip(text: Column, chars: int) -> Column:
    """One line of at most ``chars`` characters, the last three dots where something is missing."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > chars, F.concat(F.substring(flat, 1, chars - 3), F.lit("..."))).otherwise(flat)


def clip_left(path: Column, chars: int) -> Column:
    return F.when(F.length(path) > chars, F.concat(F.lit("..."), F.right(path, F.lit(chars - 3)))).otherwise(path)


def strip_heading(text: Column) -> Column:
    """A text that starts with # without its first line."""
    at = F.instr(text, "\n")
    return F.when(~text.startswith("#"), text).when(at > 0, F.ltrim(F.substring(text, at + 1, F.length(text)))).otherwise("")


def asks(title: Column) -> Column:
    """Whether an issue's title reads like a question."""
    return F.coalesce(title.contains("?") | title.rlike(r"(?i)\b(how|why|what|when|can|does|is there|help)\b"), F.lit(False))


def offset_hours(zone: str, ts: Column) -> Column:
    """Hours that ``zone`` is ahead of UTC at a time."""
    return (F.unix_seconds(F.from_utc_timestamp(ts, zone)) - F.unix_seconds(ts)) / 3600


def in_call_window(zone: str, ts: Column, start: int = 9, stop: int = 18) -> Column:
    return F.hour(F.from_utc_timestamp(ts, zone)).between(start, stop - 1)


def tool_line(tool: Column, target: Column, content: Column, skip: tuple[str, ...] = ("UserPrompt", "TaskOutput", "BashOutput")) -> Column:
    """One line for a tool call: files by their name, commands and searches by their first 60 characters, servers' tools by their last part; null if skipped."""
    quoted = lambda text: F.when(text != "", F.concat(F.lit("op:"), tool, F.lit(" `"), text, F.lit("`"))).otherwise(F.concat(F.lit("op:"), tool))
    told = F.trim(F.coalesce(content, F.lit("")))
    command = F.trim(F.when(told.startswith("Bash:"), F.substring(told, 6, 1 << 30)).otherwise(told))
    named = F.coalesce(basename(target), F.lit(""))
    short = F.trim(F.substring(F.coalesce(content, F.lit("")), 1, 60))
    parts = F.split(tool, "__")
    return (
        F.when((F.coalesce(tool, F.lit("")) == "") | tool.isin(*skip), None)
        .when(tool.isin("Read", "Write", "Edit", "MultiEdit"), quoted(named))
        .when(tool == "Bash", quoted(F.when((F.length(command) > 3) & (command != "Bash"), F.substring(command, 1, 60)).otherwise("")))
        .when(tool == "Task", F.when(short != "", F.concat(F.lit('op:Task "'), short, F.lit('"'))).otherwise("op:Task"))
        .when(tool.isin("WebSearch", "WebFetch"), quoted(short))
        .when(tool.startswith("mcp__"), F.concat(F.lit("op:"), F.when(F.size(parts) > 2, F.element_at(parts, -1)).otherwise("MCP tool")))
        .otherwise(F.concat(F.lit("op:"), tool))
    )
