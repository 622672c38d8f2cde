"""Source files and shell commands as rows: definitions, imports, files that a command touches, rules for splitting."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import markdown as M


def python_nodes(text: str) -> list[tuple]:
    """(kind, name, parent, first line, last line, called names) of a module, its classes and functions; none if it doesn't parse.

    A definition's calls are those of its own region: of bare names, outside definitions inside it.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out: list[tuple] = []

    def visit(node, path: str | None) -> None:
        calls, inner = [], []
        todo = [x for x in ast.iter_child_nodes(node) if x not in getattr(node, "decorator_list", ())]
        while todo:
            x = todo.pop(0)
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                inner.append(x)
                todo += x.decorator_list
                continue
            if isinstance(x, ast.Call) and isinstance(x.func, ast.Name):
                calls.append(x.func.id)
            todo += ast.iter_child_nodes(x)
        if isinstance(node, ast.Module):
            name, kind, first, last = "", "module", 1, len(text.splitlines())
        else:
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            name, first, last = f"{path}.{node.name}" if path else node.name, min([node.lineno, *(d.lineno for d in node.decorator_list)]), node.end_lineno
        out.append((kind, name, path, first, last, sorted(set(calls))))
        for x in inner:
            visit(x, name)

    visit(tree, None)
    return out


def code_tree(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, kind, name, parent, first, last and calls of each definition of Python files."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(p, *n) for p, t in zip(b[path], b[text]) for n in python_nodes(t or "")]
            yield pd.DataFrame(found, columns=["path", "kind", "name", "parent", "first", "last", "calls"])

    return files.select(path, text).mapInPandas(each, "path string, kind string, name string, parent string, first int, last int, calls array<string>")


def imports(text: Column) -> Column:
    """Modules that Python or script text imports, in order of kind: import x, from x import y, import … from 'x', require('x')."""
    grab = lambda p: F.regexp_extract_all(text, F.lit(p), 1)
    plain = F.flatten(F.transform(grab(r"(?m)^\s*import[ \t]+([\w. ,]+?)[ \t]*$"), lambda m: F.transform(F.split(m, ","), lambda x: F.regexp_extract(F.trim(x), r"^([\w.]+)", 1))))
    return F.array_distinct(F.filter(F.concat(plain, grab(r"(?m)^\s*from[ \t]+([\w.]+)[ \t]+import"), grab(r"""(?m)^\s*import\b[^;'"\n]*?from\s*['"]([^'"]+)['"]"""), grab(r"""require\(\s*['"]([^'"]+)['"]\s*\)""")), lambda x: x != ""))


#: Shell commands by what they do to the files named, how sure that is, and the pattern of the name.
_FILE = r"((?:\"[^\"]+\"|'[^']+'|[^\s;|&<>\"']+))"
SHELL_RULES = (
    ("write", 0.9, rf"(?<![>&\d])>(?![>&])\s*{_FILE}"),
    ("append", 0.9, rf">>\s*{_FILE}"),
    ("edit", 0.95, rf"\bsed\s+-i\S*\s+(?:-e\s+)?(?:'[^']*'|\"[^\"]*\"|\S+)\s+{_FILE}"),
    ("write", 0.85, rf"\btee\s+(?:-a\s+)?{_FILE}"),
    ("write", 0.9, rf"\bcp\s+(?:-\S+\s+)*[^\s;|&]+\s+{_FILE}"),
    ("write", 0.9, rf"\bmv\s+(?:-\S+\s+)*[^\s;|&]+\s+{_FILE}"),
    ("delete", 0.9, rf"\bmv\s+(?:-\S+\s+)*{_FILE}\s+[^\s;|&]+"),
    ("delete", 0.95, rf"\brm\s+(?:-\S+\s+)*{_FILE}"),
    ("create", 0.8, rf"\btouch\s+{_FILE}"),
    ("mkdir", 0.8, rf"\bmkdir\s+(?:-\S+\s+)*{_FILE}"),
    ("read", 0.7, rf"\b(?:cat|head|tail|less|wc|stat|sha256sum|md5sum)\s+(?:-\S+\s+|\d+\s+)*(?![<>-]){_FILE}"),
    ("read", 0.6, rf"\bgrep\s+(?:-\S+\s+)*(?:'[^']*'|\"[^\"]*\"|\S+)\s+{_FILE}"),
    ("read", 0.7, rf"\bsed\s+-n\s+(?:'[^']*'|\"[^\"]*\"|\S+)\s+{_FILE}"),
)


def file_ops(commands: DataFrame, key: str, command: str) -> DataFrame:
    """key, path, op and confidence of the files that a shell command touches, the surest rule of each path and op."""
    found = []
    for op, sure, pattern in SHELL_RULES:
        names = F.regexp_extract_all(F.col(command), F.lit(pattern), 1)
        found.append(F.transform(names, _marked(op, sure)))
    each = commands.select(key, F.explode(F.concat(*found)).alias("f")).select(key, "f.*")
    real = ~F.col("path").isin("", "/dev/null", "-") & ~F.col("path").rlike(r"^[$(&-]")
    return each.where(real).groupBy(key, "path", "op").agg(F.max("confidence").alias("confidence"))


def _marked(op: str, sure: float):
    return lambda x: F.struct(F.regexp_replace(x, r"^[\"']|[\"']$", "").alias("path"), F.lit(op).alias("op"), F.lit(sure).alias("confidence"))


def rule_for(files: DataFrame, rules: DataFrame) -> DataFrame:
    """path and strategy by precedence: a rule of the file itself, of its longest folder (whole parts), of its subtype, the default.

    ``files``: path, subtype; ``rules``: kind (file, folder, subtype, default), pattern, strategy. Folders join by equality
    with each folder above the file.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.when(n == F.size(parts), "file").otherwise("folder").alias("kind"), F.array_join(F.slice(parts, 1, n), "/").alias("pattern")))
    also = F.array(F.struct(F.lit("subtype").alias("kind"), F.coalesce("subtype", F.lit("")).alias("pattern")), F.struct(F.lit("default").alias("kind"), F.lit("").alias("pattern")))
    asked = files.select("path", F.explode(F.concat(above, also)).alias("r")).select("path", "r.*")
    rank = F.expr("CASE kind WHEN 'file' THEN 0 WHEN 'folder' THEN 1 WHEN 'subtype' THEN 2 ELSE 3 END")
    hit = asked.join(rules, ["kind", "pattern"]).groupBy("path").agg(F.min(F.struct(rank.alias("rank"), (-F.length("pattern")).alias("length"), F.col("strategy"))).alias("b"))
    return files.select("path").join(hit, "path", "left").select("path", F.coalesce("b.strategy", F.lit("heading")).alias("strategy"))


def split_files(files: DataFrame, path: str = "path", text: str = "text", strategy: str = "strategy", pattern: str = r"(?m)^-{3,}$") -> DataFrame:
    """(path, strategy, position, title, body) of files by their strategy: heading, whole, sliding, template or ast; others count as heading.

    whole: the text as it is; sliding: windows; template: the parts between lines that ``pattern`` matches; ast: the definitions
    of Python source, titled by their names; a file that doesn't parse stays whole. Empty bodies are left out.
    """
    of = lambda *names: files.where(F.coalesce(F.col(strategy).isin(*names), F.lit(False)))
    named = ("whole", "sliding", "template", "ast")
    shape = lambda df, name, title, body, at="position": df.select(path, F.lit(name).alias("strategy"), F.col(at).cast("int").alias("position"), title.alias("title"), body.alias("body"))
    heads = shape(M.sections(files.where(~F.coalesce(F.col(strategy).isin(*named), F.lit(False))), path, text), "heading", F.col("title"), F.col("body"))
    whole = shape(of("whole").withColumn("position", F.lit(0)), "whole", F.lit(""), F.col(text))
    windows = shape(M.windows(of("sliding"), path, text), "sliding", F.lit(""), F.col("piece"))
    parts = shape(of("template").select(path, F.posexplode(F.split(text, pattern)).alias("position", "piece")), "template", F.lit(""), F.regexp_replace("piece", r"^\s+|\s+$", ""))
    source = of("ast").select(F.col(path).alias("path"), F.col(text).alias("text"))
    tree = code_tree(source)
    span = tree.where("kind <> 'module'").join(source, "path")
    lines = F.array_join(F.slice(F.split("text", "\n"), F.col("first"), F.col("last") - F.col("first") + 1), "\n")
    order = F.row_number().over(Window.partitionBy("path").orderBy("first", "name")) - 1
    defined = span.withColumn("position", order).select(F.col("path").alias(path), F.lit("ast").alias("strategy"), F.col("position").cast("int").alias("position"), F.col("name").alias("title"), lines.alias("body"))
    rest = source.join(span.select("path").distinct(), "path", "left_anti").select(F.col("path").alias(path), F.lit("ast").alias("strategy"), F.lit(0).alias("position"), F.lit("").alias("title"), F.col("text").alias("body"))
    return heads.unionByName(whole).unionByName(windows).unionByName(parts).unionByName(defined).unionByName(rest).where("trim(body) <> ''")


def classify(titles: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """titles with type: the first rule that holds, an alias (equal without case) or a pattern between slashes."""
    out = F.lit(None).cast("string")
    for rule, kind in reversed(rules):
        holds = F.col("title").rlike("(?i)" + rule[1 : rule.rindex("/")]) if rule.startswith("/") else F.lower(F.trim("title")) == rule.lower()
        out = F.when(holds, kind).otherwise(out)
    return titles.withColumn("type", out)


def latex_sections(text: Column) -> Column:
    """LaTeX as headings: comments go, the abstract and sections to paragraphs become # to #### lines."""
    bare = F.regexp_replace(text, r"(?m)(?<!\\)%.*$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\\begin\{abstract\}", "\n# Abstract\n"), r"\\end\{abstract\}", "\n")
    for depth, name in enumerate(("section", "subsection", "subsubsection", "paragraph"), 1):
        bare = F.regexp_replace(bare, rf"\\{name}\*?\{{([^}}]*)\}}", "\n" + "#" * depth + " $1\n")
    return bare


def latex_title(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, r"\\title\{([^}]*)\}", 1), r"\s+", " ")
