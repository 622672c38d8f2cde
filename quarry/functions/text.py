"""Scalar expressions over text, paths and addresses."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and what they are without.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
BARE = "aaaaaaceeeeiiiinooooouuuuyy"
#: Query parameters that only track.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source", "campaign", "mc_cid", "mc_eid",
    "_ga", "_gl", "msclkid", "zanpid", "dclid", "yclid", "wickedid", "twclid", "li_fat_id", "igshid", "epik", "si",
)


def terms(text: Column) -> Column:
    """Lower-case terms without marks, in order; anything but letters and digits separates."""
    return split_terms(folded(text))


def folded(text: Column) -> Column:
    return F.translate(lowered(text), MARKED, BARE)


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def bare(words: pa.Array) -> pa.Array:
    """Lower-case words without marks. Letters stay letters, so a term may lose its marks after its text is split as well as before."""
    marked, table = pc.match_substring_regex(words, f"[{MARKED}]"), str.maketrans(MARKED, BARE)
    return pc.replace_with_mask(words, marked, pa.array([w.translate(table) for w in words.filter(marked).to_pylist()], words.type))


def split_terms(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), "")


def sanitise(query: str) -> list[str]:
    """Terms of a plain query: apostrophes vanish, other signs but dots separate, single characters go."""
    kept = "".join(c if c.isalnum() or c in ". " else "" if c in "'’" else " " for c in query.lower())
    return [w.strip(".") for w in kept.split() if len(w.strip(".")) > 1]


def chunk_id(source: Column, position: Column, content: Column) -> Column:
    return F.concat_ws(":", source.cast("string"), position.cast("string"), F.substring(F.sha2(content, 256), 1, 12))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def sentences(text: Column, most: int = 3, chars: int = 200) -> Column:
    """The first sentences, clipped."""
    return F.substring(F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, most), " "), 1, chars)


def entropy(words: Column) -> Column:
    """Shannon entropy in bits of the distribution of an array of words."""
    n = F.size(words).cast("double")
    share = lambda w: F.size(F.filter(words, lambda x: x == w)) / n
    return F.aggregate(F.transform(F.array_distinct(words), lambda w: -share(w) * F.log2(share(w))), F.lit(0.0), lambda a, b: a + b)


def normalise_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no tracking parameters, sorted parameters, no trailing slash."""
    scheme, rest = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    keep = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING)))
    mark = F.regexp_extract(rest, r"(#.*)$", 1)
    return F.concat(scheme, F.lit("://"), host, path, F.when(F.size(keep) > 0, F.concat(F.lit("?"), F.array_join(keep, "&"))).otherwise(""), mark)


def section_type(title: Column) -> Column:
    """Kind of a heading; the first rule that holds counts."""
    t = F.lower(title)
    rules = (("abstract", "abstract"), ("introduction", "introduction"), ("related", "related"), ("method", "method"), ("result", "results"), ("conclusion", "conclusion"))
    out = F.when(F.lit(False), "")
    for part, kind in rules:
        out = out.when(t.contains(part), kind)
    return out.otherwise("other")
