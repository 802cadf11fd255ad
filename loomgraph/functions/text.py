"""Scalar functions over URLs, names, marks and rule phrases, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_null(c: Column) -> Column:
    """The string, or null where a pattern found nothing."""
    return F.nullif(c, F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim of all Unicode white space, no-break space included."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def canonical_url(c: Column | str) -> Column:
    """Scheme and host in lower case, no fragment, no trailing slash but for the root; the query stays."""
    bare = F.regexp_replace(_c(c), r"#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    path = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(bare, r"(\?.*)$", 1)
    kept = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, r"/+$", ""))
    return F.concat(head, kept, query)


def absolute_url(c: Column | str, base: Column | str) -> Column:
    """A link as its page means it, canonical: absolute, from the root, or from the page's folder, with dots resolved."""
    link, here = _c(c), _c(base)
    root = F.regexp_extract(here, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(here, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(url_path(here), r"^(.*/)", 1)
    path, tail = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    full = F.when(path == "", url_path(here)).when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    parts = F.split(F.regexp_replace(full, "^/", ""), "/")
    resolved = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    query = F.when((path == "") & ~tail.startswith("?"), F.concat(F.regexp_extract(here, r"(\?[^#]*)", 1), tail)).otherwise(tail)
    return canonical_url(F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).otherwise(F.concat(root, resolved, query)))


def url_path(c: Column | str) -> Column:
    return F.regexp_extract(_c(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_host(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_slug(c: Column | str, root: str = "toc") -> Column:
    """Last segment of the path; ``root`` for the root."""
    return F.coalesce(or_null(F.regexp_extract(url_path(c), r"([^/]+)/*$", 1)), F.lit(root))


def slugify(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def camel_to_snake(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(_c(c), "([A-Z])", "_$1")), "^_+", "")


def stem(c: Column | str) -> Column:
    """First suffix rule whose result keeps three letters: ies to y, then ed, ing, es, s dropped."""
    word = _c(c)
    out = F.when(word.endswith("ies") & (F.length(word) >= 5), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y")))
    for suffix in ("ed", "ing", "es", "s"):
        out = out.when(word.endswith(suffix) & (F.length(word) - len(suffix) >= 3), F.substring(word, F.lit(1), F.length(word) - len(suffix)))
    return out.otherwise(word)


def lucene_escape(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def without_parenthetical(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"\s*\([^)]*\)\s*$", "")


#: Letters, marks and numbers of any script, and the underscore.
WORD = r"\p{L}\p{M}\p{N}_"


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(f"([{WORD}]+)"), 1)


def count_words(c: Column | str) -> Column:
    return F.regexp_count(_c(c), F.lit(f"[{WORD}]+"))


def joined(separator: str, *parts: Column) -> Column:
    """Parts that are neither null nor empty, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), separator)


def stat_value(c: Column | str) -> Column:
    """Whole number, or null for dashes, bracketed bonuses and other text."""
    v = strip(c)
    return F.when(v.rlike(r"^[+-]?\d+$"), v.try_cast("int"))


def base_size(c: Column | str) -> Column:
    got = F.regexp_extract(_c(c), r"(\d+)\s*[xX×]\s*(\d+)", 1), F.regexp_extract(_c(c), r"(\d+)\s*[xX×]\s*(\d+)", 2)
    return F.struct(or_null(got[0]).try_cast("int").alias("width"), or_null(got[1]).try_cast("int").alias("depth"))


def unit_size(c: Column | str) -> Column:
    """(min, max) of ``a-b`` (hyphen or dash), ``n+`` (no maximum), ``n`` (both), else (1, null)."""
    low, high = F.regexp_extract(_c(c), r"(\d+)\s*[-–—]\s*(\d+)", 1), F.regexp_extract(_c(c), r"(\d+)\s*[-–—]\s*(\d+)", 2)
    one, plus = F.regexp_extract(_c(c), r"^\s*(\d+)\s*(\+?)", 1), F.regexp_extract(_c(c), r"^\s*(\d+)\s*(\+?)", 2)
    number = lambda x: or_null(x).try_cast("int")
    return F.struct(
        F.when(low != "", number(low)).when(one != "", number(one)).otherwise(F.lit(1)).alias("min"),
        F.when(low != "", number(high)).when((one != "") & (plus == ""), number(one)).alias("max"),
    )


def points_cost(c: Column | str) -> Column:
    """Points and unit (per_model, per_unit, flat) of ``(+N point[s] [per model|unit])``, brackets and sign included."""
    pattern = r"(?i)\(\s*\+(\d+)\s*points?(?:\s+per\s+(model|unit))?\s*\)"
    n, per = or_null(F.regexp_extract(_c(c), pattern, 1)), F.lower(F.regexp_extract(_c(c), pattern, 2))
    unit = F.when(n.isNotNull(), F.when(per == "model", "per_model").when(per == "unit", "per_unit").otherwise("flat"))
    return F.struct(n.try_cast("int").alias("points"), unit.alias("unit"))


def points_budget(c: Column | str) -> Column:
    return or_null(F.regexp_extract(_c(c), r"(?i)up\s+to\s+(?:a\s+total\s+of\s+)?(\d+)\s+(?:points?|pts)", 1)).try_cast("int")


def percent_limits(c: Column | str) -> Column:
    """(max, min) of the first ``up to N%`` or ``at least N%`` of the first paragraph."""
    p = r"(?i)(up\s+to|at\s+least)\s+(\d+)\s*%"
    first = F.element_at(F.split(_c(c), r"\R"), 1)
    number, least = or_null(F.regexp_extract(first, p, 2)).try_cast("int"), F.contains(F.lower(F.regexp_extract(first, p, 1)), F.lit("least"))
    return F.struct(F.when(~least, number).alias("max"), F.when(least, number).alias("min"))


def per_points_limit(c: Column | str) -> Column:
    """(max count, points) of ``0-N ... per Y,000 points``."""
    p = r"(?i)0-(\d+)\s+[\w\s]*per\s+([\d,]+)\s+points?"
    return F.struct(
        or_null(F.regexp_extract(_c(c), p, 1)).try_cast("int").alias("max_count"),
        or_null(F.regexp_replace(F.regexp_extract(_c(c), p, 2), ",", "")).try_cast("int").alias("per_points"),
    )


def document_version(c: Column | str) -> Column:
    """(document, version) of ``Title - Version 1.2``; else the whole text and null."""
    p = r"(?i)^(.*?)\s*[-–—]\s*Version\s+([\d.]+)"
    version = or_null(F.regexp_extract(_c(c), p, 2))
    return F.struct(F.when(version.isNotNull(), F.regexp_extract(_c(c), p, 1)).otherwise(_c(c)).alias("document"), version.alias("version"))


def alliance_type(c: Column | str) -> Column:
    """Of a bracketed kind; trusted where there is none."""
    return F.coalesce(or_null(F.lower(F.regexp_extract(_c(c), r"(?i)\(\s*(suspicious|trusted|uneasy)\s*\)", 1))), F.lit("trusted"))


def cost_suffix(points: Column, unit: Column) -> Column:
    tail = F.when(unit == "per_model", " pt/model").when(unit == "per_unit", " pts/unit").otherwise(" pts")
    return F.when(points.isNotNull(), F.concat(F.lit("(+"), points.cast("string"), tail, F.lit(")"))).otherwise("")


def yaml_scalar(c: Column | str) -> Column:
    """Double-quoted where the text holds a special sign, edge spaces or nothing."""
    v = _c(c)
    quoted = F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(v.rlike(r"""[:#"'\[\],]""") | v.rlike(r"^\s|\s$") | (v == ""), quoted).otherwise(v)
