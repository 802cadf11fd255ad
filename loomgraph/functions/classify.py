"""Rule-based classifiers: the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions import text as X


def first_rule(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    out = F.when(rules[0][0], rules[0][1])
    for test, value in rules[1:]:
        out = out.when(test, value)
    return out.otherwise(F.lit(otherwise).cast("string"))


def page_kind(path: Column) -> Column:
    """Kind of a page by its path."""
    return first_rule([(path.isin("", "/"), "toc"), (path.rlike(r"^/[a-z]{2}/\d+/?$"), "article"), (path.rlike(r"^/[a-z]{2}(/|$)"), "section"), (path.rlike(r"\.(pdf|zip)$"), "file")])


def page_type(path: Column) -> Column:
    """Type of a page by the first pattern of its path; null for pages that are passed over."""
    # fixed values: the patterns, in order
    patterns = [
        (r"^/?$", "toc"), (r"^/sitemap(/.*)?$", "sitemap"), (r"^/army/[^/]+/reference/?$", "army_reference"), (r"^/army/[^/]+$", "army"), (r"^/unit/[^/]+$", "unit"), (r"^/faq/?$", "faq"),
        (r"^/faq/[^/]+$", "faq"), (r"^/errata/?$", "errata"), (r"^/special-rules/[^/]+$", "special_rule"), (r"^/troop-types-in-detail/[^/]+$", "troop_type"), (r"^/magic-items/[^/]+$", "magic_item"),
        (r"^/the-lores-of-magic/[^/]+$", "spell"), (r"^/spell/[^/]+$", "spell_page"), (r"^/weapons-of-war/[^/]+$", "weapon"), (r"^/battlefield-terrain/[^/]+$", "terrain"), (r"^/[^/]+/[^/]+$", "core_rule"),
    ]
    return first_rule([(path.rlike(p), v) for p, v in patterns])


def page_parser(kind: Column, path: Column, has_items: Column) -> Column:
    """The parser of a page: four corrections of its type, the first that applies."""
    bare = F.regexp_replace(path, "/+$", "")
    core = kind == "core_rule"
    rules = [((kind == "magic_item") & ~has_items, "core_rule"), (core & bare.endswith("-army-list"), "army_list"), (core & bare.startswith("/spell/"), "spell_page"), (core & bare.startswith("/magic-item/"), "magic_item")]
    out = F.when(*rules[0])
    for r in rules[1:]:
        out = out.when(*r)
    return out.otherwise(kind)


def crawlable(url: Column, host: str, excluded: tuple[str, ...] = ("/api", "/preview")) -> Column:
    """http(s), of the host or below it, outside the excluded prefixes."""
    path = X.url_path(url)
    out = url.rlike("^https?://") & ((X.url_host(url) == host) | X.url_host(url).endswith("." + host))
    for prefix in excluded:
        out &= ~path.startswith(prefix)
    return out


def terrain_kind(slug: Column, body: Column) -> Column:
    """By slug, else by the first keyword of the first 500 characters."""
    head = F.lower(F.substring(body, 1, 500))
    return F.coalesce(
        F.when(slug.rlike("(^|-)(hill|hills)($|-)"), "hill").when(slug.rlike("(^|-)(wood|woods|forest)($|-)"), "woods"),
        first_rule([(F.contains(head, F.lit("water")), "water"), (F.contains(head, F.lit("wall")), "linear_obstacle"), (F.contains(head, F.lit("the")), "open")], "special"),
    )


def failure_kind(status: Column, message: Column, tries: Column) -> Column:
    return first_rule([(status == 404, "404"), (status >= 400, "http_error"), (message.rlike("(?i)timeout|connection"), "network"), (tries > 3, "isr_exhausted"), (message.isNotNull(), "unexpected")])


def hop_bucket(n: Column) -> Column:
    return F.when(n >= 3, "3+").otherwise(n.cast("string"))


def weapon_kind(slug: Column, name: Column) -> Column:
    """By a set of slugs, then by wording of slug and name."""
    said = F.concat_ws(" ", slug, F.lower(name))
    return first_rule([(slug.isin("old-rod", "new-rod"), "great_weapon"), (said.rlike("bolt|arrow|bow"), "missile"), (said.rlike("ring|gem"), "arcane"), (said.rlike("rod|widget"), "combat")], "other")


def document_kind(section: Column, slug: Column) -> Column:
    """Rule or document, by section or by section and slug together."""
    return F.when(section.isin("src0", "src1") | F.concat(section, F.lit("/"), slug).isin("src2/en", "src3/de"), "Document").otherwise("CoreRule")


def routed_kind(kind: Column, slug: Column, has_data: Column) -> Column:
    """Corrections of a page's kind, the first that applies."""
    return F.when(slug.rlike("^[0-9]+$") & (kind == "article"), "numbered").when(has_data, "data").when(kind == "toc", "index").otherwise(kind)
