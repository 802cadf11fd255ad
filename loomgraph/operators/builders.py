"""Texts of nodes by label, as they are embedded and searched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import parse as P
from loomgraph.functions import text as X

STATS = ("M", "WS", "BS", "S", "T", "W", "I", "A", "Ld")


def _said(before: str, c: Column, after: str = "") -> Column:
    """A value in its words; nothing for null."""
    return F.concat(F.lit(before), c.cast("string"), F.lit(after))


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _all(c: Column, before: str, separator: str = ", ") -> Column:
    """An array's values in their words; nothing for an empty one."""
    return F.when(F.size(c) > 0, F.concat(F.lit(before), F.array_join(c, separator)))


def _sorted(c: Column) -> Column:
    return F.array_sort(F.filter(c, lambda x: F.coalesce(x, F.lit("")) != ""))


# one expression a label, over the columns of its nodes


def named(name: Column, text: Column) -> Column:
    return X.joined(". ", name, text)


def troop_type(name: Column, category: Column, least: Column, most: Column, strength: Column, text: Column) -> Column:
    rank = F.concat(F.lit("Rank bonus min "), least.cast("string"), F.lit(" / max +"), F.coalesce(most.cast("string"), F.lit("None")))
    return X.joined(". ", name, category, rank, _said("Unit strength ", _filled(strength)), text)


def spell(name: Column, lore: Column, text: Column) -> Column:
    return X.joined(". ", name, _said("Lore of ", _filled(lore)), text)


def item(name: Column, kind: Column, cost: Column, text: Column) -> Column:
    return X.joined(". ", name, P.spaced(kind), _said("", cost, " pts"), text)


def lore(name: Column, text: Column, spells: Column) -> Column:
    return X.joined(". ", name, text, _all(_sorted(spells), "Spells: "))


def question(asked: Column, answer: Column) -> Column:
    return X.joined(" ", asked, answer)


def erratum(name: Column, original: Column, corrected: Column) -> Column:
    return X.joined(". ", name, _said("Original: ", _filled(original)), _said("Corrected: ", _filled(corrected)))


def weapon(name: Column, kind: Column, reach: Column, strength: Column, ap: Column, shots: Column, armour: Column, rules: Column, text: Column) -> Column:
    stats = X.joined(" ", _said("Range ", reach), _said("Str ", strength), _said("AP ", ap), _said("Shots ", shots), _said("AV ", armour))
    return X.joined(". ", name, P.spaced(kind), stats, _all(rules, "Special rules: "), text)


def terrain(name: Column, kind: Column, blocks: Column, disrupts: Column, dangerous: Column, penalty: Column, cover: Column, text: Column) -> Column:
    flags = X.joined(
        ", ", F.when(blocks, "blocks movement"), F.when(disrupts, "disrupts rank bonus"), F.when(dangerous, "requires a dangerous terrain test"),
        _said("movement penalty: ", _filled(penalty)), _said("grants ", _filled(cover), " cover"),
    )
    return X.joined(". ", name, _said("", P.spaced(_filled(kind)), " terrain"), flags, text)


def size(least: Column, most: Column) -> Column:
    """a-b, or a+ without an upper bound."""
    return F.concat(least.cast("string"), F.when(F.coalesce(most, F.lit(0)) != 0, F.concat(F.lit("-"), most.cast("string"))).otherwise("+"))


def profile(name: Column, stats: dict[str, Column]) -> Column:
    """A profile's line: its name and the values that it has."""
    values = X.joined(" ", *[F.concat(F.lit(k), v.cast("string")) for k, v in stats.items()])
    return F.when(values != "", F.concat(name, F.lit(": "), values)).otherwise(name)


def option(name: Column, cost: Column, unit: Column, limit: Column) -> Column:
    """An upgrade with its cost and limit; nothing without a name."""
    return F.when(_filled(name).isNotNull(), X.joined(" ", name, X.cost_suffix(cost, unit), F.concat(F.lit("["), _filled(limit), F.lit("]"))))


def unit(u: dict[str, Column], armies: Column, types: Column, profiles: Column, rules: Column, weapons: Column, upgrades: Column) -> Column:
    """All that is said of a unit, in a fixed order; ``profiles`` come in theirs, the other lists are sorted here."""
    base = F.when((F.coalesce(u["base_width"], F.lit(0)) != 0) & (F.coalesce(u["base_depth"], F.lit(0)) != 0), F.concat(F.lit("Base "), u["base_width"].cast("string"), F.lit("x"), u["base_depth"].cast("string"), F.lit("mm")))
    return X.joined(
        ". ", u["name"], _all(armies, ""), _all(types, ""), u["category"], _said("", u["cost"], " pts/model"), _said("Unit size ", size(u["size_min"], u["size_max"])), base,
        _said("Armour save ", _filled(u["av"])), _all(profiles, "Profiles — ", "; "), _all(_sorted(rules), "Rules: "), _all(_sorted(weapons), "Weapons: "), _all(_sorted(upgrades), "Upgrades: "),
    )


# what is added to a node where it is a source or stands beside one


def seed_summary(label: Column, p: dict[str, Column]) -> Column:
    """Details of a unit, an item or an upgrade among the sources."""
    base = F.when((F.coalesce(p["base_width"], F.lit(0)) != 0) & (F.coalesce(p["base_depth"], F.lit(0)) != 0), F.concat(F.lit("Base "), p["base_width"].cast("string"), F.lit("x"), p["base_depth"].cast("string"), F.lit("mm")))
    of_unit = X.joined(" ; ", _said("", p["cost"], " pts/model"), _said("Unit size ", size(p["size_min"], p["size_max"])), base, _said("Category ", _filled(p["category"])))
    of_item = X.joined(" ; ", P.spaced(_filled(p["item_type"])), _said("", p["points"], " pts"))
    wrapped = lambda c: F.when(c != "", F.concat(F.lit("("), c, F.lit(")"))).otherwise("")
    return F.when(label == "Unit", wrapped(of_unit)).when(label == "MagicItem", wrapped(of_item)).when(label == "Upgrade", X.cost_suffix(p["points"], p["unit"])).otherwise("")


def neighbour_summary(label: Column, p: dict[str, Column]) -> Column:
    """Details of a profile, a unit or an upgrade beside the sources."""
    values = X.joined(" ", *[F.concat(F.lit(k), p[k].cast("string")) for k in STATS if k in p])
    base = F.when((F.coalesce(p["base_width"], F.lit(0)) != 0) & (F.coalesce(p["base_depth"], F.lit(0)) != 0), F.concat(F.lit("Base "), p["base_width"].cast("string"), F.lit("x"), p["base_depth"].cast("string"), F.lit("mm")))
    of_unit = X.joined(" ; ", _said("", p["cost"], " pts/model"), base)
    return (
        F.when(label == "Profile", F.when(values != "", F.concat(F.lit("Stats: "), values)).otherwise(""))
        .when(label == "Unit", F.when(of_unit != "", F.concat(F.lit("("), of_unit, F.lit(")"))).otherwise("")).when(label == "Upgrade", X.cost_suffix(p["points"], p["unit"])).otherwise("")
    )


def aligned(ids: DataFrame, builders: dict[str, Callable[[DataFrame], DataFrame]], by_name: DataFrame) -> DataFrame:
    """``ids(place, label, id)`` with their texts: each label's builder takes the ids of its label (id, text), other labels give ``by_name(id, name)``; a missing node gives an empty text."""
    made = None
    for label, build in builders.items():
        wanted = ids.where(F.col("label") == label).select("id").distinct()
        part = build(wanted).select(F.lit(label).alias("_label"), F.col("id").alias("_id"), F.col("text").alias("_text"))
        made = part if made is None else made.unionByName(part)
    rows = ids.join(made, (F.col("label") == F.col("_label")) & (F.col("id") == F.col("_id")), "left")
    rows = rows.join(by_name.select(F.col("id").alias("_n"), F.col("name").alias("_name")), F.col("id") == F.col("_n"), "left")
    fallback = F.when(~F.col("label").isin(*builders), F.col("_name"))
    return rows.select("place", "label", "id", F.coalesce("_text", fallback, F.lit("")).alias("text"))
