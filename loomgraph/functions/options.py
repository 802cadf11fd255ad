"""Upgrade options: one option line with its links and the context of its group becomes an upgrade, natively."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions import parse as P
from loomgraph.functions import text as X
from loomgraph.functions.classify import first_rule
from loomgraph.sources import constants as K

# fixed values: the patterns of option lines and of the headers above them
STANDARD = r"(?i)upgrade\s+one\s+model\s+to\s+a\s+standard\s+bearer"
MUSICIAN = r"(?i)upgrade\s+one\s+model\s+to\s+(?:a\s+)?[\w\s\-]*\(musician\)|upgrade\s+one\s+model\s+to\s+a\s+musician"
CHAMPION = r"(?i)upgrade\s+one\s+model\s+to\s+(?:a\s+|an\s+)?([\w\s\-]+?)(?:\s*\(champion\))?\s*\(\s*\+"
STANDARD_BUDGET = r"(?i)(?:magic\s+standard|standard)\s+(?:worth\s+)?up\s+to"
WIZARD = r"(?i)be\s+a\s+level\s+(\d+)\s+wizard"
REPLACE = r"(?i)\breplace\b"
ARMOUR = r"(?i)\b(?:heavy\s+armour|light\s+armour|full\s+plate(?:\s+armour)?|barding|shield(?:\s+\w+)?|coat\s+of\s+plates?|dragon\s+armour|gromril\s+armour|ithilmar\s+armour|enchanted\s+shield)\b"
UNITS_AT_MOST = r"(?i)^0-(\d+)\s+unit"
SCOPE = r"(?i)^An?\s+([\w\s\-]+?)\s+may\b"
MOUNT_HEADER = r"(?i)may\s+be\s+mounted"
MUTEX_HEADER = r"(?i)may\s+take\s+one\s+of\s+the\s+following"
MOUNT = "armyListEntry"
BUDGET_NAMES = {"magic_item_budget": "Magic Item Budget", "magic_standard_budget": "Magic Standard Budget", "vampiric_powers_budget": "Vampiric Powers Budget", "rune_budget": "Rune Budget"}


def budget_type(text: Column, slugs: Column) -> Column:
    """By the first linked slug that names a kind of budget, then by the text."""
    by_link = F.element_at(F.filter(F.transform(slugs, lambda s: P.lookup(K.BUDGET_OF, s)), lambda x: x.isNotNull()), 1)
    linked = F.exists(slugs, lambda s: P.known(K.BUDGET_OF, s))
    return F.when(linked, by_link).when(text.rlike(STANDARD_BUDGET), "magic_standard_budget").otherwise("magic_item_budget")


def upgrade(text: Column, links: Column, mounts: Column) -> Column:
    """Type, name, cost, budgets and replaced weapon of an option; the first rule that holds decides.

    ``links`` are structs of slug and kind; ``mounts``: the option stands below a mount header.
    """
    cost, budget = X.points_cost(text), X.points_budget(text)
    slugs = F.transform(links, lambda x: x["slug"])
    rules = F.transform(F.filter(links, lambda x: x["kind"] != MOUNT), lambda x: x["slug"])
    riders = F.transform(F.filter(links, lambda x: x["kind"] == MOUNT), lambda x: x["slug"])
    champion = X.or_null(X.strip(F.regexp_extract(text, CHAMPION, 1)))
    level = X.or_null(F.regexp_extract(text, WIZARD, 1))
    replaces = text.rlike(REPLACE)
    of_budget = budget_type(text, slugs)
    kind = first_rule([
        (text.rlike(STANDARD), "command_standard"), (text.rlike(MUSICIAN), "command_musician"), (champion.isNotNull(), "command_champion"), (budget.isNotNull(), "budget"),
        (level.isNotNull(), "wizard_level"), (mounts | (F.size(riders) > 0), "mount"), (replaces & (F.size(links) > 0), "weapon_replace"), (text.rlike(ARMOUR) & ~replaces, "armour_add"),
    ], "rule_add")
    short = F.substring(X.strip(text), 1, 60)
    first = lambda a, i=1: P.name_of_slug(F.try_element_at(a, F.lit(i)))
    swap = F.when(F.size(rules) >= 2, F.concat(F.lit("Replace "), first(rules), F.lit(" with "), first(rules, 2))).otherwise(F.coalesce(first(rules), short))
    budget_name = F.concat(P.lookup(BUDGET_NAMES, of_budget), F.when(budget > 0, F.concat(F.lit(" ("), budget.cast("string"), F.lit(" pts)"))).otherwise(""))
    name = (
        F.when(kind == "command_standard", "Standard Bearer").when(kind == "command_musician", "Musician").when(kind == "command_champion", F.concat(F.lit("Champion ("), P.title(champion), F.lit(")")))
        .when(kind == "budget", budget_name).when(kind == "wizard_level", F.concat(F.lit("Level "), level, F.lit(" Wizard"))).when(kind == "mount", F.coalesce(first(riders), short))
        .when(kind == "weapon_replace", swap).otherwise(F.coalesce(first(rules), short))
    )
    default = F.when(F.startswith(kind, F.lit("command_")), "per_unit").when(kind.isin("wizard_level", "mount"), "flat").when(kind.isin("weapon_replace", "armour_add"), "per_model")
    return F.struct(
        F.when(kind == "budget", of_budget).otherwise(kind).alias("upgrade_type"), name.alias("name"), F.when(kind != "budget", cost["points"]).alias("points_cost"),
        F.when(kind == "budget", "budget").otherwise(F.coalesce(cost["unit"], default)).alias("cost_unit"),
        F.when(kind.isin("budget", "command_champion"), budget).alias("points_budget"),
        F.when((kind == "command_standard") & text.rlike(STANDARD_BUDGET), budget).alias("magic_standard_budget"),
        F.when((kind == "weapon_replace") & (F.size(rules) >= 2), F.try_element_at(rules, F.lit(1))).alias("replaces"),
    )


def context(items: Column, unit: Column, profiles: Column) -> Column:
    """Each item with its id and what its group's header says: alternatives, mount, number of units, profile.

    ``items`` as ``richtext.option_items`` gives them; ``profiles``: ids of the unit's profiles.
    """

    def one(x: Column) -> Column:
        header = x["header"]
        said = F.coalesce(header, x["text"])
        mutex = F.size(F.array_distinct(F.transform(F.filter(items, lambda y: (y["group_no"] <= x["group_no"]) & F.coalesce(y["header"].rlike(MUTEX_HEADER), F.lit(False))), lambda y: y["group_no"])))
        scope = F.concat(unit, F.lit("#"), X.slugify(X.or_null(F.regexp_extract(said, SCOPE, 1))))
        return F.struct(
            F.concat(unit, F.lit("#upgrade-"), x["pos"].cast("string")).alias("id"), x["pos"].alias("order"), x["text"].alias("text"), x["links"].alias("links"),
            F.when(header.rlike(MUTEX_HEADER), F.concat(unit, F.lit("#mg"), mutex.cast("string"))).alias("mutex_group"),
            F.when(header.rlike(UNITS_AT_MOST), header).alias("availability_constraint"),
            F.coalesce(header.rlike(MOUNT_HEADER), F.lit(False)).alias("mounts"),
            F.when(F.array_contains(profiles, scope), scope).alias("applies_to_profile"),
        )

    return F.transform(items, one)


def edges(id_: Column, links: Column, kind: Column) -> Column:
    """(relation, dst) of an upgrade's links: mounts it unlocks, the weapon it replaces, all others provisionally as rules."""
    rules = F.filter(links, lambda x: x["kind"] != MOUNT)
    some = lambda x, relation: F.struct(relation.alias("relation"), x["slug"].alias("dst"))
    swapped = (kind == "weapon_replace") & (F.size(rules) >= 2)
    return F.concat(
        F.transform(F.filter(links, lambda x: x["kind"] == MOUNT), lambda x: some(x, F.lit("UNLOCKS_MOUNT"))),
        F.transform(rules, lambda x, i: some(x, F.when(swapped & (i == 0), "REPLACES_WEAPON").otherwise("UNLOCKS_RULE"))),
    )
