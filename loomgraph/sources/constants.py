"""Constant relations and lookup tables of the data model; all are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# -- fixed values: relations that are seeded beside the parsed ones ------------

#: from, to, alliance_type.
ALLIANCES = [
    ("vampire-counts", "tomb-kings-of-khemri", "trusted"),
    ("empire-of-man", "dwarfen-mountain-holds", "trusted"),
    ("empire-of-man", "grand-cathay", "trusted"),
    ("empire-of-man", "kingdom-of-bretonnia", "trusted"),
    ("empire-of-man", "wood-elf-realms", "suspicious"),
]
#: rule, terrain, effect.
TERRAIN_INTERACTIONS = [
    ("fly", "difficult-terrain", "ignores"),
    ("fly", "dangerous-terrain", "ignores_dangerous_test"),
    ("fly", "woods", "ignores"),
    ("ethereal", "difficult-terrain", "ignores"),
    ("ethereal", "dangerous-terrain", "ignores"),
    ("ethereal", "impassable-terrain", "ignores"),
    ("move-through-cover", "woods", "ignores_cover"),
    ("scouts", "woods", "can_deploy_in"),
    ("skirmishers", "woods", "ignores_disruption"),
]
#: id, least models for a rank bonus, greatest rank bonus, unit strength a model.
TROOP_TYPES = [
    ("regular-infantry", 5, 2, "1"),
    ("heavy-infantry", 4, 2, "1"),
    ("monstrous-infantry", 3, 2, "3"),
    ("swarms", None, None, "3"),
    ("light-cavalry", 5, 1, "2"),
    ("heavy-cavalry", 4, 1, "2"),
    ("monstrous-cavalry", 3, 1, "3"),
    ("war-beasts", 5, 1, "1"),
    ("light-chariots", 3, 1, "3"),
    ("heavy-chariots", None, None, "5"),
    ("monstrous-creatures", None, None, "As Starting Wounds"),
    ("behemoths", None, None, "As Starting Wounds"),
    ("war-machines", None, None, "As Starting Wounds"),
]

# -- fixed values: lookups; a value of None suppresses the reference -----------

TROOP_TYPE_OF = {
    "behemoth": "behemoths", "heavy-chariot": "heavy-chariots", "light-chariot": "light-chariots", "monstrous-creature": "monstrous-creatures",
    "swarm": "swarms", "war-beast": "war-beasts", "war-machine": "war-machines", "named-character": None,
}
ITEM_TYPE_OF = {
    "Magic Weapon": "magic_weapon", "Magic Armour": "magic_armour", "Talisman": "talisman", "Magic Standard": "magic_standard",
    "Enchanted Item": "enchanted_item", "Arcane Item": "arcane_item", "Ability": "ability", "Unique": "unique",
}
CATEGORY_OF = {"named-character": "Named Characters", "character": "Characters", "mount": "Mounts"}
ARMY_OF_BOOK = {
    "arcane-journal-dwarfen-mountain-holds": "dwarfen-mountain-holds", "arcane-journal-empire-of-man": "empire-of-man",
    "arcane-journal-wood-elf-realms": "wood-elf-realms", "arcane-journal-armies-of-grand-cathay": "grand-cathay",
    "arcane-journal-the-razing-of-westerland": "warriors-of-chaos",
}
ARMY_OF_PAGE = {"incantations-scrolls": "tomb-kings-of-khemri"}
BUDGET_OF = {"vampiric-powers": "vampiric_powers_budget", "weapon-runes": "rune_budget", "armour-runes": "rune_budget", "standard-runes": "rune_budget", "talismanic-runes": "rune_budget"}
CASTING_VALUE_RULE = "casting-roll-casting-result-and-casting-value"
UNIVERSAL_ARMIES = ["ravening-hordes", "forces-of-fantasy"]


def alliances(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALLIANCES, "src string, dst string, alliance_type string")


def terrain_interactions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERRAIN_INTERACTIONS, "src string, dst string, effect string")


def troop_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TROOP_TYPES, "id string, min_models_for_rank_bonus int, max_rank_bonus int, unit_strength_per_model string")

# -- fixed values: pages that are documents, not rules --------------------------

DOCUMENT_SECTIONS = ["overview-of-the-game"]
DOCUMENT_PAGES = [
    "general-principles/take-backs-and-changing-ones-mind", "general-principles/the-most-important-rule", "general-principles/unusual-situations",
    "warhammer-battles/size-of-battlefield", "warhammer-battles/first-turn", "warhammer-battles/game-length-warhammer-battles", "warhammer-battles/conceding",
    "warhammer-battles/time-limit", "warhammer-battles/pitched-battles", "warhammer-battles/historical-recreation", "warhammer-battles/setting-up-your-battlefield",
    "warhammer-battles/choosing-a-pitched-battle-scenario",
    "narrative-battles/what-is-a-narrative-battle", "narrative-battles/historical-recreations", "narrative-battles/narrative-scenarios", "narrative-battles/open-play",
    "narrative-battles/armies-of-imagination", "narrative-battles/think-of-them-more-as-guidelines", "narrative-battles/the-games-master", "narrative-battles/the-role-of-a-gm",
    "narrative-battles/forging-a-narrative", "narrative-battles/narrative-locations", "narrative-battles/narrative-motives", "narrative-battles/linked-battles",
    "narrative-battles/campaign-narrative", "narrative-battles/the-dark-monolith",
    "matched-play/organising-an-event", "matched-play/roles-and-responsibilties", "matched-play/the-pairing-of-players", "matched-play/an-alliance-of-warlords",
    "matched-play/gather-your-allies",
]
