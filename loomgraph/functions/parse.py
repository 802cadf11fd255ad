"""Parsers of page fields: what a text, a slug or a path says, as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions.classify import first_rule
from loomgraph.sources import constants as K


def lookup(values: dict[str, str | None], key: Column) -> Column:
    """The value of a key, null where it is unknown or suppressed."""
    return F.element_at(F.create_map(*[F.lit(x).cast("string") for x in chain(*values.items())]), key)


def known(values: dict[str, str | None], key: Column) -> Column:
    return key.isin(*values)


def title(c: Column) -> Column:
    """Every run of letters with its first letter in upper case, the others in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1)))), "")


def name_of_slug(slug: Column) -> Column:
    return title(F.replace(slug, F.lit("-"), F.lit(" ")))


def spaced(c: Column) -> Column:
    """Underscores as spaces."""
    return F.replace(c, F.lit("_"), F.lit(" "))


def without_suffixes(c: Column, *suffixes: str) -> Column:
    """Each suffix dropped in turn where the text still ends with it."""
    for s in suffixes:
        c = F.when(c.endswith(s), F.substring(c, F.lit(1), F.length(c) - len(s))).otherwise(c)
    return c


def without_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 2**31 - 1)).otherwise(c)


def citation(c: Column) -> Column:
    """(book, page) of ``Book, p. 12``, split at the last ``, p.``; else the whole text and null."""
    p = r"(?s)^(.*), p\.(.*)$"
    hit = c.rlike(p)
    part = lambda i: X.strip(F.regexp_extract(c, p, i))
    return F.struct(F.when(hit, part(1)).otherwise(c).alias("book"), F.when(hit, part(2)).alias("page"))


def without_page_prefix(c: Column) -> Column:
    return X.strip(F.regexp_replace(c, r"(?i)^Page\s+\d+\s*[-–—]\s*", ""))


def faq_topic(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("/faq/")), F.nullif(name_of_slug(F.regexp_extract(F.regexp_replace(url, "/+$", ""), r"/faq/((?:(?!/faq/).)*)$", 1)), F.lit("")))


def is_fallback(data: Column) -> Column:
    """Whether a page's data says that it is a stand-in still to be built, or there is none."""
    return F.coalesce(F.get_json_object(data, "$.isFallback").try_cast("boolean"), F.lit(False)) | data.isNull()


def wizard_level(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def section_of(rule_type: Column, path: Column) -> Column:
    """(section, name): the rule type's slug, else the last but one segment of the path, or its only one."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    own = F.when(F.size(parts) >= 2, F.element_at(parts, -2)).when(F.size(parts) == 1, F.element_at(parts, 1)).otherwise("")
    section = F.coalesce(F.nullif(rule_type, F.lit("")), own)
    return F.struct(section.alias("section"), name_of_slug(section).alias("name"))


def sibling_url(section: Column, slug: Column) -> Column:
    """``/section/slug`` where both are given."""
    both = (F.coalesce(section, F.lit("")) != "") & (F.coalesce(slug, F.lit("")) != "")
    return F.when(both, F.concat(F.lit("/"), section, F.lit("/"), slug))


def casting(value: Column, override: Column, order: Column, lore: Column) -> Column:
    """Casting value (none beside an override), override, lore number and lore of a spell."""
    said = F.nullif(override, F.lit(""))
    return F.struct(
        F.when(said.isNull(), value.try_cast("int")).alias("casting_value"), said.alias("override"),
        F.coalesce(F.floor(order / 10).cast("int"), F.lit(0)).alias("lore_number"), F.nullif(without_suffixes(lore, "-lore"), F.lit("")).alias("lore_id"),
    )


def casting_edge(casting_: Column) -> Column:
    """The rule that a spell with a casting value or an override refers to."""
    return F.when(casting_["casting_value"].isNotNull() | casting_["override"].isNotNull(), K.CASTING_VALUE_RULE)


def item_type(raw: Column) -> Column:
    """By the table, else the words in lower case joined by underscores; null for nothing."""
    some = F.nullif(raw, F.lit(""))
    return F.coalesce(lookup(K.ITEM_TYPE_OF, some), F.replace(F.lower(some), F.lit(" "), F.lit("_")))


def troop_type(slug: Column) -> Column:
    """The plural page of a singular slug; other slugs stay, a suppressed one gives null."""
    return F.when(known(K.TROOP_TYPE_OF, slug), lookup(K.TROOP_TYPE_OF, slug)).otherwise(slug)


def army_and_book(association: Column, name: Column, url: Column) -> Column:
    """(army, book) of an item: none and the book of rules without an association, else by page, by book, or as it stands."""
    army = F.when((association != "") & (association != "rulebook"), association)
    page = F.regexp_extract(url, r"([^/]*)/*$", 1)
    mapped = F.coalesce(lookup(K.ARMY_OF_PAGE, page), lookup(K.ARMY_OF_BOOK, army), army)
    return F.struct(F.when(army.isNotNull(), mapped).alias("army"), F.coalesce(name, F.lit("Rulebook")).alias("book"))


def rule_scope(association: Column) -> Column:
    own = (F.coalesce(association, F.lit("")) != "") & (association != "rulebook")
    return F.struct(F.when(own, "army").otherwise("universal").alias("scope"), F.when(own, association).alias("army"))


def troop_category(slug: Column, name: Column) -> Column:
    """By the first keyword, in the order of the table, in slug or name."""
    # fixed values
    hints = [("infantry", "infantry"), ("cavalry", "cavalry"), ("monstrous", "monster"), ("monster", "monster"), ("war-machine", "war_machine"), ("chariot", "chariot"), ("swarm", "swarm"), ("flyer", "flyer"), ("beast", "beast")]
    said = F.lower(F.concat_ws(" ", slug, name))
    return first_rule([(F.contains(said, F.lit(k)), v) for k, v in hints], "unknown")


def weapon_class(slug: Column, name: Column) -> Column:
    """By slug, then by whole words of slug and name."""
    # fixed values
    armour = ["light-armour", "heavy-armour", "full-plate-armour", "dragon-armour", "chaos-armour", "gromril-armour", "ithilmar-armour", "shield", "buckler", "barding", "dragon-scale-helm", "helmet"]
    machines = ["cannon", "mortar", "rock-lobber", "bolt-thrower", "stone-thrower", "hellblaster-volley-gun", "steam-tank", "organ-gun"]
    words = [
        (r"\bmissile\b|\bbow\b|\bcrossbow\b|\bpistol\b|\brifle\b|\bthrown\b|\bblowpipe\b", "missile"),
        (r"\bsword\b|\baxe\b|\bhalberd\b|\blance\b|\bspear\b|\bflail\b|\bmace\b|\bhammer\b|\bgreat.weapon\b|\bweapon\b", "melee"),
        (r"\barmou?r\b|\bshield\b|\bhelmet\b|\bmail\b|\bbarding\b", "armour"),
    ]
    said = F.lower(F.concat_ws(" ", slug, name))
    return first_rule([(slug.isin(*armour), "armour"), (slug.isin(*machines), "war_machine"), *[(said.rlike(p), v) for p, v in words]], "equipment")


#: Class of a terrain by slug, and whether it blocks movement.
TERRAIN_CLASS = {
    "open-ground": "open", "difficult-terrain": "difficult", "dangerous-terrain": "dangerous", "impassable-terrain": "impassable",
    "low-linear-obstacles": "low_linear_obstacle", "defended-low-linear-obstacles": "low_linear_obstacle", "high-linear-obstacles": "high_linear_obstacle",
    "woods": "woods", "woodland-boundaries": "woods", "arboreal-gloom": "woods", "hills": "hills", "vantage-point": "hills", "beyond-the-crest": "hills",
    "arcane-monolith": "special_feature", "monument-of-glory": "special_feature", "dark-ruins": "special_feature", "tower": "building", "buildings": "building",
    "linear-terrain-features": "linear_terrain_feature",
}
BLOCKING = ["impassable-terrain", "high-linear-obstacles", "arcane-monolith", "monument-of-glory", "dark-ruins", "tower", "buildings"]
#: Keywords of other terrains, the first that stands in the first 500 characters decides.
TERRAIN_WORDS = [
    ("open ground", "open"), ("difficult terrain", "difficult"), ("very difficult terrain", "difficult"), ("dangerous terrain", "dangerous"), ("impassable terrain", "impassable"),
    ("low linear obstacle", "low_linear_obstacle"), ("high linear obstacle", "high_linear_obstacle"), ("woods", "woods"), ("forest", "woods"), ("hills", "hills"), ("building", "building"),
    ("special feature", "special_feature"), ("linear terrain feature", "linear_terrain_feature"),
]


def terrain(slug: Column, body: Column) -> Column:
    """Class, movement penalty, flags and cover of a terrain."""
    head = F.lower(F.substring(body, 1, 500))
    kind = F.coalesce(lookup(TERRAIN_CLASS, slug), first_rule([(F.contains(head, F.lit(k)), v) for k, v in TERRAIN_WORDS]))
    cover = F.lower(F.regexp_extract(body, r"(?i)\b(soft cover|hard cover)\b", 1))
    return F.struct(
        kind.alias("terrain_class"),
        F.when(known(TERRAIN_CLASS, slug), slug.isin(*BLOCKING)).otherwise(body.rlike(r"(?i)\bimpassable\b")).alias("blocks_movement"),
        body.rlike(r"(?i)\b(disrupted|cannot claim (a |any )?rank bonus)\b").alias("disrupts_units"),
        body.rlike(r"(?i)\bdangerous terrain test\b").alias("requires_dangerous_test"),
        F.when(cover == "soft cover", "partial").when(cover == "hard cover", "full").alias("grants_cover"),
        F.nullif(F.regexp_extract(body, r"(?i)\b(half(?:ed)?|halve|moves at half|treat as difficult)\b", 1), F.lit("")).alias("movement_penalty"),
    )


def standard_bearer(c: Column) -> Column:
    """Cost, unlimited flag and slugs of the characters that may carry the army's standard."""
    names = F.regexp_replace(X.strip(F.regexp_extract(c, r"(?i)A\s+single\s+([\w\s\-',()]+?)\s+in\s+your\s+army\s+may\s+be\s+upgraded", 1)), r"\([^)]*\)", "")
    slugs = F.filter(F.transform(F.split(names, r"\s*,\s*|\s+or\s+"), lambda x: X.slugify(x)), lambda x: x != "")
    return F.struct(
        X.or_null(F.regexp_extract(c, r"(?i)\+(\d+)\s+point", 1)).try_cast("int").alias("points"),
        c.rlike(r"(?i)magic\s+standard\s+with\s+no\s+points\s+limit|no\s+points\s+limit|unlimited\s+magic\s+standard").alias("unlimited"),
        slugs.alias("characters"),
    )


def is_mount_profile(m: Column, t: Column, w: Column) -> Column:
    """A profile that moves but has neither toughness nor wounds."""
    none = lambda x: F.coalesce(x, F.lit("")).isin("", "-")
    return ~none(m) & none(t) & none(w)


def scannable(name: Column) -> Column:
    """Names long enough to be sought in texts: five characters, or two words."""
    return (F.length(name) >= 5) | (F.size(F.split(X.strip(name), r"(?U)\s+")) >= 2)


def identified(id_: Column, name: Column, asked: str) -> Column:
    """A node by id, by the slug of what is asked, or by name in any case."""
    return (id_ == asked) | (id_ == asked.lower().replace(" ", "-")) | (F.lower(name) == asked.lower())


def allowed(label: Column, options: list[str]) -> Column:
    """The label, or an error that lists the options."""
    return F.when(label.isin(*options), label).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(label, F.lit("null")), F.lit("; options: " + ", ".join(options)))))


def rule_lines(c: Column) -> Column:
    """Slugs of the lines of a text without links, in order, each once."""
    lines = F.filter(F.transform(F.split(c, r"\R"), lambda x: X.strip(x)), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: X.slugify(x)))


def mode_config(mode: Column) -> Column:
    """(strategy, lexical, expand) of a retrieval mode in any case, graph where none is given; an unknown one is an error."""
    config = lambda s, lexical, expand: F.struct(F.lit(s).alias("strategy"), F.lit(lexical).alias("lexical"), F.lit(expand).alias("expand"))
    m = F.lower(F.coalesce(F.nullif(mode, F.lit("")), F.lit("graph")))
    error = F.raise_error(F.concat(F.lit("unknown mode "), m, F.lit("; one of graph, hybrid, vector"))).cast("struct<strategy:string,lexical:boolean,expand:boolean>")
    return F.when(m == "vector", config("vector", False, False)).when(m == "graph", config("vector", True, True)).when(m == "hybrid", config("hybrid", False, True)).otherwise(error)


def content_part(item: Column, kinds: tuple[str, ...], fields: tuple[str, ...]) -> Column:
    """Of one content block (JSON) the first field that is not empty, if it is of a kind."""
    values = [F.nullif(F.get_json_object(item, f"$.{f}"), F.lit("")) for f in fields]
    return F.when(F.get_json_object(item, "$.type").isin(*kinds), F.coalesce(*values, F.lit(""))).otherwise("")


def content(c: Column) -> Column:
    """Text, reasoning and cited places of a message content: a plain string, a block, or a list of blocks, as JSON."""
    blocks = F.from_json(c, "array<string>")
    kind = F.substring(F.trim(c), 1, 1)
    items = F.when(kind == "[", F.coalesce(blocks, F.array().cast("array<string>"))).when(kind == "{", F.array(c)).otherwise(F.array().cast("array<string>"))
    plain = F.when(~kind.isin("[", "{"), F.coalesce(F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string")["v"], F.lit("")))
    # an item of a list may itself be a plain string
    one = lambda x: F.when(F.substring(F.trim(x), 1, 1) == "{", content_part(x, ("text", "text_delta"), ("text", "delta"))).otherwise(x)
    text = F.coalesce(plain, F.array_join(F.transform(items, one), ""))
    reasoning = F.array_join(F.transform(items, lambda x: content_part(x, ("thinking", "reasoning"), ("thinking", "reasoning"))), "")
    cited = F.flatten(F.transform(items, lambda x: F.coalesce(F.from_json(F.when(F.get_json_object(x, "$.type") == "text", F.get_json_object(x, "$.citations")), "array<struct<type:string,search_result_index:int>>"), F.array().cast("array<struct<type:string,search_result_index:int>>"))))
    places = F.transform(F.filter(cited, lambda x: (x["type"] == "search_result_location") & x["search_result_index"].isNotNull()), lambda x: x["search_result_index"])
    return F.struct(text.alias("text"), reasoning.alias("reasoning"), F.array_sort(F.array_distinct(places)).alias("cited"))


def graph_node(c: Column) -> Column:
    """A node as a client reads it: absent for null, a field of a wrong type is null, and unreadable text is null as a whole."""
    return F.from_json(c, "id string, name string, label string, page int, score double", {"mode": "PERMISSIVE"})


def page_class(path: Column) -> Column:
    """Rule or document, by section or by section and page."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    section = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    page = F.array_join(F.slice(parts, 1, 2), "/")
    return F.when(section.isin(*K.DOCUMENT_SECTIONS) | page.isin(*K.DOCUMENT_PAGES), "Document").otherwise("CoreRule")


def first_linked(c: Column, field: str) -> Column:
    """A field of the first entry of a linked list, or of a single linked entry, as JSON."""
    return F.coalesce(F.get_json_object(c, f"$[0].fields.{field}"), F.get_json_object(c, f"$.fields.{field}"))


def body_text(c: Column) -> Column:
    """An entry's index text, else its rich text as a tree."""
    return F.coalesce(F.nullif(F.get_json_object(c, "$.bodyIndex"), F.lit("")), F.get_json_object(c, "$.body"))
