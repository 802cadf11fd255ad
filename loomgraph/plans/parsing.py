"""Parsing queries: texts made of a part's own name, size and number, and what a rule must give for them.

Every part takes one of a family's patterns in turn and fills its marks with its
own columns, so the rule reads what the table holds; the SQL fills the same marks
into what the pattern must give, written down by hand from the rule and not
computed.  Patterns differ where a rule is easily got wrong.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import classify as C
from loomgraph.functions import markup as M
from loomgraph.functions import options as O
from loomgraph.functions import parse as P
from loomgraph.functions import richtext as T
from loomgraph.functions import text as X
from loomgraph.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SQL = {"string": "VARCHAR", "bigint": "BIGINT", "boolean": "BOOLEAN"}


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v).lower() if isinstance(v, bool) else str(v)


#: Marks in patterns: a part's adjective and noun, small and with a capital, its size, its number, and what an odd size says.
MARKS = {
    "§a": ("split(p_name, ' ')[0]", "string_split(p_name, ' ')[1]"), "§b": ("element_at(split(p_name, ' '), -1)", "string_split(p_name, ' ')[-1]"),
    "§A": ("initcap(split(p_name, ' ')[0])", "upper(left(string_split(p_name, ' ')[1], 1)) || substr(string_split(p_name, ' ')[1], 2)"),
    "§B": ("initcap(element_at(split(p_name, ' '), -1))", "upper(left(string_split(p_name, ' ')[-1], 1)) || substr(string_split(p_name, ' ')[-1], 2)"),
    "§n": ("string(p_size)", "p_size::VARCHAR"), "§m": ("string(p_partkey)", "p_partkey::VARCHAR"), "§t": ("string(p_size % 2 = 1)", "(p_size % 2 = 1)::VARCHAR"),
    "§v": ("if(p_size % 2 = 1, 'vector', 'hybrid')", "if(p_size % 2 = 1, 'vector', 'hybrid')"), "§k": ("if(p_size % 2 = 1, 'Impassable', 'Easy')", "if(p_size % 2 = 1, 'Impassable', 'Easy')"), "§g": ("if(p_size % 2 = 1, 'GRAPH', 'hybrid')", "if(p_size % 2 = 1, 'GRAPH', 'hybrid')"),
}


def _filled(c: Column) -> Column:
    for mark, (value, _) in MARKS.items():
        c = F.replace(c, F.lit(mark), F.expr(value))
    return c


def family(name: str, inputs: str, outputs: str, cases: list[tuple], first: Callable[[Column], Column] | None = None, dealt: bool = False) -> Callable:
    """Register a query over ``part`` whose rows take the patterns in turn; a pattern has the inputs, then the outputs, with the marks of ``MARKS``.

    ``first`` is applied to the first input in a step of its own; ``dealt`` rows
    go to all tasks first, for parsers that take long over a table of few files.
    """
    ins, outs = [x.split(":") for x in inputs.split()], [x.split(":") for x in outputs.split()]

    def register(make: Callable[..., Column]) -> Callable:
        def query(spark: SparkSession, d: str) -> DataFrame:
            said = lambda v: str(v).lower() if isinstance(v, bool) else None if v is None else str(v)
            rows = F.array(*[F.struct(*[F.lit(said(v)).cast("string").alias(n) for v, (n, _) in zip(case, ins)]) for case in cases])
            part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
            part = (part.repartition("p_partkey") if dealt else part).withColumn("x", F.element_at(rows, (F.col("p_partkey") % len(cases) + 1).cast("int")))
            filled = part.select("p_partkey", *[_filled(F.col(f"x.{n}")).cast(t).alias(n) for n, t in ins])
            filled = filled if first is None else filled.withColumn(ins[0][0], first(F.col(ins[0][0])))
            made = filled.select("p_partkey", make(*[F.col(n) for n, _ in ins]).alias("y"))
            one = F.col("y") if len(outs) == 1 and made.schema["y"].dataType.typeName() != "struct" else None
            return made.select("p_partkey", *[(F.col(f"y.{n}") if one is None else one).cast(t).alias(n) for n, t in outs])

        query.__name__, query.__doc__ = name, make.__doc__
        QUERIES[name] = query
        values = ", ".join("(" + ", ".join([str(i), *[_literal(v if v is None or isinstance(v, str) else str(v).lower()) for v in case[len(ins) :]]]) + ")" for i, case in enumerate(cases))

        def put(n: str) -> str:
            for mark, (_, value) in MARKS.items():
                n = f"replace({n}, '{mark}', {value})"
            return n

        picked = ", ".join(f"({put(f't.{n}::VARCHAR')})::{_SQL[t]} AS {n}" for n, t in outs)
        ORACLES[name] = f"SELECT p_partkey, {picked} FROM part JOIN (VALUES {values}) t(_i, {', '.join(n for n, _ in outs)}) ON _i = p_partkey % {len(cases)}"
        return query

    return register


def _links(c: Column) -> Column:
    """``slug:kind|slug:kind`` as structs."""
    parts = F.filter(F.split(c, r"\|"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.element_at(F.split(x, ":"), 1).alias("slug"), F.element_at(F.split(x, ":"), 2).alias("kind")))


@family(
    "option_upgrade", "text:string links:string mounts:boolean", "upgrade_type:string name:string points_cost:bigint cost_unit:string points_budget:bigint magic_standard_budget:bigint replaces:string",
    [
        ("May upgrade one model to a standard bearer (+§n points per unit)", "", False, "command_standard", "Standard Bearer", "§n", "per_unit", None, None, None),
        ("Upgrade one model to a standard bearer, who may carry a magic standard worth up to 50 points", "", False, "command_standard", "Standard Bearer", None, "per_unit", None, 50, None),
        ("May purchase a magic standard worth up to §n points", "", False, "magic_standard_budget", "Magic Standard Budget (§n pts)", None, "budget", "§n", None, None),
        ("Upgrade one model to a standard bearer, with gear up to a total of 20 pts", "", False, "command_standard", "Standard Bearer", None, "per_unit", None, None, None),
        ("Upgrade one model to a hornblower (musician) (+5 points)", "", False, "command_musician", "Musician", 5, "flat", None, None, None),
        ("Upgrade one model to a §A §B (champion) ( +7 points per unit )", "", False, "command_champion", "Champion (§A §B)", 7, "per_unit", None, None, None),
        ("Upgrade one model to an §A Hand (+§n points), with gear up to a total of 25 points", "", False, "command_champion", "Champion (§A Hand)", "§n", "flat", 25, None, None),
        ("May purchase items up to a total of §n points", "", False, "magic_item_budget", "Magic Item Budget (§n pts)", None, "budget", "§n", None, None),
        ("May purchase runes up to §n pts", "weapon-runes:rule", False, "rune_budget", "Rune Budget (§n pts)", None, "budget", "§n", None, None),
        ("May buy powers up to a  total of 40 points", "other:rule|vampiric-powers:rule", False, "vampiric_powers_budget", "Vampiric Powers Budget (40 pts)", None, "budget", 40, None, None),
        ("May be a Level 3 Wizard (+§n points)", "", False, "wizard_level", "Level 3 Wizard", "§n", "flat", None, None, None),
        ("May be a Level 1 Wizard", "", False, "wizard_level", "Level 1 Wizard", None, "flat", None, None, None),
        ("May ride along (+§n points)", "§a-horse:armyListEntry", False, "mount", "§A Horse", "§n", "flat", None, None, None),
        ("A §a mule (+3 points)", "", True, "mount", "A §a mule (+3 points)", 3, "flat", None, None, None),
        ("Replace §a axe with §b pike (+§n points per model)", "§a-axe:rule|§b-pike:rule", False, "weapon_replace", "Replace §A Axe with §B Pike", "§n", "per_model", None, None, "§a-axe"),
        ("Replace all §bs", "§b-pike:rule", False, "weapon_replace", "§B Pike", None, "per_model", None, None, None),
        ("Replace it without a link", "", False, "rule_add", "Replace it without a link", None, None, None, None, None),
        ("May wear heavy armour (+§n points per model)", "heavy-armour:rule", False, "armour_add", "Heavy Armour", "§n", "per_model", None, None, None),
        ("May have a barding", "", False, "armour_add", "May have a barding", None, "per_model", None, None, None),
        ("Costs up to nothing, 100 points in words", "§a-folk:rule", False, "rule_add", "§A Folk", None, None, None, None, None),
        ("This standard rule is for all (+§n points)", "", False, "rule_add", "This standard rule is for all (+§n points)", "§n", "flat", None, None, None),
    ],
)
def option_upgrade(text, links, mounts):
    """What an option line is, with its name, cost and budgets."""
    return O.upgrade(text, _links(links), mounts)


def _p(text: str) -> str:
    return f'{{"nodeType":"paragraph","content":[{{"nodeType":"text","value":"{text}"}}]}}'


def _link(slug: str, kind: str) -> str:
    return f'{{"nodeType":"entry-hyperlink","data":{{"target":{{"fields":{{"slug":"{slug}"}},"sys":{{"contentType":{{"sys":{{"id":"{kind}"}}}}}}}}}},"content":[{{"nodeType":"text","value":"{slug}"}}]}}'


def _li(*content: str) -> str:
    return f'{{"nodeType":"list-item","content":[{",".join(content)}]}}'


def _ul(*items: str) -> str:
    return f'{{"nodeType":"unordered-list","content":[{",".join(items)}]}}'


def _doc(*content: str) -> str:
    return f'{{"nodeType":"document","content":[{",".join(content)}]}}'


_TREES = [
    _doc(_p("intro"), _ul(_li(_p("A Captain may buy a §b (+5 points)")), _li(_p("The unit may take one of the following:"), _ul(_li(_p("a")), _li(_p("b")))), _li(_p("0-1 unit of §bs may have:"), _ul(_li(_p("c")))))),
    _doc(_ul(_li(_p("May take one of the following:"), _ul(_li(_p("x")))), _li(_p("May be mounted on:"), _ul(_li(_p("y")))), _li(_p("It may take one of the following: "), _ul(_li(_p("z")))))),
    _doc(_p("no list at all")),
    _doc(_ul(_li(_p("A Nobody may buy a §b")), _li(_p("A Captain may choose:"), _ul(_li(_p("v")), _li(_p("w"))))), _ul(_li(_p("a second list is passed over")))),
]


@family(
    "option_context", "tree:string", "said:string",
    [
        (_TREES[0], "u#upgrade-0,,,false,u#captain;u#upgrade-1,u#mg1,,false,;u#upgrade-2,u#mg1,,false,;u#upgrade-3,,0-1 unit of §bs may have,false,"),
        (_TREES[1], "u#upgrade-0,u#mg1,,false,;u#upgrade-1,,,true,;u#upgrade-2,u#mg2,,false,"),
        (_TREES[2], ""),
        (_TREES[3], "u#upgrade-0,,,false,;u#upgrade-1,,,false,u#captain;u#upgrade-2,,,false,u#captain"),
        ("{broken", ""),
    ],
    T.option_items,
)
def option_context(tree):
    """Ids of a unit's options and what their groups' headers say: alternatives, number of units, mounts, profile."""
    items = O.context(tree, F.lit("u"), F.array(F.lit("u#captain")))
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lines = F.transform(items, lambda x: F.concat_ws(",", x["id"], blank(x["mutex_group"]), blank(x["availability_constraint"]), blank(x["mounts"]), blank(x["applies_to_profile"])))
    return F.coalesce(F.array_join(lines, ";"), F.lit(""))


@family(
    "option_edges", "links:string kind:string", "said:string",
    [
        ("§a:rule|§b:rule|§m:armyListEntry", "weapon_replace", "UNLOCKS_MOUNT §m,REPLACES_WEAPON §a,UNLOCKS_RULE §b"),
        ("§a:rule", "weapon_replace", "UNLOCKS_RULE §a"), ("§b:rule|§a:rule", "rule_add", "UNLOCKS_RULE §b,UNLOCKS_RULE §a"), ("", "mount", ""),
    ],
)
def option_edges(links, kind):
    """Edges of an upgrade's links."""
    return F.array_join(F.transform(O.edges(F.lit("u"), _links(links), kind), lambda e: F.concat_ws(" ", e["relation"], e["dst"])), ",")


_BLOCK = '{"nodeType":"embedded-entry-block","data":{"target":{"fields":{"bodyIndex":"from the §b index","slug":"s1"},"sys":{"contentType":{"sys":{"id":"magicItem"}}}}}}'


@family(
    "rich_text_entries", "tree:string", "plain:string links:string has_item:boolean leaves:string",
    [
        (_doc(_p("§a "), _BLOCK), "§a from the §b index", "s1 magicItem", True, ""),
        (_doc(f'{{"nodeType":"paragraph","content":[{_link("§a-pike", "rule")},{_link("§b-mule", "armyListEntry")}]}}'), "§a-pike§b-mule", "§a-pike rule,§b-mule armyListEntry", False, ""),
        (_doc(_ul(_li(_p("a"), _ul(_li(_p("b")), _li(_p("c"), _ul(_li(_p("d")))))), _li(_p("e")))), "abcde", "", False, "b,d,e"),
        (None, "", "", False, ""),
    ],
)
def rich_text_entries(tree):
    """Text, typed links in order, whether an item block is embedded, and the texts of the leaves of all lists."""
    linked = F.filter(T.flat(tree), lambda n: n["slug"].isNotNull())
    return F.struct(
        T.text_of(tree).alias("plain"), F.array_join(F.transform(linked, lambda n: F.concat_ws(" ", n["slug"], n["content_type"])), ",").alias("links"),
        T.has_block(tree, "magicItem").alias("has_item"), F.array_join(T.leaf_texts(tree), ",").alias("leaves"),
    )


@family(
    "body_text", "entry:string", "body:string first:string",
    [
        ('{"bodyIndex":"§a §b","body":{"nodeType":"text","value":"§b"}}', "§a §b", None), ('{"bodyIndex":"","body":{"nodeType":"text","value":"§b"}}', '{"nodeType":"text","value":"§b"}', None),
        ('[{"fields":{"name":"§A"}},{"fields":{"name":"second"}}]', None, "§A"), ('{"fields":{"name":"§b"}}', None, "§b"), ("[]", None, None), (None, None, None),
    ],
)
def body_text(entry):
    """An entry's index text before its rich text, and the name of the first linked entry."""
    return F.struct(P.body_text(entry).alias("body"), P.first_linked(entry, "name").alias("first"))


@family(
    "slug_names", "slug:string", "title:string army:string spaced:string bare:string",
    [
        ("grey-§bs-army-list", "Grey §Bs Army List", "grey-§bs", "grey-§bs-army-list", "§bs-army-list"), ("§a-folk-legacy-army-list", "§A Folk Legacy Army List", "§a-folk", "§a-folk-legacy-army-list", "§a-folk-legacy-army-list"),
        ("magic_§b_x", "Magic_§B_X", "magic_§b_x", "magic §b x", "magic_§b_x"), ("3rd-of-o'neil", "3Rd Of O'Neil", "3rd-of-o'neil", "3rd-of-o'neil", "3rd-of-o'neil"), ("army-list-legacy", "Army List Legacy", "army-list", "army-list-legacy", "army-list-legacy"),
        ("grey-§a", "Grey §A", "grey-§a", "grey-§a", "§a"), ("", "", "", "", ""),
    ],
)
def slug_names(slug):
    """A slug as a title, an army of a list page, underscores as spaces, and a prefix dropped."""
    return F.struct(P.name_of_slug(slug).alias("title"), P.without_suffixes(slug, "-army-list", "-legacy").alias("army"), P.spaced(slug).alias("spaced"), P.without_prefix(slug, "grey-").alias("bare"))


@family(
    "citation_split", "raw:string", "book:string page:string",
    [("§A Book, p. §n", "§A Book", "§n"), ("§B, part two, p. 3 & 9", "§B, part two", "3 & 9"), ("§A, p. 1, p. 2", "§A, p. 1", "2"), ("No §b", "No §b", None), ("", "", None)],
)
def citation_split(raw):
    """Book and page of a reference."""
    return P.citation(raw)


@family(
    "page_prefix_strip", "raw:string", "name:string",
    [("Page §n – §A", "§A"), ("page 3 - §B §a ", "§B §a"), ("Page x – §A", "Page x – §A"), ("The Page 4 - §b", "The Page 4 - §b"), ("Page 9 — §B", "§B")],
)
def page_prefix_strip(raw):
    """An erratum's rule without the page it stands on."""
    return P.without_page_prefix(raw)


@family(
    "faq_topic", "url:string", "topic:string",
    [("https://h/faq/§a-steps/", "§A Steps"), ("https://h/faq", None), ("https://h/faq/", None), ("https://h/x/faq/a-§b/c", "A §B/C"), ("https://h/rules/§b", None), ("https://h/faq/a/faq/§a-c", "§A C")],
)
def faq_topic(url):
    """Topic of a page of questions."""
    return P.faq_topic(url)


@family(
    "fallback_pages", "data:string", "waiting:boolean",
    [('{"isFallback":§t}', "§t"), ('{"isFallback":false,"props":{"name":"§a"}}', False), ("{}", False), (None, True), ('{"isFallback":"true"}', True), ("not §b", False)],
)
def fallback_pages(data):
    """Pages whose data is still to be built."""
    return P.is_fallback(data)


@family(
    "standard_bearer_parse", "raw:string", "points:bigint unlimited:boolean characters:string",
    [
        ("A single §A Lord or Old Captain (on foot) in your army may be upgraded to carry the banner (+§n points).", "§n", False, "§a-lord,old-captain"),
        ("A single Thane, King's Hand or §B-Man in your army may be upgraded. He may take a magic standard with no points limit.", None, True, "thane,king-s-hand,§b-man"),
        ("Any §b may be upgraded for +§n point", "§n", False, ""), ("An unlimited magic standard", None, True, ""),
    ],
)
def standard_bearer_parse(raw):
    """Who may carry the army's standard, at what cost and limit."""
    b = P.standard_bearer(raw)
    return F.struct(b["points"].alias("points"), b["unlimited"].alias("unlimited"), F.array_join(b["characters"], ",").alias("characters"))


@family(
    "terrain_rules", "slug:string body:string", "terrain_class:string blocks_movement:boolean disrupts_units:boolean requires_dangerous_test:boolean grants_cover:string movement_penalty:string",
    [
        ("woods", "Models count as disrupted and move at half rate; it is impassable for chariots. Soft cover.", "woods", False, True, False, "partial", "half"),
        ("tower", "A §a house.", "building", True, False, False, None, None),
        ("marsh", "This is difficult terrain. Take a Dangerous Terrain Test. Moves at half speed and gives HARD COVER.", "difficult", False, False, True, "full", "Moves at half"),
        ("lake", "§k to all.", None, "§t", False, False, None, None),
        ("grove", "A §a forest. Such units cannot claim any rank bonus. Halve their move.", "woods", False, True, False, None, "Halve"),
        ("moor", "x" * 495 + " woods", None, False, False, False, None, None),
        ("statue", "A special feature that is halfed.", "special_feature", False, False, False, None, "halfed"),
    ],
)
def terrain_rules(slug, body):
    """Class, flags, cover and penalty of a terrain."""
    return P.terrain(slug, body)


@family("wizard_level_parse", "raw:string", "level:bigint", [("§n", "§n"), ("", None), (None, None), ("0", 0), ("§b", None)])
def wizard_level_parse(raw):
    return P.wizard_level(raw)


@family(
    "page_section", "kind:string path:string next:string", "section:string name:string next_url:string",
    [
        ("the-§a-phase", "/x/y", "§bs", "the-§a-phase", "The §A Phase", "/the-§a-phase/§bs"), ("", "/moving-on/slow-march", None, "moving-on", "Moving On", None),
        (None, "/§b", "§a", "§b", "§B", "/§b/§a"), (None, "/a/§b-c/d/", "", "§b-c", "§B C", None), (None, "/", "z", "", "", None),
    ],
)
def page_section(kind, path, next):
    """Section of a rule page and the address of the page that follows."""
    s = P.section_of(kind, path)
    return F.struct(s["section"].alias("section"), s["name"].alias("name"), P.sibling_url(s["section"], next).alias("next_url"))


@family(
    "spell_casting", "value:string said:string ord:bigint lore:string", "casting_value:bigint override:string lore_number:bigint lore_id:string refers_to:string",
    [
        ("§n", None, 23, "§a-magic-lore", "§n", None, 2, "§a-magic", "casting-roll-casting-result-and-casting-value"),
        ("8", "§A §n", 100, "x", None, "§A §n", 10, "x", "casting-roll-casting-result-and-casting-value"), (None, "", None, "-lore", None, None, 0, None, None), ("0", None, 9, None, 0, None, 0, None, "casting-roll-casting-result-and-casting-value"),
    ],
)
def spell_casting(value, said, ord, lore):
    """Casting value, lore and the rule that a spell refers to."""
    c = P.casting(value, said, ord, lore)
    return F.struct(c["casting_value"].alias("casting_value"), c["override"].alias("override"), c["lore_number"].alias("lore_number"), c["lore_id"].alias("lore_id"), P.casting_edge(c).alias("refers_to"))


@family(
    "item_fields", "raw:string association:string book:string url:string", "item_type:string army:string source:string",
    [
        ("Magic Weapon", "rulebook", "Rulebook", "https://h/magic-items/x", "magic_weapon", None, "Rulebook"), ("Odd §B Kind", None, None, "https://h/magic-items/x", "odd_§b_kind", None, "Rulebook"),
        ("", "§a-folk", "§A Folk", "https://h/magic-items/x/", None, "§a-folk", "§A Folk"),
        ("Ability", "arcane-journal-empire-of-man", "§B Journal", "https://h/magic-items/y", "ability", "empire-of-man", "§B Journal"),
        ("Arcane Item", "arcane-journal-empire-of-man", "§B Journal", "https://h/magic-items/incantations-scrolls/", "arcane_item", "tomb-kings-of-khemri", "§B Journal"),
    ],
)
def item_fields(raw, association, book, url):
    """Type, army and book of an item."""
    a = P.army_and_book(association, book, url)
    return F.struct(P.item_type(raw).alias("item_type"), a["army"].alias("army"), a["book"].alias("source"))


@family(
    "slug_lookups", "slug:string", "troop:string category:string",
    [("war-beast", "war-beasts", None), ("named-character", None, "Named Characters"), ("mount", "mount", "Mounts"), ("§a-§b", "§a-§b", None), ("character", "character", "Characters"), ("swarm", "swarms", None)],
)
def slug_lookups(slug):
    """Troop type by its map, unknown slugs as they are, and the army's category."""
    from loomgraph.sources import constants as K

    return F.struct(P.troop_type(slug).alias("troop"), P.lookup(K.CATEGORY_OF, slug).alias("category"))


@family("rule_scopes", "association:string", "scope:string army:string", [("rulebook", "universal", None), ("", "universal", None), (None, "universal", None), ("§a-folk", "army", "§a-folk")])
def rule_scopes(association):
    return P.rule_scope(association)


@family(
    "troop_categories", "slug:string name:string", "category:string",
    [("monstrous-infantry", "x", "infantry"), ("monstrous-cavalry", "x", "cavalry"), ("x", "§A Monstrous §B", "monster"), ("war-machines", "§A Guns", "war_machine"), ("war-beasts", "§B Hounds", "beast"), ("light-chariots", "", "chariot"), ("§a-stones", "§A Stones", "unknown"), ("swarms", "of beasts", "swarm")],
)
def troop_categories(slug, name):
    return P.troop_category(slug, name)


@family(
    "weapon_classes", "slug:string name:string", "kind:string",
    [("shield", "Shield", "armour"), ("bolt-thrower", "Bolt Thrower", "war_machine"), ("§a-bow", "§A Bow", "missile"), ("bow-spear", "Both", "missile"), ("rainbow", "Rainbow", "equipment"), ("§a-axe", "§A Axe", "melee"), ("great-weapon", "Great Weapon", "melee"), ("tower-shield", "Tower Shield", "armour"), ("§a-thing", "§A Thing", "equipment"), ("§a-armor", "§A Armor", "armour")],
)
def weapon_classes(slug, name):
    return P.weapon_class(slug, name)


@family(
    "page_types", "path:string items:boolean", "kind:string parser:string",
    [
        ("/", False, "toc", "toc"), ("", False, "toc", "toc"), ("/sitemap/a/b", False, "sitemap", "sitemap"), ("/army/§a/reference/", False, "army_reference", "army_reference"), ("/army/§a", False, "army", "army"), ("/army/§a/x", False, None, None),
        ("/unit/§a-§b", False, "unit", "unit"), ("/faq", False, "faq", "faq"), ("/faq/§b", False, "faq", "faq"), ("/errata/", False, "errata", "errata"), ("/special-rules/§b", False, "special_rule", "special_rule"), ("/troop-types-in-detail/x", False, "troop_type", "troop_type"),
        ("/magic-items/list", True, "magic_item", "magic_item"), ("/magic-items/intro", False, "magic_item", "core_rule"), ("/the-lores-of-magic/x", False, "spell", "spell"), ("/spell/x", False, "spell_page", "spell_page"), ("/weapons-of-war/§a-§b", False, "weapon", "weapon"),
        ("/battlefield-terrain/x", False, "terrain", "terrain"), ("/§b-fight/§a", False, "core_rule", "core_rule"), ("/§a-folk/§a-army-list", False, "core_rule", "army_list"), ("/magic-item/x", False, "core_rule", "magic_item"), ("/one", False, None, None), ("/a/§b/c", False, None, None),
    ],
)
def page_types(path, items):
    """Type of a page by its path, and the parser that takes it."""
    kind = C.page_type(path)
    return F.struct(kind.alias("kind"), C.page_parser(kind, path, items).alias("parser"))


@family(
    "page_classes", "path:string", "label:string",
    [("/overview-of-the-game/§a", "Document"), ("/matched-play/gather-your-allies", "Document"), ("/matched-play/gather-your-allies/§a", "Document"), ("/matched-play/§b", "CoreRule"), ("/", "CoreRule"), ("/overview-of-the-game", "Document"), ("/gather-your-allies", "CoreRule")],
)
def page_classes(path):
    return P.page_class(path)


@family(
    "mount_profiles", "m:string t:string w:string", "mount:boolean",
    [("§n", "-", "-", True), ("§n", None, "", True), ("§n", "3", "-", False), ("-", "-", "-", False), (None, None, None, False), ("§n", "-", "2", False)],
)
def mount_profiles(m, t, w):
    return P.is_mount_profile(m, t, w)


@family(
    "name_gates", "id:string name:string", "scannable:boolean found:boolean label:string",
    [("fear", "Fear", False, False, "Unit"), ("a-b", "A b", True, False, "Unit"), ("grey-lord", "§A Other", True, True, "Unit"), ("x", "GREY lord", True, True, "Unit"), ("Grey Lord", "x", False, True, "Unit"), ("§b", "§A §B §n", True, False, "Unit")],
)
def name_gates(id, name):
    """Names long enough to be sought, a node by id, slug or name, and a label that is allowed."""
    return F.struct(P.scannable(name).alias("scannable"), P.identified(id, name, "Grey Lord").alias("found"), P.allowed(F.concat(F.lit("Un"), F.substring(F.lit("it"), 1, 2)), ["Unit", "Army"]).alias("label"))


@family(
    "fallback_rule_lines", "raw:string", "slugs:string",
    [("§A Rule\n  §B rule \n\n§A Rule", "§a-rule,§b-rule"), ("One\r\nTwo's (X)", "one,two-s-x"), ("", ""), (" A ", "a")],
)
def fallback_rule_lines(raw):
    """Rules named line by line where no link says them."""
    return F.array_join(P.rule_lines(raw), ",")


@family(
    "content_parts", "raw:string", "text:string reasoning:string cited:string",
    [
        ('"just §a §n"', "just §a §n", "", ""), ('{"type":"text","text":"a"}', "a", "", ""), ('{"type":"tool_use","text":"a"}', "", "", ""),
        ('[{"type":"thinking","thinking":"§b"},{"type":"text","text":"b"},{"type":"text_delta","delta":"c"},"d"]', "bcd", "§b", ""),
        ('[{"type":"text","text":"x","citations":[{"type":"search_result_location","search_result_index":§n},{"type":"other","search_result_index":1},{"type":"search_result_location","search_result_index":0},{"type":"search_result_location","search_result_index":§n}]}]', "x", "", "0,§n"),
        ('[{"type":"reasoning","reasoning":"§A"},{"type":"reasoning","thinking":"r2"}]', "", "§Ar2", ""), ("[]", "", "", ""), (None, "", "", ""),
    ],
)
def content_parts(raw):
    """Text, reasoning and cited places of a message's content."""
    c = P.content(raw)
    return F.struct(F.coalesce(c["text"], F.lit("")).alias("text"), F.coalesce(c["reasoning"], F.lit("")).alias("reasoning"), F.coalesce(F.array_join(c["cited"].cast("array<string>"), ","), F.lit("")).alias("cited"))


@family(
    "lenient_nodes", "raw:string", "id:string name:string page:bigint",
    [('{"id":"§a-§b","name":null,"page":§n}', "§a-§b", None, "§n"), ('{"id":"b","page":"§b","name":"§A"}', "b", "§A", None), ("§a", None, None, None), ('{"other":1}', None, None, None), ('{"id":"c","extra":{"x":1}}', "c", None, None)],
)
def lenient_nodes(raw):
    """A node read leniently: what is missing or of a wrong type is null."""
    return P.graph_node(raw)


@family("retrieval_modes", "mode:string", "strategy:string lexical:boolean expand:boolean", [("vector", "vector", False, False), ("§g", "§v", "§t", True), ("hybrid", "hybrid", False, True), (None, "vector", True, True), ("", "vector", True, True)])
def retrieval_modes(mode):
    return P.mode_config(mode)


@family(
    "absolute_links", "link:string base:string", "url:string slug:string",
    [
        ("/§b/c/#x", "https://H.example/a/d?q=1", "https://h.example/§b/c", "c"), ("§a", "https://h.example/a/d", "https://h.example/a/§a", "§a"), ("../§b/", "https://h.example/a/b/d", "https://h.example/a/§b", "§b"),
        ("HTTP://Other.Example/P/?x=1#y", "https://h.example/a", "http://other.example/P?x=1", "P"), ("//cdn.example/z", "https://h.example/a", "https://cdn.example/z", "z"), ("#part", "https://h.example/a/d?q=1", "https://h.example/a/d?q=1", "d"),
        ("?page=§n", "https://h.example/a/d?q=1", "https://h.example/a/d?page=§n", "d"), ("/", "https://h.example/a/d", "https://h.example/", "unknown"), ("./g", "https://h.example", "https://h.example/g", "g"), ("../../../h", "https://h.example/a/b", "https://h.example/h", "h"),
    ],
)
def absolute_links(link, base):
    """A link as its page means it, and its slug with the parser's name for the root."""
    url = X.absolute_url(link, base)
    return F.struct(url.alias("url"), X.url_slug(url, "unknown").alias("slug"))


@family(
    "rule_phrases", "raw:string", "points:bigint unit:string budget:bigint most:bigint least:bigint count:bigint per:bigint version:string alliance:string",
    [
        ("Take up to §n points", None, None, "§n", None, None, None, None, None, "trusted"), ("It costs 5 points", None, None, None, None, None, None, None, None, "trusted"), ("( +§n Points per Model )", "§n", "per_model", None, None, None, None, None, None, "trusted"),
        ("Up to §n% of the points\nAt least 50% later", None, None, None, "§n", None, None, None, None, "trusted"), ("At least §n % of it", None, None, None, None, "§n", None, None, None, "trusted"), ("0-2 §A Guns per 1,000 points", None, None, None, None, None, 2, 1000, None, "trusted"),
        ("Book - VERSION 1.5.§n", None, None, None, None, None, None, None, "1.5.§n", "trusted"), ("§A Folk ( Uneasy )", None, None, None, None, None, None, None, None, "uneasy"), ("A suspicious §b", None, None, None, None, None, None, None, None, "trusted"), ("0-1 (in all), per 1,000 points", None, None, None, None, None, None, None, None, "trusted"),
    ],
)
def rule_phrases(raw):
    """Costs, budgets, limits, versions and alliances as rule texts state them, and where they only seem to."""
    cost, share, per = X.points_cost(raw), X.percent_limits(raw), X.per_points_limit(raw)
    return F.struct(
        cost["points"].alias("points"), cost["unit"].alias("unit"), X.points_budget(raw).alias("budget"), share["max"].alias("most"), share["min"].alias("least"),
        per["max_count"].alias("count"), per["per_points"].alias("per"), X.document_version(raw)["version"].alias("version"), X.alliance_type(raw).alias("alliance"),
    )


_TABLE = '<table class="profile-table profile-table--weapon"><tbody><tr><td>§n"</td><td>S+1</td><td>–</td><td><a href="/special-rules/§a/">Slow</a>, <a href="/x/y">no</a><a href="/special-rules/loud">Loud</a></td></tr><tr><td>9</td></tr></tbody></table>'
_CRUMBS = (
    '<div class="breadcrumb__wrapper"><ul class="breadcrumb"><li class="breadcrumb-link"><a href="/a">§A</a></li><li class="breadcrumb-link">Folk</li></ul>'
    '<ul class="breadcrumb"><li class="update-timestamp">Last update: <!-- -->2024 May 2</li><li class="page-reference">Grey Book, p. <!-- -->§n &amp; 9</li></ul></div>'
)


@family(
    "html_fields", "html:string", "weapon:string rules:string spell:string crumbs:string book:string page:string updated:string",
    [
        (_TABLE, '§n",S+1,', "§a,loud", None, "", None, None, None), ("<table class='profile-table--weapon'><tbody><tr><td>§n</td></tr></tbody></table>", ",,", "", None, "", None, None, None),
        ('<div class="spell big"><table><tr><td>Range</td><td>9</td></tr><tr><td> Type </td><td><a href="/magic/hex">§B</a></td></tr></table></div>', ",,", "", "§B", "", None, None, None),
        ('<div class="spell"><table><tr><td>Type</td><td>Bound</td></tr></table></div>', ",,", "", None, "", None, None, None), (_CRUMBS, ",,", "", None, "§A>Folk", "Grey Book", "§n & 9", "2024 May 2"), ("", ",,", "", None, "", None, None, None),
    ], dealt=True,
)
def html_fields(html):
    """A weapon's profile, a spell's type, and what a page's breadcrumbs say."""
    page = M.page_fields(html)
    w, b = page["weapon"], page["crumbs"]
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(
        F.concat_ws(",", blank(w["range"]), blank(w["strength"]), blank(w["ap"])).alias("weapon"), F.array_join(w["special_rules"], ",").alias("rules"), page["spell"].alias("spell"),
        F.array_join(b["path"], ">").alias("crumbs"), b["book"].alias("book"), b["page"].alias("page"), b["updated"].alias("updated"),
    )


@family(
    "markdown_links", "html:string", "md:string",
    [
        ('<p>§A <a href="/rules/fear#top">Fear</a><a href="/rules/awe">Awe</a></p>', "§A [Fear](../rules/fear.md#top) [Awe](https://h.example/rules/awe)"),
        ('<p><a href="https://h.example/rules/fear">F</a> and <a href="https://other.example/z">Z</a></p>', "[F](../rules/fear.md) and [Z](https://other.example/z)"),
        ('<article class="section-intro"><p>§B.</p><p>Two.</p></article><p>§A three.</p>', "*§B.*\n\n*Two.*\n\n§A three."), ('<p>§a b</p><div class="ad">no</div>', "§a b"), ("<h2>§B</h2><ul><li>x</li><li><b>y</b><i>z</i></li></ul>", "## §B\n\n- x\n- **y** *z*"),
    ],
)
def markdown_links(html):
    """Markdown with links to known pages as relative files, introductions emphasised, neighbours kept apart."""
    return M.rewritten({"/rules/fear": "rules/fear.md"}, "https://h.example")(html, F.lit("units/lord.md"))
