"""Pattern matching and bounded traversal over node and edge DataFrames."""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.constants import UNIVERSAL_ARMIES
from loomgraph.sources.tables import undirected, written

#: Relation tiers, best first, and how many neighbours of a relation a seed may show.
TIERS = {"IN_REGION": 1, "IN_NATION": 1, "PLACED_BY": 2, "SUPPLIED_BY": 2, "CONTAINS": 3}
CAPS = {"CONTAINS": 3, "SUPPLIED_BY": 5, "PLACED_BY": 20}
DEFAULT_CAP = 4
SEED_CAP = 40
#: Shares of a table that meets rows which fit everything.
SPREAD = 64


def _case(values: dict[str, int], of: Column, default: int) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(of == k, v).otherwise(out)
    return out


def expand(edges: DataFrame, seeds: DataFrame, per_seed: int = SEED_CAP) -> DataFrame:
    """One undirected hop from ``seeds(seed_id)`` to nodes that are no seeds, capped by relation and then by seed.

    Two window limits in a row; both push down as group limits before the shuffle.
    """
    return capped(undirected(edges.where(F.col("relation").isin(*TIERS))).join(seeds, F.col("node") == F.col("seed_id")), seeds, per_seed)


def capped(near: DataFrame, seeds: DataFrame, per_seed: int) -> DataFrame:
    """Neighbours (seed_id, relation, other) that are no seeds, within the caps."""
    near = near.join(seeds.select(F.col("seed_id").alias("_s")), F.col("other") == F.col("_s"), "left_anti")
    near = near.select("seed_id", F.col("relation").alias("rel_type"), F.col("other").alias("id")).withColumn("tier", _case(TIERS, F.col("rel_type"), 9))
    by_type = Window.partitionBy("seed_id", "rel_type").orderBy("tier", "id")
    near = near.withColumn("_n", F.row_number().over(by_type)).where(F.col("_n") <= _case(CAPS, F.col("rel_type"), DEFAULT_CAP))
    by_seed = Window.partitionBy("seed_id").orderBy("tier", "id", "rel_type")
    return near.withColumn("place", F.row_number().over(by_seed)).where(F.col("place") <= per_seed).drop("_n")


def links_between(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges with both ends among the seeds, one per unordered pair and relation."""
    s = seeds.select("seed_id")
    inside = edges.join(s, F.col("src") == F.col("seed_id"), "left_semi").join(s, F.col("dst") == F.col("seed_id"), "left_semi").where("src <> dst")
    pair = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst"), "relation").orderBy("src", "dst")
    return inside.withColumn("_n", F.row_number().over(pair)).where("_n = 1").drop("_n")


def hops(edges: DataFrame, centers: DataFrame, depth: int) -> DataFrame:
    """Least number of undirected hops, up to ``depth``, from each of ``centers(center)`` to the nodes it reaches.

    Level by level: each frontier is written, joined to the edges and stripped of
    what is known, so a level shuffles the frontier only and plans do not grow.
    """
    pairs = undirected(edges).select("node", "other")
    front = written(centers.select("center", F.col("center").alias("id"), F.lit(0).alias("distance")), "hops")
    known = front
    for level in range(1, depth + 1):
        step = front.join(pairs, F.col("id") == F.col("node")).select("center", F.col("other").alias("id")).distinct()
        front = written(step.join(known.select("center", "id"), ["center", "id"], "left_anti").withColumn("distance", F.lit(level)), "hops")
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known


def subgraph(edges: DataFrame, centers: DataFrame, depth: int = 2, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` hops (all, or the nearest ``most`` a center) and every directed edge among them."""
    near = nearest(hops(edges, centers, depth), most)
    ends = near.select("center", "id")
    among = edges.select("src", "dst", "relation").distinct()
    among = among.join(ends.withColumnRenamed("id", "src"), "src").join(ends.withColumnRenamed("id", "dst"), ["center", "dst"])
    return near, among.select("center", "src", "dst", "relation")


def nearest(reached: DataFrame, most: int | None) -> DataFrame:
    """The ``most`` rows of each center that are nearest, ties by id; all of them for none."""
    if most is None:
        return reached
    order = Window.partitionBy("center").orderBy("distance", "id")
    return reached.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def capped_bfs(links: DataFrame) -> DataFrame:
    """Edges of each center's subgraph that stay under the caps while every kept node stays reachable.

    A sweep level by level, each frontier in sorted order: a node claims new
    neighbours by tier and id while it has room for the relation.  Then the other
    edges among kept nodes are added by tier and ends while both ends have room,
    the claimed edges counting at both.  Order matters, so a center's edges (at
    most those among 150 nodes) are handled together.
    """

    def one(center: str, rows: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
        rows = sorted(set(rows), key=lambda r: (TIERS.get(r[2], 99), r))
        beside: dict[str, list[tuple[int, str, tuple[str, str, str]]]] = defaultdict(list)
        for r in rows:
            beside[r[0]].append((TIERS.get(r[2], 99), r[1], r))
            beside[r[1]].append((TIERS.get(r[2], 99), r[0], r))
        cap = lambda rel: CAPS.get(rel, DEFAULT_CAP)
        seen, frontier, taken = {center}, [center], []
        while frontier:
            found = []
            for at in sorted(frontier):
                used: Counter = Counter()
                for _, to, r in sorted(beside[at]):
                    if to not in seen and used[r[2]] < cap(r[2]):
                        used[r[2]] += 1
                        seen.add(to)
                        taken.append(r)
                        found.append(to)
            frontier = found
        total = Counter((n, r[2]) for r in taken for n in r[:2])
        claimed = set(taken)
        for r in rows:
            if r not in claimed and r[0] in seen and r[1] in seen and all(total[n, r[2]] < cap(r[2]) for n in r[:2]):
                total.update((n, r[2]) for n in {r[0], r[1]})
                taken.append(r)
        return taken

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(frame["src"], frame["dst"], frame["relation"]))
        return pd.DataFrame([(key[0], *r) for r in one(key[0], rows)], columns=["center", "src", "dst", "relation"])

    return links.groupBy("center").applyInPandas(run, "center string, src string, dst string, relation string")


def shortest_route(edges: DataFrame, pairs: DataFrame, most: int = 4) -> DataFrame:
    """``shortest_path`` with the nodes on the way; of several routes the least in the order of node ids from ``b`` back.

    Both ends are walked half way, each reached node with the least way to its
    center in either direction; a route is put together at the node where ways
    meet, so edges are read for each level of half the length and no more.
    ``edges`` may hold copies and need no more than their ends.
    """
    half = (most + 1) // 2
    links = undirected(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")).select("node", "other")
    # forth: the nodes from the center on; back: those to the center; both without the node itself
    none = F.array().cast("array<string>")
    ends = pairs.select(F.col("a").alias("center")).union(pairs.select("b")).distinct()
    front = written(ends.select("center", F.col("center").alias("id"), F.lit(0).alias("distance"), none.alias("forth"), none.alias("back")), "routes")
    found = front
    for level in range(1, half + 1):
        step = front.join(links, F.col("id") == F.col("node")).join(found.select("center", F.col("id").alias("other")), ["center", "other"], "left_anti")
        ways = F.min(F.concat("forth", F.array("id"))).alias("forth"), F.min(F.concat(F.array("id"), "back")).alias("back")
        front = written(step.groupBy("center", F.col("other").alias("id")).agg(F.lit(level).alias("distance"), *ways), "routes")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    here, there = found.select("center", "id", "distance", "back"), found.select("center", "id", "distance", "forth").toDF("_c", "_id", "_d", "forth")
    met = pairs.distinct().join(here, F.col("a") == F.col("center")).join(there, (F.col("b") == F.col("_c")) & (F.col("id") == F.col("_id")))
    # of the nodes of a shortest route one is half way from a, or is b
    route = F.struct((F.col("distance") + F.col("_d")).alias("hops"), (-F.col("distance")).alias("_at"), F.concat("forth", F.array("id"), "back").alias("way"))
    least = met.where(F.col("distance") + F.col("_d") <= most).groupBy("a", "b").agg(F.min(route).alias("_r"))
    return pairs.join(least, ["a", "b"], "left").select("a", "b", F.col("_r.hops").cast("bigint").alias("hops"), F.array_join(F.reverse("_r.way"), ">").alias("route"))


def shortest_path(edges: DataFrame, pairs: DataFrame, most: int = 4) -> DataFrame:
    """Length of the shortest undirected path of up to ``most`` hops between ``pairs(a, b)``; null where there is none.

    Both ends are walked half way, and paths meet at a node that both have reached.
    """
    ends = pairs.select(F.col("a").alias("center")).union(pairs.select("b")).distinct()
    return meeting(pairs, hops(edges, ends, (most + 1) // 2), most)


def meeting(pairs: DataFrame, reached: DataFrame, most: int) -> DataFrame:
    """Hops between ``pairs(a, b)`` by way of a node that both have ``reached(center, id, distance)``."""
    near = reached.select("center", "id", "distance")
    there = near.toDF("_c", "_id", "_d")
    met = pairs.distinct().join(near, F.col("a") == F.col("center")).join(there, (F.col("b") == F.col("_c")) & (F.col("id") == F.col("_id")))
    least = met.groupBy("a", "b").agg(F.min(F.col("distance") + F.col("_d")).alias("hops")).where(F.col("hops") <= most)
    return pairs.join(least, ["a", "b"], "left").select("a", "b", F.col("hops").cast("bigint").alias("hops"))


def variable_length(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Directed trails of one or two edges from ``start(src)``, no edge twice."""
    e = edges.select("src", "dst", "relation")
    one = e.join(start, "src", "left_semi").withColumn("length", F.lit(1))
    second = e.select(F.col("src").alias("_m"), F.col("dst").alias("_end"), F.col("relation").alias("_r"))
    two = one.join(second, F.col("dst") == F.col("_m")).where(~((F.col("src") == F.col("_m")) & (F.col("dst") == F.col("_end")) & (F.col("relation") == F.col("_r"))))
    return one.select("src", F.col("dst").alias("end"), "length").unionByName(two.select("src", F.col("_end").alias("end"), F.lit(2).alias("length")))


def radial_layout(distances: DataFrame) -> DataFrame:
    """x, y of every node: rings by distance, wide enough for their nodes, turned a little ring by ring."""
    ring = Window.partitionBy("center", "distance")
    i = F.row_number().over(ring.orderBy("id")) - 1
    n = F.count(F.lit(1)).over(ring)
    radius = F.when(F.col("distance") == 0, 0.0).otherwise(F.greatest(F.col("distance") * 260.0, n * 170.0 / (2 * F.pi())))
    angle = F.col("distance") * F.pi() / 7 + 2 * F.pi() * i / n
    return distances.select("center", "id", "distance", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def merge_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """Upsert by key: the columns that ``new`` has overwrite, a null clearing the value; the others stay.

    Of rows of ``new`` with equal keys the last by ``order`` counts.
    """
    given = [c for c in columns if c in new.columns]
    if order is not None:
        new = last_wins(new.select(key, *given, order), [key], order)
    joined = old.alias("o").join(new.select(key, *given, F.lit(True).alias("_is")).alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    pick = lambda c: F.when(F.col("n._is"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in given else F.col(f"o.{c}").alias(c)
    return joined.select(F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key), *[pick(c) for c in columns])


def fill_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``old`` with the values that ``new`` has for their key; a null of ``new`` never overwrites."""
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "left")
    value = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in columns else F.col(f"o.{c}")
    return joined.select(*[value(c).alias(c) for c in old.columns])


def _passes(units: DataFrame, upgrades: DataFrame, items: DataFrame) -> list[tuple[int, DataFrame, DataFrame, bool]]:
    """The three passes of eligibility: number, units with their best upgrade, items with their class, whether the unit's own army alone counts.

    Items for all armies have a null class.
    """
    own = units.select("unit", F.col("army").alias("_army"), "wizard_level")
    kind = F.col("upgrade_type")
    wide = items.withColumn("_class", F.when(~F.col("army").isin(*UNIVERSAL_ARMIES), F.col("army"))).select("item", "item_type", "_class")
    passes = [
        (0, kind.isin("magic_item_budget", "command_bsb"), F.col("points_budget"), "item_type NOT IN ('magic_standard', 'ability')", False),
        (
            1, ((kind == "magic_standard_budget") & F.col("points_budget").isNotNull()) | ((kind == "command_standard") & F.col("magic_standard_budget").isNotNull()) | ((kind == "command_bsb") & F.col("unlimited")),
            F.coalesce("points_budget", "magic_standard_budget"), "item_type = 'magic_standard'", False,
        ),
        (2, kind.isin("vampiric_powers_budget", "rune_budget"), F.col("points_budget"), "item_type = 'ability'", True),
    ]
    found = []
    for n, wanted, budget, which, army_only in passes:
        # of a unit's upgrades the best alone makes its edges, so no other one meets the items
        unlimited = (kind == "command_bsb") & F.coalesce("unlimited", F.lit(False)) if n < 2 else F.lit(False)
        best = upgrades.where(wanted).groupBy("unit").agg(F.min(F.struct(budget.isNull().alias("no"), "ord", F.col("upgrade").alias("via"), budget.alias("budget"), unlimited.alias("unlimited"))).alias("b"))
        able = own.hint("merge").join(best, "unit").select("unit", "_army", "wizard_level", "b.budget", "b.unlimited", "b.via")
        found.append((n, able, wide.where(which), army_only))
    return found


def eligible(units: DataFrame, upgrades: DataFrame, items: DataFrame) -> DataFrame:
    """unit, item, budget, unlimited, via: the items that units can take, in three passes; the first pass and the best upgrade make the edge.

    ``units(unit, army, wizard_level)``, ``upgrades(upgrade, unit, upgrade_type,
    points_budget, magic_standard_budget, unlimited, ord)``, ``items(item,
    item_type, army)``.  Items of one army meet its units by an equi-join dealt
    in ``SPREAD`` shares of the units; those for all armies, kept apart by
    ``universal_or_equal``, have a null class.  The edges are units times items:
    what asks for sums or for items alone takes ``eligible_sums`` or ``reachable``.
    """
    found = None
    for n, able, some, army_only in _passes(units, upgrades, items):
        met = dealt(able, some, "_army", "_class", many=True) if army_only else universal_or_equal(able, some, "_army", "_class", many=True)
        met = met.where("item_type <> 'arcane_item' OR coalesce(wizard_level, 0) >= 1").select("unit", "item", F.lit(n).alias("pass"), "budget", "unlimited", "via")
        found = met if found is None else found.unionByName(met)
    return found


def eligible_sums(units: DataFrame, upgrades: DataFrame, items: DataFrame) -> DataFrame:
    """unit, pass, via, budget, unlimited, n, first_item: the edges of ``eligible`` counted; items are summed by class before they meet units."""
    found = None
    for n, able, some, army_only in _passes(units, upgrades, items):
        kinds = some.groupBy("_class", (F.col("item_type") == "arcane_item").alias("_arcane")).agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("first_item"))
        met = able.join(kinds.where("_class IS NOT NULL"), F.col("_army") == F.col("_class")) if army_only else universal_or_equal(able, kinds, "_army", "_class")
        met = met.where("NOT _arcane OR coalesce(wizard_level, 0) >= 1").select("unit", F.lit(n).alias("pass"), "via", "budget", "unlimited", "n", "first_item")
        found = met if found is None else found.unionByName(met)
    return found.groupBy("unit", "pass", "via", "budget", "unlimited").agg(F.sum("n").alias("n"), F.min("first_item").alias("first_item"))


def reachable(units: DataFrame, upgrades: DataFrame, items: DataFrame) -> DataFrame:
    """item: those that some unit can take, by the armies that have such a unit; no unit meets an item."""
    found = None
    for _, able, some, army_only in _passes(units, upgrades, items):
        armies = able.groupBy("_army").agg(F.max(F.coalesce("wizard_level", F.lit(0)) >= 1).alias("_wizard"))
        met = some.where("_class IS NOT NULL").join(armies, F.col("_class") == F.col("_army")).select("item", "item_type", "_wizard")
        if not army_only:
            any_ = armies.agg(F.max("_wizard").alias("_wizard")).where("_wizard IS NOT NULL")  # one row, none where no unit is able
            met = met.unionByName(some.where("_class IS NULL").crossJoin(F.broadcast(any_)).select("item", "item_type", "_wizard"))
        met = met.where("item_type <> 'arcane_item' OR _wizard").select("item")
        found = met if found is None else found.unionByName(met)
    return found


def merge_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose ends both exist, the first of each (src, relation, dst)."""
    known = edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
    first = known.groupBy("src", "relation", "dst").agg(F.min_by(F.struct("quantity", "seq"), "seq").alias("p"))
    return first.select("src", "relation", "dst", F.col("p.quantity").alias("quantity"))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; partial maxima combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return kept.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return kept.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def universal_or_equal(left: DataFrame, right: DataFrame, left_key: str, right_key: str, many: bool = False) -> DataFrame:
    """``right_key IS NULL OR left_key = right_key`` as two equi-joins, not a nested loop.

    Rows of the right that fit everything stand in each of ``SPREAD`` shares of the
    left, so no key takes the whole of it; where they are few they broadcast and
    the left stays where it is.  ``many``: as in ``dealt``.
    """
    fitting = dealt(left, right, left_key, right_key, many)
    general = _met(left, right.where(F.col(right_key).isNull()), [], [], many)
    return fitting.unionByName(general)


def dealt(left: DataFrame, right: DataFrame, left_key: str, right_key: str, many: bool = False) -> DataFrame:
    """Equi-join in which a key's rows of the left are dealt into ``SPREAD`` shares, so no key takes one task.

    ``many``: rows of the right are many.  The planner sees the size of their
    files and not that they stand in every share, so it would broadcast them and
    deal what they make, which is far more than what it reads, to few tasks;
    instead both sides are shuffled into ``SPREAD`` tasks, where a share of the
    left is held while rows of the right pass.
    """
    return _met(left, right.where(F.col(right_key).isNotNull()), [left_key], [right_key], many)


def _met(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], many: bool) -> DataFrame:
    left, right = _shared(left), _spread(right).withColumnRenamed("_share", "_of")
    on = F.col("_share") == F.col("_of")
    for a, b in zip(left_keys, right_keys):
        on &= F.col(a) == F.col(b)
    if many:
        left, right = right.repartition(SPREAD, "_of", *right_keys).hint("merge"), left.repartition(SPREAD, "_share", *left_keys)
    return left.join(right, on).drop("_share", "_of")


def _shared(left: DataFrame) -> DataFrame:
    return left.withColumn("_share", F.pmod(F.xxhash64(*left.columns), F.lit(SPREAD)).cast("int"))


def _spread(right: DataFrame) -> DataFrame:
    return right.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
