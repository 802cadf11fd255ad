"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over blocks.

Native: DataFrame functions only.  Documents fall by hash into blocks, at least
``BLOCKS`` a source and ``SHARE`` for each output shard, whatever their number.
A source's target (its weight's share of all words, at most
``MOST`` times its own, the excess shared again by weight) becomes a list of
block draws: whole passes over all its blocks, then a permuted prefix.  The
exact draw counts of all sources are split down a binary tree: at each node the
left half of the shards gets half of the node's draws, sampled from the
multivariate hypergeometric distribution by one conditional draw per source, so
quotas stay exact.  A shard then takes the next run of its count from each
source's permuted list; runs are disjoint.  Inside a shard rows are ordered by
a seeded hash.  Running sums along a permuted list are made in two steps, over
``SLOTS`` slots of the list and within each, so no window holds a whole source.

The last block of the prefix is filled document by document and its last
document is cut to the words that the target still wants, so a source's words
differ from its target by less than one.  All draws follow from hashes, so
reruns agree.

Defined cases: null text has size 0 and is never drawn; a null source is a
source of its own, ordered last; repeated rows count as often as they occur;
null doc_ids are allowed; an empty table gives an empty result; extra columns
are ignored.  One row per source comes together in a window and in the tree's
arrays: the number of sources is taken to be small, their rows are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import common

WORD = r"[^\x20\x09-\x0D]+"
BLOCKS = 4096
#: Blocks of a source for each shard, at least.
SHARE = 64
#: log2 of the slots of a permuted list.
SLOT_BITS = 10
#: Levels of the tree that one plan holds; the nodes are written between.
LEVELS = 4
MOST = 3
SHARD_WORDS = 4_000_000
SEED = 20_240_917
#: Half-width, in standard deviations, of the hypergeometric range that is summed; what lies beyond is below double precision.
REACH = 9


def _hash(*parts: Column | int | str) -> Column:
    return F.xxhash64(F.lit(SEED), *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _uniform(*parts: Column | int | str) -> Column:
    return (F.shiftrightunsigned(_hash(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def sizes(documents: DataFrame, carried: Column | None = None) -> DataFrame:
    """doc_id, source, its sortable key (null last) and words of every document, and ``_row`` if anything is carried."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    row = [] if carried is None else [carried.alias("_row")]
    return documents.select("doc_id", "source", key.alias("_source"), words.alias("size"), *row)


def in_blocks(sized: DataFrame, levels: int) -> DataFrame:
    """``sized`` with the block of each document."""
    return sized.withColumn("_block", F.pmod(_hash("block", F.col("doc_id"), F.col("size")), F.lit(max(BLOCKS, SHARE << levels)).cast("long")))


def targets(sized: DataFrame) -> DataFrame:
    """Per source: its words and its target; weights 1, 2, 3 repeat in source order."""
    per = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("_source")
    per = per.withColumn("_at", F.row_number().over(order) - 1).withColumn("_weight", (F.col("_at") % 3 + 1).cast("double"))
    fill = Window.orderBy(MOST * F.col("source_size") / F.col("_weight"), "_at")
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - MOST * F.coalesce(F.sum("source_size").over(upto), F.lit(0))
    weight = F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(upto), F.lit(0.0))
    per = per.withColumn("_level", left / weight)
    # the level rises while sources are capped and falls after, so the fill level is its maximum
    level = F.max("_level").over(whole)
    return per.withColumn("target", F.least((MOST * F.col("source_size")).cast("double"), level * F.col("_weight"))).drop("_level")


def _hypergeometric(good: Column, population: Column, drawn: Column, u: Column) -> Column:
    """How many of ``good`` are among ``drawn`` of ``population``, by inversion of the distribution at ``u``."""
    g, n, k = good.cast("double"), population.cast("double"), drawn.cast("double")
    mean = k * g / F.greatest(n, F.lit(1.0))
    spread = F.sqrt(F.greatest(mean * (1 - g / F.greatest(n, F.lit(1.0))) * (n - k) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))
    low = F.greatest(F.lit(0), drawn - (population - good), F.floor(mean - REACH * spread - 2)).cast("long")
    high = F.least(good, drawn, F.ceil(mean + REACH * spread + 2)).cast("long")

    def after(w: Column, x: Column) -> Column:
        """The weight of x + 1 from that of x."""
        return w * (g - x) * (k - x) / ((x + 1) * F.greatest(n - g - k + x + 1, F.lit(0.5)))

    steps = F.sequence(low, F.greatest(low, high))
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    total = F.aggregate(steps, start, lambda s, x: F.struct(after(s["w"], x.cast("double")).alias("w"), (s["sum"] + s["w"]).alias("sum")), lambda s: s["sum"])
    begin = F.struct(F.lit(1.0).alias("w"), (u * total).alias("want"), F.lit(-1).cast("long").alias("pick"))

    def step(s: Column, x: Column) -> Column:
        want = s["want"] - s["w"]
        pick = F.when((s["pick"] < 0) & (want <= 0), x).otherwise(s["pick"])
        return F.struct(after(s["w"], x.cast("double")).alias("w"), want.alias("want"), pick.alias("pick"))

    return F.aggregate(steps, begin, step, lambda s: F.when(s["pick"] < 0, F.greatest(low, high)).otherwise(s["pick"]))


def splitting_tree(quotas: DataFrame, levels: int) -> DataFrame:
    """From one row with ``quotas`` (draws of each source) to 2^levels rows ``shard, quotas, starts``.

    The counts of a source sum to its quota; ``starts`` says where the shard's
    run begins in each source's list.
    """
    nodes = quotas.select(F.lit(0).cast("long").alias("shard"), "quotas", F.transform("quotas", lambda q: q * 0).alias("starts"))
    for level in range(levels):
        if level and level % LEVELS == 0:
            nodes = common.written(nodes, "mix-tree")
        sum_of = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
        start = F.struct(
            sum_of(F.col("quotas")).alias("population"),
            F.floor(sum_of(F.col("quotas")) / 2).cast("long").alias("drawn"),
            F.array().cast("array<bigint>").alias("left"),
        )

        def step(s: Column, q: Column) -> Column:
            got = _hypergeometric(q, s["population"], s["drawn"], _uniform("tree", level, F.col("shard"), F.size(s["left"])))
            # the sampled count is held in an array of one so that it is worked out once
            return F.element_at(
                F.transform(
                    F.array(got),
                    lambda x: F.struct((s["population"] - q).alias("population"), (s["drawn"] - x).alias("drawn"), F.array_append(s["left"], x).alias("left")),
                ),
                1,
            )

        nodes = nodes.withColumn("_left", F.aggregate("quotas", start, step, lambda s: s["left"]))
        halves = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("_left").alias("quotas"), F.col("starts")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), F.zip_with("quotas", "_left", lambda q, x: q - x).alias("quotas"), F.zip_with("starts", "_left", lambda t, x: t + x).alias("starts")),
        )
        nodes = nodes.select(F.explode(halves).alias("n")).select("n.shard", "n.quotas", "n.starts")
    return nodes


def block_draws(blocked: DataFrame, levels: int) -> DataFrame:
    """Per source and block: target columns and its draws (pass, shard, words it may give; null: all), null if none."""
    per = common.written(targets(blocked), "mix-targets")
    blocks = blocked.groupBy("_source", "_block").agg(F.sum("size").alias("_words"))
    blocks = common.written(blocks.join(per, "_source"), "mix-blocks")
    size = F.greatest("source_size", F.lit(1))
    want = F.round("target").cast("long")
    each = blocks.where("_words > 0").withColumn("_full", F.floor(want / size).cast("int")).withColumn("_rest", want - F.col("_full") * size)
    each = each.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("_full"))))
    each = each.withColumn("_order", _hash("order", F.col("_source"), F.col("_pass"), F.col("_block")))
    each = each.withColumn("_slot", F.shiftrightunsigned("_order", 64 - SLOT_BITS))
    # running words and ranks along each permuted list: of the slots before, then inside the slot
    slots = each.groupBy("_source", "_pass", "_slot").agg(F.sum("_words").alias("_w"), F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_source", "_pass").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    ranks = Window.partitionBy("_source").orderBy("_pass", "_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("_source", "_pass", "_slot", F.coalesce(F.sum("_w").over(upto), F.lit(0)).alias("_w"), F.coalesce(F.sum("_n").over(ranks), F.lit(0)).alias("_n"))
    inside = Window.partitionBy("_source", "_pass", "_slot").orderBy("_order", "_block")
    drawn = each.join(slots, ["_source", "_pass", "_slot"])
    drawn = drawn.withColumn("_before", F.col("_w") + F.coalesce(F.sum("_words").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a pass but the last takes all its blocks, the last a prefix, so the ranks of what is drawn follow each other
    drawn = drawn.withColumn("_nth", F.col("_n") + F.row_number().over(inside) - 1)
    drawn = drawn.where((F.col("_pass") < F.col("_full")) | (F.col("_before") < F.col("_rest")))
    drawn = drawn.withColumn("_limit", F.when(F.col("_pass") == F.col("_full"), F.col("_rest") - F.col("_before")))
    drawn = common.written(drawn.select("_source", "_at", "_block", "_pass", "_nth", "_limit"), "mix-draws")
    counts = drawn.groupBy("_at").agg(F.count(F.lit(1)).alias("n"))
    quotas = counts.agg(F.sort_array(F.collect_list(F.struct("_at", "n"))).alias("q"))
    quotas = common.written(quotas.select(F.transform("q", lambda x: x["n"]).alias("quotas"), F.transform("q", lambda x: x["_at"]).alias("ats")), "mix-quotas")
    shards = common.written(splitting_tree(quotas, levels), "mix-shards")
    runs = shards.select("shard", F.posexplode(F.arrays_zip("quotas", "starts")).alias("i", "r")).where("r.quotas > 0")
    runs = runs.select("shard", "i", F.explode(F.sequence(F.col("r.starts"), F.col("r.starts") + F.col("r.quotas") - 1)).alias("_nth"))
    runs = runs.join(quotas.select(F.posexplode("ats").alias("i", "_at")), "i").select("_at", "_nth", "shard")
    draw = F.struct(F.col("_pass").alias("pass"), F.col("shard").cast("long").alias("shard"), F.col("_limit").alias("limit"))
    lists = drawn.join(runs, ["_at", "_nth"]).groupBy("_source", "_block").agg(F.sort_array(F.collect_list(draw)).alias("_draws"))
    return blocks.select("_source", "_block", "source_size", "target").join(common.written(lists, "mix-lists"), ["_source", "_block"], "left")


def mix(documents: DataFrame, shard_words: int = SHARD_WORDS, carried: Column | None = None) -> DataFrame:
    """Every document with its size, its source's size and target, the words taken, and ``draws``: pass, shard, words and place in the shard's local order."""
    sized = common.written(sizes(documents, carried), "mix-sizes")
    words = sized.agg(F.sum("size").alias("n")).first()["n"] or 0
    levels = max(0, (max(1, -(-words // shard_words)) - 1).bit_length())
    blocked = in_blocks(sized, levels)
    blocks = block_draws(blocked, levels)
    local = Window.partitionBy("_source", "_block").orderBy(_hash("document", F.col("doc_id"), F.col("size")), "doc_id", "size")
    rows = blocked.join(blocks, ["_source", "_block"])
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    give = lambda d: F.when(d["limit"].isNull(), F.col("size")).otherwise(F.greatest(F.lit(0), F.least(F.col("size"), d["limit"] - F.col("_before"))))
    draws = F.transform(
        F.coalesce("_draws", F.array().cast("array<struct<pass:int,shard:bigint,limit:bigint>>")),
        lambda d: F.struct(
            d["pass"].alias("pass"), d["shard"].alias("shard"), give(d).cast("long").alias("words"),
            _hash("place", d["shard"], d["pass"], F.col("doc_id")).alias("place"),
        ),
    )
    rows = rows.withColumn("draws", F.filter(draws, lambda d: d["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"])
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws", *([] if carried is None else ["_row"]))


def mixed_documents(documents: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of the mix with the columns of ``documents``, a row per draw, and the draw's ``_mix_shard`` and ``_mix_place``.

    A document that is taken in part keeps its first words, joined by single
    spaces, and its n_chars follows.
    """
    rows = mix(documents, shard_words, F.struct(*documents.columns)).select("_row", "size", F.explode("draws").alias("_d"))
    cut = F.col("_d.words") < F.col("size")
    words = F.filter(F.split(F.col("_row.text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(cut, F.concat_ws(" ", F.slice(words, F.lit(1), F.col("_d.words").cast("int")))).otherwise(F.col("_row.text"))
    own = {"text": text, "n_chars": F.when(cut, F.length(text).cast("long")).otherwise(F.col("_row")["n_chars"])} if "n_chars" in documents.columns else {"text": text}
    return rows.select(*[own.get(c, F.col("_row")[c]).alias(c) for c in documents.columns], F.col("_d.shard").alias("_mix_shard"), F.col("_d.place").alias("_mix_place"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """Shard by shard, each in its own random order."""
    shards = common.partitions(mixed.sparkSession)
    return mixed.repartition(shards, "_mix_shard").sortWithinPartitions("_mix_shard", "_mix_place")
