"""Mixing sources to target weights, in DataFrame functions only.

Targets. Sources in code-point order, null last, weigh WEIGHTS in turn and share EPOCHS times all
sizes; a target stops at twice its source's size and the excess is shared again by weight.

Draw. A hash permutes each source's documents and cuts the permutation into blocks. A source takes
whole passes over its blocks and then, in permuted order, blocks up to its target; the last document
is cut so that the target is met exactly. Block passes are dealt to output shards by a
multivariate-hypergeometric splitting tree: at each node the exact quotas of all sources are split
between two halves of the shards by a draw without replacement, down to single shards; each shard
then draws its quota from the permuted blocks, disjointly, and shuffles its documents by hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, forget, materialize

WEIGHTS = (3, 1, 2)
EPOCHS = 1.5
MOST = 2
#: Documents of a block, on average, were all documents of one source. Where repeated ids fill a block
#: with SWOLLEN times as many, it is cut up.
BLOCK_ROWS = 512
SWOLLEN = 8
#: Documents of an output shard, about.
SHARD_ROWS = 20_000
#: A hypergeometric draw looks so many standard deviations, and so many values more, to either side of
#: the mode; what lies beyond is rarer than the last bit of a uniform number.
REACH, NEAR = 12, 32
#: Places that a lookup bucket of a shard's run of units spans.
SPAN = 64


def source_targets(sources: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, most: float = MOST) -> DataFrame:
    """sources: (source, source_size), one row each, materialized. Adds weight and target.

    The level at which weighted shares meet the caps is found by repeated rounds, as the rule says:
    each round sums what capped sources hold and shares the rest; only sums come to the driver."""
    # rank by code point, null last: a range sort, counts of its partitions, and a rank within each
    n = max(1, min(200, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = sources.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("_p", F.spark_partition_id())
    dealt = materialize(dealt, "sources")
    first = dealt.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last()))
    ranked = dealt.withColumn("_r", rank).join(F.broadcast(first), "_p").withColumn("_k", F.col("_before") + F.col("_r") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_k") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", weight.alias("weight")), "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    pool, level = epochs * total, None
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * level >= most * F.col("source_size")
        row = ranked.agg(F.sum(F.when(capped, most * F.col("source_size")).otherwise(0.0)).alias("held"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        now = (pool - row["held"]) / row["free"] if row["free"] else level
        if now is None or now == level or (level is not None and now <= level):
            break
        level = now
    share = F.least(F.col("weight") * F.lit(level or 0.0), most * F.col("source_size").cast("double"))
    forget(dealt)
    out = ranked.withColumn("target", share)
    out._scratch = ranked._scratch
    return out


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(u: Column, whole: Column, own: Column, draws: Column) -> Column:
    """By inversion of the uniform u: how many of `own` special units are among `draws` units drawn
    without replacement from `whole` (longs, own and draws at most whole)."""
    real = lambda c: c.cast("double")
    low, high = F.greatest(F.lit(0).cast("long"), draws - (whole - own)), F.least(draws, own)
    mode = F.floor(real(draws + 1) * real(own + 1) / real(whole + 2)).cast("long")
    share = real(own) / F.greatest(real(whole), F.lit(1.0))
    spread = F.sqrt(F.greatest(real(draws) * share * (1 - share) * real(whole - draws) / F.greatest(real(whole - 1), F.lit(1.0)), F.lit(0.0)))
    reach = (F.ceil(spread * REACH) + NEAR).cast("long")
    ends = F.struct(F.greatest(low, mode - reach).alias("a"), F.least(high, mode + reach).alias("b"))

    def ratio(k):  # of the chance of k + 1 to that of k
        return real(own - k) * real(draws - k) / (real(k + 1) * real(whole - own - draws + k + 1))

    def pick(e):
        places = F.sequence(e["a"], e["b"])
        one, nil = F.lit(1.0), F.lit(0.0)
        mass = F.aggregate(places, F.struct(one.alias("w"), nil.alias("t")), lambda acc, k: F.struct((acc["w"] * ratio(k)).alias("w"), (acc["t"] + acc["w"]).alias("t")))["t"]

        def step(goal):
            return F.aggregate(
                places,
                F.struct(one.alias("w"), nil.alias("t"), F.lit(-1).cast("long").alias("k")),
                lambda acc, k: F.struct((acc["w"] * ratio(k)).alias("w"), (acc["t"] + acc["w"]).alias("t"), F.when((acc["k"] < 0) & (acc["t"] + acc["w"] >= goal), k).otherwise(acc["k"]).alias("k")),
            )["k"]

        return _let(_let(mass * u, step), lambda k: F.when(k < 0, e["b"]).otherwise(k))

    return _let(ends, lambda e: F.when(e["a"] >= e["b"], e["a"]).otherwise(pick(e)))


def _split(items: Column, whole: Column, draws: Column, uniform) -> Column:
    """items: an array of structs with `units`, whole units in all. How many of each are among `draws`
    drawn without replacement: one item after another, given those before."""

    def step(acc, x):
        drawn = hypergeometric(uniform(x), acc["whole"], x["units"], acc["draws"])
        return _let(drawn, lambda v: F.struct((acc["whole"] - x["units"]).alias("whole"), (acc["draws"] - v).alias("draws"), F.concat(acc["out"], F.array(v)).alias("out")))

    start = F.struct(whole.cast("long").alias("whole"), draws.cast("long").alias("draws"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(items, start, step)["out"]


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas: (source, units), units >= 1. Returns (source, shard, units, first), materialized: how many
    units each shard gets of each source, and the place of the first in the source's permuted units.

    The tree: a node passes half of its units to its left child, drawn without replacement over the
    sources, the rest to the right one. A source's part is hypergeometric given those of the sources
    before it, drawn by exact inversion, so every node's sums are exact. Sources are drawn in two steps,
    first between groups of them, then within each group, which is the same law: no task sees more than
    about the square root of all sources."""
    depth = max(0, math.ceil(math.log2(max(1, shards))))
    level = materialize(quotas.select("source", F.col("units").cast("long").alias("units"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("first")), "tree")
    groups = max(1, math.isqrt(level.count())) if depth else 1

    for d in range(depth):

        def uniform(kind, node, key, d=d):
            return (F.shiftrightunsigned(F.xxhash64(F.lit(kind), F.lit(d), node, key, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)

        per = level.withColumn("group", F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(groups)).cast("int"))
        per = per.groupBy("node", "group").agg(F.sum("units").alias("units"), F.sort_array(F.collect_list(F.struct("source", "units", "first"))).alias("items"))
        per = materialize(per, "groups")
        nodes = per.groupBy("node").agg(F.sum("units").alias("all"), F.sort_array(F.collect_list(F.struct("group", "units"))).alias("groups"))
        half = F.floor(F.col("all") / 2).cast("long")
        lefts = _split(F.col("groups"), F.col("all"), half, lambda x: uniform("group", F.col("node"), x["group"]))
        nodes = nodes.select("node", F.explode(F.arrays_zip(F.col("groups.group").alias("group"), lefts.alias("left"))).alias("c")).select("node", "c.group", F.col("c.left").alias("goal"))
        mine = per.join(nodes, ["node", "group"])
        lefts = _split(F.col("items"), F.col("units"), F.col("goal"), lambda x: uniform("source", F.col("node"), x["source"]))
        mine = mine.select("node", F.explode(F.arrays_zip("items", lefts.alias("left"))).alias("c"))
        own, left = F.col("c.items"), F.col("c.left")
        children = F.array(
            F.struct((F.col("node") * 2).alias("node"), left.alias("units"), own["first"].alias("first")),
            F.struct((F.col("node") * 2 + 1).alias("node"), (own["units"] - left).alias("units"), (own["first"] + left).alias("first")),
        )
        below = mine.select(own["source"].alias("source"), F.explode(children).alias("k")).select("source", "k.units", "k.node", "k.first").filter("units > 0")
        below = materialize(below, "tree")
        forget(level, per)
        level = below
    out = level.select("source", F.col("node").alias("shard"), "units", "first")
    out._scratch = level._scratch
    return out


def mix_documents(docs: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, most: float = MOST, seed: int = 17, id_col: str = "doc_id", whole_rows: bool = False) -> DataFrame:
    """For each row: id, size (words; null text: 0), source_size, target, taken (words the mix takes,
    repeats counted), and draws, an array of (shard, place, pass, words) of the copies in the mix. With
    `whole_rows` the caller's row is carried in one struct, _row, and the figures in another, _mix.

    Null sources are one source, the last. Null and empty texts have size 0 and are never drawn. Rows
    that share an id are documents of their own; their order in the permutation is that of their places
    in the input. An empty table gives an empty result; with no words at all every target is zero. A very
    long text is one document. Other columns play no part, whatever their names."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("_row")] if whole_rows else []
    sized = materialize(docs.select(F.col(id_col).alias("_id"), F.col("source").alias("_source"), size.alias("_size"), F.monotonically_increasing_id().alias("_n"), *row), "sizes")
    rows = sized.count()
    blocks = max(1, rows // BLOCK_ROWS)
    shards = 1 << (rows // SHARD_ROWS).bit_length()
    key = F.xxhash64(F.col("_id"), F.lit(seed))
    sized = sized.withColumn("_key", key).withColumn("_block", F.pmod(key, F.lit(blocks)))

    def summed(df):
        return materialize(df.groupBy("_source", "_block").agg(F.sum("_size").alias("words"), F.count(F.lit(1)).alias("n")), "blocks")

    totals = summed(sized)
    swollen = totals.filter(F.col("n") > SWOLLEN * BLOCK_ROWS).select(F.col("_source").alias("s_source"), F.col("_block").alias("s_block"), F.ceil(F.col("n") / BLOCK_ROWS).alias("s_parts"))
    if not swollen.isEmpty():
        # rows that share an id, dealt on by their places
        swollen = materialize(swollen, "swollen")
        sized = sized.join(swollen, [F.col("_source").eqNullSafe(F.col("s_source")), F.col("_block") == F.col("s_block")], "left")
        sized = sized.withColumn("_block", F.col("_block") + blocks * F.coalesce(F.pmod(F.xxhash64("_n", F.lit(seed)), F.col("s_parts")), F.lit(0))).drop("s_source", "s_block", "s_parts")
        forget(totals)
        totals = summed(sized)
    sources = materialize(totals.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size")), "source-sizes")
    goals = source_targets(sources, weights, epochs, most)
    # words before each block in its source's permuted order, in two levels so that no source is one task's
    wide = 1024
    far = totals.withColumn("_super", F.expr(f"_block div {wide}"))
    supers = far.groupBy("_source", "_super").agg(F.sum("words").alias("w"))
    supers = supers.select("_source", "_super", F.coalesce(F.sum("w").over(Window.partitionBy("_source").orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    near = F.coalesce(F.sum("words").over(Window.partitionBy("_source", "_super").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = lambda a, b, *on: [a[x].eqNullSafe(b[y]) for x, y in on]
    far = far.withColumn("_near", near)
    far = far.join(supers, same(far, supers, ("_source", "_source"), ("_super", "_super"))).drop(supers["_source"]).drop(supers["_super"])
    placed = far.withColumn("before", F.col("_ahead") + F.col("_near")).drop("_ahead", "_near", "_super")
    placed = placed.join(goals, same(placed, goals, ("_source", "source"))).drop("source")
    # whole passes, and what the last, partial pass takes of the block
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0)).cast("int")
    placed = placed.withColumn("passes", F.least(passes, F.lit(int(most))))
    rest = F.greatest(F.lit(0), F.floor(F.col("target") - F.col("passes") * F.col("source_size"))).cast("long")
    placed = placed.withColumn("rest", F.greatest(F.lit(0), F.least(F.col("words"), rest - F.col("before"))).cast("long"))
    placed = placed.withColumn("units", F.col("passes") + (F.col("rest") > 0).cast("int"))
    placed = materialize(placed, "placed")
    forget(totals, sources, goals)
    # permuted order of each source's units, dealt to shards by the tree
    quotas = placed.groupBy(F.col("_source").alias("source")).agg(F.sum("units").alias("units")).filter("units > 0")
    split = split_quotas(quotas, shards, seed)
    dealt = materialize(_deal(placed.filter("units > 0").select("_source", "_block", "units"), split, seed), "dealt")
    forget(split)
    placed = placed.join(dealt, [placed["_source"].eqNullSafe(dealt["d_source"]), placed["_block"] == dealt["d_block"]], "left").drop("d_source", "d_block")
    # documents meet their block
    info = placed.select(F.col("_source").alias("b_source"), F.col("_block").alias("b_block"), "source_size", "target", "passes", F.col("rest").alias("_rest"), "shards")
    df = sized.join(info, [F.col("_source").eqNullSafe(F.col("b_source")), F.col("_block") == F.col("b_block")])
    order = Window.partitionBy("_source", "_block").orderBy(F.xxhash64("_key"), "_id", "_size", "_n").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("_size").over(order), F.lit(0))
    df = df.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - ahead)).cast("long"))
    words = F.when(F.col("_size") > 0, F.concat(F.array_repeat(F.col("_size"), F.col("passes")), F.when(F.col("_part") > 0, F.array("_part")).otherwise(F.expr("array()").cast("array<bigint>")))).otherwise(F.expr("array()").cast("array<bigint>"))
    df = df.withColumn("_words", words)
    draws = F.transform("_words", lambda w, i: F.struct(F.get("shards", i).alias("shard"), F.xxhash64("_key", i).alias("place"), i.alias("pass"), w.alias("words")))
    figures = [F.col("_size").alias("size"), F.col("source_size"), F.col("target"), (F.col("_size") * F.col("passes") + F.col("_part")).cast("long").alias("taken"), draws.alias("draws")]
    if whole_rows:
        return df.select(F.struct(*figures).alias("_mix"), "_row")
    return df.select(F.col("_id").alias(id_col), *figures)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each copy that is taken, dealt to shards and
    shuffled within them by place. A last copy that is taken in part holds its first words, joined by
    single spaces; its n_chars, if there is such a column, is counted anew. Documents without words are
    in no mix; else as mix_documents."""
    mixed = mix_documents(docs, id_col=id_col, whole_rows=True, **how)
    mixed = mixed.select("_row", F.col("_mix.size").alias("_size"), F.explode("_mix.draws").alias("_d"))
    own = lambda c: F.col("_row").getField(c)
    whole = F.col("_d.words") >= F.col("_size")
    cut = F.array_join(F.slice(F.array_remove(F.split(own("text"), SPACE), ""), 1, F.greatest(F.col("_d.words"), F.lit(1)).cast("int")), " ")
    mixed = mixed.withColumn("_text", F.when(whole, own("text")).otherwise(cut))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, own("n_chars")).otherwise(F.char_length("_text")).cast(docs.schema["n_chars"].dataType)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = mixed.repartition(parts, F.col("_d.shard")).sortWithinPartitions(F.col("_d.shard"), F.col("_d.place"))
    return mixed.select(*[new.get(c, own(c)).alias(c) for c in docs.columns])


def _deal(units: DataFrame, split: DataFrame, seed: int) -> DataFrame:
    """units: (_source, _block, units). Each unit gets its source's next place in permuted order, hence
    a shard: the one whose run of places holds it. Returns (d_source, d_block, shards array by pass)."""
    each = units.select("_source", "_block", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("pass"))
    each = each.withColumn("_key", F.xxhash64("_block", "pass", F.lit(seed)))
    # places in two levels: by the key's leading bits, then within
    each = each.withColumn("_top", F.shiftrightunsigned("_key", 54))
    tops = each.groupBy("_source", "_top").agg(F.count(F.lit(1)).alias("n"))
    tops = tops.select(F.col("_source").alias("t_source"), F.col("_top").alias("t_top"), F.coalesce(F.sum("n").over(Window.partitionBy("_source").orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    each = each.withColumn("_in", F.row_number().over(Window.partitionBy("_source", "_top").orderBy("_key", "_block", "pass")) - 1)
    each = each.join(tops, [F.col("_source").eqNullSafe(F.col("t_source")), F.col("_top") == F.col("t_top")]).withColumn("place", F.col("_ahead") + F.col("_in"))
    # units and runs meet in buckets of SPAN places
    each = each.select("_source", "_block", "pass", "place", F.expr(f"place div {SPAN}").alias("_bucket"))
    runs = split.select(F.col("source").alias("r_source"), "shard", F.col("first").alias("r_first"), (F.col("first") + F.col("units")).alias("r_end"))
    runs = runs.withColumn("r_bucket", F.explode(F.sequence(F.expr(f"r_first div {SPAN}"), F.expr(f"(r_end - 1) div {SPAN}"))))
    found = each.join(runs, [F.col("_source").eqNullSafe(F.col("r_source")), F.col("_bucket") == F.col("r_bucket"), F.col("place") >= F.col("r_first"), F.col("place") < F.col("r_end")])
    by_pass = F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"])
    return found.groupBy(F.col("_source").alias("d_source"), F.col("_block").alias("d_block")).agg(by_pass.alias("shards"))
