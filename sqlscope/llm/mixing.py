"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's target is its share of all words by weight, never more than
``max_repeat`` times its size; what the cap leaves is shared again by weight.
Every document of a source gets floor(target / size of the source) certain whole
copies. The rest of the target is an unequal-probability sample: a document is
included with p = min(c * weight, 1), its weight the whole square root of its size
and c such that the words expected are those left; where that is 1 it is one more
certain copy. The others are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and taken in that order until the words left are
filled. The cut lies where at least half of the next document fits, so a source
misses its target by half a document at most (unless its documents run out).

The random number u comes from md5 of the id, so reruns agree. The cut of a
source is found from sums over ranges of the key, then inside one range; no task holds
a source's rows. Defined results: a null text has size 0 and is taken 0 times;
a very long text is one document like others; a null source is a source of its own,
last in order; null ids are equal ids; rows that tie (equal id, source, size and text)
are taken row by row, as many as the words left allow, whichever they are; an empty
table gives none; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlscope.llm.common import materialize, numbered, small

WORD = r"[^\x20\x09-\x0D]+"


def uniform(doc_id: Column, salt: str = "mix") -> Column:
    """In (0, 1), from the first 52 bits of an md5."""
    digest = F.md5(F.concat(F.lit(salt + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size).

    Filling to the cap has a closed form: in order of cap / weight the capped
    sources come first, and the rest share what remains by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeat)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "i").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    total, all_weight = F.sum("source_size").over(whole), F.sum("weight").over(whole)
    # words and weight left when all sources before this one are capped
    ranked = ranked.withColumn("words_left", total - F.coalesce(F.sum("cap").over(fill), F.lit(0))).withColumn("weight_left", all_weight - F.coalesce(F.sum("weight").over(fill), F.lit(0)))
    ranked = ranked.withColumn("capped", F.col("cap") * F.col("weight_left") <= F.col("weight") * F.col("words_left"))
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "i", "words_left", "weight_left"))).over(whole)
    ranked = ranked.withColumn("level", first)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level.words_left") / F.col("level.weight_left"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), uniform(F.col("doc_id")).alias("u"), F.xxhash64("text").alias("tie"))


def mix(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """From materialised rows of sized(): doc_id, source, size, source_size, target, expected, copies, taken."""
    done = decided(rows, cuts(rows, weights, max_repeat))
    return done.select("doc_id", "source", "size", "source_size", "target", "expected", "copies", (F.col("copies") * F.col("size")).alias("taken"))


#: Rows that one range of the order holds on average.
RANGE_ROWS = 4096


def inclusion() -> Column:
    """The weight by which a document is included: the whole square root of its size."""
    return F.floor(F.sqrt("size")).cast("long")


def rates(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``goal`` (source, source_size, target) with the whole copies of all, c, and the words left beside certain copies.

    Of the weights of a source the largest may be clipped at 1; c is that of the largest weight that is not.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    per = rows.filter("size > 0").groupBy(F.col("source").alias("s"), inclusion().alias("m")).agg(F.sum("size").alias("words"))
    down = Window.partitionBy("s").orderBy(F.desc("m"))
    up = Window.partitionBy("s").orderBy("m")
    per = per.join(goal.select("source", "whole", "rest"), F.col("s").eqNullSafe(F.col("source"))).drop("source")
    per = per.withColumn("clipped", F.sum("words").over(down) - F.col("words")).withColumn("below", F.sum(F.col("m") * F.col("words")).over(up))
    c = (F.col("rest") - F.col("clipped")) / F.col("below")
    per = per.withColumn("c", c).withColumn("c", F.when(F.col("c") * F.col("m") <= 1, F.col("c")))
    per = per.withColumn("c", F.max_by("c", F.when(F.col("c").isNotNull(), F.col("m"))).over(Window.partitionBy("s")))
    certain = F.sum(F.floor(expected(F.col("m"))) * F.col("words"))
    found = per.groupBy("s").agg(F.max("c").alias("c"), certain.alias("certain"))
    joined = goal.join(found, F.col("source").eqNullSafe(F.col("s")), "left_outer").drop("s")
    return joined.withColumn("left", F.col("target") - F.coalesce("certain", F.lit(0))).drop("certain", "rest")


def expected(m: Column) -> Column:
    """How often a document of weight m is to be taken."""
    return F.col("whole") + F.coalesce(F.least(F.col("c") * m, F.lit(1.0)), F.lit(1.0))


def cuts(rows: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """A row per source: its target, its rate and how far in the order its documents are taken."""
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    per_source = materialize(per_source, "mix-sources")
    goal = targets(per_source.select("source", "source_size"), weights, max_repeat)
    goal = goal.join(per_source.select(F.col("source").alias("s2"), "source_rows"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    goal = materialize(rates(rows, goal).withColumn("ranges", F.ceil(F.col("source_rows") / RANGE_ROWS)), "mix-goal")
    keyed = keys(rows, goal).filter("key is not null")
    sums = keyed.groupBy("source", "range", "left").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    # the range where the words left run out
    edge = sums.filter((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left")))
    edge = small(materialize(edge.select(F.col("source").alias("s3"), F.col("range").alias("r3"), "before"), "mix-edge"))  # a row per source at most
    inside = keyed.join(edge, F.col("source").eqNullSafe(F.col("s3")) & (F.col("range") == F.col("r3")))
    # rows that tie are one row with their number, before they are ordered
    ties = inside.groupBy("source", "key", "doc_id", "size", "tie", "left", "before").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("source").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("left") - F.col("before") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(upto), F.lit(0))
    fit = F.greatest(F.least(F.floor(room / F.col("size") + 0.5), F.col("n")), F.lit(0))
    last = ties.withColumn("fit", fit).filter("fit > 0").groupBy("source").agg(F.max(F.struct("key", "doc_id", "size", "tie", "n", "fit")).alias("cut"))
    known = goal.join(last.withColumnRenamed("source", "s4"), F.col("source").eqNullSafe(F.col("s4")), "left_outer").drop("s4")
    known = known.join(edge.select(F.col("s3"), F.col("r3").alias("edge_range")), F.col("source").eqNullSafe(F.col("s3")), "left_outer").drop("s3")
    return materialize(known, "mix-cuts", split=F.count_if(F.col("cut.fit") < F.col("cut.n")))


def keys(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """Rows with what is known of their source, their order and its range."""
    known = goal.withColumnRenamed("source", "goal_source")
    known.facts = goal.facts
    joined = rows.join(small(known), F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")  # a row per source
    e = F.when(F.col("size") > 0, expected(inclusion())).otherwise(0.0)
    p, u = F.col("expected") - F.floor("expected"), F.col("u")
    joined = joined.withColumn("expected", e).withColumn("key", F.when(p > 0, (u / (1 - u)) / (p / (1 - p))))
    return joined.withColumn("range", F.floor(F.col("key") / (1 + F.col("key")) * F.col("ranges")))


def decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with ``copies``: how often the mix takes them."""
    keyed = keys(rows, plan)
    here, cut = F.struct("key", "doc_id", "size", "tie"), F.struct("cut.key", "cut.doc_id", "cut.size", "cut.tie")
    at_cut = F.coalesce((F.col("range") == F.col("edge_range")) & F.col("cut").isNotNull() & (here == cut), F.lit(False))
    extra = (
        F.when(F.col("key").isNull(), 0)
        .when(F.col("edge_range").isNull(), F.when(F.col("left") > 0, 1).otherwise(0))  # its documents don't reach the words left
        .when(F.col("range") < F.col("edge_range"), 1)
        .when(F.col("range") > F.col("edge_range"), 0)
        .when(F.col("cut").isNotNull() & (here <= cut), 1)
        .otherwise(0)
    )
    certain = F.floor("expected").cast("long")
    if not plan.facts["split"]:
        return keyed.withColumn("copies", certain + extra)
    # of the rows that tie at a cut some are taken: numbered in parts, so that no task holds them all
    plain = keyed.filter(~at_cut).withColumn("copies", certain + extra)
    tied = numbered(keyed.filter(at_cut).withColumn("many", F.col("cut.n")), ["source"], "many", RANGE_ROWS)
    tied = tied.withColumn("copies", certain + (F.col("nth") <= F.col("cut.fit")).cast("long"))
    return plain.unionByName(tied.select(*plain.columns))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Texts are not shuffled: the cuts are one row per source."""
    names = docs.columns
    plan = cuts(materialize(sized(docs), "mix-sizes"), weights, max_repeat)
    body = F.struct(*[F.col(f"`{c}`") for c in names]).alias("body")
    size = F.coalesce(F.regexp_count("body.text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(body).select("body", "body.doc_id", "body.source", size.alias("size"), F.xxhash64("body.text").alias("tie"))
    done = decided(rows.withColumn("u", uniform(F.col("doc_id"))), plan)
    return done.select("body", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("body.*")
