"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words.  Its documents have unequal shares in it: a
document is expected to be taken ``rate * appeal`` times, ``most`` times at the
utmost, with the rate that meets the target.  By default the appeal grows with the
logarithm of a document's size, so long documents are repeated before short ones
are.  The whole part of that number are certain copies; what is left is the
document's inclusion probability.  Documents are ranked by random odds divided by
inclusion odds, and the source's remaining words are filled in that order, to the
document whose end is nearest to the target.

A source is never ranked in one place.  The order within a source is cut into cells
of a few thousand documents, cells are summed, and only the cell in which the
target is reached is put in order row by row.  Rates come from sums over the
documents of like appeal.  Random numbers come from a seed and the row itself, so
reruns and lost tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

#: Documents that share a cell, about.
CELL = 4096
#: The sources' weights by their place in code-point order.
WEIGHTS = [5, 2, 1]
#: Appeals are rounded to this many steps between a number and its double.
STEPS = 8


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    edges = F.when(parts[0] == "", 1).otherwise(0) + F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1
    ).otherwise(0)
    return F.coalesce(F.size(parts) - edges, F.lit(0)).cast("long")


def ranked(keys: DataFrame, order: list[Column], out: str = "place", sums: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` with their 0-based place in ``order``, without bringing them to one task.

    For each column of ``sums`` there is also ``<name>_so_far``, its sum up to and with
    the row.  Rows are range-partitioned and summed by partition; only these sums, one
    row for each partition, meet in a window.
    """
    parted = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    parted = cut(parted.withColumn("_i", F.monotonically_increasing_id()))
    parted = parted.withColumn("_p", F.shiftright("_i", 33)).withColumn("_n", F.col("_i").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy("_p").agg(F.count("*").alias("_c"), *[F.sum(c).alias(f"_c_{c}") for c in sums]).select(
        "_p",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"),
        *[F.coalesce(F.sum(f"_c_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums],
    )
    within = Window.partitionBy("_p").orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = parted.join(starts, "_p").withColumn(out, F.col("_s") + F.col("_n"))
    for c in sums:
        found = found.withColumn(f"{c}_so_far", F.col(f"_s_{c}") + F.sum(c).over(within))
    return found.drop("_i", "_p", "_n", "_s", *[f"_s_{c}" for c in sums])


def fill_targets(sources: DataFrame, total: float, most: float) -> DataFrame:
    """Share ``total`` by ``weight``, none above ``most`` times its ``source_size``.

    What a capped source leaves is shared anew by weight until none is above.  With the
    sources in the order in which they meet their caps, the level ``total / weight`` at
    the end is the highest of those that the first 0, 1, 2, ... capped ones leave.
    """
    sources = sources.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    placed = ranked(sources, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], "_place", ("cap", "weight"))
    whole = sources.agg(F.sum("weight"), F.count("*")).first()
    if not whole[1]:
        return sources.withColumn("target", F.lit(0.0)).drop("cap")
    left = F.lit(whole[0]) - F.col("weight_so_far")
    level = placed.filter(left > 0).agg(F.max((F.lit(float(total)) - F.col("cap_so_far")) / left)).first()[0]
    level = max(total / whole[0], total / whole[0] if level is None else level)
    return sources.withColumn("target", F.least("cap", F.col("weight") * F.lit(float(level)))).drop("cap")


def rates(classes: DataFrame, most: float) -> DataFrame:
    """``source`` and ``rate``: with ``least(most, rate * appeal)`` copies of all words the target is met.

    ``classes`` sum a source's words by their appeal: ``source``, ``target``, ``appeal``,
    ``words``.  As with targets, the rate is the highest that any number of classes at
    the cap, greatest appeal first, leaves for the rest.
    """
    whole = Window.partitionBy("source")
    falling = whole.orderBy(F.desc("appeal")).rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum(F.col("words") * F.lit(float(most))).over(falling), F.lit(0.0))
    pull = F.col("words") * F.col("appeal")
    open_ = F.sum(pull).over(whole.orderBy(F.desc("appeal")).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    told = classes.filter("words > 0").withColumn("_rate", (F.col("target") - capped) / open_)
    return told.groupBy("source").agg(F.max("_rate").alias("rate"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    key_col: str | None = None,
    appeal: Column | None = None,
    weights: list[int] = WEIGHTS,
    volume: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """How often each document is taken so that sources come near their targets.

    Returns the id, ``source``, ``size`` (words), ``source_size``, ``target``,
    ``copies`` and ``taken`` (words, repeats counted) for every row, ``expected`` (the
    number of copies it has on average) and ``row_key``, a hash of ``key_col`` (the id
    by default) and text.  Targets share ``volume`` times all words by weight;
    the weights repeat over the sources in code-point order, null last.
    ``appeal`` is a positive column of ``docs``; null, zero and less count as the
    smallest number there is a step for.

    Null and empty texts have size 0 and take nothing.  A null source is a source
    of its own.  Rows that are equal in key and text share a random number; as many
    of them are taken as the order reaches.  A table without words has targets 0,
    an empty one an empty result.  Very long texts are counted whole; a source whose
    target ends in one comes as near to it as that document's half.  Other columns are
    ignored, whatever their names.
    """
    text = docs[text_col].cast("string")
    key = F.xxhash64(F.lit(seed), docs[key_col or id_col], text)
    size = word_count(text)
    liked = F.log2(size + F.lit(1.0)) if appeal is None else appeal.cast("double")
    step = F.round(F.log2(F.greatest(F.coalesce(liked, F.lit(0.0)), F.lit(2.0**-20))) * STEPS).cast("int")
    rows = cut(
        docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), size.alias("size"), key.alias("row_key"), step.alias("step"))
    )
    classes = rows.groupBy("source", "step").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    classes = cut(classes.withColumn("appeal", F.pow(F.lit(2.0), F.col("step") / STEPS)))
    sums = classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("docs").alias("docs"))
    places = ranked(sums, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = cut(places.withColumn("weight", weight).drop("place"))
    words = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    targets = cut(fill_targets(placed, volume * words, most))
    goals = targets.select(F.col("source").alias("_source"), "target")
    rate = rates(classes.join(goals, classes["source"].eqNullSafe(F.col("_source"))).drop("_source"), most)
    rate = rate.select(F.col("source").alias("_source"), "rate")
    targets = cut(targets.join(rate, targets["source"].eqNullSafe(F.col("_source")), "left").drop("_source"))
    return _take(rows, targets, most).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "expected", "row_key"
    )


def _take(rows: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target", "docs", "rate")
    scored = rows.join(targets, rows["source"].eqNullSafe(F.col("_source"))).drop("_source")
    expected = F.least(F.lit(float(most)), F.col("rate") * F.pow(F.lit(2.0), F.col("step") / STEPS))
    scored = scored.withColumn("expected", F.when(F.col("size") > 0, F.coalesce(expected, F.lit(0.0))).otherwise(0.0))
    scored = scored.withColumn("whole", F.floor(F.col("expected") + 1e-9).cast("long"))
    scored = scored.withColumn("part", F.when(F.col("expected") - F.col("whole") > 1e-9, F.col("expected") - F.col("whole")).otherwise(0.0))
    # Random odds over inclusion odds; a cell is a stretch of that number's share in itself and 1.
    # About 1 is where the sample ends, and there cells hold no more documents than on the whole.
    uniform = (F.shiftrightunsigned("row_key", 11).cast("double") + 0.5) / float(1 << 53)
    odds = F.col("part") / (1 - F.col("part"))
    scored = scored.withColumn("_q", F.when(F.col("part") > 0, uniform / (1 - uniform) / odds))
    scored = scored.withColumn("_cell", F.floor(F.col("_q") / (1 + F.col("_q")) * F.ceil(F.col("docs") / CELL)).cast("long"))
    certain = scored.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("_certain"))
    cells = scored.filter("part > 0").groupBy("source", "_cell").agg(F.sum("size").alias("_words"), F.first("target").alias("_target"))
    certain = certain.withColumnRenamed("source", "_source")
    cells = cells.join(certain, cells["source"].eqNullSafe(F.col("_source"))).drop("_source")
    before = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    left = (F.col("_target") - F.col("_certain") - F.col("_before")).alias("_left")
    cells = cells.select(F.col("source").alias("_s"), F.col("_cell").alias("_c"), "_words", left)
    met = scored.join(cells, scored["source"].eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")), "left").drop("_s", "_c")
    edge = (F.col("_left") > 0) & (F.col("_left") < F.col("_words"))
    flat = met.filter(~F.coalesce(edge, F.lit(False))).withColumn(
        "copies", F.col("whole") + F.coalesce((F.col("_left") >= F.col("_words")).cast("long"), F.lit(0))
    )
    order = Window.partitionBy("source", "_cell").orderBy("_q", "row_key", "id", "size")
    so_far = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = met.filter(edge).withColumn("_sum", so_far)
    ends = ends.withColumn("copies", F.col("whole") + (F.col("_sum") - F.col("size") / 2 <= F.col("_left")).cast("long"))
    return flat.unionByName(ends.drop("_sum"))
