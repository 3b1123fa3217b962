"""Greedy selections among overlapping rectangles in rounds, without a group in one task.

What a sequential loop decides one after the other is decided in rounds: a row is settled as soon as all that comes
before it and touches it is settled. Rounds are joins of the pairs that are still open, each written and counted;
they end when none is left. There are as many as the longest chain of rows that wait for each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlow.operators import rectangles
from marlow.sources.shared import drop, written

# Rows that are settled at first, and how many times more in each next batch.
FIRST_BATCH, GROWTH = 2000, 4
# How often rows that certainly fall are looked for behind a batch.
TURNS = 4


def _without(pairs: DataFrame, gone: DataFrame, *ends: str) -> DataFrame:
    for end in ends:
        pairs = pairs.join(gone.select(F.col("k").alias(end)), end, "left_anti")
    return pairs


def overruled(pairs: DataFrame) -> DataFrame:
    """k: of pairs (a, b), a coming before b, the rows that fall when each row that stands makes all its b fall, in order.

    The rows left are the lexicographically first set without a pair.
    """
    open_, fallen = written(pairs.select("a", "b"), "pairs"), []
    while open_.count():
        # nothing that could overrule these is open
        stand = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")), "a", "left_anti")
        fall = written(open_.join(stand, "a").select(F.col("b").alias("k")).distinct(), "fallen")
        fallen.append(fall)
        left = written(_without(open_, fall, "a", "b"), "pairs")
        drop(open_)
        open_ = left
    out = pairs.select(F.col("b").alias("k")).limit(0)
    for f in fallen:
        out = out.unionByName(f)
    return out


def _batch(rows: DataFrame, size: int, n: int) -> DataFrame:
    """The first rows by area, then pos, about `size` of n."""
    if size >= n:
        return rows
    # the boundary is exact for any value of these quantiles: what is before it comes before all the rest
    t = rows.agg(F.percentile_approx("_area", 1 - size / n, 10_000)).first()[0]
    ahead, same = rows.agg(F.count_if(F.col("_area") > t), F.count_if(F.col("_area") == t)).first()
    share = min(1.0, max(0.0, (size - ahead) / same))
    p = rows.where(F.col("_area") == t).agg(F.percentile_approx("pos", share, 10_000)).first()[0]
    return rows.where((F.col("_area") > t) | ((F.col("_area") == t) & (F.col("pos") <= p)))


def _first_of_equal(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows of pos, rect without those whose rectangle one with a smaller pos has, if such two overlap by the threshold."""
    r = {n: F.col("rect")[n].cast("double") for n in ("x", "y", "width", "height")}
    both = F.greatest(r["x"] + r["width"] - r["x"], F.lit(0.0)) * F.greatest(r["y"] + r["height"] - r["y"], F.lit(0.0))
    union = r["width"] * r["height"] + r["width"] * r["height"] - both
    # as rectangles.ratio() has it of two equal ones; 1 but for rounding
    own = F.when((union > 0) & ~F.isnan(union), both / union).otherwise(0.0)
    meets = (own >= threshold) & (own > 0) & ~F.isnan(own)
    first = rows.where(meets).groupBy(*[c.alias(n) for n, c in r.items()]).agg(F.min("pos").alias("pos")).select("pos")
    return rows.where(~meets).unionByName(rows.where(meets).join(first, "pos", "left_semi"))


def suppress(df: DataFrame, threshold: float = 0.7, first: int = FIRST_BATCH) -> DataFrame:
    """Rows of pos (unique), rect that stay: largest first, a rectangle stays if it overlaps no kept one by the threshold or more.

    Of equal rectangles only the first can stay: what it is, or what makes it fall, makes the others fall. Of the
    rest, a batch of the largest is settled by its pairs; then all others that overlap one it keeps are taken out at once, so
    that a crowded place has few pairs left in the next, larger batch.
    """
    size = F.col("rect.width") * F.col("rect.height")
    rows, kept, n_batch = written(df.withColumn("_area", size.cast("double")), "rects"), [], first
    # a null rectangle overlaps nothing
    kept.append(rows.where("_area is null or isnan(_area)"))
    rest = written(_first_of_equal(rows.where("_area is not null and not isnan(_area)"), threshold), "rest")
    while n := rest.count():
        batch = written(_batch(rest, n_batch, n), "batch")
        met = rectangles.overlapping(batch, batch, "pos", least=threshold, inclusive=True).where("left_key <> right_key")
        area = batch.select("pos", "_area")
        met = met.join(area.select(F.col("pos").alias("left_key"), F.col("_area").alias("_l")), "left_key").join(area.select(F.col("pos").alias("right_key"), F.col("_area").alias("_r")), "right_key")
        before = (F.col("_l") > F.col("_r")) | ((F.col("_l") == F.col("_r")) & (F.col("left_key") < F.col("right_key")))
        fallen = overruled(met.where(before).select(F.col("left_key").alias("a"), F.col("right_key").alias("b")))
        stays = written(batch.join(fallen.select(F.col("k").alias("pos")), "pos", "left_anti"), "kept")
        kept.append(stays)
        others = rest.join(batch.select("pos"), "pos", "left_anti")
        rest = written(rectangles.without_overlap(others, stays, "pos", threshold=threshold, inclusive=True), "rest")
        n_batch *= GROWTH
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out.select(df.columns)


def _smaller_left(df: DataFrame) -> DataFrame:
    """Rows (pos, rect, _area) that stay, by the rounds of all their pairs.

    In a round the rows that no earlier one can still remove (heads) remove the later ones that are no smaller, up to the
    first smaller one, if no earlier head waits for these; a head whose next one is smaller goes itself.
    """
    area = df.select(F.col("pos").alias("k"), "_area")
    met = rectangles.overlapping(df, df, "pos").where("left_key < right_key").select(F.col("left_key").alias("i"), F.col("right_key").alias("j"))
    met = met.join(area.select(F.col("k").alias("i"), F.col("_area").alias("_i")), "i").join(area.select(F.col("k").alias("j"), F.col("_area").alias("_j")), "j")
    open_, gone = written(met.select("i", "j", (F.col("_i") > F.col("_j")).alias("less")), "pairs"), []
    while open_.count():
        first = open_.groupBy("j").agg(F.min("i").alias("_by"))
        heads = open_.groupBy("i").agg(F.min("j").alias("_next"), F.min(F.when(F.col("less"), F.col("j"))).alias("_star"))
        heads = heads.join(first.select(F.col("j").alias("i")), "i", "left_anti")
        ready = open_.join(heads, "i").join(first, "j").where("_by = i")
        removed = F.when(F.col("less") & (F.col("j") == F.col("_next")), F.col("i")).when(~F.col("less") & (F.col("_star").isNull() | (F.col("j") < F.col("_star"))), F.col("j"))
        fall = written(ready.select(removed.alias("k")).where("k is not null").distinct(), "gone")
        gone.append(fall)
        left = written(_without(open_, fall, "i", "j"), "pairs")
        drop(open_)
        open_ = left
    out = df
    for g in gone:
        out = out.join(g.withColumnRenamed("k", "pos"), "pos", "left_anti")
    return out


def _certain(rest: DataFrame, standing: DataFrame) -> DataFrame:
    """k: rows of rest, all behind the standing ones, that fall whatever else happens and remove none before.

    A standing row that no smaller one of the rest overlaps stands for good. What overlaps it falls by it, or by one
    before it, and removes none if none of those before it is larger. Rows known to fall so make others stand for good, so this is repeated.
    """
    met = rectangles.overlapping(rest, standing, "pos").select(F.col("left_key").alias("j"), F.col("right_key").alias("i"))
    area = lambda df, k, a: df.select(F.col("pos").alias(k), F.col("_area").alias(a))
    met = met.join(area(rest, "j", "_j"), "j").join(area(standing, "i", "_i"), "i")
    open_, out = written(met.select("j", "i", (F.col("_i") > F.col("_j")).alias("larger")), "met"), []
    while True:
        # those that a smaller row, not known to fall, overlaps
        unsure = open_.where("larger").select("i").distinct()
        safe = open_.join(unsure.withColumn("_u", F.lit(True)), "i", "left")
        first = safe.groupBy("j").agg(F.min(F.when(F.col("_u").isNull(), F.col("i"))).alias("_safe"), F.min(F.when(F.col("larger"), F.col("i"))).alias("_larger"))
        fall = written(first.where("_safe is not null and (_larger is null or _safe < _larger)").select(F.col("j").alias("k")), "certain")
        n = fall.count()
        if n:
            out.append(fall)
            left = written(_without(open_, fall, "j"), "met")
            drop(open_)
            open_ = left
        # what is left can wait for the next batch if few rows are found
        if not n or len(out) == TURNS:
            break
    drop(open_)
    certain = rest.select(F.col("pos").alias("k")).limit(0)
    for f in out:
        certain = certain.unionByName(f)
    return certain


def keep_smaller(df: DataFrame, first: int = FIRST_BATCH) -> DataFrame:
    """Rows of pos (unique), rect that stay: of overlapping pairs the larger goes, pairs in order of both pos; of equal ones the later. One that is gone removes no other.

    A row's fate depends only on rows before it until a smaller one behind comes, so the table is settled in batches in
    the order of pos: those that stand, no two of which overlap, and the next batch give those that stand then. After each
    batch the rows behind it that certainly fall and remove nothing are taken out, so that a crowded place has few pairs left.
    """
    area = F.col("rect.width") * F.col("rect.height")
    rows = written(df.select("pos", "rect", area.cast("double").alias("_area")), "rects")
    # a null rectangle overlaps nothing
    alone, rest = rows.where("_area is null or isnan(_area)"), rows.where("_area is not null and not isnan(_area)")
    standing, n_batch = rows.limit(0), first
    while n := rest.count():
        if n_batch >= n:
            batch = rest
        else:
            # any value of this quantile parts the rows by their order
            to = rest.agg(F.percentile_approx("pos", n_batch / n, 10_000)).first()[0]
            batch = rest.where(F.col("pos") <= to)
        standing = written(_smaller_left(standing.unionByName(batch)), "standing")
        if n_batch >= n:
            break
        behind = rest.where(F.col("pos") > to)
        rest = written(_without(behind, _certain(behind, standing), "pos"), "rest")
        n_batch *= GROWTH
    return df.join(standing.unionByName(alone).select("pos"), "pos", "left_semi").select(df.columns)
