"""Grouping, best row of a key, key sets, lookups and ranking over records.

Orders are explicit everywhere: `pos` columns stand for the order rows came in, so ties keep the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- numbering

SHARDS = 64


def numbered(df: DataFrame, name: str, lead: Column, *ties: Column, part: Column | None = None) -> DataFrame:
    """df with its row number from 1, in order of part (few small numbers), lead (a number) and ties.

    Rows are dealt to shards by bounds of lead, at most SHARDS of them, that quantiles give; they are
    numbered in their shard, and shards begin where those before them end, so no task gets all rows.
    """
    rows = df.withColumns({"_part": F.lit(0) if part is None else part, "_lead": lead})
    bounds = rows.agg(F.percentile_approx(F.col("_lead").cast("double"), [k / SHARDS for k in range(1, SHARDS)], 1000)).first()[0] or []
    rows = rows.withColumn("_shard", F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < F.col("_lead"))) if bounds else F.lit(0))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part", "_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = rows.groupBy("_part", "_shard").count().select("_part", "_shard", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part", "_shard").orderBy("_lead", *ties))
    out = rows.withColumn("_n", place).join(F.broadcast(offsets), ["_part", "_shard"])  # a row for each shard
    return out.withColumn(name, (F.col("_n") + F.col("_before")).cast("int")).drop("_part", "_shard", "_lead", "_n", "_before")


# ---- best rows and groups


def best_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order. A hot key is cut to one row before the shuffle (window group limit)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def newest_of_each(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key in the given order, with their place from 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def best_access_point(df: DataFrame, key: str, active: Column, strength: Column, pos: str) -> DataFrame:
    """One row of each key: active before inactive; among active the first seen, among inactive the strongest, then the first seen."""
    return best_row(df, [key], active.desc(), F.when(~active, strength).desc_nulls_last(), F.col(pos))


def largest(df: DataFrame, keys: list[str], size: Column, pos: str) -> DataFrame:
    """The row of the largest size (null as 0), the first of equal ones."""
    return best_row(df, keys, F.coalesce(size, F.lit(0)).desc(), F.col(pos))


def latest_groups(df: DataFrame, key: str, ts: str) -> DataFrame:
    """key, n, latest: groups by their latest time, newest first."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.max(ts).alias("latest")).orderBy(F.desc("latest"), key)


def grouped_records(df: DataFrame, key: str, pos: str, first: list[str], fields: list[str], ts: str) -> DataFrame:
    """key, the first row's values, all rows in order as structs, the latest time."""
    at = F.struct(pos, *[F.col(c).alias(f"v_{c}") for c in first])
    out = df.groupBy(key).agg(F.min(at).alias("_f"), F.array_sort(F.collect_list(F.struct(pos, *fields))).alias("rows"), F.max(ts).alias("latest"))
    return out.select(key, *[F.col(f"_f.v_{c}").alias(c) for c in first], "rows", "latest")


def merged_groups(pinned: DataFrame, opened: DataFrame, key: str, value: str) -> DataFrame:
    """Pinned keys, then open ones, grouped without regard to case: key, pinned, values, in order of first appearance."""
    both = pinned.select(F.lower(key).alias("key"), F.lit(True).alias("pinned"), F.lit(0).alias("part"), "pos", F.lit(None).cast(dict(opened.dtypes)[value]).alias("value"))
    both = both.unionByName(opened.select(F.lower(key).alias("key"), F.lit(False).alias("pinned"), F.lit(1).alias("part"), "pos", F.col(value).alias("value")))
    out = both.groupBy("key").agg(F.max("pinned").alias("pinned"), F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("part", "pos", "value")))).alias("_v"), F.min(F.struct("part", "pos")).alias("_at"))
    out = out.select("key", "pinned", F.transform("_v", lambda x: x["value"]).alias("values"), "_at")
    return numbered(out, "place", F.col("_at.pos"), F.col("key"), part=F.col("_at.part")).drop("_at")


def distinct_first(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    return best_row(df, keys, F.col(pos))


def original_of_group(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Rows that are not their group's first, with the first one's name as `original`."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("original", F.first(name).over(w)).withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def counts_of(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row with a count for each listed value."""
    return df.agg(*[F.count_if(F.col(key) == v).alias(v) for v in values])


def document(packages: DataFrame, names: dict[str, str]) -> DataFrame:
    """json: {managers: {key: {name, packages}}, total} of rows manager, name, cur, new."""
    per = packages.groupBy("manager").agg(F.array_sort(F.collect_list(F.struct("name", "cur", "new"))).alias("packages"))
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("manager")], F.col("manager"))
    entry = F.struct("manager", F.struct(label.alias("name"), "packages").alias("value"))
    managers = F.map_from_entries(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["manager"], e["value"])))
    return per.agg(managers.alias("managers"), F.sum(F.size("packages")).alias("total")).select(F.to_json(F.struct("managers", "total")).alias("json"))


# ---- key sets


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side alone, with side `missing` (in a, not in b) or `extra`."""
    only = lambda x, y, side: x.select(keys).distinct().join(y.select(keys), keys, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "missing").unionByName(only(b, a, "extra"))


def key_sync(source: DataFrame, target: DataFrame, key: str, value: str, drop_extra: bool = False) -> DataFrame:
    """target with keys it lacks added from source; keys that source lacks are kept or dropped."""
    both = target.select(key, F.col(value).alias("_t"), F.lit(True).alias("_in_t")).join(source.select(key, F.col(value).alias("_s"), F.lit(True).alias("_in_s")), key, "full")
    if drop_extra:
        both = both.where("_in_s")
    return both.select(key, F.when(F.col("_in_t"), F.col("_t")).otherwise(F.col("_s")).alias(value))


def kept(value: Column, mark: str = "/*keep*/") -> Column:
    """Whether a value is marked as exempt from cleaning."""
    return F.rtrim(value).endswith(mark)


def without_unused(entries: DataFrame, used: DataFrame, key: str, value: str) -> DataFrame:
    """Entries whose key is used, or whose value is marked to be kept."""
    marked = F.coalesce(kept(F.col(value)), F.lit(False))
    return entries.where(~marked).join(used.select(key), key, "left_semi").unionByName(entries.where(marked))


def partition_requests(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """key, action: install what is wanted and absent, update what is both, remove what is present alone."""
    both = wanted.select(key).distinct().withColumn("_w", F.lit(1)).join(present.select(key).distinct().withColumn("_p", F.lit(1)), key, "full")
    return both.select(key, F.when(F.col("_p").isNull(), "install").when(F.col("_w").isNull(), "remove").otherwise("update").alias("action"))


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of current, payload replaced where new has the keys, and the new rows."""
    rest = [c for c in current.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rest], F.lit(True).alias("_new"))
    return current.join(n, keys, "full").select(*keys, *[F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in rest])


def semi_unless_empty(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; all rows if nothing is listed."""
    return df if listed.isEmpty() else df.join(listed, key, "left_semi")


def pinned_split(df: DataFrame, pins: DataFrame, key: str) -> DataFrame:
    """df with `pinned`."""
    return df.join(pins.select(key).distinct().withColumn("_p", F.lit(True)), key, "left").withColumn("pinned", F.coalesce("_p", F.lit(False))).drop("_p")


def not_contained(names: DataFrame, listed: DataFrame, name: str, text: str, exact: bool = True) -> DataFrame:
    """Names that no listed path ends in (exact), or that are no substring of any listed text (as a plain text search has it).

    For the latter the texts' substrings of the lengths that names have, which are few, meet the names by equality.
    """
    if exact:
        return names.join(listed.select(F.regexp_replace(F.element_at(F.split(text, "/"), -1), r"\.git$", "").alias(name)), name, "left_anti")
    sizes = [r[0] for r in names.select(F.length(name).alias("n")).where("n > 0").distinct().orderBy("n").collect()]
    if not sizes:
        return names.where(F.lit(False)) if not listed.isEmpty() else names

    def cut(n: int) -> Column:
        begins = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(begins, lambda i: F.substring(F.col(text), i, F.lit(n))))

    pieces = F.concat(*[cut(n) for n in sizes])
    left = names.join(listed.select(F.explode(pieces).alias(name)).distinct(), name, "left_anti")
    return left if listed.isEmpty() else left.where(F.coalesce(F.length(name), F.lit(1)) > 0)


def ordered_merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Retained items in their old order and case, then new ones in theirs; keys are compared without case. key, place."""
    o, n = old.select(key, "pos", F.lower(key).alias("_k")), new.select(key, "pos", F.lower(key).alias("_k"))
    rows = o.join(n.select("_k"), "_k", "left_semi").withColumn("_s", F.lit(0)).unionByName(n.join(o.select("_k"), "_k", "left_anti").withColumn("_s", F.lit(1)))
    return numbered(rows, "place", F.col("pos"), F.col(key), part=F.col("_s")).select(key, "place")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def toggled(values: Column, item: Column) -> Column:
    """The array without the item, or with it at the end if it was absent."""
    return F.when(F.array_contains(values, item), F.array_remove(values, item)).otherwise(F.array_append(values, item))


# ---- lookups


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """df with `value` from the first row of each key in table, or the default. Spark broadcasts the table if it is small."""
    return df.join(table.select(key, value).dropDuplicates([key]), key, "left").withColumn(value, F.coalesce(value, default))


def ordered_records(ids: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Records of an ordered id list (pos, key), in its order."""
    return ids.join(records, key).orderBy("pos")


def first_rule(df: DataFrame, text: str, rules: list[tuple[str, str]], default: str, name: str) -> DataFrame:
    """The value of the first rule found in the text, in order, without regard to case."""
    from marlow.functions.text import first_rule as rule

    return df.withColumn(name, rule(F.col(text), rules, default))


def cascade(name: Column, *steps: Callable[[Column], Column]) -> Column:
    """The first step's value that is not null, else the name itself."""
    return F.coalesce(*[s(name) for s in steps], name)


def replaced_in_order(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Each pair's first text replaced by its second, one after the other."""
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


# ---- order and limits


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows and, in `total`, how many there were."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).limit(k).crossJoin(F.broadcast(total))  # one row


def limited_text(df: DataFrame, text: str, n: int, *order: Column) -> DataFrame:
    """One row: the first n texts as a numbered list, and how many more there are."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).limit(n).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", text))), lambda x: F.concat(x["_n"].cast("string"), F.lit(". "), x[text])), "\n")
    return rows.agg(lines.alias("lines")).crossJoin(F.broadcast(total)).select(F.when(F.col("total") > n, F.concat("lines", F.lit("\n… and "), (F.col("total") - n).cast("string"), F.lit(" more"))).otherwise(F.col("lines")).alias("text"))


def page(df: DataFrame, offset: int, size: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def reversed_head(df: DataFrame, n: int, pos: str) -> DataFrame:
    """The first n rows, last first."""
    return df.orderBy(pos).limit(n).orderBy(F.desc(pos))


def pinned_first(df: DataFrame, key: str, first: str) -> DataFrame:
    return df.orderBy(F.col(key) != first, key)


def by_connection(df: DataFrame, connected: str, paired: str, name: str) -> DataFrame:
    """Connected, then paired, then names that are not addresses, then by name."""
    return df.orderBy(F.desc(connected), F.desc(paired), F.col(name).rlike("^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"), F.collate(F.col(name), "UNICODE"))


def first_available(candidates: DataFrame, available: DataFrame, key: str) -> DataFrame:
    return candidates.join(available, key, "left_semi").orderBy("pos").limit(1)


def retained(files: DataFrame, now: Column, newest: int = 5, days: int = 30) -> DataFrame:
    """path, deleted: files beyond the newest few that are older than so many days go."""
    few = files.orderBy(F.desc("modified"), "path").limit(newest).select("path", F.lit(True).alias("_new"))
    old = F.col("_new").isNull() & (F.col("modified") < now - F.make_dt_interval(F.lit(days)))
    return files.join(F.broadcast(few), "path", "left").withColumn("deleted", old).drop("_new")  # `newest` rows
