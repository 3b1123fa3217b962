"""Queries over records: groups, best rows, key sets, lookups, order, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlow.operators import records, scans, series
from marlow.plans.catalog import Fixture, query, table

EV = "ORDER BY ts, event_id"


@query("SELECT event_type, count(*) AS n, max(ts) AS latest FROM events GROUP BY event_type")
def latest_groups(spark: SparkSession, d: str) -> DataFrame:
    return records.latest_groups(table(spark, d, "events"), "event_type", "ts")


@query("SELECT event_type, min(event_id) AS first_id, count(*) AS n, sum(event_id) AS ids, max(ts) AS latest FROM events GROUP BY event_type")
def grouped_records(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("first_id", F.col("event_id"))
    out = records.grouped_records(e, "event_type", "event_id", ["first_id"], ["value"], "ts")
    return out.select("event_type", "first_id", F.size("rows").cast("long").alias("n"), F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["event_id"]).alias("ids"), "latest")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events QUALIFY place <= 2")
def newest_two(spark: SparkSession, d: str) -> DataFrame:
    out = records.newest_of_each(table(spark, d, "events"), ["user_id"], 2, F.desc("ts"), F.col("event_id"))
    return out.select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, CASE WHEN event_type <> 'purchase' THEN value END DESC NULLS LAST, event_id) = 1")
def best_per_key(spark: SparkSession, d: str) -> DataFrame:
    return records.best_access_point(table(spark, d, "events"), "user_id", F.col("event_type") == "purchase", F.col("value"), "event_id").select("user_id", "event_id")


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(p_size * p_retailprice, 0) DESC, p_partkey) = 1")
def argmax_area(spark: SparkSession, d: str) -> DataFrame:
    return records.largest(table(spark, d, "part"), ["p_brand"], F.col("p_size") * F.col("p_retailprice"), "p_partkey").select("p_brand", "p_partkey")


PINS = Fixture("pins", "appId string, pos int", [("Firefox", 0), ("term", 1), ("Mail", 2)])
OPEN = Fixture("open", "appId string, pos int, win int", [("firefox", 0, 10), ("editor", 1, 11), ("TERM", 2, 12), ("FireFox", 3, 13)])


@query(f"WITH {PINS.sql()}, {OPEN.sql()}, b AS (SELECT lower(appId) AS key, true AS p, 0 AS part, pos, NULL AS win FROM pins UNION ALL SELECT lower(appId), false, 1, pos, win FROM open), g AS (SELECT key, bool_or(p) AS pinned, string_agg(win, ',' ORDER BY pos) FILTER (win IS NOT NULL) AS wins, min(part * 1000 + pos) AS first_at FROM b GROUP BY key) SELECT key, pinned, coalesce(wins, '') AS wins, row_number() OVER (ORDER BY first_at) AS place FROM g")
def merged_groups(spark: SparkSession, d: str) -> DataFrame:
    out = records.merged_groups(PINS.df(spark), OPEN.df(spark), "appId", "win")
    return out.select("key", "pinned", F.array_join("values", ",").alias("wins"), F.col("place").cast("long").alias("place"))


@query("SELECT o_custkey, o_orderkey, first_value(o_orderkey) OVER w AS original FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey) QUALIFY row_number() OVER w > 1")
def original_of_group(spark: SparkSession, d: str) -> DataFrame:
    return records.original_of_group(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderkey").select("o_custkey", "o_orderkey", "original")


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'F') AS F FROM orders")
def keyed_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.counts_of(table(spark, d, "orders"), "o_orderstatus", ["O", "F"])


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def rows_per_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT user_id, max(ts) AS latest, bool_or(value > 90) AS some_high, bool_and(value >= 0) AS all_positive, count(DISTINCT event_type) AS kinds, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM events GROUP BY user_id")
def user_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("latest"), F.bool_or(F.col("value") > 90).alias("some_high"), F.bool_and(F.col("value") >= 0).alias("all_positive"), F.countDistinct("event_type").alias("kinds"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("names"))


@query("WITH p AS (SELECT 'm' || n_regionkey AS m, list({'name': n_name, 'cur': '1', 'new': n_nationkey::VARCHAR} ORDER BY n_name) AS packages FROM nation GROUP BY 1) SELECT to_json({'managers': map(list(m ORDER BY m), list({'name': CASE m WHEN 'm0' THEN 'First' ELSE m END, 'packages': packages} ORDER BY m)), 'total': sum(len(packages))::BIGINT})::VARCHAR AS json FROM p")
def update_document(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "nation").select(F.concat(F.lit("m"), "n_regionkey").alias("manager"), F.col("n_name").alias("name"), F.lit("1").alias("cur"), F.col("n_nationkey").cast("string").alias("new"))
    return records.document(p, {"m0": "First"})


@query("WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id FROM labels UNION SELECT doc_id + 1000000 FROM labels WHERE toxic = 1) SELECT doc_id, 'missing' AS side FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b) UNION ALL SELECT doc_id, 'extra' FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)")
def key_difference(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    b = labels.select("doc_id").unionByName(labels.where("toxic = 1").select((F.col("doc_id") + 1000000).alias("doc_id")))
    return records.key_difference(table(spark, d, "documents"), b, ["doc_id"])


_SYNC = "WITH s AS (SELECT doc_id, n_chars AS v FROM documents), t AS (SELECT doc_id, quality::BIGINT AS v FROM labels UNION ALL SELECT doc_id + 1000000, toxic FROM labels) SELECT coalesce(t.doc_id, s.doc_id) AS doc_id, CASE WHEN t.doc_id IS NOT NULL THEN t.v ELSE s.v END AS v FROM t FULL JOIN s ON t.doc_id = s.doc_id"


def _sync(spark: SparkSession, d: str, drop: bool) -> DataFrame:
    labels = table(spark, d, "labels")
    target = labels.select("doc_id", F.col("quality").cast("long").alias("v")).unionByName(labels.select((F.col("doc_id") + 1000000).alias("doc_id"), F.col("toxic").cast("long").alias("v")))
    return records.key_sync(table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("v")), target, "doc_id", "v", drop)


@query(_SYNC)
def key_sync(spark: SparkSession, d: str) -> DataFrame:
    return _sync(spark, d, False)


@query(_SYNC + " WHERE s.doc_id IS NOT NULL")
def key_sync_dropping(spark: SparkSession, d: str) -> DataFrame:
    return _sync(spark, d, True)


ENTRIES = Fixture("entries", "key string, value string", [("a", "x"), ("b", "y /*keep*/"), ("c", "z"), ("d", "w/*keep*/  "), ("e", None)])
USED = Fixture("used", "key string", [("a",), ("e",), ("q",)])


@query(f"WITH {ENTRIES.sql()}, {USED.sql()} SELECT key, value FROM entries WHERE key IN (SELECT key FROM used) OR rtrim(value) LIKE '%/*keep*/'")
def without_unused(spark: SparkSession, d: str) -> DataFrame:
    return records.without_unused(ENTRIES.df(spark), USED.df(spark), "key", "value")


@query("WITH w AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000), p AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) SELECT coalesce(w.k, p.k) AS k, CASE WHEN p.k IS NULL THEN 'install' WHEN w.k IS NULL THEN 'remove' ELSE 'update' END AS action FROM (SELECT DISTINCT k FROM w) w FULL JOIN p ON w.k = p.k")
def partition_requests(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    return records.partition_requests(wanted, table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("WITH w AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000), p AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), x AS (SELECT CASE WHEN p.k IS NULL THEN 'install' WHEN w.k IS NULL THEN 'remove' ELSE 'update' END AS action FROM (SELECT DISTINCT k FROM w) w FULL JOIN p ON w.k = p.k) SELECT action, count(*) AS n FROM x GROUP BY action")
def action_counts(spark: SparkSession, d: str) -> DataFrame:
    return partition_requests(spark, d).groupBy("action").agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT c_custkey AS k, c_nationkey AS g, c_acctbal * 2 AS v FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000, c_nationkey, 1.0 FROM customer WHERE c_custkey % 10 = 0) SELECT coalesce(n.k, c.c_custkey) AS k, coalesce(n.g, c.c_nationkey) AS g, round(CASE WHEN n.k IS NOT NULL THEN n.v ELSE c.c_acctbal END, 4) AS v FROM customer c FULL JOIN n ON c.c_custkey = n.k AND c.c_nationkey = n.g")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("v"))
    new = c.where("k % 3 = 0").withColumn("v", F.col("v") * 2).unionByName(c.where("k % 10 = 0").select((F.col("k") + 1000000).alias("k"), "g", F.lit(1.0).alias("v")))
    return records.upsert(c, new, ["k", "g"]).withColumn("v", F.round("v", 4))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS pinned FROM customer")
def pinned_split(spark: SparkSession, d: str) -> DataFrame:
    pins = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return records.pinned_split(table(spark, d, "customer").select("c_custkey"), pins, "c_custkey")


@query("SELECT s_suppkey FROM supplier")
def semi_unless_empty(spark: SparkSession, d: str) -> DataFrame:
    return records.semi_unless_empty(table(spark, d, "supplier").select("s_suppkey"), table(spark, d, "nation").where("n_name = 'none'").select(F.col("n_nationkey").alias("s_suppkey")), "s_suppkey")


DIRS = Fixture("dirs", "dir string", [("sensible",), ("resurrect",), ("old-theme",), ("res",)])
LISTED = Fixture("listed", "plugin string", [("owner/sensible",), ("https://host/owner/resurrect.git",)])


@query(f"WITH {DIRS.sql()}, {LISTED.sql()} SELECT dir FROM dirs WHERE dir NOT IN (SELECT replace(split_part(plugin, '/', -1), '.git', '') FROM listed)")
def plugins_to_remove(spark: SparkSession, d: str) -> DataFrame:
    return records.not_contained(DIRS.df(spark), LISTED.df(spark), "dir", "plugin")


@query(f"WITH {DIRS.sql()}, {LISTED.sql()} SELECT dir FROM dirs WHERE NOT EXISTS (SELECT 1 FROM listed WHERE contains(plugin, dir))")
def plugins_to_remove_by_text(spark: SparkSession, d: str) -> DataFrame:
    return records.not_contained(DIRS.df(spark), LISTED.df(spark), "dir", "plugin", exact=False)


OLD = Fixture("old", "item string, pos int", [("Bb", 0), ("aa", 1), ("cc", 2)])
NEW = Fixture("new", "item string, pos int", [("dd", 0), ("AA", 1), ("bb", 2)])


@query(f"WITH {OLD.sql()}, {NEW.sql()}, u AS (SELECT item, 0 AS s, pos FROM old WHERE lower(item) IN (SELECT lower(item) FROM new) UNION ALL SELECT item, 1, pos FROM new WHERE lower(item) NOT IN (SELECT lower(item) FROM old)) SELECT item, row_number() OVER (ORDER BY s, pos) AS place FROM u")
def ordered_merge(spark: SparkSession, d: str) -> DataFrame:
    return records.ordered_merge(OLD.df(spark), NEW.df(spark), "item").withColumn("place", F.col("place").cast("long"))


@query("SELECT true AS same")
def same_rows(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return spark.createDataFrame([(records.same_rows(n, n.orderBy(F.desc("n_name"))),)], "same boolean")


SETS = Fixture("sets", "k int, item string", [(1, "a"), (2, "z")])


@query(f"WITH {SETS.sql()} SELECT k, CASE item WHEN 'a' THEN 'b' ELSE 'a,b,z' END AS items FROM sets")
def toggled(spark: SparkSession, d: str) -> DataFrame:
    return SETS.df(spark).select("k", F.array_join(records.toggled(F.array(F.lit("a"), F.lit("b")), F.col("item")), ",").alias("items"))


@query("SELECT s.s_suppkey, coalesce(n.n_name, 'unknown') AS n_name FROM supplier s LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON s.s_nationkey = n.n_nationkey")
def lookup_default(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return records.lookup(table(spark, d, "supplier"), n, "s_nationkey", "n_name", F.lit("unknown")).select("s_suppkey", "n_name")


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_nationkey > 3 AND c.c_nationkey <= 9")
def probe_and_range(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_nationkey > 3 and c_nationkey <= 9")
    return c.join(table(spark, d, "orders"), c.c_custkey == F.col("o_custkey")).select("c_custkey", "o_orderkey")


IDS = Fixture("ids", "pos int, n_nationkey int", [(0, 7), (1, 2), (2, 11), (3, 99)])


@query(f"WITH {IDS.sql()} SELECT pos, n_nationkey, n_name FROM ids JOIN nation USING (n_nationkey)")
def ordered_records(spark: SparkSession, d: str) -> DataFrame:
    return records.ordered_records(IDS.df(spark), table(spark, d, "nation"), "n_nationkey").select("pos", "n_nationkey", "n_name")


RULES = [("reboot", "restart_alt"), ("record", "screen_record"), ("startswith:file", "folder_copy"), ("battery", "power")]
SUMMARIES = Fixture("summaries", "s string", [("Battery low, reboot",), ("File saved",), ("a file",), ("Recording",), ("",)])


@query(f"WITH {SUMMARIES.sql()} SELECT s, CASE WHEN contains(lower(s), 'reboot') THEN 'restart_alt' WHEN contains(lower(s), 'record') THEN 'screen_record' WHEN starts_with(lower(s), 'file') THEN 'folder_copy' WHEN contains(lower(s), 'battery') THEN 'power' ELSE 'chat' END AS symbol FROM summaries")
def keyword_rules(spark: SparkSession, d: str) -> DataFrame:
    return records.first_rule(SUMMARIES.df(spark), "s", RULES, "chat", "symbol")


NAMES = Fixture("names", "name string", [("code-url-handler",), ("Firefox",), ("org.kde.app",), ("steam_app_12",), ("other",)])


@query(f"WITH {NAMES.sql()} SELECT name, CASE WHEN name = 'code-url-handler' THEN 'visual-studio-code' WHEN lower(name) = 'firefox' THEN 'firefox' WHEN regexp_matches(name, '^steam_app_') THEN 'steam' WHEN contains(name, '.') THEN split_part(name, '.', -1) ELSE name END AS icon FROM names")
def icon_cascade(spark: SparkSession, d: str) -> DataFrame:
    steps = (lambda n: F.when(n == "code-url-handler", "visual-studio-code"), lambda n: F.when(F.lower(n) == "firefox", "firefox"), lambda n: F.when(n.rlike("^steam_app_"), "steam"), lambda n: F.when(n.contains("."), F.substring_index(n, ".", -1)))
    return NAMES.df(spark).select("name", records.cascade(F.col("name"), *steps).alias("icon"))


@query("SELECT p_partkey, replace(replace(p_name, 'a', 'b'), 'b', 'c') AS text FROM part")
def replaced_in_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", records.replaced_in_order(F.col("p_name"), [("a", "b"), ("b", "c")]).alias("text"))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return records.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("SELECT string_agg(i || '. ' || n_name, chr(10) ORDER BY i) || chr(10) || '… and 22 more' AS text FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) WHERE i <= 3")
def limited_text(spark: SparkSession, d: str) -> DataFrame:
    return records.limited_text(table(spark, d, "nation"), "n_name", 3, F.col("n_nationkey"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 200 OFFSET 200")
def second_page(spark: SparkSession, d: str) -> DataFrame:
    return records.page(table(spark, d, "orders").select("o_orderkey"), 200, 200, F.col("o_orderkey"))


@query("SELECT event_id FROM (SELECT event_id FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 5)")
def reversed_head(spark: SparkSession, d: str) -> DataFrame:
    return records.reversed_head(table(spark, d, "events").where("event_type = 'click'").select("event_id"), 5, "event_id")


@query("SELECT n_name, row_number() OVER (ORDER BY n_name <> 'FRANCE', n_name) AS place FROM nation")
def pinned_first(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return table(spark, d, "nation").select("n_name", F.row_number().over(Window.orderBy(F.col("n_name") != "FRANCE", "n_name")).cast("long").alias("place"))


DEVICES = Fixture("devices", "name string, connected boolean, paired boolean", [("zed", False, True), ("AA:BB:CC:DD:EE:FF", False, True), ("amp", True, True), ("bud", False, False)])


@query(f"WITH {DEVICES.sql()} SELECT * FROM devices")
def by_connection(spark: SparkSession, d: str) -> DataFrame:
    return records.by_connection(DEVICES.df(spark), "connected", "paired", "name")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey IN (7, 2, 11) ORDER BY CASE n_nationkey WHEN 7 THEN 0 WHEN 2 THEN 1 ELSE 2 END LIMIT 1")
def first_available(spark: SparkSession, d: str) -> DataFrame:
    return records.first_available(IDS.df(spark), table(spark, d, "nation").select("n_nationkey"), "n_nationkey").select("n_nationkey")


@query("SELECT event_id AS path, row_number() OVER (ORDER BY ts DESC, event_id) > 5 AND ts < TIMESTAMP '2024-02-01' - INTERVAL 10 DAY AS deleted FROM events")
def retention(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("path"), F.col("ts").alias("modified"))
    return records.retained(e, F.lit("2024-02-01").cast("timestamp"), 5, 10).select("path", "deleted")


# ---- series

_FIRST, _LAST = "first_value(value) OVER f", "last_value(value) OVER f"


@query(f"SELECT event_id, round((value + coalesce(lag(value, 1) OVER w, {_FIRST}) + coalesce(lag(value, 2) OVER w, {_FIRST}) + coalesce(lead(value, 1) OVER w, {_LAST}) + coalesce(lead(value, 2) OVER w, {_LAST})) / 5, 6) AS smooth FROM events WINDOW w AS (PARTITION BY user_id {EV}), f AS (PARTITION BY user_id {EV} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def clamped_average(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(series.clamped_average(F.col("value"), ["user_id"], ["ts", "event_id"]), 6).alias("smooth"))


@query(f"WITH x AS (SELECT event_id, value - lag(value) OVER w AS i, event_id - lag(event_id) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id {EV})) SELECT event_id, CASE WHEN t IS NULL THEN NULL WHEN t > 0 THEN 1 - i / t ELSE 0 END AS usage FROM x")
def sample_usage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", series.usage(F.col("value"), F.col("event_id"), ["user_id"], ["ts", "event_id"]).alias("usage"))


@query(f"SELECT event_id, round(value - coalesce(lag(value) OVER (PARTITION BY user_id {EV}), 0), 6) AS delta FROM events")
def lap_delta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(series.delta(F.col("value"), ["user_id"], ["ts", "event_id"]), 6).alias("delta"))


@query(f"SELECT * FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id {EV}) - 1 AS index, event_type FROM events) WHERE event_type = 'view'")
def numbered_then_filtered(spark: SparkSession, d: str) -> DataFrame:
    out = series.numbered(table(spark, d, "events"), ["user_id"], F.col("ts"), F.col("event_id"))
    return out.where("event_type = 'view'").select("event_id", F.col("index").cast("long").alias("index"), "event_type")


@query(f"SELECT event_id, lag(event_type) OVER (PARTITION BY user_id {EV}) IS DISTINCT FROM event_type AS changed FROM events")
def changes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", series.changed(F.col("event_type"), ["user_id"], ["ts", "event_id"]).alias("changed"))


@query(f"SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id {EV} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id FROM events")
def next_marked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", series.next_marked(F.col("event_id"), F.col("event_type") == "purchase", ["user_id"], ["ts", "event_id"]).alias("next_id"))


@query(f"SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id {EV} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM events")
def last_heading(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", series.last_heading(F.when(F.col("event_type") == "purchase", F.col("event_id")), ["user_id"], ["ts", "event_id"]).alias("heading"))


@query(f"SELECT event_id, round(100.0 * row_number() OVER (PARTITION BY user_id {EV}) / count(*) OVER (PARTITION BY user_id), 6) AS percent FROM events")
def progress(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(series.progress(["user_id"], ["ts", "event_id"]), 6).alias("percent"))


# ---- the same along the order of the whole table, which is one key

_ALL_ORDER = "ORDER BY ts, event_id"


@query(f"SELECT event_id, round((value + coalesce(lag(value, 1) OVER w, {_FIRST}) + coalesce(lag(value, 2) OVER w, {_FIRST}) + coalesce(lead(value, 1) OVER w, {_LAST}) + coalesce(lead(value, 2) OVER w, {_LAST})) / 5, 6) AS smooth FROM events WINDOW w AS ({_ALL_ORDER}), f AS ({_ALL_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def smoothed_all(spark: SparkSession, d: str) -> DataFrame:
    out = scans.clamped_average(table(spark, d, "events"), F.col("value"), [], ["ts", "event_id"], "smooth")
    return out.select("event_id", F.round("smooth", 6).alias("smooth"))


@query(f"SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM events")
def purchases_around(spark: SparkSession, d: str) -> DataFrame:
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    out = scans.around(table(spark, d, "events").select("event_id", "event_type", "ts"), bought, [], ["ts", "event_id"], last="heading", following="next_id")
    return out.select("event_id", "next_id", "heading")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER w AS number, round(100.0 * row_number() OVER w / count(*) OVER (PARTITION BY l_returnflag), 6) AS percent, round(sum(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS shipped FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)")
def shipped_so_far(spark: SparkSession, d: str) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    out = scans.numbered(table(spark, d, "lineitem").select("l_returnflag", *order), ["l_returnflag"], order, percent="percent", shipped=F.col("l_quantity"))
    return out.select("l_orderkey", "l_linenumber", "number", F.round("percent", 6).alias("percent"), F.round("shipped", 2).alias("shipped"))


@query("SELECT n_nationkey, (n_nationkey // 10)::BIGINT AS bucket, n_nationkey % 10 AS place, (n_nationkey // 10) * 10 + 3 AS same FROM nation")
def buckets(spark: SparkSession, d: str) -> DataFrame:
    b, p = series.bucket(F.col("n_nationkey") + 1, 10)
    return table(spark, d, "nation").select("n_nationkey", b.alias("bucket"), p.alias("place"), series.same_bucket(F.col("n_nationkey") + 1, 3).cast("int").alias("same"))


@query("SELECT k.r AS n_regionkey, g.i AS n_nationkey, EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = k.r AND n.n_nationkey = g.i) AS occupied FROM (SELECT DISTINCT n_regionkey AS r FROM nation) k, (SELECT unnest(range(0, 10))::INTEGER AS i) g")
def occupancy(spark: SparkSession, d: str) -> DataFrame:
    return series.occupancy(table(spark, d, "nation"), "n_regionkey", "n_nationkey", 0, 9)


@query(f"SELECT event_id FROM (SELECT event_id, value > 50 AS c, lag(value > 50) OVER (PARTITION BY user_id {EV}) AS b FROM events) WHERE c AND NOT b")
def rising_edges(spark: SparkSession, d: str) -> DataFrame:
    return series.rising_edges(table(spark, d, "events"), F.col("value") > 50, ["user_id"], ["ts", "event_id"]).select("event_id")
