"""Queries over semi-structured lines, filters and projections, rectangles, pixels and streams."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlow.operators import geometry, greedy, images, rectangles
from marlow.plans.catalog import Fixture, query, table
from marlow.sources import files
from marlow.sources.shared import scratch
from marlow.streaming import stateful, timers

_C = F.col

# ---- lines of text

EMOJI = Fixture("emoji", "text string", [("#!/bin/sh\necho\n### DATA ###\n😀 grin\n\n🚀 rocket\n",), ("no data",)])


@query("SELECT * FROM (VALUES ('😀 grin'), ('🚀 rocket')) t(line)")
def after_sentinel(spark: SparkSession, d: str) -> DataFrame:
    return files.after_sentinel(EMOJI.df(spark), "text", "### DATA ###").select("line")


SAVED = Fixture("saved", "line string", [("pane\t0\t1\t:bash\t1\t:*\t0\t:/tmp\t1\tbash\t:",), ("window\t0\t1\t1\t:*\tabc",), ("state\tblue\tred",), ("pane\tblue\t0\t:vim\t1\t:-\t1\t:/x\t0\tvim\t:vim a.txt",), ("grouped_session\tblue\t0\t:1\t:0",)])
PANE = ["session", "window", "window_name", "window_active", "flags", "pane", "dir", "active", "command", "full_command"]


@query("SELECT * FROM (VALUES ('0', 1, 'bash', true, '*', 0, '/tmp', true, 'bash', ''), ('blue', 0, 'vim', true, '-', 1, '/x', false, 'vim', 'vim a.txt')) t(session, \"window\", window_name, window_active, flags, pane, dir, active, command, full_command)")
def tagged_panes(spark: SparkSession, d: str) -> DataFrame:
    p = files.tagged(SAVED.df(spark), "line", "pane", PANE)
    return p.withColumns({"window": _C("window").cast("int"), "pane": _C("pane").cast("int"), "window_active": _C("window_active") == "1", "active": _C("active") == "1"})


@query("SELECT '0' AS session, 1 AS n UNION ALL SELECT 'blue', 1 LIMIT 1")
def ungrouped_panes(spark: SparkSession, d: str) -> DataFrame:
    grouped = files.tagged(SAVED.df(spark), "line", "grouped_session", ["session", "original", "alternate", "active"])
    p = files.tagged(SAVED.df(spark), "line", "pane", PANE).join(grouped, "session", "left_anti")
    return p.groupBy("session").agg(F.count("*").cast("int").alias("n"))


@query("SELECT 'blue' AS session, 'vim a.txt' AS full_command")
def marked_panes(spark: SparkSession, d: str) -> DataFrame:
    p = files.tagged(SAVED.df(spark), "line", "pane", PANE)
    return p.where((_C("window_active") == "1") & _C("flags").rlike("[*-]") & (_C("full_command") != "") & _C("command").rlike("^vim( |$)")).select("session", "full_command")


SCAN = Fixture("scan", "line string", [("yes:80:5180 MHz:home:AA\\:BB:WPA2",), ("no:60:2412 MHz:cafe\\:bar:CC\\:DD:",), ("no:90:2437 MHz::EE\\:FF:WPA1",), ("no:70:2412 MHz:home:11\\:22:WPA2",), ("no:75:2412 MHz:cafe\\:bar:33\\:44:",)])
_APS = "(VALUES (true, 80, 5180, 'home', 'AA:BB', 'WPA2'), (false, 60, 2412, 'cafe:bar', 'CC:DD', ''), (false, 70, 2412, 'home', '11:22', 'WPA2'), (false, 75, 2412, 'cafe:bar', '33:44', '')) t(active, strength, frequency, ssid, bssid, security)"


@query(f"SELECT * FROM {_APS}")
def access_points(spark: SparkSession, d: str) -> DataFrame:
    return files.access_points(SCAN.df(spark), "line")


@query(f"SELECT ssid, bssid FROM {_APS} WHERE bssid IN ('AA:BB', '33:44')")
def best_access_points(spark: SparkSession, d: str) -> DataFrame:
    from marlow.operators.records import best_access_point

    aps = files.access_points(SCAN.df(spark).coalesce(1), "line").withColumn("pos", F.monotonically_increasing_id())
    return best_access_point(aps, "ssid", _C("active"), _C("strength"), "pos").select("ssid", "bssid")


OS = Fixture("os", "text string", [('NAME="Some Linux"\nID=some\nHOME_URL="https://x.y/"\n# c\n',)])


@query("SELECT * FROM (VALUES ('NAME', 'Some Linux'), ('ID', 'some'), ('HOME_URL', 'https://x.y/')) t(key, value)")
def assignments(spark: SparkSession, d: str) -> DataFrame:
    return files.assignments(OS.df(spark), "text")


SCSS = Fixture("scss", "line string", [("$primary: #AABBCC;",), ("// $no: #000000;",), ("$on-primary : #010203 ;",), ("$x: red;",)])


@query("SELECT * FROM (VALUES ('primary', '#AABBCC'), ('on-primary', '#010203')) t(name, colour)")
def style_colours(spark: SparkSession, d: str) -> DataFrame:
    return files.style_colours(SCSS.df(spark), "line")


PROC = Fixture("proc", "text string", [("MemTotal:       16000 kB\nMemFree:  4000 kB\ncpu  1 2 3 40 5 6 7\ncpu0 1 1 1 1\n",)])


@query("SELECT 16000::BIGINT AS total, 4000::BIGINT AS free, 64::BIGINT AS counters, 40::BIGINT AS idle")
def sampled_status(spark: SparkSession, d: str) -> DataFrame:
    c = files.cpu_counters(_C("text"))
    return PROC.df(spark).select(files.sampled(_C("text"), "MemTotal").alias("total"), files.sampled(_C("text"), "MemFree").alias("free"), F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x).alias("counters"), F.get(c, F.lit(3)).alias("idle"))


UPDATES = Fixture("updates", "line string", [("zlib 1.2 -> 1.3",), ("acl 2 -> 3",), ("note only",), ("",)])
SNAPS = Fixture("snaps", "line string", [("Name  Version Rev",), ("core 16 22",)])


@query("SELECT * FROM (VALUES ('pacman', 'zlib', '1.2', '1.3'), ('pacman', 'acl', '2', '3'), ('snap', 'core', '', '16')) t(manager, name, cur, new)")
def package_updates(spark: SparkSession, d: str) -> DataFrame:
    return files.packages(UPDATES.df(spark), "pacman", "line").unionByName(files.packages(SNAPS.df(spark), "snap", "line", arrow=False))


@query("SELECT 2::BIGINT AS pacman, 1::BIGINT AS snap")
def update_counts(spark: SparkSession, d: str) -> DataFrame:
    return package_updates(spark, d).groupBy().pivot("manager", ["pacman", "snap"]).agg(F.count(F.lit(1)))


SSE = Fixture("sse", "seq int, line string", [(0, ": ping"), (1, 'data: {"a": 1}'), (2, ""), (3, "data: [DONE]"), (4, 'data:{"a": 2}')])


@query("SELECT * FROM (VALUES (1, '1'), (4, '2')) t(seq, a)")
def event_lines(spark: SparkSession, d: str) -> DataFrame:
    return SSE.df(spark).select("seq", F.get_json_object(files.event_data(_C("line")), "$.a").alias("a")).where("a is not null")


FRAMES = Fixture("frames", "k int, seq int, line string", [(0, 0, "["), (0, 1, '{"a":'), (0, 2, "1}"), (0, 3, ","), (0, 4, '{"a": 2}'), (0, 5, "]"), (1, 0, '{"a": 9}')])


@query("SELECT * FROM (VALUES (0, '1'), (0, '2'), (1, '9')) t(k, a)")
def framed_array(spark: SparkSession, d: str) -> DataFrame:
    return files.framed(FRAMES.df(spark), "k").select("k", F.get_json_object("json", "$.a").alias("a"))


WEATHER = Fixture("weather", "raw string", [('{"current_condition":[{"temp_C":"7","temp_F":"45","humidity":"80","windspeedKmph":"","windspeedMiles":"3"}],"nearest_area":[{"areaName":[{"value":"Paris"}]}],"weather":[{"astronomy":[{"sunrise":"06:01","sunset":"20:00"}]}]}',), ("{}",)])


@query("SELECT * FROM (VALUES ('Paris', '7°C', '0 km/h', '06:01', '80%', '113', '45°F'), ('City', '0°C', '0 km/h', '0.0', '0%', '113', '0°F')) t(city, temp, wind, sunrise, humidity, \"wCode\", temp_us)")
def weather_rows(spark: SparkSession, d: str) -> DataFrame:
    w = WEATHER.df(spark).select(files.weather(_C("raw")).alias("w"))
    return w.select(files.weather_row(_C("w"), False).alias("m"), files.weather_row(_C("w"), True)["temp"].alias("temp_us")).select("m.city", "m.temp", "m.wind", "m.sunrise", "m.humidity", "m.wCode", "temp_us")


@query("SELECT 'http://x/1.png' AS url")
def first_url(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(files.first_url(F.lit('[{"file_url":"http://x/1.png"},{"file_url":"b"}]')).alias("url"))


POSTS_A = Fixture("posts_a", "id long, width int, height int, tags string, rating string, md5 string, file_url string, source string", [(1, 200, 100, "a b", "safe", "m", "http://h/x.png", None), (2, 10, 0, "c", "explicit", "n", "http://h/y.webm", "s")])
POSTS_B = Fixture("posts_b", "pid long, w int, h int, tag_string string, rating string, url string, score int", [(3, 5, 10, "z", "general", "http://b/z.jpg", 7)])


@query("SELECT * FROM (VALUES (1, 2.0, 's', false, 'png'), (2, NULL, 'e', true, 'webm'), (3, 0.5, 's', false, 'jpg')) t(id, aspect_ratio, rating, is_nsfw, file_ext)")
def image_posts(spark: SparkSession, d: str) -> DataFrame:
    a = files.posts(POSTS_A.df(spark), {"preview_url": "file_url"})
    b = files.posts(POSTS_B.df(spark), {"id": "pid", "width": "w", "height": "h", "tags": "tag_string", "file_url": "url"})
    return files.union_posts(a, b).select(_C("id").cast("int").alias("id"), "aspect_ratio", "rating", "is_nsfw", "file_ext")


TAGS = Fixture("tags", "name string, count int", [("a", 3)])


@query("SELECT 'a' AS name, 3 AS count UNION ALL SELECT 'b', NULL")
def union_missing_column(spark: SparkSession, d: str) -> DataFrame:
    return files.union_posts(TAGS.df(spark), spark.createDataFrame([("b",)], "name string"))


KV = Fixture("kv", "pos int, line string", [(0, "a=1"), (1, "# note"), (2, "b = 2")])


@query("SELECT * FROM (VALUES ('a=9'), ('# note'), ('b = 2'), ('c=3')) t(line)")
def updated_config(spark: SparkSession, d: str) -> DataFrame:
    return files.updated_config(KV.df(spark), spark.createDataFrame([("a", "9"), ("c", "3")], "key string, value string")).select("line")


@query("SELECT 'nation' || chr(9) || n_nationkey || chr(9) || n_name AS line FROM nation UNION ALL SELECT 'region' || chr(9) || r_regionkey || chr(9) || r_name FROM region")
def tagged_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.tagged_lines(("nation", table(spark, d, "nation").select("n_nationkey", "n_name")), ("region", table(spark, d, "region").select("r_regionkey", "r_name")))


@query("SELECT '$' || n_name || ': ' || n_nationkey || ';' AS line FROM nation")
def style_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.style_lines(table(spark, d, "nation").withColumn("v", _C("n_nationkey").cast("string")), "n_name", "v")


OSWIN = "wins array<struct<tabs:array<struct<windows:array<struct<id:int,is_focused:boolean>>>>>>"


@query("SELECT 3 AS id UNION ALL SELECT 5")
def unfocused_siblings(spark: SparkSession, d: str) -> DataFrame:
    doc = [([([([(1, False)],), ([(3, False), (4, True), (5, False)],)],), ([([(9, False)],)],)],)]
    return files.unfocused_siblings(spark.createDataFrame(doc, OSWIN), "wins", 4)


# ---- filters and projections over the tables


@query("SELECT event_id FROM events WHERE event_type <> 'view' AND value > 20 AND starts_with(event_type, 'p') AND NOT regexp_matches(event_type, '(?i)^REFUND') AND coalesce(value > 1, true)")
def filter_chain(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where((_C("event_type") != "view") & (_C("value") > 20) & _C("event_type").startswith("p") & ~_C("event_type").rlike("(?i)^REFUND") & F.coalesce(_C("value") > 1, F.lit(True))).select("event_id")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE (starts_with(p_type, 'PROMO') OR starts_with('PROMO', p_type)) AND p_size >= 5 AND (NULL IS NULL OR p_size <= NULL) AND p_name <> ''")
def prefix_and_bounds(spark: SparkSession, d: str) -> DataFrame:
    most = F.lit(None).cast("int")
    both = _C("p_type").startswith("PROMO") | F.lit("PROMO").startswith(_C("p_type"))
    return table(spark, d, "part").where(both & (_C("p_size") >= 5) & (most.isNull() | (_C("p_size") <= most)) & (_C("p_name") != "")).select("p_partkey", "p_name", "p_type")


@query("SELECT page_id, regexp_matches(url, '(\\.org|\\.net)') AS watch, CASE WHEN page_id % 3 IN (0, 1) THEN page_id % 3 ELSE 0 END AS choice FROM pages WHERE NOT ends_with(url, '9')")
def url_classes(spark: SparkSession, d: str) -> DataFrame:
    k = _C("page_id") % 3
    return table(spark, d, "pages").where(~_C("url").endswith("9")).select("page_id", _C("url").rlike(r"(\.org|\.net)").alias("watch"), F.when(k.isin(0, 1), k).otherwise(0).alias("choice"))


@query("SELECT conv_id, turn FROM conversations WHERE role <> 'system'")
def visible_messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where(_C("role") != "system").select("conv_id", "turn")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * 2 AS price_x, CASE WHEN l_returnflag = 'R' THEN 'us' ELSE 'eu' END AS unit, round(l_extendedprice / l_quantity, 6) AS ratio FROM lineitem WHERE l_quantity > 45")
def projections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", (_C("l_extendedprice") * 2).alias("price_x"), F.when(_C("l_returnflag") == "R", "us").otherwise("eu").alias("unit"), F.round(_C("l_extendedprice") / _C("l_quantity"), 6).alias("ratio"))


@query("SELECT n_nationkey, string_split('ab cd ef gh ij', ' ')[4]::VARCHAR || n_name AS picked, unnest(range(0, 3))::INTEGER AS k FROM nation")
def positional(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.concat(F.get(F.split(F.lit("ab cd ef gh ij"), " "), F.lit(3)), _C("n_name")).alias("picked"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))


@query("SELECT n_name, z.c AS code FROM nation, (VALUES (0, 'x'), (1, 'y'), (2, 'z')) z(i, c) WHERE n_nationkey % 3 = z.i")
def index_join(spark: SparkSession, d: str) -> DataFrame:
    zipped = spark.range(1).select(F.explode(F.arrays_zip(F.array(*[F.lit(i) for i in range(3)]).alias("i"), F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("c"))).alias("z")).select("z.*").toDF("i", "code")
    return table(spark, d, "nation").withColumn("i", _C("n_nationkey") % 3).join(F.broadcast(zipped), "i").select("n_name", "code")  # three rows


# ---- rectangles

_RECTS = "r AS (SELECT p_partkey AS k, (p_partkey * 37 % 1000)::DOUBLE AS x, (p_partkey * 61 % 800)::DOUBLE AS y, (10 + p_size)::DOUBLE AS w, (5 + p_size)::DOUBLE AS h FROM part)"
_BOTH = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
_IOU = f"{_BOTH} / (a.w * a.h + b.w * b.h - {_BOTH})"


def _rects(spark: SparkSession, d: str) -> DataFrame:
    k = _C("p_partkey")
    size = lambda n: (_C("p_size") + n).cast("double")
    return table(spark, d, "part").select(k.alias("k"), F.struct((k * 37 % 1000).cast("double").alias("x"), (k * 61 % 800).cast("double").alias("y"), size(10).alias("width"), size(5).alias("height")).alias("rect"))


@query(f"WITH {_RECTS} SELECT a.k FROM r a WHERE a.k % 2 = 0 AND NOT EXISTS (SELECT 1 FROM r b WHERE b.k % 10 = 1 AND {_IOU} > 0)")
def rect_anti(spark: SparkSession, d: str) -> DataFrame:
    r = _rects(spark, d)
    return rectangles.without_overlap(r.where("k % 2 = 0"), r.where("k % 10 = 1"), "k").select("k")


@query(f"WITH {_RECTS} SELECT a.k FROM r a WHERE a.k % 2 = 0 AND NOT EXISTS (SELECT 1 FROM r b WHERE b.k % 10 = 1 AND {_IOU} > 0.1)")
def rect_anti_threshold(spark: SparkSession, d: str) -> DataFrame:
    r = _rects(spark, d)
    return rectangles.without_overlap(r.where("k % 2 = 0"), r.where("k % 10 = 1"), "k", threshold=0.1).select("k")


@query(f"WITH {_RECTS} SELECT a.k FROM r a WHERE a.k % 2 = 0 AND NOT EXISTS (SELECT 1 FROM r b WHERE b.k % 2 = 1 AND {_IOU} > 0.25)")
def rect_anti_halves(spark: SparkSession, d: str) -> DataFrame:
    r = _rects(spark, d)
    return rectangles.without_overlap(r.where("k % 2 = 0"), r.where("k % 2 = 1"), "k", threshold=0.25).select("k")


@query(f"WITH {_RECTS} SELECT a.k AS left_key, b.k AS right_key, round({_IOU}, 9) AS iou FROM r a JOIN r b ON a.k < b.k AND {_IOU} > 0.4")
def rect_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = _rects(spark, d)
    return rectangles.overlapping(r, r, "k", least=0.4, told=lambda iou: F.round(iou, 9)).where("left_key < right_key")


@query(f"WITH {_RECTS}, p AS (SELECT c_custkey AS pt, (c_custkey * 29 % 1000)::DOUBLE AS px, (c_custkey * 17 % 800)::DOUBLE AS py FROM customer), f AS (SELECT pt, k, x FROM p JOIN r ON px BETWEEN x AND x + w AND py BETWEEN y AND y + h QUALIFY row_number() OVER (PARTITION BY pt ORDER BY k % 3, k) = 1) SELECT p.pt, f.k, f.x AS left_edge FROM p LEFT JOIN f USING (pt)")
def customer_in_rect(spark: SparkSession, d: str) -> DataFrame:
    c, r = _C("c_custkey"), _rects(spark, d).withColumns({"priority": _C("k") % 3, "pos": _C("k")})
    p = table(spark, d, "customer").select(c.alias("pt"), (c * 29 % 1000).cast("double").alias("x"), (c * 17 % 800).cast("double").alias("y"))
    return rectangles.first_containing(p, r, "pt").select("pt", "k", _C("rect.x").alias("left_edge"))


@query(f"WITH {_RECTS}, p AS (SELECT i AS pt, (i * 29 % 1000)::DOUBLE AS px, (i * 17 % 800)::DOUBLE AS py FROM range(0, 300) t(i)), f AS (SELECT pt, k FROM p JOIN r ON px BETWEEN x AND x + w AND py BETWEEN y AND y + h QUALIFY row_number() OVER (PARTITION BY pt ORDER BY k % 3, k) = 1) SELECT p.pt, f.k FROM p LEFT JOIN f USING (pt)")
def point_in_rect(spark: SparkSession, d: str) -> DataFrame:
    r = _rects(spark, d).withColumns({"priority": _C("k") % 3, "pos": _C("k")})
    p = spark.range(300).select(_C("id").alias("pt"), (_C("id") * 29 % 1000).cast("double").alias("x"), (_C("id") * 17 % 800).cast("double").alias("y"))
    return rectangles.first_containing(p, r, "pt").select("pt", "k")


@query(f"WITH {_RECTS} SELECT a.k, round({_IOU}, 9) AS iou, a.x - 5 AS x, a.y - 7 AS y FROM r a, r b WHERE b.k = 1")
def overlap_ratio(spark: SparkSession, d: str) -> DataFrame:
    r = _rects(spark, d)
    one = r.where("k = 1").select(_C("rect").alias("b"))
    m = geometry.moved(_C("rect"), F.lit(5.0), F.lit(7.0))
    return r.crossJoin(F.broadcast(one)).select("k", F.round(geometry.iou(_C("rect"), _C("b")), 9).alias("iou"), m["x"].alias("x"), m["y"].alias("y"))  # one row


def _screens(spark: SparkSession, d: str) -> DataFrame:
    """Every rectangle, on screens of 400 neighbouring keys, so that no group grows with the table."""
    return _rects(spark, d).withColumns({"g": F.expr("k div 400"), "pos": _C("k")})


# Rectangles of a screen one after the other: those that overlap none kept before them are kept.
_KEPT = "WITH RECURSIVE " + _RECTS + """, o AS (SELECT k // 400 AS g, k, x, y, w, h, row_number() OVER (PARTITION BY k // 400 ORDER BY w * h DESC, k) AS n FROM r),
    s AS (
        SELECT g, 0::BIGINT AS n, []::STRUCT(k BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[] AS kept FROM o GROUP BY g
        UNION ALL
        SELECT s.g, o.n, CASE WHEN len(list_filter(s.kept, lambda b: (greatest(0, least(o.x + o.w, b.x + b.w) - greatest(o.x, b.x)) * greatest(0, least(o.y + o.h, b.y + b.h) - greatest(o.y, b.y)))
                / (o.w * o.h + b.w * b.h - greatest(0, least(o.x + o.w, b.x + b.w) - greatest(o.x, b.x)) * greatest(0, least(o.y + o.h, b.y + b.h) - greatest(o.y, b.y))) >= 0.3)) > 0
            THEN s.kept ELSE list_append(s.kept, {'k': o.k, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}) END
        FROM s JOIN o ON o.g = s.g AND o.n = s.n + 1
    ) SELECT g, unnest(kept).k AS k FROM s QUALIFY n = max(n) OVER (PARTITION BY g)"""


@query(_KEPT)
def suppressed(spark: SparkSession, d: str) -> DataFrame:
    r = _screens(spark, d)
    return geometry.suppress(r, "g", 0.3).select("g", "k")


# A rectangle that is left removes those behind it that it overlaps and that are no smaller, up to the first smaller one, which removes it.
_SMALLER = "WITH RECURSIVE " + _RECTS + f""", o AS (SELECT k // 400 AS g, k, x, y, w, h, row_number() OVER (PARTITION BY k // 400 ORDER BY k) AS n FROM r),
    l AS (SELECT a.g, a.n, list({{'k': b.k, 'less': a.w * a.h > b.w * b.h}} ORDER BY b.k) AS js FROM o a JOIN o b ON a.g = b.g AND b.k > a.k WHERE {_BOTH} > 0 GROUP BY a.g, a.n),
    s AS (
        SELECT g, 0::BIGINT AS n, []::BIGINT[] AS gone FROM o GROUP BY g
        UNION ALL
        SELECT g, n, CASE WHEN list_contains(gone, k) OR js IS NULL THEN gone WHEN first IS NULL THEN gone || list_transform(js, lambda j: j.k::BIGINT)
            ELSE gone || list_transform(list_filter(js, lambda j: j.k < first), lambda j: j.k::BIGINT) || [k::BIGINT] END
        FROM (SELECT *, list_filter(js, lambda j: j.less)[1].k AS first FROM (SELECT s.g, o.n, o.k, s.gone, list_filter(l.js, lambda j: NOT list_contains(s.gone, j.k::BIGINT)) AS js FROM s JOIN o ON o.g = s.g AND o.n = s.n + 1 LEFT JOIN l ON l.g = o.g AND l.n = o.n))
    ), e AS (SELECT g, gone FROM s QUALIFY n = max(n) OVER (PARTITION BY g)) SELECT o.g, o.k FROM o JOIN e ON e.g = o.g WHERE NOT list_contains(e.gone, o.k::BIGINT)"""


@query(_SMALLER)
def kept_smaller(spark: SparkSession, d: str) -> DataFrame:
    r = _screens(spark, d)
    return geometry.keep_smaller(r, "g").select("g", "k")


# All rectangles on one screen.
@query(_KEPT.replace("k // 400", "0").replace("SELECT g, unnest", "SELECT unnest"))
def suppressed_all(spark: SparkSession, d: str) -> DataFrame:
    return greedy.suppress(_rects(spark, d).withColumn("pos", _C("k")), 0.3).select("k")


@query()  # the recursion over all parts takes minutes in SQL; tests/test_greedy.py compares it with a loop
def kept_smaller_all(spark: SparkSession, d: str) -> DataFrame:
    return greedy.keep_smaller(_rects(spark, d).withColumn("pos", _C("k"))).select("k")


PLAYERS = Fixture("players", "g int, pos int, title string, position double, length double, art string", [(0, 0, "Song", 10.0, 200.0, ""), (0, 1, "Song - Artist", 50.0, 90.0, "art"), (0, 2, "Other", 11.0, 201.0, None), (0, 3, "Third", 99.0, 300.0, None)])


@query("SELECT * FROM (VALUES (0, 0, false), (1, 0, true), (2, 0, false), (3, 3, true)) t(pos, cluster, chosen)")
def player_clusters(spark: SparkSession, d: str) -> DataFrame:
    return geometry.cluster_players(PLAYERS.df(spark), "g").select("pos", "cluster", "chosen")


# ---- pixels

_PIX = "p AS (SELECT n % 2 AS img, (n // 2) // 20 AS y, (n // 2) % 20 AS x, (n * n * 7 + n * 13) % 256 AS val FROM range(0, 800) t(n))"


def _pixels(spark: SparkSession) -> DataFrame:
    n = _C("id")
    return spark.range(800).select((n % 2).alias("img"), F.expr("(id div 2) div 20").alias("y"), (F.expr("id div 2") % 20).alias("x"), ((n * n * 7 + n * 13) % 256).alias("val"))


_RGB = "SELECT img, val AS r, (val * 3) % 256 AS g, (val * 5 + 1) % 256 AS b FROM p"


def _colours(spark: SparkSession) -> DataFrame:
    return _pixels(spark).select("img", _C("val").alias("r"), (_C("val") * 3 % 256).alias("g"), ((_C("val") * 5 + 1) % 256).alias("b"))


@query(f"WITH {_PIX}, c AS ({_RGB}), q AS (SELECT img, sqrt(var_pop(r - g) + var_pop((r + g) / 2.0 - b)) + 0.3 * sqrt(avg(r - g) ^ 2 + avg((r + g) / 2.0 - b) ^ 2) AS v FROM c GROUP BY img) SELECT img, round(v, 6) AS colourfulness, CASE WHEN v < 20 THEN 'scheme-content' WHEN v < 50 THEN 'scheme-neutral' ELSE 'scheme-tonal-spot' END AS scheme FROM q")
def colourfulness(spark: SparkSession, d: str) -> DataFrame:
    c = images.colourfulness(_colours(spark))
    return c.select("img", F.round("colourfulness", 6).alias("colourfulness"), images.scheme(_C("colourfulness")).alias("scheme"))


@query(f"WITH {_PIX} SELECT a.img, a.y, a.x, (SELECT sum(val) FROM p b WHERE b.img = a.img AND b.y <= a.y AND b.x <= a.x)::BIGINT AS s FROM p a")
def integral_image(spark: SparkSession, d: str) -> DataFrame:
    return images.integral(_pixels(spark)).select("img", "y", "x", "s")


@query(f"WITH {_PIX}, v AS (SELECT a.img, a.y, a.x, var_pop(b.val) AS v FROM p a JOIN p b ON b.img = a.img AND b.y BETWEEN a.y AND a.y + 3 AND b.x BETWEEN a.x AND a.x + 4 WHERE a.y % 2 = 0 AND a.x % 2 = 0 AND a.y <= 16 AND a.x <= 15 GROUP BY a.img, a.y, a.x) SELECT img, y, x, round(v, 6) AS variance FROM v QUALIFY row_number() OVER (PARTITION BY img ORDER BY round(v, 9), y, x) = 1")
def quietest_region(spark: SparkSession, d: str) -> DataFrame:
    return images.quietest(_pixels(spark), 5, 4, 2).withColumn("variance", F.round("variance", 6))


@query("SELECT p_brand, p_size, count(*) AS count FROM part GROUP BY p_brand, p_size QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) = 1")
def most_frequent(spark: SparkSession, d: str) -> DataFrame:
    return images.most_frequent(table(spark, d, "part"), ["p_brand"], "p_size")


@query()
def largest_quiet_region(spark: SparkSession, d: str) -> DataFrame:
    whole = _pixels(spark).groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "val"))), lambda v: v["val"]).alias("pixels")).withColumns({"height": F.lit(20), "width": F.lit(20)})
    return images.largest_quiet(whole, 4000.0)


@query()
def dominant_colour(spark: SparkSession, d: str) -> DataFrame:
    return images.dominant(_colours(spark))


@query(f"WITH {_PIX}, c AS ({_RGB}) SELECT img, sum(255 - r)::BIGINT AS r, sum(255 - g)::BIGINT AS g, sum(255 - b)::BIGINT AS b, round(sum(r * 0.7), 6) AS red, round(sum(g * 0.6), 6) AS green, round(sum(b * 0.5), 6) AS blue FROM c GROUP BY img")
def pixel_effects(spark: SparkSession, d: str) -> DataFrame:
    c = _colours(spark)
    inverse = images.inverted(c).groupBy("img").agg(*[F.sum(x).alias(x) for x in "rgb"])
    return inverse.join(images.scaled(c, 0.7, 0.6, 0.5).groupBy("img").agg(*[F.round(F.sum(x), 6).alias(n) for x, n in zip("rgb", ("red", "green", "blue"))]), "img")


@query(f"WITH {_PIX}, c AS ({_RGB}), m AS (SELECT img, (r // 64) * 32 + (g // 32) * 4 + b // 64 AS cell, count(*) AS n, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM c GROUP BY ALL) SELECT img, cell::INTEGER AS cell, n, round(0.7 * n / sum(n) OVER (PARTITION BY img) + 0.3 * (greatest(r, g, b) - least(r, g, b)) / 255, 6) AS score FROM m")
def palettes(spark: SparkSession, d: str) -> DataFrame:
    return images.palette(_colours(spark), ["img"]).select("img", "cell", "n", F.round("score", 6).alias("score"))


@query(f"WITH {_PIX} SELECT img, y, x, val FROM p UNION ALL SELECT NULL, NULL, NULL, NULL")
def grey_rasters(spark: SparkSession, d: str) -> DataFrame:
    """The images as binary PGM files, and one that is none, read back."""
    rows = _pixels(spark).groupBy("img").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "val"))), lambda v: v["val"]).alias("v"))
    body = F.unhex(F.array_join(F.transform("v", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    pgm = rows.select(F.col("img").cast("string").alias("path"), F.concat(F.encode(F.lit("P5\n20 20\n255\n"), "utf-8"), body).alias("content"))
    read = images.greys(pgm.unionByName(spark.createDataFrame([(None, b"GIF89a")], "path string, content binary")))
    at = read.select(F.col("img").cast("long").alias("img"), "width", F.posexplode_outer("pixels").alias("k", "val"))
    return at.select("img", F.expr("k div width").cast("long").alias("y"), (F.col("k") % F.col("width")).cast("long").alias("x"), F.col("val").cast("long").alias("val"))


# ---- streams, run to their end over the events table


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Rows of a stream over what is there now. The folder of its state is the cluster's checkpoint folder if that is set."""
    spark = stream.sparkSession
    folder = scratch(spark, "stream")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream; their times without zone are taken as UTC instants."""
    return spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", True).parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return drained(stateful.first_seen(_stream(spark, d), ["event_id"], "ts")).select("event_id", "user_id")


@query("SELECT user_id, ts, value, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts), 6) AS delta FROM events")
def stream_deltas(spark: SparkSession, d: str) -> DataFrame:
    out = drained(stateful.deltas(_stream(spark, d), "user_id", "ts", "value"))
    return out.withColumn("delta", F.round(F.nanvl("delta", F.lit(None).cast("double")), 6))


@query("WITH RECURSIVE e AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events), r AS (SELECT user_id, ts, value, n, value AS accepted FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.ts, e.value, e.n, CASE WHEN e.value - r.accepted > 10 THEN r.accepted WHEN e.value > 80 THEN least(r.accepted, 80.0) ELSE e.value END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT user_id, ts, value, round(accepted, 6) AS accepted FROM r")
def stream_limited(spark: SparkSession, d: str) -> DataFrame:
    out = drained(stateful.limited(_stream(spark, d), "user_id", "ts", "value", 10.0, 80.0))
    return out.withColumn("accepted", F.round("accepted", 6))


@query("WITH g AS (SELECT user_id, ts, value, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) SELECT user_id, max(ts) AS at, arg_max(value, ts) AS value FROM g GROUP BY user_id, s")
def debounced(spark: SparkSession, d: str) -> DataFrame:
    return stateful.debounced(table(spark, d, "events"), "user_id", "ts", "value", "6 hours")


@query("SELECT event_id, ts AS shown, ts + INTERVAL 5 SECOND AS hidden FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, ts, ts + INTERVAL 1 SECOND FROM events WHERE event_id % 6 = 3")
def expiring_records(spark: SparkSession, d: str) -> DataFrame:
    k = _C("event_id")
    e = table(spark, d, "events").select("event_id", _C("ts").cast("timestamp").alias("ts"), F.when(k % 3 != 0, F.lit(-1)).when(k % 6 == 3, 1000).otherwise(0).alias("ms"), F.lit(False).alias("cancel"))
    return stateful.expiring(e, "event_id", "ts", "ms")


# What is settled by the last watermark, the latest event.
_BURSTS = "SELECT user_id, ts, value, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)"


@query(f"SELECT user_id, max(ts) AS at, arg_max(value, ts) AS value FROM ({_BURSTS}) GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events)")
def stream_debounced(spark: SparkSession, d: str) -> DataFrame:
    with timers.using(spark):
        return drained(timers.debounced(_stream(spark, d), "user_id", "ts", "value", 6 * 3_600_000))


@query("SELECT user_id, event_id AS id, CASE WHEN n < t THEN 'cancelled' ELSE 'done' END AS state, CASE WHEN n < t THEN n ELSE t END AS at FROM (SELECT user_id, event_id, ts + INTERVAL 1 HOUR * (1 + event_id % 48) AS t, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE least(t, n) <= (SELECT date_trunc('millisecond', max(ts)) FROM events)")
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    e = _stream(spark, d).withColumn("took", (1 + _C("event_id") % 48) * 3_600_000)
    with timers.using(spark):
        return drained(timers.answered(e, "user_id", "ts", "event_id", "took"))


@query("SELECT event_id, ts AS shown, ts + INTERVAL 1 SECOND * s AS hidden FROM (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 5 ELSE 1 + event_id % 7 END AS s FROM events) WHERE s > 0 AND NOT (event_id % 4 = 1 AND s >= 3) AND ts + INTERVAL 1 SECOND * s <= (SELECT date_trunc('millisecond', max(ts + CASE WHEN event_id % 4 = 1 THEN INTERVAL 3 SECOND ELSE INTERVAL 0 SECOND END)) FROM events)")
def stream_expiring(spark: SparkSession, d: str) -> DataFrame:
    k = _C("event_id")
    ms = F.when(k % 3 == 0, 0).when(k % 3 == 1, -1).otherwise((1 + k % 7) * 1000)
    rows = F.array(F.struct("ts", ms.alias("ms"), F.lit(False).alias("cancel")), F.when(k % 4 == 1, F.struct((_C("ts") + F.expr("INTERVAL 3 SECONDS")).alias("ts"), F.lit(0).cast("long").alias("ms"), F.lit(True).alias("cancel"))))
    e = _stream(spark, d).select("event_id", F.explode(F.array_compact(rows)).alias("r")).select("event_id", "r.*")
    with timers.using(spark):
        return drained(timers.expiring(e, "event_id", "ts", "ms"))


TOKENS = Fixture("tokens", "k int, seq int, reasoning boolean, piece string", [(0, 0, True, "hm"), (0, 1, True, "m"), (0, 2, False, "Hi"), (1, 0, False, "A"), (1, 1, False, None), (2, 0, True, "x")])


@query("SELECT * FROM (VALUES (0, chr(10) || chr(10) || '<think>' || chr(10) || chr(10) || 'hmm' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || 'Hi'), (1, 'A'), (2, chr(10) || chr(10) || '<think>' || chr(10) || chr(10) || 'x')) t(k, text)")
def folded_tokens(spark: SparkSession, d: str) -> DataFrame:
    return stateful.fold_tokens(TOKENS.df(spark), "k", "seq")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
def latest_requests(spark: SparkSession, d: str) -> DataFrame:
    return stateful.latest_requests(table(spark, d, "events"), "user_id", "ts").select("user_id", "event_id")


@query("SELECT n_nationkey + (SELECT max(r_regionkey) FROM region) AS id FROM nation")
def offset_ids(spark: SparkSession, d: str) -> DataFrame:
    return stateful.with_offset(table(spark, d, "nation").select(_C("n_nationkey").alias("id")), "id", table(spark, d, "region").select(_C("r_regionkey").alias("id")))
