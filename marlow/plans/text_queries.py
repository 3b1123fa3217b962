"""Queries over text, times, numbers, colours and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlow.functions import color, documents, fuzzy, rules, similarity, text, timefmt
from marlow.operators import fuzzy_join as joins
from marlow.plans.catalog import Fixture, query, table
from marlow.sources import files

STRINGS = Fixture("strings", "i int, s string", [
    (0, "https://www.example.org:8080/a/b?c=1"), (1, "http://x.y"), (2, "plain words here"), (3, "it's <b>\"quoted\"</b> & more"), (4, "(Live) [HD] Song title"), (5, "【東方】 Bad Apple"),
    (6, "12\tcopied text"), (7, "see http://a.b/c and https://d.e/f…"), (8, "file:///home/u/pic.tar.gz"), (9, "/usr/share/"), (10, "org.kde.dolphin"), (11, "on_primary_container"), (12, "  two  spaces "), (13, ""), (14, "5\t[[ binary data 12 KiB png 640x480 ]]"), (15, "v3.2-rc1"),
])


def _strings(spark: SparkSession, **columns: Column) -> DataFrame:
    return STRINGS.df(spark).select("i", *[c.alias(n) for n, c in columns.items()])


_S = F.col
W = f"WITH {STRINGS.sql()} "


@query(W + r"SELECT i, nullif(regexp_extract(s, '^(?:https?://)?(?:www\.)?([^/]+)', 1), '') AS domain, nullif(regexp_extract(s, '^(https?://[^/]+)', 1), '') AS base FROM strings")
def url_parts_fixture(spark: SparkSession, d: str) -> DataFrame:
    return _strings(spark, domain=text.domain(_S("s")), base=text.base_url(_S("s")))


@query(r"SELECT page_id, nullif(regexp_extract(url, '^(?:https?://)?(?:www\.)?([^/]+)', 1), '') AS domain, nullif(regexp_extract(url, '^(https?://[^/]+)', 1), '') AS base FROM pages")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.domain(_S("url")).alias("domain"), text.base_url(_S("url")).alias("base"))


@query(W + "SELECT i, replace(s, '''', '''\\''''') AS shell, replace(s, '\\', '\\\\') AS backslash, replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM strings")
def escapes(spark: SparkSession, d: str) -> DataFrame:
    return _strings(spark, shell=text.shell_quoted(_S("s")), backslash=text.backslash_escaped(_S("s")), html=text.html_escaped(_S("s")))


@query("SELECT p_partkey, 'Part ' || p_name || ' of ' || p_brand || ' {2}' AS filled, 'q=' || p_name AS named FROM part")
def templates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.fill(F.lit("Part {0} of {1} {2}"), _S("p_name"), _S("p_brand")).alias("filled"), text.fill_named(F.lit("q={{query}}"), {"{{query}}": _S("p_name")}).alias("named"))


@query("SELECT p_partkey, list_reduce(string_split(p_name, ' '), lambda a, w: CASE WHEN length(split_part(a, chr(10), -1)) + 1 + length(w) <= 12 THEN a || ' ' || w ELSE a || chr(10) || w END) AS lines FROM part")
def wrapped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.wrapped(_S("p_name"), 12).alias("lines"))


@query(W + r"SELECT i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^ *\([^)]*\) *', ' '), '^ *\[[^\]]*\] *', ' '), '^ *\{[^}]*\} *', ' '), '^ *【[^】]*】', '')) AS title, regexp_replace(s, '^\d+\t', '') AS entry FROM strings WHERE i < 14")
def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return _strings(spark, title=text.clean_title(_S("s")), entry=text.without_id(_S("s"))).where("i < 14")


@query(W + r"SELECT i, array_to_string(list_filter(regexp_extract_all(s, '(https?://[^\s]+)', 1), lambda u: NOT contains(u, '…')), ' ') AS urls FROM strings")
def url_extract(spark: SparkSession, d: str) -> DataFrame:
    return _strings(spark, urls=F.array_join(text.urls(_S("s")), " "))


@query(W + r"SELECT i, regexp_extract(s, '^\s*(\S+)', 1) AS head, regexp_replace(s, '^\s*\S+\s*', '') AS rest, try_cast(nullif(regexp_extract(s, '(\d+)\s*$', 1), '') AS BIGINT) AS tail FROM strings")
def word_parts(spark: SparkSession, d: str) -> DataFrame:
    return _strings(spark, head=text.first_word(_S("s")), rest=text.after_first_word(_S("s")), tail=text.trailing_number(_S("s")))


@query(W + r"SELECT i, split_part(regexp_replace(s, '^file://', ''), '/', -1) AS file, split_part(regexp_replace(regexp_replace(s, '^file://', ''), '/$', ''), '/', -1) AS folder, regexp_replace(regexp_replace(s, '^file://', ''), '\.[^./]*$', '') AS stem, CASE WHEN contains(s, '/') THEN regexp_replace(regexp_replace(s, '^file://', ''), '/[^/]*$', '') ELSE '' END AS parent FROM strings WHERE i IN (8, 9, 10)")
def paths(spark: SparkSession, d: str) -> DataFrame:
    return _strings(spark, file=text.file_name(_S("s")), folder=text.folder_name(_S("s")), stem=text.without_extension(_S("s")), parent=text.parent_folder(_S("s"))).where("i in (8, 9, 10)")


@query(W + r"SELECT i, split_part(s, '.', -1) AS segment, regexp_replace(lower(s), '\s+', '-', 'g') AS kebab, regexp_replace(s, '[^0-9]', '', 'g') AS digits, regexp_replace(trim(s), '\s+', '+', 'g') AS plus, regexp_replace(trim(s), '\S+$', '') || 'last' AS last FROM strings WHERE i NOT IN (6, 14)")
def names(spark: SparkSession, d: str) -> DataFrame:
    s = _S("s")
    return _strings(spark, segment=text.last_segment(s), kebab=text.kebab(s), digits=text.digits(s), plus=text.plus_for_spaces(s), last=text.with_last_word(s, F.lit("last"))).where("i not in (6, 14)")


@query(W + "SELECT i, CASE i WHEN 11 THEN 'onPrimaryContainer' END AS camel FROM strings WHERE i = 11")
def camel_case(spark: SparkSession, d: str) -> DataFrame:
    return _strings(spark, camel=text.camel(_S("s"))).where("i = 11")


MODELS = Fixture("models", "m string, pretty string, safe string", [("llama-3:8b", "Llama 3 (8B)", "llama-3_8b"), ("mistral:latest", "Mistral", "mistral_latest"), ("a b/c", "A (B/c)", "a-b-c")])


@query(f"WITH {MODELS.sql()} SELECT m, pretty, safe FROM models")
def model_names(spark: SparkSession, d: str) -> DataFrame:
    return MODELS.df(spark).select("m", text.pretty_name(_S("m")).alias("pretty"), text.safe_name(_S("m")).alias("safe"))


BODIES = Fixture("bodies", "app string, body string, want string", [("Chromium", "<a href=\"x\">x.org</a>\n\nHello\n\nWorld", "Hello\n\nWorld"), ("mail", "<a>\n\nHello", "<a>\n\nHello"), ("chromium", "Hi", "Hi")])


@query("WITH b AS (SELECT * FROM (VALUES (0, 'Hello' || chr(10) || chr(10) || 'World'), (1, '<a>' || chr(10) || chr(10) || 'Hello'), (2, 'Hi')) t(i, body)) SELECT body FROM b")
def message_bodies(spark: SparkSession, d: str) -> DataFrame:
    return BODIES.df(spark).select(text.message_body(_S("body"), _S("app")).alias("body"))


@query(r"""SELECT p_partkey, p_type AS section, p_name || chr(10) || ' "x"' AS unescaped, '/' || replace(p_name, ' ', '%20') || '/%C3%BC~' AS encoded, 'vim' || p_partkey AS element, 'run ' || p_partkey || ' x.txt' AS strategy, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' -site:a.b' || p_partkey ELSE '' END AS sites FROM part""")
def text_pieces(spark: SparkSession, d: str) -> DataFrame:
    k = _S("p_partkey").cast("string")
    rule = F.concat(F.lit("~vim"), k, F.lit("->run "), k, F.lit(" *"))
    sites = F.array(F.when(_S("p_partkey") % 2 == 0, F.concat(F.lit("a.b"), k)).otherwise(""), F.lit(""))
    p = table(spark, d, "part")
    return p.select("p_partkey", text.section(F.concat_ws("\n\n", "p_name", "p_type", F.lit("three")), 1).alias("section"), text.unescaped(F.concat("p_name", F.lit('\\n \\"x\\"'))).alias("unescaped"), text.path_encoded(F.concat(F.lit("/"), "p_name", F.lit("/ü~"))).alias("encoded"), text.command_element(rule).alias("element"), text.command_strategy(rule, F.lit("x.txt")).alias("strategy"), text.without_sites(_S("p_name"), sites).alias("sites"))


@query(W + r"SELECT i, coalesce(try_cast(regexp_extract(s, '^(\d+)\t', 1) AS INTEGER), 0) AS id, coalesce(try_cast(regexp_extract(s, '(\d+)x\d+', 1) AS INTEGER), 0) AS width, coalesce(try_cast(regexp_extract(s, '\d+x(\d+)', 1) AS INTEGER), 0) AS height, regexp_matches(s, '^\d+\t\[\[.*binary data.*\d+x\d+.*\]\]$') AS image FROM strings")
def image_labels(spark: SparkSession, d: str) -> DataFrame:
    return STRINGS.df(spark).select("i", text.image_label(_S("s")).alias("l"), text.is_image_entry(_S("s")).alias("image")).select("i", "l.*", "image")


@query("SELECT c_custkey, md5(c_name) AS md5, sha256(c_name) AS sha FROM customer")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.md5("c_name").alias("md5"), F.sha2("c_name", 256).alias("sha"))


# ---- similarity

_PART = "list_aggregate(list_transform(range(1, greatest(la, lb) - least(la, lb) + 2), lambda i: 1.0 - levenshtein(CASE WHEN la > lb THEN b ELSE a END, substr(CASE WHEN la > lb THEN a ELSE b END, i, least(la, lb))) / least(la, lb)), 'max')"
_PREFIX = "len(list_filter(range(1, least(la, lb) + 1), lambda i: left(a, i) = left(b, i)))"
_PAIRS = "WITH p AS (SELECT p_partkey, lower(p_name) AS a, 'green part' AS b, length(p_name) AS la, 10 AS lb FROM part), r AS (SELECT *, 1 - levenshtein(a, b) / greatest(la, lb)::DOUBLE AS full_ratio, greatest(0, " + _PART + ") AS part_ratio, " + _PREFIX + " AS prefix, (contains(a, b) OR contains(b, a))::INT AS inside FROM p) "
_NAME = "CASE WHEN a = b THEN 1 ELSE greatest(0, least(1, 0.85 * full_ratio + 0.15 * part_ratio - CASE WHEN a[1] <> b[1] THEN 0.05 ELSE 0 END - CASE WHEN abs(la - lb) >= 3 THEN 0.05 * abs(la - lb) / greatest(la, lb) ELSE 0 END + 0.02 * prefix + 0.06 * inside)) END"
_TEXT = "CASE WHEN a = b THEN 1 ELSE greatest(0, least(1, 0.4 * full_ratio + 0.6 * part_ratio - CASE WHEN abs(la - lb) >= 10 THEN 0.02 * abs(la - lb) / greatest(la, lb) ELSE 0 END + 0.01 * prefix + 0.2 * inside)) END"


@query(_PAIRS + f"SELECT p_partkey, levenshtein(a, b) AS distance, round(part_ratio, 6) AS part_ratio, round({_NAME}, 6) AS name_score, round({_TEXT}, 6) AS text_score FROM r")
def similarity_scores(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.lower("p_name"), F.lit("green part")
    return table(spark, d, "part").select("p_partkey", F.levenshtein(a, b).cast("long").alias("distance"), *[F.round(f(a, b), 6).alias(n) for n, f in (("part_ratio", similarity.partial_ratio), ("name_score", similarity.name_score), ("text_score", similarity.text_score))])


@query(_PAIRS + f"SELECT p_partkey, round({_NAME}, 6) AS score FROM r WHERE {_NAME} > 0.2 ORDER BY score DESC, p_partkey LIMIT 20")
def fuzzy_rank(spark: SparkSession, d: str) -> DataFrame:
    scored = table(spark, d, "part").select("p_partkey", similarity.name_score(F.lower("p_name"), F.lit("green part")).alias("score")).where("score > 0.2")
    return scored.select("p_partkey", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(20)


_STEP = "CASE WHEN {b} = 0 OR instr(substr(t, {b} + 1), '{c}') = 0 THEN 0 ELSE {b} + instr(substr(t, {b} + 1), '{c}') END AS {n}"


@query(f"WITH p AS (SELECT p_partkey, lower(p_name) AS t, instr(lower(p_name), 'p') AS i1 FROM part), q AS (SELECT *, {_STEP.format(b='i1', c='a', n='i2')} FROM p), r AS (SELECT *, {_STEP.format(b='i2', c='r', n='i3')} FROM q), s AS (SELECT *, {_STEP.format(b='i3', c='t', n='i4')} FROM r) SELECT p_partkey, CASE WHEN i4 = 0 THEN -1 ELSE 4 + (i2 = i1 + 1)::INT + (i3 = i2 + 1)::INT + (i4 = i3 + 1)::INT END AS score FROM s")
def subsequence_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", similarity.subsequence_score(F.lit("part"), _S("p_name")).alias("score"))


@query()
def fuzzy_search(spark: SparkSession, d: str) -> DataFrame:
    out = fuzzy.go(table(spark, d, "part").select("p_partkey", "p_name"), "co wid", "p_name", threshold=0.2, limit=50)
    return out.select("p_partkey", F.round("score", 6).alias("score"), text.highlighted(_S("p_name"), _S("indexes")).alias("marked"))


@query()
def fuzzy_search_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(fuzzy.fuzzy_keys("brand wid", _S("p_name"), _S("p_brand"), _S("p_type")), 6).alias("raw")).where("raw is not null")


@query("SELECT i, round(exp((pow(1 + i, 0.04307) - 1) * -2), 6) AS display FROM range(0, 200) t(i)")
def score_scale(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(200).select(_S("id").alias("i"), F.round(similarity.display_score(-_S("id").cast("double")), 6).alias("display"))


@query("SELECT p_partkey, coalesce(list_bit_or(list_transform(list_filter(string_split(lower(p_name), ''), lambda c: c <> ' '), lambda c: CASE WHEN c BETWEEN 'a' AND 'z' THEN 1::BIGINT << (ascii(c) - 97) WHEN c BETWEEN '0' AND '9' THEN 1::BIGINT << 26 WHEN ascii(c) <= 127 THEN 1::BIGINT << 30 ELSE 1::BIGINT << 31 END)), 0) AS mask FROM part")
def character_masks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", similarity.character_mask(_S("p_name")).alias("mask"))


# ---- times and numbers

_CLOCK = "CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END"


@query(f"SELECT s, {_CLOCK} AS clock, lpad((s // 6000)::VARCHAR, 2, '0') || ':' || lpad((s % 6000 // 100)::VARCHAR, 2, '0') || '.' || lpad((s % 100)::VARCHAR, 2, '0') AS stopwatch, concat_ws(', ', CASE WHEN s >= 86400 THEN (s // 86400) || 'd' END, CASE WHEN s % 86400 >= 3600 THEN (s % 86400 // 3600) || 'h' END, CASE WHEN s % 3600 >= 60 OR s < 3600 THEN (s % 3600 // 60) || 'm' END) AS uptime FROM (SELECT i * 977 AS s FROM range(0, 300) t(i))")
def durations(spark: SparkSession, d: str) -> DataFrame:
    s = spark.range(300).select((_S("id") * 977).alias("s"))
    return s.select("s", timefmt.clock(_S("s")).alias("clock"), timefmt.stopwatch(_S("s")).alias("stopwatch"), timefmt.uptime(_S("s")).alias("uptime"))


@query("WITH x AS (SELECT event_id, ts, TIMESTAMP '2024-01-30 12:00:00' AS now FROM events WHERE ts <= TIMESTAMP '2024-01-30 12:00:00'), y AS (SELECT *, (epoch(date_trunc('second', now))::BIGINT - floor(epoch(ts))::BIGINT) // 60 AS m, date_diff('day', ts, now) AS days FROM x) SELECT event_id, CASE WHEN m < 1 THEN 'Now' WHEN days = 0 AND m < 60 THEN m || 'm' WHEN days = 0 THEN (m // 60) || 'h' WHEN days = 1 THEN 'Yesterday' ELSE strftime(ts, '%B %d') END AS age, strftime(ts, '%A, %d %B %Y') AS day FROM y")
def relative_times(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return table(spark, d, "events").where(_S("ts") <= now).select("event_id", timefmt.relative(_S("ts"), now).alias("age"), timefmt.long_date(_S("ts")).alias("day"))


@query("SELECT m, m BETWEEN 420 AND 1140 AS day, m >= 1140 OR m <= 420 AS night FROM (SELECT i * 7 AS m FROM range(0, 206) t(i))")
def day_ranges(spark: SparkSession, d: str) -> DataFrame:
    a, b = timefmt.minutes_of_day(F.lit("07:00")), timefmt.minutes_of_day(F.lit("19:00"))
    m = spark.range(206).select((_S("id") * 7).alias("m"))
    return m.select("m", timefmt.in_day_range(_S("m"), a, b).alias("day"), timefmt.in_day_range(_S("m"), b, a).alias("night"))


@query("SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month, day(last_day(o_orderdate)) AS days, (year(o_orderdate) % 400 = 0 OR (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0)) AS leap, (date_trunc('month', o_orderdate) + INTERVAL 3 MONTH)::DATE AS later FROM orders")
def months(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    o = table(spark, d, "orders").select(F.trunc(day, "MM").alias("month")).distinct()
    return o.select("month", timefmt.days_in_month(_S("month")).cast("long").alias("days"), timefmt.is_leap(F.year("month")).alias("leap"), timefmt.first_of_month(_S("month"), 3).alias("later"))


@query("WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month FROM orders), g AS (SELECT month, i, month - (isodow(month) - 1)::INTEGER + i::INTEGER AS date FROM m, range(0, 42) t(i)) SELECT month, i // 7 AS week, i % 7 AS weekday, day(date) AS day, CASE WHEN date < month THEN -1 WHEN date > last_day(month) THEN 1 ELSE 0 END AS place FROM g")
def calendar_grid(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").select(F.trunc(F.to_date("o_orderdate"), "MM").alias("month")).distinct()
    return timefmt.calendar_grid(m).select("month", *[_S(c).cast("long").alias(c) for c in ("week", "weekday", "day")], "place")


@query("WITH t AS (SELECT i * 60 AS s, (i * 60) % 7200 AS pos FROM range(0, 240) t(i)), c AS (SELECT *, least(pos // 1800, 3) AS cycle, pos - least(pos // 1800, 3) * 1800 AS inside FROM t) SELECT s, CASE WHEN inside < 1500 THEN 'focus' WHEN cycle = 3 THEN 'long rest' ELSE 'rest' END AS phase, cycle, CASE WHEN inside < 1500 THEN 1500 - inside WHEN cycle = 3 THEN 1800 - inside ELSE 1800 - inside END AS left_s FROM c")
def timer_phases(spark: SparkSession, d: str) -> DataFrame:
    s = spark.range(240).select((_S("id") * 60).alias("s"))
    return s.select("s", timefmt.cycle_phase(_S("s"), 1500, 300, 300, 4).alias("p")).select("s", "p.phase", _S("p.cycle").cast("long").alias("cycle"), _S("p.left").alias("left_s"))


@query("SELECT c_custkey, greatest(0.0, least(5000.0, c_acctbal)) AS clamped, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS level, CASE WHEN c_acctbal >= 7000 THEN 'full' WHEN c_acctbal >= 2000 THEN 'half' ELSE 'empty' END AS bars, printf('%.1f GB', c_custkey * 12345.0 / 1048576) AS size, round(coalesce(c_acctbal / nullif(c_nationkey, 0), 0), 6) AS share FROM customer")
def scales(spark: SparkSession, d: str) -> DataFrame:
    b = _S("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", color.clamp(b, 0.0, 5000.0).alias("clamped"), color.steps(b, [(0, "debt"), (5000, "low")], "high").alias("level"), color.at_least_steps(b, [(7000, "full"), (2000, "half")], "empty").alias("bars"), color.gigabytes(_S("c_custkey") * 12345.0).alias("size"), F.round(color.share(b, _S("c_nationkey").cast("double")), 6).alias("share"))


@query("SELECT p_partkey, CASE WHEN p_size <= 10 AND p_size * 2 <= 10 THEN 'small' WHEN p_size <= 40 AND p_size * 2 <= 40 THEN 'normal' ELSE 'large' END AS size FROM part")
def size_classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", color.size_class(_S("p_size"), _S("p_size") * 2, [("small", 10), ("normal", 40)], "large").alias("size"))


COLOURS = Fixture("colours", "c string, n long, dark boolean", [("#000000", 4278190080, True), ("#FFFFFF", 4294967295, False), ("#336699", 4281558681, True), ("#FFCC00", 4294953984, False), ("#808080", 4286611584, False)])


@query(f"WITH {COLOURS.sql()} SELECT c, n, c AS back, c AS turned, dark FROM colours")
def colours(spark: SparkSession, d: str) -> DataFrame:
    rgb = color.from_hex(_S("c"))
    return COLOURS.df(spark).select("c", color.argb(_S("c")).alias("n"), color.from_argb(color.argb(_S("c"))).alias("back"), color.to_hex(color.with_hue_of(rgb, rgb)).alias("turned"), color.is_dark(rgb).alias("dark"))


@query(f"WITH {COLOURS.sql()} SELECT c, CASE c WHEN '#000000' THEN '#404040' WHEN '#FFFFFF' THEN '#C0C0C0' WHEN '#336699' THEN '#5A738D' WHEN '#FFCC00' THEN '#C0A640' ELSE '#808080' END AS mixed FROM colours")
def colour_mix(spark: SparkSession, d: str) -> DataFrame:
    return COLOURS.df(spark).select("c", color.to_hex(color.mix(color.from_hex(_S("c")), color.from_hex(F.lit("#808080")))).alias("mixed"))


# Values by Python's colorsys: the hue or saturation of #CC3311, a lightness of 0.25.
@query("SELECT *, 171 AS width, 96 AS height FROM (VALUES ('#000000', '#000000', '#000000', '#404040'), ('#FFFFFF', '#FFFFFF', '#FF1515', '#404040'), ('#336699', '#994633', '#0D5399', '#204060'), ('#FFCC00', '#FF2E00', '#FFD015', '#806600'), ('#808080', '#808080', '#800B0B', '#404040')) t(c, hue, saturation, lightness)")
def colour_transfer(spark: SparkSession, d: str) -> DataFrame:
    rgb, red = color.from_hex(_S("c")), color.from_hex(F.lit("#CC3311"))
    return COLOURS.df(spark).select("c", color.to_hex(color.with_hue_of(rgb, red)).alias("hue"), color.to_hex(color.with_saturation_of(rgb, red)).alias("saturation"), color.to_hex(color.with_lightness(rgb, 0.25)).alias("lightness"), color.same_area(F.lit(1920), F.lit(1080), 128).alias("size")).select("c", "hue", "saturation", "lightness", "size.*")


# ---- JSON and documents


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(try_cast(json_extract_string(props, '$.usage.total') AS BIGINT), -1) AS total, len(json_keys(props)) AS n_keys FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), documents.usage_tokens(_S("props"), "$.usage.total").alias("total"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@query("SELECT e.event_id, k.key, json_extract_string(e.props, '$.' || k.key) AS value FROM events e, unnest(json_keys(e.props)) k(key)")
def json_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


VALUES = Fixture("vals", "v string, want string", [("true", "true"), ("12.5", "12.5"), (" 7 ", "7"), ("abc", '"abc"'), ("1a", '"1a"')])


@query(f"WITH {VALUES.sql()} SELECT v, want AS json FROM vals")
def coerced_values(spark: SparkSession, d: str) -> DataFrame:
    return VALUES.df(spark).select("v", documents.coerced(_S("v")).alias("json"))


@query("SELECT c_custkey, c_name || '!' AS name, c_nationkey AS nation FROM customer")
def nested_set(spark: SparkSession, d: str) -> DataFrame:
    r = F.struct(F.struct("c_name", "c_nationkey").alias("who"))
    return table(spark, d, "customer").select("c_custkey", documents.with_path(r, "who.c_name", F.concat("c_name", F.lit("!"))).alias("r")).select("c_custkey", _S("r.who.c_name").alias("name"), _S("r.who.c_nationkey").alias("nation"))


@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'even' END, s_name) AS name, s_nationkey AS nation FROM supplier")
def overlays(spark: SparkSession, d: str) -> DataFrame:
    base = F.struct(_S("s_name").alias("name"), _S("s_nationkey").alias("nation"))
    over = F.struct(F.when(_S("s_suppkey") % 2 == 0, "even").alias("name"), F.lit(None).cast("int").alias("nation"), F.lit(1).alias("ignored"))
    return table(spark, d, "supplier").select("s_suppkey", documents.overlaid(base, over, ["name", "nation"]).alias("o")).select("s_suppkey", "o.*")


@query("SELECT n_nationkey, 'a=2,b=1,c=3' AS merged, 'a;1;b;1' AS flat, '1.5,2.0' AS nums FROM nation")
def maps(spark: SparkSession, d: str) -> DataFrame:
    one, two = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"), F.lit("c"), F.lit("3"))
    m = F.array_join(F.array_sort(F.transform(F.map_entries(documents.merged(one, two)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return table(spark, d, "nation").select("n_nationkey", m.alias("merged"), F.array_join(documents.flat_pairs(one), ";").alias("flat"), F.array_join(F.transform(documents.numbers(F.lit("1.5;x;2;;")), lambda x: x.cast("string")), ",").alias("nums"))


@query("SELECT conv_id, count(*) + 1 AS n FROM conversations GROUP BY conv_id")
def chat_requests(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    body = documents.chat_request(_S("m"), F.lit("model"), "Be brief.", 0.5)
    return c.select("conv_id", F.json_array_length(F.get_json_object(body, "$.messages")).cast("long").alias("n"))


MARKDOWN = Fixture("md", "k int, text string", [(0, "Intro\n```py\nx = 1\n```\nafter <think>hm</think> end"), (1, "a\n```sh\nls"), (2, "<think>open"), (3, " \n"), (4, "price $x+1$ and $$y$$ or \\(z\\)")])


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """k, text: an answer for each part, with text, code and think blocks; of each third one the last block stays open."""
    k, name = _S("p_partkey"), _S("p_name")
    closed = F.concat(F.lit("Intro "), name, F.lit("\n```py\nx = "), k, F.lit("\n```\nafter <think>hm "), name, F.lit("</think> end"))
    code, think = F.concat(name, F.lit("\n```sh\nls "), k), F.concat(name, F.lit(" <think>open "), k)
    return table(spark, d, "part").select(k.alias("k"), F.when(k % 3 == 0, closed).when(k % 3 == 1, code).otherwise(think).alias("text"))


@query("""WITH b AS (
    SELECT p_partkey AS k, unnest([{'pos': 0, 'kind': 'text', 'lang': NULL, 'content': 'Intro ' || p_name || chr(10), 'completed': true}, {'pos': 1, 'kind': 'code', 'lang': 'py', 'content': 'x = ' || p_partkey || chr(10), 'completed': true},
        {'pos': 2, 'kind': 'text', 'lang': NULL, 'content': chr(10) || 'after ', 'completed': true}, {'pos': 3, 'kind': 'think', 'lang': NULL, 'content': 'hm ' || p_name, 'completed': true}, {'pos': 4, 'kind': 'text', 'lang': NULL, 'content': ' end', 'completed': true}]) AS b FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, unnest([{'pos': 0, 'kind': 'text', 'lang': NULL, 'content': p_name || chr(10), 'completed': true}, {'pos': 1, 'kind': 'code', 'lang': 'sh', 'content': 'ls ' || p_partkey, 'completed': false}]) FROM part WHERE p_partkey % 3 = 1
    UNION ALL SELECT p_partkey, unnest([{'pos': 0, 'kind': 'text', 'lang': NULL, 'content': p_name || ' ', 'completed': true}, {'pos': 1, 'kind': 'think', 'lang': NULL, 'content': 'open ' || p_partkey, 'completed': false}]) FROM part WHERE p_partkey % 3 = 2
) SELECT k, b.pos AS pos, b.kind AS kind, b.lang AS lang, b.content AS content, b.completed AS completed FROM b""")
def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    return documents.markdown_blocks(_answers(spark, d), "k", "text")


@query("SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'Intro ' || p_name || chr(10) || '```py' || chr(10) || 'x = ' || p_partkey || chr(10) || '```' || chr(10) || 'after hm ' || p_name || ' end' WHEN 1 THEN p_name || chr(10) || '```sh' || chr(10) || 'ls ' || p_partkey || chr(10) || '```' ELSE p_name || ' open ' || p_partkey END AS text FROM part")
def markdown_joined(spark: SparkSession, d: str) -> DataFrame:
    return documents.joined_blocks(markdown_blocks(spark, d), "k")


@query("SELECT 4 AS k, '$x+1$|$$y$$|\\(z\\)' AS formulas")
def latex(spark: SparkSession, d: str) -> DataFrame:
    return MARKDOWN.df(spark).select("k", F.array_join(documents.formulas(_S("text")), "|").alias("formulas")).where("formulas <> ''")


SOURCE = Fixture("src", "text string", [('x: tr("Hello") + tr("It\\"s") ; Translation.tr(\'One\')',), ('tr("Hello", 1) str("no")',)])


@query("SELECT unnest(['Hello', 'It\"s', 'One']) AS text")
def translatable(spark: SparkSession, d: str) -> DataFrame:
    return documents.literals(SOURCE.df(spark), "text")


BINDS = Fixture("binds", "lineno int, line string", [(1, "#! Window"), (2, "bind = SUPER+SHIFT, Q, killactive, # Close"), (3, "##! Moving"), (4, "binde = Super Alt, Left, movewindow, l"), (5, "#/# bind = Ctrl, C, exec, copy # Copy"), (6, "bind = X, Y, exec, z # [hidden]"), (7, "text")])


@query("SELECT * FROM (VALUES (2, 'Window', 1, 'SUPER,SHIFT', 'Q', 'killactive', '', 'Close'), (4, 'Moving', 2, 'Super,Alt', 'Left', 'movewindow', 'l', ''), (5, 'Moving', 2, 'Ctrl', 'C', 'exec', 'copy', 'Copy')) t(lineno, section, depth, mods, key, dispatcher, params, comment)")
def key_bindings(spark: SparkSession, d: str) -> DataFrame:
    return files.bindings(BINDS.df(spark)).withColumn("mods", F.array_join("mods", ","))


@query("SELECT 2 AS lineno, 'Close window' AS words UNION ALL SELECT 4, 'Window: move in left direction' UNION ALL SELECT 5, 'Execute: copy'")
def binding_comments(spark: SparkSession, d: str) -> DataFrame:
    return files.bindings(BINDS.df(spark)).select("lineno", rules.binding_comment(_S("dispatcher"), _S("params")).alias("words"))


CODES = Fixture("codes", "code string", [("113",), ("308",), ("999",)])


@query(f"WITH {CODES.sql()} SELECT code, CASE code WHEN '113' THEN 'clear_day' WHEN '308' THEN 'weather_hail' ELSE 'cloud' END AS symbol FROM codes")
def weather_symbols(spark: SparkSession, d: str) -> DataFrame:
    return CODES.df(spark).select("code", rules.weather_symbol(_S("code")).alias("symbol"))


APPS = Fixture("apps", "name string, want string", [("Code", "visual-studio-code"), ("steam_app_570", "steam_icon_570"), ("org.kde.Dolphin", "dolphin"), ("GIMP", "gimp"), ("My App", "my-app"), ("zzz", "zzz"), ("", "image-missing"), ("polkit-agent", "system-lock-screen")])


@query(f"WITH {APPS.sql()} SELECT name, want AS icon FROM apps")
def icons(spark: SparkSession, d: str) -> DataFrame:
    known = F.array(*[F.lit(x) for x in ("dolphin", "gimp", "my-app")])
    return APPS.df(spark).select("name", rules.icon_of(_S("name"), known).alias("icon"))


BUSES = Fixture("buses", "bus string, url string", [("org.mpris.MediaPlayer2.firefox.i1", "https://www.youtube.com/feed"), ("org.mpris.MediaPlayer2.mpd", "https://youtu.be/x"), ("org.mpris.MediaPlayer2.x.mpd", "https://www.youtube.com/watch?v=1"), ("org.mpris.MediaPlayer2.vlc", "file:///a")])


@query(f"WITH {BUSES.sql()} SELECT bus, bus LIKE '%2.mpd' OR bus LIKE '%vlc' AS real, contains(url, 'feed') AS preview FROM buses")
def players(spark: SparkSession, d: str) -> DataFrame:
    return BUSES.df(spark).select("bus", rules.is_real_player(_S("bus")).alias("real"), rules.is_video_preview(_S("url")).alias("preview"))


@query("SELECT 2 AS lineno, unnest(['SUPER + SHIFT + Q', 'Close']) AS cell UNION ALL SELECT 4, unnest(['Super + Alt + Left', '']) UNION ALL SELECT 5, unnest(['Ctrl + C', 'Copy'])")
def binding_cells(spark: SparkSession, d: str) -> DataFrame:
    b = files.bindings(BINDS.df(spark))
    return b.select("lineno", F.explode(F.array(F.array_join(F.array_append(_S("mods"), _S("key")), " + "), _S("comment"))).alias("cell"))


@query("WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS x FROM pages) SELECT page_id, i AS depth, array_to_string(x[:i + 1], '/') AS prefix FROM p, range(0, 100) t(i) WHERE i < len(x)")
def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.split(F.regexp_replace("url", "^https?://", ""), "/").alias("x"))
    return p.select("page_id", "x", F.posexplode("x").alias("depth", "part")).select("page_id", F.col("depth").cast("long").alias("depth"), F.array_join(F.slice("x", F.lit(1), _S("depth") + 1), "/").alias("prefix"))


@query()
def fuzzy_join(spark: SparkSession, d: str) -> DataFrame:
    """The three customers whose names are nearest to `cus` and a supplier's number, for every supplier."""
    asked = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("cus "), _S("s_suppkey").cast("string")).alias("text"))
    names = table(spark, d, "customer").select("c_custkey", "c_name")
    found = joins.fuzzy_join(asked, names, "text", "c_name", 3)
    out = found.join(asked, found["query"] == asked["text"]).join(names, found["target"] == names["c_name"])
    return out.select("s_suppkey", "c_custkey", "rank", F.round("raw", 6).alias("raw"))
