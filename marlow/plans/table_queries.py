"""Text, time, colour and rule functions over columns of the given tables, each with SQL that computes the same from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlow.functions import color, documents, rules, similarity, text, timefmt
from marlow.plans.catalog import query, table

_C = F.col


def _with(spark: SparkSession, d: str, name: str, key: str, **columns: str) -> DataFrame:
    """A table's key and columns made by SQL expressions, which the queries' SQL has too."""
    return table(spark, d, name).select(_C(key), *[F.expr(e).alias(n) for n, e in columns.items()])


# ---- text


@query("SELECT doc_id, md5(replace(text, '''', '''\\''''')) AS shell, md5(replace(text, '\\', '\\\\')) AS backslash, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS html FROM documents")
def document_escapes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *[F.md5(f(_C("text"))).alias(n) for n, f in (("shell", text.shell_quoted), ("backslash", text.backslash_escaped), ("html", text.html_escaped))])


@query(r"WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '(Live) ' WHEN 1 THEN '[HD] ' WHEN 2 THEN '{x} ' WHEN 3 THEN '【東方】 ' ELSE '' END || p_name AS s, p_partkey || chr(9) || p_name AS e FROM part) SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^ *\([^)]*\) *', ' '), '^ *\[[^\]]*\] *', ' '), '^ *\{[^}]*\} *', ' '), '^ *【[^】]*】', '')) AS title, regexp_replace(e, '^\d+\t', '') AS entry FROM t")
def part_titles(spark: SparkSession, d: str) -> DataFrame:
    t = _with(spark, d, "part", "p_partkey", s="CASE p_partkey % 5 WHEN 0 THEN '(Live) ' WHEN 1 THEN '[HD] ' WHEN 2 THEN '{x} ' WHEN 3 THEN '【東方】 ' ELSE '' END || p_name", e="p_partkey || chr(9) || p_name")
    return t.select("p_partkey", text.clean_title(_C("s")).alias("title"), text.without_id(_C("e")).alias("entry"))


@query(r"WITH t AS (SELECT page_id, 'see ' || url || ' and ' || url || '/x…' || chr(10) || url AS s FROM pages) SELECT page_id, array_to_string(list_filter(regexp_extract_all(s, '(https?://[^\s]+)', 1), lambda u: NOT contains(u, '…')), ' ') AS urls FROM t")
def linked_urls(spark: SparkSession, d: str) -> DataFrame:
    t = _with(spark, d, "pages", "page_id", s="'see ' || url || ' and ' || url || '/x…' || chr(10) || url")
    return t.select("page_id", F.array_join(text.urls(_C("s")), " ").alias("urls"))


@query(r"WITH t AS (SELECT c_custkey, '  ' || c_name || ' no ' || CASE WHEN c_custkey % 3 = 0 THEN 'number' ELSE c_custkey::VARCHAR END AS s FROM customer) SELECT c_custkey, regexp_extract(s, '^\s*(\S+)', 1) AS head, regexp_replace(s, '^\s*\S+\s*', '') AS rest, try_cast(nullif(regexp_extract(s, '(\d+)\s*$', 1), '') AS BIGINT) AS tail FROM t")
def customer_words(spark: SparkSession, d: str) -> DataFrame:
    t = _with(spark, d, "customer", "c_custkey", s="'  ' || c_name || ' no ' || CASE WHEN c_custkey % 3 = 0 THEN 'number' ELSE CAST(c_custkey AS STRING) END")
    return t.select("c_custkey", text.first_word(_C("s")).alias("head"), text.after_first_word(_C("s")).alias("rest"), text.trailing_number(_C("s")).alias("tail"))


@query(r"WITH t AS (SELECT p_partkey, 'file:///' || replace(p_name, ' ', '/') || CASE WHEN p_partkey % 2 = 0 THEN '.v1.gz' ELSE '/' END AS s FROM part) SELECT p_partkey, split_part(regexp_replace(s, '^file://', ''), '/', -1) AS file, split_part(regexp_replace(regexp_replace(s, '^file://', ''), '/$', ''), '/', -1) AS folder, regexp_replace(regexp_replace(s, '^file://', ''), '\.[^./]*$', '') AS stem, regexp_replace(regexp_replace(s, '^file://', ''), '/[^/]*$', '') AS parent FROM t")
def part_paths(spark: SparkSession, d: str) -> DataFrame:
    t = _with(spark, d, "part", "p_partkey", s="'file:///' || replace(p_name, ' ', '/') || CASE WHEN p_partkey % 2 = 0 THEN '.v1.gz' ELSE '/' END")
    s = _C("s")
    return t.select("p_partkey", text.file_name(s).alias("file"), text.folder_name(s).alias("folder"), text.without_extension(s).alias("stem"), text.parent_folder(s).alias("parent"))


@query(r"WITH t AS (SELECT p_partkey, p_name || ' ' || p_size || '.' || p_brand AS s, lower(replace(p_name, ' ', '_')) || '_of_' || lower(p_type) AS c FROM part) SELECT p_partkey, split_part(s, '.', -1) AS segment, regexp_replace(lower(s), '\s+', '-', 'g') AS kebab, regexp_replace(s, '[^0-9]', '', 'g') AS digits, regexp_replace(trim(s), '\s+', '+', 'g') AS plus, regexp_replace(trim(s), '\S+$', '') || 'last' AS last, string_split(c, '_')[1] || array_to_string(list_transform(string_split(c, '_')[2:], lambda w: upper(w[1]) || w[2:]), '') AS camel FROM t")
def part_names(spark: SparkSession, d: str) -> DataFrame:
    t = _with(spark, d, "part", "p_partkey", s="p_name || ' ' || p_size || '.' || p_brand", c="lower(replace(p_name, ' ', '_')) || '_of_' || lower(p_type)")
    s = _C("s")
    return t.select("p_partkey", text.last_segment(s).alias("segment"), text.kebab(s).alias("kebab"), text.digits(s).alias("digits"), text.plus_for_spaces(s).alias("plus"), text.with_last_word(s, F.lit("last")).alias("last"), text.camel(_C("c")).alias("camel"))


@query("SELECT p_partkey, upper(w[1]) || w[2:] || ' ' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN ' (' || p_size || 'B)' ELSE '' END AS pretty, w || '-' || p_partkey || '_' || CASE WHEN p_partkey % 2 = 0 THEN p_size || 'b' ELSE 'latest' END AS safe FROM (SELECT *, split_part(p_name, ' ', 1) AS w FROM part)")
def part_models(spark: SparkSession, d: str) -> DataFrame:
    t = _with(spark, d, "part", "p_partkey", m="split(p_name, ' ')[0] || '-' || p_partkey || ':' || CASE WHEN p_partkey % 2 = 0 THEN p_size || 'b' ELSE 'latest' END")
    return t.select("p_partkey", text.pretty_name(_C("m")).alias("pretty"), text.safe_name(_C("m")).alias("safe"))


@query(r"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey END::INTEGER AS id, CASE WHEN p_partkey % 3 = 1 THEN p_size * 10 ELSE 0 END::INTEGER AS width, CASE WHEN p_partkey % 3 = 1 THEN p_size * 7 ELSE 0 END::INTEGER AS height, p_partkey % 3 = 1 AS image FROM part")
def clip_entries(spark: SparkSession, d: str) -> DataFrame:
    t = _with(spark, d, "part", "p_partkey", s="CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_partkey || chr(9) || '[[ binary data ' || p_size || ' KiB png ' || p_size * 10 || 'x' || p_size * 7 || ' ]]' ELSE p_partkey || chr(9) || p_name END")
    return t.select("p_partkey", text.image_label(_C("s")).alias("l"), text.is_image_entry(_C("s")).alias("image")).select("p_partkey", "l.*", "image")


@query("SELECT p_partkey, '$x+' || p_partkey || '$|$$' || p_size || 'y$$|\\(z\\)' AS formulas FROM part")
def part_formulas(spark: SparkSession, d: str) -> DataFrame:
    t = _with(spark, d, "part", "p_partkey", s=r"p_name || ' $x+' || p_partkey || '$ and $$' || p_size || 'y$$ or \\(z\\)'")
    return t.select("p_partkey", F.array_join(documents.formulas(_C("s")), "|").alias("formulas"))


@query("SELECT DISTINCT unnest([p_name, 'It\"s ' || p_brand, p_type]) AS text FROM part")
def part_literals(spark: SparkSession, d: str) -> DataFrame:
    return documents.literals(_with(spark, d, "part", "p_partkey", text=r"""'x: tr("' || p_name || '") + tr("It\\"s ' || p_brand || '") ; Translation.tr(\'' || p_type || '\') str("no")'"""), "text")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN p_size || '.5' WHEN 2 THEN p_size::VARCHAR WHEN 3 THEN '\"' || p_name || '\"' ELSE '\"' || p_size || 'a\"' END AS json FROM part")
def part_values(spark: SparkSession, d: str) -> DataFrame:
    t = _with(spark, d, "part", "p_partkey", v="CASE p_partkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN p_size || '.5' WHEN 2 THEN ' ' || p_size || ' ' WHEN 3 THEN p_name ELSE p_size || 'a' END")
    return t.select("p_partkey", documents.coerced(_C("v")).alias("json"))


# ---- times and numbers

_CLOCK = "CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END"


@query(f"SELECT o_orderkey, {_CLOCK} AS clock, lpad((s // 6000)::VARCHAR, 2, '0') || ':' || lpad((s % 6000 // 100)::VARCHAR, 2, '0') || '.' || lpad((s % 100)::VARCHAR, 2, '0') AS stopwatch, concat_ws(', ', CASE WHEN s >= 86400 THEN (s // 86400) || 'd' END, CASE WHEN s % 86400 >= 3600 THEN (s % 86400 // 3600) || 'h' END, CASE WHEN s % 3600 >= 60 OR s < 3600 THEN (s % 3600 // 60) || 'm' END) AS uptime FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS s FROM orders)")
def order_durations(spark: SparkSession, d: str) -> DataFrame:
    s = _C("s")
    t = _with(spark, d, "orders", "o_orderkey", s="CAST(floor(o_totalprice) AS BIGINT)")
    return t.select("o_orderkey", timefmt.clock(s).alias("clock"), timefmt.stopwatch(s).alias("stopwatch"), timefmt.uptime(s).alias("uptime"))


@query("SELECT event_id, m BETWEEN 420 AND 1140 AS day, m >= 1140 OR m <= 420 AS night FROM (SELECT event_id, hour(ts) * 60 + minute(ts) AS m FROM events)")
def event_day_ranges(spark: SparkSession, d: str) -> DataFrame:
    a, b = timefmt.minutes_of_day(F.lit("07:00")), timefmt.minutes_of_day(F.lit("19:00"))
    t = _with(spark, d, "events", "event_id", m="hour(ts) * 60 + minute(ts)")
    return t.select("event_id", timefmt.in_day_range(_C("m"), a, b).alias("day"), timefmt.in_day_range(_C("m"), b, a).alias("night"))


@query("WITH t AS (SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) % 7200 AS pos FROM events), c AS (SELECT *, least(pos // 1800, 3) AS cycle, pos - least(pos // 1800, 3) * 1800 AS inside FROM t) SELECT event_id, CASE WHEN inside < 1500 THEN 'focus' WHEN cycle = 3 THEN 'long rest' ELSE 'rest' END AS phase, cycle, CASE WHEN inside < 1500 THEN 1500 - inside ELSE 1800 - inside END AS left_s FROM c")
def event_phases(spark: SparkSession, d: str) -> DataFrame:
    t = _with(spark, d, "events", "event_id", s="hour(ts) * 3600 + minute(ts) * 60 + second(ts)")
    return t.select("event_id", timefmt.cycle_phase(_C("s"), 1500, 300, 300, 4).alias("p")).select("event_id", "p.phase", _C("p.cycle").cast("long").alias("cycle"), _C("p.left").alias("left_s"))


@query("SELECT p_partkey, round(exp((pow(1 + p_partkey, 0.04307) - 1) * -2), 6) AS display FROM part")
def score_displays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(similarity.display_score(-_C("p_partkey").cast("double")), 6).alias("display"))


# ---- colours from keys

_RGB = "WITH v AS (SELECT c_custkey, c_custkey * 7919 % 16777216 AS n FROM customer), t AS (SELECT *, n // 65536 AS r, n // 256 % 256 AS g, n % 256 AS b FROM v)"


def _mixed(channel: str) -> str:
    """Halfway to 128, in doubles from 0 to 1 as colours are kept."""
    return f"round((0.5::DOUBLE * ({channel} / 255::DOUBLE) + 0.5::DOUBLE * (128 / 255::DOUBLE)) * 255)::INTEGER"


@query(_RGB + f" SELECT c_custkey, 4278190080 + n AS argb, printf('#%06X', n) AS back, (299 * r + 587 * g + 114 * b) / 1000 < 128 AS dark, printf('#%02X%02X%02X', {_mixed('r')}, {_mixed('g')}, {_mixed('b')}) AS mixed FROM t")
def customer_colours(spark: SparkSession, d: str) -> DataFrame:
    t = _with(spark, d, "customer", "c_custkey", c="concat('#', lpad(hex(c_custkey * 7919 % 16777216), 6, '0'))")
    rgb = color.from_hex(_C("c"))
    return t.select("c_custkey", color.argb(_C("c")).alias("argb"), color.from_argb(color.argb(_C("c"))).alias("back"), color.is_dark(rgb).alias("dark"), color.to_hex(color.mix(rgb, color.from_hex(F.lit("#808080")))).alias("mixed"))


# ---- rules on names


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'clear_day' WHEN 1 THEN 'weather_hail' ELSE 'cloud' END AS symbol FROM part")
def part_weather(spark: SparkSession, d: str) -> DataFrame:
    t = _with(spark, d, "part", "p_partkey", code="CASE p_partkey % 3 WHEN 0 THEN '113' WHEN 1 THEN '308' ELSE CAST(9000 + p_partkey AS STRING) END")
    return t.select("p_partkey", rules.weather_symbol(_C("code")).alias("symbol"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'visual-studio-code' WHEN 1 THEN 'steam_icon_' || p_partkey WHEN 2 THEN 'gimp' WHEN 3 THEN 'my-app' ELSE 'zzz' || p_partkey END AS icon FROM part")
def part_icons(spark: SparkSession, d: str) -> DataFrame:
    t = _with(spark, d, "part", "p_partkey", app="CASE p_partkey % 5 WHEN 0 THEN 'Code' WHEN 1 THEN 'steam_app_' || p_partkey WHEN 2 THEN 'GIMP' WHEN 3 THEN 'My App' ELSE 'zzz' || p_partkey END")
    return t.select("p_partkey", rules.icon_of(_C("app"), F.array(F.lit("gimp"), F.lit("my-app"))).alias("icon"))


@query("SELECT p_partkey, p_partkey % 4 IN (1, 3) AS real, p_partkey % 2 = 0 AS preview FROM part")
def part_players(spark: SparkSession, d: str) -> DataFrame:
    bus = "'org.mpris.MediaPlayer2.' || CASE p_partkey % 4 WHEN 0 THEN 'firefox.i' || p_partkey WHEN 1 THEN 'mpd' WHEN 2 THEN 'x' || p_partkey || '.mpd' ELSE 'vlc' END"
    t = _with(spark, d, "part", "p_partkey", bus=bus, url="'https://www.youtube.com/' || CASE p_partkey % 2 WHEN 0 THEN 'feed' ELSE 'watch?v=' || p_partkey END")
    return t.select("p_partkey", rules.is_real_player(_C("bus")).alias("real"), rules.is_video_preview(_C("url")).alias("preview"))
