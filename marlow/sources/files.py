"""Readers for the file formats at hand, and the sinks that write them. All take paths that Spark can open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marlow.operators import scans

# ---- JSON


def json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document that is an array of records; a missing file is an empty table of that schema."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def json_map(df: DataFrame, text: str) -> DataFrame:
    """key, value of JSON objects in a text column; text that is no object gives no rows."""
    return df.select(F.explode(F.from_json(text, "map<string,string>")).alias("key", "value"))


def json_files_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A watched document: each version is a new file in the folder."""
    return spark.readStream.schema(schema).option("multiLine", True).json(path)


_CURRENT = ("uvIndex", "humidity", "winddir16Point", "weatherCode", "windspeedMiles", "windspeedKmph", "precipInches", "precipMM", "visibilityMiles", "visibility", "pressureInches", "pressure", "temp_F", "temp_C", "FeelsLikeF", "FeelsLikeC")


def weather(raw: Column) -> Column:
    """current, location, astronomy of a weather answer in JSON as one struct."""
    kind = "current_condition array<struct<" + ",".join(f"{c}:string" for c in _CURRENT) + ">>, nearest_area array<struct<areaName:array<struct<value:string>>>>, weather array<struct<astronomy:array<struct<sunrise:string,sunset:string>>>>"
    w = F.from_json(raw, kind)
    return F.struct(F.get(w["current_condition"], F.lit(0)).alias("current"), F.get(F.get(w["nearest_area"], F.lit(0))["areaName"], F.lit(0))["value"].alias("location"), F.get(F.get(w["weather"], F.lit(0))["astronomy"], F.lit(0)).alias("astronomy"))


def weather_row(w: Column, us: bool) -> Column:
    """The thirteen values to show, in one system of units; absent and empty ones have a default."""
    cur = w["current"]
    or_ = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    unit = lambda c, u: F.concat(or_(cur[c], "0"), F.lit(u))
    measured = {"wind": ("windspeedMiles", " mph"), "precip": ("precipInches", " in"), "visib": ("visibilityMiles", " m"), "press": ("pressureInches", " psi"), "temp": ("temp_F", "°F"), "tempFeelsLike": ("FeelsLikeF", "°F")}
    if not us:
        measured = {"wind": ("windspeedKmph", " km/h"), "precip": ("precipMM", " mm"), "visib": ("visibility", " km"), "press": ("pressure", " hPa"), "temp": ("temp_C", "°C"), "tempFeelsLike": ("FeelsLikeC", "°C")}
    plain = {"uv": or_(cur["uvIndex"], "0"), "humidity": unit("humidity", "%"), "sunrise": or_(w["astronomy"]["sunrise"], "0.0"), "sunset": or_(w["astronomy"]["sunset"], "0.0"), "windDir": or_(cur["winddir16Point"], "N"), "wCode": or_(cur["weatherCode"], "113"), "city": or_(w["location"], "City")}
    return F.struct(*[c.alias(n) for n, c in (plain | {n: unit(*x) for n, x in measured.items()}).items()])


def first_url(raw: Column) -> Column:
    return F.get_json_object(raw, "$[0].file_url")


# ---- text


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def records_by_marker(spark: SparkSession, path: str, marker: str = "\n\n") -> DataFrame:
    """Records between markers."""
    return spark.read.text(path, lineSep=marker)


def whole_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, value of all files under a folder."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def after_sentinel(df: DataFrame, text: str, sentinel: str) -> DataFrame:
    """pos, line of the part behind a sentinel line; blank lines are left out, texts without it give nothing."""
    part = F.get(F.split(text, rf"(?m)^\Q{sentinel}\E\R?", 2), F.lit(1))
    rows = df.select(F.posexplode(F.split(part, r"\R")).alias("pos", "line"))
    return rows.where(F.trim("line") != "")


def tagged(df: DataFrame, line: str, tag: str, columns: list[str]) -> DataFrame:
    """Tab-separated records of one tag; a leading colon keeps a possibly empty value and is taken off."""
    parts = F.split(line, "\t")
    rows = df.where(F.get(parts, F.lit(0)) == tag)
    return rows.select(*[F.regexp_replace(F.get(parts, F.lit(i + 1)), "^:", "").alias(c) for i, c in enumerate(columns)])


def escaped_fields(line: Column, separator: str = ":") -> Column:
    """Fields of a line whose separator may be escaped by a backslash."""
    return F.transform(F.split(line, rf"(?<!\\){separator}", -1), lambda x: F.replace(x, F.lit(f"\\{separator}"), F.lit(separator)))


def access_points(df: DataFrame, line: str) -> DataFrame:
    """active, strength, frequency, ssid, bssid, security of terse scan lines; networks without a name are left out."""
    f = escaped_fields(F.col(line))
    at = lambda i: F.get(f, F.lit(i))
    number = lambda c: F.regexp_extract(c, r"(\d+)", 1).try_cast("int")
    return df.select((at(0) == "yes").alias("active"), number(at(1)).alias("strength"), number(at(2)).alias("frequency"), at(3).alias("ssid"), at(4).alias("bssid"), F.coalesce(at(5), F.lit("")).alias("security")).where("ssid <> ''")


def assignments(df: DataFrame, text: str) -> DataFrame:
    """key, value of KEY="value" lines in whole texts."""
    rows = df.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^[A-Z_]+=.*$"), F.lit(0))).alias("x"))
    return rows.select(F.substring_index("x", "=", 1).alias("key"), F.regexp_replace(F.regexp_replace("x", "^[A-Z_]+=", ""), '^"|"$', "").alias("value"))


def style_colours(df: DataFrame, line: str) -> DataFrame:
    """name, colour of `$name: #RRGGBB;` lines."""
    p = r"^\s*\$([\w-]+)\s*:\s*(#[0-9A-Fa-f]{6})\s*;"
    return df.where(F.col(line).rlike(p)).select(F.regexp_extract(line, p, 1).alias("name"), F.regexp_extract(line, p, 2).alias("colour"))


def sampled(text: Column, name: str) -> Column:
    """The number behind a name in a status text."""
    return F.regexp_extract(text, rf"(?m)^{name}:?\s+(\d+)", 1).try_cast("bigint")


def cpu_counters(text: Column) -> Column:
    """The counters of the first cpu line."""
    return F.transform(F.regexp_extract_all(F.regexp_extract(text, r"(?m)^cpu\s+(.*)$", 1), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("bigint"))


def packages(df: DataFrame, manager: str, line: str, arrow: bool = True) -> DataFrame:
    """manager, name, cur, new of update lists: `name old -> new` lines, or name and new version in columns."""
    p = F.split(F.trim(line), r"\s+")
    at = lambda i: F.get(p, F.lit(i))
    if arrow:
        rows = df.where((F.size(p) >= 4) & (at(2) == "->"))
        return rows.select(F.lit(manager).alias("manager"), at(0).alias("name"), at(1).alias("cur"), at(3).alias("new"))
    rows = df.where((F.size(p) >= 2) & (at(0) != "Name"))
    return rows.select(F.lit(manager).alias("manager"), at(0).alias("name"), F.lit("").alias("cur"), at(1).alias("new"))


def with_sourced(spark: SparkSession, path: str, base: str) -> DataFrame:
    """Lines of a configuration file and of the files its source lines name, and theirs, each file once. Such files are few, so their names are gathered."""
    seen, new = [], [path]
    while new:
        seen += new
        named = spark.read.text(new).select(F.regexp_extract("value", r"^\s*source(?:-file)?\s+(?:-q\s+)?['\"]?([^'\"\s]+)", 1).alias("p")).where("p <> ''").distinct().collect()
        # a file that was seen ends a circle
        new = sorted({r.p if r.p.startswith("/") else f"{base}/{r.p}" for r in named} - set(seen))
    return spark.read.text(seen)


# ---- key bindings


def bindings(df: DataFrame) -> DataFrame:
    """lineno, section, depth, mods, key, dispatcher, params, comment of binding lines.

    Lines `#!`, `##!`, ... open a section of that depth; `bind... = MODS, key, dispatcher, params # comment`;
    `#/# bind` is a binding for display alone; a comment with [hidden] hides the line. df: lineno, line and,
    for several files, file; the lines of one file are one order.
    """
    head = F.regexp_extract("line", r"^(#+)!\s*(.*)$", 1)
    title = F.when(head != "", F.struct(F.length(head).alias("depth"), F.regexp_extract("line", r"^(#+)!\s*(.*)$", 2).alias("name")))
    rows = scans.last_known(df, title, [c for c in ("file",) if c in df.columns], ["lineno"], "_h")
    p = r"^\s*(?:#/#\s*)?bind[a-z]*\s*=\s*([^,#]*),\s*([^,#]*)(?:,\s*([^,#]*))?(?:,\s*([^#]*))?(?:#\s*(.*))?$"
    rows = rows.where(F.col("line").rlike(p) & ~F.col("line").contains("[hidden]"))
    part = lambda i: F.trim(F.regexp_extract("line", p, i))
    mods = F.filter(F.split(part(1), r"[+\s]+"), lambda x: F.length(x) > 1)
    return rows.select(*[c for c in ("file",) if c in df.columns], "lineno", F.coalesce("_h.name", F.lit("")).alias("section"), F.coalesce("_h.depth", F.lit(0)).alias("depth"), mods.alias("mods"), part(2).alias("key"), part(3).alias("dispatcher"), part(4).alias("params"), part(5).alias("comment"))


# ---- folders, nested documents, streams of lines


def listing(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, modified, length of files by a case-insensitive glob, newest first; contents are not read."""
    pattern = "(?i)(" + "|".join(g.replace(".", r"\.").replace("*", ".*") for g in glob.strip("{}").split(",")) + ")$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("modified"), "length")
    return files.where(F.element_at(F.split("path", "/"), -1).rlike("^" + pattern)).orderBy(F.desc("modified"), "path")


def unfocused_siblings(df: DataFrame, tree: str, own: int) -> DataFrame:
    """Ids of the windows beside window `own` in its tab that have no focus; df holds array<struct<tabs>> documents."""
    tabs = df.select(F.explode(tree).alias("w")).select(F.explode("w.tabs").alias("t"))
    return tabs.where(F.exists("t.windows", lambda w: w["id"] == own)).select(F.explode("t.windows").alias("w")).where(~F.col("w.is_focused")).select("w.id")


def event_data(line: Column) -> Column:
    """The payload of a server-sent-event line; comments, blank lines and the closing mark are null."""
    data = F.trim(F.regexp_replace(line, "^data:", ""))
    return F.when((F.trim(line) == "") | line.startswith(":") | (data == "[DONE]"), F.lit(None)).otherwise(data)


def framed(df: DataFrame, key: str) -> DataFrame:
    """key, part, json: objects of a streamed JSON array whose brackets and commas stand on lines of their own. df: key, seq, line."""
    cut = F.col("line").isin("[", "]", ",")
    rows = scans.running_sum(df, cut.cast("int"), [key], ["seq"], "part").where(~cut).groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("l"))
    return rows.select(key, "part", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("json"))


# ---- image boards: one shape for all providers

POST = ["id", "width", "height", "aspect_ratio", "tags", "rating", "is_nsfw", "md5", "preview_url", "sample_url", "file_url", "file_ext", "source"]


def posts(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Provider rows with columns renamed to the common ones; width / height and the flag are computed, a missing file type comes from the URL."""
    have = lambda c: F.col(names.get(c, c)) if names.get(c, c) in df.columns else F.lit(None).cast("string")
    rating = F.substring(F.lower(have("rating")), 1, 1)
    rating = F.when(rating == "g", "s").otherwise(rating)
    made = {"aspect_ratio": F.try_divide(have("width").cast("double"), have("height").cast("double")), "rating": rating, "is_nsfw": rating != "s", "file_ext": F.coalesce(have("file_ext"), F.element_at(F.split(have("file_url"), r"\."), -1)), "sample_url": F.coalesce(have("sample_url"), have("file_url"))}
    return df.select(*[made.get(c, have(c)).alias(c) for c in POST])


def union_posts(*tables: DataFrame) -> DataFrame:
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t, allowMissingColumns=True)
    return first


class Staged(DataSource):
    """A provider's answers as rows (url, status, body): spark.read.format("staged").option("urls", "a b").load().

    A failed request is a row with status -1 and the message, so one provider's failure stops nothing. Each
    URL is a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "staged"

    def schema(self) -> str:
        return "url string, status int, body string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _StagedReader(self.options)


class _StagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls, self.agent = options.get("urls", "").split(), options.get("userAgent", "marlow")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition):
        import urllib.request

        try:
            with urllib.request.urlopen(urllib.request.Request(partition.value, headers={"User-Agent": self.agent}), timeout=30) as r:
                yield partition.value, getattr(r, "status", None) or 200, r.read().decode("utf-8", "replace")
        except (OSError, ValueError) as e:
            yield partition.value, -1, str(e)


def archived(files: DataFrame) -> DataFrame:
    """path, name, text of the members of gzip tar files (path, content); files that are none have no rows."""

    def run(batches):
        import io
        import tarfile

        import pandas as pd

        for pdf in batches:
            out = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                try:
                    with tarfile.open(fileobj=io.BytesIO(bytes(raw)), mode="r:gz") as tar:
                        out += [(path, m.name, tar.extractfile(m).read().decode("utf-8", "replace")) for m in tar if m.isfile()]
                except (tarfile.TarError, OSError):
                    continue
            yield pd.DataFrame(out, columns=["path", "name", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, text string")


# ---- sinks


def write_json(df: DataFrame, path: str) -> None:
    """The whole document again."""
    df.write.mode("overwrite").json(path)


def write_if_changed(df: DataFrame, path: str, backup: str | None = None) -> bool:
    """Write only if the rows differ from those at path (Parquet); the old ones go to backup first. Whether it wrote."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        old = spark.read.parquet(path)
        if old.columns == df.columns and old.exceptAll(df).isEmpty() and df.exceptAll(old).isEmpty():
            return False
        if backup:
            old.write.mode("overwrite").parquet(backup)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(p, True)
    fs.rename(new, p)
    return True


def tagged_lines(*tables: tuple[str, DataFrame]) -> DataFrame:
    """line: records of several types as tab-separated lines with their tag first."""
    parts = [df.select(F.concat_ws("\t", F.lit(tag), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("line")) for tag, df in tables]
    return union_posts(*parts)


def updated_config(df: DataFrame, values: DataFrame, line: str = "line") -> DataFrame:
    """Lines with `key=value` replaced where values(key, value) has the key, missing keys behind. df: pos, line."""
    key = F.trim(F.regexp_extract(line, r"^([^=#]+)=", 1))
    known = df.withColumn("key", key).join(values, "key", "left")
    out = known.select("pos", F.when(F.col("value").isNotNull(), F.concat("key", F.lit("="), "value")).otherwise(F.col(line)).alias(line))
    more = values.join(df.select(key.alias("key")), "key", "left_anti")
    last = F.lit(2**31 - 1)
    return out.unionByName(more.select(last.alias("pos"), F.concat("key", F.lit("="), "value").alias(line)))


def _signature(columns: list[str]) -> Column:
    """One text for a set of rows, whatever their order: their number and the sums of both halves of their hashes, so nothing is gathered."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return F.sha2(F.concat_ws(",", F.count("*").cast("string"), half(1), half(16)), 256)


def signatures(inputs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, signature of the rows of each key."""
    return inputs.groupBy(key).agg(_signature(columns).alias("signature"))


def is_stale(inputs: DataFrame, columns: list[str], stored: str | None) -> tuple[bool, str]:
    """Whether a cache made from these rows must be made again, and the rows' signature."""
    sign = inputs.agg(_signature(columns)).first()[0]
    return sign != stored, sign


def style_lines(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.select(F.format_string("$%s: %s;", name, value).alias("line"))
