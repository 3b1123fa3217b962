"""Semi-structured values: nested fields, JSON, chat requests, markdown blocks, expressions in text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "array<struct<kind:string,lang:string,content:string,completed:boolean>>"
_BLOCK = re.compile(r"```(\w+)?\n(.*?)```|<think>(.*?)</think>", re.S)


def coerced(value: Column) -> Column:
    """A string as JSON text of the type it looks like: true and false, numbers, else a quoted string."""
    number = F.trim(value).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(value.isin("true", "false"), value).when(number, F.trim(value)).otherwise(F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2))


def with_path(record: Column, path: str, value: Column) -> Column:
    """A struct with the field at a dotted path set."""
    return record.withField(path, value)


def overlaid(base: Column, over: Column, fields: list[str]) -> Column:
    """base's fields, replaced where over has a value; fields that only over has are left out."""
    return F.struct(*[F.coalesce(over[f], base[f]).alias(f) for f in fields])


def merged(*maps: Column) -> Column:
    """Maps merged, later ones win."""
    entries = F.concat(*[F.map_entries(m) for m in maps])
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def flat_pairs(m: Column) -> Column:
    """A map as one array: key, value, key, value."""
    return F.flatten(F.transform(F.map_entries(m), lambda e: F.array(e["key"], e["value"])))


def numbers(c: Column, separator: str = ";") -> Column:
    """Numbers of a separated list; parts that are none are left out."""
    return F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))


def usage_tokens(c: Column, path: str) -> Column:
    """A count in a JSON answer, -1 where absent."""
    return F.coalesce(F.get_json_object(c, path).try_cast("bigint"), F.lit(-1))


def chat_request(messages: Column, model: Column, system: str, temperature: float) -> Column:
    """JSON of a request: the system prompt, then the messages (array of role, content) in order."""
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    all_ = F.concat(first, F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    return F.to_json(F.struct(model.alias("model"), all_.alias("messages"), F.lit(True).alias("stream"), F.lit(temperature).alias("temperature")))


def blocks_of(text: str) -> Iterator[tuple[str, str | None, str, bool]]:
    """(kind, lang, content, completed) of text, code and think blocks in order; blank ones are left out, an unclosed one is not completed."""
    at = 0

    def block(kind: str, content: str, lang: str | None = None, done: bool = True):
        return [(kind, lang, content, done)] if content and content.strip() else []

    for m in _BLOCK.finditer(text):
        yield from block("text", text[at : m.start()])
        yield from block("think", m[3]) if m[0].startswith("<think>") else block("code", m[2], m[1] or "")
        at = m.end()
    rest = text[at:]
    opening = min((p for p in (rest.find("<think>"), rest.find("```")) if p >= 0), default=len(rest))
    yield from block("text", rest[:opening])
    if rest.startswith("<think>", opening):
        yield from block("think", rest[opening + 7 :], None, False)
    elif opening < len(rest):
        head = re.match(r"(\w+)?\n", rest[opening + 3 :])
        yield from block("code", rest[opening + 3 + (head.end() if head else 0) :], (head and head[1]) or "", False)


def register_markdown_blocks(spark: SparkSession, name: str = "markdown_blocks") -> None:
    """A table function for SQL: markdown_blocks(text) gives pos, kind, lang, content, completed."""
    from pyspark.sql.functions import udtf

    class Blocks:
        def eval(self, text: str):
            for i, (kind, lang, content, done) in enumerate(blocks_of(text or "")):
                yield i, kind, lang, content, done

    spark.udtf.register(name, udtf(Blocks, returnType="pos int, kind string, lang string, content string, completed boolean"))


def markdown_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, kind, lang, content, completed: a row for each block."""

    @F.pandas_udf(BLOCKS)
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("kind", "lang", "content", "completed"), b)) for b in blocks_of(t or "")])

    return df.select(key, F.posexplode(split(text)).alias("pos", "b")).select(key, "pos", "b.*")


def joined_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """key, text: blocks back as markdown; code in fences, think blocks as plain text."""
    part = F.when(F.col("kind") == "code", F.concat(F.lit("```"), F.coalesce("lang", F.lit("")), F.lit("\n"), F.regexp_replace("content", r"\s+$", ""), F.lit("\n```"))).otherwise(F.col("content"))
    rows = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("p"))
    return rows.select(key, F.array_join(F.transform("p", lambda x: x["part"]), "").alias("text"))


def formulas(c: Column) -> Column:
    """LaTeX expressions between $$ $$, $ $, \\[ \\] and \\( \\), in order, with their marks."""
    return F.regexp_extract_all(c, F.lit(r"(?s)\$\$.+?\$\$|\$[^$]+?\$|\\\[.+?\\\]|\\\(.+?\\\)"), F.lit(0))


def literals(files: DataFrame, text: str, function: str = "tr") -> DataFrame:
    """text: the different literals passed to a translation function in source texts, unescaped, sorted."""
    from marlow.functions.text import unescaped

    plain = F.regexp_extract_all(text, F.lit(rf"""\b{function}\(\s*"((?:[^"\\]|\\.)*)"\s*[,)]"""), F.lit(1))
    single = F.regexp_extract_all(text, F.lit(rf"""\b{function}\(\s*'((?:[^'\\]|\\.)*)'\s*[,)]"""), F.lit(1))
    return files.select(F.explode(F.concat(plain, single)).alias("text")).select(unescaped(F.col("text")).alias("text")).distinct().orderBy("text")


def modifiers(c: Column) -> Column:
    """Names in a list of modifiers; pieces of one character are left out."""
    return F.filter(F.split(c, r"[+\s]+"), lambda x: F.length(x) > 1)
