"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _replace(c: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def _plain_letters() -> tuple[str, str]:
    """Latin letters that are a letter with marks, and that letter alone; of the blocks up to U+024F and from U+1E00 to U+1EFF."""
    pairs = [(chr(n), unicodedata.normalize("NFD", chr(n))[0]) for n in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b) for a, b in pairs if a != b and "LATIN" in unicodedata.name(a, "")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_accents(c: Column) -> Column:
    """Latin letters without their marks, also where these are characters of their own; other scripts keep their letters."""
    return F.regexp_replace(F.translate(c, *_plain_letters()), "[\u0300-\u036f]", "")


def at_path(column: str, path: str | list[str]) -> Column:
    """A field of a nested record by a dotted name or a list of names."""
    return reduce(lambda c, name: c[name], path.split(".") if isinstance(path, str) else path, F.col(column))


def message_id() -> Column:
    """A new id for each row: the time to the base of 36, and a random part."""
    return F.concat_ws("-", F.lower(F.conv(F.unix_millis(F.current_timestamp()).cast("string"), 10, 36)), F.replace(F.uuid(), F.lit("-"), F.lit("")))


def _regex(c: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), pairs, c)


def fill(template: Column, *values: Column) -> Column:
    """{0}, {1}, ... replaced by the values; other numbers stay."""
    return reduce(lambda x, p: F.replace(x, F.lit(f"{{{p[0]}}}"), p[1]), enumerate(values), template)


def fill_named(template: Column, values: dict[str, Column]) -> Column:
    """Each key replaced by its value, in order."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), p[1]), values.items(), template)


def domain(url: Column) -> Column:
    """Host of a URL with its port, without scheme and www; null where there is none."""
    return F.nullif(F.regexp_extract(url, r"^(?:https?://)?(?:www\.)?([^/]+)", 1), F.lit(""))


def base_url(url: Column) -> Column:
    """Scheme, host and port; null without a scheme."""
    return F.nullif(F.regexp_extract(url, r"^(https?://[^/]+)", 1), F.lit(""))


def shell_quoted(c: Column) -> Column:
    """Safe between single quotes of a shell."""
    return F.replace(c, F.lit("'"), F.lit("'\\''"))


def backslash_escaped(c: Column) -> Column:
    return _replace(c, ("\\", "\\\\"))


def html_escaped(c: Column) -> Column:
    return _replace(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\"", "&quot;"), ("'", "&#39;"))


def wrapped(c: Column, width: int) -> Column:
    """Words laid greedily into lines of at most width characters; a longer word has its own line."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def add(acc: Column, w: Column) -> Column:
        fits = F.length(acc["line"]) + 1 + F.length(w) <= width
        done = F.when(fits | (acc["line"] == ""), acc["done"]).otherwise(F.concat(acc["done"], acc["line"], F.lit("\n")))
        line = F.when(acc["line"] == "", w).when(fits, F.concat(acc["line"], F.lit(" "), w)).otherwise(w)
        return F.struct(done.alias("done"), line.alias("line"))

    return F.aggregate(F.split(c, " "), start, add, lambda acc: F.concat(acc["done"], acc["line"]))


def clean_title(c: Column) -> Column:
    """A track title without bracketed openings of any kind."""
    return F.trim(_regex(c, (r"^ *\([^)]*\) *", " "), (r"^ *\[[^\]]*\] *", " "), (r"^ *\{[^}]*\} *", " "), (r"^ *【[^】]*】", ""), (r"^ *《[^》]*》", ""), (r"^ *「[^」]*」", ""), (r"^ *『[^』]*』", "")))


def without_id(entry: Column) -> Column:
    """A history entry without its leading number and tab."""
    return F.regexp_replace(entry, r"^\d+\t", "")


def urls(c: Column) -> Column:
    """All http(s) URLs of a text, without shortened ones (that hold an ellipsis)."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"(https?://[^\s]+)"), F.lit(1)), lambda u: ~u.contains("…"))


def first_word(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*(\S+)", 1)


def after_first_word(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s*\S+\s*", "")


def trailing_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)\s*$", 1), F.lit("")).try_cast("bigint")


def without_file_scheme(c: Column) -> Column:
    return F.regexp_replace(c, "^file://", "")


def file_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.element_at(F.split(without_file_scheme(path), r"[\\/]"), -1)


def folder_name(path: Column) -> Column:
    """Last part of a path, one trailing slash aside."""
    return file_name(F.regexp_replace(without_file_scheme(path), "/$", ""))


def without_extension(path: Column) -> Column:
    """The path up to the last dot of its last part."""
    return F.regexp_replace(without_file_scheme(path), r"\.[^./]*$", "")


def parent_folder(path: Column) -> Column:
    """The path up to its last slash or backslash; empty without one."""
    p = without_file_scheme(path)
    return F.when(p.rlike(r"[\\/]"), F.array_join(F.slice(F.split(p, r"[\\/]"), F.lit(1), F.size(F.split(p, r"[\\/]")) - 1), "/")).otherwise("")


def last_segment(reverse_domain: Column) -> Column:
    return F.substring_index(reverse_domain, ".", -1)


def kebab(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+", "-")


def camel(snake: Column) -> Column:
    """snake_case as camelCase."""
    parts = F.split(snake, "_")
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), ""))


def safe_name(c: Column) -> Column:
    """A model's name as an id: colons become underscores, blanks and slashes hyphens."""
    return _regex(c, (":", "_"), ("[ /]", "-"))


def pretty_name(c: Column) -> Column:
    """model-name:8b as "Model Name (8B)": words with capitals, the last in brackets; a last word "latest" is left out."""
    words = F.split(F.regexp_replace(F.regexp_replace(c, "[-:]", " "), r"(\d+)b$", "$1B"), " ")
    words = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))
    last, rest = F.element_at(words, -1), F.slice(words, F.lit(1), F.size(words) - 1)
    return F.array_join(F.when(last == "Latest", rest).otherwise(F.array_append(rest, F.concat(F.lit("("), last, F.lit(")")))), " ")


def first_rule(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The value of the first rule whose key the text contains; a key that begins with "startswith:" must open the text. Case is ignored."""
    low = F.lower(c)
    tests = [(low.startswith(k.removeprefix("startswith:")) if k.startswith("startswith:") else low.contains(k), v) for k, v in rules]
    out = F.when(*tests[0][:1], tests[0][1])
    for t, v in tests[1:]:
        out = out.when(t, v)
    return out.otherwise(default)


# Browsers whose notifications open with a link to the site.
BROWSERS = ["brave", "chrome", "chromium", "vivaldi", "opera", "microsoft edge"]


def message_body(body: Column, app: Column, apps: list[str] = BROWSERS) -> Column:
    """A notification's body; for applications with one of these names in theirs, a first paragraph that is a link is left out."""
    parts = F.split(body, "\n\n")
    named = reduce(lambda a, b: a | b, [F.lower(app).contains(x) for x in apps])
    drop = F.coalesce(named, F.lit(False)) & (F.size(parts) > 1) & F.get(parts, F.lit(0)).startswith("<a")
    return F.when(drop, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "\n\n")).otherwise(body)


def section(c: Column, n: int) -> Column:
    """The n-th part (from 0) between blank lines."""
    return F.get(F.split(F.trim(c), r"\n\s*\n"), F.lit(n))


def unescaped(c: Column) -> Column:
    """Escapes of a source literal resolved; the double backslash last of all pairs is kept apart by a control character."""
    return _replace(c, ("\\\\", "\x01"), ("\\n", "\n"), ("\\t", "\t"), ("\\\"", "\""), ("\\'", "'"), ("\x01", "\\"))


def path_encoded(c: Column) -> Column:
    """Percent-encoded, slashes kept."""
    return _replace(F.url_encode(c), ("%2F", "/"), ("%7E", "~"), ("+", "%20"), ("*", "%2A"))


def command_element(rule: Column) -> Column:
    """The process of a restore rule `process->command`; a leading tilde is not part of it."""
    return F.regexp_replace(F.substring_index(rule, "->", 1), "^~", "")


def command_strategy(rule: Column, arguments: Column) -> Column:
    """The command to restore: after `->` if there is one, with `*` standing for the arguments."""
    command = F.when(rule.contains("->"), F.regexp_replace(rule, "^.*?->", "")).otherwise(command_element(rule))
    return F.trim(F.replace(command, F.lit("*"), arguments))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def without_sites(query: Column, sites: Column) -> Column:
    """A search query with ` -site:x` for each site of an array; empty names are left out."""
    return F.concat(query, F.array_join(F.transform(F.filter(sites, lambda s: s != ""), lambda s: F.concat(F.lit(" -site:"), s)), ""))


def image_label(entry: Column) -> Column:
    """id, width and height of a history entry for an image, 0 where absent."""
    part = lambda pattern: F.coalesce(F.regexp_extract(entry, pattern, 1).try_cast("int"), F.lit(0))
    return F.struct(part(r"^(\d+)\t").alias("id"), part(r"(\d+)x\d+").alias("width"), part(r"\d+x(\d+)").alias("height"))


def with_last_word(c: Column, word: Column) -> Column:
    """The text with its last word replaced."""
    return F.concat(F.regexp_replace(F.trim(c), r"\S+$", ""), word)


def plus_for_spaces(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s+", "+")


def is_image_entry(entry: Column) -> Column:
    return entry.rlike(r"^\d+\t\[\[.*binary data.*\d+x\d+.*\]\]$")


def highlighted(c: Column, matched: Column, opening: str = "<b>", closing: str = "</b>") -> Column:
    """The text with marks around each run of matched positions (ascending, from 0)."""
    marks = F.transform(F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0))), lambda i: F.concat(
        F.when(F.array_contains(matched, i) & ~F.array_contains(matched, i - 1), opening).otherwise(""), F.substring(c, i + 1, F.lit(1)),
        F.when(F.array_contains(matched, i) & ~F.array_contains(matched, i + 1), closing).otherwise("")))
    return F.array_join(marks, "")
