"""Text and path helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extname(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def normalize_path(path: Column) -> Column:
    """Folds `.` and `..`."""
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def tokens(name: Column) -> Column:
    """Before every capital, at _ and -, lower-cased, empties dropped."""
    return F.filter(F.transform(F.split(name, "(?=[A-Z])|_|-"), F.lower), lambda t: t != "")


def word_tokens(name: Column) -> Column:
    """At lower-to-upper changes, before the last capital of an acronym that a word follows, and at white space, _, -, . and /."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[\s_\-./]+"), lambda t: t != "")


def symbol_tokens(name: Column) -> Column:
    """At changes from lower case or digit to upper case, and at everything that is no letter or digit."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda t: t != "")


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def has_any(array: Column, *terms: str) -> Column:
    return F.arrays_overlap(array, F.array(*[F.lit(t) for t in terms]))


def contains_any(text: Column, *terms: str) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def plural(kind: Column) -> Column:
    """A kind in the plural, by its ending."""
    return F.when(F.rlike(kind, F.lit("(s|ch|sh|x)$")), F.concat(kind, F.lit("es"))).when(F.rlike(kind, F.lit("(?i)[^aeiou]y$")) & F.endswith(kind, F.lit("y")), F.concat(F.substring(kind, F.lit(1), F.length(kind) - 1), F.lit("ies"))).otherwise(F.concat(kind, F.lit("s")))


#: How parts of a region's label are said, and those that modify the part after them.
LABEL_WORDS = {"explain": "explanation", "impact": "impact analysis", "resolve": "resolution", "resolution": "resolution", "conflict": "conflict-resolution", "ingestion": "ingestion", "parsers": "parser", "cli": "CLI", "api": "API", "db": "database", "github": "GitHub"}


def humanize(label: Column) -> Column:
    """A region's label as a phrase: without a remark in brackets, its parts in words, and `layer`."""
    said = F.create_map(*[F.lit(x) for kv in LABEL_WORDS.items() for x in kv])
    word = lambda p: F.coalesce(F.element_at(said, F.lower(F.trim(p))), F.lower(F.trim(p)))
    parts = F.transform(F.split(F.regexp_replace(label, r"\s*\([^)]*\)\s*$", ""), " / "), word)
    first = F.get(parts, 0)
    short = (first == F.upper(first)) & F.length(first).between(2, 4)
    return F.concat(F.when(short, F.array_join(parts, " ")).otherwise(F.array_join(parts, " and ")), F.lit(" layer"))


def join_path(base: Column, more: Column) -> Column:
    """more below base, folded; a leading .. that nothing is left for stays."""
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array_append(acc, p))
    parts = F.aggregate(F.split(F.concat(base, F.lit("/"), more), "/"), F.array().cast("array<string>"), step)
    return F.when(F.size(parts) == 0, F.lit(".")).otherwise(F.array_join(parts, "/"))


def relative_path(path: Column, root: str, home: str | None = None) -> Column:
    """A path below root without it, one below home with ~, others and relative ones as they are; empty is null."""
    out = F.when(F.coalesce(path, F.lit("")) == "", F.lit(None)).when(~F.startswith(path, F.lit("/")) & ~F.rlike(path, F.lit(r"^[A-Za-z]:[\\/]")), path)
    out = out.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path)))
    return (out.when(F.startswith(path, F.lit(home)), F.concat(F.lit("~"), F.substring(path, F.lit(len(home) + 1), F.length(path)))) if home else out).otherwise(path)


def raw_id(text: Column) -> Column:
    """Whether a text is an id rather than a name: UUID-shaped, or 32 hex digits or more."""
    return F.rlike(text, F.lit("(?i)^([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{32,}$)"))


def llm_quote(value: Column) -> Column:
    """Values with white space, a quote, =, a backslash or a control character are quoted and escaped."""
    escaped = value
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(code))
    return F.when(F.rlike(value, F.lit(r'[\s"=\\\x00-\x1f]')), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(value)


def llm_line(record: str | Column, **fields: Column) -> Column:
    """One record a line: its type, then key=value; null and empty fields are left out."""
    first = F.lit(record) if isinstance(record, str) else record
    return F.concat_ws(" ", first, *[F.when(v.cast("string") != "", F.concat(F.lit(f"{k}="), llm_quote(v.cast("string")))) for k, v in fields.items()])
