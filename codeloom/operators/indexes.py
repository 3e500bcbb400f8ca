"""Inverted indexes over a code base, and the resolution of import specifiers to files.

files(path, language), entities(path, name, container), exports(path, local, public).
All indexes are one long table (index, key, path, value), so that it can be
stored once, clustered by index, and each lookup is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import ids
from codeloom.functions import text as X

#: How many trailing segments of a directory are indexed, extensions that a specifier may carry, entry names of a repository.
SUFFIXES = 8
SPECIFIER_EXTENSION = r"\.(js|ts|mjs|cjs|jsx|tsx|py|scala|java|c|cc|cpp|cxx|h|hh|hpp|hxx|[Ss][Aa][Ss])$"
ENTRY_NAMES = ("index", "main", "mod", "lib", "__init__", "app", "init")
#: What a relative specifier may stand for, in the order in which it is tried.
JS_SUFFIXES = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".d.ts")
TS_SUFFIXES = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs")
JS_FOR_JS = (".js", ".ts", ".tsx", ".d.ts")
TS_FOR_JS = (".ts", ".tsx", ".d.ts", ".js")
JS_FOR_JSX = (".jsx", ".tsx", ".d.ts")
TS_FOR_JSX = (".tsx", ".d.ts", ".jsx")


def family(language: Column) -> Column:
    """JavaScript with TypeScript, C with C++; others on their own."""
    return F.when(language.isin("javascript", "typescript"), "js").when(language.isin("c", "cpp"), "c").otherwise(language)


def stem(path: Column) -> Column:
    """The name of a file without its extension; a name that starts with its only dot has none."""
    return F.regexp_replace(X.basename(path), r"(?<=.)\.[^.]*$", "")


def suffixes(parts: Column, sep: str) -> Column:
    """The last 1 to SUFFIXES of parts, joined."""
    return F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(SUFFIXES))), lambda k: F.array_join(F.slice(parts, -k, k), sep))


def _parts(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")


def build(files: DataFrame, entities: DataFrame | None = None, exports: DataFrame | None = None) -> DataFrame:
    """(index, key, path, value): stem, dir, package, go-dir, go-path and path of files; symbol and qkey of entities; public of exports."""
    row = lambda df, name, key, value=None: df.select(F.lit(name).alias("index"), key.alias("key"), "path", (F.lit(None).cast("string") if value is None else value).alias("value"))
    ext, directory = X.extname(F.col("path")), _parts(X.dirname(F.col("path")))
    some = F.size(directory) > 0
    out = [
        row(files, "stem", stem(F.col("path"))),
        row(files.where(stem(F.col("path")) == "index").where(some), "dir", F.element_at(directory, -1)),
        row(files.where(ext.isin(".scala", ".java")).where(some), "package", F.explode(suffixes(directory, "."))),
        row(files.where(ext == ".go").where(some), "go-dir", F.element_at(directory, -1)),
        row(files.where(ext == ".go").where(some), "go-path", F.explode(suffixes(directory, "/"))),
        row(files, "path", ids.norm_path(F.col("path"))),
    ]
    if entities is not None:
        out.append(row(entities, "symbol", F.col("name")))
        out.append(row(entities, "qkey", F.col("name"), ids.qualified_key(F.col("container"), F.col("name"))))
    if exports is not None:
        out.append(row(exports, "public", F.col("public"), F.col("local")))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every.distinct()


def lookup(index: DataFrame, name: str, key: str = "key", value: str | None = None) -> DataFrame:
    """(key, target) of one index, and its value."""
    return index.where(F.col("index") == name).select(F.col("key").alias(key), F.col("path").alias("target"), *([F.col("value").alias(value)] if value else []))


def go_prescan(files: DataFrame) -> DataFrame:
    """(path, name) of files(path, content) in Go: the package, exported types, functions and methods, without a parser."""
    found = lambda pattern: F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
    package = F.slice(found(r"(?m)^package\s+(\w+)"), 1, 1)
    names = F.array_distinct(F.concat(package, found(r"(?m)^type\s+([A-Z]\w*)\s+"), found(r"(?m)^func\s+([A-Z]\w*)\s*[(\[]"), found(r"(?m)^func\s+\([^)]+\)\s+([A-Z]\w*)\s*[(\[]")))
    return files.where(X.extname(F.col("path")) == ".go").select("path", F.explode(names).alias("name"))


def best_key(asked: DataFrame, index: DataFrame) -> DataFrame:
    """asked(id, target, name, preferred) with qkey: the preferred key if the file has it, else its only key for the name, else null."""
    keys = lookup(index, "qkey", "name", "value").distinct()
    found = asked.join(keys, ["target", "name"]).groupBy("id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.bool_or(F.col("value") == F.col("preferred")).alias("has"))
    out = asked.join(found, "id", "left")
    return out.withColumn("qkey", F.when(F.coalesce("has", F.lit(False)), F.col("preferred")).when(F.col("low") == F.col("high"), F.col("low"))).drop("low", "high", "has")


def spellings(module: Column) -> Column:
    """Up to six spellings of a module under which files may be indexed: as it is, without leading signs, extension, directories, or all but its last dotted part."""
    bare = F.regexp_replace(module, r"^[^a-zA-Z0-9_]+", "")
    short = F.regexp_replace(module, SPECIFIER_EXTENSION, "")
    last = F.when(F.contains(module, F.lit(".")), F.regexp_extract(module, r"\.([^.]*)$", 1))
    return F.array_distinct(F.filter(F.array(module, bare, short, X.basename(module), X.basename(short), last), lambda s: F.coalesce(s, F.lit("")) != ""))


def module_files(imports: DataFrame, index: DataFrame) -> DataFrame:
    """(id, target) of imports(id, path, module): files that any spelling, package or Go directory of the module names, without the importing file."""
    spelled = imports.select("id", "path", F.explode(spellings(F.col("module"))).alias("key"))
    by_name = spelled.join(index.where(F.col("index").isin("stem", "dir")).select("key", F.col("path").alias("target")), "key")
    whole = imports.select("id", "path", F.col("module").alias("key"))
    by_package = whole.join(index.where(F.col("index").isin("package", "go-dir")).select("key", F.col("path").alias("target")), "key")
    tail = imports.select("id", "path", F.explode(suffixes(_parts(F.col("module")), "/")).alias("key"))
    by_path = tail.join(lookup(index, "go-path"), "key")
    found = by_name.unionByName(by_package).unionByName(by_path)
    return found.where("target <> path").select("id", "target").distinct()


def relative_path(path: Column, language: Column, raw: Column) -> Column:
    """Where a relative specifier of JavaScript, TypeScript or Python points; null if it is not relative."""
    here = X.dirname(F.replace(path, F.lit("\\"), F.lit("/")))
    script = X.join_path(here, F.regexp_replace(raw, r"[?#].*$", ""))
    dots = F.length(F.regexp_extract(raw, r"^\.+", 0))
    up = F.concat(here, F.repeat(F.lit("/.."), dots - 1))
    module = X.join_path(up, F.replace(F.substring(raw, dots + 1, F.length(raw)), F.lit("."), F.lit("/")))
    return F.when(language.isin("javascript", "typescript") & F.rlike(raw, F.lit(r"^\.\.?/")), script).when((language == "python") & F.startswith(raw, F.lit(".")), module)


def relative_candidates(language: Column, target: Column) -> Column:
    """Paths that a relative target may stand for, in the order in which they are tried."""
    ext = X.extname(target)
    base = F.substring(target, F.lit(1), F.length(target) - F.length(ext))
    each = lambda at, ends: F.array(*[F.concat(at, F.lit(e)) for e in ends])
    js = language == "javascript"
    index = F.concat(target, F.lit("/index"))
    plain = F.when(js, F.concat(each(target, JS_SUFFIXES), each(index, JS_SUFFIXES))).otherwise(F.concat(each(target, TS_SUFFIXES), each(index, TS_SUFFIXES)))
    script = F.when(ext == "", plain).when(ext == ".js", F.when(js, each(base, JS_FOR_JS)).otherwise(each(base, TS_FOR_JS))).when(ext == ".jsx", F.when(js, each(base, JS_FOR_JSX)).otherwise(each(base, TS_FOR_JSX))).otherwise(F.array(target))
    python = F.when(F.endswith(target, F.lit(".py")), F.array(target)).otherwise(F.array(F.concat(target, F.lit("/__init__.py")), F.concat(target, F.lit(".py"))))
    return F.when(language == "python", python).otherwise(script)


def relative_files(imports: DataFrame, index: DataFrame) -> DataFrame:
    """(id, target) of imports(id, path, language, raw) with a relative specifier: the first candidate that is a file; target is null where none is."""
    asked = imports.withColumn("at", relative_path(F.col("path"), F.col("language"), F.col("raw"))).where("at is not null")
    tried = asked.select("id", "path", F.posexplode(relative_candidates(F.col("language"), F.col("at"))).alias("k", "candidate")).withColumn("key", ids.norm_path(F.col("candidate")))
    hits = tried.join(lookup(index, "path"), "key").where(ids.norm_path(F.col("target")) != ids.norm_path(F.col("path")))
    first = hits.groupBy("id").agg(F.min("k").alias("k"))
    return asked.select("id").join(hits.join(first, ["id", "k"]).select("id", "target").distinct(), "id", "left")


def go_anchor(matches: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, target) of matches(id, target) in one directory: no test, the file named like the directory if it is the only such, else most imports, most entities, first name.

    weights(path, n_imports, n_entities).
    """
    rows = matches.join(weights.select(F.col("path").alias("target"), "n_imports", "n_entities"), "target", "left").fillna(0, ["n_imports", "n_entities"])
    rows = rows.withColumn("test", F.endswith("target", F.lit("_test.go"))).withColumn("named", F.lower(stem(F.col("target"))) == F.lower(F.element_at(_parts(X.dirname(F.col("target"))), -1)))
    each = Window.partitionBy("id")
    rows = rows.withColumn("pool", ~F.col("test") | (F.min(F.col("test").cast("int")).over(each) == 1))
    rows = rows.where("pool").withColumn("only", F.count_if("named").over(each) == 1)
    order = [F.desc(F.col("named") & F.col("only")), F.desc("n_imports"), F.desc("n_entities"), F.col("target")]
    return rows.withColumn("rn", F.row_number().over(each.orderBy(*order))).where("rn = 1").select("id", "target")


def go_narrowed(matches: DataFrame, weights: DataFrame | None) -> DataFrame:
    """(id, target) of matches(id, module, target): those whose directory ends with the longest suffix of the module; of one directory its anchor.

    Without weights all files of a single directory stay, as for qualifiers.
    """
    directory = X.dirname(F.replace("target", F.lit("\\"), F.lit("/")))
    ends = lambda s: (directory == s) | F.endswith(directory, F.concat(F.lit("/"), s))
    length = F.coalesce(F.array_max(F.transform(F.filter(suffixes(_parts(F.col("module")), "/"), ends), F.length)), F.lit(-1))
    each = Window.partitionBy("id")
    rows = matches.withColumn("dir", directory).withColumn("len", length)
    rows = rows.withColumn("best", F.max("len").over(each)).where("len = best")
    dirs = rows.groupBy("id").agg((F.min("dir") == F.max("dir")).alias("single"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(dirs, "id")
    if weights is None:
        return rows.select("id", "target")
    one = go_anchor(rows.where("single and n > 1").select("id", "target"), weights)
    return rows.where("not single or n = 1").select("id", "target").unionByName(one)


def import_targets(imports: DataFrame, files: DataFrame, index: DataFrame, weights: DataFrame | None = None, configured: DataFrame | None = None) -> DataFrame:
    """(id, target) of imports(id, path, language, module, raw): configured ahead of relative ahead of module files, of the same language family.

    configured(id, target) are answers of a module resolver; an id there with a
    null target is one for which it found no file, and which is not looked up
    further.
    """
    done = configured.select("id", "target") if configured is not None else imports.sparkSession.createDataFrame([], imports.select("id", F.lit("").alias("target")).schema)
    relative = relative_files(imports.join(done.select("id").distinct(), "id", "left_anti"), index)
    rest = imports.join(done.unionByName(relative).select("id").distinct(), "id", "left_anti")
    found = done.unionByName(relative).where("target is not null").unionByName(module_files(rest, index))
    lang = files.select(F.col("path").alias("target"), family(F.col("language")).alias("to"))
    found = found.join(lang, "target").join(imports.select("id", "path", "language", "module"), "id").where(family(F.col("language")) == F.col("to")).where("target <> path")
    many = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    found = found.join(many, "id")
    go = found.where("language = 'go' and n > 1").select("id", "module", "target")
    return found.where("not (language = 'go' and n > 1)").select("id", "target").unionByName(go_narrowed(go, weights)).distinct()


def entry_files(files: DataFrame) -> DataFrame:
    """(repo, path) of files(path, repo): per repository an entry name first, then the shallowest, then the first path."""
    norm = F.replace("path", F.lit("\\"), F.lit("/"))
    score = F.struct(F.when(F.lower(stem(F.col("path"))).isin(*ENTRY_NAMES), 0).otherwise(1).alias("named"), F.size(F.split(norm, "/")).alias("depth"), norm.alias("norm"))
    return files.where("repo is not null").groupBy("repo").agg(F.min_by("path", score).alias("path"))


def call_bindings(bindings: DataFrame) -> DataFrame:
    """(path, local, imported) of bindings(path, seq, pkg, local, imported): the first renaming of each local name; defaults rename nothing."""
    return bindings.where("imported <> 'default' and local <> imported").groupBy("path", "local").agg(F.min_by("imported", "seq").alias("imported"))


def php_imports(imports: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, local, fqcn) of imports(path, raw, kind, aliased) in PHP: null where a local name has several; files of several namespace blocks(path, n) are left out."""
    fqcn = F.lower(F.regexp_replace("raw", r"^\\+", ""))
    rows = imports.where("raw is not null and coalesce(kind, '') not in ('function', 'const') and not coalesce(aliased, false)").select("path", fqcn.alias("fqcn"))
    rows = rows.join(blocks.where("n > 1").select("path"), "path", "left_anti").withColumn("local", F.element_at(F.split("fqcn", r"\\"), -1)).where("local <> ''")
    return rows.groupBy("path", "local").agg(F.when(F.min("fqcn") == F.max("fqcn"), F.min("fqcn")).alias("fqcn"))


def suffix_index(paths: DataFrame, most: int = SUFFIXES) -> DataFrame:
    """(suffix, path): the last 1 to `most` segments of each directory, dotted."""
    parts = _parts(X.dirname(F.col("path")))
    rows = paths.select("path", parts.alias("parts")).where("size(parts) > 0")
    return rows.select(F.explode(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(most)))).alias("k"), "parts", "path").select(F.concat_ws(".", F.expr("slice(parts, -k, k)")).alias("suffix"), "path")


def captured_import(raw: Column, language: Column) -> Column:
    """The name under which an import is known: its last segment without leading dots; C keeps the path, Go all but leading dots, PHP the last part, SAS the file or member."""
    plain = unwrapped(raw)
    last = lambda text: F.coalesce(F.element_at(F.filter(F.split(text, "/"), lambda p: p != "*"), -1), text)
    slashed = F.replace(plain, F.lit("\\"), F.lit("/"))
    php = F.coalesce(F.element_at(F.filter(F.split(slashed, "/"), lambda p: p != ""), -1), slashed)
    member = F.regexp_extract(slashed, r"^[A-Za-z_][A-Za-z0-9_]*\(([^)]+)\)$", 1)
    sas = F.when(F.contains(slashed, F.lit("&")), "").when(~F.contains(slashed, F.lit("/")), F.when(member != "", member).otherwise(slashed)).otherwise(F.regexp_replace(last(slashed), r"^\.+", ""))
    return F.when(language.isin("c", "cpp"), F.regexp_replace(plain, r"^\./+", "")).when(language == "go", F.regexp_replace(plain, r"^\.+", "")).when(language == "php", php).when(language == "sas", sas).otherwise(F.regexp_replace(last(plain), r"^\.+", ""))


def unwrapped(raw: Column) -> Column:
    """A specifier without its quotes or brackets; doubled backslashes are slashes."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.trim(raw), F.lit("\\\\"), F.lit("/")), r"""^["'`<]""", ""), r"""[>"'`]$""", "")
