"""File sources: discovery, filters, language and role by path, change detection, manifests."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as X

#: Languages by extension.
EXTENSIONS = {
    "typescript": (".ts", ".tsx"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "python": (".py",),
    "java": (".java",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp"),
    "csharp": (".cs",),
    "go": (".go",),
    "ruby": (".rb",),
    "rust": (".rs",),
    "php": (".php",),
    "kotlin": (".kt", ".kts"),
    "swift": (".swift",),
    "scala": (".scala", ".sc"),
    "yaml": (".yaml", ".yml"),
    "dockerfile": (".dockerfile",),
    "sql": (".sql",),
    "json": (".json",),
    "toml": (".toml",),
    "markdown": (".md", ".markdown"),
    "r": (".r",),
    "sas": (".sas",),
    "elixir": (".ex", ".exs"),
    "lua": (".lua",),
    "makefile": (".mk", ".makefile"),
    "bash": (".sh", ".bash", ".zsh", ".ksh"),
    "haskell": (".hs", ".lhs"),
    "zig": (".zig",),
    "html": (".html", ".htm", ".xhtml"),
    "xml": (".xml", ".xsd", ".xsl", ".xslt", ".wsdl", ".csproj", ".vbproj", ".fsproj", ".props", ".targets", ".plist"),
    "hcl": (".tf", ".tfvars", ".hcl"),
    "css": (".css", ".scss", ".sass", ".less"),
    "latex": (".tex", ".sty", ".cls", ".ltx", ".latex"),
}
#: Shell files known by their whole name.
SHELL_NAMES = (".bashrc", ".bash_profile", ".bash_aliases", ".bash_logout", ".zshrc", ".zprofile", ".zshenv", ".profile")
#: Other names of languages in a filter.
LANGUAGE_ALIASES = {"c++": "cpp", "cplusplus": "cpp", "c#": "csharp", "cs": "csharp", "js": "javascript", "ts": "typescript", "py": "python", "rb": "ruby", "rs": "rust", "kt": "kotlin"}
#: Directories that a walk does not enter, besides those that start with a dot.
IGNORED = (
    "node_modules", "dist", "build", "target", "out", "__pycache__", "venv", "coverage", "vendor", "Pods", "bin", "obj", "pkg",
    "test", "tests", "__tests__", "spec", "specs", "e2e", "examples", "fixtures", "__mocks__", "__fixtures__",
)
#: Ends and beginnings of the names of generated files.
GENERATED_ENDS = (".pb.go", "_deepcopy.go", "_mock.go", ".pb.ts", ".pb.js", "_pb.ts", "_pb.js")
GENERATED_BEGINNINGS = ("zz_generated", "mock_")
MAX_BYTES, MINIFIED_BYTES = 1 << 20, 200 * 1024


def language(path: Column) -> Column:
    name, ext = F.lower(X.basename(path)), X.extname(path)
    out = F.when((name == "dockerfile") | F.endswith(name, F.lit(".dockerfile")), "dockerfile").when(name.isin("makefile", "gnumakefile"), "makefile").when(name.isin(*SHELL_NAMES), "bash")
    for lang, exts in EXTENSIONS.items():
        out = out.when(ext.isin(*exts), lang)
    return out


def generated(path: Column) -> Column:
    name, out = X.basename(path), F.lit(False)
    for end in GENERATED_ENDS:
        out = out | F.endswith(name, F.lit(end))
    for beginning in GENERATED_BEGINNINGS:
        out = out | F.startswith(name, F.lit(beginning))
    return out


def minified(text: Column) -> Column:
    """At least 200 KiB, and a line of 20 000 characters, or up to 50 lines with 2 000 on average."""
    sizes = F.transform(F.split(text, "\n", -1), F.length)
    return (F.length(text) >= MINIFIED_BYTES) & ((F.array_max(sizes) >= 20_000) | ((F.size(sizes) <= 50) & (F.length(text) / F.size(sizes) >= 2_000)))


def languages(asked: str) -> list[str]:
    """A comma-separated language filter: trimmed, lower-cased, with aliases resolved."""
    names = (x.strip().lower() for x in asked.split(","))
    return list(dict.fromkeys(LANGUAGE_ALIASES.get(x, x) for x in names if x))


def of_languages(files: DataFrame, asked: str | None) -> DataFrame:
    return files if asked is None else files.where(F.col("language").isin(*languages(asked)))


def walk(files: DataFrame, root: str) -> DataFrame:
    """files(path, ..) below root that a walk reaches: no directory that starts with a dot or is IGNORED, only supported and no generated files."""
    below = F.regexp_replace("path", "^(file:)?/*" + re.escape(root.removeprefix("file:").strip("/")), "")
    parts = F.split(below, "/")
    hidden = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: (F.startswith(p, F.lit(".")) & (p != ".") & (p != "..")) | p.isin(*IGNORED))
    return supported(files).where(~hidden)


def supported(files: DataFrame) -> DataFrame:
    """files with their language: those that have one and are not generated."""
    return files.withColumn("language", language(F.col("path"))).where(F.col("language").isNotNull() & ~generated(F.col("path")))


def listed(tracked: DataFrame, untracked: DataFrame) -> DataFrame:
    """(path, seq) of a version control listing: tracked(path, seq) and then untracked(path, seq) files, each canonical path once.

    Directories are not filtered here: what is tracked was put there on purpose.
    """
    rows = tracked.select("path", F.col("seq").cast("long").alias("seq"), F.lit(0).alias("rank")).unionByName(untracked.select("path", F.col("seq").cast("long").alias("seq"), F.lit(1).alias("rank")))
    first = rows.groupBy(X.join_path(F.lit(""), F.col("path")).alias("canonical")).agg(F.min(F.struct("rank", "seq", "path")).alias("r"))
    return supported(first.select("r.path", "r.rank", "r.seq")).select("path", "rank", "seq", "language")


def within(path: Column, root: str) -> Column:
    """Whether a canonical path lies below a canonical root: not the root itself, and no neighbour whose name begins like it."""
    top = root.rstrip("/") + "/"
    return F.startswith(path, F.lit(top)) & (F.length(path) > len(top))


def confined(paths: DataFrame, root: str | None) -> tuple[DataFrame, DataFrame]:
    """(paths below root, one row outside_root): paths(path, seq) canonical and once each; without a root all stay."""
    once = first_canonical(paths)
    if root is None:
        return once, once.agg(F.lit(0).cast("long").alias("outside_root"))
    inside = within(F.col("path"), posixpath.normpath(root))
    return once.where(inside), once.agg(F.count_if(~inside).alias("outside_root"))


def sized(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """files(length, ..) with `skipped`: too-large beyond the limit, else null."""
    return files.withColumn("skipped", F.when(F.col("length") > most, "too-large"))


def discover(spark: SparkSession, root: str, asked: str | None = None) -> DataFrame:
    """(path, length, modified, content, language) of the supported files under a root, up to the size limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = of_languages(walk(files.where(F.col("length") <= MAX_BYTES), root), asked)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("content"), "language")


def first_canonical(paths: DataFrame) -> DataFrame:
    """paths(path, seq): the first of each canonical path, as its canonical form; case counts."""
    absolute = F.when(F.startswith("path", F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    canonical = F.concat(absolute, X.join_path(F.lit(""), F.col("path")))
    return paths.groupBy(canonical.alias("canonical")).agg(F.min("seq").alias("seq")).select(F.col("canonical").alias("path"), "seq")


def unmodified(files: DataFrame, baseline: DataFrame) -> DataFrame:
    """files(path, modified, ..) less those whose time equals that of the baseline(path, modified): they are not even read."""
    return files.join(baseline.select("path", "modified"), ["path", "modified"], "left_anti")


def with_hashes(files: DataFrame, known: DataFrame) -> DataFrame:
    """files(workspace, path, ..) with known_hash of known(workspace, uri, hash); both keys count, as workspaces share paths."""
    return files.join(known.select("workspace", F.col("uri").alias("path"), F.col("hash").alias("known_hash")), ["workspace", "path"], "left")


def changed(files: DataFrame, baseline: DataFrame) -> DataFrame:
    """(path, status): new, changed or deleted, by content hash against baseline(path, hash)."""
    now = files.select("path", F.sha2("content", 256).alias("now"))
    both = now.join(baseline.select("path", F.col("hash").alias("before")), "path", "full")
    status = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("before"), "changed")
    return both.select("path", status.alias("status")).where("status is not null")


def recovery(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """deleted(path, dependents): paths to ingest again as a deleted file they depend on is back."""
    return deleted.join(files.select("path"), "path", "left_semi").select(F.explode("dependents").alias("path")).distinct()


#: Roles of files, strongest first among equals, with their signals in groups.
#: A group counts its weight once, for the first of its patterns that is found in the path, the name or the source.
ROLE_SIGNALS = [
    ("test", "path", 0.8, [
        (r"(?i)[/\\]__tests__[/\\]", "path:__tests__"),
        (r"(?i)[/\\]tests?[/\\]", "path:tests/"),
        (r"(?i)[/\\]spec[/\\]", "path:spec/"),
        (r"(?i)[/\\]src[/\\]test[/\\]", "path:src/test/"),
        (r"(?i)[/\\]test[/\\]unit[/\\]", "path:test/unit/"),
        (r"(?i)[/\\]test[/\\]integration[/\\]", "path:test/integration/"),
        (r"(?i)[/\\][^/\\]*\.tests?[/\\]", "path:.Tests/"),
    ]),
    ("test", "name", 0.9, [
        (r"(?i)\.test\.[^.]+$", "filename:.test."),
        (r"(?i)\.spec\.[^.]+$", "filename:.spec."),
        (r"Tests?\.[^.]+$", "filename:Test(s)."),
        (r"Spec\.[^.]+$", "filename:Spec."),
        (r"(?i)_test\.[^.]+$", "filename:_test."),
        (r"(?i)_spec\.[^.]+$", "filename:_spec."),
    ]),
    ("test", "source", 0.5, [
        (r"""from ['"](jest|vitest|mocha|chai|sinon|jasmine|@testing-library)""", "import:js_test_framework"),
        (r"""require\(['"](jest|vitest|mocha|chai|sinon|jasmine)['"]\)""", "import:js_test_framework_require"),
        (r"import\s+(unittest|pytest)", "import:python_test_framework"),
        (r"from\s+(unittest|pytest)", "import:python_test_framework_from"),
        (r"import\s+org\.junit", "import:junit"),
        (r"import\s+org\.testng", "import:testng"),
        (r"import\s+io\.mockk", "import:mockk"),
        (r"import\s+org\.mockito", "import:mockito"),
        (r"import\s+org\.scalatest", "import:scalatest"),
        (r"import\s+munit", "import:munit"),
        (r"import\s+zio\.test", "import:zio_test"),
        (r'"testing"', "import:go_testing"),
        (r"""require\s+['"]rspec['"]""", "import:rspec"),
        (r"""require\s+['"]minitest['"]""", "import:minitest"),
        (r"using\s+NUnit\.Framework", "import:nunit"),
        (r"using\s+Xunit", "import:xunit"),
        (r"using\s+Microsoft\.VisualStudio\.TestTools\.UnitTesting", "import:mstest"),
    ]),
    ("fixture", "path", 0.8, [
        (r"(?i)[/\\]fixtures?[/\\]", "path:fixtures/"),
        (r"(?i)[/\\]__fixtures__[/\\]", "path:__fixtures__/"),
        (r"(?i)[/\\]test[/\\]resources[/\\]", "path:test/resources/"),
        (r"(?i)[/\\]testdata[/\\]", "path:testdata/"),
    ]),
    ("fixture", "name", 0.6, [
        (r"(?i)fixture", "filename:fixture"),
        (r"(?i)\.mock\.[^.]+$", "filename:.mock."),
        (r"(?i)stub", "filename:stub"),
        (r"(?i)fake", "filename:fake"),
        (r"(?i)sample", "filename:sample"),
        (r"(?i)seed", "filename:seed"),
    ]),
    ("generated", "path", 0.7, [
        (r"(?i)[/\\]generated[/\\]", "path:generated/"),
        (r"(?i)[/\\]gen[/\\]", "path:gen/"),
        (r"(?i)[/\\]\.gen[/\\]", "path:.gen/"),
        (r"\.pb\.[^.]+$", "filename:.pb. (protobuf)"),
        (r"\.gen\.[^.]+$", "filename:.gen."),
        (r"_generated\.[^.]+$", "filename:_generated."),
    ]),
    ("generated", "source", 0.9, [
        (r"(?m)^// Code generated", "source_marker:code_generated"),
        (r"(?m)^// DO NOT EDIT", "source_marker:do_not_edit"),
        (r"(?m)^# Code generated", "source_marker:code_generated_hash"),
        (r"(?m)^# DO NOT EDIT", "source_marker:do_not_edit_hash"),
        (r"(?m)^/\* Generated by", "source_marker:generated_by"),
        (r"(?im)^/\* AUTO-GENERATED", "source_marker:auto_generated"),
        (r"(?im)^// AUTO-GENERATED", "source_marker:auto_generated_line"),
    ]),
    ("external", "path", 0.9, [
        (r"(?i)[/\\]vendor[/\\]", "path:vendor/"),
        (r"(?i)[/\\]third[-_]?party[/\\]", "path:third_party/"),
        (r"(?i)[/\\]extern[/\\]", "path:extern/"),
    ]),
    ("tooling", "path", 0.6, [
        (r"(?i)[/\\]scripts?[/\\]", "path:scripts/"),
        (r"(?i)[/\\]tools?[/\\]", "path:tools/"),
        (r"(?i)[/\\]ci[/\\]", "path:ci/"),
        (r"(?i)[/\\]\.github[/\\]", "path:.github/"),
        (r"(?i)[/\\]dev[/\\]", "path:dev/"),
    ]),
    ("tooling", "name", 0.7, [
        (r"^Makefile$", "filename:Makefile"),
        (r"^Dockerfile[^/\\]*$", "filename:Dockerfile"),
        (r"(?i)^docker-compose[^/\\]*\.yml$", "filename:docker-compose"),
        (r"(?i)\.config\.[^.]+$", "filename:.config."),
        (r"(?i)^vite\.config\.", "filename:vite.config"),
        (r"(?i)^webpack\.config\.", "filename:webpack.config"),
        (r"(?i)^jest\.config\.", "filename:jest.config"),
        (r"(?i)^babel\.config\.", "filename:babel.config"),
        (r"(?i)^tsconfig[^/\\]*\.json$", "filename:tsconfig.json"),
        (r"(?i)^\.eslintrc", "filename:.eslintrc"),
        (r"(?i)^rollup\.config\.", "filename:rollup.config"),
        (r"(?i)^build\.[^.]+$", "filename:build."),
        (r"(?i)migrate\.[^.]+$", "filename:migrate."),
    ]),
]
ROLES = ("test", "fixture", "generated", "external", "tooling")


def file_role(path: Column, source: Column | None = None) -> Column:
    """struct(role, confidence, signals): groups of a role add up; the strongest role wins from 0.5 on, the first of equal ones.

    signals names the pattern that counted of every group, the losing roles' as well; a production file has none.
    """
    where = {"path": F.replace(path, F.lit("\\"), F.lit("/")), "name": X.basename(path), "source": source}
    scores, fired = {r: F.lit(0.0) for r in ROLES}, []
    for role, at, weight, patterns in ROLE_SIGNALS:
        if where[at] is None:
            continue
        text = F.coalesce(where[at], F.lit(""))
        signal = F.when(F.rlike(text, F.lit(patterns[0][0])), patterns[0][1])
        for pattern, name in patterns[1:]:
            signal = signal.when(F.rlike(text, F.lit(pattern)), name)
        scores[role] = scores[role] + F.when(signal.isNotNull(), weight).otherwise(0.0)
        fired.append(signal)
    best = F.greatest(*scores.values())
    role = F.when(best < 0.5, "production")
    for r in ROLES:
        role = role.when(scores[r] == best, r)
    signals = F.when(best < 0.5, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*fired)))
    return F.struct(role.alias("role"), F.when(best < 0.5, 0.5).otherwise(F.round(F.least(best, F.lit(1.0)), 2)).alias("confidence"), signals.alias("signals"))


#: Manifests that make a directory a repository of its own, and ends of the names of further ones.
REPO_MANIFESTS = ("package.json", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "pyproject.toml", "setup.py", "setup.cfg", "Gemfile", "composer.json", "mix.exs", "CMakeLists.txt", "build.sbt")
REPO_ENDS = (".csproj", ".sln", ".gemspec")


def systems(files: DataFrame, workspaces: tuple[str, ...] = ("pnpm-workspace.yaml", "lerna.json", "nx.json", "turbo.json", "go.work")) -> DataFrame:
    """(root, member, system_id) of files(root, path): roots that hold two repositories or more side by side.

    A member is a directory right below the root, without a leading dot, that has
    a manifest or version control of its own; a root that is a repository or a
    workspace itself is no system.
    """
    from codeloom import ids

    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    manifest = name.isin(*REPO_MANIFESTS) | F.endswith(name, F.lit(REPO_ENDS[0])) | F.endswith(name, F.lit(REPO_ENDS[1])) | F.endswith(name, F.lit(REPO_ENDS[2]))
    rows = files.select("root", parts.alias("parts"), (manifest & (F.size(parts) == 2)).alias("own"), ((F.get(parts, F.lit(0)) == ".git") | ((F.size(parts) == 1) & name.isin(*workspaces))).alias("whole"), (F.get(parts, F.lit(1)) == ".git").alias("git"))
    single = rows.where("whole").select("root").distinct()
    members = rows.where((F.col("own") | F.col("git")) & ~F.startswith(F.get("parts", F.lit(0)), F.lit("."))).select("root", F.get("parts", F.lit(0)).alias("member")).distinct().join(single, "root", "left_anti")
    many = members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("root")
    return members.join(many, "root").select("root", "member", ids.stable_id(F.concat(F.lit("system:"), F.col("root"))).alias("system_id"))


def _found(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all("content", F.lit(pattern), F.lit(group))


def package_names(manifests: DataFrame) -> DataFrame:
    """(repo, name) of manifests(repo, path, content): what a repository publishes, by the kind of its manifest."""
    file = X.basename(F.col("path"))
    cargo = F.regexp_extract("content", r"(?s)\[package\](.*?)(?:\n\[|\z)", 1)
    project = F.regexp_extract("content", r"(?s)\[(?:project|tool\.poetry)\](.*?)(?:\n\[|\z)", 1)
    pom = "content"
    for tag in ("parent", "dependencyManagement", "dependencies", "build"):
        pom = F.regexp_replace(pom, rf"(?s)<{tag}>.*?</{tag}>", "")
    one = lambda text, pattern: F.regexp_extract(text, pattern, 1)
    whole = F.col("content")
    name = (
        F.when(file == "package.json", F.get_json_object("content", "$.name"))
        .when(file == "Cargo.toml", one(F.when(cargo != "", cargo).otherwise(whole), r'\bname\s*=\s*"([^"]+)"'))
        .when(file == "go.mod", one(whole, r"(?m)^\s*module\s+(\S+)"))
        .when(file == "pyproject.toml", one(F.when(project != "", project).otherwise(whole), r"""(?m)^\s*name\s*=\s*["']([^"']+)["']"""))
        .when(file == "setup.py", one(whole, r"""name\s*=\s*["']([^"']+)["']"""))
        .when(file == "setup.cfg", one(whole, r"(?m)^\s*name\s*=\s*(\S+)"))
        .when(file == "mix.exs", one(whole, r"app:\s*:(\w+)"))
        .when(file == "pom.xml", one(pom, r"<artifactId>([^<]+)</artifactId>"))
        .when(F.endswith(file, F.lit(".gemspec")), one(whole, r"""\.name\s*=\s*["']([^"']+)["']"""))
    )
    return manifests.select("repo", F.trim(name).alias("name")).where("name <> ''").distinct()


def package_deps(manifests: DataFrame) -> DataFrame:
    """(repo, name) of manifests(repo, path, content): what a repository depends on at run time; what only tests or builds need does not count."""
    file = X.basename(F.col("path"))
    npm = lambda key: F.coalesce(F.json_object_keys(F.get_json_object("content", f"$.{key}")), F.array().cast("array<string>"))
    sections = F.filter(F.regexp_extract_all("content", F.lit(r"(?s)\[[^\]\n]*\bdependencies\b[^\]\n]*\].*?(?=\n\[|\z)"), F.lit(0)), lambda s: ~F.rlike(F.substring_index(s, "]", 1), F.lit(r"\b(dev|build)-dependencies\b")))
    cargo = F.flatten(F.transform(sections, lambda s: F.regexp_extract_all(s, F.lit(r"(?m)^\s*([A-Za-z0-9_-]+)\s*(?:=|\.)"), F.lit(1))))
    required = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(r"(?s)require\s*\((.*?)\)"), F.lit(1)), lambda b: F.regexp_extract_all(b, F.lit(r"(?m)^\s*(\S+)\s+v"), F.lit(1))))
    listed_ = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(r"(?s)dependencies\s*=\s*\[(.*?)\]"), F.lit(1)), lambda b: F.regexp_extract_all(b, F.lit(r"""["']([A-Za-z0-9_.-]+)"""), F.lit(1))))
    names = (
        F.when(file == "package.json", F.concat(npm("dependencies"), npm("peerDependencies"), npm("optionalDependencies")))
        .when(file == "Cargo.toml", cargo)
        .when(file == "go.mod", F.concat(_found(r"(?m)^\s*require\s+(\S+)\s+v"), required))
        .when(file == "pom.xml", _found(r"(?s)<dependency>.*?<artifactId>([^<]+)</artifactId>.*?</dependency>"))
        .when(file.isin("build.gradle", "build.gradle.kts"), F.concat(F.transform(_found(r"""project\(['"]:?([^'"]+)['"]\)"""), lambda p: F.substring_index(p, ":", -1)), _found(r"""['"][\w.-]+:([\w.-]+):[^'"]+['"]""")))
        .when(file == "pyproject.toml", F.concat(_found(r"""(?m)^\s*["']?([A-Za-z0-9_.-]+)["']?\s*(?:[><=~!^]=|[><~!^]|=\s*["'])"""), listed_))
    )
    return manifests.select("repo", F.explode(names).alias("name")).where("trim(name) <> ''").distinct()


def package_registry(packages: DataFrame) -> DataFrame:
    """packages(repo, name) -> (key, repo): full names, and lower-case stems and underscore forms that only one repository has."""
    stem = F.lower(F.coalesce(F.element_at(F.filter(F.split("name", "[/.:]"), lambda p: p != ""), -1), F.col("name")))
    under = lambda c: F.replace(c, F.lit("-"), F.lit("_"))
    full = packages.select("repo", F.col("name").alias("key"), F.lit(0).alias("rank"))
    stems = packages.select("repo", stem.alias("key"), F.lit(1).alias("rank"))
    forms = packages.select("repo", F.col("name"), stem.alias("stem"), F.explode(F.array_distinct(F.array(under(F.col("name")), under(stem)))).alias("key")).where("key <> name and key <> stem").select("repo", "key", F.lit(2).alias("rank"))
    keys = full.unionByName(stems).unionByName(forms)
    only = keys.groupBy("key", "rank").agg(F.min("repo").alias("repo"), F.max("repo").alias("other")).where("repo = other or rank = 0")
    return only.groupBy("key").agg(F.min_by("repo", "rank").alias("repo"))


#: A specifier with such an end is a file, not a package.
SOURCE_END = r"(?i)\.(ts|tsx|js|jsx|mjs|cjs|py|pyi|rs|go|rb|java|ex|exs|c|h|cc|cpp|hpp|cs|scala|kt|swift)$"


def package_of(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, repo) of asked(id, spec): the whole specifier, then in lower case, then its longest prefix at /, . or :: that the registry(key, repo) has.

    Relative specifiers and file names are no packages; a single colon is a protocol.
    """
    rows = asked.where(~F.rlike("spec", F.lit(r"^[./]")) & (F.col("spec") != "") & ~F.rlike("spec", F.lit(SOURCE_END)))
    cuts = F.filter(F.sequence(F.lit(1), F.length("spec") - 1), lambda k: F.substring(F.col("spec"), k + 1, F.lit(1)).isin("/", ".") | (F.substring(F.col("spec"), k + 1, F.lit(2)) == "::"))
    prefixes = F.transform(F.when(F.length("spec") > 1, cuts).otherwise(F.array().cast("array<int>")), lambda k: F.struct((F.lit(1_000_000) - k).alias("rank"), F.substring(F.col("spec"), F.lit(1), k).alias("key")))
    keys = F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.col("spec").alias("key")), F.struct(F.lit(1).alias("rank"), F.lower("spec").alias("key"))), prefixes)
    tried = rows.select("id", F.explode(keys).alias("k")).select("id", "k.rank", "k.key")
    return tried.join(registry, "key").groupBy("id").agg(F.min_by("repo", "rank").alias("repo"))


def path_mappings(configs: DataFrame) -> DataFrame:
    """(dir, seq, pattern, k, target, base) of configs(path, content) of TypeScript or JavaScript projects: path rules in order, and the base as a last rule.

    Comments and trailing commas are allowed in these files.
    """
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", r"(?s)/\*.*?\*/", ""), r"(?m)(?<![:\x22'])//[^\n]*$", ""), r",(\s*[}\]])", "$1")
    options = configs.select(X.dirname(F.col("path")).alias("dir"), plain.alias("j"))
    options = options.select("dir", F.get_json_object("j", "$.compilerOptions.baseUrl").alias("url"), F.from_json(F.get_json_object("j", "$.compilerOptions.paths"), "map<string,array<string>>").alias("paths"))
    base = X.join_path(F.col("dir"), F.coalesce("url", F.lit(".")))
    rules = options.select("dir", base.alias("base"), F.posexplode(F.map_entries("paths")).alias("seq", "rule")).select("dir", "base", "seq", F.col("rule.key").alias("pattern"), F.posexplode("rule.value").alias("k", "target"))
    bases = options.where("url is not null").select("dir", base.alias("base"), F.lit(1_000_000).alias("seq"), F.lit("*").alias("pattern"), F.lit(0).alias("k"), F.lit("*").alias("target"))
    return rules.unionByName(bases).select("dir", "seq", "pattern", "k", "target", "base")


def configured_targets(imports: DataFrame, mappings: DataFrame, index: DataFrame) -> DataFrame:
    """(id, target) of imports(id, path, language, raw) by path rules: the nearest project's first rule that matches, then its base.

    A rule of its own, other than *, that leads to no file is an answer as well:
    target is null, and nothing else is tried for the specifier.
    """
    from codeloom.operators import indexes as I

    asked = imports.where(F.col("language").isin("javascript", "typescript") & ~F.rlike("raw", F.lit(r"^\.\.?/")))
    parts = F.split(X.dirname(F.col("path")), "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")))
    dirs = asked.select("id", "path", "language", "raw", F.explode(up).alias("d")).select("id", "path", "language", "raw", "d.depth", "d.dir")
    near = dirs.join(mappings.select("dir").distinct(), "dir")
    near = near.join(near.groupBy("id").agg(F.max("depth").alias("depth")), ["id", "depth"]).join(mappings, "dir")
    head, tail = F.substring_index("pattern", "*", 1), F.when(F.contains("pattern", F.lit("*")), F.substring_index("pattern", "*", -1)).otherwise(F.lit(None))
    star = F.when(tail.isNull(), F.when(F.col("raw") == F.col("pattern"), "")).when(F.startswith("raw", head) & F.endswith("raw", tail) & (F.length("raw") >= F.length(head) + F.length(tail)), F.substring(F.col("raw"), F.length(head) + 1, F.length("raw") - F.length(head) - F.length(tail)))
    hit = near.withColumn("star", star).where("star is not null")
    first = hit.where("seq < 1000000").groupBy("id").agg(F.min("seq").alias("first"))
    hit = hit.join(first, "id", "left").where("seq = first or seq = 1000000")
    tried = hit.select("id", "path", "seq", "k", F.posexplode(I.relative_candidates(F.col("language"), X.join_path(F.col("base"), F.replace(F.col("target"), F.lit("*"), F.col("star"))))).alias("c", "candidate"))
    from codeloom import ids

    found = tried.withColumn("key", ids.norm_path(F.col("candidate"))).join(I.lookup(index, "path"), "key").where("target <> path").groupBy("id").agg(F.min_by("target", F.struct("seq", "k", "c")).alias("target"))
    explicit = hit.where("seq < 1000000 and pattern <> '*'").select("id").distinct()
    return found.unionByName(explicit.join(found, "id", "left_anti").select("id", F.lit(None).cast("string").alias("target")))


#: How much of a text goes into the graph.
BODY, RATIONALE = 2000, 500


def _cut(text: str, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(F.coalesce(F.col(text), F.lit("")))


def read_tracker(spark: SparkSession, path: str, schema: str, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Records that a tracker's export left as JSON files: those from `since` on, the newest `limit`."""
    rows = spark.read.schema(schema).json(path)
    if since is not None:
        rows = rows.where(F.col("created_at") >= since)
    return rows.orderBy(F.desc("created_at"), "id").limit(limit) if limit is not None else rows


def _uri(kind: str, number: Column) -> Column:
    return F.concat(F.lit("github://"), F.col("repo"), F.lit(f"/{kind}/"), number.cast("string"))


def _node(kind: str, uri: Column, name: Column, **attrs: Column) -> list[Column]:
    from codeloom import ids

    return [F.lit("UpsertNode").alias("op"), ids.uuid_form(uri).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("string").alias("predicate"), F.to_json(F.struct(*[v.alias(k) for k, v in attrs.items()], uri.alias("source_uri"))).alias("attrs")]


def _edge(key: Column, src: Column, dst: Column, predicate: str, attrs: Column | None = None) -> list[Column]:
    from codeloom import ids

    none = F.lit(None).cast("string")
    return [F.lit("UpsertEdge").alias("op"), ids.uuid_form(key).alias("id"), none.alias("kind"), none.alias("name"), ids.uuid_form(src).alias("src"), ids.uuid_form(dst).alias("dst"), F.lit(predicate).alias("predicate"), (F.lit("{}") if attrs is None else attrs).alias("attrs")]


def issue_ops(issues: DataFrame) -> DataFrame:
    """Intent nodes of issues(repo, number, title, author, state, labels, created_at, body)."""
    author = F.coalesce("author", F.lit("unknown"))
    return issues.select(*_node("intent", _uri("issues", F.col("number")), F.col("title"), number=F.col("number"), author=author, labels=F.col("labels"), state=F.col("state"), created_at=F.col("created_at"), body=_cut("body", BODY)))


def pull_ops(pulls: DataFrame) -> DataFrame:
    """Decision nodes of pulls(repo, number, title, author, state, merged_at, base, head, changed_files, created_at, body)."""
    author = F.coalesce("author", F.lit("unknown"))
    return pulls.select(*_node("decision", _uri("pull", F.col("number")), F.col("title"), number=F.col("number"), author=author, state=F.col("state"), merged=F.col("merged_at").isNotNull(), base_branch=F.col("base"), head_branch=F.col("head"), changed_files_count=F.col("changed_files"), created_at=F.col("created_at"), body=_cut("body", BODY), rationale=_cut("body", RATIONALE)))


def comment_ops(comments: DataFrame, of: str = "issues") -> DataFrame:
    """Doc nodes of comments(repo, number, id, author, created_at, body) on issues, or reviews on pull requests (of='pull'), each below its parent."""
    author = F.coalesce("author", F.lit("unknown"))
    parent = _uri(of, F.col("number"))
    uri = F.concat(parent, F.lit("/comments/"), F.col("id").cast("string"))
    said = F.concat(F.lit("Issue #" if of == "issues" else "PR #"), F.col("number").cast("string"), F.lit(" comment by " if of == "issues" else " review by "), author)
    nodes = comments.select(*_node("doc", uri, said, author=author, created_at=F.col("created_at"), body=_cut("body", BODY)))
    return nodes.unionByName(comments.select(*_edge(F.concat(parent, F.lit(":CONTAINS:"), uri), parent, uri, "CONTAINS")))


def commit_ops(commits: DataFrame) -> DataFrame:
    """Doc nodes of commits(repo, sha, author, created_at, message, files array<struct<filename,status>>), named by their first line, with a REFERENCES edge for each file."""
    uri = _uri("commit", F.col("sha"))
    nodes = commits.select(*_node("doc", uri, F.substring_index("message", "\n", 1), sha=F.col("sha"), author=F.coalesce("author", F.lit("unknown")), created_at=F.col("created_at"), message=_cut("message", BODY), changed_files=F.coalesce(F.col("files.filename"), F.array().cast("array<string>"))))
    each = commits.withColumn("file", F.explode("files"))
    edges = each.select(*_edge(F.concat(uri, F.lit(":REFERENCES:"), F.col("file.filename")), uri, F.concat("repo", F.lit("::"), F.col("file.filename")), "REFERENCES", F.to_json(F.struct(F.col("file.status").alias("change_type")))))
    return nodes.unionByName(edges)
