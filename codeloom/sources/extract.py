"""Extraction: source files to entities and relationships, in parallel by file.

extract(files) runs a registered extractor per language in Python, one file at
a time, and never fails a task: a file that cannot be read comes out with its
error.  Line formats that need no parser state have expression-only forms.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.sources import scopes

#: An entity: (name, kind, container, first line, last line); a relationship: (source, target, predicate).
Parsed = tuple[list[tuple], list[tuple]]
EXTRACTORS: dict[str, Callable[[str], Parsed]] = {}


def extractor(*languages: str) -> Callable:
    def put(f: Callable[[str], Parsed]) -> Callable[[str], Parsed]:
        EXTRACTORS.update(dict.fromkeys(languages, f))
        return f

    return put


@extractor("python")
def python(source: str) -> Parsed:
    entities, relations = [], []

    def named(node: ast.expr | None) -> str | None:
        """The type that an annotation or a base names: `C` of C, b.C, C[int] and "C"."""
        if isinstance(node, ast.Constant) and isinstance(node.value, str) and node.value.isidentifier():
            return node.value
        node = node.value if isinstance(node, ast.Subscript) else node
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None

    def walk(body: list, container: str | None, caller: str | None, types: dict[str, str]) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if container else "function"
                entities.append((node.name, kind, container, node.lineno, node.end_lineno))
                if kind == "class":
                    relations.extend((node.name, base, "EXTENDS") for b in node.bases if (base := named(b)))
                    walk(node.body, node.name, node.name, {})
                    continue
                args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
                own = {a.arg: t for a in args if (t := named(a.annotation))}
                relations.extend((node.name, t, "REFERENCES") for t in [*own.values(), named(node.returns)] if t and t not in _BUILTINS["python"] and t not in ("None", "object", "bool", "bytes"))
                walk(node.body, container, node.name, types | own)
            else:
                for x in ast.walk(node):
                    if isinstance(x, ast.ImportFrom):
                        relations.append((None, (x.module or "").split(".")[-1] or x.names[0].name, "IMPORTS"))
                    elif isinstance(x, ast.Import):
                        relations.extend((None, n.name.split(".")[-1], "IMPORTS") for n in x.names)
                    elif isinstance(x, ast.Call) and isinstance(x.func, ast.Name):
                        relations.append((caller, x.func.id, "CALLS"))
                    elif isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute):
                        relations.append((caller, x.func.attr, "CALLS"))
                        if isinstance(x.func.value, ast.Name):
                            root = container if x.func.value.id in ("self", "cls") and container else types.get(x.func.value.id, x.func.value.id)
                            relations.append((caller, f"{root}.{x.func.attr}", "CALLS"))

    walk(ast.parse(source).body, None, None, {})
    return entities, list(dict.fromkeys(relations))


#: Definition patterns by language family: (kind, pattern with the name as group 1).
_DEFINITIONS = {
    "typescript": [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("function", r"\bfunction\s+(\w+)"), ("function", r"\bconst\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"), ("method", r"^[ \t]+(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*(?!(?:if|for|while|switch|catch|function|return|else|do|try|with)\b)(\w+)\s*\([^()]*\)\s*(?::\s*[\w<>\[\]|&., ]+)?\s*\{")],
    "java": [("class", r"\b(?:class|enum|record)\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("method", r"\b(?:public|private|protected)\s[\w<>\[\], ]*?\b(\w+)\s*\("), ("method", r"(?<!\bnew )(?<![\w.])(?!(?:if|for|while|switch|catch|synchronized|try|do|else|return|new)\b)(\w+)\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+?)?\s*\{")],
    "go": [("function", r"^func\s+(\w+)"), ("method", r"^func\s+\([^)]*\)\s+(\w+)"), ("class", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface")],
    "rust": [("function", r"\bfn\s+(\w+)"), ("class", r"\b(?:struct|enum)\s+(\w+)"), ("trait", r"\btrait\s+(\w+)"), ("module", r"\bmod\s+(\w+)"), ("macro", r"\bmacro_rules!\s*(\w+)")],
    "c": [("class", r"\b(?:struct|union|enum)\s+(\w+)\s*\{"), ("macro", r"^#\s*define\s+(\w+)"), ("function", r"^[\w*\s]+?\b(\w+)\s*\([^;]*\)\s*\{")],
    "ruby": [("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)"), ("method", r"^\s*def\s+(?:self\.)?(\w+[?!]?)")],
    "php": [("class", r"\b(?:class|enum)\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("trait", r"\btrait\s+(\w+)"), ("function", r"\bfunction\s+(\w+)")],
    "kotlin": [("class", r"\b(?:class|object)\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("function", r"\bfun\s+(\w+)")],
    "swift": [("class", r"\b(?:class|struct|enum)\s+(\w+)"), ("interface", r"\bprotocol\s+(\w+)"), ("function", r"\bfunc\s+(\w+)")],
    "scala": [("class", r"\b(?:class|object)\s+(\w+)"), ("interface", r"\btrait\s+(\w+)"), ("function", r"\bdef\s+(\w+)")],
    "bash": [("function", r"^\s*(?:function\s+)?(\w+)\s*\(\)")],
    "lua": [("function", r"\bfunction\s+([\w.:]+)")],
    "elixir": [("class", r"\bdefmodule\s+([\w.]+)"), ("function", r"\bdefp?\s+(\w+[?!]?)"), ("macro", r"\bdefmacrop?\s+(\w+)")],
    "r": [("function", r"(\w[\w.]*)\s*(?:<-|=)\s*function\b")],
    "haskell": [("function", r"^(\w+)\s*::"), ("type", r"^(?:data|newtype|type)\s+(\w+)"), ("interface", r"^class\s+(\w+)")],
    "zig": [("function", r"\bfn\s+(\w+)"), ("class", r"\bconst\s+(\w+)\s*=\s*(?:struct|enum|union)")],
    "css": [("class", r"([.#][\w-]+)\s*[,{]")],
    "hcl": [("class", r'^(?:resource|data)\s+"[^"]+"\s+"([^"]+)"'), ("class", r'^(?:variable|output|module|provider)\s+"([^"]+)"')],
    "makefile": [("function", r"^([\w.-]+)\s*:(?!=)"), ("macro", r"^(\w+)\s*[:?+]?=")],
    "sas": [("macro", r"(?i)%macro\s+(\w+)"), ("module", r"(?i)^\s*data\s+([\w.]+)")],
    "xml": [],
}
_DEFINITIONS |= {"javascript": _DEFINITIONS["typescript"], "cpp": _DEFINITIONS["c"] + [("class", r"\bclass\s+(\w+)"), ("module", r"\bnamespace\s+(\w+)")], "csharp": _DEFINITIONS["java"] + [("module", r"\bnamespace\s+([\w.]+)")]}
_IMPORTS = {
    "typescript": r"""(?:import|export)\b[^;'"\n]*?from\s*['"]([^'"]+)['"]|import\s*\(?\s*['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\)""", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "go": r'^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$', "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)",
    "c": r'^\s*#\s*include\s*[<"]([^>"]+)', "ruby": r"""^\s*require(?:_relative)?\s+['"]([^'"]+)""", "php": r"^\s*use\s+([\w\\]+)", "kotlin": r"^\s*import\s+([\w.]+)", "swift": r"^\s*import\s+(\w+)", "scala": r"^\s*import\s+([\w.]+)", "bash": r"^\s*(?:source|\.)\s+(\S+)",
    "lua": r"""require\s*\(?\s*['"]([^'"]+)""", "elixir": r"^\s*(?:alias|import|use|require)\s+([\w.]+)", "r": r"\b(?:library|require|source)\(\s*['\"]?([\w./]+)", "haskell": r"^import\s+(?:qualified\s+)?([\w.]+)", "zig": r'@import\("([^"]+)"\)',
    "css": r"""@import\s+(?:url\()?['"]([^'"]+)""", "hcl": r'^\s*source\s*=\s*"([^"]+)"', "makefile": r"^-?include\s+(\S+)", "sas": r"""(?i)%include\s+['"]([^'"]+)""", "xml": r"""(?:href|resource|schemaLocation|src|Include)\s*=\s*"([^"]+)\"""", "csharp": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;",
}
_IMPORTS |= {"javascript": _IMPORTS["typescript"], "cpp": _IMPORTS["c"]}
#: Words that look like calls but are none.
_NO_CALLS = frozenset("if for while switch catch return function def class new sizeof typeof match fn func fun and or not in is elif else super print println printf len range".split())


#: Names that each language brings along and that no edge is made to.
_BUILTINS = {
    "python": ("print", "len", "range", "str", "int", "float", "list", "dict", "set", "tuple", "isinstance", "super", "open", "enumerate", "zip", "sorted", "min", "max", "sum", "any", "all", "getattr", "setattr", "hasattr", "type", "repr"),
    "javascript": ("parseInt", "parseFloat", "require", "setTimeout", "clearTimeout", "setInterval", "clearInterval", "String", "Number", "Boolean", "Array", "Object", "Promise", "Symbol", "Date", "Error"),
    "r": ("c", "list", "paste", "cat", "stop", "warning", "is.null", "seq", "rep", "names", "nrow", "ncol"),
    "sas": ("input", "put", "sum", "mean", "scan", "substr", "trim", "compress"),
}
_BUILTINS["typescript"] = _BUILTINS["javascript"]
#: Words of a language that stand before parentheses and are no calls.
_BUILTINS |= {"go": ("import", "type", "var", "const", "defer", "go", "select"), "java": ("synchronized",), "csharp": ("lock", "using", "fixed")}


def is_supported(language: str) -> bool:
    """Whether files of a language are extracted."""
    return language in EXTRACTORS


def _by_patterns(language: str) -> Callable[[str], Parsed]:
    def parse(source: str) -> Parsed:
        if language == "rust":
            source = scopes.unwrapped_cfg(source)
        if language == "java":
            source = scopes.plain_varargs(source)
        lines, code = scopes.Lines(source), scopes.blanked(source, language)
        # A name is found once at its place, by the first pattern that finds it.
        named = {}
        for kind, pattern in _DEFINITIONS[language]:
            for m in re.finditer(pattern, code if '"' not in pattern else source, re.M):
                named.setdefault(m.start(1), (m[1], kind))
        entities = scopes.contained([(at, name, kind) for at, (name, kind) in sorted(named.items())], code, language, lines)
        if language == "php":
            entities = [(name, "method" if kind == "function" and container else kind, container, *span) for name, kind, container, *span in entities]
        relations = [(None, next(g for g in m.groups() if g), "IMPORTS") for m in re.finditer(_IMPORTS[language], ungrouped(source, language), re.M)] if language in _IMPORTS else []
        relations += scopes.heritage(code, language)
        own, builtin = {(e[3], e[0]) for e in entities}, _NO_CALLS | set(_BUILTINS.get(language, ()))
        for m in re.finditer(r"\b(\w+)\s*\(", code):
            at = lines.of(m.start())
            if m[1] not in builtin and (at, m[1]) not in own:
                relations.append((scopes.caller(entities, at), m[1], "CALLS"))
        relations += scopes.member_calls(code, language, entities, lines) + scopes.type_references(code, language, entities, lines)
        return (merged_clauses(entities) if language == "elixir" else entities), list(dict.fromkeys(relations))

    return parse


#: Imports of several names at once: what stands before the braces, and what joins it to each name.
_GROUPS = {"php": (r"^(\s*use\s+(?:function\s+|const\s+)?[\w\\]+\\)\{([^}]*)\}", r"\s+as\s+"), "scala": (r"^(\s*import\s+[\w.]+\.)\{([^}]*)\}", r"\s*=>\s*"), "rust": (r"^(\s*(?:pub\s+)?use\s+[\w:]+::)\{([^{}]*)\}", r"\s+as\s+")}


def ungrouped(source: str, language: str) -> str:
    """The source with imports of several names in braces as one import a line."""
    if language not in _GROUPS:
        return source
    pattern, renamed = _GROUPS[language]
    names = lambda group: [n for x in group.split(",") if (n := re.split(renamed, x.strip())[0]) not in ("", "_", "*", "self")]
    return re.sub(pattern, lambda m: "\n".join(m[1].lstrip("\n") + n for n in names(m[2])), source, flags=re.M)


def merged_clauses(entities: list[tuple]) -> list[tuple]:
    """Clauses of one function as one entity, from the first line of the first to the last line of the last."""
    out: dict[tuple, tuple] = {}
    for name, kind, container, first, last in entities:
        key = (kind, container, name)
        before = out.get(key, (name, kind, container, first, last))
        out[key] = (name, kind, container, min(before[3], first), max(before[4], last))
    return list(out.values())


for _language in _DEFINITIONS:
    EXTRACTORS.setdefault(_language, _by_patterns(_language))


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.links, self.tags = [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        held = dict(attrs)
        for key in {"script": ("src",), "link": ("href",), "a": ("href",), "img": ("src",), "iframe": ("src",), "source": ("src",), "use": ("href",)}.get(tag, ()):
            if held.get(key):
                self.links.append((None, held[key], "IMPORTS"))
        if "-" in tag:
            self.tags.append((tag, "class", None, self.getpos()[0], self.getpos()[0]))


@extractor("html")
def html(source: str) -> Parsed:
    found = _Links()
    found.feed(source)
    return found.tags, list(dict.fromkeys(found.links))


@extractor("json")
def json_keys(source: str) -> Parsed:
    """Every object key at its line, its dotted path as container; arrays are transparent."""
    json.loads(source)
    out, stack, line, at = [], [], 1, 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*"|[{}\[\],]', source):
        line += source.count("\n", at, m.start())
        at, token = m.start(), m[0]
        if token in "{[":
            above = stack[-1] if stack else {"path": "", "key": None}
            path = ".".join(x for x in (above["path"], above["key"]) if x)
            stack.append({"path": path, "key": None, "next": token == "{", "object": token == "{"})
        elif token in "}]":
            stack.pop()
        elif token == ",":
            stack[-1]["next"] = stack[-1]["object"]
        elif stack and stack[-1]["next"]:
            key = json.loads(token)
            out.append((key, "config_entry", stack[-1]["path"] or None, line, line))
            stack[-1] |= {"key": key, "next": False}
    return out, []


@extractor("yaml")
def yaml(source: str) -> Parsed:
    """Keys by indentation; a tab counts two, a list dash two more; keys of list items are nobody's parents."""
    out, stack = [], []
    for number, raw in enumerate(re.split(r"\r?\n", source), 1):
        if m := re.match(r"^(\s*)(-\s+)?([A-Za-z0-9_.-]+)\s*:.*$", raw):
            indent = len(m[1].replace("\t", "  ")) + (2 if m[2] else 0)
            while stack and indent <= stack[-1][0]:
                stack.pop()
            out.append((m[3], "config_entry", ".".join(s[1] for s in stack) or None, number, number))
            if not m[2]:
                stack.append((indent, m[3]))
    return out, []


@extractor("toml")
def toml(source: str) -> Parsed:
    """Tables with their prefixes once each, and keys below the table's dotted path."""
    out, seen, at = [], set(), None
    for number, raw in enumerate(source.split("\n"), 1):
        line = raw.strip()
        if m := re.match(r"^\[\[?\s*([^\]]+?)\s*\]\]?", line):
            parts = [p.strip().strip("\"'") for p in m[1].split(".")]
            for k in range(1, len(parts) + 1):
                if (path := ".".join(parts[:k])) not in seen:
                    seen.add(path)
                    out.append((parts[k - 1], "config_entry", ".".join(parts[: k - 1]) or None, number, number))
            at = ".".join(parts)
        elif line and not line.startswith("#") and (m := re.match(r"""^("[^"]+"|'[^']+'|[\w.-]+)\s*=""", line)):
            out.append((m[1].strip("\"'"), "config_entry", at, number, number))
    return out, []


@extractor("markdown")
def markdown(source: str) -> Parsed:
    """Headings outside fences and front matter, each within the nearest shallower one; a section ends before the next heading of its level or above."""
    lines = source.split("\n")
    found, fence, k = [], None, 0
    if lines and lines[0].strip() == "---":
        k = next((j + 1 for j in range(1, len(lines)) if lines[j].strip() in ("---", "...")), 0)
    while k < len(lines):
        line = lines[k]
        if m := re.match(r"^ {0,3}(`{3,}|~{3,})", line):
            if fence is None:
                fence = m[1]
            elif m[1][0] == fence[0] and len(m[1]) >= len(fence):
                fence = None
        elif fence is None:
            if m := re.match(r"^ {0,3}(#{1,6})\s+(.+?)\s*#*\s*$", line) or re.match(r"^\s*<h([1-6])[^>]*>(.*?)</h", line, re.I):
                found.append((k + 1, int(m[1]) if m[1].isdigit() else len(m[1]), m[2]))
            elif k and re.match(r"^ {0,3}(=+|-{3,})\s*$", line) and lines[k - 1].strip() and not (found and found[-1][0] == k):
                found.append((k, 1 if "=" in line else 2, lines[k - 1].strip()))
        k += 1
    out = []
    for j, (at, level, name) in enumerate(found):
        name = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", re.sub(r"\s*\{#[^}]*\}\s*$", "", name)).replace("\\*", "*")).strip()
        end = next((a - 1 for a, lv, _ in found[j + 1 :] if lv <= level), len(lines))
        out.append((name, "heading", next((n for a, lv, n in reversed(found[:j]) if lv < level), None), at, end))
    return out, []


@extractor("dockerfile")
def dockerfile(source: str) -> Parsed:
    out, relations, stage, number = [], [], None, 0
    # A line that goes on stands at its first line; what it goes on with is a blank one.
    joined = re.sub(r"(?:[^\n]*\\\n)+[^\n]*", lambda m: m[0].replace("\\\n", " ") + "\n" * m[0].count("\\\n"), source)
    for at, line in enumerate(joined.split("\n"), 1):
        if m := re.match(r"(?i)^\s*FROM\s+(?:--\S+\s+)*(\S+)(?:\s+AS\s+(\S+))?", line):
            stage, number = m[2] or f"stage-{number}", number + 1
            out += [(stage, "config", None, at, at), (m[1], "module", None, at, at)]
            relations.append((stage, m[1], "IMPORTS"))
        elif m := re.match(r"^\s*([A-Z]+)\s+(.*)$", line):
            rest = re.sub(r"^(--\S+\s+)+", "", m[2])
            name = f"{m[1].lower()}:{rest.split()[0]}" if m[1] in ("COPY", "ADD") and rest.split() else m[1].lower()
            out.append((name, "config_entry", stage, at, at))
            if f := re.search(r"--from=(\S+)", m[2]):
                relations.append((stage, f[1], "IMPORTS"))
    return out, relations


@extractor("latex")
def latex(source: str) -> Parsed:
    levels = ["part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph"]
    text = re.sub(r"(?<!\\)%[^\n]*", "", re.sub(r"\\begin\{(verbatim|lstlisting)\}.*?\\end\{\1\}", lambda m: "\n" * m[0].count("\n"), source, flags=re.S))
    out, relations, stack = [], [], []
    for m in re.finditer(r"\\(part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|label|newcommand|renewcommand|usepackage|input|include|bibliography|ref|cite|begin)\*?(?:\[[^\]]*\])?\{(\\?[^}]*)\}", text):
        at, what, name = text.count("\n", 0, m.start()) + 1, m[1], m[2]
        if what in levels:
            while stack and stack[-1][0] >= levels.index(what):
                stack.pop()
            out.append((name, "section", stack[-1][1] if stack else None, at, at))
            stack.append((levels.index(what), name))
        elif what in ("newcommand", "renewcommand"):
            out.append((name.lstrip("\\"), "function", None, at, at))
        elif what == "label":
            out.append((name, "label", stack[-1][1] if stack else None, at, at))
        elif what == "begin":
            out.append((name, "environment", stack[-1][1] if stack else None, at, at))
        elif what in ("usepackage", "input", "include", "bibliography"):
            ext = {"usepackage": ".sty", "bibliography": ".bib"}.get(what, ".tex")
            relations += [(None, n.strip() if "." in n else n.strip() + ext, "IMPORTS") for n in name.split(",")]
        else:
            relations += [(stack[-1][1] if stack else None, n.strip(), "REFERENCES") for n in name.split(",")]
    return out, list(dict.fromkeys(relations))


@extractor("sql")
def sql(source: str) -> Parsed:
    text = re.sub(r"--[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)
    out, relations = [], []
    for m in re.finditer(r"(?is)\bcreate\s+(?:or\s+replace\s+)?(?:unique\s+|temp(?:orary)?\s+|materialized\s+)*(table|view|function|procedure|trigger|index)\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)(.*?);", text):
        kind, name = m[1].lower(), re.sub(r"[\"`\[\]]", "", m[2])
        at = text.count("\n", 0, m.start()) + 1
        out.append((name, {"procedure": "function"}.get(kind, kind), None, at, text.count("\n", 0, m.end()) + 1))
        if kind != "table":
            relations += [(name, t, "REFERENCES") for t in re.findall(r"(?i)\b(?:from|join|into|update|references|on)\s+([A-Za-z_][\w.]*)", m[3]) if t != name]
    return out, list(dict.fromkeys(relations))


ROW = "path string, language string, seq long, row string, name string, kind string, container string, first_line int, last_line int, source string, target string, predicate string, error string"


def extract(files: DataFrame) -> DataFrame:
    """files(path, language, content) -> one row per entity (`row` = entity) and relationship, in order; the file itself comes first."""
    registry = dict(EXTRACTORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ROW.split(", ")]
        for batch in batches:
            rows = []
            for path, language, content in zip(batch.path, batch.language, batch.content, strict=True):
                content = content or ""
                base = (path, language)
                rows.append((*base, 0, "entity", path.rsplit("/", 1)[-1], "file", None, 1, content.count("\n") + 1, None, None, None, None))
                try:
                    entities, relations = registry[language](content) if language in registry else ([], [])
                except Exception as e:  # noqa: BLE001  a broken file is a result
                    rows.append((*base, 1, "error", *[None] * 8, type(e).__name__))
                    continue
                for k, e in enumerate(entities):
                    rows.append((*base, k + 1, "entity", *e, None, None, None, None))
                for k, r in enumerate(relations):
                    rows.append((*base, k + 1, "relationship", *[None] * 5, *r, None))
            out = pd.DataFrame(rows, columns=names)
            for c in ("first_line", "last_line"):
                out[c] = out[c].astype("Int32")
            yield out

    return _spread(files.select("path", "language", "content")).mapInPandas(run, ROW)


def _spread(files: DataFrame) -> DataFrame:
    """files over all tasks of a shuffle: a table's few bytes may hold many files, and what takes time is each file, not its bytes."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def sniffed(path: Column, content: Column, language: Column) -> Column:
    """The language of a file: C++ for headers of C that use what only C++ has."""
    cpp = r"\bclass\s+[A-Za-z_]\w*\b|\bnamespace\s+[A-Za-z_]\w*\b|\btemplate\s*<|\busing\s+namespace\b|\b(public|private|protected)\s*:|\b(virtual|constexpr|typename|friend|operator)\b|\b[A-Za-z_]\w*::[A-Za-z_]\w*"
    return F.when((language == "c") & F.endswith(F.lower(path), F.lit(".h")) & F.rlike(content, F.lit(cpp)), "cpp").otherwise(language)


def chunks(extracted: DataFrame, files: DataFrame) -> DataFrame:
    """(path, seq, name, kind, container, first_line, last_line, start_byte, end_byte, content_hash): one chunk a definition, one of the whole file where there is none.

    extracted is extract(files) of files(path, content); the hash is the first 16
    hex digits of the chunk's text.
    """
    found = extracted.where("row = 'entity' and kind not in ('file', 'module')").select("path", "seq", "name", "kind", "container", "first_line", "last_line")
    # One join, so files are read by their extractors once.
    rows = files.where("path is not null").select("path", F.split("content", "\n", -1).alias("lines")).join(found, "path", "left")
    whole = F.col("seq").isNull()
    rows = rows.select("path", "lines", F.coalesce("seq", F.lit(0)).alias("seq"), "name", F.when(whole, "file_body").otherwise(F.col("kind")).alias("kind"), "container", F.when(whole, 1).otherwise(F.col("first_line")).alias("first_line"), F.when(whole, F.size("lines")).otherwise(F.col("last_line")).alias("last_line"))
    before = F.array_join(F.slice("lines", F.lit(1), F.greatest(F.col("first_line") - 1, F.lit(0))), "\n")
    text = F.array_join(F.slice("lines", F.col("first_line"), F.greatest(F.col("last_line") - F.col("first_line") + 1, F.lit(0))), "\n")
    start = F.when(F.col("first_line") > 1, F.octet_length(before) + 1).otherwise(F.lit(0))
    return rows.select("path", "seq", "name", "kind", "container", "first_line", "last_line", start.alias("start_byte"), (start + F.octet_length(text)).alias("end_byte"), F.substring(F.sha2(text, 256), 1, 16).alias("content_hash"))


def bindings(files: DataFrame) -> DataFrame:
    """(path, row, seq, package, local, other) of JavaScript and TypeScript files(path, language, content): imports bind a local name, exports give one a public name, covered names are those that a caller's own hide."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, language, content in zip(batch.path, batch.language, batch.content, strict=True):
                content = content or ""
                bound = scopes.js_bindings(content)
                rows += [(path, "import", k, p, local, name) for k, (p, local, name) in enumerate(bound)]
                rows += [(path, "export", k, None, local, public) for k, (local, public) in enumerate(scopes.js_exports(content))]
                entities, _ = EXTRACTORS[language](content)
                covered = scopes.shadowed(scopes.blanked(content, language), entities, scopes.Lines(content), {b[1] for b in bound})
                rows += [(path, "covered", k, by, name, None) for k, (by, name) in enumerate(sorted(covered))]
            yield pd.DataFrame(rows, columns=["path", "row", "seq", "package", "local", "other"])

    some = files.where("language in ('javascript', 'typescript')").select("path", "language", "content")
    return _spread(some).mapInPandas(run, "path string, row string, seq int, package string, local string, other string")


def bound_calls(calls: DataFrame, names: DataFrame) -> DataFrame:
    """calls(path, src, name) with bound of bindings(): false if the caller's own name covers an imported one, true if it does not, null for names that are not imported."""
    imported = names.where("row = 'import'").select("path", F.col("local").alias("name"), F.lit(True).alias("imported")).distinct()
    covered = names.where("row = 'covered'").select("path", F.col("package").alias("src"), F.col("local").alias("name"), F.lit(True).alias("covered")).distinct()
    return calls.join(imported, ["path", "name"], "left").join(covered, ["path", "src", "name"], "left").withColumn("bound", F.when(F.col("imported"), F.col("covered").isNull())).drop("imported", "covered")


def php_blocks(files: DataFrame) -> DataFrame:
    """(path, n) of PHP files(path, content): how many namespace blocks each has."""
    return files.select("path", F.size(F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:<\?php\s+)?namespace\s*[\w\\]*\s*[;{]"), F.lit(0))).alias("n"))


def sql_table_refs(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:from|join|into|update)\s+([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1)), F.lower)))


def html_links(html_: Column) -> Column:
    return F.regexp_extract_all(html_, F.lit(r'href="([^"]*)"'), F.lit(1))
