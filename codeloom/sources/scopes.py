"""Blocks, containers, heritage, types and bindings of source text, without a grammar library.

Comments and strings are blanked first, with all offsets kept, so that patterns
and braces only meet code.
"""

from __future__ import annotations

import re
from bisect import bisect_right

#: Languages whose blocks are in braces, and those whose blocks end with a word at the indent of their beginning.
BRACES = frozenset(("typescript", "javascript", "java", "c", "cpp", "csharp", "go", "rust", "php", "kotlin", "swift", "scala", "zig", "css", "hcl"))
ENDED = frozenset(("ruby", "elixir", "lua"))
#: Kinds that hold members.
HOLDERS = frozenset(("class", "interface", "trait", "module"))
_LINE_COMMENTS = {"ruby": "#", "elixir": "#", "r": "#", "bash": "#", "makefile": "#", "hcl": "#", "lua": "--", "haskell": "--", "php": "//|#", "zig": "//"}

#: Types that no reference is made to.
BUILTIN_TYPES = frozenset(("String", "Integer", "Boolean", "Object", "Double", "Float", "Long", "Short", "Byte", "Character", "Void", "Promise", "Array", "Map", "Set", "Record", "Partial", "Readonly", "Date", "Error", "List", "Optional", "Option", "Some", "None", "Result", "Vec", "Box", "Int", "Unit", "Any", "Self", "T", "K", "V", "E"))
#: Patterns of heritage: (name, bases as a list).
HERITAGE = {
    "typescript": [r"\b(?:class|interface)\s+(\w+)(?:<[^>{]*>)?\s+extends\s+([\w.<>, ]+?)(?=\s+implements\b|\s*\{)", r"\bclass\s+(\w+)[^{;]*?\bimplements\s+([\w.<>, ]+?)(?=\s*\{)"],
    "java": [r"\b(?:class|interface|enum|record)\s+(\w+)[^{;]*?\bextends\s+([\w.<>, ]+?)(?=\s+implements\b|\s*\{)", r"\b(?:class|enum|record)\s+(\w+)[^{;]*?\bimplements\s+([\w.<>, ]+?)(?=\s*\{)"],
    "csharp": [r"\b(?:class|interface|struct|record)\s+(\w+)(?:<[^>{]*>)?\s*:\s*([\w.<>, ]+?)(?=\s*(?:where\b|\{))"],
    "kotlin": [r"\b(?:class|object|interface)\s+(\w+)(?:<[^>{]*>)?(?:\([^)]*\))?\s*:\s*([\w.<>,() ]+?)(?=\s*[{\n])"],
    "swift": [r"\b(?:class|struct|enum|protocol|extension)\s+(\w+)(?:<[^>{]*>)?\s*:\s*([\w.<>, ]+?)(?=\s*\{)"],
    "scala": [r"\b(?:class|object|trait)\s+(\w+)[^{\n]*?\bextends\s+([\w.\[\], ]+?)(?=\s+with\b|\s*[({\n])", r"\b(?:class|object|trait)\s+(\w+)[^{\n]*?\bwith\s+([\w.\[\], ]+?)(?=\s*[({\n])"],
    "php": [r"\b(?:class|interface)\s+(\w+)\s+extends\s+([\w\\, ]+?)(?=\s+implements\b|\s*\{)", r"\b(?:class|enum)\s+(\w+)[^{;]*?\bimplements\s+([\w\\, ]+?)(?=\s*\{)"],
    "cpp": [r"\b(?:class|struct)\s+(\w+)\s*(?:final\s*)?:\s*([\w:<>, ]+?)(?=\s*\{)"],
    "ruby": [r"\bclass\s+(\w+)\s*<\s*([\w:]+)"],
    "rust": [r"\bimpl(?:<[^>]*>)?\s+[\w:]+(?:<[^>]*>)?\s+for\s+(\w+)"],
}
HERITAGE["javascript"] = HERITAGE["typescript"]
#: Patterns of types that are referred to.
TYPES = {
    "typescript": [r"[:<|&,]\s*([A-Z]\w+)", r"\bas\s+([A-Z]\w+)"],
    "java": [r"\b([A-Z]\w+)(?:<[^<>]*>)?(?:\[\])?\s+\w+\s*[=;,):]", r"<\s*([A-Z]\w+)"],
    "csharp": [r"\b([A-Z]\w+)(?:<[^<>]*>)?(?:\[\])?\s+\w+\s*[=;,){]", r"<\s*([A-Z]\w+)"],
    "go": [r"[\s*\])]([A-Z]\w+)\s*[,){\n]"],
    "rust": [r":\s*&?(?:mut\s+)?([A-Z]\w+)", r"->\s*&?([A-Z]\w+)"],
    "kotlin": [r":\s*([A-Z]\w+)"],
    "swift": [r":\s*([A-Z]\w+)", r"->\s*([A-Z]\w+)"],
    "scala": [r":\s*([A-Z]\w+)"],
    "cpp": [r"\b([A-Z]\w+)\s*[*&]?\s+\w+\s*[=;,)(]"],
    "php": [r"[(,]\s*\??([A-Z]\w+)\s+\$", r":\s*\??([A-Z]\w+)\s*\{"],
}
#: Patterns that say of which type a variable is: (variable, type) by name.
DECLARED = {
    "python": [r"(?P<v>\w+)\s*:\s*['\"]?(?P<t>[A-Z]\w+)", r"(?P<v>\w+)\s*=\s*(?P<t>[A-Z]\w+)\("],
    "php": [r"(?P<t>[A-Z]\w+)\s+\$(?P<v>\w+)", r"\$(?P<v>\w+)\s*=\s*new\s+(?P<t>[A-Z]\w+)"],
    "go": [r"[(,]\s*(?P<v>\w+)\s+\*?(?P<t>[A-Z]\w*)", r"(?P<v>\w+)\s*:=\s*&?(?P<t>[A-Z]\w*)\{", r"\bvar\s+(?P<v>\w+)\s+\*?(?P<t>[A-Z]\w*)"],
    "c": [r"\b(?:struct\s+)?(?P<t>[A-Z]\w+)\s*[*&]?\s*(?P<v>\w+)\s*[;=,)]"],
    "typescript": [r"(?P<v>\w+)\s*:\s*(?P<t>[A-Z]\w+)", r"\b(?:const|let|var)\s+(?P<v>\w+)\s*=\s*new\s+(?P<t>[A-Z]\w+)"],
    "java": [r"\b(?P<t>[A-Z]\w+)(?:<[^<>]*>)?\s+(?P<v>[a-z]\w*)\s*[=;,)]"],
}
DECLARED |= {"cpp": DECLARED["c"], "javascript": DECLARED["typescript"], "csharp": DECLARED["java"]}
_SELF = frozenset(("this", "self", "cls", "$this"))
#: Qualified calls: receiver, member.
_MEMBER = re.compile(r"(?<![\w.>])(\$?\w+)\s*(?:\.|->|::|\?\.)\s*(\w+)\s*\(")


def blanked(source: str, language: str) -> str:
    """source with comments and the contents of strings as blanks, line breaks kept."""
    line = _LINE_COMMENTS.get(language, "//")
    parts = rf"(?:{line})[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
    return re.sub(parts, lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)


def unwrapped_cfg(source: str) -> str:
    """Rust source in which conditional blocks macro! { .. } are blanked but for what they hold, so that their items are seen."""
    return re.sub(r"\bcfg_\w+!\s*\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}", lambda m: " " * (m.start(1) - m.start()) + m[1] + " ", source)


def plain_varargs(source: str) -> str:
    """Java source in which annotated varargs (`@A ... x`) are plain ones."""
    return re.sub(r"@\w+\s+(?=\.\.\.)", lambda m: " " * len(m[0]), source)


def namespaces(source: str) -> list[tuple[int, str]]:
    """(offset, name) of the namespace blocks of PHP source, in order."""
    return [(m.start(), m[1] or "") for m in re.finditer(r"^\s*(?:<\?php\s+)?namespace\s*([\w\\]*)\s*[;{]", source, re.M)]


class Lines:
    def __init__(self, source: str) -> None:
        self._starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.count = len(self._starts)

    def of(self, at: int) -> int:
        return bisect_right(self._starts, at)

    def start(self, line: int) -> int:
        return self._starts[line - 1]


def _closing(code: str, at: int) -> int:
    """Offset of the brace that closes the one at `at`, or the end."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(code) - 1


def block_end(code: str, at: int, language: str, lines: Lines) -> int:
    """Last line of the definition whose name stands at offset `at`."""
    first = lines.of(at)
    if language in BRACES:
        m = re.compile(r"[{;\n]").search(code, at)
        while m and m[0] == "\n" and re.match(r"\s*(?:[{:,]|extends\b|implements\b|where\b|throws\b|with\b)", code[m.end() : m.end() + 80]):
            m = re.compile(r"[{;\n]").search(code, m.end())
        if m is None or m[0] != "{":
            return first
        return lines.of(_closing(code, m.start()))
    begin = lines.start(first)
    indent = len(re.match(r"[ \t]*", code[begin:])[0])
    if language in ENDED:
        m = re.compile(rf"^[ \t]{{{indent}}}end\b", re.M).search(code, at)
        return lines.of(m.start()) if m else lines.count
    m = re.compile(rf"^[ \t]{{0,{indent}}}\S", re.M).search(code, lines.start(first + 1) if first < lines.count else len(code))
    return lines.of(m.start()) - 1 if m else lines.count


def innermost(spans: list[tuple], line: int, kinds: frozenset | set, but: tuple | None = None) -> tuple | None:
    """The shortest of spans (name, kind, container, first, last) of some kinds that holds a line, the first of equal ones."""
    held = [s for s in spans if s[1] in kinds and s[3] <= line <= s[4] and s is not but and (but is None or (s[3], -s[4]) < (but[3], -but[4]))]
    return min(held, key=lambda s: s[4] - s[3], default=None)


def contained(found: list[tuple[int, str, str]], code: str, language: str, lines: Lines) -> list[tuple]:
    """Entities (name, kind, container, first, last) of found (offset, name, kind): a function inside a class is a method of it."""
    spans = [(name, kind, None, lines.of(at), block_end(code, at, language, lines)) for at, name, kind in found]
    out = []
    for (at, _, _), s in zip(found, spans, strict=True):
        holder = innermost(spans, s[3], HOLDERS, s)
        container = holder[0] if holder else None
        if language == "go" and (m := re.match(r"func\s+\(\s*\w*\s*\*?\s*(\w+)[^)]*\)", code[lines.start(s[3]) :])):
            container = m[1]
        kind = "method" if s[1] == "function" and container and holder and holder[1] in ("class", "interface", "trait") else s[1]
        out.append((s[0], kind, container, s[3], s[4]))
    return out


def heritage(code: str, language: str) -> list[tuple]:
    """EXTENDS relationships, of what is extended and of what is implemented alike."""
    out = []
    for pattern in HERITAGE.get(language, []):
        for m in re.finditer(pattern, code):
            if language == "rust":
                trait = re.search(r"impl(?:<[^>]*>)?\s+([\w:]+)", m[0])
                out.append((m[1], trait[1].split("::")[-1], "EXTENDS"))
                continue
            for base in re.sub(r"<[^<>]*>|\[[^\]]*\]|\([^)]*\)", "", m[2]).split(","):
                name = re.sub(r"\b(?:public|private|protected|virtual)\b", "", base).strip()
                if name:
                    out.append((m[1], re.split(r"[.:\\]+", name)[-1], "EXTENDS"))
    return out


def caller(entities: list[tuple], line: int) -> str | None:
    """Where a call on a line comes from: the innermost function, else class, else the file (None); members are qualified."""
    at = innermost(entities, line, {"function", "method", "macro"}) or innermost(entities, line, HOLDERS)
    return None if at is None else f"{at[2]}.{at[0]}" if at[2] else at[0]


def type_references(code: str, language: str, entities: list[tuple], lines: Lines) -> list[tuple]:
    """REFERENCES to types, once a source; built-in types and names of one letter are none."""
    out, own = [], {(e[0], e[3]) for e in entities}
    for pattern in TYPES.get(language, []):
        for m in re.finditer(pattern, code):
            at = lines.of(m.start(1))
            if len(m[1]) > 1 and m[1] not in BUILTIN_TYPES and (m[1], at) not in own:
                out.append((caller(entities, at), m[1], "REFERENCES"))
    return list(dict.fromkeys(out))


def member_calls(code: str, language: str, entities: list[tuple], lines: Lines) -> list[tuple]:
    """Calls of members by receiver: of the enclosing class for this and self, of the declared type for typed variables, else as written."""
    types: dict[tuple, str] = {}
    for pattern in DECLARED.get(language, []):
        for m in re.finditer(pattern, code):
            types.setdefault((caller(entities, lines.of(m.start())), m["v"]), m["t"])
    out = []
    for m in _MEMBER.finditer(code):
        at = lines.of(m.start())
        by, receiver = caller(entities, at), m[1]
        if receiver in _SELF:
            holder = innermost(entities, at, HOLDERS)
            receiver = holder[0] if holder else None
        else:
            receiver = types.get((by, receiver.lstrip("$"))) or types.get((None, receiver.lstrip("$"))) or receiver.lstrip("$")
        if receiver:
            out.append((by, f"{receiver}.{m[2]}", "CALLS"))
    return out


def js_bindings(source: str) -> list[tuple[str, str, str]]:
    """(package, local name, imported name) of import statements; a default is imported as `default`, a namespace binds nothing."""
    out = []
    for m in re.finditer(r"\bimport\s+(?:type\s+)?([^'\";]+?)\s+from\s*['\"]([^'\"]+)['\"]", source):
        clause, package = m[1].strip(), m[2]
        named = re.search(r"\{([^}]*)\}", clause)
        head = re.sub(r"\{[^}]*\}", "", clause).strip(" ,\n")
        if head and not head.startswith("*"):
            out.append((package, head.split(",")[0].strip(), "default"))
        for part in (named[1] if named else "").split(","):
            if words := re.sub(r"^\s*type\s+", "", part).split():
                out.append((package, words[-1], words[0]))
    return out


def js_exports(source: str) -> list[tuple[str, str]]:
    """(local name, public name) of exports: under their own name, another one, or as default."""
    out = [(m[2], "default" if m[1] else m[2]) for m in re.finditer(r"\bexport\s+(default\s+)?(?:async\s+)?(?:abstract\s+)?(?:class|function\*?|const|let|var|interface|enum|type)\s+(\w+)", source)]
    out += [(m[1], "default") for m in re.finditer(r"\bexport\s+default\s+(\w+)\s*;?\s*$", source, re.M) if m[1] not in ("class", "function", "async")]
    for m in re.finditer(r"\bexport\s*\{([^}]*)\}(?!\s*from)", source):
        for part in m[1].split(","):
            if words := part.split():
                out.append((words[0], words[-1]))
    return list(dict.fromkeys(out))


def shadowed(code: str, entities: list[tuple], lines: Lines, names: set[str]) -> set[tuple]:
    """(caller, name) of imported names that a parameter or a local variable of the caller covers."""
    out = set()
    for e in entities:
        if e[1] not in ("function", "method"):
            continue
        body = code[lines.start(e[3]) : lines.start(e[4] + 1) if e[4] < lines.count else len(code)]
        head = re.search(r"\(([^)]*)\)", body)
        own = set(re.findall(r"\b(\w+)\b", head[1] if head else "")) | set(re.findall(r"\b(?:const|let|var|function)\s+(\w+)", body))
        own.discard(e[0])
        out |= {(f"{e[2]}.{e[0]}" if e[2] else e[0], n) for n in names & own}
    return out
