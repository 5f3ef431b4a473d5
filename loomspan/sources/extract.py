"""Facts and syntax sites of source files: Python by its own parser, brace languages by a scanner."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FACT = "kind string, name string, qualified_name string, name_start long, name_end long, decl_start long, decl_end long"
_SITE = "site_kind string, raw_target string, start long, end long, enclosing string, enclosing_kind string, evidence string"
#: Which site kinds each extractor supports; a kind that isn't supported is not the same as none found.
SUPPORT = {"rust": ("import", "reference", "call", "macro_call", "test_marker"), "go": ("import", "call"), "typescript": ("import", "call"), "tsx": ("import", "call"), "python": ("import", "call")}
DIRECT, HEURISTIC = "direct_syntax", "syntax_heuristic"


@dataclass
class Found:
    """Facts and sites as tuples in the order of their columns; ``errors``: places that don't parse."""

    facts: list[tuple] = field(default_factory=list)
    sites: list[tuple] = field(default_factory=list)
    errors: int = 0


# --- Python


def _python(text: str) -> Found:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return Found(errors=1)
    lines, at = [0], 0
    for line in text.splitlines(keepends=True):
        at += len(line.encode())
        lines.append(at)
    off = lambda row, col: lines[row - 1] + col
    raw = text.encode()
    facts, sites = [], []
    todo: list[tuple[ast.AST, tuple[str, ...], bool, str | None]] = [(tree, (), False, None)]
    while todo:
        node, outer, inside_class, kind = todo.pop()
        for child in ast.iter_child_nodes(node):
            here, in_class, k = outer, inside_class, kind
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) or type(child).__name__ == "TypeAlias":
                name = child.name if isinstance(child.name, str) else child.name.id
                k = "class" if isinstance(child, ast.ClassDef) else "type_alias" if type(child).__name__ == "TypeAlias" else "method" if inside_class else "function"
                first = min([child.lineno, *[d.lineno for d in getattr(child, "decorator_list", [])]])
                start = off(first, child.col_offset) if first == child.lineno else lines[first - 1]
                end = off(child.end_lineno, child.end_col_offset)
                n = raw.find(name.encode(), off(child.lineno, child.col_offset) + 1)
                here, in_class = (*outer, name), isinstance(child, ast.ClassDef)
                facts.append((k, name, "::".join(here), n, n + len(name.encode()), start, end))
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                base = "." * (getattr(child, "level", 0) or 0) + (getattr(child, "module", None) or "")
                for a in child.names:
                    target = (f"{base}.{a.name}" if base and not base.endswith(".") else base + a.name) + (f" as {a.asname}" if a.asname else "")
                    sites.append(("import", target, off(child.lineno, child.col_offset), off(child.end_lineno, child.end_col_offset), "::".join(outer) or None, kind, DIRECT))
            elif isinstance(child, ast.Call):
                f = child.func
                s, e = off(f.lineno, f.col_offset), off(f.end_lineno, f.end_col_offset)
                sites.append(("call", raw[s:e].decode("utf-8", "replace"), s, e, "::".join(outer) or None, kind, DIRECT))
            todo.append((child, here, in_class, k))
    return Found(sorted(facts, key=lambda x: (x[5], x[3])), sorted(sites, key=lambda x: (x[2], x[3])))


# --- brace languages

_NAME = rb"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*"
_QUIET = {
    "rust": rb'//[^\n]*|/\*.*?\*/|b?r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|b?\'(?:\\(?:u\{[^}]*\}|.)|[^\\\'\n])\'',
    "go": rb'//[^\n]*|/\*.*?\*/|`[^`]*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "typescript": rb'//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
}
_DECLARATIONS = {
    "rust": rb"\b(fn|struct|enum|union|trait|mod|type|const(?!\s+(?:unsafe\s+|extern\s+)*fn\b)|static|macro_rules!|impl)\s*(?:mut\s+)?(?:<[^>{}]*>\s*)?(" + _NAME + rb"(?:[^{;=(]*\bfor\s+" + _NAME + rb")?)",
    "go": rb"(?:^|(?<=[;{}\n]))[ \t]*(?:(func)\s+(?:\(\s*(?:\w+\s+)?\*?(\w+)[^)]*\)\s*)?|(type|const|var)[ \t]+)(" + _NAME + rb")",
    "typescript": rb"(?<![\w$.])(function\s*\*|function|class|interface|enum|type|namespace|module|const|let|var)(?:\s+|(?<=\*)\s*)(" + _NAME + rb"(?:\s*\.\s*" + _NAME + rb")*)",
}
_KINDS = {b"fn": "function", b"struct": "struct", b"enum": "enum", b"union": "union", b"trait": "trait", b"mod": "module", b"type": "type_alias", b"const": "constant", b"static": "static", b"macro_rules!": "macro", b"func": "function", b"var": "variable", b"let": "variable", b"class": "class", b"interface": "interface", b"function": "function", b"namespace": "module", b"module": "module"}
_KEYWORDS = {b"if", b"for", b"while", b"match", b"switch", b"return", b"fn", b"func", b"function", b"catch", b"loop", b"impl", b"where", b"with", b"await", b"typeof", b"in", b"of", b"as", b"super", b"import", b"else", b"do", b"case", b"yield", b"throw", b"delete", b"void", b"const", b"var", b"type"}
_MODIFIERS = re.compile(rb"(?:\s|\*|public\b|private\b|protected\b|static\b|async\b|abstract\b|override\b|readonly\b|get\b|set\b|declare\b|export\b|default\b)*")
_CLOSE = {ord("{"): ord("}"), ord("("): ord(")"), ord("["): ord("]")}


class _Code:
    """Code with comments and literals blanked, so that spans stay, and its brackets matched in one pass."""

    def __init__(self, raw: bytes, language: str):
        self.raw, self.language = raw, language
        self.code = re.sub(_QUIET[language], lambda m: re.sub(rb"[^\n]", b" ", m[0]), raw, flags=re.S)
        self.at: list[int] = []
        self.char: list[int] = []
        self.mate: list[int] = []  # the other bracket's number, or -1
        self.outer: list[int] = []  # the innermost bracket open before this one, or -1
        self.errors, stack = 0, []
        for m in re.finditer(rb"[{}()\[\];]", self.code):
            c, k = m[0][0], len(self.at)
            self.at.append(m.start())
            self.char.append(c)
            self.mate.append(-1)
            if c in _CLOSE:
                self.outer.append(stack[-1] if stack else -1)
                stack.append(k)
                continue
            if c != ord(";"):
                if stack and _CLOSE[self.char[stack[-1]]] == c:
                    j = stack.pop()
                    self.mate[j], self.mate[k] = k, j
                else:
                    self.errors += 1
            self.outer.append(stack[-1] if stack else -1)
        self.errors += len(stack)

    def inside(self, position: int) -> int:
        """The number of the innermost bracket open at a position, or -1."""
        k = bisect_left(self.at, position) - 1
        if k < 0:
            return -1
        return k if self.char[k] in _CLOSE else self.outer[k]

    def end_of(self, position: int) -> int:
        """Where the declaration whose head ends at ``position`` ends: with its block, its semicolon, or what is around it."""
        k = bisect_left(self.at, position)
        while k < len(self.at):
            c = self.char[k]
            if c == ord(";"):
                return self.at[k] + 1
            if c not in _CLOSE:
                return self.at[k]
            if self.mate[k] < 0:
                return len(self.code)
            if c == ord("{"):
                return self.at[self.mate[k]] + 1
            k = self.mate[k] + 1
        return len(self.code)

    def statement_end(self, position: int) -> int:
        """The same for a variable, whose initial value may hold blocks and end with its line."""
        k, at = bisect_left(self.at, position), position
        while True:
            stop = self.at[k] if k < len(self.at) else len(self.code)
            for m in re.finditer(rb"\n", self.code[at:stop]):
                before, after = self.code[position : at + m.start()].rstrip()[-1:], self.code[at + m.end() : at + m.end() + 200].lstrip()[:1]
                if before not in (b"=", b",", b"+", b"-", b"*", b"/", b"|", b"&", b"?", b":", b">", b"<", b"(", b"") and after not in (b".", b",", b"?", b":", b"+", b"-", b"*", b"/", b"|", b"&", b"=", b"(", b"["):
                    return at + m.start()
            if k >= len(self.at) or self.char[k] not in _CLOSE or self.mate[k] < 0:
                return stop
            at, k = self.at[self.mate[k]] + 1, self.mate[k] + 1


def _text(b: bytes) -> str:
    return b.decode("utf-8", "replace")


def _rust_facts(c: _Code) -> list[tuple]:
    """(kind, name, name start, name end, start, end, extra scopes)."""
    out = []
    for m in re.finditer(_DECLARATIONS["rust"], c.code):
        word, name = m[1], m[2]
        first = re.match(_NAME, name)[0]
        if word == b"impl":
            target = re.search(rb"\bfor\s+(" + _NAME + rb")", name)
            out.append(("impl", _text(target[1] if target else first), m.start(2), m.start(2) + len(first), m.start(), c.end_of(m.end()), ()))
        elif not (word == b"const" and first == b"fn") and not (word in (b"type", b"union") and c.code[m.start() - 1 : m.start()] == b"."):
            end = c.statement_end(m.end()) if word in (b"const", b"static") else c.end_of(m.end(2) if word != b"macro_rules!" else m.end())
            out.append((_KINDS[word], _text(first), m.start(2), m.start(2) + len(first), m.start(), end, ()))
    return out


def _go_facts(c: _Code) -> list[tuple]:
    out = []
    package = re.search(rb"^\s*package\s+(\w+)", c.code, re.M)
    scope = (_text(package[1]),) if package else ()
    spec = re.compile(rb"^[ \t]*(" + _NAME + rb")(?=[ \t]|\n|,|=)", re.M)

    def kind_of(word: bytes, rest: bytes) -> str:
        if word != b"type":
            return "constant" if word == b"const" else "variable"
        rest = re.sub(rb"^\[[^\]]*\]", b"", rest.lstrip())
        return "type_alias" if rest.lstrip().startswith(b"=") else "struct" if re.match(rb"\s*struct\b", rest) else "interface" if re.match(rb"\s*interface\b", rest) else "defined_type"

    for m in re.finditer(rb"(?:^|(?<=[;}\n]))[ \t]*(type|const|var)\s*\(", c.code, re.M):
        k = bisect_left(c.at, m.end() - 1)
        if c.inside(m.start(1)) >= 0 or c.mate[k] < 0:
            continue
        at, stop = m.end(), c.at[c.mate[k]]
        while (s := spec.search(c.code, at, stop)) is not None:
            if c.inside(s.start(1)) == k:
                end = c.statement_end(s.end())
                out.append((kind_of(m[1], c.code[s.end() : s.end() + 200]), _text(s[1]), s.start(1), s.end(1), s.start(1), end, scope))
                at = max(end, s.end())
            else:
                at = s.end()
    for m in re.finditer(_DECLARATIONS["go"], c.code, re.M):
        if c.inside(m.start(4)) >= 0:
            continue  # local ones
        kind = ("method" if m[2] else "function") if m[1] else kind_of(m[3], c.code[m.end() : m.end() + 200])
        end = c.end_of(m.end()) if m[1] or kind in ("struct", "interface") else c.statement_end(m.end())
        start = m.start(1) if m[1] else m.start(3)
        out.append((kind, _text(m[4]), m.start(4), m.end(4), start, end, (*scope, *((_text(m[2]),) if m[2] else ()))))
    return sorted(out, key=lambda x: x[4])


def _typescript_facts(c: _Code) -> list[tuple]:
    out, modules, bodies = [], set(), {}

    def body(position: int) -> int:
        """The number of the block's bracket that follows a head."""
        k = bisect_left(c.at, position)
        while k < len(c.at) and c.char[k] in _CLOSE and c.char[k] != ord("{") and c.mate[k] >= 0:
            k = c.mate[k] + 1
        return k if k < len(c.at) and c.char[k] == ord("{") else -2

    def module_level(position: int) -> bool:
        k = c.inside(position)
        return k < 0 or k in modules

    for m in re.finditer(_DECLARATIONS["typescript"], c.code):
        word, name = re.sub(rb"[\s*]", b"", m[1]), re.sub(rb"\s", b"", m[2])
        kind = "variable" if word in (b"const", b"let", b"var") else _KINDS[word]
        if kind == "variable":
            if name == b"enum" or not module_level(m.start()):
                continue
            at, start = m.end(), m.start(2)
            end = c.statement_end(at)
            while True:  # declarators after commas
                k, comma = at, -1
                while k < end:
                    n = bisect_left(c.at, k)
                    stop = min(c.at[n] if n < len(c.at) else end, end)
                    comma = c.code.find(b",", k, stop)
                    if comma >= 0 or stop >= end or c.char[n] not in _CLOSE or c.mate[n] < 0:
                        break
                    k = c.at[c.mate[n]] + 1
                out.append((kind, _text(name), start, start + len(name), start, comma if comma >= 0 else end, ()))
                more = re.compile(rb"\s*(" + _NAME + rb")\s*(?=[:=,;\n]|$)").match(c.code, comma + 1, end) if comma >= 0 else None
                if more is None:
                    break
                name, start, at = more[1], more.start(1), more.end(1)
            continue
        if kind == "type_alias" and not re.match(rb"\s*(?:<[^=]*>)?\s*=", c.code[m.end() : m.end() + 300]):
            continue
        if kind == "module" and (b"{" not in c.code[m.end() : m.end() + 3] or not module_level(m.start())):
            continue
        if kind == "module":
            modules.add(body(m.end()))
        if kind in ("class", "interface"):
            bodies[body(m.end())] = kind
        end = c.statement_end(m.end()) if kind == "type_alias" else c.end_of(m.end())
        if kind == "function" and (k := body(m.end())) >= 0 and c.at[k] > c.statement_end(m.end()):
            end = c.statement_end(m.end())  # a signature without a block
        out.append((kind, _text(name), m.start(2), m.end(2), m.start(), end, ()))
    for m in re.finditer(rb"(?<![\w$.])(#?" + _NAME + rb")\??\s*(?:<[^<>()]*>\s*)?\(", c.code):
        k = bisect_left(c.at, m.end() - 1)
        if m[1] in _KEYWORDS or c.mate[k] < 0:
            continue
        begin = max(c.code.rfind(x, 0, m.start()) for x in (b";", b"{", b"}", b"\n", b",")) + 1
        modifiers = _MODIFIERS.fullmatch(c.code, begin, m.start())
        close = c.at[c.mate[k]]
        rest = re.compile(rb"\s*(:[^;{}=]*?(?:\{[^{}]*\}[^;{}=]*?)??)?([ \t]*\{|\s*[;,}]|\s*\n|$)").match(c.code, close + 1)
        if modifiers is None or rest is None:
            continue
        kind = bodies.get(c.inside(m.start()))
        block = rest[2].endswith(b"{")
        if block or kind:
            end = c.at[c.mate[n]] + 1 if block and (n := bisect_left(c.at, rest.end() - 1)) < len(c.at) and c.mate[n] >= 0 else rest.start(2)
            start = begin + len(c.code[begin : m.start()]) - len(c.code[begin : m.start()].lstrip())
            out.append(("method", _text(m[1]), m.start(1), m.end(1), start, end, ()))
    return sorted(out, key=lambda x: (x[4], -x[5]))


def _rust_sites(c: _Code, heads: set[int]) -> list[tuple]:
    code, sites, quiet = c.code, [], []
    for m in re.finditer(rb"\buse\s+([^;]+);", code):
        sites.append(("import", _text(m[1]).strip(), *m.span(1), DIRECT))
        quiet.append(m.span())
    for m in re.finditer(rb"\b(" + _NAME + rb"(?:::" + _NAME + rb")*)!\s*(?=[({\[])", code):
        if m[1] != b"macro_rules":
            sites.append(("macro_call", _text(m[1]), *m.span(1), DIRECT))
        k = bisect_left(c.at, m.end())
        quiet.append((m.start(), c.at[c.mate[k]] if k < len(c.at) and c.mate[k] >= 0 else len(code)))
    for m in re.finditer(rb"#!?\[", code):
        k = bisect_left(c.at, m.end() - 1)
        stop = c.at[c.mate[k]] + 1 if c.mate[k] >= 0 else len(code)
        quiet.append((m.start(), stop))
        inner = code[m.end() : stop - 1]
        if (t := re.match(rb"\s*((?:\w+::)*test)\s*(?:\(|$)", inner)) is not None:
            sites.append(("test_marker", _text(t[1]), m.end() + t.start(1), m.end() + t.end(1), DIRECT))
        elif re.match(rb"\s*cfg(?:_attr)?\s*\(", inner):
            sites += [("test_marker", "test", m.end() + t.start(), m.end() + t.end(), HEURISTIC) for t in re.finditer(rb"\btest\b", inner)]
    quiet += [m.span() for m in re.finditer(rb"\bpub\s*\([^)]*\)|\blet\s+(?:mut\s+)?[^:=;]*", code)]
    spans = []
    for s, e in sorted(quiet):
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
        else:
            spans.append((s, e))
    starts = [s for s, _ in spans]
    path = rb"(?:" + _NAME + rb"::|::)*" + _NAME + rb"(?:::<[^>()]*>)?(?:\s*\.\s*" + _NAME + rb")*"
    for m in re.finditer(rb"(?<![\w.'$!#])(" + path + rb")(\s*[(!]|\s*:(?!:))?", code):
        k = bisect_right(starts, m.start()) - 1
        if (k >= 0 and m.start() < spans[k][1]) or m.start() in heads or m[2] or m[1] in _RUST_WORDS or m[1].startswith(b"$"):
            continue
        sites.append(("reference", _text(m[1]), *m.span(1), HEURISTIC))
    return sites


#: Words of the language that are no names.
_RUST_WORDS = {w.encode() for w in "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self static struct super trait true type union unsafe use where while bool char str i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 _".split()}


def _calls(c: _Code, heads: set[int], quiet: list[tuple[int, int]]) -> Iterator[tuple]:
    """Calls outside of the spans ``quiet``, which don't overlap."""
    part, starts = rb"(?:::<[^>()]*>)?", [s for s, _ in quiet]
    for m in re.finditer(rb"(?<![\w$!])((?:" + _NAME + part + rb"(?:::|\??\.))*#?" + _NAME + part + rb")\s*\(", c.code):
        before = c.code[max(0, m.start() - 40) : m.start()].rstrip()
        k = bisect_right(starts, m.start()) - 1
        if k >= 0 and m.start() < quiet[k][1]:
            continue
        if m[1] not in _KEYWORDS and m.start() not in heads and not re.search(rb"\b(?:fn|func|function|function\s*\*)$", before) and not (c.language == "rust" and m[1] in _RUST_WORDS):
            yield ("call", _text(m[1]), *m.span(1), DIRECT)


def _braces(text: str, language: str) -> Found:
    """A scanner, not a parser: declarations by keyword, their ends by matching brackets, nesting by their spans. Time grows
    with the file's length. Brackets without their other half count as errors."""
    raw = text.encode()
    c = _Code(raw, "typescript" if language == "tsx" else language)
    found = {"rust": _rust_facts, "go": _go_facts, "typescript": _typescript_facts}[c.language](c)
    heads = {f[2] for f in found if f[0] != "impl"}
    facts, open_ = [], []
    for kind, name, ns, ne, start, end, scope in found:
        while open_ and open_[-1][1] <= start:
            open_.pop()
        path = [*scope, *(o[0] for o in open_), name] if c.language != "go" else [*scope, name]
        if c.language == "rust" and kind == "function":
            around = next((o[2] for o in reversed(open_) if o[2] in ("function", "method", "impl", "trait")), "")
            kind = "method" if around in ("impl", "trait") else kind
        if kind != "impl":
            facts.append((kind, name, "::".join(path), ns, ne, start, end))
        open_.append((name, end, kind))
    quiet = []  # where nothing is called: attributes, and heads of an interface's methods
    if c.language == "rust":
        sites = _rust_sites(c, heads)
        quiet = [(c.at[k], c.at[c.mate[k]]) for k in range(len(c.at)) if c.char[k] == ord("[") and c.mate[k] >= 0 and re.search(rb"#!?$", c.code[max(0, c.at[k] - 2) : c.at[k]])]
    elif c.language == "go":
        quiet = [(f[4], f[5]) for f in found if f[0] == "interface"]
        sites = [("import", _text(m[1]), *m.span(1), DIRECT) for m in re.finditer(rb'^\s*(?:import\s+)?(?:\w+\s+|\.\s+)?"([^"\n]+)"\s*;?\s*$', raw, re.M)]
    else:
        sites = [("import", _text(m[1]), *m.span(1), DIRECT) for m in re.finditer(rb"\bimport\b[^;\"'\n(]*[\"']([^\"'\n]+)[\"']", raw)]
    sites = sorted([*sites, *_calls(c, heads, quiet)], key=lambda x: (x[2], x[3]))
    out, at, open_ = [], 0, []
    starts = [f[5] for f in facts]
    for kind, target, s, e, evidence in sites:
        while at < len(facts) and facts[at][5] <= s:
            while open_ and facts[open_[-1]][6] <= facts[at][5]:
                open_.pop()
            open_.append(at)
            at += 1
        while open_ and facts[open_[-1]][6] <= s:
            open_.pop()
        if kind == "test_marker" and at < len(facts):  # what it is put on
            k = bisect_left(starts, e)
            between = re.sub(rb"#!?\[[^\]]*\]|\bpub(?:\s*\([^)]*\))?|\basync\b|\bunsafe\b|[\s\])]", b"", c.code[e : facts[k][5]]) if k < len(facts) else b"x"
            best = facts[k] if not between else None
        else:
            best = next((facts[k] for k in reversed(open_) if facts[k][6] >= e and not facts[k][3] <= s < facts[k][4]), None)
        out.append((kind, target, s, e, best and best[2], best and best[0], evidence))
    return Found(facts, out, c.errors)


def extract(text: str | None, language: str | None) -> Found:
    if not text or language not in SUPPORT:
        return Found()
    return _python(text) if language == "python" else _braces(text, language)


def analyses(files: DataFrame) -> DataFrame:
    """(path, content_digest, language, facts, sites, errors) of files (path, content_digest, language, content): each is parsed once."""
    source = files.where(F.col("language").isNotNull()).select("path", "content_digest", "language", F.col("content").cast("string").alias("text"))
    columns = {"facts": [x.split()[0] for x in _FACT.split(", ")], "sites": [x.split()[0] for x in _SITE.split(", ")]}

    def kind(ddl: str) -> pa.DataType:
        return pa.list_(pa.struct([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in ddl.split(", "))]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                b = whole.slice(i, 64)
                got = [extract(t, lang) for t, lang in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)]
                lists = [pa.array([[dict(zip(names, x, strict=True)) for x in getattr(g, what)] for g in got], kind(ddl)) for (what, names), ddl in zip(columns.items(), (_FACT, _SITE), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *lists, pa.array([g.errors for g in got], pa.int64())], names=["path", "content_digest", "language", "facts", "sites", "errors"])

    nested = lambda ddl: T.ArrayType(T.StructType([T.StructField(n, T.StringType() if t == "string" else T.LongType()) for n, t in (x.split() for x in ddl.split(", "))]))
    schema = T.StructType([*source.schema.fields[:3], T.StructField("facts", nested(_FACT)), T.StructField("sites", nested(_SITE)), T.StructField("errors", T.LongType())])
    return source.mapInArrow(run, schema)


def facts(analysed: DataFrame) -> DataFrame:
    """Declarations of files, or of their ``analyses``, numbered in order of place."""
    analysed = analysed if "facts" in analysed.columns else analyses(analysed)
    return analysed.select("path", "content_digest", "language", F.posexplode("facts").alias("ordinal", "f")).select("path", "content_digest", "language", "ordinal", "f.*")


def sites(analysed: DataFrame) -> DataFrame:
    """Imports, references, calls, macro calls and test markers, each with the declaration around it."""
    analysed = analysed if "sites" in analysed.columns else analyses(analysed)
    return analysed.select("path", "content_digest", "language", F.posexplode("sites").alias("ordinal", "s")).select("path", "content_digest", "language", "ordinal", "s.*")


def errors(analysed: DataFrame) -> DataFrame:
    """(path, errors) of the files that an extractor could not parse in part or whole."""
    analysed = analysed if "errors" in analysed.columns else analyses(analysed)
    return analysed.where("errors > 0").select("path", "errors")


def name_elided_digests(facts_: DataFrame, files: DataFrame) -> DataFrame:
    """Adds declaration and name_elided digests: of a declaration's bytes, and of those without its name."""
    j = facts_.join(files.select("path", "content"), "path")
    part = lambda a, b: F.substring(F.col("content"), (a + 1).cast("int"), (b - a).cast("int"))
    whole = part(F.col("decl_start"), F.col("decl_end"))
    elided = F.concat(part(F.col("decl_start"), F.col("name_start")), F.lit(b"\x00"), part(F.col("name_end"), F.col("decl_end")))
    return j.withColumns({"declaration": F.sha2(whole, 256), "name_elided": F.sha2(elided, 256)}).drop("content")
