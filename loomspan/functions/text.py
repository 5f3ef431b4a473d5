"""Column functions: identifiers, paths, query terms. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: File endings by language, and files by topology category in order of precedence.
LANGUAGES = {"rust": (".rs",), "go": (".go",), "tsx": (".tsx",), "typescript": (".ts", ".mts", ".cts"), "python": (".py",)}
TOPOLOGY = (
    ("agent_instruction", ("AGENTS.md", "CLAUDE.md", "GEMINI.md", ".cursorrules")),
    ("build", ("Makefile", "GNUmakefile", "build.rs", "justfile", "Taskfile.yml", "Taskfile.yaml")),
    ("package", ("Cargo.toml", "Cargo.lock", "go.mod", "go.sum", "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "pyproject.toml", "poetry.lock", "requirements.txt")),
    ("configuration", (".gitignore", ".gitattributes", ".editorconfig", "rust-toolchain.toml", "rustfmt.toml", "clippy.toml", "deny.toml", ".cargo/config.toml")),
)
MAX_QUERY_BYTES, MAX_TERMS, MAX_TERM_BYTES = 256, 8, 64


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, unlike ``lower``."""
    return F.translate(c, _UPPER, _LOWER)


def tokens(c: Column) -> Column:
    """Search tokens: runs of letters, digits and underscores, case folded."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def query_terms(query: str) -> list[str]:
    """White-space terms of a query, within the limits of queries."""
    if len(query.encode()) > MAX_QUERY_BYTES or any(ord(x) < 32 and x not in "\t\n\r" for x in query):
        raise ValueError(f"a query has at most {MAX_QUERY_BYTES} bytes and no control characters")
    terms = query.split()
    if not 1 <= len(terms) <= MAX_TERMS or any(len(t.encode()) > MAX_TERM_BYTES for t in terms):
        raise ValueError(f"a query has 1 to {MAX_TERMS} terms of at most {MAX_TERM_BYTES} bytes")
    return terms


def query_digest(terms: list[str]) -> str:
    """A digest of the terms in which no two term lists run together."""
    h = hashlib.sha256(b"loomspan.query.v1")
    for t in terms:
        raw = t.encode()
        h.update(len(raw).to_bytes(8, "big") + raw)
    return h.hexdigest()


def language_of(path: Column) -> Column:
    """The language a path's ending tells; null for others."""
    ends = lambda s: [path.endswith(e) for e in s]
    out = None
    for lang, ending in LANGUAGES.items():
        test = ends(ending)[0]
        for t in ends(ending)[1:]:
            test = test | t
        out = F.when(test, F.lit(lang)) if out is None else out.when(test, F.lit(lang))
    return out


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def topology_category(path: Column) -> Column:
    """One of seven categories; the first that fits counts."""
    names = dict(TOPOLOGY)
    name = base_name(path)
    flow = path.startswith(".github/workflows/") & (path.endswith(".yml") | path.endswith(".yaml"))
    return (
        F.when(name.isin(*names["agent_instruction"]) | (path == ".github/copilot-instructions.md"), "agent_instruction")
        .when(flow, "workflow")
        .when(path.endswith(".md") | path.startswith("docs/"), "documentation")
        .when(name.isin(*names["build"]), "build")
        .when(name.isin(*names["package"]) | path.startswith("requirements/"), "package")
        .when(path.isin(*names["configuration"]) | path.startswith("config/"), "configuration")
        .otherwise("other")
    )


def top_directory(path: Column) -> Column:
    """The first path component; null for files at the root."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1))


def in_packages(path: Column, roots: list[str] | None) -> Column:
    """Whether a path is a package root or lies under one; all paths if no roots are given."""
    if not roots:
        return F.lit(True)
    if len(roots) > 64:
        raise ValueError("at most 64 package roots")
    out = F.lit(False)
    for r in roots:
        out = out | (path == r) | path.startswith(r.rstrip("/") + "/")
    return out


def encode_path(path: Column) -> Column:
    """A path of any bytes as printable text: a tag and hexadecimal digits."""
    return F.concat(F.lit("path:h:"), F.lower(F.hex(path.cast("binary"))))


def decode_path(text: Column) -> Column:
    return F.when(text.startswith("path:h:"), F.unhex(F.substr(text, F.lit(8))))


def container_of(qualified: Column) -> Column:
    """The part of a qualified name before its last ``::``; empty at the top."""
    return F.regexp_extract(qualified, r"^(.*)::[^:]*$", 1)


def strip_turbofish(target: Column) -> Column:
    """``f::<T>`` as ``f``: a generic argument list at the end, from the last ``::<`` on and with its brackets in balance, is no part of the name."""
    name, rest = (F.regexp_extract(target, r"(?s)\A(.+)::(<.*>)\z", k) for k in (1, 2))
    depth = F.aggregate(F.split(rest, ""), F.lit(0), lambda d, c: F.when(d < 0, d).when(c == "<", d + 1).when(c == ">", d - 1).otherwise(d))
    return F.when((rest != "") & (depth == 0), name).otherwise(target)


IDENTIFIER = r"(?:r#)?[A-Za-z_][A-Za-z0-9_]*"


def path_parts(target: Column) -> Column:
    """struct(path, same_slot, bare) of a path of ASCII identifiers, else null. ``crate::`` in front restricts to the same
    slot, ``::`` says nothing more; what is left is bare if it is one identifier. Paths from ``self`` and ``super`` are not told."""
    inner = F.regexp_replace(target, r"\A(?:crate)?::", "")
    ok = inner.rlike(rf"\A{IDENTIFIER}(?:::{IDENTIFIER})*\z") & ~target.rlike(r"\A(?:self|super)::")
    return F.when(ok, F.struct(inner.alias("path"), target.startswith("crate::").alias("same_slot"), (F.instr(inner, "::") == 0).alias("bare")))


def import_parts(raw: Column) -> Column:
    """struct(target, alias, same_slot) of ``path [as alias]``, else null. The alias is null where nothing is bound: for
    ``as _``, and for a path that ends in ``self``."""
    words = F.split(F.regexp_replace(raw, r"\A[ \t\n\f\r]+|[ \t\n\f\r]+\z", ""), r"[ \t\n\f\r]+")
    p, n, given = path_parts(words[0]), F.size(words), F.get(words, F.lit(2))
    last = F.element_at(F.split(p["path"], "::"), -1)
    named = (n == 3) & (F.get(words, F.lit(1)) == "as") & given.rlike(rf"\A{IDENTIFIER}\z")
    alias = F.when(n == 3, F.when(given != "_", given)).otherwise(F.when(last != "self", last))
    return F.when(p.isNotNull() & ((n == 1) | named), F.struct(p["path"].alias("target"), alias.alias("alias"), p["same_slot"].alias("same_slot")))
