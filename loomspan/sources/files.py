"""File sources: discovery, contained reads, package scopes, and the facts of their languages."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import in_packages, language_of


def git_paths(spark: SparkSession, root: str, *, cached: bool = False, max_paths: int = 1_000_000, timeout: float = 60) -> DataFrame:
    """Tracked (and, unless ``cached``, untracked but not ignored) paths of a local repository, in byte order."""
    args = ["git", "-C", root, "ls-files", "-z", "--cached", *([] if cached else ["--others", "--exclude-standard"])]
    env = {"PATH": "/usr/bin:/bin:/usr/local/bin", "GIT_OPTIONAL_LOCKS": "0", "LC_ALL": "C", "HOME": "/nonexistent"}
    raw = subprocess.run(args, capture_output=True, env=env, timeout=timeout, check=True).stdout
    paths = sorted({p for p in raw.split(b"\0") if p})
    if len(paths) > max_paths:
        raise ValueError(f"over {max_paths} paths")
    return spark.createDataFrame([(p.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode(), bytearray(p)) for p in paths], "path string, path_bytes binary")


def is_repository(root: str) -> bool:
    return subprocess.run(["git", "-C", root, "rev-parse", "--git-dir"], capture_output=True, check=False, timeout=60).returncode == 0


def source_state(root: str, timeout: float = 60) -> dict[str, str]:
    """HEAD, object format, and digests of the index and of the status: the fence that a publication confirms."""
    import hashlib

    env = {"PATH": "/usr/bin:/bin:/usr/local/bin", "GIT_OPTIONAL_LOCKS": "0", "LC_ALL": "C", "HOME": "/nonexistent"}
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, env=env, timeout=timeout, check=False).stdout
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return {
        "head": run("rev-parse", "HEAD").decode().strip(),
        "object_format": run("rev-parse", "--show-object-format").decode().strip(),
        "shallow": run("rev-parse", "--is-shallow-repository").decode().strip(),
        "index_digest": digest(run("ls-files", "-s", "-z")),
        "status_digest": digest(run("status", "--porcelain=v2", "-z", "--untracked-files=all")),
    }


def resolve_selector(root: str, *, revision: str | None = None, ref: str | None = None, allowed: tuple[str, ...] = ("refs/heads/", "refs/tags/")) -> str | None:
    """The commit of an exact revision or an allowed ref; None selects the work tree."""
    if revision is None and ref is None:
        return None
    if ref is not None and not ref.startswith(allowed):
        raise ValueError("the ref isn't allowed")
    if revision is not None and (len(revision) not in (40, 64) or set(revision) - set("0123456789abcdef")):
        raise ValueError("a revision is a full object id")
    out = subprocess.run(["git", "-C", root, "rev-parse", "--verify", f"{ref or revision}^{{commit}}"], capture_output=True, check=True, timeout=60)
    return out.stdout.decode().strip()


def git_commits(spark: SparkSession, root: str, max_commits: int = 1_000_000) -> DataFrame:
    """(commit, parent, at_ms) of reachable history, a row a parent (null for the first); more than ``max_commits`` are an error."""
    raw = subprocess.run(["git", "-C", root, "log", f"-{max_commits + 1}", "--format=%H %ct %P"], capture_output=True, check=True, timeout=120).stdout.decode()
    if raw.count("\n") > max_commits:
        raise ValueError(f"over {max_commits} commits")
    rows = [(c, p, int(t) * 1000) for line in raw.splitlines() for c, t, *ps in [line.split(" ")] for p in ([x for x in ps if x] or [None])]
    return spark.createDataFrame(rows, "commit string, parent string, at_ms long")


def _files(spark: SparkSession, root: str, packages: list[str] | None, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    base = root if "://" in root else Path(root).resolve().as_uri()
    # What is listed has decoded paths and one or three slashes after the scheme.
    base = re.sub(r"^(\w+):/+(?=[^/])", r"\1:/", unquote(base)).rstrip("/") + "/" if base.startswith("file:") else unquote(base).rstrip("/") + "/"
    listed = F.regexp_replace(F.col("path"), "^file:/+", "file:/")
    path = F.when(listed.startswith(base), F.substr(listed, F.lit(len(base) + 1))).otherwise(F.raise_error(F.concat(F.lit("outside of the root: "), listed)))
    out = files.withColumn("path", path)
    return out.where(in_packages(F.col("path"), packages) & ~F.col("path").startswith(".git/"))


def read_tree(spark: SparkSession, root: str, *, max_bytes: int = 8 << 20, packages: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """(path, content, content_digest, size, language) of files under a folder, with any Hadoop file system; what lies elsewhere
    is an error. Files over ``max_bytes`` are left out by their listed length, before a read; ``omitted_files`` names them."""
    files = _files(spark, root, packages, glob).where(F.col("length") <= max_bytes)
    out = files.select("path", "content", F.sha2("content", 256).alias("content_digest"), F.col("length").alias("size"))
    return out.withColumn("language", language_of(F.col("path")))


def omitted_files(spark: SparkSession, root: str, *, max_bytes: int = 8 << 20, packages: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """(path, size, reason) of the files that ``read_tree`` leaves out."""
    files = _files(spark, root, packages, glob).where(F.col("length") > max_bytes)
    return files.select("path", F.col("length").alias("size"), F.lit("over_max_bytes").alias("reason"))


def read_contained(root: str, path: str, max_bytes: int = 8 << 20) -> tuple[bytes, str]:
    """(content, digest) of one regular file under a local root. Symbolic links, files of several names, files over ``max_bytes`` and
    files that change while they are read are errors: nothing outside of the root is read, and nothing half written."""
    import hashlib
    import os
    import stat

    at, parts = Path(root).resolve(), Path(path).parts
    if not parts or Path(path).is_absolute() or ".." in parts:
        raise ValueError("a path below the root")
    folder = os.open(at, os.O_RDONLY | os.O_DIRECTORY)
    try:
        for part in parts[:-1]:
            inner = os.open(part, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=folder)
            os.close(folder)
            folder = inner
        try:
            f = os.open(parts[-1], os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK, dir_fd=folder)
        except OSError as e:
            raise ValueError(f"no regular file: {path}") from e
    except NotADirectoryError as e:
        raise ValueError(f"a link in the path: {path}") from e
    finally:
        os.close(folder)
    before = os.fstat(f)
    if not stat.S_ISREG(before.st_mode) or before.st_nlink != 1:
        os.close(f)
        raise ValueError(f"no regular file of one name: {path}")
    with os.fdopen(f, "rb") as file:
        raw = file.read(max_bytes + 1)
        after = os.fstat(file.fileno())
    if len(raw) > max_bytes:
        raise ValueError(f"over {max_bytes} bytes: {path}")
    if (before.st_size, before.st_mtime_ns, before.st_ino) != (after.st_size, after.st_mtime_ns, after.st_ino) or len(raw) != after.st_size:
        raise ValueError(f"changed while it was read: {path}")
    return raw, hashlib.sha256(raw).hexdigest()


def workspace_manifest(spark: SparkSession, manifest: dict) -> DataFrame:
    """(slot, root, revision) of an explicit connected-workspace manifest: unique slots, at most 64."""
    slots = manifest.get("slots", [])
    if not 1 <= len(slots) <= 64 or len({s["slot"] for s in slots}) != len(slots):
        raise ValueError("1 to 64 slots with names of their own")
    return spark.createDataFrame([(s["slot"], s["root"], s.get("revision")) for s in slots], "slot string, root string, revision string")


#: Settings by name: their type, and how a later layer may change them. ``least`` and ``all`` tighten, ``common`` intersects, ``last`` is no policy.
SETTINGS = {
    "max_bytes": (int, "least"),
    "max_paths": (int, "least"),
    "max_results": (int, "least"),
    "max_response_bytes": (int, "least"),
    "max_attempts": (int, "least"),
    "deadline_ms": (int, "least"),
    "poll_interval_ms": (int, "last"),
    "debounce_ms": (int, "last"),
    "keep_generations": (int, "last"),
    "allow_writes": (bool, "all"),
    "allow_untracked": (bool, "all"),
    "allow_refs": (list, "common"),
    "languages": (list, "common"),
    "packages": (list, "last"),
    "pins": (list, "last"),
}


def resolve_configuration(*layers: dict) -> dict:
    """Layers in order user, workspace, repository: later ones may only tighten. Numbers take the least, booleans that allow
    something the conjunction, lists of allowed values the intersection; what is no policy is replaced. Unknown keys,
    other types and numbers below 1 are errors."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            kind, rule = SETTINGS.get(k, (None, ""))
            if kind is None or type(v) is not kind or (kind is int and v < 1):
                raise ValueError(f"unknown or mistyped setting {k}")
            if kind is list and not all(isinstance(x, str) for x in v):
                raise ValueError(f"{k} is a list of strings")
            if k not in out or rule == "last":
                out[k] = v
            else:
                out[k] = (out[k] and v) if rule == "all" else min(out[k], v) if rule == "least" else [x for x in out[k] if x in v]
    return out


def load_configuration(*paths: str) -> dict:
    import tomllib

    return resolve_configuration(*[tomllib.loads(Path(p).read_text()) for p in paths])
