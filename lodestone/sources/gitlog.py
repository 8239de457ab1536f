"""Commit history as tables: format("gitlog") runs git once for names and once for numbers, and joins them."""

from __future__ import annotations

import subprocess
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "full_hash string, short_hash string, author_name string, author_email string, author_date timestamp, author_date_raw string, parents array<string>, subject string, "
    "is_merge boolean, seq bigint, changes array<struct<status string, path string, old_path string, additions bigint, deletions bigint, is_binary boolean>>"
)
MARK = "\x1e"
FORMAT = MARK + "%H%x1f%h%x1f%an%x1f%ae%x1f%aI%x1f%P%x1f%s%x1f"


class GitError(RuntimeError):
    pass


class GitParsingError(GitError):
    pass


def run_git(root: str, *args: str, timeout: int = 30) -> bytes:
    """git with an argument list, never a shell."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=timeout, check=False)
    except FileNotFoundError as e:
        raise GitError("git is not installed") from e
    except subprocess.TimeoutExpired as e:
        raise GitError(f"git took more than {timeout} s") from e
    if done.returncode:
        raise GitError(done.stderr.decode(errors="replace").replace(root, "<repository>").strip()[:500])
    return done.stdout


def status(root: str) -> dict:
    """Whether a folder is a repository, empty, shallow, detached, and its head."""
    out = {"is_git_repo": False, "git_root": None, "is_empty": False, "is_shallow": False, "is_detached": False, "head_commit": None, "error": None}
    try:
        out["git_root"] = run_git(root, "rev-parse", "--show-toplevel").decode().strip()
        out["is_git_repo"] = True
        out["is_shallow"] = run_git(root, "rev-parse", "--is-shallow-repository").strip() == b"true"
        try:
            out["head_commit"] = run_git(root, "rev-parse", "--verify", "HEAD").decode().strip()
            out["is_detached"] = run_git(root, "rev-parse", "--abbrev-ref", "HEAD").strip() == b"HEAD"
        except GitError:
            out["is_empty"] = True
    except GitError as e:
        out["error"] = str(e)
    return out


def decode_path(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode("utf-8")


def parse_numstat(tokens: list[bytes]) -> dict[tuple[str | None, str], tuple[int, int, bool]]:
    """(old path, path) -> (added, deleted, binary) of one commit."""
    out, i = {}, 0
    while i < len(tokens):
        token = tokens[i].lstrip(b"\n")
        i += 1
        if not token:
            continue
        parts = token.split(b"\t", 2)
        if len(parts) != 3:
            raise GitParsingError("cut off in the numbers")
        a, d, path = parts
        old = None
        if not path:
            if i + 1 >= len(tokens):
                raise GitParsingError("cut off in a rename")
            old, path = decode_path(tokens[i]), tokens[i + 1]
            i += 2
        out[old, decode_path(path)] = (0, 0, True) if a == b"-" else (int(a), int(d), False)
    return out


def parse_names(tokens: list[bytes]) -> list[tuple[str, str | None, str]]:
    """(status, old path, path) of one commit."""
    out, i = [], 0
    while i < len(tokens):
        s = tokens[i].strip().decode()
        i += 1
        if not s:
            continue
        need = 2 if s[0] in "RC" else 1
        if i + need > len(tokens):
            raise GitParsingError("cut off in the names")
        paths = [decode_path(x) for x in tokens[i : i + need]]
        i += need
        out.append((s[0], paths[0] if need == 2 else None, paths[-1]))
    return out


def _commits(data: bytes):
    for block in data.split(MARK.encode())[1:]:
        *fields, rest = block.split(b"\x1f", 7)
        if len(fields) != 7:
            raise GitParsingError("cut off in a commit")
        yield [f.decode("utf-8", "replace") for f in fields], [t for t in rest.split(b"\0")]


def mine(root: str, max_commits: int = 1000, include_merges: bool = False, path: str | None = None, since: str | None = None, author: str | None = None):
    """Rows of SCHEMA, newest first."""
    args = ["log", "-z", f"--max-count={int(max_commits)}", f"--format={FORMAT}", "-M"]
    args += [] if include_merges else ["--no-merges"]
    args += [f"--since={since}"] if since else []
    args += [f"--author={author}"] if author else []
    tail = ["--", path] if path else []
    numbers = {f[0]: parse_numstat(t) for f, t in _commits(run_git(root, *args, "--numstat", *tail, timeout=120))}
    for seq, (f, tokens) in enumerate(_commits(run_git(root, *args, "--name-status", *tail, timeout=120))):
        changes, known = [], numbers.get(f[0], {})
        for s, old, new in parse_names(tokens):
            if (old, new) not in known:
                raise GitParsingError(f"no numbers for a change of {f[1]}")
            a, d, binary = known[old, new]
            changes.append((s, new, old, a, d, binary))
        try:
            when = datetime.fromisoformat(f[4])
        except ValueError:
            when = datetime.now(timezone.utc)
        parents = f[5].split()
        yield f[0], f[1], f[2], f[3], when, f[4], parents, f[6], len(parents) > 1, seq, changes


class GitLogSource(DataSource):
    """format("gitlog"): one task, as git itself walks the history."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(dict(self.options))


class GitLogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        o = self.options
        yield from mine(o["path"], int(o.get("maxcommits", 1000)), o.get("includemerges", "false") == "true", o.get("file"), o.get("since"), o.get("author"))


def read_history(spark: SparkSession, root: str, **options) -> tuple[DataFrame, DataFrame]:
    """(commits, changes)."""
    spark.dataSource.register(GitLogSource)
    log = spark.read.format("gitlog").option("path", root)
    for k, v in options.items():
        log = log.option(k, v)
    log = log.load()
    return log.drop("changes"), log.select("full_hash", "seq", F.explode("changes").alias("c")).select("full_hash", "seq", "c.*")
