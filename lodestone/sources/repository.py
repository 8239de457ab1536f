"""Source trees as tables: directories and ZIP archives, filtered with reasons, decoded, with checksums."""

from __future__ import annotations

import os
import re
import subprocess
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Names of folders that are left out, patterns of files, extensions without text, and languages by extension.
IGNORED_DIRECTORIES = (
    ".git", ".svn", ".hg", ".bzr", "node_modules", "venv", ".venv", "env", ".env", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "dist", "build",
    "eggs", ".eggs", "*.egg-info", ".tox", ".nox", ".idea", ".vscode", ".history", ".cache", "coverage", "htmlcov", "site-packages",
)
IGNORED_PATTERNS = (
    "*.pyc", "*.pyo", "*.pyd", "*.so", "*.dll", "*.dylib", "*.exe", "*.bin", "*.db", "*.sqlite", "*.sqlite3", "*.log", "*.tmp", "*.bak", "*.swp", "*.DS_Store",
    "Thumbs.db", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "*.min.js", "*.min.css", "*.map",
)
BINARY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".webp", ".bmp", ".tiff", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".tar", ".gz", ".7z",
    ".rar", ".bz2", ".xz", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".mkv", ".ttf", ".otf", ".woff", ".woff2", ".eot", ".exe", ".dll", ".so", ".dylib", ".bin", ".iso",
    ".img", ".pyc", ".class", ".o", ".obj", ".pkl", ".pickle", ".parquet", ".feather", ".npy", ".npz", ".db", ".sqlite", ".sqlite3",
)
LANGUAGES = {
    ".py": "python", ".pyw": "python", ".md": "markdown", ".markdown": "markdown", ".rst": "restructuredtext", ".txt": "text", ".json": "json", ".yaml": "yaml",
    ".yml": "yaml", ".toml": "toml", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".html": "html", ".htm": "html",
    ".css": "css", ".scss": "scss", ".sql": "sql", ".sh": "shell", ".bash": "shell", ".ps1": "powershell", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp",
    ".java": "java", ".go": "go", ".rs": "rust",
}
MAX_FILE_BYTES = 5 * 1024 * 1024
RAW = "relative_path string, file_size bigint, content binary"


def _pattern(globs: tuple[str, ...]) -> str:
    return "^(?:" + "|".join(re.escape(g).replace(r"\*", ".*") for g in globs) + ")$"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def language(path: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), extension(path)), F.lit("unknown"))


def looks_binary(content: Column) -> Column:
    """A NUL byte, or over 30 % of bytes that no text has, in the first 2,048."""
    head = F.hex(F.substring(content, 1, 2048))
    odd = F.length(F.regexp_replace(head, r"(?:0[789AaBbCcDd]|1[bB]|[2-7][0-9A-Ea-e]|[2-6][Ff]|[89A-Fa-f][0-9A-Fa-f])|(..)", "$1"))
    return head.rlike(r"^(?:..)*?00") | (odd > 0.3 * F.length(head))


def in_ignored_directory(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.rlike(_pattern(IGNORED_DIRECTORIES)))


def skip_reason(path: Column, size: Column, content: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """Why a file is left out: the first reason in this order, NULL where it stays."""
    name = F.element_at(F.split(path, "/"), -1)
    return (
        F.when(in_ignored_directory(path), "ignored directory")
        .when(name.rlike(_pattern(IGNORED_PATTERNS)), "ignored pattern")
        .when(extension(path).isin(*BINARY_EXTENSIONS), "binary extension")
        .when(size > max_bytes, "too large")
        .when(size == 0, "empty")
        .when((language(path) == "unknown") & looks_binary(content), "binary content")
    )


def raw_directory(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder of any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z]+:/*", "", root).strip("/") + "/"
    path = F.regexp_replace("path", r"^[a-z]+:/*", "")
    return files.select(F.regexp_replace(path, rf"^.*?\Q{base}\E", "").alias("relative_path"), F.col("length").alias("file_size"), "content")


class ZipSource(DataSource):
    """format("repository_zip"): the members of an archive, read by several tasks."""

    @classmethod
    def name(cls) -> str:
        return "repository_zip"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options["path"], int(self.options.get("partitions", "4")))


class Part(InputPartition):
    def __init__(self, value: int):
        super().__init__(value)


class ZipReader(DataSourceReader):
    def __init__(self, path: str, partitions: int):
        self.path, self.n = path, partitions

    def partitions(self):
        return [Part(i) for i in range(self.n)]

    def read(self, partition):
        import zipfile

        with zipfile.ZipFile(self.path) as z:
            members = [m for m in z.infolist() if not m.is_dir() and ".." not in m.filename.split("/")]
            for m in members[partition.value :: self.n]:
                yield m.filename.lstrip("/"), m.file_size, z.read(m)


def decoded(content: Column) -> Column:
    """UTF-8 without its mark, or Latin-1 where the bytes are no UTF-8."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


#: What ends a line for Python's splitlines.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def line_count(text: Column) -> Column:
    lines = F.split(text, LINE_END)
    return F.when(text == "", 0).otherwise(F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)).cast("long")


def repository(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, skipped) of raw files; checksums are over the raw bytes."""
    path = F.replace(F.col("relative_path"), F.lit("\\"), F.lit("/"))
    judged = raw.select(path.alias("relative_path"), "file_size", "content").withColumn("reason", skip_reason(F.col("relative_path"), F.col("file_size"), F.col("content")))
    files = judged.where("reason is null").select(
        "relative_path", F.element_at(F.split("relative_path", "/"), -1).alias("file_name"), extension(F.col("relative_path")).alias("extension"), language(F.col("relative_path")).alias("language"),
        "file_size", decoded(F.col("content")).alias("content"), F.sha2("content", 256).alias("checksum"),
    )
    files = files.withColumn("line_count", line_count(F.col("content"))).withColumn("is_python", F.col("language") == "python").withColumn("is_documentation", F.col("language").isin("markdown", "restructuredtext", "text"))
    # Files of ignored folders are never entered, so they are no skipped files either.
    return files, judged.where("reason is not null and reason <> 'ignored directory'").select(F.col("relative_path").alias("path"), "reason")


def load_repository(spark: SparkSession, source: str, timeout: int = 120) -> tuple[DataFrame, DataFrame]:
    """A git address is cloned, a .zip read, a folder scanned."""
    if re.match(r"https?://|git@", source):
        folder = tempfile.mkdtemp()
        subprocess.run(["git", "clone", "--depth", "1", "--", source, folder], check=True, timeout=timeout, capture_output=True)
        return repository(raw_directory(spark, folder))
    if source.endswith(".zip"):
        if not os.path.exists(source):
            raise FileNotFoundError(source)
        spark.dataSource.register(ZipSource)
        return repository(spark.read.format("repository_zip").option("path", source).load())
    if "://" not in source and not os.path.exists(source):
        raise FileNotFoundError(source)
    if "://" not in source and not os.path.isdir(source):
        raise NotADirectoryError(source)
    return repository(raw_directory(spark, source))


def language_breakdown(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.sum("file_size").alias("bytes"))


def safe_slice(files: DataFrame, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """(line, text) of a file's lines start to end, from 1; a path that leaves the tree is an error, an end behind the last line is cut."""
    clean = path.replace("\\", "/")
    if clean.startswith("/") or ".." in clean.split("/"):
        raise ValueError(f"path leaves the repository: {path}")
    if start is not None and (start < 1 or (end is not None and end < start)):
        raise ValueError(f"no such lines: {start}-{end}")
    rows = files.where(F.col("relative_path") == clean).select(F.posexplode(F.split("content", LINE_END)).alias("line", "text"), "line_count")
    rows = rows.select((F.col("line") + 1).alias("line"), "text", "line_count").where(F.col("line") <= F.col("line_count"))
    return rows.where(F.col("line").between(start or 1, end or 2**31 - 1)).select("line", "text")


def load_env(path: str) -> dict[str, str]:
    """Sets what a .env file names and the environment lacks."""
    added = {}
    if os.path.exists(path):
        with open(path) as f:
            for line in f:
                line = line.strip()
                if line and not line.startswith("#") and "=" in line:
                    key, _, value = line.removeprefix("export ").partition("=")
                    key, value = key.strip(), value.strip().strip("'\"")
                    if key and key not in os.environ:
                        os.environ[key] = added[key] = value
    return added


def dependency_names(folder: str) -> set[str]:
    """Normalised names from requirements files, pyproject.toml and the literal lists of setup.py."""
    import ast
    import tomllib

    found: list[str] = []
    for name in ("requirements.txt", "requirements-dev.txt", "requirements_dev.txt"):
        if os.path.exists(p := os.path.join(folder, name)):
            found += [x for x in map(str.strip, open(p)) if x and not x.startswith(("#", "-"))]  # noqa: SIM115
    if os.path.exists(p := os.path.join(folder, "pyproject.toml")):
        with open(p, "rb") as f:
            data = tomllib.load(f)
        project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
        found += project.get("dependencies", []) + [x for v in project.get("optional-dependencies", {}).values() for x in v]
        groups = [poetry.get("dependencies", {}), poetry.get("dev-dependencies", {}), *(g.get("dependencies", {}) for g in poetry.get("group", {}).values())]
        found += [k for g in groups for k in g if k.lower() != "python"]
    if os.path.exists(p := os.path.join(folder, "setup.py")):
        with open(p) as f:
            tree = ast.parse(f.read())
        for node in ast.walk(tree):
            if isinstance(node, ast.keyword) and node.arg in ("install_requires", "tests_require", "setup_requires"):
                found += [c.value for c in ast.walk(node.value) if isinstance(c, ast.Constant) and isinstance(c.value, str)]
    return {normalized(x) for x in found} - {""}


def normalized(requirement: str) -> str:
    m = re.match(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)", re.split("[#;]", requirement)[0])
    return re.sub(r"[-_.]+", "-", m[1]).lower() if m else ""
