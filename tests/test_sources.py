import os
import subprocess
import zipfile

import pytest

from lodestone.functions import code
from lodestone.operators import temporal as T
from lodestone.sources import gitlog
from lodestone.sources.repository import dependency_names, language_breakdown, load_repository, safe_slice

SOURCE = '''"""Doc."""
import os
from . import base


class Service(base.Base):
    """A service."""

    def run(self, items, *rest, flag=False, **more):
        for x in items:
            if x and flag:
                self.helper(x)
        return [y for y in items if y]

    def helper(self, x): return os.path.join(x)


async def main() -> None:
    def inner(a):
        return a if a else 1
    Service().run([])
'''


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    for name, data in {
        "README.md": b"Intro\n# One\ntext\n## Two\nmore\n# Three\nend\n",
        "src/main.py": SOURCE.encode(),
        "src/bad.py": b"def x(:\n",
        "src/latin.txt": "caf\xe9\r\nx".encode("latin-1"),
        "src/odd.xyz": b"\0\1\2binary",
        "src/plain.xyz": b"plain text\n",
        "empty.py": b"",
        "logo.png": b"\x89PNG",
        "node_modules/a.js": b"x",
        "a.min.js": b"x",
        "requirements.txt": b"Py_Spark>=4 # c\nfoo.bar[x]; python_version>'3'\n",
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return root


def test_directory_and_zip(spark, tree, tmp_path):
    files, skipped = load_repository(spark, str(tree))
    rows = {r.relative_path: r for r in files.collect()}
    assert set(rows) == {"README.md", "src/main.py", "src/bad.py", "src/latin.txt", "src/plain.xyz", "requirements.txt"}
    assert rows["src/latin.txt"].content == "caf\xe9\r\nx" and rows["src/latin.txt"].line_count == 2
    assert rows["src/plain.xyz"].language == "unknown" and rows["README.md"].line_count == 7
    assert {r.path: r.reason for r in skipped.collect()} == {"src/odd.xyz": "binary content", "logo.png": "binary extension", "a.min.js": "ignored pattern"}
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        for p in sorted(tree.rglob("*")):
            if p.is_file():
                z.write(p, p.relative_to(tree))
    again, left_out = load_repository(spark, str(tmp_path / "r.zip"))
    # Spark's file reader never lists files without bytes; the archive does.
    assert {r.path: r.reason for r in left_out.collect()}["empty.py"] == "empty"
    assert {r.relative_path: r.checksum for r in again.collect()} == {k: r.checksum for k, r in rows.items()}
    assert {r.language: r.files for r in language_breakdown(files).collect()}["python"] == 2
    assert [r.text for r in safe_slice(files, "README.md", 2, 99).collect()][:2] == ["# One", "text"]
    with pytest.raises(ValueError):
        safe_slice(files, "../x")
    with pytest.raises(FileNotFoundError):
        load_repository(spark, str(tmp_path / "none"))
    assert dependency_names(str(tree)) == {"py-spark", "foo-bar"}


def test_parsing_chunking_complexity(spark, tree):
    files, _ = load_repository(spark, str(tree))
    parsed = {r.relative_path: r for r in code.parse_files(files).collect()}
    assert parsed["src/bad.py"].is_valid is False and parsed["src/bad.py"].error.startswith("SyntaxError at line 1")
    assert (parsed["src/main.py"].classes, parsed["src/main.py"].methods, parsed["src/main.py"].functions, parsed["src/main.py"].imports) == (1, 2, 1, 2)
    symbols = {r.name: r for r in code.parse_symbols(files).collect()}
    assert symbols["run"].args == ["self", "items", "*rest", "flag", "**more"] and symbols["run"].calls == ["self.helper"] and symbols["Service"].bases == ["base.Base"]
    assert symbols["main"].is_async and symbols["main"].returns == "None"
    assert [r.statement for r in code.parse_imports(files).orderBy("line_number").collect()] == ["import os", "from . import base"]
    each = {r.symbol: r.complexity for r in code.symbol_complexity(files).collect()}
    assert each == {"Service.run": 1 + 1 + 1 + 1 + 2, "Service.helper": 1, "main": 1, "main.<locals>.inner": 2}
    total = {r.relative_path: (r.total_complexity, r.max_complexity, r.is_valid) for r in code.complexity(files).collect()}
    assert total == {"src/main.py": (11, 6, True), "src/bad.py": (1, 1, False)}
    chunks = code.chunk_files(files).collect()
    kinds = [(c.chunk_type, c.symbol_name, c.start_line) for c in chunks if c.relative_path == "src/main.py"]
    assert kinds == [("module_header", "module:src/main.py", 1), ("class", "Service", 6), ("method", "Service.run", 9), ("method", "Service.helper", 15), ("function", "main", 18)]
    docs = [(c.symbol_name, c.parent_symbol, c.start_line, c.end_line) for c in chunks if c.relative_path == "README.md"]
    assert docs == [("README.md:preamble", None, 1, 1), ("One", None, 2, 3), ("Two", "One", 4, 5), ("Three", None, 6, 7)]
    assert all(len(c.chunk_id) == 16 for c in chunks)


def test_git_history(spark, tmp_path):
    root = str(tmp_path)
    env = os.environ | {"GIT_AUTHOR_NAME": "Ada", "GIT_AUTHOR_EMAIL": "ADA@x.org", "GIT_COMMITTER_NAME": "Ada", "GIT_COMMITTER_EMAIL": "a@x.org"}
    git = lambda *a: subprocess.run(["git", "-C", root, *a], check=True, capture_output=True, env=env)
    assert gitlog.status(root)["is_git_repo"] is False
    git("init", "-q")
    assert gitlog.status(root)["is_empty"]
    (tmp_path / "a b.txt").write_text("1\n2\n3\n4\n5\n")
    (tmp_path / "x.bin").write_bytes(b"\0\1")
    git("add", "-A")
    git("commit", "-qm", "first\x1bodd")
    git("mv", "a b.txt", "c.txt")
    (tmp_path / "c.txt").write_text("1\n2\n3\n4\n5\n6\n")
    git("add", "-A")
    git("commit", "-qm", "second")
    commits, changes = gitlog.read_history(spark, root)
    assert [r.subject for r in commits.orderBy("seq").collect()] == ["second", "first\x1bodd"]
    rows = sorted((r.status, r.path, r.old_path or "", r.additions, r.is_binary) for r in changes.collect())
    assert rows == [("A", "a b.txt", "", 5, False), ("A", "x.bin", "", 0, True), ("R", "c.txt", "a b.txt", 1, False)]
    churn = {r.path: r for r in T.churn(commits, changes).collect()}
    assert churn["a b.txt"].commit_frequency == 2 and churn["a b.txt"].is_deleted and churn["a b.txt"].distinct_authors == ["Ada <ada@x.org>"]
    assert churn["c.txt"].total_additions == 1 and churn["x.bin"].is_binary
    assert [r.subject for r in T.history(commits, changes, author="ada", path="x.bin").collect()] == ["first\x1bodd"]
    with pytest.raises(gitlog.GitParsingError):
        gitlog.parse_numstat([b"1\t2\t", b"old"])
