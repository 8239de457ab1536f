"""Python sources as rows: symbols, imports, chunks and cyclomatic complexity, one task a partition of files.

The syntax tree needs Python's own parser, so these run in Arrow batches; everything after them is DataFrame operations.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections import deque

from pyspark.sql import DataFrame

SYMBOLS = (
    "relative_path string, name string, symbol_type string, parent_name string, start_line int, end_line int, docstring string, is_async boolean, "
    "args array<string>, returns string, decorators array<string>, calls array<string>, bases array<string>, methods_count int, seq int"
)
IMPORTS = "relative_path string, name string, module string, alias string, is_from boolean, line_number int, statement string, level int"
FILES = "relative_path string, is_valid boolean, error string, docstring string, classes int, functions int, methods int, imports int"
CHUNKS = (
    "chunk_id string, relative_path string, language string, chunk_type string, symbol_name string, parent_symbol string, start_line int, end_line int, "
    "signature string, content string, metadata map<string,string>"
)
COMPLEXITY = "relative_path string, symbol string, line int, complexity int"

Function = (ast.FunctionDef, ast.AsyncFunctionDef)


def shown(node: ast.AST | None) -> str:
    return ast.unparse(node) if node is not None else ""


def argument_names(args: ast.arguments) -> list[str]:
    out = [a.arg for a in [*args.posonlyargs, *args.args]]
    out += [f"*{args.vararg.arg}"] if args.vararg else []
    out += [a.arg for a in args.kwonlyargs]
    return out + ([f"**{args.kwarg.arg}"] if args.kwarg else [])


def calls_in(node: ast.AST) -> list[str]:
    """Names of called functions, each once, breadth first."""
    found: dict[str, None] = {}
    todo = deque([node])
    while todo:
        x = todo.popleft()
        if isinstance(x, ast.Call) and (name := shown(x.func)):
            found.setdefault(name)
        todo.extend(ast.iter_child_nodes(x))
    return list(found)


def _symbol(path: str, node: ast.AST, kind: str, parent: str | None, seq: int) -> dict:
    is_class = kind == "class"
    return {
        "relative_path": path, "name": node.name, "symbol_type": kind, "parent_name": parent, "start_line": node.lineno, "end_line": node.end_lineno, "docstring": ast.get_docstring(node),
        "is_async": isinstance(node, ast.AsyncFunctionDef), "args": [] if is_class else argument_names(node.args), "returns": None if is_class or node.returns is None else shown(node.returns),
        "decorators": [shown(d) for d in node.decorator_list], "calls": [] if is_class else calls_in(node), "bases": [shown(b) for b in node.bases] if is_class else [],
        "methods_count": sum(isinstance(x, Function) for x in node.body) if is_class else 0, "seq": seq,
    }


def symbols_of(path: str, tree: ast.Module) -> list[dict]:
    """Classes, their direct methods, and functions of the top level."""
    out: list[dict] = []
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            out.append(_symbol(path, node, "class", None, len(out)))
            for x in node.body:
                if isinstance(x, Function):
                    out.append(_symbol(path, x, "method", node.name, len(out)))
        elif isinstance(node, Function):
            out.append(_symbol(path, node, "function", None, len(out)))
    return out


def imports_of(path: str, tree: ast.Module) -> list[dict]:
    out = []
    for node in tree.body:
        if isinstance(node, ast.Import):
            for a in node.names:
                out.append((a.name, None, a.asname, False, node.lineno, f"import {a.name}" + (f" as {a.asname}" if a.asname else ""), 0))
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            for a in node.names:
                out.append((a.name, module, a.asname, True, node.lineno, f"from {module} import {a.name}" + (f" as {a.asname}" if a.asname else ""), node.level))
    names = ("name", "module", "alias", "is_from", "line_number", "statement", "level")
    return [{"relative_path": path} | dict(zip(names, x, strict=True)) for x in out]


def parsed(source: str) -> tuple[ast.Module | None, str | None]:
    try:
        return ast.parse(source), None
    except SyntaxError as e:
        return None, f"SyntaxError at line {e.lineno}: {e.msg}"
    except (ValueError, RecursionError) as e:
        return None, f"{type(e).__name__}: {e}"


def file_row(path: str, source: str) -> dict:
    tree, error = parsed(source)
    if tree is None:
        return {"relative_path": path, "is_valid": False, "error": error, "docstring": None, "classes": 0, "functions": 0, "methods": 0, "imports": 0}
    s = symbols_of(path, tree)
    count = lambda k: sum(x["symbol_type"] == k for x in s)
    return {
        "relative_path": path, "is_valid": True, "error": None, "docstring": ast.get_docstring(tree), "classes": count("class"), "functions": count("function"),
        "methods": count("method"), "imports": len(imports_of(path, tree)),
    }


# --- complexity ---------------------------------------------------------------------------------------------------------


def branches(node: ast.AST) -> int:
    """Decisions below a node, without those of functions and classes inside it."""
    total = 0
    for x in ast.iter_child_nodes(node):
        if isinstance(x, (*Function, ast.ClassDef)):
            continue
        if isinstance(x, (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler)):
            total += 1
        elif isinstance(x, ast.BoolOp):
            total += len(x.values) - 1
        elif isinstance(x, ast.comprehension):
            total += 1 + len(x.ifs)
        elif isinstance(x, ast.match_case):
            wild = isinstance(x.pattern, ast.MatchAs) and x.pattern.pattern is None and x.pattern.name is None and x.guard is None
            total += (not wild) + (x.guard is not None)
        total += branches(x)
    return total


def complexities(tree: ast.Module) -> list[tuple[str, int, int]]:
    """(symbol, line, complexity) of all callables, closures by ``outer.<locals>.inner``."""
    out: list[tuple[str, int, int]] = []

    def look(body_of: ast.AST, prefix: str) -> None:
        for x in ast.iter_child_nodes(body_of):
            if isinstance(x, Function):
                out.append((prefix + x.name, x.lineno, 1 + branches(x)))
                look(x, f"{prefix}{x.name}.<locals>.")
            elif isinstance(x, ast.ClassDef):
                look(x, f"{prefix}{x.name}.")
            else:
                look(x, prefix)

    look(tree, "")
    return out


def file_complexity(source: str) -> tuple[int, int, bool, list[tuple[str, int, int]]]:
    """(total, maximum, valid, per symbol): the script counts 1 and its branches, class bodies theirs."""
    tree, error = parsed(source)
    if error:
        return 1, 1, False, []
    each = complexities(tree)

    def bodies(node: ast.AST) -> int:
        return sum(branches(x) + bodies(x) for x in ast.iter_child_nodes(node) if isinstance(x, ast.ClassDef))

    script = 1 + branches(tree)
    return script + bodies(tree) + sum(c for *_, c in each), max([script, *(c for *_, c in each)]), True, each


# --- chunks -------------------------------------------------------------------------------------------------------------


def chunk_id(path: str, kind: str, symbol: str | None, start: int, end: int, content: str) -> str:
    return hashlib.sha256(f"{path}:{kind}:{symbol or ''}:{start}-{end}:{content.strip()}".encode()).hexdigest()[:16]


def file_name(path: str) -> str:
    return path.rpartition("/")[2]


def _chunk(path, language, kind, symbol, parent, start, end, signature, content, **metadata) -> dict:
    return {
        "chunk_id": chunk_id(path, kind, symbol, start, end, content), "relative_path": path, "language": language, "chunk_type": kind, "symbol_name": symbol, "parent_symbol": parent,
        "start_line": start, "end_line": end, "signature": signature, "content": content, "metadata": {k: str(v) for k, v in metadata.items()},
    }


def function_signature(node) -> str:
    returns = f" -> {shown(node.returns)}" if node.returns is not None else ""
    return f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({', '.join(argument_names(node.args))}){returns}:"


def class_signature(node: ast.ClassDef) -> str:
    bases = ", ".join(shown(b) for b in node.bases)
    return f"class {node.name}({bases}):" if bases else f"class {node.name}:"


def _start(node) -> int:
    return min([node.lineno, *(d.lineno for d in node.decorator_list)])


def code_chunks(path: str, source: str, language: str = "python") -> list[dict]:
    """A header of the module, classes (only their heads where they have methods), methods and functions, by place."""
    lines = source.splitlines()
    tree, _ = parsed(source)
    if not source.strip():
        return []
    if tree is None:
        return [_chunk(path, language, "block", file_name(path), None, 1, len(lines), None, source, syntax_error=True)]
    cut = lambda a, b: "\n".join(lines[a - 1 : b])
    out = []
    tops = [n for n in tree.body if isinstance(n, (*Function, ast.ClassDef))]
    imports = [n.end_lineno for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom))]
    before = min((_start(n) for n in tops), default=len(lines) + 1) - 1
    doc = tree.body[0].end_lineno if tree.body and ast.get_docstring(tree) is not None else 0
    end = min(max(imports), before) if imports else min(doc, before)
    if end > 0 and cut(1, end).strip():
        out.append(_chunk(path, language, "module_header", f"module:{path}", None, 1, end, f"# Module {file_name(path)}", cut(1, end).rstrip()))
    for n in tops:
        a, b = _start(n), n.end_lineno
        if isinstance(n, ast.ClassDef):
            methods = [x for x in n.body if isinstance(x, Function)]
            stop = max(a, min(_start(m) for m in methods) - 1) if methods else b
            out.append(_chunk(path, language, "class", n.name, None, a, stop, class_signature(n), cut(a, stop), methods_count=len(methods)))
            out += [_chunk(path, language, "method", f"{n.name}.{m.name}", n.name, _start(m), m.end_lineno, function_signature(m), cut(_start(m), m.end_lineno), is_async=isinstance(m, ast.AsyncFunctionDef)) for m in methods]
        else:
            out.append(_chunk(path, language, "function", n.name, None, a, b, function_signature(n), cut(a, b), is_async=isinstance(n, ast.AsyncFunctionDef)))
    if not out:
        out.append(_chunk(path, language, "block", file_name(path), None, 1, len(lines), None, source))
    return sorted(out, key=lambda c: (c["start_line"], c["end_line"]))


HEADING = re.compile(r"^(#{1,6})\s+(.+)$")


def doc_chunks(path: str, source: str, language: str = "markdown") -> list[dict]:
    """Sections of a text by its headings, each with the heading above it; text before the first heading is a preamble."""
    lines = source.splitlines()
    if not source.strip():
        return []
    heads = [(i, len(m[1]), m[2].strip()) for i, x in enumerate(lines) if (m := HEADING.match(x.strip()))]
    whole = lambda a, b: "\n".join(lines[a:b])
    if not heads:
        return [_chunk(path, language, "doc_section", file_name(path), None, 1, len(lines), None, source)]
    out = []
    if whole(0, heads[0][0]).strip():
        out.append(_chunk(path, language, "doc_section", f"{file_name(path)}:preamble", None, 1, heads[0][0], None, whole(0, heads[0][0])))
    stack: list[tuple[int, str]] = []
    for k, (i, level, title) in enumerate(heads):
        while stack and stack[-1][0] >= level:
            stack.pop()
        end = heads[k + 1][0] if k + 1 < len(heads) else len(lines)
        if whole(i, end).strip():
            out.append(_chunk(path, language, "doc_section", title, stack[-1][1] if stack else None, i + 1, end, None, whole(i, end), heading_level=level))
        stack.append((level, title))
    return out


def chunks_of(path: str, source: str, language: str) -> list[dict]:
    if language == "python" or path.endswith(".py"):
        return code_chunks(path, source)
    if language in ("markdown", "restructuredtext", "text") or path.endswith((".md", ".rst", ".txt")):
        return doc_chunks(path, source, language)
    return [_chunk(path, language, "block", file_name(path), None, 1, max(1, len(source.splitlines())), None, source)] if source.strip() else []


#: Parsers by language and by extension; more can be added with ``register``.
EXTRACTORS = {"python": ".py"}


def register(language: str, extension: str) -> None:
    EXTRACTORS[language] = extension


def _rows(files: DataFrame, schema: str, make) -> DataFrame:
    """make(path, content, language) -> rows as dicts."""
    import pandas as pd

    names = [x.split(" ")[0] for x in re.split(r", (?=\w+ )", schema)]

    def run(batches):
        for df in batches:
            rows = [r for p, c, lang in zip(df.relative_path, df.content, df.language, strict=True) for r in make(p, c or "", lang or "")]
            yield pd.DataFrame(rows, columns=names)

    return files.select("relative_path", "content", "language").mapInPandas(run, schema)


def parse_files(files: DataFrame) -> DataFrame:
    return _rows(files.where("language = 'python'"), FILES, lambda p, c, _: [file_row(p, c)])


def parse_symbols(files: DataFrame) -> DataFrame:
    return _rows(files.where("language = 'python'"), SYMBOLS, lambda p, c, _: symbols_of(p, t) if (t := parsed(c)[0]) else [])


def parse_imports(files: DataFrame) -> DataFrame:
    return _rows(files.where("language = 'python'"), IMPORTS, lambda p, c, _: imports_of(p, t) if (t := parsed(c)[0]) else [])


def chunk_files(files: DataFrame) -> DataFrame:
    return _rows(files, CHUNKS, chunks_of)


def symbol_complexity(files: DataFrame) -> DataFrame:
    return _rows(files.where("language = 'python'"), COMPLEXITY, lambda p, c, _: [{"relative_path": p, "symbol": s, "line": n, "complexity": k} for s, n, k in file_complexity(c)[3]])


def complexity(files: DataFrame) -> DataFrame:
    def one(p, c, _):
        total, most, valid, _each = file_complexity(c)
        return [{"relative_path": p, "total_complexity": total, "max_complexity": most, "is_valid": valid}]

    return _rows(files.where("language = 'python'"), "relative_path string, total_complexity int, max_complexity int, is_valid boolean", one)
