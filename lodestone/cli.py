"""python -m lodestone.cli SOURCE TOOL [name=value ...] | SOURCE ask QUESTION: results as JSON."""

from __future__ import annotations

import json
import os
import sys


def main(arguments: list[str]) -> int:
    if len(arguments) < 2:
        print(__doc__)
        return 2
    from lodestone.plans.investigation import investigate
    from lodestone.plans.tools import Workspace, registry
    from lodestone.session import build_session
    from lodestone.sources import gitlog

    source, tool, *rest = arguments
    spark = build_session("lodestone-cli", "local[*]")
    history = source if os.path.isdir(source) and gitlog.status(source)["head_commit"] else None
    tools = registry(Workspace.open(spark, source, history))
    if tool == "ask":
        print(investigate(spark, " ".join(rest), tools)["answer"])
        return 0
    values = dict(x.split("=", 1) for x in rest)
    result = tools.run("cli", tool, {k: json.loads(v) if v[:1] in '[{"' or v.lstrip("-").isdigit() or v in ("true", "false") else v for k, v in values.items()})
    print(json.dumps({"status": result.status, "error": result.error, "rows": result.rows}, default=str, indent=1))
    return int(result.status != "SUCCESS")


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
