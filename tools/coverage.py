"""Write COVERAGE.md: which registered query exercises which inventory row."""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from evidary.catalog import COVERS, ORACLES  # noqa: E402


def places() -> dict[str, list[str]]:
    """Functions whose docstring names an inventory row."""
    found: dict[str, list[str]] = {}
    for folder, _, names in os.walk(os.path.join(ROOT, "evidary")):
        if "catalog" in folder:
            continue
        for name in sorted(names):
            if not name.endswith(".py"):
                continue
            path = os.path.join(folder, name)
            text = open(path, encoding="utf-8").read()
            for fn, doc in re.findall(r'def (\w+)\([^"]*?"""(.*?)"""', text, re.S):
                for row in re.findall(r"\b([A-HIKQSUV]\d{1,2})\b", doc):
                    found.setdefault(row, []).append(f"`{os.path.relpath(path, ROOT)}:{fn}`")
    return found


def main() -> None:
    by_row: dict[str, list[str]] = {}
    for name, rows in COVERS.items():
        for row in rows.split():
            by_row.setdefault(row, []).append(name)
    code = places()
    key = lambda r: (r[0], int(r[1:]))
    lines = ["# Coverage", "", "Queries marked * have an SQL twin that DuckDB checks.", "", "| row | code | queries |", "|---|---|---|"]
    for row in sorted(set(by_row) | set(code), key=key):
        queries = ", ".join(f"`{n}`" + ("*" if n in ORACLES else "") for n in by_row.get(row, [])) or "unit tests"
        lines.append(f"| {row} | {', '.join(dict.fromkeys(code.get(row, []))) or '-'} | {queries} |")
    with open(os.path.join(ROOT, "COVERAGE.md"), "w", encoding="utf-8") as handle:
        handle.write("\n".join(lines) + "\n")
    print(len(by_row), "rows in queries;", len(COVERS), "queries;", len(ORACLES), "with SQL")


if __name__ == "__main__":
    main()
