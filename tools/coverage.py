"""Regenerate the operator-coverage table of README.md from the registry."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docsift.plans.registry import registry  # noqa: E402

GROUPS = [("S", 16), ("P", 19), ("F", 11), ("J", 11), ("A", 20), ("W", 3), ("O", 11), ("U", 4), ("T", 17),
          ("V", 8), ("I", 13), ("ST", 2), ("X", 9)]


def table() -> str:
    ids: dict[str, list] = {}
    for name, spec in registry().items():
        for part in spec.survey_id.split("/"):
            ids.setdefault(part, []).append((name, spec.oracle is not None))
    lines = ["| ID | Registered queries | Check |", "|---|---|---|"]
    for g, k in GROUPS:
        for i in range(1, k + 1):
            qs = sorted(ids.get(f"{g}{i}", []))
            chk = "Y" if qs and all(o for _, o in qs) else ("R" if qs else "-")
            lines.append(f"| {g}{i} | {', '.join('`' + q + '`' for q, _ in qs)} | {chk} |")
    return "\n".join(lines) + "\n"


if __name__ == "__main__":
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md")
    text = open(path).read()
    start = text.index("| ID | Registered queries | Check |")
    end = text.index("\nInputs are the driver tables")
    open(path, "w").write(text[:start] + table() + text[end:])
