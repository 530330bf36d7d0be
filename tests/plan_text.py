"""Text of executed plans."""

from __future__ import annotations

MARK = "+- == Initial Plan =="


def final_only(plan: str) -> str:
    """The plan without the sections that show how it looked before adaptive changes."""
    kept, skip_from = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :|"))
        # Line breaks inside literals leave lines without indentation.
        if skip_from is not None and (depth > skip_from or depth == 0):
            continue
        skip_from = None
        if MARK in line:
            skip_from = line.index(MARK)
            continue
        kept.append(line)
    return "\n".join(kept)


def executed(df) -> str:
    execution = df._jdf.queryExecution()
    execution.executedPlan().execute().count()
    return final_only(execution.executedPlan().toString())
