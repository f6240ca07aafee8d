"""Reading a finished plan: what was really run, not what was planned."""

from __future__ import annotations

from pyspark.sql import DataFrame


def final_plan(df: DataFrame) -> list[str]:
    """Run ``df`` and return the operators of its final adaptive plan.

    Initial plans are left out. Subqueries are kept, since they run as well.
    """
    df.collect()
    lines, skip_from = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        text = line.lstrip(" :+-")
        indent = len(line) - len(text)
        if skip_from is not None and indent >= skip_from:
            continue
        skip_from = None
        if text.startswith("== Initial Plan"):
            skip_from = indent
            continue
        if text.startswith("== Final Plan"):
            continue
        lines.append(text)
    return lines


def scans(df: DataFrame) -> int:
    """How often files were scanned; a reused shuffle does not scan again."""
    return sum(line.startswith("FileScan") for line in final_plan(df))
