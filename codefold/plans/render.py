"""Results as text or JSON lines, cut to a budget that always keeps the account."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Characters of an answer by default, when compact, and at most.
BUDGET, COMPACT, MOST = 10_000, 3_000, 100_000
KEPT = ("ACCOUNT", "CONTRACT", "WARNING")


def as_json(result: DataFrame | dict[str, DataFrame], limit: int = 1000) -> list[str]:
    """JSON lines; a dict's rows carry their section's name."""
    if isinstance(result, dict):
        return [f'{{"section": "{k}", "row": {line}}}' for k, df in result.items() for line in as_json(df, limit)]
    return result.limit(limit).toJSON().collect()


def as_text(result: DataFrame | dict[str, DataFrame], limit: int = 200) -> str:
    """Rows as ``column: value`` lines, under a heading for each section."""
    if isinstance(result, dict):
        return "\n".join(f"== {k} ==\n{as_text(df, limit)}" for k, df in result.items())
    return "\n".join("  ".join(f"{c}={v}" for c, v in zip(result.columns, r) if v is not None) for r in result.limit(limit).collect())


def within_budget(text: str, compact: bool = False, budget: int | None = None) -> str:
    """Whole lines up to the budget; account, contract and warning lines always stay, and what was left out is counted."""
    most = min(MOST, budget or (COMPACT if compact else BUDGET))
    if len(text) <= most:
        return text
    lines, out, size, dropped = text.split("\n"), [], 0, 0
    room = most - sum(len(x) + 1 for x in lines if x.startswith(KEPT)) - 40
    for line in lines:
        if line.startswith(KEPT):
            out.append(line)
        elif not dropped and size + len(line) + 1 <= room:
            out.append(line)
            size += len(line) + 1
        else:
            dropped += 1
    return "\n".join([*out, f"... {dropped} more lines"])
