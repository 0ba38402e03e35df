"""A table in box-drawing characters."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from ..functions.exprs import is_numeric

if TYPE_CHECKING:
    from ..operators.frame import Frame


def cell(v: Any) -> str:
    """At most four decimals; NA where a value is missing."""
    if v is None:
        return "NA"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return str(int(v)) if v == v and abs(v) < 1e15 and v == int(v) else f"{v:.4f}".rstrip("0").rstrip(".")
    return str(v)


def box(frame: Frame, n: int = 20) -> str:
    """The first n rows; numbers to the right. Only those rows leave the executors."""
    names = [c for c in frame.columns if not c.startswith("__")]
    rows = frame.head(n + 1).df.select(*[f"`{c}`" for c in names]).collect() if names else []
    cells = [[cell(v) for v in r] for r in rows[:n]]
    right = [is_numeric(frame.df.schema[c].dataType) for c in names]
    width = [max([len(c), *(len(r[k]) for r in cells)]) for k, c in enumerate(names)]
    rule = lambda a, b, c: a + b.join("─" * (w + 2) for w in width) + c
    line = lambda r: "│" + "│".join(f" {x.rjust(w) if to_right else x.ljust(w)} " for x, w, to_right in zip(r, width, right, strict=True)) + "│"
    out = [rule("┌", "┬", "┐"), line(names), rule("├", "┼", "┤"), *map(line, cells), rule("└", "┴", "┘")]
    return "\n".join([*out, f"... more than {n} rows"] if len(rows) > n else out)
