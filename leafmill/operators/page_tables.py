"""Tables of pages as rectangles of text. Rows are lists of cells (text, head, rows, cols)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, takewhile

MAX_SPAN = 50


def title_rows(rows: list[list[dict]]) -> int:
    """How many leading rows are titles: one cell each, above a wider rest, and never the last row."""
    width = [sum(c["cols"] for c in r) for r in rows]
    widest = list(accumulate(reversed(width), max))[::-1]
    alone = takewhile(lambda i: len(rows[i]) == 1 and widest[i] > 1, range(len(rows) - 1))
    return sum(1 for _ in alone)


def grid_lines(rows: list[list[dict]]) -> Iterator[list[str]]:
    """Each row's texts by column: a cell's text stands in its first place, the rest of its span is empty.

    One pass from the top: ``covered`` holds for how many more rows each column lies under a cell from above.
    """
    covered: list[int] = []
    for left, row in zip(range(len(rows), 0, -1), rows):
        line: list[str] = []
        fresh: list[tuple[int, int, int]] = []
        for cell in row:
            while len(line) < len(covered) and covered[len(line)]:
                line.append("")
            fresh.append((len(line), cell["cols"], min(cell["rows"], left)))
            line += [cell["text"], *[""] * (cell["cols"] - 1)]
        covered += [0] * (len(line) - len(covered))
        covered = [max(c - 1, 0) for c in covered]
        for at, cols, down in fresh:
            covered[at : at + cols] = [max(c, down - 1) for c in covered[at : at + cols]]
        yield line


def table_grid(rows: list[list[dict]], caption: str | None) -> tuple[list[str], list[list[tuple[str, bool]]]]:
    """The titles of a table and its rectangle of (text, is header)."""
    above = title_rows(rows)
    titles = [t for t in [caption] if t] + [r[0]["text"] for r in rows[:above]]
    rows = rows[above:]
    lines = list(grid_lines(rows))
    # A cell that reaches down past shorter rows widens the table as its own row does.
    total = max(map(len, lines), default=0)
    heads = [bool(r) and all(c["head"] for c in r) for r in rows]
    return titles, [[(text, head) for text in line + [""] * (total - len(line))] for line, head in zip(lines, heads)]


def pipe_table(rows: list[list[dict]], caption: str | None) -> str:
    """Titles in bold, then a pipe table."""
    def pipe(values: list[str]) -> str:
        return "| " + " | ".join(v.replace("|", "\\|") for v in values) + " |"

    titles, grid = table_grid(rows, caption)
    lines = [pipe([t for t, _ in row]) for row in grid]
    if lines:
        lines.insert(1, pipe(["---"] * len(grid[0])))
    return "\n\n".join([*(f"**{t}**" for t in titles if t), "\n".join(lines)])
