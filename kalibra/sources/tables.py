"""SRC21: the tables of web pages, by a state machine over tags in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the standard allows a cell to span at most.
COLUMNS, ROWS = 1000, 65534
UNSEEN = {"script", "style", "template"}
BLOCKS = {"br", "p", "div", "li", "ul", "ol", "hr", "h1", "h2", "h3", "h4", "h5", "h6"}


class Open:
    """A table whose end has not been read."""

    def __init__(self, number: int):
        self.number, self.rows, self.row, self.cell = number, [], None, None

    def close_cell(self) -> None:
        if self.cell is not None:
            parts, across, down = self.cell
            self.row.append((" ".join("".join(parts).split()), across, down))
            self.cell = None

    def close_row(self) -> None:
        self.close_cell()
        if self.row:
            self.rows.append(self.row)
        self.row = None

    def grid(self) -> list[list[str]]:
        """The rows with every spanned place filled, each cell in the next free columns; spans end with the table."""
        out, held = [], {}  # column -> (text, rows still to fill)
        for row in self.rows:
            line = {c: text for c, (text, _) in held.items()}
            held = {c: (text, left - 1) for c, (text, left) in held.items() if left > 1}
            at = 0
            for text, across, down in row:
                for _ in range(across):
                    while at in line:
                        at += 1
                    line[at] = text
                    if down > 1:
                        held[at] = text, down - 1
            out.append([line.get(c, "") for c in range(max(line) + 1)])
        return out


class Scanner(HTMLParser):
    """The tables of one page, numbered by their start tags, as (number, rows); each is handed over at its end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.n, self.done, self.unseen = [], 0, [], 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in UNSEEN:
            self.unseen += 1
        elif tag == "table":
            self.open.append(Open(self.n))
            self.n += 1
        elif self.open and tag in ("tr", "thead", "tbody", "tfoot"):
            self.open[-1].close_row()
            if tag == "tr":
                self.open[-1].row = []
        elif self.open and tag in ("td", "th"):
            now = self.open[-1]
            now.close_cell()
            now.row = [] if now.row is None else now.row
            spans = dict(attrs)
            down = span(spans.get("rowspan"), ROWS, 0)
            now.cell = [], span(spans.get("colspan"), COLUMNS, 1), down or ROWS  # 0 reaches to the end
        elif tag in BLOCKS:
            self.handle_data(" ")

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag not in UNSEEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in UNSEEN:
            self.unseen = max(0, self.unseen - 1)
        elif self.open and tag in ("td", "th"):
            self.open[-1].close_cell()
        elif self.open and tag in ("tr", "thead", "tbody", "tfoot"):
            self.open[-1].close_row()
        elif self.open and tag == "table":
            now = self.open.pop()
            now.close_row()
            self.done.append((now.number, now.grid()))
        elif tag in BLOCKS:
            self.handle_data(" ")

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].cell is not None and not self.unseen:
            self.open[-1].cell[0].append(data)


def span(value: str | None, most: int, least: int) -> int:
    try:
        found = int(value or 1)
    except ValueError:
        return 1
    return min(found, most) if found >= least else 1


def tables_of(html: str | None) -> list[tuple[int, list[list[str]]]]:
    """(number, rows of texts) of a page's tables; what is still open at its end is closed there."""
    if not html or "<table" not in html.lower():
        return []
    scanner = Scanner()
    scanner.feed(html)
    scanner.close()
    while scanner.open:
        scanner.handle_endtag("table")
    return sorted(scanner.done)


def scanned(pages: DataFrame, rows_of: Callable[[list[list[str]]], list[tuple[int, list[str]]]], key: str, html: str, first: bool = False) -> DataFrame:
    """(key, t, row, cells) of what rows_of picks of each table, or of the first one of a page of which it picks any."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, places, numbers, cells = [], [], [], []
            for i, page in enumerate(b.column(1)):
                for t, grid in tables_of(page.as_py()):
                    picked = rows_of(grid)
                    for n, row in picked:
                        ids.append(i)
                        places.append(t)
                        numbers.append(n)
                        cells.append(row)
                    if first and picked:
                        break
            arrays = [b.column(0).take(pa.array(ids, pa.int64())), pa.array(places, pa.int32()), pa.array(numbers, pa.int32()), pa.array(cells, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "t", "row", "cells"])

    return pages.select(F.col(key), F.col(html).cast("string")).mapInArrow(run, f"`{key}` {kind}, t int, row int, cells array<string>")


def page_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, t, row, cells): every row of every table, numbered from 0.

    Cells are texts without tags, entities decoded, blanks folded; cells that span
    rows or columns fill all their places.  Cells, rows and tables may lack their
    ends.  A table within a cell is a table of its own, and its text isn't the
    cell's.  Null pages and those without tables have no row; pages aren't shuffled.
    """
    return scanned(pages, lambda grid: list(enumerate(grid)), key, html)


def page_cells(pages: DataFrame, header: list[str], key: str = "page_id", html: str = "html") -> DataFrame:
    """page_tables() of the tables that name all headers in their first row, in any case, without that row."""
    names = {h.lower() for h in header}

    def rows_of(grid):
        return list(enumerate(grid))[1:] if grid and names <= {c.lower() for c in grid[0]} else []

    return scanned(pages, rows_of, key, html)


def page_records(pages: DataFrame, columns: dict[str, str], required: list[str], key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, row, columns): the first table of each page whose header has all that is required, with its columns renamed.

    columns maps a new name to what a header contains, in any case; a header goes to
    the first name that fits, and of several that fit a name the first counts.
    Columns that a table lacks are empty, and so are cells that a row lacks.
    """
    marks = [(name, part.lower()) for name, part in columns.items()]
    need = [columns[name].lower() for name in required]

    def rows_of(grid):
        head = [c.lower() for c in grid[0]] if grid else []
        if not all(any(n in c for c in head) for n in need):
            return []
        place: dict[str, int] = {}
        for i, c in enumerate(head):
            name = next((name for name, part in marks if part in c), None)
            if name is not None:
                place.setdefault(name, i)
        if not all(name in place for name in required):
            return []
        return [(n, [row[place[m]] if m in place and place[m] < len(row) else "" for m, _ in marks]) for n, row in enumerate(grid) if n]

    found = scanned(pages, rows_of, key, html, first=True)
    return found.select(key, "row", *[F.get("cells", F.lit(i)).alias(name) for i, (name, _) in enumerate(marks)])
