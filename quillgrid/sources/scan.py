"""One pass over the HTML of a sheet: tags as they come, with the state of the open table, row, cell and link.

The state is that of a reader of table exports, not of a browser: a cell or row counts when
it is closed; one that is still open when the next one begins is given up. Rows of a table
inside a cell are rows like others, and end the cell's own; what follows the end of any table
counts again from the next table on. Header cells, comments, scripts and styles are passed over.

Cells go to flat columns as they close, so that no object is made for any of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa

#: A whole cell that holds texts and breaks only (attributes, content), as most do; a comment, a script
#: or style with its content, a tag (closing mark, name, attributes), or other markup.
_TAG = re.compile(
    r"""<(?:td(?=[\s/>])((?:[^>=]++|=\s*(?:"[^"]*"|'[^']*')|=)*+)>([^<]*+(?:<br>[^<]*+)*+)</td>|!--.*?(?:-->|\Z)|(?:(script)|style)\b(?:[^>=]++|=\s*(?:"[^"]*"|'[^']*')|=)*+>.*?(?:</(?(3)script|style)\b[^>]*>|\Z)"""
    r"""|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*(?:"[^"]*"|'[^']*')|=)*+)>|[!?/][^>]*>)""",
    re.S | re.I,
)
_BREAK = re.compile("<br>", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_SPAN = re.compile(r"\s*(\d{1,4})\s*")
#: Sheets leave a task in batches of so many cells, a sheet at least.
BATCH_CELLS = 100_000
#: A sheet is cut into so many tags at a time; where its first rows are asked for, into these.
TAGS, FIRST_TAGS = 16384, 512


def _tags(html: str, step: int) -> Iterator[tuple]:
    """Attributes and content of each whole cell, or closing mark, name and attributes of each tag, with the text that follows it.

    Other markup has no name. The texts between tags come from the expression itself, so that no slice is made for them.
    """
    fields, read = _TAG.groups + 1, (1, 2, 4, 5, 6, 7)
    follows = (None,) * (len(read) - 1)
    while True:
        found = _TAG.split(html, step)
        yield *follows, found[0]
        if len(found) <= step * fields:
            yield from zip(*(found[k::fields] for k in read), strict=True)
            return
        # the last tag's text is cut in the next round
        html, found = found[-1], found[:-1]
        follows = tuple(found[k - fields] for k in read[:-1])
        yield from zip(*(found[k : len(found) - fields + 1 : fields] for k in read), strict=True)


_decoded = lru_cache(4096)(unescape)


@lru_cache(4096)
def _attributes(text: str) -> dict[str, str]:
    """Decoded values by name in lower case; the last one of a name counts."""
    return {name.lower(): unescape(a or b or c) for name, a, b, c in _ATTRIBUTE.findall(text)}


@lru_cache(4096)
def _cell_attributes(text: str) -> tuple[str, int]:
    """Class and width of a cell."""
    found = _attributes(text)
    wide = _SPAN.fullmatch(found.get("colspan", ""))
    return found.get("class", ""), max(1, int(wide[1])) if wide else 1


class CellColumns:
    """Sheets of rows of cells as flat columns with offsets."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.classes: list[str] = []
        self.colors: list[str | None] = []
        self.links: list[str] = []
        self.lines: list[int] = []
        self.images: list[str] = []
        self.link_ends, self.image_ends, self.row_ends, self.sheet_ends = [0], [0], [0], [0]

    def scan(self, html: str, colors: dict[str, str], most_rows: int | None = None) -> None:
        """Appends the rows of one sheet, or the first ones if no more are asked for."""
        in_table = in_row = in_cell = in_link = False
        href, css, width = "", "", 1
        parts: list[str] = []
        cells: list[tuple] = []
        links: list[tuple[str, int]] = []
        images: list[str] = []
        last = None if most_rows is None else len(self.row_ends) + most_rows
        none: list = []
        for attributes, content, close, name, rest, data in _tags(html, TAGS if last is None else FIRST_TAGS):
            if content is not None:
                if "<" in content:
                    content = _BREAK.sub("\n", content)
                if "&" in content:
                    content = _decoded(content)
                if in_row:
                    css, width = _cell_attributes(attributes) if attributes else ("", 1)
                    if in_link:
                        # a link that is still open ends in a later cell
                        parts, links, images = [content], [], []
                        cells.append((content.strip(), css, links, images, width))
                    else:
                        cells.append((content.strip(), css, none, none, width))
                elif in_cell:
                    parts.append(content)
                    cells.append(("".join(parts).strip(), css, links, images, width))
                in_cell = False
                continue
            if name:
                name = name.lower()
                if name == "td":
                    if not close:
                        if in_row:
                            in_cell, parts, links, images = True, [], [], []
                            css, width = _cell_attributes(rest)
                    elif in_cell:
                        in_cell = False
                        cells.append(("".join(parts).strip(), css, links, images, width))
                elif name == "br":
                    if in_cell and not close:
                        parts.append("\n")
                elif name == "tr":
                    if not close:
                        if in_table:
                            in_row, cells = True, []
                    elif in_row:
                        in_row = False
                        if cells:
                            self._add_row(cells, colors)
                            if len(self.row_ends) == last:
                                break
                elif name == "a":
                    if not close:
                        if in_cell:
                            in_link, href = True, _attributes(rest).get("href", "")
                    elif in_link:
                        in_link = False
                        if href:
                            links.append((href, sum(p.count("\n") for p in parts)))
                elif name == "img":
                    if in_cell and not close:
                        found = _attributes(rest)
                        if found.get("src"):
                            images.append(found["src"])
                        parts.append(found.get("alt", ""))
                elif name == "table":
                    in_table = not close
            if in_cell and data:
                parts.append(_decoded(data) if "&" in data else data)
        self.sheet_ends.append(len(self.row_ends) - 1)

    def _add_row(self, cells: list[tuple], colors: dict[str, str]) -> None:
        if any(c[4] > 1 for c in cells):
            # a wide cell is followed by empty ones
            cells = [part for c in cells for part in (c, *[("", "", (), (), 1)] * (c[4] - 1))]
        self.texts += [c[0] for c in cells]
        self.classes += [c[1] for c in cells]
        self.colors += [colors.get(c[1]) if c[1] else None for c in cells]
        for _, _, links, images, _ in cells:
            if links:
                self.links += [href for href, _ in links]
                self.lines += [line for _, line in links]
            if images:
                self.images += images
            self.link_ends.append(len(self.links))
            self.image_ends.append(len(self.images))
        self.row_ends.append(len(self.texts))

    def to_arrow(self) -> pa.Array:
        """array<array<struct>> with one entry for each sheet."""
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        fields = {
            "text": pa.array(self.texts, pa.string()),
            "links": lists(self.link_ends, pa.array(self.links, pa.string())),
            "link_lines": lists(self.link_ends, pa.array(self.lines, pa.int32())),
            "images": lists(self.image_ends, pa.array(self.images, pa.string())),
            "css_class": pa.array(self.classes, pa.string()),
            "bg_color": pa.array(self.colors, pa.string()),
        }
        return lists(self.sheet_ends, lists(self.row_ends, pa.StructArray.from_arrays(list(fields.values()), names=list(fields))))


def scan_batches(batches: Iterator[pa.RecordBatch], most_rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """``(sheet_id, html, colors map)`` to ``(sheet_id, rows)``, or the first rows of each; a null text has no rows."""
    for batch in batches:
        ids, columns, begun = batch.column(0), CellColumns(), 0
        for i in range(batch.num_rows):
            colors = batch.column(2)[i].as_py()
            columns.scan(batch.column(1)[i].as_py() or "", dict(colors or ()), most_rows)
            if len(columns.texts) >= BATCH_CELLS or i + 1 == batch.num_rows:
                yield pa.record_batch([ids.slice(begun, i + 1 - begun), columns.to_arrow()], names=["sheet_id", "rows"])
                columns, begun = CellColumns(), i + 1
