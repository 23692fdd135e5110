"""Documents to segments to chunks, without any shuffle.

A document stays one row throughout: segments and chunks are arrays in it
until the last step spreads them out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 800
OVERLAP_CHARS = 100

SEGMENTS = "array<struct<text:string,heading:string,line_start:int,line_end:int>>"
_PARTS = pa.list_(pa.struct([("text", pa.string()), ("heading", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())]))
#: Characters of segments that a Python task hands over at a time, and what a
#: segment counts beside its text.
SLICE_CHARS, PART_CHARS = 1 << 20, 200

# Heading lines of markdown and of Python code, ends of lines.
TITLES = {"txt": None, "md": r"(?U)^#{1,6}\s+(.*)$", "py": r"(?U)^(def|class)\s+(\w+)"}
#: A character that is no white space, and all white space (fixed values).
FILLED = r"(?U)\S"
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def _map_rows(df: DataFrame, id_column: str, column: str, split: Callable[[Any], list[dict]]) -> DataFrame:
    """(id, segments) from a function of one row's value, in Arrow batches."""
    schema = f"`{id_column}` {df.schema[id_column].dataType.simpleString()}, segments {SEGMENTS}"
    return df.select(id_column, column).mapInArrow(lambda batches: _in_slices(batches, split), schema)


def _in_slices(batches: Iterable[pa.RecordBatch], split: Callable[[Any], list[dict]]) -> Iterator[pa.RecordBatch]:
    """Rows become Python objects one at a time and leave as soon as their
    segments hold `SLICE_CHARS`, however many rows a batch has."""
    for batch in batches:
        ids, values = batch.columns
        held: list[list[dict]] = []
        low = size = 0
        for i in range(batch.num_rows):
            held.append(split(values[i].as_py()))
            size += sum(len(part["text"]) + PART_CHARS for part in held[-1])
            if size >= SLICE_CHARS or i + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([ids.slice(low, len(held)), pa.array(held, _PARTS)], [batch.schema.names[0], "segments"])
                held, low, size = [], i + 1, 0


# --- plain text, markdown, code -----------------------------------------------------


def segment_text(df: DataFrame, id_column: str, text_column: str, kind: str = "txt") -> DataFrame:
    """Blocks between blank lines with line range and heading, as an array.

    kind: "txt", "md" (# lines are headings) or "py" (def and class lines
    start a block). Documents without text get an empty array. A block's range
    starts right after the block or heading before it and one line between.
    """
    if kind not in TITLES:
        raise ValueError(f"unknown text kind '{kind}'")
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.split(F.regexp_replace(text, f"(?:{LINE_END})$", ""), LINE_END)
    shape = TITLES[kind]
    numbered = F.transform(
        lines,
        lambda line, i: F.struct(
            (i + 1).alias("n"),
            line.alias("line"),
            (F.lit(kind == "py") | ~line.rlike(shape)).alias("own") if shape else F.lit(True).alias("own"),
            line.rlike(FILLED).alias("filled"),
            _title(line, kind).alias("title"),
        ),
    )
    in_block = lambda x: x["own"] & x["filled"]
    opens = lambda x: x["title"].isNotNull() if kind == "py" else F.lit(False)

    def parts(lines: Column) -> Column:
        beside = lambda i, test: F.coalesce(test(F.get(lines, i)), F.lit(False))
        first = F.filter(lines, lambda x, i: in_block(x) & (opens(x) | ~beside(i - 1, in_block)))
        last = F.filter(lines, lambda x, i: in_block(x) & (beside(i + 1, opens) | ~beside(i + 1, in_block)))
        return F.struct(
            F.transform(lines, lambda x: x["line"]).alias("texts"),
            F.transform(first, lambda x: x["n"]).alias("first"),
            F.transform(last, lambda x: x["n"]).alias("last"),
            F.filter(lines, lambda x: x["title"].isNotNull()).alias("titles"),
        )

    def blocks(p: Column) -> Column:
        def block(n: Column, i: Column) -> Column:
            before = F.coalesce(F.get(p["last"], i - 1) + 2, F.lit(1))
            end = F.get(p["last"], i)
            start, title = before, F.lit(None).cast("string")
            if shape:
                above = F.filter(p["titles"], lambda t: t["n"] <= n)
                found = F.get(above, F.size(above) - 1)
                title = found["title"]
                start = F.greatest(before, F.coalesce(found["n"] + 1, F.lit(1))) if kind == "md" else F.when(found["n"] == n, n).otherwise(before)
            return F.struct(
                _strip(F.array_join(F.slice(p["texts"], n, end - n + 1), "\n")).alias("text"),
                title.alias("heading"),
                start.cast("int").alias("line_start"),
                end.cast("int").alias("line_end"),
            )

        return F.transform(p["first"], block)

    def plain(lines: Column) -> Column:
        """The parts of lines without titles, from one flag a line."""

        def bounds(filled: Column) -> Column:
            at = F.sequence(F.lit(1), F.size(filled))
            is_filled = lambda i: F.coalesce(F.get(filled, i - 1), F.lit(False))
            return F.struct(
                lines.alias("texts"), F.filter(at, lambda i: is_filled(i) & ~is_filled(i - 1)).alias("first"), F.filter(at, lambda i: is_filled(i) & ~is_filled(i + 1)).alias("last")
            )

        return _once(F.transform(lines, lambda line: line.rlike(FILLED)), bounds)

    cut = _once(numbered, parts) if shape else _once(lines, plain)
    return df.select(id_column, _once(cut, blocks).alias("segments"))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _title(line: Column, kind: str) -> Column:
    if kind == "md":
        return F.when(line.rlike(TITLES[kind]), _strip(F.regexp_extract(line, TITLES[kind], 1)))
    if kind == "py":
        return F.when(line.rlike(TITLES[kind]), F.concat_ws(" ", F.regexp_extract(line, TITLES[kind], 1), F.regexp_extract(line, TITLES[kind], 2)))
    return F.lit(None).cast("string")


# --- HTML ---------------------------------------------------------------------------


def extract_html(df: DataFrame, id_column: str, html_column: str, merged: bool = False) -> DataFrame:
    """Paragraphs, list items and tables with their heading, as an array.

    Scripts, styles, templates and comments are dropped. Where no heading came
    before, line_start and line_end hold the element's number. With `merged`
    neighbours are joined as `merge_neighbours` does, in the same pass.
    """
    names = ("text", "heading", "line_start", "line_end")

    def split(html: str | None) -> list[dict]:
        parts = [dict(zip(names, part)) for part in html_blocks(html or "")]
        return _merged(parts) if merged else parts

    return _map_rows(df, id_column, html_column, split)


_DROPPED = {"script", "style", "noscript", "template"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCKS = _HEADINGS | {"p", "li", "table"}
_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer", "keygen", "menuitem",
}


class _Element:
    __slots__ = ("name", "texts", "rows", "cells")

    def __init__(self, name: str):
        self.name = name
        self.texts: list[str] = []  # pieces of text inside, in order
        self.rows: list[_Element] = []  # of a table
        self.cells: list[_Element] = []  # of a row

    def text(self) -> str:
        return " ".join(self.texts)

    def content(self) -> str:
        """The text; of a table its filled rows, a line each."""
        if self.name != "table":
            return self.text()
        rows = ([cell.text() for cell in row.cells] for row in self.rows)
        return "\n".join("  |  ".join(cells) for cells in rows if any(cells))


class _Blocks(HTMLParser):
    """Collects block elements in document order.

    Unclosed elements stay open until an enclosing element closes, so an
    unclosed paragraph also holds the text of what follows inside its parent.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Element] = []
        self.found: list[_Element] = []
        self.dropped = 0
        self.piece: list[str] = []

    def _end_piece(self) -> None:
        text = "".join(self.piece).strip()
        self.piece.clear()
        if text and not self.dropped:
            for element in self.open:
                element.texts.append(text)

    def handle_data(self, data: str) -> None:
        self.piece.append(data)

    def handle_comment(self, data: str) -> None:
        self._end_piece()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._end_piece()
        if tag in _VOID:
            return
        element = _Element(tag)
        if not self.dropped:
            if tag in _BLOCKS:
                self.found.append(element)
            for outer in self.open:
                if tag == "tr" and outer.name == "table":
                    outer.rows.append(element)
                elif tag in ("td", "th") and outer.name == "tr":
                    outer.cells.append(element)
        self.dropped += tag in _DROPPED
        self.open.append(element)

    def handle_endtag(self, tag: str) -> None:
        self._end_piece()
        if not any(element.name == tag for element in self.open):
            return
        while True:
            name = self.open.pop().name
            self.dropped -= name in _DROPPED
            if name == tag:
                return

    def close(self) -> None:
        super().close()
        self._end_piece()


def html_blocks(html: str) -> list[tuple]:
    """(text, heading, element number twice where there is no heading)."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    titles = accumulate((e.text() if e.name in _HEADINGS else "" for e in parser.found), lambda last, new: new or last)
    under = [(e.content(), title) for e, title in zip(parser.found, titles) if e.name not in _HEADINGS]
    filled = [(text, title) for text, title in under if text.strip()]
    return [(text, title, None, None) if title else (text, None, n, n) for n, (text, title) in enumerate(filled, 1)]


# --- chunks --------------------------------------------------------------------------


def merge_neighbours(df: DataFrame, id_column: str) -> DataFrame:
    """X9, first half: neighbours with the same location joined up to 800 characters."""
    return _map_rows(df, id_column, "segments", _merged)


def _merged(parts: list[dict]) -> list[dict]:
    out: list[dict] = []
    place = ("heading", "line_start", "line_end")
    room = False  # whether the last piece may still grow
    for part in parts:
        text = part["text"]
        fits = room and len(out[-1]["text"]) + len(text) + 1 <= CHUNK_CHARS
        if len(text) <= CHUNK_CHARS and fits and all(out[-1][k] == part[k] for k in place):
            out[-1]["text"] += "\n" + text
        else:
            out.append(dict(part))
            room = len(text) <= CHUNK_CHARS
    return out


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def chunk(df: DataFrame, id_column: str, mergeable: bool = True) -> DataFrame:
    """(id, chunk_index, chunk_id, text, heading, line_start, line_end).

    df: id and segments. Neighbours of one location merge, which Python does;
    segments of `segment_text` have lines of their own and can't, those of
    `extract_html` may have been merged where they were found: with
    `mergeable` off nothing leaves the JVM. Pieces above 800 characters become windows that
    overlap by 100; their location goes with every window.
    """
    step = CHUNK_CHARS - OVERLAP_CHARS

    def windows(part: Column) -> Column:
        size = F.length(part["text"])
        last = F.greatest(F.lit(0), F.ceil((size - CHUNK_CHARS) / step)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                _strip(F.substring(part["text"], i * step + 1, F.lit(CHUNK_CHARS))).alias("text"),
                (last == 0).alias("whole"),
                part["heading"].alias("heading"),
                part["line_start"].alias("line_start"),
                part["line_end"].alias("line_end"),
            ),
        )

    whole = merge_neighbours(df, id_column) if mergeable else df
    pieces = whole.select(id_column, F.flatten(F.transform("segments", windows)).alias("pieces"))
    kept = F.filter("pieces", lambda p: ~p["whole"] | (p["text"] != ""))
    return (
        pieces.select(id_column, F.posexplode(kept).alias("chunk_index", "p"))
        .select(
            id_column,
            "chunk_index",
            F.concat_ws("_", F.col(id_column).cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"),
            "p.text",
            "p.heading",
            "p.line_start",
            "p.line_end",
        )
    )


def document_summary(chunks: DataFrame, id_column: str) -> DataFrame:
    """Chunks and characters per document."""
    return chunks.groupBy(id_column).agg(
        F.count(F.lit(1)).alias("chunk_count"), F.sum(F.length("text")).alias("char_count")
    )
