"""Fill-in-the-middle texts, cut at ranks of units found by an indexable skip list.

A unit is a word with the white space before it, or the white space at a text's
end. The list's lowest lane has one link for each unit; a link of an express
lane spans `STRIDE` links below and carries how many units and how many code
points it passes. A cut rank is reached from the top lane down, by links that
do not pass it, and the code points passed are the place to cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightledger.llm.arrays import SPACED, slices, text_bytes, word_bounds

STRIDE = 16
#: Marks of prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)

_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Lanes:
    """An indexable skip list over units of these widths in code points."""

    def __init__(self, points: np.ndarray):
        units = np.ones(len(points), np.int64)
        self.lanes = [(units, points)]
        while len(units) > STRIDE:
            starts = np.arange(0, len(units), STRIDE)
            units, points = np.add.reduceat(units, starts), np.add.reduceat(points, starts)
            self.lanes.append((units, points))

    def seek(self, rank: int) -> int:
        """Code points before the unit of this rank (their number: all)."""
        at, passed, left = 0, 0, rank
        for units, points in reversed(self.lanes):
            at *= STRIDE
            while at < len(units) and units[at] <= left:
                left -= int(units[at])
                passed += int(points[at])
                at += 1
        return passed


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2**32 of a document (null: an empty id)."""
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(text[k : k + 8], 16) for k in (0, 8, 16, 24)]


def _arranged(text: str, first: int, second: int, spm: bool) -> str:
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if spm else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars
    (code points, null if plain) and output of every row.

    The id and the seed alone decide the form and the two cut ranks, so runs
    agree. Texts that are null, empty or hold a mark stay plain; a null text is
    an empty one. Rows may repeat and are alike then. Whole texts are cut; a
    task holds a slice of a megabyte, or one text if that is longer.
    """
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
    schema = pa.schema(list(zip(names, kinds)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column(1))
            _, ends, counts = word_bounds(data, offsets, SPACED)
            full = np.diff(offsets) > 0
            blank_end = np.zeros(len(counts), bool)
            blank_end[full] = ~SPACED[data[offsets[1:][full] - 1]]
            before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            at, rows = 0, []
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                text = text or ""
                last, n = at + int(counts[i]), int(counts[i]) + int(blank_end[i])
                one, two, three, four = draws(doc_id, seed)
                if not text or three % 100 >= percent or any(mark in text for mark in MARKS):
                    rows.append((doc_id, n, "plain", None, None, text))
                else:
                    places = [int(offsets[i]), *ends[at:last], *([int(offsets[i + 1])] if blank_end[i] else [])]
                    lanes = Lanes(np.diff(before[places]))
                    low, high = sorted((one % (n + 1), two % (n + 1)))
                    first, second = lanes.seek(low), lanes.seek(high)
                    spm = four % 100 < spm_percent
                    rows.append((doc_id, n, "spm" if spm else "psm", first, second - first, _arranged(text, first, second, spm)))
                at = last
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return texts.mapInArrow(cut, _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    second = F.when(form == "psm", F.instr(output, SUFFIX)).otherwise(F.instr(output, PREFIX))
    third = F.instr(output, MIDDLE)
    first_part = F.substring(output, F.lit(4), second - 4)
    second_part = F.substring(output, second + 3, third - second - 3)
    middle = F.substring(output, third + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first_part, middle, second_part)).otherwise(F.concat(second_part, middle, first_part))
