"""Online packing of token sequences in bounded space.

Each task keeps a fixed number of open windows. A document's remainder goes to
the window where it fits best. When none fits and no window may be opened, the
fullest is topped up with the head of the document, emitted, and the rest is
placed anew. What is left open in many tasks is merged at the end.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightledger.llm.arrays import slices
from brightledger.llm.tables import settled

LENGTH = 2048
OPEN_WINDOWS = 32
#: Leftovers of this many tasks are merged in one group: at most
#: GROUP * OPEN_WINDOWS * LENGTH ids of 4 bytes (8 MB).
GROUP = 32
END_ID = 1
#: Split pattern of the byte-level tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ByteTokenizer:
    """Ids of a byte-level BPE file of the `tokenizers` library, its special
    tokens recognised in texts as that library does by default."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = list(special)
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.encoding.encode(text, allowed_special="all")
        return self.encoding.encode_ordinary(text)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Packer:
    """Best-fit windows of one task. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int, windows: int):
        self.length, self.windows = length, windows
        self.open: list[tuple[int, list]] = []  # (room, pieces)

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list]:
        """Place a document; yields the sequences that are full."""
        at, n = 0, len(ids)
        while n - at >= self.length:
            yield [(doc_id, at, ids[at : at + self.length], n)]
            at += self.length
        while at < n:
            fits = [w for w in range(len(self.open)) if self.open[w][0] >= n - at]
            if fits:
                w, take = min(fits, key=lambda w: self.open[w][0]), n - at
            elif len(self.open) < self.windows:
                self.open.append((self.length, []))
                w, take = len(self.open) - 1, n - at
            else:  # the fullest window, filled to its end
                w = min(range(len(self.open)), key=lambda w: self.open[w][0])
                take = self.open[w][0]
            room, pieces = self.open[w]
            pieces.append((doc_id, at, ids[at : at + take], n))
            at += take
            if room == take:
                self.open.pop(w)
                yield pieces
            else:
                self.open[w] = (room - take, pieces)


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, windows: int = OPEN_WINDOWS, group: int = GROUP, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of
    each piece of a document in a sequence of at most `length` ids.

    A document is the ids of its whole text (null: none) and the end id 1, so
    every row has at least one piece; repeated rows are documents of their own.
    Only what many tasks leave open is padded: it is cut to whole sequences, and
    the last rest of a group to powers of two. A task holds one slice of texts
    and its open windows; ids don't leave it but for the leftovers.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = ByteTokenizer(tokenizer_path), Packer(length, windows)
        task, count, rows = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 9
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _stage_types)], _stage_names)
            rows.clear()
            return out

        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*tokenizer.ids(text or ""), END_ID], np.uint32)
                for pieces in packer.add(doc_id, ids):
                    offset = 0
                    for d, start, part, n in pieces:
                        rows.append((d, start, len(part), _crc(part), n, (task << 32) + count, offset, None, task))
                        offset += len(part)
                    count += 1
            yield flush()
        for w, (_, pieces) in enumerate(packer.open):
            rows += [(d, start, len(part), None, n, w, k, part.astype("<u4").tobytes(), task) for k, (d, start, part, n) in enumerate(pieces)]
        yield flush()

    _stage_types = (*[pa.int64()] * 7, pa.binary(), pa.int32())
    _stage_names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "task"]
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    stage = settled(texts.mapInArrow(placed, f"{_PIECES}, ids binary, task int"), "packed")

    def merged(left: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["task", "sequence_id", "offset"])
        base, rest, out = (int(left["task"].iloc[0]) << 32) + (1 << 31), int(left["length"].sum()), []
        sequence, room, size = 0, 0, 0
        for doc_id, start, ids, n in zip(left["doc_id"], left["start"], left["ids"], left["doc_tokens"]):
            ids = np.frombuffer(ids, "<u4")
            while len(ids):
                if not room:  # the next sequence: whole, or the largest power of two within the rest
                    size = room = length if rest >= length else 1 << (rest.bit_length() - 1)
                    sequence += 1
                part, ids = ids[:room], ids[room:]
                out.append((doc_id, start, len(part), _crc(part), n, base + sequence, size - room))
                start, room, rest = start + len(part), room - len(part), rest - len(part)
        frame = pd.DataFrame(out, columns=_stage_names[:7])
        return frame.astype({"doc_id": "Int64"})

    left = stage.where(F.col("ids").isNotNull())
    done = stage.where(F.col("ids").isNull()).drop("ids", "task")
    return done.unionByName(left.groupBy(F.floor(F.col("task") / group)).applyInPandas(merged, _PIECES))
