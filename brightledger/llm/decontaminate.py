"""Benchmark passages in documents, by a prefix-filtered join of shingles.

A benchmark item is cut into windows of consecutive words. A window occurs in a
document only if all its shingles do, so its necessary prefix is one shingle:
the rarest, counted over all documents. Places where a document holds a prefix
shingle give, by the shingle's place in the window, the one possible start;
starts outside the document are dropped and the rest is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightledger.llm.arrays import ALPHANUMERIC, LOWER, shingle_hashes, slices, text_bytes, word_bounds, word_hashes
from brightledger.llm.tables import settled, whole_row

WINDOW, SHINGLE = 10, 5
#: Windows that are broadcast at once (about 200 bytes each).
BLOCK_WINDOWS = 100_000


class Index:
    """One block of windows, and its prefix shingles."""

    def __init__(self, rows: list, shingle: int):
        """rows: (window as words joined by spaces, item ids), all distinct."""
        self.texts = [r[0].encode() for r in rows]
        self.items = [r[1] for r in rows]
        data = np.frombuffer(b"\n".join(self.texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in self.texts])]).astype(np.int64)
        offsets[-1] = len(data)
        starts, ends, self.sizes = word_bounds(data, offsets, ALPHANUMERIC)
        self.words = word_hashes(data, starts, ends)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.shingle_sizes = np.minimum(self.sizes, shingle)
        keys, windows, places = [], [], []
        for size in np.unique(self.shingle_sizes):
            hashes = shingle_hashes(self.words, int(size))
            for w in np.flatnonzero(self.shingle_sizes == size):
                n = int(self.sizes[w] - size + 1)
                keys.append(hashes[self.first[w] : self.first[w] + n])
                windows.append(np.full(n, w))
                places.append(np.arange(n))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.windows = np.concatenate(windows).astype(np.int64) if windows else np.zeros(0, np.int64)
        self.places = np.concatenate(places).astype(np.int64) if places else np.zeros(0, np.int64)
        self.distinct = np.unique(self.keys)

    def choose(self, counts: dict[int, int]) -> None:
        """Keep the rarest shingle of each window (of equal ones the least hash)."""
        n = np.array([counts.get(int(k), 0) for k in self.keys], np.int64)
        order = np.lexsort((self.keys, n, self.windows))
        order = order[np.unique(self.windows[order], return_index=True)[1]]
        order = order[np.argsort(self.keys[order], kind="stable")]
        self.keys, self.windows, self.places = self.keys[order], self.windows[order], self.places[order]
        self.distinct = np.unique(self.keys)


def _found(hashes: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Places of the hashes that are among the keys."""
    if not len(sorted_keys) or not len(hashes):
        return np.zeros(0, np.int64)
    at = np.searchsorted(sorted_keys, hashes)
    at[at == len(sorted_keys)] = 0
    return np.flatnonzero(sorted_keys[at] == hashes)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, counts = word_bounds(data, offsets, ALPHANUMERIC)
    return data, starts, ends, counts, word_hashes(data, starts, ends)


def windows_of(items: DataFrame, window: int = WINDOW, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Distinct windows (words joined by spaces) with their items' ids as texts,
    in order. An item of fewer words than a window, but at least one, is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, starts, ends, counts, _ = _words(batch.column(1))
            whole, ids, texts, at = data.tobytes(), [], [], 0
            for item, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                words = [whole[s:e].decode() for s, e in zip(starts[at : at + n].tolist(), ends[at : at + n].tolist())]
                at += n
                for i in range(max(1, n - window + 1) if n else 0):
                    ids.append(item)
                    texts.append(" ".join(words[i : i + window]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(ids, pa.string())], ["window", "item"])

    texts = items.select(F.col(id_column).cast("string").alias("item"), F.col(text_column).alias("text"))
    return texts.mapInArrow(cut, "window string, item string").groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def find_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", carry: bool = False) -> DataFrame:
    """doc id, text, n_words, spans (first word, end; merged where they touch)
    and items of each document, one row for each input row; with `carry` the
    input row as the struct `row`.

    Words are lower-cased `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; null texts and
    items have none. Windows are broadcast in blocks of bounded size; documents
    pass once for each block to count its shingles and once to be searched.
    They are never shuffled, and a task holds one slice of them.
    """
    windows = settled(windows_of(items, window, item_column, item_text), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    found = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.array().cast("array<string>").alias("items"),
        *([whole_row(docs)] if carry else []),
    )
    texts = docs.select(F.col(text_column).alias("text"))
    for block in range(blocks):
        rows = [(r.window, r["items"]) for r in windows.where(F.col("block") == block).orderBy("window").collect()]
        index = Index(rows, shingle)
        if rows:
            counts = texts.mapInArrow(_counter(index), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
            index.choose({int(np.int64(r.key).view(np.uint64)): r.n for r in counts})
        if block:
            found = settled(found, "block")
        found = found.mapInArrow(_searcher(index), found.schema)
    return found


def _counter(index: Index):
    """Counts the index's shingles in a task's texts."""
    distinct, sizes = index.distinct, [int(s) for s in np.unique(index.shingle_sizes)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(distinct), np.int64)
        for batch in slices(batches):
            _, _, _, counts, words = _words(batch.column(0))
            # A shingle that crosses texts counts as well; any order is right.
            for size in sizes:
                hashes = shingle_hashes(words, size)
                at = _found(hashes, distinct)
                total += np.bincount(np.searchsorted(distinct, hashes[at]), minlength=len(distinct))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(distinct[seen].view(np.int64)), pa.array(total[seen])], ["key", "n"])

    return count


def _searcher(index: Index):
    sizes = [int(s) for s in np.unique(index.shingle_sizes)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, starts, ends, counts, words = _words(batch.column(1))
            first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
            hits: dict[int, list[tuple[int, int, int]]] = {}
            whole = None
            for size in sizes:
                hashes = shingle_hashes(words, size)
                places = _found(hashes, index.distinct)
                left, right = (np.searchsorted(index.keys, hashes[places], side=s) for s in ("left", "right"))
                # Every window under the prefix shingle of each place.
                n = right - left
                at = np.repeat(places, n)
                entry = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
                win = index.windows[entry]
                start = at - index.places[entry]
                end = start + index.sizes[win]
                doc = np.searchsorted(first, at, side="right") - 1
                # By position and length, a window lies within one text.
                fits = (index.shingle_sizes[win] == size) & (start >= first[doc]) & (end <= first[doc + 1])
                for d, w, s, e in zip(doc[fits].tolist(), win[fits].tolist(), start[fits].tolist(), end[fits].tolist()):
                    if np.array_equal(words[s:e], index.words[index.first[w] : index.first[w + 1]]):
                        whole = data.tobytes() if whole is None else whole
                        if b" ".join(whole[a:b] for a, b in zip(starts[s:e].tolist(), ends[s:e].tolist())) == index.texts[w]:
                            hits.setdefault(d, []).append((s - int(first[d]), e - int(first[d]), w))
            spans, items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for d, found in hits.items():
                spans[d] = _merged([(x["start"], x["end"]) for x in spans[d]] + [(s, e) for s, e, _ in found])
                items[d] = sorted(set(items[d]) | {i for _, _, w in found for i in index.items[w]})
            spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts, pa.int64()), spans, pa.array(items, pa.list_(pa.string())), *batch.columns[5:]], batch.schema.names)

    return search


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each
    document, from `find_windows`."""
    found = find_windows(docs, items, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_join("items", ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
