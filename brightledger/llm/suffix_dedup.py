"""Repeated byte strings across documents, by merging Burrows-Wheeler transforms.

1. Every string of `length` bytes has a least hash among its substrings of
   `GRAM` bytes. Runs of neighbouring strings with the same least hash are a
   piece; equal strings lie in pieces of the same hash, so pieces are dealt by
   it. A piece equal to an earlier one is a repeat as a whole.
2. Where a hash has several different pieces, or a piece repeats within itself,
   the pieces are cut into shards. Each shard's rotations are sorted and give its
   transform; the transforms are merged by refining their interleave: each round
   sorts by some more leading bytes, in one stable distribution of the order so
   far. Bounds between blocks tell common prefixes; blocks left after `length`
   bytes are intervals of equal strings, all but the earliest of which are
   repeats. Suffixes are not sorted again.
3. The repeats of a document, merged, are its removed spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightledger.llm.arrays import mix, slices, text_bytes
from brightledger.llm.tables import settled, whole_row
from brightledger.llm.url_filter import bloom_blocks, possible

LENGTH = 100
GRAM = 32
#: Strings in one piece at most; longer runs are cut.
PIECE = 4096
#: Pieces that a task compares at once before it sends them on.
COMBINED = 500_000
#: Bytes of pieces that are merged at once, and shards they make.
BATCH_BYTES, SHARDS = 192 << 10, 4
#: A hash with more different pieces, or more bytes of them, is hot: its strings
#: are dealt one by one, not merged.
HOT_PIECES, HOT_BYTES = 2000, 512 << 10
#: Strings that a task compares at once before it sends them on.
HELD_STRINGS = 1 << 17

_ODD = np.random.default_rng(524287).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the `size` bytes (eight or more) from each place on."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    whole = padded.tobytes()
    words = np.empty(n, np.uint64)
    for k in range(8):
        words[k::8] = np.frombuffer(whole, "<u8", len(range(k, n, 8)), k)
    hashes = words[: n - size + 1] * _ODD[0]
    for k, at in enumerate([*range(8, size - 7, 8), *[size - 8] * (size % 8 > 0)], 1):
        hashes ^= words[at : at + len(hashes)] * _ODD[k % len(_ODD)] + np.uint64(k)
        hashes = (hashes << np.uint64(23)) | (hashes >> np.uint64(41))
    return mix(hashes)


# --- pieces --------------------------------------------------------------------


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Text, start in the bytes, number of strings, least hash, and whether the
    piece may repeat within itself, of all pieces of these texts."""
    n = len(data)
    span = length - GRAM + 1
    if n < length:
        return (*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64), np.zeros(0, bool))
    hashes = _hashes(data, GRAM)
    least, size = hashes, 1
    while 2 * size <= span:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    strings = n - length + 1
    least = np.minimum(least[:strings], least[span - size : span - size + strings])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:strings]
    whole_string = np.arange(strings) + length <= offsets[text + 1]
    first = whole_string.copy()
    first[1:] &= (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(first)
    # A run ends before the next one, or where strings would cross texts.
    ends = np.minimum(np.append(starts[1:], strings), offsets[text[starts] + 1] - length + 1)
    counts = ends - starts
    # Within a piece, equal strings need the least substring again at most `span`
    # later: at just `span`, each string holds one, and the run goes on.
    own = np.flatnonzero(whole_string & (hashes[:strings] == least))
    again = np.zeros(len(own), bool)
    for k in range(1, span + 1):
        at = np.minimum(own + k, len(hashes) - 1)
        again |= (hashes[at] == hashes[own]) & (at > own)
    twice = np.zeros(len(starts), bool)
    twice[np.searchsorted(starts, own[again], side="right") - 1] = True
    if (counts > PIECE).any():
        parts = -(-counts // PIECE)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, rest = np.repeat(starts, parts) + inner * PIECE, np.repeat(counts, parts) - inner * PIECE
        counts, twice = np.minimum(rest, PIECE), np.repeat(twice, parts)
    return text[starts], starts, counts, least[starts], twice


_PIECES = "bucket long, digest long, doc long, start long, n long, own boolean, covered boolean"
_NAMES = [c.split()[0] for c in _PIECES.split(", ")]


def _first_of_each(bucket, digest, doc, start) -> tuple[np.ndarray, np.ndarray]:
    """An order by (bucket, digest, doc, start), and by that order which rows
    have the least (doc, start) of their bucket and digest."""
    order = np.lexsort((start, doc, digest, bucket))
    b, g, d, s = bucket[order], digest[order], doc[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (g[1:] != g[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order, (d == d[head]) & (s == s[head])


def _cut(length: int):
    """Pieces of a task's texts. Of equal pieces that it sees together, only the
    earliest can be the first of all; the others are covered already."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            bucket, digest, doc, start, n, own = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order, first = _first_of_each(bucket, digest, doc, start)
            columns = [c[order] for c in (bucket, digest, doc, start, n, own)]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(~first)], _NAMES)

        for batch in slices(batches, limit=256 << 10):
            data, offsets = text_bytes(batch.column(1))
            text, starts, counts, least, twice = pieces(data, offsets, length)
            if len(text):
                whole = data.tobytes()
                digests = [xxhash.xxh3_64_intdigest(whole[s : s + n + length - 1]) for s, n in zip(starts.tolist(), counts.tolist())]
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                held.append([least.view(np.int64), np.array(digests, np.uint64).view(np.int64), ids[text], starts - offsets[text], counts, twice])
            if sum(len(h[0]) for h in held) >= COMBINED:
                yield flush()
        if held:
            yield flush()

    return cut


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ordered by (bucket, digest, doc, start): repeats of whole pieces
    as covered, and the first of each piece where the bucket has several pieces
    or the piece repeats itself. Only the last piece and whether its bucket had
    an earlier one are kept between batches. Rows covered already pass."""
    key = last = None  # (bucket, digest, doc, start) of the current first piece
    waiting = None  # its row, while it is the only piece of its bucket
    for batch in batches:
        known = batch.column(6).to_numpy(zero_copy_only=False).astype(bool)
        if known.any():
            yield batch.filter(pa.array(known))
            batch = batch.filter(pa.array(~known))
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        bucket, digest, doc, start, n, own, _ = columns
        new_bucket = np.ones(len(bucket), bool)
        new_bucket[1:] = bucket[1:] != bucket[:-1]
        new_bucket[0] = last is None or bucket[0] != last[0]
        new = new_bucket.copy()
        new[1:] |= digest[1:] != digest[:-1]
        new[0] = new[0] or digest[0] != last[1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(bucket)), -1))
        first_doc = np.where(head >= 0, doc[np.maximum(head, 0)], 0 if key is None else key[0])
        first_start = np.where(head >= 0, start[np.maximum(head, 0)], 0 if key is None else key[1])
        covered = (doc != first_doc) | (start != first_start)
        # A first piece is wanted if its bucket has another one.
        firsts = np.flatnonzero(new)
        opens = new_bucket[firsts]
        followed = np.append(~opens[1:], False)
        wanted = np.zeros(len(bucket), bool)
        wanted[firsts] = ~opens | followed | own[firsts]
        out = [c[covered | wanted] for c in columns[:6]] + [covered[covered | wanted]]
        if waiting is not None and len(firsts) and not opens[0]:
            out = [np.append(c, w) for c, w in zip(out, waiting)]
        if len(firsts):
            at = firsts[-1]
            key = (doc[at], start[at])
            waiting = None if wanted[at] else [c[at] for c in columns[:6]] + [False]
        last = (bucket[-1], digest[-1])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (*[pa.int64()] * 5, pa.bool_(), pa.bool_()))], _NAMES)


# --- transforms ------------------------------------------------------------------


def _ranks(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    values = values[order]
    new = np.ones(len(order), bool)
    new[1:] = values[1:] != values[:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new) - 1
    return ranks


def _in_order(ranks: np.ndarray) -> np.ndarray:
    """A stable order by small numbers, 16 bits at a time."""
    order, most, shift = np.argsort(ranks.astype(np.uint16), kind="stable"), int(ranks.max()), 16
    while most >> shift:
        order = order[np.argsort((ranks >> shift).astype(np.uint16)[order], kind="stable")]
        shift += 16
    return order


def _leading(text: np.ndarray, on: Callable[[int], np.ndarray], width: int) -> np.ndarray:
    """The ranks of all rotations by their `width` leading symbols (9 bits each).
    on: the places so many symbols on."""
    known = min(7, width)
    grams = text
    for k in range(1, known):
        grams = (grams << np.uint64(9)) | text[on(k)]
    rank = _ranks(grams)
    while known < width:
        more = min(known, width - known)
        rank = _ranks(rank * len(text) + rank[on(more)])
        known += more
    return rank


def shard_order(rank: np.ndarray, known: int, ahead: np.ndarray, length: int) -> np.ndarray:
    """The rotations of a shard's strings, in the order of at least `length`
    leading symbols; equal ones in the order of their places. Their ranks by
    `known` symbols and the places so many symbols on are given."""
    while known < length:
        rank = _ranks(rank * (int(rank.max()) + 1) + rank[ahead])
        known, ahead = 2 * known, ahead[ahead]
    return _in_order(rank)


def merged_blocks(strings: list[bytes], shards: int = SHARDS, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merged order of all rotations of the strings (each with an end mark):
    string and place of each, and the block of those whose first `length`
    symbols are equal.

    Strings are dealt to shards, whose rotations are sorted alone. A shard's
    transform holds, for each rotation, the symbols before it (a quarter of the
    length at once, as one rank). The interleave says which shard the
    next rotation comes from; it starts as one block and after each round is
    right by so many more leading symbols.
    """
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    ends = np.cumsum(sizes)
    text = np.zeros(int(ends[-1]), np.uint64)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint64) + np.uint64(1)
    places = np.arange(len(text))
    begins, size_of = np.repeat(ends - sizes, sizes), np.repeat(sizes, sizes)
    inner = places - begins

    def on(steps: int) -> np.ndarray:
        return begins + (inner + steps) % size_of

    width = -(-length // 4)
    rank = _leading(text, on, width)
    ahead = on(width)
    # Shards are runs of whole strings of about the same size.
    shard_of = np.minimum(ends * shards // (ends[-1] + 1), shards - 1)
    bounds = np.append(0, ends)[np.searchsorted(shard_of, np.arange(shards + 1))]
    orders = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if high > low:
            orders.append(shard_order(rank[low:high], width, ahead[low:high] - low, length) + low)
    order = np.concatenate(orders)
    interleave = np.repeat(np.arange(len(orders), dtype=np.uint8), [len(o) for o in orders])
    # A block is told by a bound at its first rotation.
    bound = np.zeros(len(order), bool)
    bound[0] = True
    left, transform = length, rank[on(-width)[order]]  # shard after shard
    while left:
        if left < width:
            width = left
            transform = _leading(text, on, width)[on(-width)[order]]
        # The next rotation of each shard, dealt out by the interleave.
        seen = np.empty_like(transform)
        seen[np.argsort(interleave, kind="stable")] = transform
        source = _in_order(seen)
        interleave, symbols = interleave[source], seen[source]
        block = np.cumsum(bound)[source]
        bound[1:] = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])
        left -= width
    merged = np.empty(len(order), np.int64)
    merged[np.argsort(interleave, kind="stable")] = order
    string = np.searchsorted(ends, merged, side="right")
    return string, merged - (ends - sizes)[string], np.cumsum(bound) - 1


def _shared(strings: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The parts of the strings whose `length`-byte strings have a hash that
    occurs twice; no others can be equal."""
    sizes = np.array([len(s) for s in strings], np.int64)
    whole = b"".join(strings)
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    at = np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    if not len(at):
        return [], docs[:0], starts[:0]
    values = _hashes(np.frombuffer(whole, np.uint8), length)[at]
    order = np.argsort(values)
    values = values[order]
    twice = np.zeros(len(at), bool)
    twice[1:] = values[1:] == values[:-1]
    twice[:-1] |= twice[1:]
    kept = np.zeros(len(at), bool)
    kept[order] = twice
    of, at = np.repeat(np.arange(len(strings)), counts)[kept], at[kept]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    of, low, n = of[first], at[first], np.diff(np.append(first, len(at)))
    cut = [whole[b : b + k + length - 1] for b, k in zip(low.tolist(), n.tolist())]
    return cut, docs[of], starts[of] + low - begins[of]


def repeats(strings: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of every `length`-byte string inside the strings that
    is also found at an earlier (document, start)."""
    strings, docs, starts = _shared(strings, docs, starts, length)
    if not strings:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    string, place, block = merged_blocks(strings, length=length)
    inside = place + length <= np.array([len(s) for s in strings])[string]
    doc, start, block = docs[string[inside]], starts[string[inside]] + place[inside], block[inside]
    order = np.lexsort((start, doc, block))
    doc, start, block = doc[order], start[order], block[order]
    new = np.ones(len(block), bool)
    new[1:] = block[1:] != block[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(block)), 0))
    later = (doc != doc[head]) | (start != start[head])
    return doc[later], start[later]


# --- Spark -----------------------------------------------------------------------


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, start and number of the runs that neighbouring strings make."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return doc[at], start[at], np.diff(np.append(at, len(doc)))


#: Pieces to merge have no digest, strings of hot buckets have one, and what is
#: covered already has no bytes.
_STRINGS = "bucket long, digest long, doc long, start long, n long, piece binary"


def _extract(length: int):
    """The bytes of wanted pieces; those of hot buckets string by string. Of
    equal strings that a task sees together, only the earliest can be the first
    of all; the others are covered already."""
    schema = pa.schema([*[(c, pa.int64()) for c in ("bucket", "digest", "doc", "start", "n")], ("piece", pa.binary())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple[int, int]] = {}  # (document, start) by string
        later: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            out = [(0, xxhash.xxh3_64_intdigest(x) - (1 << 63), doc, start, 1, x) for x, (doc, start) in first.items()]
            if later:
                out += [(0, None, doc, start, n, None) for doc, start, n in zip(*(c.tolist() for c in _runs(*np.array(later, np.int64).T)))]
            first.clear(), later.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in slices(batches):
            out = []
            for doc, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = text.encode()
                for w in wanted:
                    bucket, s, n = w["bucket"], w["start"], w["n"]
                    if not w["hot"]:
                        out.append((bucket, None, doc, s, n, data[s : s + n + length - 1]))
                        continue
                    for k in range(s, min(s + n, len(data) - length + 1)):
                        x, mine = data[k : k + length], (doc, k)
                        known = first.setdefault(x, mine)
                        if mine < known:
                            first[x] = mine
                            later.append(known)
                        elif mine > known:
                            later.append(mine)
                    if len(first) + len(later) >= HELD_STRINGS:
                        yield flush()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if first:
            yield flush()

    return extract


def _merge(length: int):
    """Repeats among the pieces of whole buckets, which come one after another,
    and among strings of hot buckets, of which equal ones follow each other by
    (document, start); of those only the last one is kept between batches."""
    names = ["doc", "start", "n"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings: list[bytes] = []
        docs: list[int] = []
        starts: list[int] = []
        size, key = 0, None
        last, head = b"", (0, 0)  # a hot string, and where it is first

        def flush() -> pa.RecordBatch:
            doc, start = repeats(strings, np.array(docs, np.int64), np.array(starts, np.int64), length)
            strings.clear(), docs.clear(), starts.clear()
            return pa.RecordBatch.from_arrays([*map(pa.array, _runs(doc, start))], names)

        for batch in slices(batches, "piece"):
            kept, single = batch.column(5).is_valid(), batch.column(1).is_valid()
            yield batch.filter(pc.invert(kept)).select(names)
            hot = batch.filter(single)
            if hot.num_rows:
                doc, start = (hot.column(i).to_numpy() for i in (2, 3))
                rows = text_bytes(hot.column(5))[0].reshape(-1, length)
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
                new[0] = rows[0].tobytes() != last
                at = np.maximum.accumulate(np.where(new, np.arange(len(rows)), -1))
                first_doc, first_start = np.where(at < 0, head[0], doc[at]), np.where(at < 0, head[1], start[at])
                covered = (doc != first_doc) | (start != first_start)
                last, head = rows[-1].tobytes(), (first_doc[-1], first_start[-1])
                yield pa.RecordBatch.from_arrays([*map(pa.array, _runs(doc[covered], start[covered]))], names)
            batch = batch.filter(pc.and_not(kept, single))
            for bucket, doc, start, piece in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 5))):
                if bucket != key and size >= BATCH_BYTES:
                    yield flush()
                    size = 0
                key = bucket
                strings.append(piece)
                docs.append(doc)
                starts.append(start)
                size += len(piece)
        if strings:
            yield flush()

    return merge


def _remove(length: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans, kept, clean = [], [], []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, mine, at, whole, parts = (text or "").encode(), [], 0, [], []
                for run in sorted((r["start"], r["start"] + r["n"] + length - 1) for r in runs or ()):
                    if mine and run[0] <= mine[-1][1]:
                        mine[-1] = (mine[-1][0], max(mine[-1][1], run[1]))
                    else:
                        mine.append(run)
                for start, end in mine:
                    parts.append(data[at:start])
                    at = end
                parts.append(data[at:])
                spans.append([{"start": s, "end": e} for s, e in mine])
                kept.append(b"".join(parts))
                # As text, a character goes if one of its bytes does.
                whole = [p.decode("utf-8", "ignore") for p in parts]
                clean.append("".join(whole))
            spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, pa.array(kept, pa.binary()), pa.array(clean, pa.string()), *batch.columns[3:]], ["doc", "spans", "kept", "kept_text", *batch.schema.names[3:]])

    return remove


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans (start, end; maximal removed runs of bytes), kept
    (the remaining bytes), kept_text (as text, without characters of which a
    byte was removed) of each row; with `carry` the input's other columns as the
    struct `row`.

    A byte is removed if a `length`-byte string over it also starts earlier: in
    a document of smaller id, or earlier in the same one; strings are judged on
    the input. Null texts are empty. Rows that share an id count as the same
    document and must share the text; they don't remove each other. Rows
    without an id count as one document before all others. Hashes only decide
    where strings meet and, with 128 bits of hash and digest, which whole pieces
    are equal; different pieces are compared by their bytes.
    """
    least = F.lit(-(2**63)).cast("long")
    keyed = docs.select(F.coalesce(F.col(id_column).cast("long"), least).alias("doc"), F.col(text_column).alias("text"))
    whole = docs.select(F.coalesce(F.col(id_column).cast("long"), least).alias("doc"), F.col(text_column).alias("text"), whole_row(docs.drop(text_column))) if carry else keyed
    row = ["row"] if carry else []
    cut = keyed.mapInArrow(_cut(length), _PIECES)
    # What is covered already goes anywhere, so hot pieces don't meet.
    place = F.when(F.col("covered"), F.xxhash64("doc", "start")).otherwise(F.col("bucket"))
    dealt = cut.repartition(place).sortWithinPartitions("bucket", "digest", "doc", "start")
    found = settled(dealt.mapInArrow(_sorted_out, _PIECES), "sorted")
    wanted = found.where("not covered").select("bucket", "doc", "start", "n")
    large = (F.count(F.lit(1)) > HOT_PIECES) | (F.sum(F.col("n") + length - 1) > HOT_BYTES)
    hot = settled(wanted.groupBy("bucket").agg(large.alias("hot")).where("hot"), "hot")
    wanted = wanted.join(hot, "bucket", "left").withColumn("hot", F.col("hot").isNotNull())
    of_doc = settled(wanted.groupBy("doc").agg(F.collect_list(F.struct("bucket", "start", "n", "hot")).alias("wanted")), "wanted")
    texts = possible(keyed.where("text is not null"), "doc", bloom_blocks(of_doc.select("doc"), "doc"))
    strings = texts.join(of_doc, "doc").select("doc", "text", "wanted").mapInArrow(_extract(length), _STRINGS)
    # Pieces of a bucket meet, of a hot one only equal strings; the rest goes anywhere.
    place = F.when(F.col("piece").isNull(), F.xxhash64("doc", "start")).otherwise(F.coalesce("digest", "bucket"))
    groups = strings.repartition(place).sortWithinPartitions("bucket", "digest", "piece", "doc", "start")
    apart = settled(groups.mapInArrow(_merge(length), "doc long, start long, n long"), "repeats")
    covered = found.where("covered").select("doc", "start", "n").unionByName(apart)
    runs = settled(covered.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("runs")), "runs")
    # Documents that surely have no repeat are not shuffled.
    touched = bloom_blocks(runs.select("doc"), "doc")
    none = F.lit(None).cast("array<struct<start:long,n:long>>").alias("runs")
    free = possible(whole, "doc", touched, without=True).select("doc", "text", none, *row)
    joined = possible(whole, "doc", touched).join(runs, "doc", "left").select("doc", "text", "runs", *row)
    schema = T.StructType.fromDDL("doc long, spans array<struct<start:long,end:long>>, kept binary, kept_text string")
    if carry:
        schema = schema.add("row", joined.schema["row"].dataType)
    done = joined.unionByName(free).mapInArrow(_remove(length), schema)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select(F.when(F.col("doc") != least, F.col("doc")).alias("doc_id"), (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), "spans", "kept", "kept_text", *row)


def repeat_counts(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 from `remove_repeats`."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    done = remove_repeats(docs, **options)
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
