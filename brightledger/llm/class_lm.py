"""Class-based n-gram scores: classes by exchange, smoothed by counts.

Texts become chunks of word numbers with a dictionary each, so a word is sent
once for a chunk and not once for a token. Every word of at least `LEAST`
training tokens is assigned to a class by exchange: each round counts every
word's neighbours by class over all training tokens, and moves the word to the
class that gains most, until few words move. Words are kept in buckets of
their hashes; a chunk knows its words by their places there, so rounds send
places, classes and counts, squeezed, and no words. No task and not the driver
holds the vocabulary. Words below `LEAST` are one class of rare words, with room
for unknown ones. A token's probability is that of its class after the classes
before it, times that of the word in its class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightledger.llm.arrays import LOWER, SPACED, slices, text_bytes, word_bounds, word_hashes
from brightledger.llm.tables import settled
from brightledger.session import work_folder

#: Classes at least; a large vocabulary has the fourth root of its words.
CLASSES = 32
#: Words of fewer training tokens, at any size of the input, are rare.
LEAST = 2
#: Rounds end when two (each word has one turn) move less than one word in `FEW`.
#: (Their gain is no measure: rare words add little to the likelihood of all.)
FEW = 10
#: Words in a bucket, about.
BUCKET_WORDS = 8192
#: Tokens in a chunk at least, but for a task's last.
CHUNK_TOKENS = 1 << 20
#: Chunks whose counts for a bucket meet in one task.
PART_CHUNKS = 256
#: Added to each count of a word, and of a class after another.
ADDED, ADDED_CLASS = 0.1, 0.1

_CHUNKS = "chunk long, doc_id binary, known_id binary, held binary, n_tokens binary, words array<long>, counts array<long>, tokens binary, ends long"
_WORDS = "bucket long, words binary, counts binary"
_STATE = "bucket long, classes binary, moved long"
_MET = "bucket long, kind int, chunk long, places binary, one binary, two binary, three binary"
_SUMS = "bucket long, classes binary, per binary, codes binary, sums binary"


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers from 0 up in the least width that holds them all; many small
    arrays leave a task, and the shuffle compresses them together."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _spread(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def _compressed(tokens: np.ndarray) -> bytes:
    """The tokens of a chunk, which travel each round."""
    raw = tokens.astype("<u4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _steps(places: np.ndarray) -> bytes:
    """Places in ascending order, by their distances."""
    return _squeezed(np.diff(places, prepend=0))


def _places(data: bytes) -> np.ndarray:
    return np.cumsum(_spread(data), dtype=np.int64)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training (null counts as an empty id)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a task's texts: ids, tokens of each document, distinct words
    with their training counts, and each token's number among them. The end of
    a document has the number after the last word."""
    task, made = TaskContext.get().partitionId(), 0
    ids: list[int | None] = []
    numbers: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    size = 0

    def close() -> pa.RecordBatch:
        counts = np.concatenate(numbers).astype(np.int64)
        words, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        held = np.array([held_out(i) for i in ids], bool)
        train = ~np.repeat(held, counts)
        seen = np.bincount(inverse[train], minlength=len(words))
        # An end after each document's words.
        tokens = np.insert(inverse.astype(np.uint32), np.cumsum(counts), len(words))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(task << 32) + made], pa.int64()), pa.array([np.array([i or 0 for i in ids], np.int64).tobytes()]), pa.array([np.array([i is not None for i in ids], bool).tobytes()]),
                pa.array([held.tobytes()]), pa.array([(counts + 1).tobytes()]), pa.array([words.view(np.int64)], pa.list_(pa.int64())), pa.array([seen], pa.list_(pa.int64())),
                pa.array([_compressed(tokens)]), pa.array([int(np.count_nonzero(~held))], pa.int64()),
            ],
            [c.split()[0] for c in _CHUNKS.split(", ")],
        )

    for batch in slices(batches):
        data, offsets = text_bytes(batch.column(1))
        data = LOWER[data]
        starts, ends, counts = word_bounds(data, offsets, SPACED)
        ids += batch.column(0).to_pylist()
        numbers.append(counts)
        hashes.append(word_hashes(data, starts, ends))
        size += len(starts) + len(counts)
        if size >= CHUNK_TOKENS:
            yield close()
            made, size = made + 1, 0
            ids, numbers, hashes = [], [], []
    if ids:
        yield close()


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, tokens of each document, and which documents are held out."""
    raw = row["tokens"]
    tokens = np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd"), "<u4")
    return tokens.astype(np.int64), np.frombuffer(row["n_tokens"], np.int64), np.frombuffer(row["held"], bool)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dicts; lists stay arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            values = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            yield {name: _array(v) if isinstance(v, pa.ListScalar) and pa.types.is_integer(v.type.value_type) else v.as_py() for name, v in values.items()}


def _array(value: pa.ListScalar) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.zeros(0, np.int64)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    columns = zip(*rows) if rows else [()] * len(_names(schema))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(columns, schema.split(", "))], _names(schema))


def _ranges(bucket: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal buckets."""
    cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)])) if len(bucket) else []


def _bucket(words: np.ndarray, bits: int) -> np.ndarray:
    return (words >> np.uint64(64 - bits)).astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket, of rows ordered by (bucket, word)."""
    key, held = None, []

    def close() -> pa.RecordBatch:
        words, n = (np.concatenate(c) for c in zip(*held))
        held.clear()
        return _batch([(key, words.tobytes(), n.tobytes())], _WORDS)

    for batch in batches:
        bucket, word, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for low, high in _ranges(bucket):
            if held and bucket[low] != key:
                yield close()
            key = int(bucket[low])
            held.append((word[low:high].astype(np.int64).view(np.uint64), n[low:high].astype(np.int64)))
    if held:
        yield close()


def _first_classes(classes: int, least: int):
    """A class for each word by its hash."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, n = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["counts"], "<i8")
            mine = np.where(n >= least, (words >> np.uint64(7)) % np.uint64(classes), classes)
            yield _batch([(row["bucket"], _squeezed(mine), 0)], _STATE)

    return first


def _met(words: DataFrame, columns: list[str], rows: DataFrame) -> DataFrame:
    """The row of each bucket, and after it the rows that ask for it."""
    none = F.lit(None).cast("binary")
    given = [F.col(c) for c in columns] + [none] * (3 - len(columns))
    held = words.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("chunk"), none.alias("places"), *[v.alias(n) for v, n in zip(given, ("one", "two", "three"))])
    return held.unionByName(rows).repartition("bucket").sortWithinPartitions("bucket", "kind")


def _asked(chunks: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """(bucket, kind, chunk, places, one): for each chunk and bucket which of the
    chunk's words the bucket has (one, as flags), and their places there."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            mine = row["words"].view(np.uint64)
            bucket = _bucket(mine, bits)
            yield _batch([(int(bucket[i]), 1, row["chunk"], None, mine[i:j].tobytes(), None, None) for i, j in _ranges(bucket)], _MET)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for row in _rows([batch]):
                mine = np.frombuffer(row["one"], "<u8")
                if row["kind"] == 0:
                    key, known = row["bucket"], mine
                    continue
                here = known if row["bucket"] == key else known[:0]
                at = np.searchsorted(here, mine)
                there = np.zeros(len(mine), bool)
                inside = at < len(here)
                there[inside] = here[at[inside]] == mine[inside]
                out.append((row["bucket"], 1, row["chunk"], _steps(at[there]), _squeezed(np.packbits(there)) + len(mine).to_bytes(4, "little"), None, None))
            yield _batch(out, _MET)

    return _met(words, ["words"], chunks.select("chunk", "words").mapInArrow(ask, _MET)).mapInArrow(answer, _MET)


def _size(data: bytes) -> int:
    return int.from_bytes(data[-4:], "little")


def _flags(data: bytes) -> np.ndarray:
    return np.unpackbits(_spread(data[:-4]), count=_size(data)).astype(bool)


def _answers(asked: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """For each chunk, bucket by bucket, what the bucket has of its words: the
    classes, and the counts if `columns` name them."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, of_word, n = None, np.zeros(0, "<i2"), np.zeros(0, "<i8") if len(columns) > 1 else None
        for batch in batches:
            out = []
            for row in _rows([batch]):
                if row["kind"] == 0:
                    key, of_word = row["bucket"], _spread(row["one"])
                    n = np.frombuffer(row["two"], "<i8") if len(columns) > 1 else None
                    continue
                at = _places(row["places"]) if row["bucket"] == key else np.zeros(0, np.int64)
                out.append((row["chunk"], row["bucket"], _squeezed(of_word[at]), _squeezed(n[at]) if n is not None else None))
            yield _batch(out, "chunk long, bucket long, classes binary, uses binary")

    sent = _met(state, columns, asked).mapInArrow(answer, "chunk long, bucket long, classes binary, uses binary")
    return sent.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "classes", "uses"))).alias("answers"))


def _known(row: dict) -> np.ndarray:
    """Which words of a chunk are in the vocabulary."""
    found = [_flags(p["flags"]) for p in row["places"] or ()]
    return np.concatenate(found) if found else np.zeros(0, bool)


def _classes(row: dict, classes: int) -> np.ndarray:
    """The class of each word of a chunk (words without training tokens are
    rare); last, that of an end."""
    known = _known(row)
    out = np.full(len(known) + 1, classes, np.int16)
    found = [_spread(a["classes"]) for a in row["answers"] or ()]
    out[:-1][known] = np.concatenate(found) if found else 0
    out[-1] = classes + 1
    return out


def _sparse(table: np.ndarray) -> tuple[np.ndarray, bytes, bytes, bytes]:
    """Rows of a table that are not empty: their numbers, and squeezed how many
    values each has, at which codes, and the values."""
    at, codes = np.nonzero(table)
    seen, per = np.unique(at, return_counts=True)
    return seen, _squeezed(per), _squeezed(codes), _squeezed(table[at, codes])


def _add(table: np.ndarray, row: dict) -> None:
    table[np.repeat(_places(row["places"]), _spread(row["one"])), _spread(row["two"])] += _spread(row["three"]).astype(np.int64)


def _neighbours(classes: int):
    """For each word that has a class, how often each class stands before and
    after it in the training tokens of a chunk, packed by bucket."""
    wide, block = classes + 2, 1 << 15

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            tokens, sizes, held = _tokens(row)
            known, found = _known(row), [_places(p["places"]) for p in row["places"] or ()]
            if not len(known):
                continue
            placed = np.zeros(len(known), np.int64)
            placed[known] = np.concatenate(found)
            state = _classes(row, classes)[tokens]
            use = (state < classes) & ~np.repeat(held, sizes)
            place = tokens[use]
            before = np.append(np.int16(classes + 1), state[:-1])[use]
            after = np.append(state[1:], np.int16(classes + 1))[use] + np.int16(wide)
            del tokens, state, use
            entries = []
            for low in range(0, len(known), block):
                here = (place >= low) & (place < low + block)
                at = (place[here] - low) * (2 * wide)
                table = np.bincount(at + before[here], minlength=2 * wide * min(block, len(known) - low))
                table += np.bincount(at + after[here], minlength=len(table))
                filled = np.flatnonzero(table)
                entries.append((filled // (2 * wide) + low, filled % (2 * wide), table[filled]))
            at, codes, n = (np.concatenate(c) for c in zip(*entries))
            seen, first = np.unique(at, return_index=True)
            first, out, low = np.append(first, len(at)), [], 0
            for part in row["places"]:
                size = _size(part["flags"])
                i, j = np.searchsorted(seen, (low, low + size))
                low += size
                if i < j:
                    cut = slice(first[i], first[j])
                    out.append((part["bucket"], 1, row["chunk"], _steps(placed[seen[i:j]]), _squeezed(np.diff(first[i : j + 1])), _squeezed(codes[cut]), _squeezed(n[cut])))
            yield _batch(out, _MET)

    return count


def _combined(classes: int, parts: int):
    """The sums of the rows of each bucket and part of the chunks."""
    wide = classes + 2

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table = None, None

        def close() -> pa.RecordBatch:
            found, *packed = _sparse(table)
            return _batch([(key[0], 1, key[1], _steps(found), *packed)], _MET)

        for row in _rows(batches):
            here = row["bucket"], row["chunk"] % parts
            if here != key:
                if key is not None:
                    yield close()
                key, table = here, np.zeros((0, 2 * wide), np.int64)
            last = int(_places(row["places"])[-1]) + 1
            if last > len(table):
                table = np.concatenate([table, np.zeros((last - len(table), 2 * wide), np.int64)])
            _add(table, row)
        if key is not None:
            yield close()

    return combine


def _summed(classes: int):
    """Each bucket's words with the sums of their neighbours; in the bucket -1,
    those of a task's words class by class."""
    wide = classes + 2

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, bucket, mine, table = np.zeros((classes, 2 * wide), np.int64), None, None, None

        def close() -> pa.RecordBatch:
            for k in range(classes):
                pairs[k] += table[mine == k].sum(axis=0)
            at, codes = np.nonzero(table)
            per = np.bincount(at, minlength=len(mine))
            return _batch([(bucket, _squeezed(mine), _squeezed(per), _squeezed(codes), _squeezed(table[at, codes]))], _SUMS)

        for row in _rows(batches):
            if row["kind"] == 0:
                if bucket is not None:
                    yield close()
                bucket, mine = row["bucket"], _spread(row["one"])
                table = np.zeros((len(mine), 2 * wide), np.int64)
            else:
                _add(table, row)
        if bucket is not None:
            yield close()
        yield _batch([(-1, None, None, None, pairs.tobytes())], _SUMS)

    return total


def _exchange(chunks: DataFrame, asked: DataFrame, state: DataFrame, classes: int, turn: int, parts: int) -> tuple[DataFrame, float, int]:
    """One round: half of the words, another half each time, may change. Also
    the log likelihood of the classes before it, and how many words moved."""
    wide, spark = classes + 2, chunks.sparkSession
    asking = chunks.select("chunk", "tokens", "n_tokens", "held", "places").join(_answers(asked, state, ["classes"]), "chunk", "left")
    counted = asking.mapInArrow(_neighbours(classes), _MET)
    if parts > 1:
        # Counts of many chunks for a bucket are summed up in parts first.
        part = F.pmod(F.xxhash64("chunk"), F.lit(parts))
        counted = counted.withColumn("chunk", part).repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk").mapInArrow(_combined(classes, parts), _MET)
    folder = work_folder(spark, "neighbours")
    _met(state, ["classes"], counted).mapInArrow(_summed(classes), _SUMS).write.parquet(folder)
    summed = spark.read.schema(_SUMS).parquet(folder)
    pairs = np.zeros((classes, 2 * wide))  # class by class
    for row in summed.where("bucket < 0").select("sums").toLocalIterator():
        pairs += np.frombuffer(row[0], np.int64).reshape(pairs.shape)
    before, after = pairs[:, :wide], pairs[:, wide:]
    size = after.sum(axis=1)
    logs = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    likelihood = logs(after) + logs(before[:, classes:]) - 2 * logs(size)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            mine = _spread(row["classes"]).astype(np.int64)
            own = np.zeros((len(mine), 2 * wide))
            own[np.repeat(np.arange(len(mine)), _spread(row["per"])), _spread(row["codes"])] = _spread(row["sums"])
            # Places follow the words' hashes, so either half is any half.
            free = np.flatnonzero((mine < classes) & (np.arange(len(mine)) % 2 == turn % 2))
            own, k = own[free], mine[free]
            n, uses = own[:, wide:].sum(axis=1), own.sum(axis=1)
            gains = own @ np.log(pairs + 0.5).T - uses[:, None] * np.log(size + 1)
            # Without the word itself in its present class.
            rest = np.log(np.maximum(pairs[k] - own, 0) + 0.5)
            gains[np.arange(len(k)), k] = (own * rest).sum(axis=1) - uses * np.log(np.maximum(size[k] - n, 0) + 1)
            new = mine.copy()
            new[free] = gains.argmax(axis=1) if len(free) else k
            yield _batch([(row["bucket"], _squeezed(new), int(np.count_nonzero(new != mine)))], _STATE)

    new = settled(summed.where("bucket >= 0").mapInArrow(move, _STATE), "classes")
    # The sums of this round are not read again.
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return new, likelihood, new.agg(F.sum("moved")).first()[0] or 0


def _exchanged(chunks: DataFrame, asked: DataFrame, state: DataFrame, words: int, classes: int, rounds: int | None) -> DataFrame:
    """Rounds until two move less than one word in `FEW`, or leave the likelihood
    below what it was (words that move at once may undo each other, most of all
    in the first rounds, of which there are five at least); at most `rounds`,
    if given."""
    parts, seen, moves = -(-chunks.count() // PART_CHUNKS), [], []
    while rounds is None or len(seen) < rounds:
        state, likelihood, moved = _exchange(chunks, asked, state, classes, len(seen), parts)
        seen.append(likelihood)
        moves.append(moved)
        if len(seen) > 4 and (sum(moves[-2:]) * FEW < words or max(seen[-2:]) <= max(seen[:-2])):
            break
    return state


def _contexts(state: np.ndarray, classes: int) -> np.ndarray:
    """What stands before each token: the last class that is not rare, and
    whether rare words stand between. A document begins after an end."""
    places = np.arange(len(state))
    last = np.maximum.accumulate(np.where(state != classes, places, -1))
    before = np.append(-1, last[:-1])
    kind = np.where(before >= 0, state[np.maximum(before, 0)], classes + 1)
    kind = np.where(kind == classes + 1, classes, kind)
    return 2 * kind + (before < places - 1)


def _transitions(classes: int):
    wide, contexts = classes + 2, 2 * (classes + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(contexts * wide, np.int64)
        for row in _rows(batches):
            tokens, sizes, held = _tokens(row)
            state = _classes(row, classes)[tokens].astype(np.int64)
            use = ~np.repeat(held, sizes)
            total += np.bincount((_contexts(state, classes) * wide + state)[use], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pair", "n"])

    return count


def _class_sums(classes: int):
    """Words and training tokens of each class among a task's buckets."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, total = np.zeros(classes + 1, np.int64), np.zeros(classes + 1, np.int64)
        for row in _rows(batches):
            mine = _spread(row["classes"])
            kinds += np.bincount(mine, minlength=classes + 1)
            np.add.at(total, mine, np.frombuffer(row["counts"], "<i8"))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes + 1)), pa.array(kinds), pa.array(total)], ["class", "kinds", "n"])

    return add


@dataclass
class ClassModel:
    """Chunks of all texts (with the places of their words), the vocabulary by
    buckets, and the classes of its words."""

    chunks: DataFrame
    asked: DataFrame
    words: DataFrame
    state: DataFrame
    classes: int
    ends: int  # training documents
    tokens: int  # training tokens, ends included
    kinds: int  # distinct words, and the end if there is one

    def of_words(self) -> DataFrame:
        """(word, n, class) of the vocabulary, words by their hashes; the class
        after the last is that of rare words."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["words"], "<i8")), pa.array(np.frombuffer(row["counts"], "<i8")), pa.array(_spread(row["classes"]).astype(np.int64))], ["word", "n", "class"])

        return self.words.join(self.state, "bucket").mapInArrow(spread, "word long, n long, class long")


def train_classes(docs: DataFrame, classes: int | None = None, rounds: int | None = None, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text") -> ClassModel:
    """Classes of the words of training documents, those whose crc32 of the id
    as text isn't divisible by ten."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    chunks = settled(texts.mapInArrow(_chunked, _CHUNKS), "chunks")
    counted = chunks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    vocabulary = settled(counted.where("n > 0").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    ends = chunks.agg(F.sum("ends")).first()[0] or 0
    kinds, in_words = vocabulary.agg(F.count(F.lit(1)), F.sum("n")).first()
    classes = classes or max(CLASSES, round(kinds**0.25))
    bits = max(1, (kinds // BUCKET_WORDS).bit_length())
    placed = vocabulary.select(F.shiftrightunsigned("word", 64 - bits).alias("bucket"), "word", "n")
    words = settled(placed.repartition("bucket").sortWithinPartitions("bucket", "word").mapInArrow(_packed, _WORDS), "words")
    asked = settled(_asked(chunks, words, bits), "asked")
    of_chunk = asked.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "places", F.col("one").alias("flags")))).alias("places"))
    chunks = settled(chunks.drop("words", "counts", "ends").join(of_chunk, "chunk", "left"), "placed")
    asked = asked.withColumn("one", F.lit(None).cast("binary"))
    state = settled(words.mapInArrow(_first_classes(classes, least), _STATE), "classes")
    if kinds:
        state = _exchanged(chunks, asked, state, kinds, classes, rounds)
    return ClassModel(chunks, asked, words, state, classes, ends, (in_words or 0) + ends, kinds + (ends > 0))


def score_documents(docs: DataFrame, classes: int | None = None, rounds: int | None = None, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed
    unigrams) and score (the class model), both log10 probabilities of the whole
    text and its end. One row for each input row.

    Words are `[^\\x20\\x09-\\x0D]+` of lower-cased (A-Z) texts, told apart by
    64-bit hashes; null texts have only an end. Training documents are those
    whose crc32 of the id as text isn't divisible by ten. Without training
    tokens every score is that of an empty model, never an error. The driver
    gets tables of class pairs, no words.
    """
    model = train_classes(docs, classes, rounds, least, id_column, text_column)
    classes, chunks, ends, total = model.classes, model.chunks, model.ends, model.tokens
    known = settled(_answers(model.asked, model.words.join(model.state, "bucket"), ["classes", "counts"]), "answers")
    wide, contexts = classes + 2, 2 * (classes + 1)
    pairs = np.zeros(contexts * wide)
    answered = chunks.join(known, "chunk", "left")
    for pair, n in answered.select("chunk", "tokens", "n_tokens", "held", "places", "answers").mapInArrow(_transitions(classes), "pair long, n long").groupBy("pair").agg(F.sum("n")).collect():
        pairs[pair] = n
    pairs = pairs.reshape(contexts, wide) + ADDED_CLASS
    transitions = np.log10(pairs / pairs.sum(axis=1, keepdims=True))
    sums = np.zeros((classes + 1, 2))
    for k, *each in model.words.join(model.state, "bucket").mapInArrow(_class_sums(classes), "class long, kinds long, n long").groupBy("class").agg(F.sum("kinds"), F.sum("n")).collect():
        sums[k] = each
    # Of rare words with room for an unknown one; an end is the only one of its class.
    of_class = np.append(np.log10(np.maximum(sums[:, 1], 1)), 0)
    of_class[classes] = np.log10(sums[classes, 1] + ADDED * (sums[classes, 0] + 1))
    whole = np.log10(total + ADDED * (model.kinds + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            tokens, sizes, held = _tokens(row)
            of_word = _classes(row, classes).astype(np.int64)
            state = of_word[tokens]
            n = np.zeros(len(of_word), np.int64)
            uses = [_spread(a["uses"]) for a in row["answers"] or ()]
            n[:-1][_known(row)] = np.concatenate(uses) if uses else 0
            n[-1] = ends
            base = np.log10(n + ADDED) - whole
            word = np.log10(np.where(of_word == classes, n + ADDED, n + (n == 0))) - of_class[of_word]
            word[-1] = 0
            starts = np.cumsum(sizes) - sizes
            after = transitions[_contexts(state, classes), state]
            ids = np.ma.masked_array(np.frombuffer(row["doc_id"], np.int64), ~np.frombuffer(row["known_id"], bool))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids.filled(0), pa.int64(), mask=np.ma.getmaskarray(ids)), pa.array(held), pa.array(sizes), pa.array(np.add.reduceat((n > 0)[tokens].astype(np.int64), starts)),
                    pa.array(np.full(len(sizes), total, np.int64)), pa.array(np.add.reduceat(base[tokens], starts)), pa.array(np.add.reduceat(word[tokens] + after, starts)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return answered.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
