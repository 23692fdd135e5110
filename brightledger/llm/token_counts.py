"""Token counts of a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton lists all vocabulary matches that end at a place, from
the longest to the shortest; dynamic programming carries the best score and the
number of pieces. Ties, unknown characters and byte fallback follow the
`tokenizers` library's Unigram model with a Metaspace pre-tokenizer.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightledger.llm.arrays import slices

SPACE = "▁"
#: What an unknown character scores below the lowest score (fixed value).
UNKNOWN_PENALTY = 10.0
#: Counts of words that a task remembers; it starts anew beyond.
CACHED_WORDS = 500_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in the order of their ids."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Pieces of each word that a Unigram model would give."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: str = "<unk>"):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score, piece == unknown))
        self.automaton.make_automaton()
        self.unknown_score = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in pieces}

    def count(self, word: str) -> int:
        """Pieces of one pre-token: the best sum of scores, the earliest start
        of the last piece among equal ones. Unknown characters next to each
        other are one unknown piece, or their bytes if the vocabulary has all."""
        n = len(word)
        ends: list[list] = [[] for _ in range(n + 1)]
        for last, (length, score, _) in self.automaton.iter(word):
            ends[last + 1].append((length, score))
        best, number, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top, from_, is_unknown, known = None, end - 1, False, False
            for length, score in ends[end]:  # the longest first
                known |= length == 1
                value = best[end - length] + score
                if top is None or value > top:
                    top, from_, is_unknown = value, end - length, False
            if not known:
                value = best[end - 1] + self.unknown_score
                if top is None or value > top:
                    top, from_, is_unknown = value, end - 1, True
            best[end], unknown[end] = top, is_unknown
            if not is_unknown:
                number[end] = number[from_] + 1
            elif self.bytes:
                number[end] = number[from_] + len(word[end - 1].encode())
            else:
                number[end] = number[from_] + (not unknown[from_])
        return number[n]

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n

    def text(self, text: str) -> int:
        """Tokens of a text: each space begins a word, as does the text."""
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        words = text.split(SPACE)
        # With a leading space, the part before it is empty and no word.
        first = words[1:] if text[0] == SPACE else words
        return sum(map(self.__getitem__, [SPACE + w for w in first]))


def count_tokens(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens of every whole text (null and empty: 0), one row
    for each input row, repeats too. Nothing is shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(vocabulary_path))
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(map(counter.text, texts), pa.int64())], [id_column, "n_bytes", "n_tokens"]
            )

    texts = docs.select(F.col(id_column).cast("long").alias(id_column), F.col(text_column).alias("text"))
    return texts.mapInArrow(counted, f"`{id_column}` long, n_bytes long, n_tokens long")
