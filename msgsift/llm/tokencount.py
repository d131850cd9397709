"""Unigram token counts by a count-only Viterbi pass.

An Aho-Corasick automaton over the vocabulary names every piece that ends at a
position; dynamic programming keeps, per position, only the best score and its
number of pieces. No token list is built. Ties follow the tokenizer library's
lattice: at equal score the piece that begins first stays. A character that is
no piece gets the lowest score minus 10 and counts as its UTF-8 bytes (byte
fallback). Spaces become the word mark, which only begins pieces, so a text's
best segmentation is that of its words; counts of frequent words are kept in a
bounded cache per task.

Vocabulary: the pieces and scores of a public SentencePiece file (its path is a
parameter), read as a unigram model; nothing is trained. Every task reads that
file by itself.

Defined cases
    null or empty text: 0 tokens, score 0. very long texts: whole, word by word.
    ties: as above. repeated rows and null ids: counted like any row. empty table: no rows.
"""

from __future__ import annotations

from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 150_000


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece file, in id order."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


class UnigramCounter(dict):
    """word -> (pieces, score); fills itself, and starts anew when it holds ``CACHE_WORDS`` words."""

    def __init__(self, vocabulary: list[tuple[str, float]], cache_words: int = CACHE_WORDS):
        super().__init__()
        import ahocorasick
        self.auto = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.singles = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.cache_words = cache_words

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= self.cache_words:
            self.clear()
        out = self.segment(MARK + word)
        if len(word) <= 64:
            self[word] = out
        return out

    def segment(self, s: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of ``s``."""
        n = len(s)
        score, count = [0.0] + [-inf] * n, [0] * (n + 1)
        if self.singles.issuperset(s):       # every place can be reached, so matches are used as they come
            for end, (length, v) in self.auto.iter(s):       # by end, the earliest beginning first
                start = end + 1 - length
                c = score[start] + v
                if c > score[end + 1]:
                    score[end + 1], count[end + 1] = c, count[start] + 1
            return count[n], score[n]
        ends: list[list] = [[] for _ in range(n)]
        for end, hit in self.auto.iter(s):
            ends[end].append(hit)
        for e in range(n):
            best, pieces = -inf, 0
            for length, v in ends[e]:
                c = score[e + 1 - length] + v
                if c > best:
                    best, pieces = c, count[e + 1 - length] + 1
            if s[e] not in self.singles:
                c = score[e] + self.unknown
                if c > best:
                    best, pieces = c, count[e] + len(s[e].encode("utf-8", "surrogatepass"))
            score[e + 1], count[e + 1] = best, pieces
        return count[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(MARK, " ")
        words = (text[1:] if text[0] == " " else text).split(" ")
        pieces, score = 0, 0.0
        for p, v in map(self.__getitem__, words):
            pieces += p
            score += v
        return pieces, score


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score: tokens of each whole text and the best segmentation's score."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = None
        for b in batches:
            if counter is None:
                counter = UnigramCounter(load_vocabulary(vocabulary_path))
            got = [counter.count(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "n_tokens", "score"])
    return (docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
            .mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, score double"))
