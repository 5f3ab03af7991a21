"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists all vocabulary matches of a pre-token; dynamic
programming over their ends carries the best score and its piece count, and
never the path.  Ties follow the tokenizers library's unigram model: scores are
double precision, of equal scores the earliest start (longest piece) stays,
an unmatched character costs 10 less than the lowest score, runs of such
characters are one piece, or one piece a byte where the vocabulary has all byte
pieces.  Text is split before each space mark, with one put in front.

The vocabulary is a list of pieces and scores.  The files at hand hold no unigram
model, and tokenizers are not trained here, so the query takes ``piece_bpe_32k.model``,
whose scores are negated merge ranks: its counts are those of a unigram model with
just these scores (which the test builds in the library), not those of the file's own
BPE.  ``token_counts`` warns of a file of another kind.

Each distinct pre-token of a batch is counted once; counts are kept in a bounded
cache per worker; there is no shuffle, and each text is read whole.

Defined cases: null and empty texts count 0; repeated rows count each; null ids
stay null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import as_documents, by_bytes
from .tokens import vocabulary

MARK = "▁"
CACHE_WORDS = 400_000
#: Text bytes taken up at once.
BATCH_BYTES = 4 << 20


class Unigram(dict):
    """Maps a pre-token without its mark to its piece count; ``scores`` to its score."""

    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        super().__init__()
        self.scores: dict[str, float] = {}
        self.matches = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece and not self.matches.exists(piece):
                self.matches.add_word(piece, (len(piece), float(score)))
        if len(self.matches):
            self.matches.make_automaton()
        self.unknown = min((s for _, s in vocab), default=0.0) - 10.0
        names = {p for p, _ in vocab}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))

    def viterbi(self, word: str) -> tuple[int, float]:
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        count, lost = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        found: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.matches):
            for end, match in self.matches.iter(word):
                found[end].append(match)
        for end in range(n):
            single = False
            for size, score in sorted(found[end], reverse=True):  # the earliest start first
                single |= size == 1
                total = score + best[end + 1 - size]
                if best[end + 1] is None or total > best[end + 1]:
                    best[end + 1], count[end + 1], lost[end + 1] = total, count[end + 1 - size] + 1, False
            if not single:
                total = self.unknown + best[end]
                if best[end + 1] is None or total > best[end + 1]:
                    more = len(word[end].encode()) if self.bytes else 0 if lost[end] else 1
                    best[end + 1], count[end + 1], lost[end + 1] = total, count[end] + more, True
        return count[n], best[n]

    def __missing__(self, part: str) -> int:
        count, score = self.viterbi(MARK + part)
        if len(self) >= CACHE_WORDS:
            self.clear()
            self.scores.clear()
        self[part], self.scores[part] = count, score
        return count

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of pieces of each text; none for an empty one."""
        spaced = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        lists = pc.split_pattern(spaced, " ")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        told = lists.flatten().dictionary_encode()
        each = np.array([self[w] for w in told.dictionary.to_pylist()], np.int64)[told.indices.to_numpy()]
        total = np.concatenate([[0], np.cumsum(each)])
        stop = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        found = total[stop] - total[np.concatenate([[0], stop[:-1]])]
        # the mark in front of a text is not put before one that is there
        found -= self[""] * pc.starts_with(spaced, " ").to_numpy(zero_copy_only=False)
        return np.where(pc.equal(spaced, "").to_numpy(zero_copy_only=False), 0, found)

    def count(self, text: str) -> int:
        return int(self.counts(pa.array([text]))[0])


def is_unigram(data: bytes) -> bool:
    """Whether a sentencepiece model file says that it is a unigram model: field 3 of
    the trainer's settings, which are field 2 of the file; 1, or nothing, is unigram."""

    def fields(raw: bytes) -> Iterator[tuple[int, object]]:
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                b = raw[at]
                at, value, shift = at + 1, value | (b & 127) << shift, shift + 7
                if b < 128:
                    return value

        while at < len(raw):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            else:
                size = {1: 8, 5: 4}.get(tag & 7) or number()
                yield tag >> 3, raw[at : at + size]
                at += size

    settings = next((x for k, x in fields(data) if k == 2), b"")
    return next((x for k, x in fields(settings) if k == 3), 1) == 1


def pieces(data: bytes) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@lru_cache(maxsize=2)
def _unigram(data: bytes) -> Unigram:
    return Unigram(pieces(data))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) for every row, by the pieces and scores of a model file."""
    shipped = vocabulary(docs.sparkSession, model_path)
    if not is_unigram(shipped.value):
        warnings.warn(f"{model_path} is no unigram model: its scores are taken as if it were one", stacklevel=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _unigram(shipped.value)
        for batch in by_bytes(batches, text_col, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(model.counts(batch.column(text_col)), pa.int64())], [id_col, "n_tokens"])

    return as_documents(docs, id_col, text_col).mapInArrow(run, f"{id_col} long, n_tokens long")
