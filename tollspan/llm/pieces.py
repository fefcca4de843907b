"""Encoding into SentencePiece pieces and back: an Aho-Corasick automaton drives a single-pass Viterbi search.

The automaton reports, at every position, all pieces that end there (its output links), each of which relaxes
the best score of the position behind it. The pieces and scores are those of a given model file. A character
that no piece covers is written as its bytes, at a score below any piece's. Texts are taken as they are, so
decoding gives the text back exactly.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollspan.llm.common import table

BLANK = "▁"
#: How far a byte written for an uncovered character lies below the lowest score.
PENALTY = 10.0
#: Segments of a generation; two are kept.
KEPT_SEGMENTS = 200_000
_ID = np.dtype("<u4")


class Pieces:
    """Pieces of a model; segments between blanks are remembered with their ids and scores."""

    def __init__(self, path: str | None = None, pieces: list[tuple[str, float, int]] | None = None,
                 byte_ids: list[int] | None = None) -> None:
        """From a model file, or from (piece, score, id) and the ids of the 256 byte pieces."""
        if path:
            pieces, byte_ids = _read(path)
        self.pieces, self.byte_ids = pieces, byte_ids
        self.lowest = min(score for _, score, _ in pieces) - PENALTY
        self.raw: dict[int, bytes] = {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.raw.update((i, piece.replace(BLANK, " ").encode()) for piece, _, i in pieces)
        # a character that no piece has behind another one opens a segment that is independent of what is before
        behind = {b for piece, _, _ in pieces for a, b in zip(piece, piece[1:], strict=False) if a != b}
        opening = [c for c in BLANK + string.punctuation + "\n\r\t" if c not in behind]
        others = "".join(map(re.escape, opening))
        runs = "|".join(f"{re.escape(c)}+" for c in opening)
        self.segments = re.compile(f"(?s)(?:{runs})[^{others}]*|[^{others}]+" if opening else "(?s).+")
        self.known: dict[str, tuple[bytes, float]] = {}
        self.older: dict[str, tuple[bytes, float]] = {}
        self.single = frozenset(piece for piece, _, _ in pieces if len(piece) == 1)
        self.bytes_of = {i: np.array([i], _ID).tobytes() for i in self.raw}

    @cached_property
    def words(self):
        """The automaton, built where texts are encoded; decoding does without."""
        import ahocorasick

        words = ahocorasick.Automaton()
        for piece, score, i in self.pieces:
            words.add_word(piece, (len(piece), score, i))
        words.make_automaton()
        return words

    def best(self, segment: str) -> tuple[bytes, float]:
        """Ids and score of the best way to cut a segment; of equal ways, the one with the longer last piece."""
        n = len(segment)
        score = [0.0] + [-math.inf] * n
        start, piece = [0] * (n + 1), [-1] * (n + 1)
        if self.single.issuperset(segment):  # then bytes, which score less than any piece, are never the best
            for last, (length, gain, i) in self.words.iter(segment):
                last += 1
                total = score[last - length] + gain
                if total > score[last]:  # of the pieces that end here, the longest comes first
                    score[last], start[last], piece[last] = total, last - length, i
        else:
            self._relax_with_bytes(segment, score, start, piece)
        ids: list[int] = []
        at = n
        while at:
            if piece[at] < 0:
                ids += [self.byte_ids[b] for b in reversed(segment[at - 1].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(piece[at])
            at = start[at]
        return b"".join(map(self.bytes_of.__getitem__, reversed(ids))), score[n]

    def _relax_with_bytes(self, segment: str, score: list[float], start: list[int], piece: list[int]) -> None:
        n, lowest = len(segment), self.lowest
        settled = 0  # no piece that is still to come ends at or before this position
        for last, (length, gain, i) in self.words.iter(segment):
            while settled < last:
                settled += 1
                if score[settled - 1] + lowest > score[settled]:
                    score[settled], start[settled], piece[settled] = score[settled - 1] + lowest, settled - 1, -1
            end = last + 1
            total = score[end - length] + gain
            if total > score[end]:
                score[end], start[end], piece[end] = total, end - length, i
        while settled < n:
            settled += 1
            if score[settled - 1] + lowest > score[settled]:
                score[settled], start[settled], piece[settled] = score[settled - 1] + lowest, settled - 1, -1

    def encode(self, text: str) -> tuple[bytes, float]:
        """Ids (little-endian, 32 bits) and score; a blank is put before the text, nothing for the empty text.

        A U+2581 that stands in the text is written as bytes, as pieces use it for the blank.
        """
        if not text:
            return b"", 0.0
        found: list[tuple[bytes, float]] = []
        for k, part in enumerate((" " + text).split(BLANK)):
            if k:
                found.append((b"".join(self.bytes_of[self.byte_ids[b]] for b in BLANK.encode()), self.lowest))
            segments = self.segments.findall(part.replace(" ", BLANK))
            met = list(map(self.known.get, segments))
            if None in met:
                for i, one in enumerate(met):
                    if one is None:
                        met[i] = self._remembered(segments[i])
            found += met
        return b"".join([f[0] for f in found]), sum([f[1] for f in found])

    def _remembered(self, segment: str) -> tuple[bytes, float]:
        met = self.known.get(segment) or self.older.get(segment) or self.best(segment)
        if len(self.known) >= KEPT_SEGMENTS:
            self.older, self.known = self.known, {}
        self.known[segment] = met
        return met

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, _ID).tolist()))[1:].decode("utf-8", "surrogatepass")


def _read(path: str) -> tuple[list[tuple[str, float, int]], list[int]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    byte_ids = {int(model.id_to_piece(i)[3:-1], 16): i for i in ids if model.is_byte(i)}
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte pieces")
    special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i), i) for i in ids if not special(i)], [byte_ids[b] for b in range(256)]


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(text: Column, path: str, *, back: bool = False) -> Column:
    """Struct `ids` (binary, little-endian 32-bit numbers) and `score` of whole texts; a null text is empty.

    With `back`, a third field is the text decoded from the ids, by the same worker.
    """

    @F.pandas_udf("ids binary, score double" + ", back string" * back)
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = _pieces(path)
        for texts in batches:
            frame = pd.DataFrame([pieces.encode(t or "") for t in texts], columns=["ids", "score"])
            if back:
                frame["back"] = pd.Series([pieces.decode(i) for i in frame["ids"]], dtype=object)
            yield frame

    return encoded(text)


def decode(ids: Column, path: str) -> Column:
    """Text of encoded ids; null for null."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = _pieces(path)
        for column in batches:
            yield pd.Series([None if i is None else pieces.decode(i) for i in column], dtype=object)

    return decoded(ids)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; n_tokens, checksum of the ids, score, checksum of what comes back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = docs.withColumn("e", encode(F.col("text"), path, back=True))
    return found.select(
        "doc_id",
        (F.octet_length("e.ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("e.ids").alias("ids_crc32"),
        "e.score",
        F.sha2("e.back", 256).alias("decoded_sha256"),
        (F.col("e.back") == F.col("text")).alias("round_trip"),
    )
