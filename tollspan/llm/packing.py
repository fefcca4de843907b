"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
GROUP_TOKENS = 1 << 19
#: Share of a window that differencing leaves free at first.
LEAST_FREE = 0.001
#: Longest piece that differencing moves as a whole; shorter pieces balance better.
PIECE = 512
#: Words of a generation; two are kept.
KEPT_CHUNKS = 500_000
#: Characters tokenized at once.
TEXT_CHARS = 1 << 20
PIECES = "doc_id {id}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each item and the sums of the `k` windows, by Karmarkar-Karp multiway differencing.

    Every item starts as a partition into one full and k - 1 empty windows. The two partitions with the widest
    gap between their largest and smallest window are merged, largest against smallest, until one is left.
    """
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums = np.zeros(k, np.int64)
        sums[0] = size
        heap.append((-(size if k > 1 else 0), i, sums))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []  # both partitions, and where the windows of the first go
    numbers = np.arange(k)
    while len(heap) > 1:
        _, a, sums_a = heapq.heappop(heap)
        _, b, sums_b = heap[0]
        sums = sums_a + sums_b[::-1]
        order = np.argsort(-sums, kind="stable")
        place = np.empty(k, np.int64)
        place[order] = numbers
        sums = sums[order]
        merges.append((a, b, place))
        heapq.heapreplace(heap, (int(sums[-1] - sums[0]), len(sizes) + len(merges), sums))
    window = np.empty(len(sizes), np.int64)
    if not heap:
        return window, np.zeros(k, np.int64)
    _, last, sums = heap[0]
    # from the last merge back, where each window of a partition ends up
    ends = {last: numbers}
    for number in range(len(merges), 0, -1):
        a, b, place = merges[number - 1]
        to = ends.pop(len(sizes) + number)[place]
        ends[a], ends[b] = to, to[::-1]
    for i, to in ends.items():
        window[i] = to[0]
    return window, sums


def _trim(rest: list[tuple[int, int, int]], tokens: int) -> tuple[list, list]:
    """`rest` without `tokens` tokens, taken off the ends of its longest pieces, and the pieces taken off."""
    kept, taken = [], []
    for doc, start, n in sorted(rest, key=lambda r: (-r[2], r[0])):
        cut = min(tokens, n)
        tokens -= cut
        if cut:
            taken.append((doc, start + n - cut, cut))
        if n > cut:
            kept.append((doc, start, n - cut))
    return kept, taken


def plan(lengths: list[int], capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int, int, int]]:
    """Pieces `(document, start, length, window)` of one group; every token lies in exactly one piece.

    Full windows are cut off the front of long documents. Differencing parts the rest, in pieces of at most `piece`, into near-equal windows
    that leave a small share free; tokens beyond them fill windows of power-of-two lengths, which take no
    padding. Whenever a window is above the capacity, the free share doubles, so the window count rises.
    """
    pieces: list[tuple[int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []
    window = 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((doc, start, capacity, window))
            window += 1
        rest += [(doc, start, min(piece, n - start)) for start in range(n - n % capacity, n, piece)]
    total, share = sum(r[2] for r in rest), LEAST_FREE
    while True:
        filled = max(1, int(capacity * (1 - share)))
        k = total // filled
        kept, tail = _trim(rest, total - k * filled)
        if not k:
            break
        slots, sums = difference(np.array([r[2] for r in kept]), k)
        if sums.max() <= capacity:
            pieces += [(doc, start, n, window + slot) for (doc, start, n), slot in zip(kept, slots.tolist(), strict=True)]
            window += k
            break
        share = min(1.0, 2 * share)
    left, room = sum(t[2] for t in tail), 0
    for doc, start, n in tail:
        while n:
            if not room:
                room = min(1 << (capacity.bit_length() - 1), 1 << (left.bit_length() - 1))
                left -= room
                window += 1
            take = min(room, n)
            pieces.append((doc, start, take, window - 1))
            start, n, room = start + take, n - take, room - take
    return pieces


def _gathered(lists: pa.LargeListArray, indices: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of the chosen lists, one behind the other, and where each ends (from 0 on)."""
    taken = lists.take(indices)
    return taken.flatten(), np.r_[0, np.cumsum(pc.list_value_length(taken).to_numpy())].astype(np.int64)


def _strings(column: pa.Array) -> list[str]:
    """What `to_pylist` gives for strings without null, without a scalar object for each."""
    return column.to_numpy(zero_copy_only=False).tolist()


class _Chunks:
    """Ids, as little-endian bytes, of chunks between blanks; forgets those not met for a generation."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before the last change of generation
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text; the tokenizer drops blanks, never joins what they part, and lowers letters.

        Texts are parted, chunks numbered and ids gathered as columns. A distinct chunk of Latin letters is a
        lowered word and the stops and commas behind it; only distinct words are looked up one by one.
        """
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        parted = pc.split_pattern(pc.replace_substring(pc.fill_null(column, ""), "\n", " "), " ")
        coded = parted.flatten().dictionary_encode()
        chunks = coded.dictionary
        bare = pc.utf8_rtrim(chunks, ".,")
        plain = pc.match_substring_regex(bare, "^[A-Za-zÀ-ÖØ-öø-ÿ]+$")
        words = pc.if_else(plain, pc.utf8_lower(bare), chunks).dictionary_encode()
        stopped = pc.and_(plain, pc.not_equal(chunks, bare))
        tails = pc.if_else(stopped, None, pa.scalar("", pa.large_string()))
        tails = pc.replace_with_mask(tails, stopped, pc.replace_substring_regex(chunks.filter(stopped), "^.*[^.,]", "")).dictionary_encode()
        found = self._looked_up(_strings(words.dictionary) + _strings(tails.dictionary))
        ends = np.cumsum([0, *map(len, found)]) // 4
        every = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(found), "<u4")))
        two = np.stack([words.indices.to_numpy(), tails.indices.to_numpy() + len(words.dictionary)], axis=1)
        values, ends = _gathered(every, pa.array(two.ravel()))
        by_chunk = pa.LargeListArray.from_arrays(pa.array(ends[::2], pa.int64()), values)
        values, ends = _gathered(by_chunk, coded.indices)
        raw = values.to_numpy().tobytes()
        at = 4 * ends[np.r_[0, np.cumsum(pc.list_value_length(parted).to_numpy())]]
        return [raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _looked_up(self, words: list[str]) -> list[bytes]:
        found = list(map(self.known.get, words))
        new = {c for c, ids in zip(words, found, strict=True) if ids is None}
        if not new:
            return found
        if len(self.known) + len(new) > KEPT_CHUNKS:
            self.older, self.known = self.known, {}
        met = [c for c in new if c in self.older]
        self.known.update((c, self.older[c]) for c in met)
        self._learn(new.difference(met))
        # what the change of generation took away is still in the first list
        return [self.known[c] if ids is None else ids for c, ids in zip(words, found, strict=True)]

    def _learn(self, new: set[str]) -> None:
        """Lowered words of Latin letters go as one text cut at its word ends; others singly."""
        chunks = pa.array(list(new), pa.large_string())
        plain = pc.match_substring_regex(chunks, "^[a-zß-öø-ÿ]+$")
        self._singly(_strings(chunks.filter(pc.invert(plain))))
        words = _strings(chunks.filter(plain))
        found = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.r_[0, np.flatnonzero(self.ends_word[found]) + 1]
        if len(ends) != len(words) + 1:
            self._singly(words)
            return
        raw, at = found.tobytes(), (4 * ends).tolist()
        self.known.update((w, raw[i:j]) for w, i, j in zip(words, at[:-1], at[1:], strict=True))

    def _singly(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            for chunk, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[chunk] = np.array(found.ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def _chunks(path: str) -> _Chunks:
    return _Chunks(path)


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    tokenizer_path: str,
    end_id: int = 2,
    capacity: int = CAPACITY,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """Tokens of every document and `end_id`, packed into windows of at most `capacity` tokens.

    Returns a row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian
    unsigned 32-bit). Each partition is packed as it is read, about `group_tokens` tokens at a time, so nothing
    is shuffled and a lost task gives the same pieces again. Sequence ids hold the partition's number in the
    upper bits. Null and empty texts hold only `end_id`. Null and repeated ids are kept, each row a document.
    An empty table gives no rows. Only the two named columns are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks(tokenizer_path)
        first = TaskContext.get().partitionId() << 33
        made = 0

        def flush(ids: list, tokens: list[bytes]) -> pa.RecordBatch:
            nonlocal made
            pieces = sorted(plan([len(t) // 4 for t in tokens], capacity), key=lambda p: (p[3], p[0], p[1]))
            doc, start, length, window = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            before = np.cumsum(length) - length
            opens = np.r_[True, window[1:] != window[:-1]]
            offset = before - np.maximum.accumulate(np.where(opens, before, 0))
            sequence = first + made + np.cumsum(opens) - 1
            made += int(opens.sum())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, id_type).take(pa.array(doc)),
                    *(pa.array(c) for c in (start, length, np.array([len(t) // 4 for t in tokens])[doc], sequence, offset)),
                    pa.array([tokens[d][4 * s : 4 * (s + n)] for d, s, n, _ in pieces], pa.binary()),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        ids: list = []
        texts: list[str] = []
        tokens: list[bytes] = []
        size = 0

        def encode() -> None:
            nonlocal size
            made_now = [t + end for t in chunks.ids(texts)]
            tokens.extend(made_now)
            size += sum(map(len, made_now)) // 4
            texts.clear()

        waiting = 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                waiting += len(texts[-1])
                if waiting >= TEXT_CHARS:
                    encode()
                    waiting = 0
                    if size >= group_tokens:
                        yield flush(ids, tokens)
                        ids, tokens, size = [], [], 0
        encode()
        if tokens:
            yield flush(ids, tokens)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pack, PIECES.format(id=kind))


def packed_digests(docs: DataFrame) -> DataFrame:
    """Pieces of documents with the public word tokenizer, 4096 to a window, ids as their checksum."""
    import public_tokenizers

    pieces = pack_documents(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op8_packing(spark, sf_dir: str) -> DataFrame:
    from tollspan.llm.common import table

    return packed_digests(table(spark, sf_dir, "documents"))
