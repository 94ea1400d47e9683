"""Operator 7: token counts by heap-and-linked-list byte-pair merging, without identifiers.

The symbols of a stretch form a linked list; a heap holds the ranks of its
adjacent pairs; the pair of lowest rank, leftmost first, is popped and merged
until none is left. The count is the initial symbols less the merges, plus the
further bytes of symbols that the vocabulary lacks. A text is cut before each
run of spaces that follows another character (the space's own mark aside): the vocabulary has no piece with
a space after another character (this is checked), so no merge crosses such a
place, and a stretch met before need not be merged again.

Defined cases: a null or empty text has 0 tokens; special strings are ordinary
text, as the library does by default; repeated rows are counted each; an empty
table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, read_table, slices, texts_of

LIMIT = 4096
STRETCHES = 400_000
SPACE = "▁"
_MARK = SPACE.encode()
_CUT = re.compile(rb"(?<=[^ ])(?<!" + _MARK + rb") ")
#: Fixed values of the model file's format: kinds of pieces, and its field numbers.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES_FIELD, TRAINER_FIELD, NORMALIZER_FIELD = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, BPE = 3, 35, 2
NAME, PREFIX, REMOVE_SPACES = 1, 3, 4


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        wire = key & 7
        if wire == 0:
            yield key >> 3, number()
            continue
        size = number() if wire == 2 else 4 if wire == 5 else 8
        yield key >> 3, raw[at:at + size]
        at += size


class HeapCounter:
    def __init__(self, model: bytes):
        import struct

        self.rank: dict[str, float] = {}
        trainer, normalizer = {}, {}
        for field, value in _fields(model):
            if field == PIECES_FIELD:
                piece = dict(_fields(value))
                kind = piece.get(3, NORMAL)
                if kind in (USER, UNUSED):
                    raise ValueError("vocabularies with user-defined or unused pieces are not supported")
                if kind == NORMAL:
                    self.rank[piece[1].decode()] = -struct.unpack("<f", piece[2])[0]
            elif field == TRAINER_FIELD:
                trainer = dict(_fields(value))
            elif field == NORMALIZER_FIELD:
                normalizer = dict(_fields(value))
        if (trainer.get(MODEL_TYPE) != BPE or not trainer.get(BYTE_FALLBACK) or normalizer.get(NAME) != b"identity"
                or not normalizer.get(PREFIX, 1) or normalizer.get(REMOVE_SPACES, 1)
                or any(SPACE in p.lstrip(SPACE) for p in self.rank)):
            raise ValueError("the cut before spaces is proven for byte-fallback BPE without normalisation only")
        self.counts = BoundedCache(self._count, STRETCHES)

    def _count(self, stretch: bytes) -> int:
        return self.merged(SPACE + stretch.decode().replace(" ", SPACE))

    def merged(self, text: str) -> int:
        rank = self.rank
        symbols: list[str | None] = list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known = [rank.get(a + b) for a, b in zip(symbols, symbols[1:])]  # rank of the pair that starts here
        known.append(None)
        heap = [(r, i) for i, r in enumerate(known) if r is not None]
        heapify(heap)
        merges = 0
        while heap:
            r, i = heappop(heap)
            if known[i] != r:
                continue  # a side of this pair was merged elsewhere
            j = after[i]
            symbols[i] += symbols[j]
            symbols[j] = known[j] = None
            merges += 1
            k = after[i] = after[j]
            known[i] = None
            if k < n:
                before[k] = i
                known[i] = r = rank.get(symbols[i] + symbols[k])
                if r is not None:
                    heappush(heap, (r, i))
            h = before[i]
            if h >= 0:
                known[h] = r = rank.get(symbols[h] + symbols[i])
                if r is not None:
                    heappush(heap, (r, h))
        return n - merges + sum(len(s.encode()) - 1 for s in symbols if s is not None and s not in rank)

    def count(self, text: bytes) -> int:
        if not text:
            return 0
        odd = b"  " in text or text[:1] == b" " or _MARK in text
        return sum(map(self.counts.__getitem__, _CUT.split(text) if odd else text.split(b" ")))


@functools.lru_cache(2)
def _counter(model: bytes) -> HeapCounter:
    return HeapCounter(model)


def count_tokens(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens) of every text; ``model`` is the content of the vocabulary file."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for b in slices(batches):
            texts = texts_of(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(counter.count, texts), pa.int64())],
                names=[id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_bytes long, n_tokens long")


def op7_token_count(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return count_tokens(read_table(spark, sf_dir, "documents", "doc_id", "text"), model).withColumn(
        "over_limit", F.col("n_tokens") > LIMIT)
