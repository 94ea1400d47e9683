"""Operator 2: BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over 32 bytes cuts every text into chunks whose ends depend on
the nearby content alone, so documents that share a passage share its chunks;
a task encodes each chunk that it holds once and keeps the ids of its inner
part. A chunk end may lie inside a word, so joins are repaired: the stretch
from the last place in the left chunk where both encodings must agree to the
first such place in the right chunk is encoded again, and grows over further
chunks until it ends at such a place. Encodings agree before a single space
that is followed by a character that is surely no white space: the vocabulary's
word pattern never looks past that place from either side.

The reuse is within a task (the cache is bounded and outlives tasks of one
worker): sharing ids between tasks would need a shuffle of all chunk texts and
of all ids, several times the input, to save the encoding of shared chunks.

Defined cases: a null text is empty and has no ids; a special token's text
inside a document becomes that token, as the library does by default; repeated
rows are encoded each; an empty table gives an empty result; only the id and
text columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, mix64, read_table, slices, texts_of

#: A chunk ends where the low bits of the rolling hash are 0: 512 bytes on average.
CHUNK_BITS = 9
#: Entries of a cache's young half; the other half holds at most as many.
PIECES, WORDS, CHUNKS = 100_000, 20_000, 4_000
#: Places where encodings agree: before such a space.
_AGREE = re.compile(rb" (?=[^\t-\r \x1c-\x1f\xc2\xe1\xe2\xe3\xef])")
_ODD = re.compile(rb" (?:[\t-\r \x1c-\x1f\xc2\xe1\xe2\xe3\xef]|\Z)")
#: The byte-level pre-tokenizer's pattern (fixed value), used where its classes are the same in every version of
#: Unicode: on characters below U+0250 other than controls and non-ASCII spaces.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_STABLE = re.compile(r"[\t-\r -~¡-ɏ]*")
_MARKS = frozenset(",.;:!?")
_GEAR = mix64(np.arange(1, 257, dtype=np.uint64))


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def content_cuts(text: bytes) -> list[int]:
    """Ends of the content-defined chunks of a text, on character bounds."""
    raw = np.frombuffer(text, np.uint8)
    h = _GEAR[raw]
    for k in (1, 2, 4, 8, 16):  # after each step h covers twice as many bytes
        later = h[k:] + (h[:-k] << np.uint64(k))
        h = np.concatenate([h[:k], later])
    cuts = np.flatnonzero((h >> np.uint64(64 - CHUNK_BITS)) == 0) + 1
    cuts = cuts[cuts < len(raw)]
    while len(cuts) and (inside := (raw[cuts] & 0xC0) == 0x80).any():
        cuts = np.unique(cuts + inside)
        cuts = cuts[cuts < len(raw)]
    return [*cuts.tolist(), len(raw)]


class ChunkEncoder:
    """Encodes whole texts through cached chunks and cached pieces; ids as little-endian uint32 bytes."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        spec = json.loads(tokenizer_json)
        pre = spec["pre_tokenizer"]
        self.plain = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]
        if not self.plain or any(b.isspace() for t in spec["added_tokens"] for b in t["content"]):
            raise ValueError("joins are proven for plain byte-level vocabularies only")
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words = BoundedCache(self._word, WORDS)
        self.first = BoundedCache(self._ids, WORDS)  # a text's first piece has no space before it
        self.pieces = BoundedCache(self._spaced_ids, PIECES)
        self.chunks = BoundedCache(None, CHUNKS)

    def _spaced_ids(self, piece: bytes) -> bytes:
        """Ids of a piece after its space; most are a word, or one with a mark behind it."""
        text = piece.decode()
        if text.isalpha() and max(text) < "ɐ":
            return self._word(" " + text)
        if text[-1:] in _MARKS and text[:-1].isalpha() and max(text) < "ɐ":
            return self.pieces[text[:-1].encode()] + self.words[text[-1]]
        return self._ids(b" " + piece)

    def _ids(self, piece: bytes) -> bytes:
        text = piece.decode()
        if _STABLE.fullmatch(text) and not any(t in text for t in self.special):
            return b"".join(map(self.words.__getitem__, _WORDS.findall(text)))
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one match of the pre-tokenizer's pattern."""
        mapped = "Ġ" + word[1:] if word[0] == " " and word.isascii() and word[1:].isalnum() else word.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _stretch(self, text: bytes) -> bytes:
        """Ids of a stretch that starts and ends where encodings agree."""
        parts = text.split(b" ") if not _ODD.search(text) else _AGREE.split(text)
        head = self.first[parts[0]] if parts[0] else b""
        return head + b"".join(map(self.pieces.__getitem__, parts[1:]))

    def _chunk(self, chunk: bytes) -> tuple[int, bytes, int]:
        """(end of the head, ids between head and tail, start of the tail); (-1, b"", -1) without such a place."""
        first = _AGREE.search(chunk)
        if not first:
            return -1, b"", -1
        last = chunk.rfind(b" ")
        while not _AGREE.match(chunk, last):
            last = chunk.rfind(b" ", 0, last)
        return first.start(), self._stretch(chunk[first.start():last]), last

    def encode(self, text: bytes) -> bytes:
        out, carry, start = [], b"", 0
        for end in content_cuts(text):
            chunk = text[start:end]
            start = end
            digest = hashlib.blake2b(chunk, digest_size=16).digest()
            found = self.chunks.find(digest)
            if found is None:
                found = self.chunks.keep(digest, self._chunk(chunk))
            head, ids, tail = found
            if head < 0:  # no place to agree: the join goes on over the next chunk
                carry += chunk
                continue
            out.append(self._stretch(carry + chunk[:head]))
            out.append(ids)
            carry = chunk[tail:]
        out.append(self._stretch(carry))
        return b"".join(out)


class IdDecoder:
    """Bytes and decimal names of ids."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.names = [str(i) for i in range(len(self.bytes))]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def listed(self, ids: list[int]) -> str:
        return ",".join(map(self.names.__getitem__, ids))


@functools.lru_cache(2)
def _encoder(tokenizer_json: str) -> ChunkEncoder:
    return ChunkEncoder(tokenizer_json)


@functools.lru_cache(2)
def _decoder(tokenizer_json: str) -> IdDecoder:
    return IdDecoder(tokenizer_json)


def tokenizer_text(path: str) -> str:
    """The file's text, read once on the driver: of fixed size, so that tasks get it by broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_texts(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): the ids of every text as little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for b in slices(batches):
            ids = [encoder.encode(t) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids binary")


def decode_ids(encoded: DataFrame, tokenizer_json: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids, listed, text): the ids in decimal joined by commas, and the text that they decode to."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(shared.value)
        for b in slices(batches):
            ids = [np.frombuffer(x, "<u4").tolist() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([decoder.listed(x) for x in ids], pa.string()),
                 pa.array([decoder.decode(x) for x in ids], pa.string())], names=[id_col, "ids", "listed", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} {kind}, ids binary, listed string, text string")


def round_trip(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, listed, text): ``encode_texts`` and ``decode_ids`` in one pass, so that the ids of a text
    are decoded by the worker that made them."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(shared.value), _decoder(shared.value)
        for b in slices(batches, 256):
            raw = [encoder.encode(t) for t in texts_of(b.column(1))]
            ids = [np.frombuffer(x, "<u4").tolist() for x in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(raw, pa.binary()), pa.array([decoder.listed(x) for x in ids], pa.string()),
                 pa.array([decoder.decode(x) for x in ids], pa.string())], names=[id_col, "ids", "listed", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids binary, listed string, text string")


def op2_bpe_codec(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    spec = tokenizer_text(path or public_tokenizers.path("byte_bpe_50k.json"))
    return round_trip(read_table(spark, sf_dir, "documents", "doc_id", "text"), spec).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("listed", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def digests(ids: list[int], text: str) -> tuple[int, str, str]:
    """The query's columns for one document, as plain Python for tests."""
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest())
