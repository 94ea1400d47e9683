"""Operator 8: token-id files compressed by Re-Pair grammars, with random-access decoding.

Documents are range-sorted by id; each range's ids are written as blocks, and
each block is a shard with a grammar of its own: frequent adjacent id pairs are
replaced by nonterminals, round after round, until no pair is frequent enough.
A block stores its rules, the expansion length of every nonterminal and the
lengths of its documents, so a document is decoded from the symbols that cover
it alone.

File format: Parquet rows (range, block, n_ids, block bytes); the bytes are the
header ``<4sIIIII`` (magic, version, first nonterminal, rules, symbols,
documents), then little-endian arrays: rules (uint32 pairs), expansion lengths
(uint32), document lengths (uint64), symbols (uint32).

Defined cases: a null text is empty and becomes the end id alone; a null id
comes first; documents of equal id are ordered by their text, and equal rows
are kept each; a special token's text becomes that token; an empty table writes
no block and gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_codec import byte_alphabet, tokenizer_text
from .common import BoundedCache, Scratch, partitions, read_table, texts_of

END_ID = 1
WORDS, PARTS = 400_000, 50_000
#: Words without other characters are the same to every version of Unicode, and composed already.
_STABLE = re.compile("[!-~¡-ɏ]*")
#: Whole texts of such words and ASCII white space, less the one capital whose small form is two characters.
_STABLE_TEXT = "^[\t-\r -~¡-įı-ɏ]*$"
#: Bytes of text whose words are looked up together.
LOOKUP_BYTES = 1 << 24
_MARKS = frozenset(",.;:!?")
#: Ids after which a block is closed; documents are not split.
BLOCK_IDS = 1 << 19
#: A pair that occurs less often is not worth a rule.
MIN_PAIRS = 8
#: Rounds go on while they shorten the block by this share at least.
MIN_GAIN = 0.01
#: Buckets of pairs, as a power of two.
BUCKET_BITS = 18
HEADER, MAGIC, VERSION = struct.Struct("<4sIIIII"), b"IDRP", 1


class WordEncoder:
    """Ids of whole texts by the tokenizers library, through a cache of space-separated words.

    The vocabulary drops white space and no token, pattern or normalisation of
    it reaches over ASCII white space, so the words of a text are independent.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("words are proven independent for vocabularies that drop white space only")
        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.first_free = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.words, self.parts = BoundedCache(self._ids, WORDS), BoundedCache(self._part, PARTS)
        self.small = SmallWords(self, WORDS)

    def _ids(self, word: bytes) -> bytes:
        text = word.decode()
        if _STABLE.fullmatch(text) and "İ" not in text and not any(t in text for t in self.special):
            return self.small[text.lower()]
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of one match of the vocabulary's pattern."""
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text. Words of stable texts are found as numbers of distinct words, and only those are looked up."""
        column = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        stable = pc.match_substring_regex(column, _STABLE_TEXT)
        for t in self.special:
            stable = pc.and_not(stable, pc.match_substring(column, t))
        words = pc.ascii_split_whitespace(pc.utf8_lower(column.filter(stable)))
        coded = words.flatten().dictionary_encode()
        small = self.small
        table = [small[w] if w else b"" for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat, starts = np.frombuffer(b"".join(table), "<u4"), np.cumsum(sizes) - sizes
        out, ends = joined(flat, starts, sizes, coded.indices.to_numpy())
        bounds = np.concatenate([[0], ends])[words.offsets.to_numpy()].tolist()
        found = iter(zip(bounds, bounds[1:]))
        return [out[slice(*next(found))].tobytes() if s else self.encode(t) for s, t in zip(stable.to_pylist(), texts)]


class SmallWords(dict):
    """Ids of stable words in small letters, made when missing; drops its older half when full."""

    def __init__(self, encoder: WordEncoder, limit: int):
        super().__init__()
        self.encoder, self.limit, self.old = encoder, limit, {}
        self.tokenize, self.alphabet = encoder.model.tokenize, encoder.alphabet

    def __missing__(self, word: str) -> bytes:
        value = self.old.get(word)
        if value is None:
            if word.isalpha():
                part = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
                value = array("I", [t.id for t in self.tokenize(part)]).tobytes()
            elif word[-1] in _MARKS and word[:-1].isalpha():
                value = self[word[:-1]] + self.encoder.parts[word[-1]]
            else:
                value = b"".join(map(self.encoder.parts.__getitem__, self.encoder.pattern.findall(word)))
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


def joined(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``which`` of ``flat`` (they begin at ``starts``) one after another, and where each ends."""
    size = sizes[which]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((starts[which] - ends + size).astype(kind), size) + np.arange(total, dtype=kind)], ends


def by_bytes(values: list[bytes], limit: int) -> Iterator[list[bytes]]:
    """The values in order, in lists of about so many bytes."""
    part, size = [], 0
    for v in values:
        part.append(v)
        size += len(v)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


@functools.lru_cache(2)
def _encoder(tokenizer_json: str) -> WordEncoder:
    return WordEncoder(tokenizer_json)


def _frequent_pairs(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(keys, counts, places by key) of pairs that are frequent next to the most frequent one; None if no pair is.

    A pair is at most as frequent as its bucket, so only places of full buckets are sorted.
    """
    spread = key.dtype.type(0x9E3779B97F4A7C15 >> 64 - bits | 1)
    bucket = ((key * spread) >> key.dtype.type(bits - BUCKET_BITS)).astype(np.int64)
    full = np.bincount(bucket, minlength=1 << BUCKET_BITS)
    for least in sorted({max(MIN_PAIRS, int(full.max()) // 32), MIN_PAIRS}, reverse=True):
        places = np.flatnonzero((full >= least)[bucket])
        places = places[np.argsort(key[places])]
        ranked = key[places]
        starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])[:len(ranked)])
        counts = np.diff(np.append(starts, len(ranked)))
        good = counts >= max(MIN_PAIRS, int(counts.max(initial=0)) // 32)
        if good.any():
            return ranked[starts[good]], counts[good], places[np.repeat(good, counts)]
    return None


def re_pair(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): nonterminal base + k stands for the two symbols of rules[k]."""
    s = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    n_rules = 0
    while len(s) > 2 * MIN_PAIRS:
        # ids of a block mostly fit 16 bits, with its nonterminals too
        bits, wide = (16, np.uint32) if base + n_rules <= 1 << 16 else (32, np.uint64)
        key = (s[:-1].astype(wide) << wide(bits)) | s[1:]
        found = _frequent_pairs(key, 2 * bits)
        if found is None:
            break
        pairs, counts, places = found
        which = np.repeat(np.arange(len(pairs)), counts)
        weight = np.zeros(len(key) + 2, np.int64)  # of the pair at each place, with a margin on both sides
        weight[places + 1] = np.repeat(counts, counts)
        double = np.flatnonzero(s[:-1] == s[1:])
        if len(double):  # in a run of equal ids every second pair
            first = np.concatenate([[True], double[1:] != double[:-1] + 1])
            run = double - double[np.maximum.accumulate(np.where(first, np.arange(len(double)), 0))]
            weight[double[run % 2 == 1] + 1] = 0
        # of overlapping pairs the more frequent, then the left one
        mine = weight[places + 1]
        take = (mine > 0) & (mine > weight[places]) & (mine >= weight[places + 2])
        chosen, which = places[take], which[take]
        times = np.bincount(which, minlength=len(pairs))
        used = np.flatnonzero(times)
        worth = times[used] >= MIN_PAIRS // 2
        if not worth.any():
            break
        number = np.zeros(len(pairs), np.int64)
        number[used[worth]] = np.arange(int(worth.sum())) + base + n_rules
        keep = number[which] > 0
        chosen, which = chosen[keep], which[keep]
        gain = len(chosen) / len(s)
        s = s.copy()
        s[chosen] = number[which]
        left = np.ones(len(s), bool)
        left[chosen + 1] = False
        s = s[left]
        made = pairs[used[worth]]
        rules.append(np.column_stack([made >> wide(bits), made & wide((1 << bits) - 1)]).astype("<u4"))
        n_rules += len(made)
        if gain < MIN_GAIN:
            break
    return np.concatenate(rules) if rules else np.zeros((0, 2), "<u4"), s.astype("<u4")


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each nonterminal stands for; a rule uses earlier rules only, level by level."""
    size = np.ones(first + len(rules), np.int64)
    done = np.zeros(first + len(rules), bool)
    done[:first] = True
    todo = np.arange(len(rules))
    while len(todo):
        ready = done[rules[todo]].all(1)
        now = todo[ready]
        size[first + now] = size[rules[now]].sum(1)
        done[first + now] = True
        todo = todo[~ready]
    return size[first:]


def pack_block(ids: np.ndarray, lengths: list[int], first: int) -> bytes:
    rules, symbols = re_pair(ids, first)
    return b"".join([HEADER.pack(MAGIC, VERSION, first, len(rules), len(symbols), len(lengths)), rules.tobytes(),
                     expansion_lengths(rules, first).astype("<u4").tobytes(), np.array(lengths, "<u8").tobytes(),
                     symbols.tobytes()])


class Block:
    """A packed block; ``ids`` decodes a stretch, ``document`` one document."""

    def __init__(self, raw: bytes):
        magic, version, self.first, n_rules, n_symbols, n_docs = HEADER.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a block of this format")
        at = HEADER.size
        take = lambda kind, n: np.frombuffer(raw, kind, n, at)
        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        at += 8 * n_rules
        self.sizes = take("<u4", n_rules)
        at += 4 * n_rules
        self.lengths = take("<u8", n_docs).astype(np.int64)
        at += 8 * n_docs
        self.symbols = take("<u4", n_symbols)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        #: ids that each symbol stands for, the vocabulary's own ones included
        self.size_of = np.concatenate([np.ones(self.first, np.int64), self.sizes.astype(np.int64)])
        self.ends = np.cumsum(self.size_of[self.symbols])

    @functools.cached_property
    def _expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids that the symbols stand for, one after another; where each symbol's begin), rules level by level."""
        begin = np.cumsum(self.size_of) - self.size_of
        flat = np.empty(int(self.size_of.sum()), np.uint32)
        flat[:self.first] = np.arange(self.first)
        done = np.zeros(len(self.size_of), bool)
        done[:self.first] = True
        todo = np.arange(len(self.rules))
        while len(todo):
            ready = done[self.rules[todo]].all(1)
            now = todo[ready]
            size = self.size_of[self.first + now]
            there = np.repeat(begin[self.first + now] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            flat[there] = joined(flat, begin, self.size_of, self.rules[now].ravel())[0]
            done[self.first + now] = True
            todo = todo[~ready]
        return flat, begin

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, "<u4")
        lo, hi = np.searchsorted(self.ends, [start, end - 1], side="right")
        skipped = int(self.ends[lo - 1]) if lo else 0
        flat, begin = self._expanded
        return joined(flat, begin, self.size_of, self.symbols[lo:hi + 1])[0][start - skipped:end - skipped].astype("<u4", copy=False)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_ids(docs: DataFrame, path: str, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode all texts and write them, each followed by ``end_id``, in ascending order of id to ``path``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        end = np.array([end_id], "<u4").tobytes()
        place, number, held, idents, total = None, 0, [], [], 0

        def block() -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(held), "<u4")
            packed = pack_block(raw, [len(x) // 4 for x in held], encoder.first_free)
            return pa.RecordBatch.from_arrays(
                [pa.array([place], pa.int32()), pa.array([number], pa.int64()), pa.array([len(raw)], pa.int64()),
                 pa.array([idents], pa.list_(kind)), pa.array([packed], pa.binary())],
                names=["range", "block", "n_ids", "ids_of", "packed"])

        for b in batches:
            kind = b.column(1).type
            encoded = (ids for part in by_bytes(texts_of(b.column(2)), LOOKUP_BYTES) for ids in encoder.encode_many(part))
            for p, ident, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encoded, strict=True):
                if held and (p != place or total >= block_ids):
                    yield block()
                    number, held, idents, total = number + 1, [], [], 0
                place = p
                held.append(ids + end)
                idents.append(ident)
                total += len(held[-1]) // 4
        if held:
            yield block()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("ident"), F.col(text_col).alias("text"))
    # equal ids are dealt by a hash of the text too, so that no id is bound to one range
    ordered = (rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions(spark), "ident", "tie")
               .sortWithinPartitions("ident", "tie", "text"))
    (ordered.select(F.spark_partition_id().alias("range"), "ident", "text")
     .mapInArrow(run, f"range int, block long, n_ids long, ids_of array<{kind}>, packed binary")
     .write.option("compression", "zstd").parquet(path))


def read_ids(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, ids): every document of the files in order, ``ids`` as little-endian uint32 bytes."""
    files, scratch = spark.read.parquet(path), Scratch(spark, "token-store-places")
    kind = files.schema["ids_of"].dataType.elementType.simpleString()
    totals = files.groupBy("range").agg(F.sum("n_ids").alias("n"))
    ranges = totals.select("range", F.coalesce(F.sum("n").over(
        Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # written, so that its size is known and it need not be shuffled with the blocks
    blocks = scratch.write(files.select("range", "block", "n_ids").join(ranges, "range").select(
        "range", "block", (F.col("base") + F.coalesce(F.sum("n_ids").over(
            Window.partitionBy("range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base")), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                block, base = Block(b.column(2)[k].as_py()), b.column(0)[k].as_py()
                everything = block.ids(0, int(block.starts[-1]))
                n = len(block.lengths)
                for i in range(0, n, 4096):
                    at = block.starts[i:min(i + 4096, n) + 1]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(1)[k].values[i:i + 4096], pa.array(base + at[:-1], pa.int64()),
                         pa.array([everything[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary())],
                        names=[id_col, "start", "ids"])

    return (files.join(blocks, ["range", "block"]).select("base", "ids_of", "packed")
            .mapInArrow(run, f"{id_col} {kind}, start long, ids binary"))


def op8_token_store(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    spec = tokenizer_text(path or public_tokenizers.path("word_bpe_49k.json"))
    where = f"{Scratch(spark, 'token-store').root}/ids"
    write_ids(read_table(spark, sf_dir, "documents", "doc_id", "text"), where, spec)
    return read_ids(spark, where).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def brute_force(documents: list[tuple[int, str]], tokenizer_json: str, end_id: int = END_ID) -> list[tuple[int, int, int, int]]:
    """The query's rows by the library alone, for tests."""
    from tokenizers import Tokenizer

    tok, out, start = Tokenizer.from_str(tokenizer_json), [], 0
    for ident, text in sorted(documents, key=lambda d: d[0]):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((ident, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out
