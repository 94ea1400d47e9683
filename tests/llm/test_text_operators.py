"""Token operators against their libraries, whole texts with odd content included."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sievekit.llm import bpe_codec, token_count, token_store

ODD = [" ", "  ", "\n", "a", "the", "é", "!", "\u00a0", "'s", "'", "<|endoftext|>", "<|endof", "1", "23", "\t", "\u3000",
       "\u180e", "\x1c", "日本", "x" * 40, "🙂", "“", "\u2009", "<s>", "▁", "\x00", "\x85", "\ufeff", "İ", "Σ"]


def odd_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 300))) for _ in range(n)] + [
        "", " ", "  ", "a ", " a", "a" * 30_000, "   a   b  ", "\n\n a", "日本語" * 2000, "word " * 5000]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, kept string")


ROWS = [(i, t, "clash", None) for i, t in enumerate(odd_texts(60, 5))] + [(None, "a b", "x", "y"), (7, None, "x", "y"), (7, None, "x", "y")]


def test_chunk_encoder_equals_library():
    spec = bpe_codec.tokenizer_text(public_tokenizers.path("byte_bpe_50k.json"))
    tok, encoder, decoder = Tokenizer.from_str(spec), bpe_codec.ChunkEncoder(spec), bpe_codec.IdDecoder(spec)
    shared = "".join(random.Random(1).choice("abc dé\n") for _ in range(5000))
    for text in odd_texts(300, 1) + [shared, "x" + shared, shared + " tail", shared[100:] + shared]:
        ids = np.frombuffer(encoder.encode(text.encode()), "<u4").tolist()
        assert ids == tok.encode(text, add_special_tokens=False).ids
        assert decoder.decode(ids) == tok.decode(ids, skip_special_tokens=False) == text


def test_cuts_depend_on_content_alone():
    shared = bytes(random.Random(2).choices(b"abcdefgh ", k=20_000))
    ends = {e - 7 for e in bpe_codec.content_cuts(b"1234567" + shared)} & set(bpe_codec.content_cuts(shared))
    assert len(ends) > 20


def test_bpe_codec_rows(spark):
    spec = bpe_codec.tokenizer_text(public_tokenizers.path("byte_bpe_50k.json"))
    tok = Tokenizer.from_str(spec)
    rows = bpe_codec.decode_ids(bpe_codec.encode_texts(frame(spark, ROWS), spec), spec).collect()
    got = sorted(bpe_codec.digests(np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in rows)
    want = []
    for _, text, *_ in ROWS:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want.append(bpe_codec.digests(ids, tok.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert sorted(map(tuple, bpe_codec.round_trip(frame(spark, ROWS), spec).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert bpe_codec.encode_texts(frame(spark, []), spec).count() == 0


def test_heap_counts_equal_library(spark):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    library, counter = sentencepiece.SentencePieceProcessor(model_proto=model), token_count.HeapCounter(model)
    for text in odd_texts(300, 3):
        assert counter.count(text.encode()) == len(library.encode(text))
        assert not text or counter.merged("▁" + text.replace(" ", "▁")) == len(library.encode(text))
    rows = token_count.count_tokens(frame(spark, ROWS), model).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == sorted(
        (len((t or "").encode()), len(library.encode(t or ""))) for _, t, *_ in ROWS)
    assert token_count.count_tokens(frame(spark, []), model).count() == 0


def test_word_encoder_equals_library():
    spec = bpe_codec.tokenizer_text(public_tokenizers.path("word_bpe_49k.json"))
    tok, encoder = Tokenizer.from_str(spec), token_store.WordEncoder(spec)
    for text in odd_texts(300, 4):
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("ids", [
    np.zeros(0, "<u4"), np.array([1], "<u4"), np.full(10_000, 7, "<u4"), np.tile(np.arange(50), 200).astype("<u4"),
    np.random.default_rng(0).integers(0, 12, 20_000).astype("<u4")])
def test_grammar_round_trip_and_random_access(ids):
    cut = len(ids) // 3
    block = token_store.Block(token_store.pack_block(ids, [cut, 0, len(ids) - cut], 100))
    assert (block.ids(0, len(ids)) == ids).all()
    assert (block.document(2) == ids[cut:]).all() and len(block.document(1)) == 0
    rng = random.Random(0)
    for _ in range(100):
        a, z = sorted((rng.randint(0, len(ids)), rng.randint(0, len(ids))))
        assert (block.ids(a, z) == ids[a:z]).all()
    if len(ids) > 1000:
        assert len(block.symbols) < 0.6 * len(ids)


def test_token_store_files(spark, tmp_path):
    from pyspark.sql import functions as F

    spec = bpe_codec.tokenizer_text(public_tokenizers.path("word_bpe_49k.json"))
    rows = [r for r in ROWS if r[0] is not None]
    for name, block_ids in (("one", 1 << 21), ("many", 500)):
        path = f"{tmp_path}/{name}"
        token_store.write_ids(frame(spark, rows), path, spec, block_ids=block_ids)
        back = token_store.read_ids(spark, path).select(
            "doc_id", "start", (F.length("ids") / 4).cast("long"), F.crc32("ids")).collect()
        got = sorted(tuple(r) for r in back)
        want = token_store.brute_force([(i, t) for i, t, *_ in rows], spec)
        # rows of equal id may stand in another order than here: their texts are both null
        assert got == sorted(want)
    token_store.write_ids(frame(spark, []), f"{tmp_path}/none", spec)
    assert token_store.read_ids(spark, f"{tmp_path}/none").count() == 0
    token_store.write_ids(frame(spark, [(None, "a", "", ""), (3, "b", "", "")]), f"{tmp_path}/null", spec)
    assert [r.doc_id for r in token_store.read_ids(spark, f"{tmp_path}/null").orderBy("start").collect()] == [None, 3]
