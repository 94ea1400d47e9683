"""Operator 9: removal of repeated passages with per-shard suffix arrays.

A byte goes if some ``length``-byte string that covers it also starts anywhere
else in the corpus, in the same document or another.

1. Each ``length``-byte window selects the smallest of its hashed ``GRAM``-byte
   strings, leftmost first. Equal windows select equal strings at equal places,
   so only windows whose selected string (the anchor) occurs twice can repeat;
   all others are set aside by counting anchors.
2. The windows of an anchor, with the bytes they span, form a context. Equal
   contexts are collapsed and counted; contexts are dealt into shards by anchor.
3. A shard sorts its suffixes by Larsson-Sadakane refinement and finds common
   prefixes of neighbours by Kasai's method, run over all contexts in step.
   Suffixes with a common prefix of ``length`` form classes; classes with two
   or more occurrences repeat.
4. An anchor with very many occurrences is dealt over several shards; their
   sorted window keys (128 bits) are merged by binary search to find windows
   that repeat across these shards only.
5. Repeated windows become byte spans of their documents, and are cut out.

Defined cases: a null text is empty; texts shorter than ``length`` keep all
their bytes, as do empty tables; rows that repeat are copies of each other, so
their texts go as far as they are long enough; ids may be null or repeat, since
documents are told apart by a 128-bit key of id and text; only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, partitions, read_table, texts_of, tidy

LENGTH = 400
GRAM = 64
#: Bytes that are hashed at once, so that the work arrays stay in the processor's cache; longer texts are taken in
#: overlapping segments.
SEGMENT = 1 << 17
#: Bytes of contexts in a shard, on average, and occurrences of an anchor in a shard.
SHARD_BYTES, SHARD_OCCURRENCES = 1 << 18, 400
#: Anchors of more occurrences are hot, unless that would make more than HOT_ANCHORS.
HOT_OCCURRENCES, HOT_ANCHORS = 5_000, 20_000
_PLACE = np.uint64((1 << 24) - 1)
_U = np.uint64
_WIDE = 128


def gram_hashes(raw: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hashes of all ``size``-byte strings (a power of two), by doubling."""
    h = mix64(np.arange(256 * seed, 256 * seed + 256, dtype=np.uint64))[raw]
    k = 1
    while k < size:
        factor = mix64(np.array([k + 1000 * seed], np.uint64))[0] | _U(1)
        more = h[:-k] * factor
        more += h[k:]
        h = more
        k *= 2
    return mix64(h)


def window_keys(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of all ``length``-byte windows: two overlapping power-of-two strings cover each."""
    size = 1 << (length.bit_length() - 1)
    out = []
    for seed in (2, 3):
        h = gram_hashes(raw, size, seed)
        rest = length - size
        out.append(mix64(h[:len(raw) - length + 1] * _U(0x9E3779B97F4A7C15) + h[rest:rest + len(raw) - length + 1]))
    return out[0], out[1]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: minima up to and from the bounds of blocks of that width."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    grid = padded.reshape(blocks, width)
    up_to = np.minimum.accumulate(grid, 1).ravel()
    since = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(since[:n], up_to[width - 1:width - 1 + n])


def anchors(raw: np.ndarray, bounds: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor hash) of every run of windows with the same anchor.

    ``raw`` holds the texts one after another and ``bounds`` where they start and end.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64),)
    if len(raw) < length:
        return none
    hashes = gram_hashes(raw, gram)
    chosen = sliding_min((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1) & _PLACE
    valid, first = np.zeros(len(chosen), bool), np.zeros(len(chosen), bool)
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e - s >= length:
            valid[s:e - length + 1] = True
            first[s] = True
    turn = np.concatenate([[True], chosen[1:] != chosen[:-1]])
    lo = np.flatnonzero(valid & (first | turn))
    if not len(lo):
        return none
    doc = np.searchsorted(bounds, lo, side="right") - 1
    hi = np.minimum(np.append(lo[1:], len(chosen)), bounds[doc + 1] - length + 1)
    return doc, lo - bounds[doc], hi - lo, hashes[chosen[lo].astype(np.int64)].view(np.int64)


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers that sort as the bytes do."""
    return np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,)).astype(np.uint64)


def suffix_order(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, place of each suffix in that order).

    Larsson-Sadakane: sorted by 8 bytes first; then only the groups that are
    not yet told apart are sorted again, by the groups of the suffixes that
    start as many bytes on as are sorted so far.
    """
    n = len(raw)
    key = _eights(np.concatenate([raw, np.zeros(7, np.uint8)]))
    order = np.argsort(key)
    ranked = key[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    group = np.empty(n, np.int64)  # of a suffix: the place where its group begins
    begins = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    group[order] = begins
    sorted_to = 8
    todo = np.flatnonzero(~head | ~np.append(head[1:], True))  # places of groups of two or more
    while len(todo):
        p = order[todo]
        on = p + sorted_to
        # suffixes that end within what is sorted come first, the shorter ones before
        both = (group[p] << 32) | np.where(on < n, group[np.minimum(on, n - 1)] + sorted_to + 1, n - p)
        by = np.argsort(both)
        p, both = p[by], both[by]
        order[todo] = p
        head = np.concatenate([[True], both[1:] != both[:-1]])
        group[p] = todo[np.maximum.accumulate(np.where(head, np.arange(len(p)), 0))]
        todo = todo[~head | ~np.append(head[1:], True)]
        sorted_to *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def common_prefixes(raw: np.ndarray, order: np.ndarray, place: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
                    limit: int) -> np.ndarray:
    """Common prefix of each suffix and the one before it in the order, up to ``limit``.

    Kasai's method: the prefix of the next suffix is shorter by one at most.
    All contexts (``starts``, ``sizes``) advance together, one suffix a step.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(limit + _WIDE + 8, np.uint8)])
    eight, wide = _eights(padded), np.lib.stride_tricks.sliding_window_view(padded, _WIDE)
    steps = np.array([1 << (8 * k) for k in range(1, 8)], np.uint64)
    out = np.zeros(n, np.int64)
    by_size = np.argsort(-sizes)
    starts, sizes = starts[by_size], sizes[by_size]
    length = np.zeros(len(starts), np.int64)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -t, side="left"))  # contexts longer than t
        here = starts[:live] + t
        at = place[here]
        other = order[np.maximum(at - 1, 0)]
        got = np.maximum(length[:live] - 1, 0)
        got[at == 0] = 0
        todo = np.flatnonzero((at > 0) & (got < limit))
        a, b = here[todo] + got[todo], other[todo] + got[todo]
        differ = eight[a] ^ eight[b]
        got[todo] += np.where(differ == 0, 8, 7 - np.searchsorted(steps, differ, side="right"))
        todo = todo[(differ == 0) & (got[todo] < limit)]
        while len(todo):  # a few suffixes just passed a difference and match for long again
            differ = wide[here[todo] + got[todo]] != wide[other[todo] + got[todo]]
            same = np.where(differ.any(1), differ.argmax(1), _WIDE)
            got[todo] += same
            todo = todo[(same == _WIDE) & (got[todo] < limit)]
        got = np.minimum(got, limit)
        out[at] = got
        length[:live] = got
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def window_spans(repeated: np.ndarray, length: int) -> list[dict]:
    """Byte spans that the repeated windows of one context cover."""
    first, end = _runs(repeated)
    return [{"s": int(a), "e": int(b) - 1 + length} for a, b in zip(first, end)]


def repeated_windows(contexts: list[bytes], times: list[int], length: int) -> list[np.ndarray]:
    """Of each context, which windows occur twice or more among all contexts, each counted ``times``."""
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    order, place = suffix_order(raw)
    prefix = common_prefixes(raw, order, place, starts, sizes, length)
    classes = np.cumsum(prefix < length)[place]
    context = np.repeat(np.arange(len(sizes)), sizes)
    window = np.arange(len(raw)) - starts[context] <= sizes[context] - length
    count = np.bincount(classes[window], np.array(times, np.int64)[context[window]], minlength=int(classes.max()) + 1)
    hit = count[classes] > 1
    return [hit[s:s + n - length + 1] for s, n in zip(starts.tolist(), sizes.tolist())]


def document_key(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"),
            F.xxhash64(F.lit(7), F.col(text_col), F.col(id_col)).alias("k2")]


def _anchor_rows(length: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = (b.column(k).to_numpy() for k in (0, 1))
            parts: list[tuple[int, int, bytes]] = []  # row, offset, bytes
            size = 0

            def found() -> pa.RecordBatch:
                bounds = np.cumsum([0, *(len(p[2]) for p in parts)])
                doc, lo, n, h = anchors(np.frombuffer(b"".join(p[2] for p in parts), np.uint8), bounds, length)
                row = np.array([p[0] for p in parts], np.int64)[doc]
                offset = np.array([p[1] for p in parts], np.int64)[doc]
                return pa.RecordBatch.from_arrays(
                    [pa.array(k1[row]), pa.array(k2[row]), pa.array(lo + offset), pa.array(n.astype(np.int32)), pa.array(h)],
                    names=["k1", "k2", "lo", "n", "h"])

            for row, text in enumerate(texts_of(b.column(2))):
                for offset in range(0, max(len(text) - length + 1, 0), SEGMENT):
                    part = text[offset:offset + SEGMENT + length - 1]
                    if size and size + len(part) > SEGMENT:
                        yield found()
                        parts, size = [], 0
                    parts.append((row, offset, part))
                    size += len(part)
            if parts:
                yield found()
    return run


def _context_rows(length: int, schema: pa.Schema):
    """Rows sorted by document key, anchors before texts: contexts of the texts that have anchors."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runs = None, []
        for b in batches:
            out: list[tuple] = []
            seen: dict[tuple[int, int], int] = {}
            columns = [b.column(k).to_pylist() for k in range(7)]
            for k1, k2, lo, n, h, c, text in zip(*columns, strict=True):
                if (k1, k2) != key:
                    key, runs = (k1, k2), []
                    kept = False
                if text is None:
                    runs.append((lo, n, h, c))
                    continue
                if not runs:
                    continue
                if not kept:  # of rows that repeat one text stays for the cutting, but all occurrences count
                    out.append((0, k1, k2, None, None, None, None, None, None, None, text))
                    kept = True
                for lo_, n_, h_, c_ in runs:
                    context = text[lo_:lo_ + n_ - 1 + length]
                    d1, d2 = np.frombuffer(hashlib.blake2b(context, digest_size=16).digest(), "<i8").tolist()
                    place = seen.get((d1, d2))
                    if place is None:
                        seen[d1, d2] = len(out)
                        out.append((1, k1, k2, lo_, h_, c_, d1, d2, 1, context, None))
                    else:
                        first = out[place]
                        out[place] = (*first[:8], first[8] + 1, *first[9:])
                        out.append((1, k1, k2, lo_, h_, c_, d1, d2, None, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)],
                                                 schema=schema)
    return run


_SPAN = "array<struct<s:int,e:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _shard_rows(length: int):
    """Rows sorted by (shard, context): spans of each context; sorted window keys of those whose anchor is split."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, {}

        def found() -> pa.RecordBatch:
            contexts = [x[0] for x in held.values()]
            hits = repeated_windows(contexts, [x[1] for x in held.values()], length)
            rows, split = [], {}
            for ((h, d1, d2), (context, _, sub, subs)), hit in zip(held.items(), hits, strict=True):
                if hit.any():
                    rows.append((h, d1, d2, window_spans(hit, length), None, None, None, None))
                if subs > 1:
                    split.setdefault((h, sub, subs), []).append(context)
            for (h, sub, subs), texts in split.items():
                a, b = (np.concatenate(x) for x in zip(*(window_keys(np.frombuffer(t, np.uint8), length) for t in texts)))
                a, where = np.unique(a, return_index=True)
                b = b[where]
                dealt = (a % _U(subs)).astype(np.int64)
                for r in np.unique(dealt).tolist():
                    rows.append((h, None, None, None, sub, r, a[dealt == r].tobytes(), b[dealt == r].tobytes()))
            types = (pa.int64(), pa.int64(), pa.int64(), _SPAN_TYPE, pa.int32(), pa.int32(), pa.binary(), pa.binary())
            names = ("h", "d1", "d2", "spans", "sub", "r", "keys", "more")
            return pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], names=list(names))

        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(8)]
            for s, h, d1, d2, times, context, sub, subs in zip(*columns, strict=True):
                if s != shard:
                    if held:
                        yield found()
                    shard, held = s, {}
                old = held.get((h, d1, d2))
                held[h, d1, d2] = (context, times, sub, subs) if old is None else (old[0], old[1] + times, sub, subs)
        if held:
            yield found()
    return run


def _merge_rows():
    """Rows sorted by (anchor, key range): which keys of each shard another shard has too, by binary search."""
    def merge(h: int, runs: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple]:
        keys, more = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        shared = np.zeros(0, bool)
        for _, a, b in runs:
            at = np.searchsorted(keys, a)
            inside = at < len(keys)
            same = np.zeros(len(a), bool)
            same[inside] = (keys[at[inside]] == a[inside]) & (more[at[inside]] == b[inside])
            shared[at[same]] = True
            at, a, b = at[~same], a[~same], b[~same]
            keys, more, shared = np.insert(keys, at, a), np.insert(more, at, b), np.insert(shared, at, False)
        hit = keys[shared]
        out = []
        for sub, a, _ in runs:
            own = a[np.isin(a, hit, assume_unique=True)]
            if len(own):
                out.append((h, sub, own.tobytes()))
        return out

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, runs, rows = None, [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in
                                               enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["h", "sub", "keys"])

        for b in batches:
            for h, r, sub, a, c in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if (h, r) != group:
                    if runs:
                        rows += merge(group[0], runs)
                    group, runs = (h, r), []
                runs.append((sub, np.frombuffer(a, np.uint64), np.frombuffer(c, np.uint64)))
            if rows:
                yield out()
                rows = []
        if runs:
            rows += merge(group[0], runs)
        if rows:
            yield out()
    return run


def _split_spans(length: int):
    """Rows sorted by (anchor, shard), merged keys before contexts: spans of windows that other shards have too."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, ready, done = None, [], None, None
        for b in batches:
            rows = []
            for h, sub, key, d1, d2, context in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if (h, sub) != group:
                    group, keys, ready, done = (h, sub), [], None, None
                if context is None:
                    keys.append(np.frombuffer(key, np.uint64))
                    continue
                if (d1, d2) == done:  # a context comes once from each batch that met it
                    continue
                done = d1, d2
                if ready is None:
                    ready = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
                own = window_keys(np.frombuffer(context, np.uint8), length)[0]
                at = np.searchsorted(ready, own)
                at[at == len(ready)] = 0
                hit = ready[at] == own if len(ready) else np.zeros(len(own), bool)
                if hit.any():
                    rows.append((h, d1, d2, window_spans(hit, length)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(
                    (pa.int64(), pa.int64(), pa.int64(), _SPAN_TYPE))], names=["h", "d1", "d2", "spans"])
    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def character_bounds(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans widened to the bounds of the characters that they split; nothing else of the text is covered."""
    def inside(p: int) -> bool:
        return p < len(text) and text[p] & 0xC0 == 0x80

    out = []
    for s, e in spans:
        while inside(s) and s > 0:
            s -= 1
        while inside(e):
            e += 1
        out.append((s, e))
    return merge_spans(out)


def _cut_rows(characters: bool, min_words: int):
    """Rows sorted by document key, spans before the text: the maximal spans and the bytes that stay.

    With ``characters`` the rest of a character that a cut splits does not stay; maximal spans of fewer
    words than ``min_words`` stay.
    """
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, spans = None, []
        for b in batches:
            rows = []
            for k1, k2, s, e, text in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if (k1, k2) != key:
                    key, spans = (k1, k2), []
                if text is None:
                    spans.append((s, e))
                elif spans:
                    cut = [(a, z) for a, z in merge_spans(spans) if not min_words or len(text[a:z].split()) >= min_words]
                    if not cut:
                        continue
                    gone = character_bounds(text, cut) if characters else cut
                    ends = [0, *(x[1] for x in gone)]
                    kept = b"".join(text[a:z] for a, z in zip(ends, [*(x[0] for x in gone), len(text)]))
                    rows.append((k1, k2, [{"s": a, "e": z} for a, z in cut], kept))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(
                    (pa.int64(), pa.int64(), _SPAN_TYPE, pa.binary()))], names=["k1", "k2", "spans", "kept"])
    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                      shard_bytes: int = SHARD_BYTES, shard_occurrences: int = SHARD_OCCURRENCES, characters: bool = False,
                      min_words: int = 0, hot_occurrences: int = HOT_OCCURRENCES) -> DataFrame:
    """(k1, k2, spans, kept) of every document that loses bytes, by its key (see ``document_key``).

    ``spans`` are the maximal removed runs as byte offsets, ``kept`` the bytes that stay; with ``characters``
    ``kept`` lacks the rest of characters that a cut splits too, and is valid UTF-8 if the text is. With ``min_words``
    only runs of so many words (parts of words at their ends included) are removed.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM} bytes")
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "suffix-dedup"), partitions(spark)
    texts = (docs.where(F.octet_length(text_col) >= length)
             .select(*document_key(id_col, text_col), F.col(text_col).alias("text")))
    runs = scratch.write(texts.mapInArrow(_anchor_rows(length), "k1 long, k2 long, lo long, n int, h long"), "anchors")
    often = scratch.write(runs.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "often")
    # at most HOT_ANCHORS anchors are hot by this bound; they are sent to the rows, the rows of others to them
    hot_from = max(hot_occurrences, runs.count() // HOT_ANCHORS)
    hot = F.broadcast(often.where(F.col("c") > hot_from))
    cold = runs.join(hot, "h", "left_anti").join(often.where(F.col("c") <= hot_from), "h")
    # rows that repeat would bring each anchor again
    candidates = cold.unionByName(runs.join(hot, "h")).dropDuplicates(["k1", "k2", "lo"])
    both = candidates.select("k1", "k2", "lo", "n", "h", "c", F.lit(None).cast("binary").alias("text")).unionByName(
        texts.select("k1", "k2", F.col("text").cast("binary").alias("text")), allowMissingColumns=True)
    fields = "kind int, k1 long, k2 long, lo long, h long, c long, d1 long, d2 long, times long, context binary, text binary"
    arrow = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]])
                       for x in fields.split(", ")])
    found = scratch.write(
        both.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", F.col("text").isNotNull())
        .mapInArrow(_context_rows(length, arrow), fields), "contexts")
    scratch.drop("anchors", "often")
    contexts = found.where("context is not null").withColumn(
        "subs", F.ceil(F.col("c") / shard_occurrences).cast("int")).withColumn("sub", F.pmod("d1", "subs").cast("int"))
    total = contexts.agg(F.sum(F.length("context"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    sharded = (contexts.select(F.pmod(F.xxhash64("h", "sub"), F.lit(shards)).alias("shard"), "h", "d1", "d2", "times", "context", "sub", "subs")
               .repartition(n, "shard").sortWithinPartitions("shard", "h", "d1", "d2"))
    judged = scratch.write(sharded.mapInArrow(
        _shard_rows(length), f"h long, d1 long, d2 long, spans {_SPAN}, sub int, r int, keys binary, more binary"), "judged")
    shared = (judged.where("keys is not null").select("h", "r", "sub", "keys", "more")
              .repartition(n, "h", "r").sortWithinPartitions("h", "r", "sub")
              .mapInArrow(_merge_rows(), "h long, sub int, keys binary"))
    split = contexts.where("subs > 1").select("h", "sub", "d1", "d2", "context")
    across = (shared.unionByName(split, allowMissingColumns=True).select("h", "sub", "keys", "d1", "d2", "context")
              .repartition(n, "h", "sub").sortWithinPartitions("h", "sub", F.col("context").isNotNull(), "d1", "d2")
              .mapInArrow(_split_spans(length), f"h long, d1 long, d2 long, spans {_SPAN}"))
    # a context's spans may come from its own shard and from the merge
    # written, so that the join with the places of a hot context is not bound to this grouping and can be split
    spans = scratch.write(judged.where("spans is not null").select("h", "d1", "d2", "spans").unionByName(across)
                          .groupBy("h", "d1", "d2").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    cuts = (found.where("kind = 1").select("k1", "k2", "lo", "h", "d1", "d2").join(spans, ["h", "d1", "d2"])
            .select("k1", "k2", "lo", F.explode("spans").alias("x"))
            .select("k1", "k2", (F.col("lo") + F.col("x.s")).cast("long").alias("s"),
                    (F.col("lo") + F.col("x.e")).cast("long").alias("e"), F.lit(None).cast("binary").alias("text")))
    return (cuts.unionByName(found.where("kind = 0").select("k1", "k2", "text"), allowMissingColumns=True)
            .repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", F.col("text").isNotNull())
            .mapInArrow(_cut_rows(characters, min_words), f"k1 long, k2 long, spans {_SPAN}, kept binary"))


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    # digests come before the join, so that it moves no texts
    narrow = docs.select("doc_id", *document_key("doc_id", "text"), F.octet_length(text).cast("long").alias("n_bytes"),
                         F.sha2(text, 256).alias("whole"))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.e - x.s)
    cut = repeated_passages(docs).select("k1", "k2", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                                         F.sha2("kept", 256).alias("part"))
    return narrow.join(cut, ["k1", "k2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("part", "whole").alias("kept_sha256"))


def brute_force(documents: list[tuple[int, str]], length: int = LENGTH) -> list[tuple]:
    """The query's rows by counting all windows, for tests."""
    from collections import Counter

    raw = [(i, (t or "").encode()) for i, t in documents]
    count = Counter(t[p:p + length] for _, t in raw for p in range(len(t) - length + 1))
    out = []
    for i, t in raw:
        spans = merge_spans([(p, p + length) for p in range(len(t) - length + 1) if count[t[p:p + length]] > 1])
        gone = bytearray(len(t))
        for s, e in spans:
            gone[s:e] = b"\1" * (e - s)
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return out
