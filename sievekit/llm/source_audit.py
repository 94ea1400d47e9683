"""Operator 11: divergence of sources by term shares, with a minimal acyclic transducer as vocabulary.

1. Terms and the documents that have them are counted per language; those in
   ``MIN_DOCUMENTS`` documents or more are kept, and range-sorted as keys
   (language, zero byte, term).
2. Each stretch of sorted keys becomes a shard: a minimal acyclic transducer,
   built incrementally, whose arcs carry the number of keys that sort before
   them, so that a key's outputs sum up to its place in the shard.
3. The texts are read again and streamed through the transducers: a task sums
   up the occurrences of each (language, source) and deals them, sorted, to the
   shards of their keys; a shard that gets many is dealt further, with a copy
   of its transducer for each part. Keys walk all at once, a byte a step.
4. Shares and divergences are integers. Terms of a shard come in blocks; a block
   adds up the divergence of every two sources of its language, a tile of
   sources at a time, and the ten first terms of each group. Places in the
   sorted keys break ties; the few winners are spelled by their transducers.

Only shard bounds are sent to all tasks, ``MAX_SHARDS`` at most and one for
each task of the sort. What grows with the square of the sources is the result.

Defined cases: null text, lang and source count as ''; a language without kept
terms has pairs of value 0 and no terms; one with a single source has no pairs;
an empty table gives an empty result; rows that repeat are documents each; only
the three columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, from_planes, partitions, planes, read_table, texts_of, tidy

MIN_DOCUMENTS = 10
SCALE = 10 ** 9
TOP = 10
#: Keys of a shard; more if that would make more than MAX_SHARDS.
SHARD_KEYS, MAX_SHARDS = 1 << 15, 50_000
#: Distinct terms that a task sums up before it passes them on, and terms that one part of a shard gets.
HELD_TERMS, PART_TERMS = 400_000, 4_000_000
#: Terms of a block, and numbers of a block over all sources of its language.
BLOCK_TERMS, BLOCK_CELLS = 2048, 1 << 22
#: Sources that are compared at once with one source.
TILE = 64

#: Letters A-Z become small, all other ASCII characters that are no letters become spaces: terms are what is left between.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Transducer:
    """Minimal acyclic transducer of sorted distinct keys: states are numbers, 0 is where keys begin.

    ``first``: of each state its first arc; ``label``, ``target``, ``before``: of
    each arc its byte, where it leads and how many keys of its state sort before
    those through it; ``final``: whether a key ends in a state.
    """

    def __init__(self, first: np.ndarray, label: np.ndarray, target: np.ndarray, before: np.ndarray, final: np.ndarray):
        self.first, self.label, self.target, self.before, self.final = first, label, target, before, final
        origin = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.arcs = (origin << 8) | label  # ascending

    @classmethod
    def build(cls, keys: list[bytes]) -> Transducer:
        """Incremental construction: states off the last key's path are final in form and shared when equal."""
        register: dict[tuple, int] = {}
        arcs: list[tuple] = []  # of each frozen state: (final, ((byte, state), ..))
        sizes: list[int] = []  # keys from each frozen state on
        path: list[list] = [[False, []]]  # states of the last key's path: [final, frozen arcs]
        last = b""

        def freeze(depth: int) -> None:
            """Replace the path's states below ``depth`` by frozen ones."""
            while len(path) > depth + 1:
                final, out = path.pop()
                form = (final, tuple(out))
                state = register.get(form)
                if state is None:
                    state = register[form] = len(arcs)
                    arcs.append(form)
                    sizes.append(final + sum(sizes[s] for _, s in out))
                path[-1][1].append((last[len(path) - 1], state))

        for key in keys:
            shared, n = 0, min(len(last), len(key))
            while shared < n and last[shared] == key[shared]:
                shared += 1
            if key <= last and keys[0] is not key:
                raise ValueError("keys must be sorted and distinct")
            freeze(shared)
            path += [[False, []] for _ in range(len(key) - shared)]
            path[-1][0] = True
            last = key
        freeze(0)
        root = (path[0][0], tuple(path[0][1]))
        # states by number: the root first, then the frozen ones
        first, label, target, before, final = [0], [], [], [], []
        for is_final, out in (root, *arcs):
            passed = int(is_final)  # a key that ends here sorts before those that go on
            for byte, state in out:
                label.append(byte)
                target.append(state + 1)
                before.append(passed)
                passed += sizes[state]
            first.append(len(label))
            final.append(is_final)
        kind = np.int64
        return cls(np.array(first, kind), np.array(label, kind), np.array(target, kind), np.array(before, kind), np.array(final, bool))

    def pack(self) -> bytes:
        head = struct.pack("<qq", len(self.final), len(self.label))
        return head + b"".join(a.astype(t).tobytes() for a, t in (
            (self.first, "<u4"), (self.target, "<u4"), (self.before, "<u4"), (self.label, "u1"), (self.final, "u1")))

    @classmethod
    def unpack(cls, raw: bytes) -> Transducer:
        states, arcs = struct.unpack_from("<qq", raw)
        out, at = [], 16
        for n, t in ((states + 1, "<u4"), (arcs, "<u4"), (arcs, "<u4"), (arcs, "u1"), (states, "u1")):
            out.append(np.frombuffer(raw, t, n, at).astype(np.int64))
            at += out[-1].size * np.dtype(t).itemsize
        first, target, before, label, final = out
        return cls(first, label, target, before, final.astype(bool))

    def walk(self, head: bytes) -> tuple[int, int]:
        """State after some first bytes, and the keys that sort before what goes on from there; state -1 if no key does."""
        state, place = 0, 0
        for byte in head:
            a, z = int(self.first[state]), int(self.first[state + 1])
            arc = a + int(np.searchsorted(self.label[a:z], byte))
            if arc == z or self.label[arc] != byte:
                return -1, 0
            state, place = int(self.target[arc]), place + int(self.before[arc])
        return state, place

    def ordinals(self, keys: list[bytes], head: bytes = b"") -> np.ndarray:
        """Place of each key (``head`` and the given rest) among the transducer's sorted keys; -1 of others. All walk together."""
        n = len(keys)
        at, passed = self.walk(head)
        if at < 0:
            return np.full(n, -1)
        raw = np.frombuffer(b"".join(keys), np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, keys), np.int64, n)
        starts = np.cumsum(sizes) - sizes
        state, place = np.full(n, at), np.full(n, passed)
        live = np.arange(n)
        step = 0
        while len(live := live[sizes[live] > step]):
            want = (state[live] << 8) | raw[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.arcs, want), len(self.arcs) - 1)  # a shard's keys are not empty, so it has arcs
            there = self.arcs[arc] == want
            state[live[~there]] = -1
            live, arc = live[there], arc[there]
            state[live] = self.target[arc]
            place[live] += self.before[arc]
            step += 1
        return np.where((state >= 0) & self.final[state], place, -1)

    def key(self, ordinal: int) -> bytes:
        """The key at a place: the way down by the counts."""
        out, state = bytearray(), 0
        while not (ordinal == 0 and self.final[state]):
            a, z = int(self.first[state]), int(self.first[state + 1])
            arc = a + int(np.searchsorted(self.before[a:z], ordinal, side="right")) - 1
            out.append(int(self.label[arc]))
            ordinal -= int(self.before[arc])
            state = int(self.target[arc])
        return bytes(out)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _columns(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))


@tidy
def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (key, documents that have it), summed up in the task."""
    held: dict[bytes, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang + b"\0" + t for t in counts], pa.binary()), pa.array(counts.values(), pa.int64())], names=["key", "df"])

    size = 0
    for b in batches:
        for lang, text in zip(texts_of(b.column(0)), texts_of(b.column(1)), strict=True):
            counts = held.setdefault(lang, Counter())
            size -= len(counts)
            counts.update(set(terms_of(text)))
            size += len(counts)
            if size >= HELD_TERMS:
                yield from out()
                held, size = {}, 0
    yield from out()


def _shards(shard_keys: int):
    """Sorted keys to transducers of ``shard_keys`` keys, with the stretches of places that each language has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def out(keys: list[bytes]) -> pa.RecordBatch:
            langs = [k[:k.rindex(b"\0")] for k in keys]
            starts = [i for i, x in enumerate(langs) if not i or x != langs[i - 1]]
            return pa.RecordBatch.from_arrays(
                [pa.array([keys[0]], pa.binary()), pa.array([len(keys)], pa.int64()), pa.array([Transducer.build(keys).pack()], pa.binary()),
                 pa.array([[langs[i].decode() for i in starts]], pa.list_(pa.string())), pa.array([starts], pa.list_(pa.int64())),
                 pa.array([[z - a for a, z in zip(starts, [*starts[1:], len(keys)])]], pa.list_(pa.int64()))],
                names=["first", "n", "packed", "langs", "starts", "kept"])

        for b in batches:
            held += b.column(0).to_pylist()
            while len(held) >= shard_keys:
                yield out(held[:shard_keys])
                held = held[shard_keys:]
        if held:
            yield out(held)
    return run


def _dealt_terms(bounds):
    """(lang, source, text) to sorted keys with counts, by group and shard, summed up in the task."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = bounds.value
        held: dict[tuple[bytes, bytes], Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            rows = []
            for (lang, source), counts in held.items():
                keys = sorted(lang + b"\0" + t for t in counts)
                skip = len(lang) + 1
                at = 0
                while at < len(keys):
                    shard = bisect_right(firsts, keys[at]) - 1
                    end = len(keys) if shard + 1 >= len(firsts) else bisect_left(keys, firsts[shard + 1], at)
                    if shard >= 0:  # keys before the first kept one are none
                        mine = keys[at:end]
                        rows.append((shard, lang.decode(), source.decode(), len(mine), b"\0".join(k[skip:] for k in mine),
                                     planes(np.array([counts[k[skip:]] for k in mine], np.uint32))))
                    at = end
            for i in range(0, len(rows), 256):
                part = rows[i:i + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in part], t) for c, t in enumerate(
                        (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                    names=["shard", "lang", "source", "n", "terms", "counts"])

        size = 0
        for b in batches:
            for lang, source, text in zip(*(texts_of(b.column(c)) for c in range(3)), strict=True):
                counts = held.setdefault((lang, source), Counter())
                size -= len(counts)
                counts.update(terms_of(text))
                size += len(counts)
                if size >= HELD_TERMS:
                    yield from out()
                    held, size = {}, 0
        yield from out()
    return run


def _recount(block_terms: int):
    """Rows sorted by (shard, part), the transducer before the terms of each group: counts by place, in blocks of terms.

    A block is named by its first place; it lies in one stretch of a language.
    """
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, machine, starts, group, total = None, None, None, None, None

        def out() -> Iterator[pa.RecordBatch]:
            if group is None:
                return
            rows = []
            places = np.flatnonzero(total)
            stretch = starts[np.searchsorted(starts, places, side="right") - 1]
            first = stretch + (places - stretch) // block_terms * block_terms
            turns = np.flatnonzero(np.diff(first, prepend=-1))
            for a, z in zip(turns, [*turns[1:], len(places)]):
                mine = places[a:z]
                rows.append((shard[0], int(first[a]), *group, int(total[mine].sum()), planes((mine - first[a]).astype(np.uint32)),
                             planes(total[mine])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], t) for c, t in enumerate(
                    (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                names=["shard", "block", "lang", "source", "n_counted", "places", "counts"])

        for b in batches:
            for s, part, packed, n, of_langs, lang, source, terms, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if packed is not None:
                    yield from out()
                    shard, machine, starts, group, size = (s, part), Transducer.unpack(packed), np.array(of_langs), None, n
                    continue
                if (lang, source) != group:
                    yield from out()
                    group, total = (lang, source), np.zeros(size, np.int64)
                place = machine.ordinals(terms.split(b"\0"), lang.encode() + b"\0")
                hit = place >= 0
                total[place[hit]] += from_planes(counts, np.uint32)[hit].astype(np.int64)  # a term comes once in a row
        yield from out()
    return run


def share(count: np.ndarray, n: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (n + 2 * kept)), by long division, so that no product passes 63 bits."""
    divisor = n + 2 * kept
    whole, rest = np.divmod(count + 2, divisor)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, divisor)
        whole = whole * 1000 + more
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compare(top: int):
    """Rows sorted by (lang, shard, block), the language's groups first: sums of pairs of sources, and each group's first terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names, totals, kept, counts, width = None, [], [], 0, None, 0

        def out() -> Iterator[pa.RecordBatch]:
            if counts is None:
                return
            lang, shard, number = block
            all_counts = counts.sum(0)
            q = share(all_counts, sum(totals), kept)
            p = np.stack([share(c, n, kept) for c, n in zip(counts, totals)])
            for i in range(len(names)):
                rows = []
                for a in range(i + 1, len(names), TILE):
                    found = divergence(p[i], p[a:a + TILE]).sum(1)
                    rows += [(names[i], names[a + j], int(v)) for j, v in enumerate(found)]
                if rows:
                    yield table([(lang, *r, None, None) for r in rows])
            firsts = []
            for i, name in enumerate(names):
                mine = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                value = divergence(p[i][mine], q[mine])
                for j in np.lexsort((mine, -value))[:top].tolist():
                    firsts.append((lang, name, None, int(value[j]), shard, number + int(mine[j])))
            yield table(firsts)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)],
                                              names=["lang", "source", "other", "value", "shard", "place"])

        for b in batches:
            for lang, shard, number, sources, ns, v, in_block, source, places, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if sources is not None:
                    yield from out()
                    block, names, totals, kept = (lang, shard, number), sources, ns, v
                    index = {s: k for k, s in enumerate(names)}
                    counts = np.zeros((len(names), in_block), np.int64)
                    continue
                counts[index[source], from_planes(places, np.uint32)] += from_planes(found, np.int64)
        yield from out()
    return run


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, its transducer first: the terms at the winners' places."""
    machine = None
    for b in batches:
        rows = []
        for packed, *row, place in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
            if packed is not None:
                machine = Transducer.unpack(packed)
                continue
            key = machine.key(place)
            rows.append((*row, key[key.rindex(b"\0") + 1:].decode()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()))],
            names=["lang", "source", "value", "rank", "item"])


def audit_sources(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                  min_documents: int = MIN_DOCUMENTS, top: int = TOP, shard_keys: int = SHARD_KEYS, block_terms: int | None = None,
                  part_terms: int = PART_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): see the module's description and the registered query."""
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "audit"), partitions(spark)
    rows = _columns(docs, lang_col, source_col, text_col)
    groups = scratch.write(rows.select("lang", "source").distinct(), "groups")
    counted = rows.select("lang", "text").mapInArrow(_document_counts, "key binary, df long").groupBy("key").agg(F.sum("df").alias("df"))
    kept = scratch.write(counted.where(F.col("df") >= min_documents).select("key"), "kept")
    shard_keys = max(shard_keys, -(-kept.count() // MAX_SHARDS))
    shards = scratch.write(kept.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(
        _shards(shard_keys),
        "first binary, n long, packed binary, langs array<string>, starts array<long>, kept array<long>"), "shards")
    # bounded: MAX_SHARDS and one for each task of the sort
    firsts = sorted(bytes(r["first"]) for r in shards.select("first").collect())
    number = scratch.write(shards.select("first").withColumn(
        "shard", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first")) - 1).cast("int")), "numbers")
    shards = scratch.write(shards.join(number, "first").drop("first"), "transducers")
    bounds = spark.sparkContext.broadcast(firsts)
    dealt = scratch.write(rows.mapInArrow(
        _dealt_terms(bounds), "shard int, lang string, source string, n long, terms binary, counts binary"), "dealt")
    parts = scratch.write(dealt.groupBy("shard").agg(F.ceil(F.sum("n") / part_terms).cast("int").alias("parts")), "parts")
    machines = (shards.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "packed", "n", "starts"))
    salted = dealt.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("lang", "source", "terms"), "parts").cast("int"))
    # how many sources a language has bounds the memory of a block
    most = groups.groupBy("lang").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 1
    block_terms = block_terms or max(16, min(BLOCK_TERMS, BLOCK_CELLS // most))
    met = machines.unionByName(salted.drop("parts", "n"), allowMissingColumns=True).select(
        "shard", "part", "packed", "n", "starts", "lang", "source", "terms", "counts")
    found = scratch.write(
        met.repartition(n, "shard", "part").sortWithinPartitions("shard", "part", F.col("packed").isNull(), "lang", "source")
        .mapInArrow(_recount(block_terms), "shard int, block long, lang string, source string, n_counted long, places binary, counts binary"), "found")
    scratch.drop("dealt")
    vocabulary = (shards.select(F.explode(F.arrays_zip("langs", "kept")).alias("x"))
                  .groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.kept").alias("v")))
    sizes = found.groupBy("lang", "source").agg(F.sum("n_counted").alias("counted"))
    known = groups.join(sizes, ["lang", "source"], "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    by_lang = (known.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "counted"))).alias("g"))
               .join(vocabulary, "lang").select("lang", F.col("g.source").alias("sources"), F.col("g.counted").alias("ns"), "v"))
    # every block of each language's stretches, the last one of a stretch may be shorter
    end = F.col("x.starts") + F.col("x.kept")
    blocks = (shards.select("shard", F.explode(F.arrays_zip("langs", "starts", "kept")).alias("x"))
              .select("shard", F.col("x.langs").alias("lang"), end.alias("end"),
                      F.explode(F.sequence(F.col("x.starts"), end - 1, F.lit(block_terms).cast("long"))).alias("block"))
              .select("lang", "shard", "block", F.least(F.lit(block_terms), F.col("end") - F.col("block")).cast("int").alias("in_block")))
    heads = blocks.join(by_lang, "lang")
    compared = scratch.write(
        heads.unionByName(found.select("lang", "shard", "block", "source", "places", "counts"), allowMissingColumns=True)
        .select("lang", "shard", "block", "sources", "ns", "v", "in_block", "source", "places", "counts")
        .repartition(n, "lang", "shard", "block").sortWithinPartitions("lang", "shard", "block", F.col("sources").isNull())
        .mapInArrow(_compare(top), "lang string, source string, other string, value long, shard int, place long"), "compared")
    summed = compared.where("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = summed.unionByName(summed.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    # a language without kept terms has no block: its pairs come from its groups
    g = by_lang_pairs(groups, vocabulary)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.withColumnRenamed("other", "item").unionByName(g).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).cast("int").alias("rank"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "shard", "place")
    winners = (compared.where("place is not null").withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= top))
    needed = shards.select("shard", "packed").join(winners.select("shard").distinct(), "shard", "left_semi")
    spelled = (needed.unionByName(winners.select("shard", "lang", "source", "value", "rank", "place"), allowMissingColumns=True)
               .select("shard", "packed", "lang", "source", "value", "rank", "place")
               .repartition(n, "shard").sortWithinPartitions("shard", F.col("packed").isNull())
               .mapInArrow(_spell, "lang string, source string, value long, rank int, item string"))
    terms = spelled.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


def by_lang_pairs(groups: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, source, item, value 0) of every two sources of a language without kept terms."""
    bare = groups.join(vocabulary, "lang", "left_anti")
    others = bare.groupBy("lang").agg(F.collect_list("source").alias("items"))
    return (bare.join(others, "lang").select("lang", "source", F.explode("items").alias("item"), F.lit(0).cast("long").alias("value"))
            .where(F.col("item") != F.col("source")))


def op11_source_audit(spark, sf_dir: str) -> DataFrame:
    return audit_sources(read_table(spark, sf_dir, "documents", "lang", "source", "text"))


_P = "1 + ({scale}::HUGEINT * ({count} + 2)) // ({n} + 2 * v)"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, unnest(regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
           FROM (SELECT row_number() OVER () AS doc_id, lang, source, text FROM documents)),
kept AS (SELECT lang, term FROM d GROUP BY lang, term HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}),
grp AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
voc AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
cnt AS (SELECT lang, source, term, count(*) AS c FROM d SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM grp g LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0)::HUGEINT AS c, {_P.format(scale=SCALE, count='coalesce(c, 0)', n='n')} AS p
      FROM gn g JOIN kept k USING (lang) JOIN voc USING (lang) LEFT JOIN cnt USING (lang, source, term)),
q AS (SELECT lang, term, {_P.format(scale=SCALE, count='s', n='m')} AS q FROM (
        SELECT lang, term, sum(c)::HUGEINT AS s FROM p GROUP BY ALL) JOIN (SELECT lang, sum(n)::HUGEINT AS m FROM gn GROUP BY lang) USING (lang) JOIN voc USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
                     FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
          ON f.lang = a.lang AND f.source = a.source AND f.other = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
           UNION ALL
           SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT FROM terms)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""


def brute_force(documents: list[tuple], min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> list[tuple]:
    """The query's rows from (lang, source, text) by plain dictionaries and integers, for tests."""
    df: dict[str, Counter] = {}
    counts: dict[str, dict[str, Counter]] = {}
    for lang, source, text in documents:
        found = [t.decode() for t in terms_of((text or "").encode())]
        df.setdefault(lang or "", Counter()).update(set(found))
        counts.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(found)
    out = []
    for lang, groups in counts.items():
        kept = sorted(t for t, n in df[lang].items() if n >= min_documents)
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def shares(c: Counter) -> list[int]:
            n = sum(c[t] for t in kept)
            return [1 + SCALE * (c[t] + 2) // (n + 2 * len(kept)) for t in kept]

        q, p = shares(whole), {s: shares(c) for s, c in groups.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted(((-sum(map(f, p[s], p[o])), o.encode()) for o in groups if o != s))
            out += [(lang, s, "pair", o.decode(), -v, r + 1) for r, (v, o) in enumerate(pairs)]
            best = sorted((-f(a, b), t.encode()) for t, a, b in zip(kept, p[s], q) if groups[s][t] and a > b)[:top]
            out += [(lang, s, "term", t.decode(), -v, r + 1) for r, (v, t) in enumerate(best)]
    return out
