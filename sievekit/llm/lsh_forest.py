"""Operator 5: n-gram Jaccard self-join with a MinHash LSH forest and exact verification.

1. A document becomes its set of ``WORDS``-word shingles (64-bit hashes);
   documents of equal sets are one node, known by a 128-bit digest of the set.
2. Each tree of the forest is the sorted list of one stretch of the nodes'
   signatures, range-partitioned over tasks: a sorted list of labels is a
   prefix trie. Each node is compared with its neighbours in the list, longest
   common prefix first; the prefix is shortened until a neighbour looks alike
   or until it has the depth at which the trees together reach the target
   recall for pairs of exactly the wanted similarity.
3. The links found join nodes into groups. Groups are verified exactly: all
   pairs of a group are counted by a product of their incidence matrices,
   inside a task, and only counts of links and a spanning set of them leave
   it. A large group is dealt into blocks of bounded size, and each pair of
   blocks is a task's work.
4. Verified links make the classes (connected components).

Defined cases: a document of fewer than ``WORDS`` words has one shingle, all its
words; one without words (null text too) has no links and is a class of its
own; repeated rows are copies of each other; the class id is the least doc_id
of the class, null if it has none; an empty table gives an empty result; only
the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, partitions, read_table, slices, texts_of, tidy, word_keys
from .suffix_dedup import document_key

WORDS = 5
SIMILARITY = 0.8
TREES, DEPTH = 16, 8
TARGET_RECALL = 0.995
#: Neighbours whose signatures agree less than the wanted similarity minus this margin (four standard errors) don't look alike.
MARGIN = 0.15
#: Bounds of a block of a group: nodes and shingles.
BLOCK_NODES, BLOCK_SHINGLES = 2000, 1_000_000
_COLUMNS = 1024
_FACTORS = mix64(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)
_PLACES = mix64(np.arange(1000, 1000 + 64, dtype=np.uint64)) | np.uint64(1)


def least_depth(similarity: float = SIMILARITY, recall: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which pairs of this similarity share a tree's node with the wanted probability."""
    for d in range(depth, 1, -1):
        if 1 - (1 - similarity ** d) ** trees >= recall:
            return d
    return 1


def shingle_set(text: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles."""
    h = word_keys(text)
    if not len(h):
        return h
    k = min(n, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total += h[i:len(h) - k + 1 + i] * _PLACES[i % len(_PLACES)]
    return np.unique(mix64(total))


def signature(shingles: np.ndarray) -> bytes:
    """One byte for each of TREES * DEPTH minima."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[i:i + 2048, None] * _FACTORS).min(0))
    return (mix64(least) & np.uint64(255)).astype(np.uint8).tobytes()


@tidy
def _node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "k1", "k2", "node", "n_shingles", "signature"]
    for b in slices(batches):
        sets = [shingle_set(t) for t in texts_of(b.column(3))]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:3],
             pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
             pa.array([len(s) for s in sets], pa.int64()),
             pa.array([signature(s) if len(s) else None for s in sets], pa.binary())], names=names)


def _neighbour_rows(depth: int, floor: float):
    """Rows sorted by (tree, label): links of each node to the nearest one before it that looks alike."""
    size = TREES * DEPTH
    agree = (floor * (1 - 1 / 256) + 1 / 256) * size

    def links(nodes: list[bytes], signatures: list[bytes]) -> list[tuple[bytes, bytes]]:
        sig = np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, size)
        active, lag, out = np.arange(1, len(nodes)), 1, []
        while len(active):
            alike = np.concatenate([(sig[part] == sig[part - lag]).sum(1) >= agree
                                    for part in np.array_split(active, -(-len(active) // 8192))])
            out += [(nodes[i], nodes[i - lag]) for i in active[alike].tolist()]
            lag += 1
            active = active[~alike]
            active = active[active >= lag]
        return out

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, nodes, signatures, out = None, [], [], []
        ends = []  # the first and last node of this range, for the next range's run may go on with this one's

        def batch(rows, kind):
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.binary()),
                 pa.array([r[1] for r in rows], pa.binary())], names=["kind", "a", "b"])

        for b in batches:
            for tree, label, node, sig in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                now = (tree, label[:depth])
                if now != prefix:
                    out += links(nodes, signatures)
                    prefix, nodes, signatures = now, [], []
                    if not ends:
                        ends.append((bytes([tree]) + label[:depth], node))
                nodes.append(node)
                signatures.append(sig)
            if out:
                yield batch(out, 0)
                out = []
        if nodes:
            ends.append((bytes([prefix[0]]) + prefix[1], nodes[-1]))
            out += links(nodes, signatures)
            yield batch(out, 0)
            yield batch(ends, 1)
    return run


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the least node of each connected component of the edges (a, b)."""
    both = scratch.write(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                           .select("node", F.least("node", "b").alias("label")), f"{name}-0")
    step = 0
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near")))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        # follow the label's own label, so that chains shrink by halves
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        step += 1
        moved = scratch.write(lower.join(jump, "new", "left").select(
            "node", F.least("new", F.coalesce("far", "new")).alias("label"), "old"), f"{name}-{step}")
        changed = moved.where("label <> old").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        labels = moved.select("node", "label")
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels


def count_links(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Matrix of which sets of ``left`` and ``right`` (None: of left itself) have at least this Jaccard similarity."""
    sets = left + (right or [])
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    both = np.zeros((len(left), len(right or left)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, z = np.searchsorted(column, [lo, lo + _COLUMNS])
        m = np.zeros((len(sets), min(_COLUMNS, int(column[z - 1]) - lo + 1)), np.float32)
        m[owner[a:z], column[a:z] - lo] = 1
        both += m[:len(left)] @ (m[len(left):] if right else m).T
    linked = np.empty(both.shape, bool)
    for i, row in enumerate(both):
        linked[i] = row >= similarity * (size[i] + (size[len(left):] if right else size) - row) - 1e-6
    return linked


def _verified_rows(similarity: float):
    """Rows sorted by (group, block pair, node): links of each node (kind 1), a spanning set of links (kind 0)."""
    def judge(members: list[tuple[bool, bytes, np.ndarray]], crossed: bool) -> list[tuple]:
        left = [x for x in members if not crossed or x[0]]
        right = [x for x in members if not x[0]] if crossed else None
        if not left or right == [] or len(members) < 2:
            return []
        linked = count_links([x[2] for x in left], [x[2] for x in right] if crossed else None, similarity)
        if not crossed:
            np.fill_diagonal(linked, False)
        out = [(1, x[1], None, int(n)) for x, n in zip(left, linked.sum(1)) if n]
        if crossed:
            out += [(1, x[1], None, int(n)) for x, n in zip(right, linked.sum(0)) if n]
        nodes = [x[1] for x in left] + [x[1] for x in right or []]
        shift = len(left) if crossed else 0
        seen = np.zeros(len(nodes), bool)
        for k in range(len(left)):  # breadth first: each node but the first of a component adds one link
            if seen[k]:
                continue
            seen[k] = True
            front = [k]
            while front:
                i = front.pop()
                near = np.flatnonzero(linked[i]) + shift if i < len(left) else np.flatnonzero(linked[:, i - shift])
                near = near[~seen[near]]
                seen[near] = True
                out += [(0, nodes[i], nodes[j], None) for j in near.tolist()]
                front += near.tolist()
        return out

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, rows = None, [], []
        for b in batches:
            for g, i, j, block, node, text in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if (g, i, j) != group:
                    if members:
                        rows += judge(members, group[1] != group[2])
                    group, members = (g, i, j), []
                if not members or members[-1][1] != node:  # rows that repeat bring a node again
                    members.append((block == i, node, shingle_set(text.encode())))
            if rows:
                yield _links(rows)
                rows = []
        if members:
            rows += judge(members, group[1] != group[2])
        if rows:
            yield _links(rows)

    def _links(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.int64()))],
            names=["kind", "a", "b", "n"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                    recall: float = TARGET_RECALL, block_nodes: int = BLOCK_NODES,
                    block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: doc_id, k1, k2 (see ``document_key``), class_id, class, n_links, n_copies.

    ``n_links`` counts the different shingle sets that are at least this
    similar, ``n_copies`` the documents of the same set, itself included.
    """
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "lsh-forest"), partitions(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("doc_id"), *document_key(id_col, text_col), F.col(text_col).alias("text"))
    rows = scratch.write(keyed.mapInArrow(
        _node_rows, f"doc_id {kind}, k1 long, k2 long, node binary, n_shingles long, signature binary"), "documents")
    nodes = scratch.write(
        rows.where("node is not null").groupBy("node").agg(
            F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"),
            F.min(F.struct("k1", "k2")).alias("key"), F.count("*").alias("n_copies")), "nodes")
    depth = least_depth(similarity, recall)
    forest = nodes.select(
        F.posexplode(F.array(*(F.substring("signature", DEPTH * t + 1, DEPTH) for t in range(TREES)))).alias("tree", "label"),
        "node", "signature")
    found = scratch.write(
        forest.repartitionByRange(n, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
        .mapInArrow(_neighbour_rows(depth, similarity - MARGIN), "kind int, a binary, b binary"), "links")
    # a run of one prefix may go on over ranges: its ends are joined without comparison, verification decides
    ends = found.where("kind = 1").groupBy("a").agg(F.min("b").alias("first"), F.collect_set("b").alias("all"))
    ends = ends.select(F.col("first").alias("a"), F.explode("all").alias("b"))
    groups = components(scratch, found.where("kind = 0").select("a", "b").unionByName(ends), "groups")
    members = nodes.join(groups, "node").select("node", "n_shingles", "key", F.col("label").alias("group"))
    blocks = members.groupBy("group").agg(F.greatest(
        F.ceil(F.count("*") / block_nodes), F.ceil(F.sum("n_shingles") / block_shingles)).cast("int").alias("blocks"))
    dealt = (members.join(blocks, "group")
             .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node",
                     F.col("key.k1").alias("k1"), F.col("key.k2").alias("k2")))
    with_text = (keyed.select("k1", "k2", "text").join(dealt, ["k1", "k2"])
                 .select("group", "i", "j", "block", "node", "text")
                 .repartition(n, "group", "i", "j").sortWithinPartitions("group", "i", "j", "node"))
    verified = scratch.write(with_text.mapInArrow(_verified_rows(similarity), "kind int, a binary, b binary, n long"), "verified")
    labels = components(scratch, verified.where("kind = 0").select("a", "b"), "classes")
    degree = verified.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    judged = (nodes.select("node", "n_copies").join(labels, "node", "left").join(degree, "node", "left")
              .select("node", "n_copies", F.coalesce("label", "node").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    placed = scratch.write(rows.select("doc_id", "k1", "k2", "node").join(judged, "node", "left"), "placed")
    scratch.drop("documents", "nodes", "links", "verified")
    least = placed.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return placed.join(least, "class", "left").select(
        "doc_id", "k1", "k2", "class",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def op5_lsh_forest(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "class_id", "n_links", "n_copies")


def brute_force(documents: list[tuple[int, str]], similarity: float = SIMILARITY) -> tuple[dict, list[tuple]]:
    """(links between different sets by exact comparison of all pairs, rows (doc_id, class_id, n_links, n_copies)), for tests."""
    sets = [frozenset(zip(*(w[i:] for i in range(WORDS))) if len(w) >= WORDS else [tuple(w)] if w else [])
            for w in ((t or "").encode().split() for _, t in documents)]
    distinct = sorted({s for s in sets if s}, key=lambda s: (len(s), hash(s)))
    links = {s: set() for s in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if len(a) < math.floor(similarity * len(b)):
                break
            if len(a & b) >= similarity * len(a | b) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    of: dict[frozenset, int] = {}
    for k, s in enumerate(distinct):
        if s in of:
            continue
        todo = [s]
        of[s] = k
        while todo:
            for x in links[todo.pop()]:
                if x not in of:
                    of[x] = k
                    todo.append(x)
    least: dict[int, int] = {}
    for (i, _), s in zip(documents, sets):
        if s and i is not None:
            least[of[s]] = min(least.get(of[s], i), i)
    return links, [(i, least.get(of[s]) if s else i, len(links[s]) if s else 0, sets.count(s) if s else 1)
                   for (i, _), s in zip(documents, sets)]
