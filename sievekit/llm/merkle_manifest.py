"""Operator 13: Merkle manifest of a dataset as a persistent tree with path copying.

Rows become leaves (SHA-256 of length-prefixed fields). The leaves of a group
(here a language) ascend by id and every two consecutive nodes become one, up
to the group's subroot; the subroots become the root in the same way.

1. Leaves are range-sorted once, as digests without texts; prefix sums over the
   ranges give each its place in its group.
2. Aligned blocks of ``2 ** BLOCK_BITS`` nodes are raised to their top in one
   task each; the tops are the nodes of the level above, until a group has one.
3. From the root down, the path of each block's top (the siblings on the way to
   the root) comes to the block below. A block keeps its nodes as a persistent
   tree: a changed leaf is a version that copies its ancestors in the block,
   shares all other nodes, and goes on along the block's path to a root of its
   own. No version meets another, so no task holds the versions of a group.

Defined cases: a null field counts as ``-``, an empty text as ``0:``; a null id
sorts first and is never tampered, a null group is a group of its own and comes
first; rows of equal id ascend by their leaf, and rows that repeat are leaves
each; a group's lone leaf is its subroot; an empty table gives an empty result;
further columns are not read, so names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, read_table

#: Levels of an aligned block.
BLOCK_BITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7
#: One step of a path: the side of the sibling (or that there is none) and its digest as hex text.
LEFT, RIGHT, NONE = b"L", b"R", b"-"
_STEP = 65


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _h(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


class BlockTree:
    """The nodes of one aligned block, level by level; versions copy paths and share the rest."""

    def __init__(self, nodes: list[bytes], height: int):
        self.levels = [nodes]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([_h(*below[i:i + 2]) for i in range(0, len(below), 2)])

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def path(self, place: int) -> bytes:
        """Steps from a node of the lowest level to the block's top."""
        out = []
        for level in self.levels[:-1]:
            other = place ^ 1
            out.append(NONE + b"0" * 64 if other >= len(level) else (LEFT if place & 1 else RIGHT) + level[other])
            place >>= 1
        return b"".join(out)

    def copied(self, place: int, node: bytes) -> list[tuple[int, int, bytes]]:
        """(level, place, digest) of the nodes that a version with another node at ``place`` has of its own."""
        out = [(0, place, node)]
        for k, level in enumerate(self.levels[:-1]):
            pair = (level[place - 1], node) if place & 1 else (node, *level[place + 1:place + 2])
            node, place = _h(*pair), place >> 1
            out.append((k + 1, place, node))
        return out


def steps(path: bytes) -> list[tuple[bytes, bytes]]:
    return [(path[i:i + 1], path[i + 1:i + _STEP]) for i in range(0, len(path), _STEP)]


def fold(node: bytes, path: bytes) -> list[bytes]:
    """The nodes above ``node`` along a path, up to the root."""
    out = []
    for side, other in steps(path):
        node = _h(other, node) if side == LEFT else _h(node, other) if side == RIGHT else _h(node)
        out.append(node)
    return out


def siblings(path: bytes) -> list[bytes]:
    return [other for side, other in steps(path) if side != NONE]


def height_of(n: int, bits: int) -> int:
    """Levels to raise a block of a group of n nodes: all of them if the group has further blocks, else up to one node."""
    return bits if n > 1 << bits else (n - 1).bit_length()


def _numbered(group: int):
    """Sorted rows with their range and their number among the range's rows of their group (column ``group``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, number = TaskContext.get().partitionId(), (), 0
        for b in batches:
            nth = []
            for g in b.column(group).to_pylist():
                if (g,) != last:
                    last, number = (g,), 0
                nth.append(number)
                number += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())],
                                             names=[*b.schema.names, "part", "nth"])
    return run


def place(rows: DataFrame, group: str, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Rows with ``pos``, their place in their group by ``order`` (nulls first), and ``n``, the rows of the group."""
    keys = [F.asc_nulls_first(c) for c in (group, *order)]
    spark = rows.sparkSession
    numbered = scratch.write(
        rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
        .mapInArrow(_numbered(rows.columns.index(group)), f"{_ddl(rows)}, part int, nth long"), name)
    counts = numbered.groupBy(group, "part").agg(F.count("*").alias("c"))
    by = Window.partitionBy(group)
    bases = counts.select(
        F.col(group).alias("_g"), F.col("part").alias("_p"), F.sum("c").over(by).alias("n"),
        F.coalesce(F.sum("c").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return (numbered.join(bases, numbered[group].eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_p")))
            .select(*rows.columns, (F.col("_base") + F.col("nth")).alias("pos"), "n"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _blocks(batches: Iterator[pa.RecordBatch], n_keys: int = 2) -> Iterator[tuple[tuple, list[dict]]]:
    """(key, rows) of blocks whose rows come one after another; the first columns are the key."""
    key, held = None, []
    for b in batches:
        for row in b.to_pylist():
            k = tuple(list(row.values())[:n_keys])
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(row)
    if held:
        yield key, held


def _by_block(rows: DataFrame, bits: int, *order: str) -> DataFrame:
    """Rows dealt by block, the blocks' rows together and in order."""
    rows = rows.withColumn("block", F.shiftright("pos", bits))
    first = ["grp", "block"]
    return (rows.select(*first, *(c for c in rows.columns if c not in first))
            .repartition(partitions(rows.sparkSession), *first).sortWithinPartitions(*first, *order, "pos"))


def raise_blocks(nodes: DataFrame, group: str, bits: int) -> DataFrame:
    """(grp, pos, node, n): the tops of aligned blocks as nodes of the level above."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g, block), rows in _blocks(batches):
            n = rows[0]["n"]
            top = BlockTree([r["node"].encode() for r in rows], height_of(n, bits)).top
            yield pa.RecordBatch.from_arrays(
                [pa.array([g], pa.string()), pa.array([block], pa.int64()), pa.array([top.decode()]), pa.array([-(-n >> bits)], pa.int64())],
                names=["grp", "pos", "node", "n"])

    return _by_block(nodes.select(F.col(group).alias("grp"), "pos", "node", "n"), bits).mapInArrow(
        run, "grp string, pos long, node string, n long")


def _with_paths(nodes: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """Nodes by block, each block's own path before them (``above``: grp, block, path)."""
    nodes = nodes.withColumn("path", F.lit(None).cast("binary")).withColumn("kind", F.lit(1))
    heads = above.select("grp", F.shiftleft("pos", bits).alias("pos"), "path", F.lit(0).alias("kind"))
    return _by_block(nodes.unionByName(heads, allowMissingColumns=True), bits, "kind")


def lower_paths(nodes: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """(grp, pos, path): each node's steps to the root, from the paths of its level's block tops."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g, _), (head, *rows) in _blocks(batches):
            tree = BlockTree([r["node"].encode() for r in rows], height_of(rows[0]["n"], bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array([g] * len(rows), pa.string()), pa.array([r["pos"] for r in rows], pa.int64()),
                 pa.array([tree.path(k) + head["path"] for k in range(len(rows))], pa.binary())], names=["grp", "pos", "path"])

    return _with_paths(nodes, above, bits).mapInArrow(run, "grp string, pos long, path binary")


def climb(nodes: DataFrame, group: str, bits: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """All levels of block tops above ``nodes``, until every group has one node: its subroot."""
    levels = []
    while True:
        levels.append(scratch.write(raise_blocks(nodes, group, bits), f"{name}-{len(levels)}"))
        nodes, group = levels[-1], "grp"
        if (nodes.agg(F.max("n")).first()[0] or 1) <= 1:
            return levels


def descend(levels: list[DataFrame], above: DataFrame, bits: int, scratch: Scratch, name: str) -> DataFrame:
    """Paths of the nodes of the lowest of ``levels``, from the paths of the highest."""
    for k, nodes in reversed(list(enumerate(levels[:-1]))):
        above = scratch.write(lower_paths(nodes, above, bits), f"{name}-{k}")
    return above


_COPY = pa.list_(pa.struct([("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string())]))
PROOF = "subroot string, root string, proof array<string>, folded_root string, copies array<struct<level:int,place:long,digest:string>>"


def _prove(bits: int, schema: pa.Schema, id_col: str, levels_of: Callable[[int], int], with_copies: bool):
    """Blocks of leaves, their path first: each leaf's proof and the root of its version."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, block), (head, *rows) in _blocks(batches):
            n, upper = rows[0]["n"], head["path"]
            tree = BlockTree([r["leaf"].encode() for r in rows], height_of(n, bits))
            above = fold(tree.top, upper)  # shared by all versions that leave the block's top as it is
            inside = levels_of(n) - len(tree.levels) + 1  # steps of the path that stay in the group
            subroot = ([tree.top, *above][inside]).decode()
            root = ([tree.top, *above][-1]).decode()
            others = siblings(upper)
            out = []
            for k, r in enumerate(rows):
                own = tree.copied(k, (r["changed"] or r["leaf"]).encode())
                top = own[-1][2]
                rest = above if top == tree.top else fold(top, upper)
                proof = [x.decode() for x in (*siblings(tree.path(k)), *others)]
                copies = None
                if with_copies and r["changed"]:
                    at, copies = block, [{"level": a, "place": b + (block << bits >> a), "digest": d.decode()} for a, b, d in own]
                    for i, d in enumerate(rest):
                        at = at >> 1 if i < inside else 0
                        copies.append({"level": len(own) + i, "place": at if i < inside else None, "digest": d.decode()})
                out.append((r[id_col], r["leaf"], subroot, root, proof, (rest[-1] if rest else top).decode(), copies))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], f.type) for c, f in enumerate(schema)], schema=schema)
    return run


def prove(leaves: DataFrame, id_col: str = "doc_id", group: str = "lang", bits: int = BLOCK_BITS, with_copies: bool = False) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root, copies) of every row of ``leaves(id, group, leaf, changed)``.

    ``changed`` is the leaf of a version (null: none). ``proof`` lists the siblings up to the root, ``folded_root`` is
    the version's root, and ``copies`` the nodes that the version does not share: those of its group with their level
    and place, then those above the subroot (place null).
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = leaves.sparkSession
    scratch = Scratch(spark, "merkle")
    rows = scratch.write(leaves.select(id_col, group, "leaf", "changed"), "leaves")
    placed = scratch.write(place(rows, group, [id_col, "leaf"], scratch, "numbered"), "placed")
    scratch.drop("leaves", "numbered")
    tree = climb(placed.withColumn("node", F.col("leaf")), group, bits, scratch, "tops")
    # the subroots are one group, in order of their own groups
    subroots = place(tree[-1].select(F.lit("").alias("all"), F.col("grp").alias("name"), "node"), "all", ["name"], scratch, "subroots")
    subroots = scratch.write(subroots, "forest")
    forest = climb(subroots, "all", bits, scratch, "forest-tops")
    roof = forest[-1].select("grp", "pos", F.lit(b"").alias("path"))
    roof = descend(forest, roof, bits, scratch, "forest-paths")
    of_subroots = lower_paths(subroots.select(F.col("all").alias("grp"), "pos", "node", "n"), roof, bits)
    top = scratch.write(subroots.join(of_subroots, "pos").select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "path"), "roof")
    above = descend(tree, top, bits, scratch, "paths")
    ident = placed.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(ident)), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                        ("proof", pa.list_(pa.string())), ("folded_root", pa.string()), ("copies", _COPY)])
    met = _with_paths(placed.withColumnRenamed(group, "grp"), above, bits)
    return met.mapInArrow(_prove(bits, schema, id_col, lambda n: (n - 1).bit_length(), with_copies),
                          f"`{id_col}` {ident.simpleString()}, leaf string, {PROOF}")


def document_leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tamper_every: int = TAMPER_EVERY) -> DataFrame:
    """(doc_id, lang, leaf, changed): ``changed`` is the leaf with one more in n_chars, where tampered."""
    values = [F.col(c) for c in fields]
    more = [(F.col(c).cast("decimal(20,0)") + 1) if c == "n_chars" else F.col(c) for c in fields]
    hit = F.crc32(F.col("doc_id").cast("string")) % tamper_every == 0
    return docs.select("doc_id", "lang", leaf_digest(values).alias("leaf"), F.when(hit, leaf_digest(more)).alias("changed"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    proven = prove(document_leaves(read_table(spark, sf_dir, "documents", *FIELDS)))
    return proven.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_CRC = ("list_reduce(list_prepend(4294967295::UBIGINT, [ascii(c)::UBIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), [0,0,0,0,0,0,0,0]::UBIGINT[]), "
        "lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))")
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"


def _leaf_sql(chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(chars if f == "n_chars" else f) for f in FIELDS) + ")"


#: A tree of nodes (grp, lvl, pos, d, n): every two become one until n is 1.
_LEVELS = """{name} AS (
  SELECT grp, 0 AS lvl, pos, d, n FROM {start}
  UNION ALL
  SELECT grp, lvl + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1
  GROUP BY grp, lvl, pos // 2)"""
OP13_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang AS grp, {_leaf_sql('n_chars')} AS leaf,
         CASE WHEN xor({_CRC}, 4294967295::UBIGINT) % {TAMPER_EVERY} = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS changed
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n, leaf AS d
  FROM rows),
{_LEVELS.format(name='tree', start='leaves')},
subroots AS (
  SELECT grp AS lang, d, lvl, '' AS grp, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
{_LEVELS.format(name='forest', start='subroots')},
root AS (SELECT d AS root FROM forest WHERE n = 1),
step AS (
  SELECT l.doc_id, l.leaf, l.changed, l.grp, s.d AS subroot, s.pos AS place, s.lvl AS height, l.pos, 0 AS lvl, '' AS proof,
         coalesce(l.changed, l.leaf) AS folded
  FROM leaves l JOIN subroots s ON l.grp IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT t.doc_id, t.leaf, t.changed, t.grp, t.subroot, t.place, t.height, t.pos // 2, t.lvl + 1, t.proof || coalesce(o.d, ''),
         CASE WHEN t.pos % 2 = 1 THEN sha256(o.d || t.folded) ELSE sha256(t.folded || coalesce(o.d, '')) END
  FROM step t LEFT JOIN tree o ON o.grp IS NOT DISTINCT FROM t.grp AND o.lvl = t.lvl AND o.pos = xor(t.pos, 1)
  WHERE t.lvl < t.height),
up AS (
  SELECT doc_id, leaf, subroot, place AS pos, 0 AS lvl, proof, folded FROM step WHERE lvl = height
  UNION ALL
  SELECT t.doc_id, t.leaf, t.subroot, t.pos // 2, t.lvl + 1, t.proof || coalesce(o.d, ''),
         CASE WHEN t.pos % 2 = 1 THEN sha256(o.d || t.folded) ELSE sha256(t.folded || coalesce(o.d, '')) END
  FROM up t LEFT JOIN forest o ON o.lvl = t.lvl AND o.pos = xor(t.pos, 1)
  WHERE t.lvl < (SELECT max(lvl) FROM forest))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM up, root WHERE lvl = (SELECT max(lvl) FROM forest)
"""


def brute_force(rows: list[dict], fields: tuple[str, ...] = FIELDS, tamper_every: int = TAMPER_EVERY) -> list[tuple]:
    """The query's rows by whole trees in plain Python, for tests; each version's root by building all its tree anew."""
    def leaf(r: dict) -> bytes:
        return _h(b"".join(b"-" if r[f] is None else f"{len(str(r[f]).encode())}:{r[f]}".encode() for f in fields))

    def tree(nodes: list[bytes]) -> list[list[bytes]]:
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([_h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
        return levels

    def beside(levels: list[list[bytes]], i: int) -> list[bytes]:
        out = []
        for level in levels[:-1]:
            out += level[i ^ 1:(i ^ 1) + 1]
            i >>= 1
        return out

    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in names}
    subroots = [trees[g][-1][0] for g in names]
    forest = tree(subroots) if subroots else []
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % tamper_every == 0 and r["n_chars"] is not None
            leaves = list(trees[g][0])
            if changed:
                leaves[i] = leaf(r | {"n_chars": r["n_chars"] + 1})
            folded = tree([*subroots[:k], tree(leaves)[-1][0], *subroots[k + 1:]])[-1][0]
            proof = sha256(b"".join([*beside(trees[g], i), *beside(forest, k)])).hexdigest()
            root = forest[-1][0]
            out.append((r["doc_id"], trees[g][0][i].decode(), subroots[k].decode(), root.decode(), proof, folded.decode(), folded == root))
    return out
