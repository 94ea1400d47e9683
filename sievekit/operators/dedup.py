"""First-wins duplicate resolution (lexicographically-first maximal independent set).

Walking designs in ascending index and keeping every design that has no kept
smaller neighbour is the lexicographically-first maximal independent set
(LFMIS) of the similarity graph - not its connected components (A~B, B~C,
not A~C keeps A and C). It splits over components, so ``first_wins`` walks
each component of candidates in one task. Components too large for that, edge
tables and buckets are settled in synchronous rounds:

* an undecided node with a kept smaller neighbour becomes a duplicate;
* an undecided node whose smaller neighbours are all duplicates is kept.

Two further graph shapes are supported:

* ``first_wins_edges``   - an explicit verified edge table;
* ``first_wins_buckets`` - bucket membership (LSH mode): members of one
  bucket are pairwise neighbours, but no pair is ever materialised. A bucket
  has at most one kept member, so per round it is enough to aggregate
  ``(has_kept, smallest non-duplicate member)`` per bucket and join that back.

Each round's state is written as a Parquet table into the session's shared
checkpoint directory, which cuts lineage and survives executor loss.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_at_exit, drop_path, scratch_path, ship, shuffles_freed

UNDECIDED, KEPT, DUP = 0, 1, 2
#: Set elements of a component that one task walks at most.
GIANT_CELLS = 10_000_000
#: Members of a posting list from which on they are linked to its least one, in place of candidate pairs.
LONG_LIST = 64
LINKS = "duplicate_index long, original_index long, similarity double"


def _checkpoint(df: DataFrame, options: dict | None = None) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Cuts lineage like a reliable checkpoint, survives executor loss, stays
    columnar/compressed for the readers, and plans through the normal writer
    (so Arrow UDFs in ``df`` are extracted as usual). The shuffle files of the
    write go with its end: nothing reads them again.
    """
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, "mat-" + uuid.uuid4().hex)
    drop_at_exit(spark, path)
    with shuffles_freed(spark):
        df.write.mode("overwrite").options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of ``_checkpoint`` that no later step reads."""
    for t in tables:
        drop_path(t.sparkSession, t._scratch_path)


def first_wins_edges(edges: DataFrame) -> DataFrame:
    """LFMIS over ``edges(i, j)`` with i < j; returns ``(node, state)`` for nodes with edges.

    Edges into a decided node, and edges from a duplicate, decide nothing more
    and are left out of the next round.
    """
    e = _checkpoint(edges.select("i", "j").distinct())
    state = _checkpoint(e.select(F.col("i").alias("node")).union(e.select(F.col("j").alias("node"))).distinct()
                        .withColumn("state", F.lit(UNDECIDED)))
    while True:
        src = state.select(F.col("node").alias("i"), F.col("state").alias("st_i"))
        inc = (e.join(src, "i").groupBy("j").agg(
            F.max((F.col("st_i") == KEPT).cast("int")).alias("any_kept"),
            F.max((F.col("st_i") != DUP).cast("int")).alias("any_open")))
        nxt = _checkpoint(state.join(inc, state["node"] == inc["j"], "left")
                          .select("node", F.when(F.col("state") != UNDECIDED, F.col("state"))
                                  .when(F.col("any_kept") == 1, F.lit(DUP))
                                  .when(F.coalesce("any_open", F.lit(0)) == 0, F.lit(KEPT))
                                  .otherwise(F.lit(UNDECIDED)).alias("state")))
        release(state)
        state = nxt
        und = state.where(F.col("state") == UNDECIDED).select(F.col("node").alias("j"))
        if und.isEmpty():
            release(e)
            return state
        dup = state.where(F.col("state") == DUP).select(F.col("node").alias("i"))
        left = _checkpoint(e.join(und, "j", "left_semi").join(dup, "i", "left_anti"))
        release(e)
        e = left


def first_wins_buckets(members: DataFrame) -> DataFrame:
    """LFMIS where ``members(node, bucket)`` rows make each bucket a clique.

    Returns ``(node, state, similar_to)``; ``similar_to`` is the smallest kept
    node sharing a bucket with a duplicate. Single-member buckets are dropped
    first; no pair of nodes is ever emitted.
    """
    m = members.select("node", "bucket").distinct()
    sizes = m.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    m = _checkpoint(m.join(sizes.where(F.col("n") > 1).select("bucket"), "bucket"))
    state = _checkpoint(m.select("node").distinct().withColumn("state", F.lit(UNDECIDED)))
    while True:
        ms = m.join(state, "node")
        per_bucket = ms.groupBy("bucket").agg(
            F.max(F.when(F.col("state") == KEPT, F.col("node"))).alias("kept_node"),
            F.min(F.when(F.col("state") != DUP, F.col("node"))).alias("min_open"))
        und = ms.where(F.col("state") == UNDECIDED).select("node", "bucket")
        votes = (und.join(per_bucket, "bucket").groupBy("node").agg(
            F.max(F.col("kept_node").isNotNull().cast("int")).alias("any_kept"),
            F.min((F.col("min_open") == F.col("node")).cast("int")).alias("all_first")))
        nxt = (state.join(votes, "node", "left")
               .select("node", F.when(F.col("state") != UNDECIDED, F.col("state"))
                       .when(F.col("any_kept") == 1, F.lit(DUP))
                       .when(F.col("all_first") == 1, F.lit(KEPT))
                       .otherwise(F.lit(UNDECIDED)).alias("state")))
        nxt = _checkpoint(nxt)
        release(state)
        state = nxt
        if state.where(F.col("state") == UNDECIDED).isEmpty():
            break
    kept_in_bucket = (m.join(state.where(F.col("state") == KEPT), "node")
                      .select("bucket", F.col("node").alias("kept_node")))
    link = (m.join(state.where(F.col("state") == DUP).select("node"), "node")
            .join(kept_in_bucket, "bucket")
            .groupBy("node").agg(F.min("kept_node").alias("similar_to")))
    return state.join(link, "node", "left")


def links_from_edges(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(duplicate_index, original_index, similarity): the smallest kept neighbour of each dup."""
    kept = state.where(F.col("state") == KEPT).select(F.col("node").alias("i"))
    dups = state.where(F.col("state") == DUP).select(F.col("node").alias("j"))
    best = (edges.join(kept, "i").join(dups, "j")
            .groupBy("j").agg(F.min(F.struct("i", "sim")).alias("b")))
    return best.select(F.col("j").alias("duplicate_index"),
                       F.col("b.i").alias("original_index"),
                       F.col("b.sim").alias("similarity"))


def expand_collapsed_links(members: DataFrame, rep_links: DataFrame) -> DataFrame:
    """Links for every design given links of representatives of equal-set groups.

    A representative r that is kept makes every other member a duplicate of r
    with similarity 1; a duplicate r passes its own original and similarity on
    (equal sets have equal neighbourhoods, so the greedy walk agrees).
    """
    non_rep = members.where(F.col("id") != F.col("rep"))
    rl = rep_links.select(F.col("duplicate_index").alias("rep"),
                          F.col("original_index").alias("r_orig"),
                          F.col("similarity").alias("r_sim"))
    derived = (non_rep.join(rl, "rep", "left").select(
        F.col("id").alias("duplicate_index"),
        F.coalesce("r_orig", "rep").alias("original_index"),
        F.coalesce("r_sim", F.lit(1.0)).alias("similarity")))
    return rep_links.select("duplicate_index", "original_index", "similarity").unionByName(derived)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of ``edges(a, b)``.

    A label moves to the least label next to it, and on to that node's own label, so chains shrink by halves.
    """
    both = _checkpoint(edges.where("a <> b").select("a", "b")
                       .unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = _checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near")))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        moved = _checkpoint(lower.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), "old"))
        changed = not moved.where("label <> old").isEmpty()
        release(labels)
        labels = moved
        if not changed:
            release(both)
            return labels.select("node", "label")


def shared_elements(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def overlap_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = shared_elements(a, b)
    return both / (len(a) + len(b) - both)


def equal_places(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal positions of two signatures."""
    return int((a == b).sum()) / len(a)


def _walk_rows(threshold: float, similarity, use_length: bool):
    """Rows sorted by (component, id): duplicates with their original, the smallest kept design that is similar.

    Only kept designs of the component are held, with their postings; a design meets those that share one with it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept, lists = None, [], {}
        for b in batches:
            found = []
            n_sets, n_toks = b.column(2), b.column(3)
            for k, (comp, ident) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if comp != group:
                    group, kept, lists = comp, [], {}
                values = np.array(n_sets[k].values) if similarity is equal_places else np.sort(np.array(n_sets[k].values))
                toks = n_toks[k].values.to_pylist()
                near = sorted({i for t in toks for i in lists.get(t, ())})  # kept ones by id, as they came
                for i in near:
                    other, other_id = kept[i]
                    if use_length and min(len(values), len(other)) < threshold * max(len(values), len(other)) - 1e-9:
                        continue
                    sim = similarity(other, values)
                    if sim >= threshold:
                        found.append((ident, other_id, sim))
                        break
                else:
                    for t in toks:
                        lists.setdefault(t, []).append(len(kept))
                    kept.append((values, ident))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                names=["duplicate_index", "original_index", "similarity"])
    return run


def candidate_components(docs: DataFrame, threshold: float, prefix: DataFrame | None, giant_cells: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs with sizes, shared postings, groups(id, label, giant)): components that hold every similar pair.

    Members of a long list are linked to its least design, without comparison. Pairs of short lists are linked only if
    their sizes and positions let them be similar (``candidate_pairs``), so that tokens shared by chance do not grow
    everything together. A similar pair shares a list: a long one, or all its common prefix tokens are in short ones.
    """
    from .simjoin import prefix_table
    docs = _checkpoint(docs.select("id", "set").withColumn("n", F.size("set")).where(F.col("n") > 0))
    pre = shared_postings(prefix if prefix is not None else prefix_table(docs, float(threshold)))
    return docs, pre, posting_components(pre, docs.select("id", "n"), threshold, giant_cells)


def shared_postings(pre: DataFrame) -> DataFrame:
    """The rows of ``pre(id, n, tok, ..)`` of lists with two designs or more, written once, with the list's size ``p`` and least design ``first``.

    Designs alone on all their lists have no neighbour; a list's size and least design come from the one shuffle by token.
    """
    by_tok = Window.partitionBy("tok")
    return _checkpoint(pre.withColumn("p", F.count(F.lit(1)).over(by_tok)).withColumn("first", F.min("id").over(by_tok)).where("p > 1"))


def posting_components(pre: DataFrame, sizes: DataFrame, threshold: float, giant_cells: int) -> DataFrame:
    """groups(id, label, giant) of ``shared_postings``, of designs with ``sizes(id, n)``; see ``candidate_components``."""
    from .simjoin import candidate_pairs
    ordered = "pos" in pre.columns  # postings of Jaccard prefixes
    edges = (pre.where(F.col("p") > LONG_LIST) if ordered else pre).select(F.col("first").alias("a"), F.col("id").alias("b"))
    if ordered:
        edges = edges.unionByName(candidate_pairs(pre.where(F.col("p") <= LONG_LIST), float(threshold)).toDF("a", "b"))
    groups = components(edges.distinct())
    cells = (sizes.select(F.col("id").alias("node"), "n").join(groups, "node").groupBy("label").agg(F.sum("n").alias("cells")))
    return _checkpoint(groups.join(cells, "label").select(F.col("node").alias("id"), "label", (F.col("cells") > giant_cells).alias("giant")))


def by_component(docs, pre: DataFrame, groups: DataFrame) -> DataFrame:
    """(label, id, set, toks) of the components that fit a task, a component's rows together and in index order.

    ``docs(id, set)``, or ``tokensets.PackedSets``, which are joined and dealt packed.
    """
    toks = (pre.select("id", "tok").join(groups.where("not giant"), "id").groupBy("id", "label").agg(F.collect_list("tok").alias("toks")))
    rows, column = (docs, "set") if isinstance(docs, DataFrame) else (docs.table, "packed")
    dealt = (rows.select("id", column).join(toks, "id").select("label", "id", column, "toks")
             .repartition(F.col("label")).sortWithinPartitions("label", "id"))
    return dealt if rows is docs else docs.opened(dealt)


def sets_among(docs, ids: DataFrame) -> DataFrame:
    """(id, set, n) of ``docs``, a table or ``tokensets.PackedSets``, whose id is among ``ids``."""
    if isinstance(docs, DataFrame):
        return docs.join(ids, "id", "left_semi")
    return docs.opened(docs.table.join(ids, "id", "left_semi"))


def _class_rows(threshold: float):
    """Rows sorted by (component, id): each design's similar designs, counted, and the least design linked to it over any chain."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, links, top, lists = None, [], [], [], [], {}

        def root(i: int) -> int:
            while top[i] != i:
                top[i] = i = top[top[i]]
            return i

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([ids[root(i)] for i in range(len(ids))], pa.int64()),
                                               pa.array(links, pa.int64())], names=["id", "class", "n_links"])

        for b in batches:
            n_sets, n_toks = b.column(2), b.column(3)
            for k, (comp, ident) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if comp != group:
                    yield found()
                    group, ids, sets, links, top, lists = comp, [], [], [], [], {}
                v, values, toks = len(ids), np.sort(np.array(n_sets[k].values)), n_toks[k].values.to_pylist()
                near = {i for t in toks for i in lists.get(t, ())}
                ids.append(ident)
                sets.append(values)
                links.append(0)
                top.append(v)
                for t in toks:
                    lists.setdefault(t, []).append(v)
                for i in near:
                    small, large = sorted((len(values), len(sets[i])))
                    if small >= threshold * large - 1e-9 and overlap_jaccard(sets[i], values) >= threshold:
                        links[i] += 1
                        links[v] += 1
                        a, z = sorted((root(i), root(v)))
                        top[z] = a
        yield found()
    return run


def _pair_rows(threshold: float):
    """Rows sorted by (component, id): the pairs of similar designs, each with the one met before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, lists = None, [], [], {}
        for b in batches:
            found = []
            n_sets, n_toks = b.column(2), b.column(3)
            for k, (comp, ident) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if comp != group:
                    group, ids, sets, lists = comp, [], [], {}
                values, toks = np.sort(np.array(n_sets[k].values)), n_toks[k].values.to_pylist()
                for i in sorted({i for t in toks for i in lists.get(t, ())}):
                    small, large = sorted((len(values), len(sets[i])))
                    if ids[i] == ident or small < threshold * large - 1e-9:
                        continue
                    both = shared_elements(sets[i], values)
                    sim = both / (small + large - both)
                    if sim >= threshold:
                        found.append((ids[i], ident, both, sim))
                for t in toks:
                    lists.setdefault(t, []).append(len(ids))
                ids.append(ident)
                sets.append(values)
                if len(found) >= 50_000:
                    yield _pairs(found)
                    found = []
            yield _pairs(found)
    return run


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.float64()))],
                                      names=["i", "j", "overlap", "jaccard"])


def component_pairs(docs, pre: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(i, j, overlap, jaccard) of the similar pairs i < j of the designs of ``groups``, whose sets ``docs(id, set, n)`` holds.

    A component's sets go to one task, once; only pairs of giants carry sets through a join.
    """
    from .simjoin import jaccard_self_join
    out = by_component(docs, pre, groups).mapInArrow(_pair_rows(float(threshold)), "i long, j long, overlap int, jaccard double")
    giants = groups.where("giant").select("id")
    if not giants.isEmpty():
        few = _checkpoint(sets_among(docs, giants))
        out = out.unionByName(jaccard_self_join(few, threshold, prefix=pre.join(giants, "id", "left_semi")))
    return out


def similar_classes(docs: DataFrame, threshold: float, giant_cells: int = GIANT_CELLS) -> DataFrame:
    """(id, class, n_links) of every design of ``docs(id, set)``: its class is the least design that links of Jaccard >=
    threshold lead to, ``n_links`` how many designs are that similar to it. No row a pair: m near copies are m rows.

    Components of candidates are counted in a task each; of giants the pairs are joined and counted over the cluster.
    """
    docs, pre, groups = candidate_components(docs, threshold, None, giant_cells)
    return with_alone(docs.select("id"), component_classes(docs, pre, groups, threshold))


def with_alone(ids: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, class, n_links) of all ``ids``; those without a row in ``classes`` are a class each."""
    return ids.join(classes, "id", "left").select("id", F.coalesce("class", "id").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def component_classes(docs, pre: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(id, class, n_links) of the designs of ``groups``, at least of those with links; ``docs(id, set, n)`` holds them."""
    from .simjoin import jaccard_self_join
    out = by_component(docs, pre, groups).mapInArrow(_class_rows(float(threshold)), "id long, class long, n_links long")
    giants = groups.where("giant").select("id")
    if not giants.isEmpty():
        few = _checkpoint(sets_among(docs, giants))
        pairs = _checkpoint(jaccard_self_join(few, threshold, prefix=pre.join(giants, "id", "left_semi")).select("i", "j"))
        links = pairs.select(F.explode(F.array("i", "j")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
        classes = components(pairs.select(F.col("i").alias("a"), F.col("j").alias("b"))).select(F.col("node").alias("id"), F.col("label").alias("class"))
        out = out.unionByName(classes.join(links, "id"))
    return out


def first_wins(docs: DataFrame, threshold: float, prefix: DataFrame | None = None, verify=None,
               use_length: bool = True, similarity=overlap_jaccard, giant_cells: int = GIANT_CELLS):
    """First-wins resolution of the similarity graph of ``docs(id, set)`` without an edge table.

    Designs that share a posting list (a token of their prefixes) are candidates. The walk splits over the
    connected components of the candidate graph, which star edges (a list's least design to the others) give:

    * a component of at most ``giant_cells`` set elements is walked in index order in one task, however long its
      chains are; components are packed into tasks by their label;
    * larger ones, and only they, are settled in rounds over the cluster (``_first_wins_rounds``).

    Returns ``(state(node, state), links)``. ``prefix(id, n, tok)`` are the posting lists (default: Jaccard
    prefixes of ``docs``); ``similarity(a, b)`` compares two sets in a task, ``verify(pairs, docs, t, a, b)`` keeps
    the similar pairs of a table; ``use_length`` applies the Jaccard length filter.
    """
    docs, pre, groups = candidate_components(docs, threshold, prefix, giant_cells)
    links = component_links(docs, pre, groups, threshold, verify, use_length, similarity)
    state = docs.select(F.col("id").alias("node")).join(
        links.select(F.col("duplicate_index").alias("node"), F.lit(DUP).alias("state")), "node", "left").select(
        "node", F.coalesce("state", F.lit(KEPT)).alias("state"))
    return state, links


def component_links(docs, pre: DataFrame, groups: DataFrame, threshold: float, verify=None,
                    use_length: bool = True, similarity=overlap_jaccard) -> DataFrame:
    """First-wins links of the designs of ``groups``, whose sets ``docs(id, set, n)`` holds, over postings ``pre``."""
    links = [_checkpoint(by_component(docs, pre, groups).mapInArrow(_walk_rows(float(threshold), similarity, use_length), LINKS))]
    giants = groups.where("giant").select("id")
    if not giants.isEmpty():
        links.append(_first_wins_rounds(sets_among(docs, giants), pre.join(giants, "id", "left_semi"),
                                        float(threshold), verify, use_length))
    return links[0] if len(links) == 1 else links[0].unionByName(links[1])


def _first_wins_rounds(docs: DataFrame, pre: DataFrame, t: float, verify, use_length: bool) -> DataFrame:
    """First-wins links in rounds over posting lists ``pre(id, n, tok)``, for components too large for a task.

    Each round looks at undecided designs only, and at designs that the round before kept:

    1. undecided v vs newly kept k < v sharing a token -> duplicates;
    2. the rest vs the smallest undecided member of each of its lists -> blocked;
    3. those not yet blocked vs all smaller undecided candidates -> blocked;
    4. undecided designs that nothing blocks are kept.

    A clique of m near copies is settled by steps 1 and 2: O(m * |prefix|) verifications, not m^2 edges. Where all
    common tokens of a pair meet (steps 1 and 3), those of Jaccard prefixes bound its overlap: sets go with few pairs.
    """
    from .simjoin import length_ok as jaccard_length_ok, verify_pairs as jaccard_verify, within_reach
    verify_pairs = verify or jaccard_verify
    counted = use_length and "pos" in pre.columns

    def candidates(right: DataFrame, left: DataFrame, a: str, b: str, whole: bool = True) -> DataFrame:
        """Pairs a < b of posting lists ``left(tok, a, na)`` and ``right(tok, b, nb)``, which hold all or (not ``whole``) some of the tokens of a and b."""
        ok = jaccard_length_ok(F.col("na"), F.col("nb"), t) if use_length else F.lit(True)
        met = right.join(left, "tok").where((F.col(a) < F.col(b)) & ok)
        if not (counted and whole):
            return met.select(a, b).distinct()
        return (met.groupBy(a, b).agg(F.count(F.lit(1)).alias("common"), F.max(F.greatest("na", "nb")).alias("larger"),
                                      F.min(F.col("na") + F.col("nb")).alias("both"))
                .where(within_reach("common", F.col("larger"), "both", t)).select(a, b))

    def lists(p: DataFrame, name: str, n: str) -> DataFrame:
        return p.select("tok", F.col("id").alias(name), F.col("n").alias(n))

    docs, pre = _checkpoint(docs), _checkpoint(pre)
    undecided, new_kept, kept, dups = pre, None, [], []
    while not undecided.isEmpty():
        if new_kept is not None:
            kv = candidates(lists(undecided, "v", "nb"), lists(new_kept, "k", "na"), "k", "v")
            dup = _checkpoint(verify_pairs(kv, docs, t, "k", "v").select(F.col("v").alias("id")).distinct())
            dups.append(dup)
            undecided = undecided.join(dup, "id", "left_anti")
        und = lists(undecided, "v", "nb")
        first = und.groupBy("tok").agg(F.min(F.struct(F.col("v").alias("u"), F.col("nb").alias("na"))).alias("m"))
        quick = candidates(und, first.select("tok", F.col("m.u").alias("u"), F.col("m.na").alias("na")), "u", "v", False)
        blocked = _checkpoint(verify_pairs(quick, docs, t, "u", "v").select("v").distinct())
        rest = und.join(blocked, "v", "left_anti")
        more = verify_pairs(candidates(rest, lists(undecided, "u", "na"), "u", "v"), docs, t, "u", "v").select("v")
        blocked = _checkpoint(blocked.unionByName(more).select(F.col("v").alias("id")).distinct())
        new_kept = _checkpoint(undecided.join(blocked, "id", "left_anti"))
        kept.append(new_kept)
        undecided = _checkpoint(undecided.join(blocked, "id", "left_semi"))

    def ids(tables: list[DataFrame]) -> DataFrame:
        out = docs.select("id").limit(0)
        for x in tables:
            out = out.unionByName(x.select("id"))
        return out.distinct()

    dup = _checkpoint(ids(dups))
    # the original is the smallest kept neighbour overall, which a later round may have kept
    kv = candidates(lists(pre.join(dup, "id", "left_semi"), "v", "nb"),
                    lists(pre.join(ids(kept), "id", "left_semi"), "k", "na"), "k", "v")
    links = (verify_pairs(kv, docs, t, "k", "v").groupBy("v")
             .agg(F.min(F.struct("k", "sim")).alias("b"))
             .select(F.col("v").alias("duplicate_index"), F.col("b.k").alias("original_index"),
                     F.col("b.sim").alias("similarity")))
    return _checkpoint(links)
