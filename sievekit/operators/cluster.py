"""Clustering: K-Means for many k and restarts at once, best-k sweep, PCA projection.

All (k, restart) models advance together, one pass over the vectors a round:

* Vectors are packed once into blocks (ids, a matrix); a pass is one task per
  partition of blocks, with the models' centres sent along. Their number is a
  parameter's, not the data's (``MAX_CENTRE_CELLS`` is checked).
* Start centres: every restart draws ``max(ks)`` points, each with a chance in
  proportion to its squared distance from those before (smallest -ln(u) / d2,
  with u from a hash of restart, step and id), so that they do not depend on
  the engine or the partitioning. A model of k starts from its restart's first k.
* Rounds: a block keeps, for each model that still moves, the label of every
  point, an upper bound of the distance to its centre and a lower bound of that
  to the second one (Hamerly). Points whose bounds are apart are skipped; the
  others meet the model's centres in one matrix product. Only points that
  changed their label enter the sums, which are added up by model. A model
  whose labels stand still drops out of the next pass.
* Distances are compared as squares rounded to ``PLACES``, the lower centre on
  a tie. A cluster that loses all points keeps its centre.
* Inertia comes from the sums; the best restart of each k (the first on a tie)
  is scored with all others in two more passes (squared Euclidean silhouette in
  closed form, O(n k)).

Each round's blocks are a written table, so a lost executor costs its tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .dedup import _checkpoint, release

SEED = 42      # FIXED VALUE: base seed of the restarts
N_INIT = 10    # FIXED VALUE: restarts per k
MAX_ITER = 300
PLACES = 6
#: Points of a block; numbers of all models' centres at most (sent to the tasks); steps that one hash serves.
BLOCK_POINTS, MAX_CENTRE_CELLS, HASH_STEPS = 2048, 16_000_000, 16
#: Bounds closer than this are looked at again: far above the error of a distance, far below what rounding can tell.
MARGIN = 2e-3

_STATE = "ids binary, x binary, draws binary, labels binary, upper binary, lower binary"


@dataclass
class Model:
    k: int
    restart: int
    centres: np.ndarray
    sums: np.ndarray | None = None
    counts: np.ndarray | None = None
    cost: float = math.inf
    rounds: int = 0


@dataclass
class Fit:
    k: int
    model: Model
    cost: float
    silhouette: float


def k_range(n: int) -> tuple[int, int]:
    """(min_k, max_k) = (max(3, n//100), min(50, n//10))."""
    return max(3, n // 100), min(50, n // 10)


# ---- blocks -----------------------------------------------------------------

def _array(raw, kind) -> np.ndarray:
    return np.frombuffer(raw, kind)


def _pack(n_init: int, max_k: int, seed: int):
    """(design_idx, features) rows to blocks, with the hashes that start centres are drawn by."""
    turns = -(-max_k // HASH_STEPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK_POINTS):
                part = b.slice(i, BLOCK_POINTS)
                ids = part.column(0).to_pylist()
                x = np.asarray(part.column(1).flatten(), float)
                draws = b"".join(hashlib.md5(f"{seed + r}:{t}:{d}".encode()).digest() for r in range(n_init) for t in range(turns) for d in ids)
                yield _blocks([(np.array(ids, np.int64).tobytes(), x.tobytes(), draws, None, None, None)])
    return run


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _STATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.binary()) for c in range(len(names))], names=names)


def pack_points(vectors: DataFrame, n_init: int, max_k: int, seed: int) -> DataFrame:
    """``vectors(design_idx, features)`` as a written table of blocks."""
    return _checkpoint(vectors.select("design_idx", "features").mapInArrow(_pack(n_init, max_k, seed), _STATE))


def _points(ids, x) -> tuple[np.ndarray, np.ndarray]:
    ids = _array(ids, np.int64)
    return ids, _array(x, float).reshape(len(ids), -1)


def square_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points and centres, rounded for comparison."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    return np.round(np.maximum(d, 0), PLACES)


# ---- start centres ------------------------------------------------------------

def _draw(draws: np.ndarray, restart: int, step: int) -> np.ndarray:
    """-ln(u) of every point: u from 13 hex digits of the hash, at a place of its own for each step."""
    turn, shift = divmod(step, HASH_STEPS)
    high, low = draws[restart, turn, :, 0], draws[restart, turn, :, 1]
    bits = np.uint64(4 * shift)
    top = high if shift == 0 else (high << bits) | (low >> (np.uint64(64) - bits))
    return -np.log(((top >> np.uint64(12)).astype(float) + 1) / 2.0 ** 52)


def _pick_rows(chosen: list[np.ndarray] | None, step: int, n_init: int, turns: int):
    """Of each restart the point of the smallest key in the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for b in batches:
            for ids, x, draws in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                ids, x = _points(ids, x)
                draws = np.frombuffer(draws, ">u8").astype(np.uint64).reshape(n_init, turns, len(ids), 2)
                for r in range(n_init):
                    key = _draw(draws, r, step)
                    if chosen is not None:
                        near = square_distances(x, chosen[r]).min(1)
                        key = np.divide(key, near, out=np.full(len(key), np.inf), where=near > 0)
                    at = np.lexsort((ids, key))[0]
                    found = (float(key[at]), int(ids[at]), x[at].tobytes())
                    best[r] = min(best.get(r, found), found)
        rows = [(r, *v) for r, v in best.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v[c] for v in rows], t) for c, t in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.binary()))],
            names=["r", "key", "id", "x"])
    return run


def start_centres(blocks: DataFrame, n_init: int, max_k: int) -> list[np.ndarray]:
    """Of each restart ``max_k`` points in the order they were drawn; ``n_init`` rows a step reach the driver."""
    chosen: list[np.ndarray] | None = None
    for step in range(max_k):
        rows = (blocks.select("ids", "x", "draws").mapInArrow(_pick_rows(chosen, step, n_init, -(-max_k // HASH_STEPS)), "r int, key double, id long, x binary")
                .groupBy("r").agg(F.min(F.struct("key", "id", "x")).alias("b")).collect())
        new = {row.r: _array(bytes(row.b.x), float) for row in rows}
        chosen = [np.vstack([chosen[r], new[r]]) if chosen else new[r][None] for r in range(n_init)]
    return chosen


# ---- rounds -------------------------------------------------------------------

def _split(raw, kind, models: int, n: int) -> np.ndarray:
    return _array(raw, kind).reshape(models, n)


def _round_rows(models: list[tuple[np.ndarray, np.ndarray]], held: list[int] | None):
    """One round over blocks: new labels and bounds (kind 0), and the changes of the sums by model (kind 1).

    ``models``: centres, and how far each moved in the last round; ``held``: which of the state's models they are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change: dict[int, list] = {}
        apart = []
        for c, _ in models:
            between = np.sqrt(np.maximum((c * c).sum(1)[:, None] - 2 * c @ c.T + (c * c).sum(1), 0))
            np.fill_diagonal(between, np.inf)
            apart.append(between.min(1) / 2)
        for b in batches:
            for ids_raw, x_raw, draws, labels, upper, lower in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, x = _points(ids_raw, x_raw)
                n = len(ids)
                if held is None:
                    old = [(np.full(n, -1, np.int16), np.full(n, np.inf), np.zeros(n))] * len(models)
                else:
                    before = len(labels) // (2 * n)
                    old = list(zip(*(_split(a, t, before, n)[held] for a, t in ((labels, np.int16), (upper, float), (lower, float)))))
                out = []
                for m, ((centres, moved), (label, up, low)) in enumerate(zip(models, old, strict=True)):
                    label, up, low = label.copy(), up + np.where(label >= 0, moved[label], 0), low - moved.max()
                    look = np.flatnonzero(up + MARGIN >= np.maximum(low, apart[m][label]))
                    d = square_distances(x[look], centres)
                    near = d.argmin(1)
                    up[look] = np.sqrt(d[np.arange(len(look)), near])
                    d[np.arange(len(look)), near] = np.inf
                    low[look] = np.sqrt(d.min(1, initial=np.inf))
                    turned = near != label[look]
                    if turned.any():
                        k = len(centres)
                        sums, counts = change.setdefault(m, [np.zeros_like(centres), np.zeros(k, np.int64)])
                        points, new, last = x[look[turned]], near[turned], label[look[turned]]
                        np.add.at(sums, new, points)
                        counts += np.bincount(new, minlength=k)
                        left = last >= 0
                        np.subtract.at(sums, last[left], points[left])
                        counts -= np.bincount(last[left], minlength=k)
                        label[look] = near
                    out.append((label, up, low))
                state = [np.concatenate([o[c] for o in out]).tobytes() for c in range(3)]
                yield _with_kind(_blocks([(ids_raw, x_raw, draws, *state)]), None)
        for m, (sums, counts) in change.items():
            yield _with_kind(_blocks([(None, sums.tobytes(), counts.tobytes(), None, None, None)]), m)
    return run


def _with_kind(block: pa.RecordBatch, model: int | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), *block.columns], names=["model", *block.schema.names])


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(model, sums, counts) rows added up by model, as far as they meet in the task."""
    total: dict[int, list] = {}
    for b in batches:
        for m, sums, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            s, c = _array(sums, float), _array(counts, np.int64)
            if m in total:
                total[m][0] += s
                total[m][1] += c
            else:
                total[m] = [s.copy(), c.copy()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([v[0].tobytes() for v in total.values()], pa.binary()),
         pa.array([v[1].tobytes() for v in total.values()], pa.binary())], names=["model", "sums", "counts"])


def _added(changes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums by model: the models' centres in number, whatever the points'."""
    ship(changes.sparkSession)
    rows = changes.mapInArrow(_add_rows, "model int, sums binary, counts binary").repartition("model").mapInArrow(
        _add_rows, "model int, sums binary, counts binary").collect()
    return {r.model: (_array(bytes(r.sums), float), _array(bytes(r.counts), np.int64)) for r in rows}


def fit_models(blocks: DataFrame, grid: list[tuple[int, int]], starts: list[np.ndarray], total_square: float, max_iter: int = MAX_ITER) -> list[Model]:
    """All models ``(k, restart)`` of the grid to the end, in passes that all of them share."""
    models = [Model(k, r, starts[r][:k].copy()) for k, r in grid]
    if sum(m.centres.size for m in models) > MAX_CENTRE_CELLS:
        raise ValueError("too many centres to send to the tasks: fewer k or restarts")
    live, held, table, written = list(range(len(models))), None, blocks, None
    moves = {i: np.zeros(m.k) for i, m in enumerate(models)}
    for _ in range(max_iter):
        if not live:
            break
        sent = [(models[i].centres, moves[i]) for i in live]
        nxt = _checkpoint(table.mapInArrow(_round_rows(sent, held), "model int, " + _STATE))
        if written:
            release(written)
        written, table = nxt, nxt.where("model is null").drop("model")
        changes = _added(nxt.where("model is not null").select("model", F.col("x").alias("sums"), F.col("draws").alias("counts")))
        keep = []
        for place, i in enumerate(live):
            m = models[i]
            m.rounds += 1
            if place not in changes:  # no label changed
                continue
            sums, counts = changes[place]
            m.sums = sums.reshape(m.centres.shape) + (0 if m.sums is None else m.sums)
            m.counts = counts + (0 if m.counts is None else m.counts)
            centres = np.where(m.counts[:, None] > 0, m.sums / np.maximum(m.counts, 1)[:, None], m.centres)
            moves[i] = np.sqrt(((centres - m.centres) ** 2).sum(1))
            m.centres = centres
            keep.append(place)
        held, live = keep, [live[p] for p in keep]
    if written:
        release(written)
    for m in models:
        filled = m.counts > 0
        m.cost = total_square - float(((m.sums[filled] ** 2).sum(1) / m.counts[filled]).sum())
    return models


# ---- scores and labels --------------------------------------------------------

def _cluster_stats_rows(centres: list[np.ndarray]):
    """By model: points, sums and summed squares of the clusters that its centres make."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(c), c.shape[1] + 1)) for c in centres]
        counts = [np.zeros(len(c), np.int64) for c in centres]
        for b in batches:
            for ids, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, x = _points(ids, x)
                more = np.column_stack([x, (x * x).sum(1)])
                for m, c in enumerate(centres):
                    near = square_distances(x, c).argmin(1)
                    np.add.at(sums[m], near, more)
                    counts[m] += np.bincount(near, minlength=len(c))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres)), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary()),
                                          pa.array([c.tobytes() for c in counts], pa.binary())], names=["model", "sums", "counts"])
    return run


def _silhouette_rows(models: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
    """By model the summed silhouettes of the task's points; a model is centres, counts, means and mean squares."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(models))
        for b in batches:
            for ids, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, x = _points(ids, x)
                square = (x * x).sum(1)[:, None]
                for m, (centres, counts, means, squares) in enumerate(models):
                    own = square_distances(x, centres).argmin(1)
                    mean_d = square - 2 * x @ means.T + squares
                    mean_d[:, counts == 0] = np.inf
                    at = np.arange(len(x))
                    n = counts[own]
                    a = np.maximum(mean_d[at, own], 0) * n / np.maximum(n - 1, 1)
                    mean_d[at, own] = np.inf
                    other = mean_d.min(1, initial=np.inf)
                    top = np.maximum(a, other)
                    fair = (n > 1) & np.isfinite(other) & (top > 0)
                    total[m] += ((other - a)[fair] / top[fair]).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models)), pa.int32()), pa.array(total)], names=["model", "s"])
    return run


def score_models(blocks: DataFrame, models: list[Model], n: int) -> list[float]:
    """Silhouettes of all models in two passes; 0 where there is one cluster."""
    points = blocks.select("ids", "x")
    got = _added(points.mapInArrow(_cluster_stats_rows([m.centres for m in models]), "model int, sums binary, counts binary"))
    full = []
    for i, m in enumerate(models):
        counts = got[i][1]
        mean = got[i][0].reshape(m.k, -1) / np.maximum(counts, 1)[:, None]
        full.append((m.centres, counts, mean[:, :-1], mean[:, -1]))
    sums = {r.model: r.s for r in points.mapInArrow(_silhouette_rows(full), "model int, s double").groupBy("model").agg(F.sum("s").alias("s")).collect()}
    return [sums[i] / n if (full[i][1] > 0).sum() > 1 else 0.0 for i in range(len(models))]


def _label_rows(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, x = _points(ids, x)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(square_distances(x, centres).argmin(1).astype(np.int32))],
                                                 names=["design_idx", "cluster"])
    return run


def labels_of(blocks: DataFrame, model: Model) -> DataFrame:
    return _checkpoint(blocks.select("ids", "x").mapInArrow(_label_rows(model.centres), "design_idx long, cluster int"))


def _square_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        both = [(len(i) // 8, float((_array(x, float) ** 2).sum())) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in both], pa.int64()), pa.array([v[1] for v in both], pa.float64())], names=["n", "s"])


def sweep(blocks: DataFrame, n: int, total_square: float, ks: list[int], n_init: int = N_INIT, max_iter: int = MAX_ITER) -> list[Fit]:
    """The best restart (lowest cost, the first on a tie) of every k, with its silhouette."""
    starts = start_centres(blocks, n_init, max(ks))
    models = fit_models(blocks, [(k, r) for k in ks for r in range(n_init)], starts, total_square, max_iter)
    best = [min(models[i * n_init:(i + 1) * n_init], key=lambda m: (round(m.cost, PLACES), m.restart)) for i in range(len(ks))]
    return [Fit(m.k, m, m.cost, s) for m, s in zip(best, score_models(blocks, best, n))]


def sweep_table(spark, fits: list[Fit]) -> DataFrame:
    return spark.createDataFrame([(f.k, float(f.silhouette), float(f.cost)) for f in fits], "k int, silhouette double, cost double")


def choose(fits: list[Fit]) -> Fit:
    """The fit of highest silhouette (to PLACES + 3 places), of the lowest k on a tie."""
    return min(fits, key=lambda f: (-round(f.silhouette, PLACES + 3), f.k))


def cluster(vectors: DataFrame, n_init: int = N_INIT, k_step: int = 1, seed: int = SEED):
    """-> (labels DataFrame(design_idx, cluster), k, silhouette, sweep table).

    The k range comes from the number of points; an empty range gives k = its lower end with score -1.
    """
    n = vectors.count()
    if n < 3:
        raise ValueError("need at least 3 designs to cluster")
    lo, hi = k_range(n)
    ks = list(range(lo, hi + 1, k_step))
    # enough partitions for all cores without a shuffle of vectors where the scan has them
    blocks = pack_points(vectors, n_init, max(ks or [lo]), seed)
    square = blocks.select("ids", "x").mapInArrow(_square_rows, "n long, s double").agg(F.sum("s")).first()[0]
    fits = sweep(blocks, n, square, ks or [lo], n_init)
    best = choose(fits)
    labels = labels_of(blocks, best.model)
    table = sweep_table(vectors.sparkSession, fits if ks else [])
    release(blocks)
    return labels, best.k, best.silhouette if ks else -1.0, table


# ---- projection ---------------------------------------------------------------

#: Rotations end when all cross products are below this share of the trace.
JACOBI_SHARE, JACOBI_SWEEPS = 1e-15, 100


def _moment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and the upper triangle of the products of a task's vectors."""
    n, sums, products = 0, None, None
    for b in batches:
        if not b.num_rows:
            continue
        x = np.asarray(b.column(0).flatten(), float).reshape(b.num_rows, -1)
        if sums is None:
            sums, products = np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)
        n += len(x)
        sums += x.sum(0)
        products += x.T @ x
    if n:
        upper = products[np.triu_indices(len(sums))]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.concatenate([sums, upper]).tobytes()], pa.binary()),
                                          pa.array([np.array([n]).tobytes()], pa.binary())], names=["model", "sums", "counts"])


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending) and vectors (columns) of a symmetric matrix, by cyclic rotations."""
    a, v, n = a.astype(float).copy(), np.eye(len(a)), len(a)
    least = JACOBI_SHARE * max(float(np.abs(np.diag(a)).sum()), 1e-300)
    for _ in range(JACOBI_SWEEPS):
        if n < 2 or np.abs(a - np.diag(np.diag(a))).max() <= least:
            break
        for p in range(n - 1):
            for q in range(p + 1, n):
                if abs(a[p, q]) <= least:
                    continue
                angle = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = math.copysign(1 / (abs(angle) + math.hypot(angle, 1)), angle) if angle else 1.0
                c = 1 / math.hypot(t, 1)
                s = t * c
                for m in (a.T, a, v.T):  # columns of a, then its rows, then columns of v
                    row = c * m[p] - s * m[q]
                    m[q] = s * m[p] + c * m[q]
                    m[p] = row
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


def pca_points(vectors: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """Coordinates on the first ``k`` principal components of the centred vectors, and explained variance ratios.

    The covariance is one partial aggregate of the products' upper triangle; each component's sign makes its largest
    loading positive (the first of equal ones).
    """
    got = _added(vectors.select("features").mapInArrow(_moment_rows, "model int, sums binary, counts binary"))
    if not got:
        return vectors.select("design_idx", *(F.lit(None).cast("double").alias(f"pc{i + 1}") for i in range(k))), [0.0] * k
    flat, (n,) = got[0]
    d = int((math.sqrt(9 + 8 * len(flat)) - 3) / 2)
    mean, cov = flat[:d] / n, np.zeros((d, d))
    cov[np.triu_indices(d)] = flat[d:] / n
    cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)
    values, axes = jacobi(cov)
    axes = axes[:, :k]
    axes = axes * np.sign(axes[np.abs(np.round(axes, 9)).argmax(0), np.arange(axes.shape[1])])
    total = float(np.maximum(values, 0).sum())
    coords = [F.aggregate(F.zip_with("features", F.array(*map(F.lit, axes[:, i].tolist())), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
              - float(mean @ axes[:, i]) for i in range(axes.shape[1])]
    return (vectors.select("design_idx", *(c.alias(f"pc{i + 1}") for i, c in enumerate(coords))),
            [float(v) / total if total else 0.0 for v in values[:k]])
