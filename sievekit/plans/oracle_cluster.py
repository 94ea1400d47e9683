"""DuckDB SQL of the clustering family: Lloyd's rounds and start draws as recursive queries, silhouettes from all pairs.

It recomputes ``operators.cluster`` by brute force: every point meets every
centre of every (k, restart) model in each round, and every other point for
the silhouette.
"""

from __future__ import annotations

from ..operators import cluster as CL
from . import oracle as O

MODES = ("structural_only", "semantic_only", "combined")


def vectors(mode: str, raw: str, tfidf: str, feats: list[str], source: tuple[str, str]) -> str:
    """CTEs up to ``vec(id, f)``: the feature vectors of the designs and files of ``source`` (two CTE names)."""
    def of_kept(ctes: str) -> str:
        return ctes.replace("FROM files", f"FROM {source[1]}").replace("FROM designs", f"FROM {source[0]}")

    parts, struct, sem = [], "[]::DOUBLE[]", "[]::DOUBLE[]"
    if mode != "semantic_only":
        parts.append(of_kept(raw))
        table = "ms" if mode == "combined" else "rs"
        struct = "[" + ", ".join(f"{table}.{n}" for n in feats) + "]"
    if mode != "structural_only":
        parts.append(of_kept(tfidf))
        scale = "/ coalesce(nullif(max(abs(w.weight)) OVER (PARTITION BY v.dim), 0), 1)" if mode == "combined" else ""
        parts.append(f"""sem AS (SELECT design_idx, list(x ORDER BY dim) AS f FROM (
  SELECT d.design_idx, v.dim, coalesce(w.weight, 0) {scale} AS x
  FROM {source[0]} d CROSS JOIN vocab v LEFT JOIN wts w ON w.design_idx = d.design_idx AND w.dim = v.dim) GROUP BY design_idx)""")
        sem = "coalesce(sem.f, [])"
    joins = ("" if mode == "semantic_only" else f" JOIN {table} USING (design_idx)") + ("" if mode == "structural_only" else " LEFT JOIN sem USING (design_idx)")
    parts.append(f"vec AS MATERIALIZED (SELECT d.design_idx AS id, {struct} || {sem} AS f FROM {source[0]} d{joins})")
    return ",\n".join(parts)


def _key(step: str) -> str:
    return (f"-ln((('0x' || substr(md5(({CL.SEED} + r) || ':' || ({step} // {CL.HASH_STEPS}) || ':' || id), {step} % {CL.HASH_STEPS} + 1, 13))::BIGINT + 1)"
            " / 4503599627370496.0)")


def sweep(vec: str = "vec", n_init: int = CL.N_INIT) -> str:
    """CTEs from ``vec(id, f)`` to ``fits(k, r, cost, silhouette)`` and ``labels(k, id, cluster)`` of each k's best restart."""
    d2 = f"round(list_distance(c, f) ** 2, {CL.PLACES})"
    return f"""
km_n AS (SELECT count(*) AS n, greatest(3, count(*) // 100) AS lo, least(50, count(*) // 10) AS hi FROM {vec}),
km_k AS (SELECT unnest(range(lo, greatest(lo, hi) + 1)) AS k, hi >= lo AS swept FROM km_n),
km_r AS (SELECT unnest(range({n_init})) AS r),
km_start AS (
  SELECT r, 1 AS step, [arg_min(f, ({_key('0')}, id))] AS cs FROM km_r, {vec} GROUP BY r
  UNION ALL
  SELECT r, any_value(step) + 1, list_append(any_value(cs), arg_min(f, (CASE WHEN near > 0 THEN e / near ELSE 'Infinity'::DOUBLE END, id)))
  FROM (SELECT r, step, cs, id, f, {_key('step')} AS e, list_min(list_transform(cs, lambda c: {d2})) AS near
        FROM km_start, {vec} WHERE step < (SELECT max(k) FROM km_k)) GROUP BY r),
km AS (
  SELECT 0 AS it, k, r, j, cs[j + 1] AS c, true AS moved
  FROM km_start, (SELECT k, unnest(range(k)) AS j FROM km_k) WHERE step = (SELECT max(k) FROM km_k)
  UNION ALL
  SELECT o.it + 1, o.k, o.r, o.j, coalesce(n.c, o.c), n.c IS NOT NULL AND list_distance(n.c, o.c) > 1e-9
  FROM km o JOIN (SELECT k, r FROM km GROUP BY k, r HAVING bool_or(moved)) a ON a.k = o.k AND a.r = o.r
  LEFT JOIN (
    SELECT k, r, j, list(m ORDER BY d) AS c FROM (
      SELECT k, r, j, d, avg(x) AS m FROM (
        SELECT k, r, j, unnest(f) AS x, unnest(range(len(f))) AS d FROM (
          SELECT k, r, id, any_value(f) AS f, arg_min(j, ({d2}, j)) AS j
          FROM (SELECT * FROM km WHERE (k, r) IN (SELECT (k, r) FROM km GROUP BY k, r HAVING bool_or(moved))), {vec} GROUP BY k, r, id))
      GROUP BY k, r, j, d) GROUP BY k, r, j) n ON n.k = o.k AND n.r = o.r AND n.j = o.j
  WHERE o.it < {CL.MAX_ITER}),
km_end AS (SELECT k, r, j, c FROM km QUALIFY it = max(it) OVER (PARTITION BY k, r)),
km_near AS (SELECT k, r, id, arg_min(j, ({d2}, j)) AS cluster, arg_min(list_distance(c, f) ** 2, ({d2}, j)) AS d FROM km_end, {vec} GROUP BY k, r, id),
km_cost AS (SELECT k, r, sum(d) AS cost FROM km_near GROUP BY k, r),
km_best AS (SELECT k, arg_min(r, (round(cost, {CL.PLACES}), r)) AS r FROM km_cost GROUP BY k),
labels AS (SELECT k, id, cluster FROM km_near JOIN km_best USING (k, r)),
km_pair AS (SELECT a.id, b.id AS other, list_distance(a.f, b.f) ** 2 AS d FROM {vec} a JOIN {vec} b ON a.id <> b.id),
km_mean AS (SELECT p.id, x.k, x.cluster AS own, y.cluster AS theirs, avg(p.d) AS d
            FROM km_pair p JOIN labels x ON x.id = p.id JOIN labels y ON y.id = p.other AND y.k = x.k GROUP BY ALL),
km_ab AS (SELECT id, k, max(d) FILTER (WHERE own = theirs) AS a, min(d) FILTER (WHERE own <> theirs) AS b FROM km_mean GROUP BY id, k),
km_sil AS (SELECT k, avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) <= 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette
           FROM km_ab GROUP BY k),
fits AS (SELECT k, r, cost, silhouette, swept FROM km_best JOIN km_cost USING (k, r) JOIN km_sil USING (k) JOIN km_k USING (k)),
chosen AS (SELECT k, CASE WHEN swept THEN silhouette ELSE -1.0 END AS silhouette FROM fits ORDER BY round(silhouette, {CL.PLACES + 3}) DESC, k LIMIT 1)"""


def kept_code(exact_code: str) -> str:
    """CTEs up to ``kdesigns`` and ``kfiles``: the code designs that exact dedup keeps."""
    return exact_code + O.first_wins_ctes() + """,
kdesigns AS MATERIALIZED (SELECT * FROM designs WHERE design_idx IN (SELECT design_idx FROM kept)),
kfiles AS MATERIALIZED (SELECT * FROM files WHERE design_idx IN (SELECT design_idx FROM kept))"""


def pca(points: str, dims: int = 2, squarings: int = 26) -> str:
    """CTEs from ``points(id, f)`` to ``pcs(id, pc1, ..)``: dominant axes by repeated squaring of the covariance, deflated in turn."""
    out = f"""
cell AS (SELECT id, unnest(f) AS x, unnest(range(len(f))) AS d FROM {points}),
mean AS (SELECT d, avg(x) AS m FROM cell GROUP BY d),
dev AS (SELECT id, d, x - m AS x FROM cell JOIN mean USING (d)),
a1 AS MATERIALIZED (SELECT p.d AS i, q.d AS j, sum(p.x * q.x) / (SELECT count(*) FROM {points}) AS v FROM dev p JOIN dev q USING (id) GROUP BY 1, 2)"""
    for k in range(1, dims + 1):
        out += f""",
p{k} AS (
  SELECT 0 AS step, i, j, v / max(abs(v)) OVER () AS v FROM a{k}
  UNION ALL
  SELECT step + 1, i, j, v / max(abs(v)) OVER () FROM (
    SELECT a.step, a.i, b.j, sum(a.v * b.v) AS v FROM p{k} a JOIN p{k} b ON a.j = b.i WHERE a.step < {squarings} GROUP BY 1, 2, 3)),
col{k} AS (SELECT i, v FROM p{k} WHERE step = {squarings} AND j = (SELECT arg_max(i, v) FROM p{k} WHERE step = {squarings} AND i = j)),
axis{k} AS MATERIALIZED (SELECT i, v / sqrt((SELECT sum(v * v) FROM col{k})) * (SELECT sign(arg_max(v, (round(abs(v), 9), -i))) FROM col{k}) AS v FROM col{k}),
a{k + 1} AS MATERIALIZED (SELECT a.i, a.j, a.v - x.v * y.v * (SELECT sum(m.v * p.v * q.v) FROM a{k} m JOIN axis{k} p ON p.i = m.i JOIN axis{k} q ON q.i = m.j) AS v
       FROM a{k} a JOIN axis{k} x ON x.i = a.i JOIN axis{k} y ON y.i = a.j)"""
    cols = ", ".join(f"sum(x * axis{k}.v) AS pc{k}" for k in range(1, dims + 1))
    joins = " ".join(f"JOIN axis{k} ON axis{k}.i = dev.d" for k in range(1, dims + 1))
    return out + f",\npcs AS (SELECT id, {cols} FROM dev {joins} GROUP BY id)"
