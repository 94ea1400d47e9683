"""Operator 1: URL filters as a sort-merge range join of reversed-host keys with nested rules.

A host becomes its labels in reverse (``a.example.org`` -> ``org, example, a``),
so that a rule's host and all its subdomains are one interval of the sorted
keys, and intervals of rules are nested or disjoint. Keys are dealt into
ranges; a rule is copied to each range that its interval meets; every range is
swept once in key order with a stack of the rules that are active.

Defined cases: a null url, or one without ``://``, has an empty host and path
and no rule; rules with a null host are ignored, a null path is empty; two
rules of equal host and path count as ``block`` if either is; of equally long
fitting rules the one with the longer host wins. Rows are returned as often as
they come; an empty table gives an empty result; only the id and url columns
are read, so further columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sampled keys per range; ranges decide only how evenly the work is dealt.
SAMPLED_PER_RANGE = 40
#: The rules of the registered query: host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def url_parts(url):
    """Columns (host, path) of a url column."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _sweep(default: str, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack, last = None, [], None  # stack: (labels, {path: (rule, verdict)}, lengths of its paths)
        for batch in batches:
            rows = batch.to_pydict()
            ids, hosts, paths, rules, verdicts = [], [], [], [], []
            for pid, kind, labels, path, ident, host, verdict in zip(
                    rows["pid"], rows["kind"], rows["labels"], rows["path"], rows["ident"], rows["host"],
                    rows["verdict"], strict=True):
                if pid != part:
                    part, stack, last = pid, [], None
                if labels != last:
                    while stack and labels[:len(stack[-1][0])] != stack[-1][0]:
                        stack.pop()
                    last = labels
                if kind == 0:
                    if not stack or stack[-1][0] != labels:
                        stack.append((labels, {}, []))
                    top = stack[-1]
                    top[1][path] = (host + path, len(host), verdict)
                    if len(path) not in top[2]:
                        top[2].append(len(path))
                        top[2].sort(reverse=True)
                    continue
                best = None
                for _, by_path, lengths in stack:
                    for n in lengths:
                        hit = by_path.get(path[:n]) if n <= len(path) else None
                        if hit:
                            if best is None or (len(hit[0]), hit[1]) > (len(best[0]), best[1]):
                                best = hit
                            break
                ids.append(ident)
                hosts.append(host)
                paths.append(path)
                rules.append(best[0] if best else None)
                verdicts.append(best[2] if best else default)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, f.type) for x, f in zip((ids, hosts, paths, rules, verdicts), out, strict=True)],
                    schema=out)
    return run


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """Verdict of every url: (id_col, host, path, rule, verdict).

    ``rules`` has columns host, path, verdict (allow or block). The longest
    fitting rule decides, else ``default``.
    """
    spark = pages.sparkSession
    n = partitions(spark)
    host, path = url_parts(F.col("url"))
    urls = (pages.select(F.col(id_col).alias("ident"), F.col(url_col).alias("url"))
            .select("ident", host.alias("host"), path.alias("path"))
            .withColumn("labels", F.reverse(F.split("host", r"\.", -1)))
            .withColumn("salt", F.xxhash64("ident")))
    rules = (rules.where(F.col("host").isNotNull())
             .select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
             .withColumn("labels", F.reverse(F.split("host", r"\.", -1))))
    # range bounds from a random sample whose size depends on the number of ranges alone
    sample = sorted((tuple(r.labels), r.path, r.salt) for r in
                    urls.select("labels", "path", "salt").orderBy(F.rand(1)).limit(n * SAMPLED_PER_RANGE).collect())
    bounds = sample[SAMPLED_PER_RANGE::SAMPLED_PER_RANGE][:n - 1]

    @F.pandas_udf("int")
    def range_of(labels, path, salt):
        return labels.__class__([bisect_right(bounds, (tuple(a), b, c)) for a, b, c in zip(labels, path, salt)])

    @F.pandas_udf("array<int>")
    def ranges_of(labels):
        found = []
        for x in labels:
            a = tuple(x)
            first = bisect_left(bounds, (a, "", -(1 << 63)))
            last = bisect_right(bounds, a, key=lambda b, k=len(a): b[0][:k])
            found.append(list(range(first, last + 1)))
        return labels.__class__(found)

    id_type = pages.schema[id_col].dataType
    ident = F.lit(None).cast(id_type)
    events = urls.select(range_of("labels", "path", "salt").alias("pid"), F.lit(1).alias("kind"), "labels", "path",
                         "ident", "host", F.lit(None).cast("string").alias("verdict")).unionByName(
        rules.select(F.explode(ranges_of("labels")).alias("pid"), F.lit(0).alias("kind"), "labels", "path",
                     ident.alias("ident"), "host", "verdict"))
    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(x, T.StringType())
                                                            for x in ("host", "path", "rule", "verdict"))])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    return (events.repartition(n, "pid").sortWithinPartitions("pid", "labels", "kind", "path")
            .mapInArrow(_sweep(default, arrow), schema))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(read_table(spark, sf_dir, "pages", "page_id", "url"), rules)


_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'"
    for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
OP1_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, host, path,
       CASE {_FITS.format(*(h + p for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))))} END AS rule,
       CASE {_FITS.format(*(v for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))))} ELSE 'allow' END AS verdict
FROM p
"""
