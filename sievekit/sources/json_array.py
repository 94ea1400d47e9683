"""JSON arrays read in pieces: a file of one array is split over tasks like any text file.

A text is cut at closing braces by Spark's own splittable line reader, so each
task gets a stretch of the file in order. Whether a bracket or comma counts
depends on what came before, so the read has two passes:

1. each stretch is summed up for each state that it may begin in (outside a
   string, in one, in one after a backslash): the state that it ends in and
   the change of the bracket depth. A running combination of the summaries, one
   small row a stretch, tells how every stretch begins;
2. each stretch finds the commas between elements and cuts. Elements that go
   over a stretch's end (one a stretch) are put together by their number.

Strings, escapes and depths are found with numpy over whole stretches of text.
Elements come with their number in the file and their byte offset, whatever is
in them; an element that is no JSON is the reader's to reject. One whose brackets
or quotes do not close takes the rest of its file with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dedup import _checkpoint
from ..session import ship

CUT = "}"
OUTSIDE, STRING, ESCAPED = 0, 1, 2
#: Bytes of a stretch that are looked at together; and stretches whose beginnings are sent to the tasks.
CHUNK, MAX_STRETCHES = 1 << 22, 1_000_000


def strings(raw: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """(which characters are outside strings, the quotes themselves not; the state after them) from a beginning state."""
    n = len(raw)
    slash = raw == 92
    place = np.arange(n)
    last_other = np.maximum.accumulate(np.where(slash, -1, place))  # of each character: the last one that is no backslash
    run = place - last_other  # backslashes that end here
    if state == ESCAPED:
        run = run + (last_other < 0)
    odd_before = np.concatenate([[state == ESCAPED], run[:-1] % 2 == 1])
    quote = (raw == 34) & ~odd_before
    inside = (np.cumsum(quote) + (state != OUTSIDE)) % 2 == 1
    if not n:
        return np.zeros(0, bool), state
    end = OUTSIDE if not inside[-1] else ESCAPED if run[-1] % 2 == 1 else STRING
    return ~inside & ~quote, end


def depth_change(raw: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """+1, -1 or 0 of each character."""
    return np.where(outside, ((raw == 91) | (raw == 123)).astype(np.int8) - ((raw == 93) | (raw == 125)).astype(np.int8), 0)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """((path, start), bytes): the text of each stretch in chunks of whole cuts, in order."""
    key, parts, size = None, [], 0
    for b in batches:
        values = b.column(0).cast(pa.large_binary()).to_pylist()
        for path, start, value in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), values, strict=True):
            if (path, start) != key or size >= CHUNK:
                if parts:
                    yield key, b"".join(parts)
                key, parts, size = (path, start), [], 0
            parts += (value, CUT.encode())
            size += len(value) + 1
    if parts:
        yield key, b"".join(parts)


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, bytes, and for each beginning state: end state, depth change) of each stretch."""
    found: dict[tuple, list] = {}
    for key, text in _stretches(batches):
        raw = np.frombuffer(text, np.uint8)
        held = found.setdefault(key, [0, [OUTSIDE, STRING, ESCAPED], [0, 0, 0]])
        held[0] += len(raw)
        for s in range(3):
            outside, end = strings(raw, held[1][s])
            held[2][s] += int(depth_change(raw, outside).sum(dtype=np.int64))
            held[1][s] = end
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()), pa.array([v[0] for v in found.values()], pa.int64()),
         pa.array([v[1] for v in found.values()], pa.list_(pa.int32())), pa.array([v[2] for v in found.values()], pa.list_(pa.int64()))],
        names=["path", "start", "bytes", "ends", "depths"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (path, start): the state, depth and offset that each stretch begins with, and the file's end (start -1)."""
    path, state, depth, offset = None, OUTSIDE, 0, 0

    def table(rows):
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["path", "start", "state", "depth", "offset"])

    for b in batches:
        rows = []
        for p, start, size, ends, depths in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if p != path:
                if path is not None:
                    rows.append((path, -1, state, depth, offset))
                path, state, depth, offset = p, OUTSIDE, 0, 0
            rows.append((p, start, state, depth, offset))
            offset, depth, state = offset + size, depth + depths[state], ends[state]
        yield table(rows)
    if path is not None:
        yield table([(path, -1, state, depth, offset)])


def _cut(beginnings):
    """(path, start, seq, whole, offset, text): the parts of each stretch between the commas of the array.

    ``seq`` counts the elements that begin in the stretch; 0 is the rest of one that began before it. ``whole`` tells
    that an element begins and ends here. A last row (text null) tells how many begin in the stretch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = beginnings.value
        key, seq, open_, held, at = None, 0, False, [], 0

        def rows_of(found):
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in enumerate(kinds)],
                                              names=["path", "start", "seq", "whole", "offset", "text"])

        def part(ended: bool):
            text = b"".join(held)
            return (*key, seq, ended and seq > 0, at, text.decode("utf-8", "replace"))

        for now, text in _stretches(batches):
            found = []
            if now != key:
                if key is not None:
                    if open_:
                        found.append(part(False))
                    found.append((*key, seq, None, None, None))
                key, seq, held = now, 0, []
                state, depth, offset = known[key]
                open_, at = depth > 0, offset
            raw = np.frombuffer(text, np.uint8)
            outside, state = strings(raw, state)
            change = depth_change(raw, outside)
            after = depth + np.cumsum(change, dtype=np.int64)
            before = after - change
            bound = outside & (((raw == 44) & (after == 1)) | ((raw == 91) & (before == 0)) | ((raw == 93) & (after == 0) & (before == 1)))
            last = 0
            for p in np.flatnonzero(bound).tolist():
                if open_:
                    held.append(text[last:p])
                    found.append(part(True))
                open_, held, last, at = raw[p] != 93, [], p + 1, offset + p + 1
                seq += int(open_)
            if open_:
                held.append(text[last:])
            offset += len(raw)
            depth = int(after[-1]) if len(after) else depth
            if found:
                yield rows_of(found)
        if key is not None:
            yield rows_of([*([part(False)] if open_ else []), (*key, seq, None, None, None)])
    return run


def read_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(elements, files) of the arrays at a path, as written tables.

    elements(path, element, offset, text): blank texts are no elements. files(path, is_array, ends): whether an array
    begins in the file and whether it ends there; if not, its last element is cut off.
    """
    ship(spark)
    pieces = spark.read.option("lineSep", CUT).text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    sums = _checkpoint(pieces.mapInArrow(_sum_up, "path string, start long, bytes long, ends array<int>, depths array<long>"))
    if sums.count() > MAX_STRETCHES:
        raise ValueError("too many stretches to tell the tasks: raise spark.sql.files.maxPartitionBytes")
    begins = _checkpoint(sums.repartition("path").sortWithinPartitions("path", "start")
                         .mapInArrow(_combine, "path string, start long, state int, depth long, offset long"))
    shared = spark.sparkContext.broadcast({(r.path, r.start): (r.state, r.depth, r.offset) for r in begins.where("start >= 0").collect()})
    parts = _checkpoint(pieces.mapInArrow(_cut(shared), "path string, start long, seq long, whole boolean, offset long, text string"))
    begun = parts.where("text is null").select("path", "start", F.col("seq").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    bases = begun.select("path", "start", F.coalesce(before, F.lit(0)).alias("base"))
    numbered = parts.where("text is not null").join(bases, ["path", "start"]).withColumn("element", F.col("base") + F.col("seq") - 1)
    whole = numbered.where("whole").select("path", "element", "offset", "text")
    over = (numbered.where("not whole").groupBy("path", "element")
            .agg(F.min(F.struct("start", "offset")).alias("b"), F.sort_array(F.collect_list(F.struct("start", "seq", "text"))).alias("t"))
            .select("path", "element", F.col("b.offset").alias("offset"), F.array_join("t.text", "").alias("text")))
    elements = _checkpoint(whole.unionByName(over).where(F.trim(F.translate("text", "\r\n\t", "   ")) != ""))
    # every cut got its brace back, the file's last one too: an array that ends leaves the depth one below nothing
    ends = begins.where("start < 0").select("path", ((F.col("state") == OUTSIDE) & (F.col("depth") == -1)).alias("ends"))
    files = begun.groupBy("path").agg((F.sum("n") > 0).alias("is_array")).join(ends, "path")
    return elements, _checkpoint(files.select("path", "is_array", "ends"))
