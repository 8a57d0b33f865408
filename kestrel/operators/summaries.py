"""One-pass column summaries of raw captures: token-class counts, extremes and heavy hitters.

Bytes that are not UTF-8 count as U+FFFD. Each task splits its lines batch by batch (Arrow, no row per cell) and keeps, per file and column,
fixed-width counters, the least and greatest cell, and a Misra-Gries summary of at most COUNTERS
cells. What leaves a task is one small row a file and column and at most COUNTERS heavy cells.

``dominant_cells`` finds exact modes from them: a cell outside the candidates occurs at most
``lowered`` times, so where the best candidate's count exceeds that, an exact recount of the
candidates decides. Columns where it doesn't (nearly unique ones) are counted value by value.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions import FIXED_MISSING_TOKENS, FIXED_NEG_INF_TOKENS, FIXED_POS_INF_TOKENS
from kestrel.functions.scalars import WHITESPACE
from kestrel.session import materialize

COUNTERS = 256
#: Files and columns a task holds at once; candidates that a recount carries to the tasks.
HELD = 20_000
MOST_CANDIDATES = 100_000
CLASSES = ("missing", "pos_inf", "neg_inf", "integer", "float", "string")
OVERALL = "*"


def cells_of(lines: pa.Array, n: int) -> list[pa.Array]:
    """The first ``n`` cells of each line; short lines and null lines have empty ones."""
    lines = lines.fill_null("")
    split = pc.split_pattern(lines, ",")
    size, begin, flat = split.value_lengths().to_numpy(), split.offsets.to_numpy()[:-1], split.values
    out = []
    for i in range(n):
        at = pa.array(begin + i, mask=size <= i)
        out.append(flat.take(at).fill_null(""))
    return out


def class_masks(values: pa.Array) -> list[np.ndarray]:
    """Which of the cells are of each of CLASSES."""
    t = pc.ascii_trim(values, characters=WHITESPACE)
    low = pc.ascii_lower(t)
    among = lambda tokens: pc.is_in(low, pa.array(tokens, low.type)).to_numpy(zero_copy_only=False)
    missing, pos, neg = among(FIXED_MISSING_TOKENS), among(FIXED_POS_INF_TOKENS), among(FIXED_NEG_INF_TOKENS)
    found = lambda p: pc.match_substring_regex(t, p).to_numpy(zero_copy_only=False)
    rest = ~(missing | pos | neg)
    numeric = rest & found("^[+-]?([0-9.]|[eE][+-]?)*$") & found("[0-9]")
    mark = found("[.eE]")
    return [missing, pos, neg, numeric & ~mark, numeric & mark, rest & ~numeric]


class ColumnState:
    def __init__(self):
        self.counts, self.rows, self.least, self.most = np.zeros(len(CLASSES), np.int64), 0, None, None
        self.heavy: dict[str, int] = {}
        self.lowered = 0

    def add(self, cells: pa.Array) -> None:
        counted = pc.value_counts(cells)
        values, n = counted.field("values"), counted.field("counts").to_numpy()
        self.rows += len(cells)
        self.counts += [int(n[m].sum()) for m in class_masks(values)]
        ends = pc.min_max(values).as_py()  # by bytes, as code points are ordered
        self.least = ends["min"] if self.least is None else min(self.least, ends["min"])
        self.most = ends["max"] if self.most is None else max(self.most, ends["max"])
        if len(n) > COUNTERS:  # the batch's own summary first
            cut = int(np.partition(n, len(n) - COUNTERS - 1)[len(n) - COUNTERS - 1])
            keep = np.flatnonzero(n > cut)
            values, n = values.take(pa.array(keep)), n[keep] - cut
            self.lowered += cut
        for v, k in zip(values.to_pylist(), n.tolist()):
            self.heavy[v] = self.heavy.get(v, 0) + k
        if len(self.heavy) > COUNTERS:
            cut = sorted(self.heavy.values(), reverse=True)[COUNTERS]
            self.heavy = {v: k - cut for v, k in self.heavy.items() if k > cut}
            self.lowered += cut


def by_file(batches, n: int):
    """(file, cells per column) of each file in each batch."""
    for batch in batches:
        files = batch.column(0).dictionary_encode()
        cells = cells_of(batch.column(1), n)
        which = files.indices.to_numpy(zero_copy_only=False)
        for k, name in enumerate(files.dictionary.to_pylist()):
            at = pa.array(np.flatnonzero(which == k))
            yield name, [c.take(at) for c in cells]


_SUMMARY = ("source_file string, col_index int, rows long, " + ", ".join(f"{c} long" for c in CLASSES)
            + ", vmin string, vmax string, lowered long, heavy array<struct<cell:string,n:long>>")


def lines_of(raw: DataFrame) -> DataFrame:
    return raw.select("source_file", F.make_valid_utf8(F.col("line").cast("string")).alias("line"))


def column_summaries(raw: DataFrame, columns: int) -> DataFrame:
    """One row per task, file and column; written down, it is read several times."""
    def task(batches):
        held: dict[tuple, ColumnState] = {}

        def rows():
            out = [(f, i, s.rows, *s.counts.tolist(), s.least, s.most, s.lowered, [{"cell": v, "n": k} for v, k in s.heavy.items()])
                   for (f, i), s in held.items()]
            kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.int64()] * len(CLASSES), pa.string(), pa.string(), pa.int64(),
                     pa.list_(pa.struct([("cell", pa.string()), ("n", pa.int64())]))]
            names = ["source_file", "col_index", "rows", *CLASSES, "vmin", "vmax", "lowered", "heavy"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        for name, cells in by_file(batches, columns):
            for i, c in enumerate(cells):
                held.setdefault((name, i), ColumnState()).add(c)
            if len(held) > HELD:
                yield rows()
                held.clear()
        if held:
            yield rows()

    return materialize(lines_of(raw).mapInArrow(task, _SUMMARY))


def profile_of(summaries: DataFrame) -> DataFrame:
    """(source_file, col_index, rows, class counts, constant, constant_value) per file and overall.
    Extremes are grouping keys: a column is constant where one pair is left and its sides are equal."""
    sums = ["rows", *CLASSES]
    per_file = summaries.groupBy("source_file", "col_index", "vmin", "vmax").agg(*[F.sum(c).alias(c) for c in sums])
    overall = per_file.groupBy("col_index", "vmin", "vmax").agg(*[F.sum(c).alias(c) for c in sums])
    both = materialize(per_file.unionByName(overall.withColumn("source_file", F.lit(OVERALL))))
    whole = both.groupBy("source_file", "col_index").agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("pairs"))
    one = both.where("vmin = vmax").select("source_file", "col_index", F.col("vmin").alias("constant_value"))
    out = (whole.where("pairs = 1").join(one, ["source_file", "col_index"], "left")
           .unionByName(whole.where("pairs > 1").withColumn("constant_value", F.lit(None).cast("string"))))
    return out.select("source_file", "col_index", *sums, F.col("constant_value").isNotNull().alias("constant"), "constant_value")


def _recounted(raw: DataFrame, columns: int, candidates: dict[int, list[str]]) -> DataFrame:
    """(source_file, col_index, cell, n): exact counts of the candidates."""
    shared = raw.sparkSession.sparkContext.broadcast(candidates)  # at most MOST_CANDIDATES cells

    def task(batches):
        wanted = {i: pa.array(v, pa.string()) for i, v in shared.value.items()}
        for name, cells in by_file(batches, columns):
            for i, values in wanted.items():
                counted = pc.value_counts(cells[i].filter(pc.is_in(cells[i], values)))
                k = len(counted)
                yield pa.RecordBatch.from_arrays([pa.array([name] * k, pa.string()), pa.array([i] * k, pa.int32()), counted.field("values"),
                                                  counted.field("counts")], ["source_file", "col_index", "cell", "n"])

    found = lines_of(raw).mapInArrow(
        task, "source_file string, col_index int, cell string, n long")
    return found.groupBy("source_file", "col_index", "cell").agg(F.sum("n").alias("n"))


def _top(counts: DataFrame) -> DataFrame:
    """The most frequent cell of each file and column, ties by the least cell. Counts and the cells'
    first bytes are compared as numbers; only what ties in both is compared as text."""
    keys = ["source_file", "col_index"]
    head = F.conv(F.rpad(F.hex(F.substring(F.col("cell").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    most = counts.groupBy(*keys).agg(F.max("n").alias("_n"))
    tied = counts.join(most, keys).where("n = _n").drop("_n").withColumn("_head", F.coalesce(head, F.lit(0)))
    least = tied.groupBy(*keys).agg(F.min("_head").alias("_least"))
    last = tied.join(least, keys).where("_head = _least")
    rank = F.expr(f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY cell)")
    return last.withColumn("_r", rank).where("_r = 1").select(*keys, "cell", "n")


def dominant_cells(raw: DataFrame, summaries: DataFrame, columns: int) -> DataFrame:
    """(source_file, col_index, cell, n): the exact mode per file and overall."""
    def with_overall(df: DataFrame, key: list[str], sums: list[str]) -> DataFrame:
        per = df.groupBy("source_file", *key).agg(*[F.sum(c).alias(c) for c in sums])
        return per.unionByName(per.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums]).withColumn("source_file", F.lit(OVERALL)))

    error = with_overall(summaries, ["col_index"], ["lowered"])
    est = with_overall(summaries.select("source_file", "col_index", F.inline("heavy")), ["col_index", "cell"], ["n"])
    best = est.groupBy("source_file", "col_index").agg(F.max("n").alias("best"))
    bound = materialize(error.join(best, ["source_file", "col_index"], "left"))
    unsure = {r["col_index"] for r in bound.where("best is null or lowered >= best").select("col_index").distinct().collect()}
    near = (est.where(~F.col("col_index").isin(list(unsure))).join(bound, ["source_file", "col_index"])
            .where("n >= best - lowered").select("col_index", "cell").distinct())
    found = near.limit(MOST_CANDIDATES + 1).collect()
    if len(found) > MOST_CANDIDATES:
        unsure, found = set(range(columns)), []
    wanted: dict[int, list[str]] = {}
    for r in found:
        wanted.setdefault(r["col_index"], []).append(r["cell"])
    parts = [_recounted(raw, columns, wanted)] if wanted else []
    if unsure:
        cells = F.split(F.coalesce(F.col("line"), F.lit("")), ",", -1)
        tall = lines_of(raw).select("source_file", F.explode(F.array(*[
            F.struct(F.lit(i).alias("col_index"), F.coalesce(F.get(cells, i), F.lit("")).alias("cell")) for i in sorted(unsure)])).alias("c"))
        parts.append(tall.groupBy("source_file", "c.col_index", "c.cell").agg(F.count(F.lit(1)).alias("n")))
    if not parts:  # no lines
        return est.select("source_file", "col_index", "cell", "n")
    counts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    counts = materialize(counts)
    overall = counts.groupBy("col_index", "cell").agg(F.sum("n").alias("n")).withColumn("source_file", F.lit(OVERALL))
    return _top(counts.unionByName(overall))
