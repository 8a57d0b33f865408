"""Reproducible sampling without a row order.

Every row gets a seeded 60-bit hash of its key (first 15 hex digits of SHA-256 of
``seed:key``), identical in Spark, Python and SQL engines. A sample of ``q`` rows is
the ``q`` smallest hashes (ties by key). Finding them never sorts a whole class in
one task: rows below a per-group threshold (expected ~1.1 q + 64 rows) are kept as
candidates and ranked with bucketed running totals; a group whose candidates fall
short is retried with the full group. Sizes are exact; members differ from a
NumPy RNG (quirk Q9).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.ranking import running_totals

HASH_SPACE = float(1 << 60)


HASH_BITS = 60  # 15 hexadecimal digits


def seeded_hash(key: Column, seed: int) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 15), 16, 10).cast("bigint")


def ranked_sample(df: DataFrame, key: str, seed: int, quotas: DataFrame, by: Sequence[str] = (),
                  slack: float = 1.1, pad: int = 64, max_groups: int = 100_000) -> DataFrame:
    """Rows with the ``quota`` smallest seeded hashes per ``by`` group (``quotas``: by..., quota).

    Per-group sizes, quotas and candidate counts are one small row per group and are
    decided on the driver (checked against ``max_groups`` before the threshold table is
    broadcast); the data itself is scanned with a broadcast filter and ranked with
    bucketed running totals over the bounded candidate set.
    """
    by = list(by)
    h = df.withColumn("_h", seeded_hash(F.col(key), seed))
    if by:
        sizes = h.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).join(quotas, by).limit(max_groups + 1).collect()
    else:
        n_all = h.count()
        sizes = [{"_n": n_all, "quota": quotas.first()["quota"]}]
    if len(sizes) > max_groups:
        raise ValueError(f"more than {max_groups} sample groups")

    def gkey(r):
        return tuple(r[c] for c in by)

    def thresholds(wide: set) -> dict:
        out = {}
        for r in sizes:
            q, n = int(r["quota"]), int(r["_n"])
            out[gkey(r)] = (q, HASH_SPACE if (q >= n or gkey(r) in wide) else min(HASH_SPACE, (q * slack + pad) / n * HASH_SPACE))
        return out

    def apply(th: dict) -> DataFrame:
        """Attach quota and threshold: literals for a few groups, else a broadcast equi-join."""
        if len(th) <= 64:
            qc, tc = F.lit(None).cast("long"), F.lit(None).cast("double")
            for g, (q, t) in th.items():
                cond = F.lit(True)
                for c, v in zip(by, g):
                    cond = cond & (F.col(c) == F.lit(v))
                qc, tc = F.when(cond, F.lit(q)).otherwise(qc), F.when(cond, F.lit(t)).otherwise(tc)
            tagged = h.withColumn("quota", qc).withColumn("_t", tc)
        else:
            schema = h.select(*by).schema.add("quota", "long").add("_t", "double")
            table = spark.createDataFrame([(*g, q, t) for g, (q, t) in th.items()], schema)
            tagged = h.join(F.broadcast(table), by)  # one row per group, count checked above
        return tagged.filter(F.col("_h") < F.col("_t"))

    spark = df.sparkSession
    # candidates are bounded (~slack * quota + pad per group): checkpoint them so the input is
    # scanned twice in total (sizes, candidates) and ranking reads the small written set
    from kestrel.session import materialize

    cand = materialize(apply(thresholds(set())))
    if by:
        got = {gkey(r): r["_c"] for r in cand.groupBy(*by).agg(F.count(F.lit(1)).alias("_c")).collect()}
    else:
        got = {(): cand.count()}
    short = {gkey(r) for r in sizes if got.get(gkey(r), 0) < min(int(r["quota"]), int(r["_n"]))}
    if short:  # rare: those groups take all their rows as candidates
        cand = materialize(apply(thresholds(short)))
    per_h = cand.groupBy(*by, "_h").agg(F.count(F.lit(1)).alias("_w"), F.first("quota").alias("quota"))
    ranked = running_totals(per_h, by, "_h", ["_w"])
    keep = ranked.filter(F.col("cum__w") - F.col("_w") < F.col("quota")).select(*by, "_h", "quota",
                                                                               (F.col("cum__w") - F.col("_w")).alias("_before"))
    picked = cand.drop("quota", "_t").join(keep, [*by, "_h"], "inner")
    # hash ties (only exact 60-bit collisions) resolved by key inside the tied set
    w = Window.partitionBy(*by, "_h").orderBy(F.col(key))
    picked = picked.withColumn("_r", F.row_number().over(w)).filter(F.col("_before") + F.col("_r") <= F.col("quota"))
    return picked.drop("_h", "quota", "_before", "_r", "_g")


def stratified_allocation(counts: DataFrame, n: int, target: str = "target", count_col: str = "count",
                          by: Sequence[str] = ()) -> DataFrame:
    """Class quotas for a two-class sample of ``n``: proportional floor, at least 1, then add to the
    class with the most room (ties to class 0) or trim the largest (ties to class 0) until the sum
    is ``n``. ``n`` >= rows keeps everything. Closed form of the reference's bounded loops."""
    by = list(by)
    wide = counts.groupBy(*by).agg(
        F.sum(F.when(F.col(target) == 0, F.col(count_col))).cast("bigint").alias("c0"),
        F.sum(F.when(F.col(target) == 1, F.col(count_col))).cast("bigint").alias("c1"))
    c0, c1 = F.coalesce("c0", F.lit(0)), F.coalesce("c1", F.lit(0))
    total = c0 + c1
    a0 = F.greatest(F.lit(1), F.least(c0, F.floor(F.lit(n) * (c0 / total)).cast("bigint")))
    a1 = F.greatest(F.lit(1), F.least(c1, F.floor(F.lit(n) * (c1 / total)).cast("bigint")))
    s = wide.select(*by, c0.alias("c0"), c1.alias("c1"), a0.alias("a0"), a1.alias("a1"))
    r0, r1 = F.col("c0") - F.col("a0"), F.col("c1") - F.col("a1")
    d = F.greatest(F.lit(n) - F.col("a0") - F.col("a1"), F.lit(0))
    gap = F.abs(r0 - r1)
    first_to_0 = r0 >= r1
    add_big = F.least(d, gap)
    rest = d - add_big
    add0 = F.when(first_to_0, add_big).otherwise(0) + F.ceil(rest / 2)
    add1 = F.when(first_to_0, 0).otherwise(add_big) + F.floor(rest / 2)
    s = s.select("*", (F.col("a0") + add0).cast("bigint").alias("b0"), (F.col("a1") + add1).cast("bigint").alias("b1"))
    # trimming: only when the floors of 1 pushed the sum over n
    over = F.greatest(F.col("b0") + F.col("b1") - F.lit(n), F.lit(0))
    big0 = F.col("b0") >= F.col("b1")
    g = F.abs(F.col("b0") - F.col("b1"))
    cut_big = F.least(over, g)
    rest2 = over - cut_big
    t0 = F.when(big0, cut_big).otherwise(0) + F.ceil(rest2 / 2)
    t1 = F.when(big0, 0).otherwise(cut_big) + F.floor(rest2 / 2)
    q0 = F.greatest(F.lit(1), F.col("b0") - t0)
    q1 = F.greatest(F.lit(1), F.col("b1") - t1)
    keep_all = F.lit(n) >= F.col("c0") + F.col("c1")
    out = s.select(*by, "c0", "c1", F.when(keep_all, F.col("c0")).otherwise(q0).cast("bigint").alias("quota_0"),
                   F.when(keep_all, F.col("c1")).otherwise(q1).cast("bigint").alias("quota_1"))
    return out


def quotas_long(alloc: DataFrame, target: str = "target", by: Sequence[str] = ()) -> DataFrame:
    return alloc.select(*by, F.inline(F.array(
        F.struct(F.lit(0).alias(target), F.col("quota_0").alias("quota")),
        F.struct(F.lit(1).alias(target), F.col("quota_1").alias("quota")))))


def stratified_sample(df: DataFrame, n: int, seed: int, key: str, target: str = "target",
                      by: Sequence[str] = ()) -> DataFrame:
    """Exact per-class quotas (``stratified_allocation``), members by smallest seeded hash."""
    counts = df.groupBy(*by, target).agg(F.count(F.lit(1)).alias("count"))
    q = quotas_long(stratified_allocation(counts, n, target, "count", by), target, by)
    return ranked_sample(df, key, seed, q, [*by, target])


def promotion_allocation(counts: DataFrame, n: int, min_positive_rows: int, max_positive_fraction: float,
                         target: str = "target") -> DataFrame:
    """positives = min(available, cap, max(min_pos, round_half_even(rows * rate))), at most rows - 1."""
    wide = counts.agg(F.sum(F.when(F.col(target) == 0, F.col("count"))).cast("bigint").alias("c0"),
                      F.sum(F.when(F.col(target) == 1, F.col("count"))).cast("bigint").alias("c1"))
    total = F.col("c0") + F.col("c1")
    rows = F.least(F.lit(n), total)
    natural = F.bround(rows * (F.col("c1") / total), 0).cast("bigint")
    cap = F.greatest(F.lit(1), F.floor(rows * max_positive_fraction).cast("bigint"))
    pos = F.least(F.col("c1"), cap, F.greatest(F.lit(min_positive_rows), natural))
    pos = F.least(pos, rows - 1)
    return wide.select("c0", "c1", rows.alias("rows"), pos.alias("quota_1"), (rows - pos).alias("quota_0"))


def promotion_slice(df: DataFrame, n: int, seed: int, key: str, min_positive_rows: int = 50,
                    max_positive_fraction: float = 0.05, target: str = "target") -> DataFrame:
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("count"))
    q = quotas_long(promotion_allocation(counts, n, min_positive_rows, max_positive_fraction, target), target)
    return ranked_sample(df, key, seed, q, [target])


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Seeded n of N (all rows when N <= n)."""
    spark = df.sparkSession
    quotas = spark.createDataFrame([(int(n),)], "quota long")
    return ranked_sample(df, key, seed, quotas)


def hash_ranks(df: DataFrame, seed: int, key: str, name: str) -> DataFrame:
    """0-based rank of each row by (seeded hash of the key, key): the same rows get the same ranks however
    they are partitioned. Rows are bucketed by the leading bits of the hash; a small table of bucket
    sizes gives each bucket its offset. Rows equal in the key take ranks in any order."""
    bits = 10
    hashed = df.withColumn("_h", seeded_hash(F.col(key), seed))
    rows = hashed.withColumn("_b", F.shiftright("_h", HASH_BITS - bits))
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # at most 2**bits rows
    off = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
                                        F.lit(0)).alias("_off"))
    w = Window.partitionBy("_b").orderBy("_h", key)
    ranked = rows.withColumn(name, F.row_number().over(w) - 1)
    return ranked.join(F.broadcast(off), "_b").select(*df.columns, (F.col(name) + F.col("_off")).alias(name))


def request_sample(df: DataFrame, n: int, seed: int, key: str, target: str = "target",
                   attack_fraction: float | None = None) -> DataFrame:
    """``n`` request rows; with replacement only when a class has fewer rows than asked.

    Without replacement: smallest seeded hashes (``draw`` null). With replacement: draw ``i`` in [0, n)
    takes the row of rank ``hash(seed, i) mod N`` by ``hash_ranks``, so a repeated evaluation or another
    partitioning draws the same rows.
    """
    spark = df.sparkSession
    if attack_fraction is None:
        parts = [(None, n)]
    else:
        k = int(round(n * attack_fraction))
        parts = [(0, n - k), (1, k)]
    out = None
    for label, count in parts:
        if count == 0:
            continue
        src = df if label is None else df.filter(F.col(target) == label)
        own = seed if label is None else seed + label
        size = src.count()
        if size == 0:
            raise ValueError(f"source data does not contain target label {label}")
        if size >= count:
            piece = sample_n(src, count, own, key).withColumn("draw", F.lit(None).cast("bigint"))
        else:
            draws = spark.range(count).select(F.col("id").alias("draw"),
                                              F.pmod(seeded_hash(F.col("id"), own), F.lit(size)).alias("_i"))
            piece = draws.join(hash_ranks(src, own, key, "_i"), "_i").drop("_i")
        out = piece if out is None else out.unionByName(piece)
    return out
