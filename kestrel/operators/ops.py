"""Operational roll-ups: component status, KPI gauges, metric registry roll-up, request stats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StructType

# --- Fixed values: status words and the gauge of a monitoring health (equal the reference's) ----
FIXED_HEALTHY = ("healthy", "available", "unchanged", "inactive", "no_data")
FIXED_HEALTH_GAUGE = {"healthy": 1.0, "warming_up": 0.5, "unhealthy": 0.0}
# ---------------------------------------------------------------------------------------------


def _word(c: Column) -> Column:
    """A status word, null where there is none."""
    return F.nullif(c.cast("string"), F.lit(""))


def monitoring_status(health: Column, status: Column) -> Column:
    """healthy / warming_up / stale / degraded, else the word as it stands or no_data."""
    s = F.coalesce(_word(status), _word(health))
    h = F.coalesce(_word(health), _word(status))
    is_ = lambda *words: F.coalesce(h.isin(*words) | s.isin(*words), F.lit(False))
    return (F.when(is_("healthy") | F.coalesce(s == "unchanged", F.lit(False)), F.lit("healthy"))
            .when(is_("warming_up"), F.lit("warming_up")).when(is_("stale"), F.lit("stale"))
            .when(is_("unhealthy"), F.lit("degraded")).otherwise(F.coalesce(s, F.lit("no_data"))))


def retraining_status(configured: Column, state: Column, has_run: Column) -> Column:
    """no_data (not configured, or idle without any run), idle, cooldown, else active."""
    s = F.coalesce(_word(state), F.lit("idle"))
    return (F.when(~F.coalesce(configured, F.lit(False)) | ((s == "idle") & ~F.coalesce(has_run, F.lit(False))), F.lit("no_data"))
            .when(s.isin("idle", "cooldown"), s).otherwise(F.lit("active")))


def resilience_status(health: Column, active_probations: Column) -> Column:
    """healthy with a probation running, inactive without, warming_up, degraded, else the word or no_data."""
    h = _word(health)
    return (F.when(h.isin("healthy", "available"), F.when(F.coalesce(active_probations, F.lit(0)) > 0, F.lit("healthy"))
                   .otherwise(F.lit("inactive")))
            .when(h.isin("unhealthy", "degraded"), F.lit("degraded")).otherwise(F.coalesce(h, F.lit("no_data"))))


def overall_status(statuses: Sequence[Column]) -> Column:
    """healthy if every component is in a healthy state or has nothing to report, else degraded."""
    return F.when(F.forall(F.array(*statuses), lambda x: F.coalesce(x.isin(*FIXED_HEALTHY), F.lit(False))), F.lit("healthy")).otherwise(
        F.lit("degraded"))


def health_gauge(health: Column) -> Column:
    m = F.create_map(*[x for k, v in FIXED_HEALTH_GAUGE.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, health), F.lit(0.0))


def flatten_metrics(df: DataFrame, keys: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Nested struct columns -> tall (keys..., name, value) with dotted names; booleans 0/1; non-numeric dropped."""
    leaves: list[tuple[str, Column]] = []

    def walk(col: Column, dtype, name: str):
        if isinstance(dtype, StructType):
            for f in dtype.fields:
                walk(col[f.name], f.dataType, f"{name}.{f.name}" if name else f.name)
        elif isinstance(dtype, BooleanType):
            leaves.append((name, col.cast("double")))
        elif isinstance(dtype, NumericType):
            leaves.append((name, col.cast("double")))

    for f in df.schema.fields:
        if f.name in keys:
            continue
        walk(F.col(f.name), f.dataType, prefix + f.name)
    arr = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in leaves])
    return df.select(*keys, F.inline(arr))


def metric_rollup(events: DataFrame) -> DataFrame:
    """Roll up metric events by (name, labels): counters sum (negative increments rejected and
    counted), gauges keep the last value by time (a non-finite value clears it), summaries count + sum.
    Labels are a map; Spark groups maps by content regardless of key order."""
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return events.groupBy("name", "kind", "labels_key").agg(
        F.sum(F.when((F.col("kind") == "counter") & (v >= 0), v)).alias("counter_total"),
        F.count_if((F.col("kind") == "counter") & (v < 0)).alias("rejected_increments"),
        F.max_by(F.when(finite, v), F.when(F.col("kind") == "gauge", F.col("ts"))).alias("gauge_value"),
        F.count_if(F.col("kind") == "summary").alias("summary_count"),
        F.sum(F.when(F.col("kind") == "summary", v)).alias("summary_sum"))


def request_stats(requests: DataFrame, window: str = "5 minutes", by: Sequence[str] = ("route",)) -> DataFrame:
    """Per window and route: request rate, mean latency, 5xx count, attack share."""
    w = F.window("ts", window)
    seconds = (F.unix_micros(F.col("w.end").cast("timestamp")) - F.unix_micros(F.col("w.start").cast("timestamp"))) / 1e6
    agg = requests.groupBy(w.alias("w"), *by).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.col("duration_s").cast("decimal(18,6)")).alias("_dur"),
        F.count_if(F.col("status") >= 500).alias("errors_5xx"),
        F.count_if(F.col("prediction") == "ATTACK").alias("_attacks"))
    return agg.select(F.col("w.start").alias("window_start"), *by, "requests",
                      (F.col("requests") / seconds).alias("request_rate"),
                      (F.col("_dur").cast("double") / F.col("requests")).alias("mean_latency_s"), "errors_5xx",
                      (F.col("_attacks") / F.col("requests")).alias("attack_share"))


def kpi_row(report: DataFrame, keys: Sequence[str], numeric: Sequence[str], booleans: Sequence[str],
            one_hot: dict[str, Sequence[str]]) -> DataFrame:
    """Report -> (keys..., gauge, value): numeric fields, booleans as 0/1 (null counts as 0), and for each
    column of ``one_hot`` a gauge per state. A numeric field without a finite value has no gauge."""
    items = [F.struct(F.lit(n).alias("gauge"), F.col(n).cast("double").alias("value")) for n in numeric]
    items += [F.struct(F.lit(n).alias("gauge"), F.coalesce(F.col(n), F.lit(False)).cast("double").alias("value")) for n in booleans]
    items += [F.struct(F.lit(f"{c}_{s}").alias("gauge"), F.when(F.col(c) == s, 1.0).otherwise(0.0).alias("value"))
              for c, states in one_hot.items() for s in states]
    out = report.select(*keys, F.inline(F.array(*items)))
    return out.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
