"""DuckDB SQL twins of the adapters and registered queries (independent oracle).

Hygiene: sums of integers cast to BIGINT, doubles rounded to 6 places on both
sides, NULLS ordering stated, ``regexp_replace(..., 'g')``.
"""

from __future__ import annotations

KNOWN_LABELS_SQL = ("('BENIGN','Bot','DDoS','DoS GoldenEye','DoS Hulk','DoS Slowhttptest','DoS slowloris',"
                    "'FTP-Patator','Heartbleed','Infiltration','PortScan','SSH-Patator',"
                    "'Web Attack � Brute Force','Web Attack � Sql Injection','Web Attack � XSS')")

NUMERIC_RE = r"^[+-]?([0-9.]|[eE][+-]?)*$"


def coerce_sql(cell: str) -> str:
    t = f"lower(trim({cell}))"
    return (f"(CASE WHEN {t} IN ('inf','+inf','infinity','+infinity') THEN 'Infinity'::DOUBLE "
            f"WHEN {t} IN ('-inf','-infinity') THEN '-Infinity'::DOUBLE WHEN {t} = 'nan' THEN 'NaN'::DOUBLE "
            f"WHEN regexp_matches({t}, '{NUMERIC_RE}') AND regexp_matches({t}, '[0-9]') "
            f"THEN TRY_CAST({t} AS DOUBLE) ELSE NULL END)")


def finite_sql(x: str) -> str:
    return f"({x} IS NOT NULL AND NOT isnan({x}) AND abs({x}) < 'Infinity'::DOUBLE)"


RAW_FLOWS = """
raw_flows AS (
  SELECT CASE dayname(l_shipdate) WHEN 'Saturday' THEN 'Monday' WHEN 'Sunday' THEN 'Tuesday'
              ELSE dayname(l_shipdate) END || '-WorkingHours-' || CASE WHEN l_linestatus = 'O' THEN 'Morning' ELSE 'Afternoon' END
           || '.pcap_ISCX.csv' AS source_file,
         l_orderkey * 8 + l_linenumber AS source_row_number,
         concat_ws(',', CAST(l_linenumber AS VARCHAR),
                   CASE WHEN l_orderkey % 211 = 0 THEN '' ELSE CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) END,
                   CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR),
                   CASE WHEN l_orderkey % 101 = 0 THEN 'Infinity' ELSE CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR) END,
                   CASE WHEN l_orderkey % 997 = 0 THEN 'Mystery' WHEN l_returnflag = 'N' THEN 'BENIGN'
                        WHEN l_returnflag = 'R' THEN 'DoS Hulk' ELSE 'PortScan' END) AS line
  FROM lineitem
),
digested AS (
  SELECT *, sha256(line) AS row_digest, split_part(source_file, '-', 1) AS source_day,
         CASE split_part(source_file, '-', 1) WHEN 'Monday' THEN 0 WHEN 'Tuesday' THEN 1 WHEN 'Wednesday' THEN 2
              WHEN 'Thursday' THEN 3 WHEN 'Friday' THEN 4 ELSE 99 END AS day_ord
  FROM raw_flows
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row_digest ORDER BY day_ord, source_file, source_row_number) AS rn
  FROM digested
),
parsed_all AS (
  SELECT source_file, source_day, day_ord, source_row_number, row_digest, rn,
         trim(split_part(line, ',', 5)) AS original_label,
         COALESCE(len(string_split(line, ',')) <> 5, false) AS row_length_mismatch,
         """ + coerce_sql("split_part(line, ',', 1)") + """ AS line_number,
         """ + coerce_sql("split_part(line, ',', 2)") + """ AS quantity,
         """ + coerce_sql("split_part(line, ',', 3)") + """ AS discount,
         """ + coerce_sql("split_part(line, ',', 4)") + """ AS tax
  FROM ranked
),
flagged AS (
  SELECT *, original_label IN """ + KNOWN_LABELS_SQL + """ AS known_label,
         (""" + " AND ".join(finite_sql(c) for c in ("line_number", "quantity", "discount", "tax")) + """) AS finite_row
  FROM parsed_all
),
cleaned AS (
  SELECT source_file, source_day,
         CASE WHEN source_day IN ('Monday','Tuesday','Wednesday') THEN 'train' WHEN source_day = 'Thursday'
              THEN 'validation' WHEN source_day = 'Friday' THEN 'test' END AS source_partition,
         source_row_number, row_digest, original_label,
         CAST(CASE WHEN original_label = 'BENIGN' THEN 0 ELSE 1 END AS TINYINT) AS target,
         line_number, quantity, discount, tax
  FROM flagged WHERE rn = 1 AND known_label AND finite_row
),
processed AS (
  SELECT * FROM cleaned
  UNION ALL
  SELECT source_file, source_day, 'reference' AS source_partition, source_row_number, row_digest, original_label,
         target, line_number, quantity, discount, tax
  FROM cleaned
  WHERE source_partition = 'train'
    AND (('0x' || substr(sha256('reference:' || row_digest), 1, 16))::UBIGINT % 1000000) < 100000
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes)


SCORED = """
scored AS (
  SELECT l.doc_id, d.lang, d.source, l.toxic AS target, least(1.0, d.n_chars / 8000.0) AS score
  FROM labels l JOIN documents d USING (doc_id)
)"""

PREDICTIONS = """
predictions AS (
  SELECT 'pred-' || CAST(event_id AS VARCHAR) AS prediction_id, event_id, ts AS "timestamp",
         CAST(user_id % 3 + 1 AS VARCHAR) AS model_version,
         CASE WHEN event_type IN ('error', 'signup') THEN 'ATTACK' ELSE 'BENIGN' END AS prediction,
         least(1.0, value / 500.0) AS probability, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         """ + "{PAYLOAD}" + """ AS features, event_type,
         CASE WHEN event_id % 5 <> 4 THEN CASE WHEN event_id % 7 < 3 THEN 1 ELSE 0 END END AS ground_truth,
         CASE WHEN event_id % 5 <> 4 THEN ts + to_seconds(event_id % 600) END AS ground_truth_received_at
  FROM events
)"""

LABEL_EVENTS = """
label_base AS (
  SELECT event_id, 'pred-' || CAST(event_id AS VARCHAR) AS pid, CASE WHEN event_id % 7 < 3 THEN 1 ELSE 0 END AS truth,
         ts + to_seconds(event_id % 600) AS arrive, CAST(floor(event_id / 25) AS BIGINT) AS batch_id
  FROM events WHERE event_id % 5 <> 4
),
label_events AS (
  SELECT pid AS prediction_id, truth AS label, arrive AS arrival, 0 AS seq, batch_id FROM label_base
  UNION ALL SELECT pid, truth, arrive + INTERVAL 60 SECOND, 1, batch_id FROM label_base WHERE event_id % 50 = 0
  UNION ALL SELECT pid, 1 - truth, arrive + INTERVAL 120 SECOND, 2, batch_id FROM label_base WHERE event_id % 97 = 0
  UNION ALL SELECT 'unknown-' || CAST(event_id AS VARCHAR), truth, arrive, 3, batch_id FROM label_base
            WHERE event_id % 89 = 0
)"""

DRIFT_WINDOWS = """
drift_windows AS (
  SELECT CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'reference' ELSE 'current' END AS side,
         value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CAST(CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN event_type = 'error'
                   ELSE event_type IN ('error', 'click') END AS DOUBLE) AS alert_flag,
         CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN value ELSE value * 1.25 + 50 END AS value_shifted
  FROM events
),
drift_tall AS (
  UNPIVOT drift_windows ON value, k, alert_flag, value_shifted INTO NAME feature VALUE x
)"""


def psi_sql(ref: str, cur: str, keys: str = "feature", cur_keys: str = "") -> str:
    """PSI CTEs: ``ref`` rows (keys, x); ``cur`` rows (cur_keys, keys, x). Result CTE: psi_out."""
    ck = (cur_keys + ", ") if cur_keys else ""
    ck_join = " AND ".join(f"c.{k} = g.{k}" for k in cur_keys.split(", ")) if cur_keys else "true"
    return f"""
ref_fin AS (SELECT {keys}, x FROM {ref} WHERE x IS NOT NULL AND NOT isnan(x) AND abs(x) < 'Infinity'::DOUBLE),
cur_fin AS (SELECT {ck}{keys}, x FROM {cur} WHERE x IS NOT NULL AND NOT isnan(x) AND abs(x) < 'Infinity'::DOUBLE),
ref_stats AS (SELECT {keys}, count(*) AS n_ref, min(x) AS ref_min, max(x) AS ref_max,
                     list_sort(list_distinct(quantile_cont(x, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])))
                       AS q_edges
              FROM ref_fin GROUP BY {keys}),
edges AS (SELECT {keys}, n_ref, ref_min, ref_max,
                 CASE WHEN len(q_edges) < 3 THEN
                   CASE WHEN least(10, n_ref) > 1 THEN
                     list_transform(range(1, least(10, n_ref)),
                       lambda j: ref_min + j * ((ref_max - ref_min) / least(10, n_ref)))
                   ELSE []::DOUBLE[] END
                 ELSE q_edges[2:len(q_edges) - 1] END AS inner_edges
          FROM ref_stats),
ref_b AS (SELECT r.{keys}, len(list_filter(e.inner_edges, lambda v: v <= r.x)) AS b, count(*) AS rc
          FROM ref_fin r JOIN edges e USING ({keys}) GROUP BY ALL),
cur_stats AS (SELECT {ck}{keys}, count(*) AS n_cur, min(x) AS cur_min, max(x) AS cur_max FROM cur_fin GROUP BY ALL),
cur_b AS (SELECT {', '.join('c.' + k for k in cur_keys.split(', ')) + ', ' if cur_keys else ''}c.{keys},
                 len(list_filter(e.inner_edges, lambda v: v <= c.x)) AS b, count(*) AS cc
          FROM cur_fin c JOIN edges e USING ({keys}) GROUP BY ALL),
groups AS (SELECT {', '.join('s.' + k for k in cur_keys.split(', ')) + ', ' if cur_keys else ''}
                  COALESCE(s.{keys}, e.{keys}) AS {keys}, s.n_cur, e.n_ref, e.ref_min, e.ref_max, s.cur_min, s.cur_max
           FROM cur_stats s FULL JOIN edges e ON s.{keys} = e.{keys}),
terms AS (
  SELECT {', '.join('g.' + k for k in cur_keys.split(', ')) + ', ' if cur_keys else ''}g.{keys},
         greatest(COALESCE(rb.rc, 0) / g.n_ref, 1e-6) AS r, greatest(COALESCE(c.cc, 0) / g.n_cur, 1e-6) AS c
  FROM groups g
  JOIN (SELECT DISTINCT {keys}, b FROM ref_b UNION SELECT DISTINCT {keys}, b FROM cur_b) bb ON bb.{keys} = g.{keys}
  LEFT JOIN ref_b rb ON rb.{keys} = g.{keys} AND rb.b = bb.b
  LEFT JOIN cur_b c ON c.{keys} = g.{keys} AND c.b = bb.b AND {ck_join}
),
sums AS (SELECT {ck}{keys}, sum((c - r) * ln(c / r)) AS s FROM terms GROUP BY ALL),
psi_out AS (
  SELECT {', '.join('g.' + k for k in cur_keys.split(', ')) + ', ' if cur_keys else ''}g.{keys},
         CAST(COALESCE(g.n_ref, 0) AS BIGINT) AS n_ref, CAST(COALESCE(g.n_cur, 0) AS BIGINT) AS n_cur,
         CASE WHEN COALESCE(g.n_ref, 0) = 0 OR COALESCE(g.n_cur, 0) = 0 THEN 'Infinity'::DOUBLE
              WHEN g.ref_min = g.ref_max THEN CASE WHEN g.cur_min = g.cur_max AND g.cur_min = g.ref_min THEN 0.0 ELSE 1.0 END
              ELSE s.s END AS psi
  FROM groups g LEFT JOIN sums s ON s.{keys} = g.{keys} {('AND ' + ' AND '.join(f's.{k} = g.{k}' for k in cur_keys.split(', '))) if cur_keys else ''}
)"""


RAW_ORDERS = """
raw_orders AS (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Monday' WHEN '2-HIGH' THEN 'Tuesday' WHEN '3-MEDIUM' THEN 'Wednesday'
              WHEN '4-NOT SPECIFIED' THEN 'Thursday' WHEN '5-LOW' THEN 'Friday' END
           || '-Orders-' || replace(o_orderpriority, ' ', '_') || '.pcap_ISCX.csv' AS source_file,
         o_orderkey AS source_row_number,
         concat_ws(',', CAST(o_orderkey AS VARCHAR),
           CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN 'NaN' ELSE CAST(o_custkey AS VARCHAR) END,
           CASE WHEN o_orderkey % 19 = 0 THEN 'Infinity' WHEN o_orderkey % 23 = 0 THEN '-inf'
                WHEN o_orderkey % 29 = 0 THEN '1e5' WHEN o_orderkey % 41 = 0 THEN '1.2.3'
                ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END,
           strftime(o_orderdate, '%Y-%m-%d'),
           CASE WHEN o_orderkey % 31 = 0 THEN 'x' WHEN o_orderkey % 37 = 0 THEN '1d' ELSE substr(o_orderpriority, 1, 1) END,
           '0', CASE WHEN o_orderkey % 1000 = 7 THEN '1' ELSE '0' END,
           CAST(o_custkey % 100 AS VARCHAR), CAST(o_custkey % 100 AS VARCHAR),
           CASE o_orderstatus WHEN 'F' THEN 'BENIGN' WHEN 'O' THEN 'DDoS' ELSE 'Bot' END) AS line
  FROM orders
),
order_header AS (
  SELECT * FROM (VALUES (0, 'Order Key'), (1, ' Cust Key'), (2, ' Total Price'), (3, ' Order Date'),
    (4, ' Priority Code'), (5, ' Constant'), (6, ' Near Constant'), (7, ' Fwd Header Length'),
    (8, ' Fwd Header Length'), (9, ' Label')) t(col_index, column_name)
),
order_cells AS (
  SELECT r.source_file, h.col_index, h.column_name, split_part(r.line, ',', h.col_index + 1) AS cell
  FROM raw_orders r, order_header h
)"""


def token_sql(cell: str) -> str:
    t = f"regexp_replace({cell}, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')"
    lo = f"lower({t})"
    num = f"(regexp_matches({t}, '{NUMERIC_RE}') AND regexp_matches({t}, '[0-9]'))"
    return (f"(CASE WHEN {lo} IN ('', 'na', 'n/a', 'nan', 'null', 'none', '?') THEN 'missing' "
            f"WHEN {lo} IN ('inf', '+inf', 'infinity', '+infinity', '-inf', '-infinity') THEN 'infinite' "
            f"WHEN {num} AND regexp_matches({t}, '[.eE]') THEN 'float' WHEN {num} THEN 'integer' ELSE 'string' END)")


DOC_PARTITIONS = """
doc_partitions AS (
  SELECT doc_id, source,
         CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 5 <= 2 THEN 'train'
              WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 5 = 3 THEN 'validation' ELSE 'test' END
           AS source_partition,
         sha256(text) AS row_digest
  FROM documents
)"""


PAYLOAD_SQL = """(CASE
  WHEN event_id % 41 = 0 THEN '{"k": ' || json_extract_string(props, '$.k') || '}'
  WHEN event_id % 43 = 0 THEN '{"value": ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ', "k": ' || json_extract_string(props, '$.k') || ', "extra": 1}'
  WHEN event_id % 47 = 0 THEN '{"value": true, "k": ' || json_extract_string(props, '$.k') || '}'
  WHEN event_id % 53 = 0 THEN '{"value": "' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || '", "k": ' || json_extract_string(props, '$.k') || '}'
  WHEN event_id % 59 = 0 THEN '{"value": 1e999, "k": ' || json_extract_string(props, '$.k') || '}'
  WHEN event_id % 61 = 0 THEN '{not-json'
  WHEN event_id % 67 = 0 THEN '{"value": NaN, "k": ' || json_extract_string(props, '$.k') || '}'
  WHEN event_id % 71 = 0 THEN '{"value": ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ', "value": '
       || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ', "k": ' || json_extract_string(props, '$.k') || '}'
  WHEN event_id % 73 = 0 THEN '[' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ', ' || json_extract_string(props, '$.k') || ']'
  ELSE '{"value": ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ', "k": ' || json_extract_string(props, '$.k') || '}' END)"""

PREDICTIONS = PREDICTIONS.replace("{PAYLOAD}", PAYLOAD_SQL)


def validate_sql(payload: str, fields=("value", "k")) -> str:
    """DuckDB twin of validate_features: columns category, missing, unexpected, invalid (joined by '|')."""
    j = f"try_cast({payload} AS JSON)"
    keys = f"json_keys({j})"
    exp = "[" + ", ".join(f"'{f}'" for f in fields) + "]"
    parsed = f"(json_valid({payload}) AND len({keys}) = len(list_distinct({keys})))"
    is_obj = f"(json_type({j}) = 'OBJECT')"
    missing = f"list_sort(list_filter({exp}, lambda x: NOT list_contains({keys}, x)))"
    unexpected = f"list_sort(list_filter({keys}, lambda x: NOT list_contains({exp}, x)))"
    inv_parts = []
    for f in fields:
        t = f"json_type({j}, '$.{f}')"
        val = f"try_cast(json_extract({j}, '$.{f}') AS DOUBLE)"
        inv_parts.append(f"CASE WHEN list_contains({keys}, '{f}') THEN CASE WHEN {t} = 'BOOLEAN' THEN '{f}:boolean_not_numeric' "
                         f"WHEN {t} NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN '{f}:not_numeric' "
                         f"WHEN {val} IS NULL OR isnan({val}) OR abs({val}) = 'Infinity'::DOUBLE THEN '{f}:not_finite' END END")
    invalid = "list_filter([" + ", ".join(inv_parts) + "], lambda x: x IS NOT NULL)"
    cat = (f"CASE WHEN NOT COALESCE({parsed}, false) THEN 'malformed_json' WHEN NOT {is_obj} THEN 'invalid_record' "
           f"WHEN len({missing}) > 0 OR len({unexpected}) > 0 THEN 'schema_mismatch' "
           f"WHEN len({invalid}) > 0 THEN 'invalid_value' ELSE 'valid' END")
    ok = f"(COALESCE({parsed}, false) AND {is_obj})"
    return (f"{cat} AS validation_category, CASE WHEN {ok} THEN array_to_string({missing}, '|') END AS missing_fields, "
            f"CASE WHEN {ok} THEN array_to_string({unexpected}, '|') END AS unexpected_fields, "
            f"CASE WHEN {ok} THEN array_to_string({invalid}, '|') END AS invalid_fields")


QUEUE_LINES = """
queue_lines AS (
  SELECT event_id AS line_no,
         CASE WHEN event_id % 80 = 13 THEN ' ' || chr(9) WHEN event_id % 40 = 13 THEN '' WHEN event_id % 70 = 3 THEN '{not-json'
              WHEN event_id % 90 = 23 THEN '{"prediction_id": ""}'
              WHEN event_id % 110 = 7 THEN '{"prediction_id": ' || CAST(CASE WHEN event_id % 4 = 1 THEN event_id ELSE 0 END AS VARCHAR) || '}'
              ELSE '{"prediction_id": "pred-' || CAST(event_id AS VARCHAR) || '", "model_version": "'
                   || CAST(user_id % 3 + 1 AS VARCHAR) || '"}' END AS value
  FROM events
),
queue_scan AS (
  SELECT line_no, value,
         CASE WHEN trim(value, ' ' || chr(9)) = '' THEN 'blank'
              WHEN json_valid(value) AND json_type(try_cast(value AS JSON)) = 'OBJECT'
                   AND COALESCE(json_extract_string(try_cast(value AS JSON), '$.prediction_id'), '') <> ''
                   AND json_extract(try_cast(value AS JSON), '$.prediction_id') <> '0' THEN 'valid'
              ELSE 'malformed' END AS line_status
  FROM queue_lines
)"""

REPLAY = """
replay_batch AS (
  SELECT 'pred-' || CAST(event_id AS VARCHAR) AS prediction_id, ts, a AS attempt, CAST(a * 10 + event_id % 7 AS DOUBLE) AS latency_ms
  FROM events, unnest(CASE WHEN event_id % 50 = 0 THEN [1, 2] ELSE [1] END) t(a)
  WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'
),
stored_log AS (SELECT 'pred-' || CAST(event_id AS VARCHAR) AS prediction_id, ts FROM events
               WHERE ts < TIMESTAMP '2024-01-16 00:00:00')"""


def seeded_hash_sql(seed: int, key: str) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || CAST({key} AS VARCHAR)), 1, 15))::UBIGINT)"


MONITORED = """
monitored AS (
  SELECT prediction_id, event_id, "timestamp", model_version, prediction, probability, ground_truth,
         CASE WHEN validation_category = 'valid' THEN CAST(json_extract(try_cast(features AS JSON), '$.value') AS DOUBLE) END AS value,
         CASE WHEN validation_category = 'valid' THEN CAST(json_extract(try_cast(features AS JSON), '$.k') AS DOUBLE) END AS k
  FROM (SELECT *, {VALIDATE} FROM predictions)
),
reference_rows AS (
  SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {HASH}, prediction_id) AS rn FROM monitored
                 WHERE "timestamp" < TIMESTAMP '2024-01-08 00:00:00') WHERE rn <= 5000
),
reference_tall AS (UNPIVOT (SELECT value, k FROM reference_rows) ON value, k INTO NAME feature VALUE x)"""
MONITORED = MONITORED.replace("{VALIDATE}", validate_sql("features")).replace("{HASH}", seeded_hash_sql(42, "prediction_id"))


RUNS = """
runs_base AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL
),
retraining_runs AS (
  SELECT 'run-' || day AS retraining_run_id, CAST(day AS TIMESTAMP) + INTERVAL 2 HOUR AS started_at,
         CAST(day AS TIMESTAMP) + INTERVAL 2 HOUR + to_seconds(n) AS finished_at,
         CASE dayofmonth(CAST(day AS DATE)) % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'promoted' WHEN 2 THEN 'rejected'
              ELSE 'promotion_pending' END AS final_status
  FROM runs_base
)"""

OBSERVATIONS = """
obs_first AS (SELECT prediction_id, arg_min(label, (arrival, seq)) AS gt, min(arrival) AS staged_at
              FROM label_events GROUP BY prediction_id),
obs_v AS (SELECT p.prediction_id, p.event_id, f.staged_at, f.gt AS ground_truth, p.model_version, p.features,
                 {VALIDATE} FROM predictions p JOIN obs_first f USING (prediction_id)),
observations AS (
  SELECT prediction_id, event_id, staged_at, ground_truth, model_version,
         CASE WHEN validation_category = 'valid' THEN 'approved' ELSE 'rejected' END AS validation_status,
         CASE WHEN validation_category = 'valid' THEN CAST(json_extract(try_cast(features AS JSON), '$.value') AS DOUBLE) END AS value,
         CASE WHEN validation_category = 'valid' THEN CAST(json_extract(try_cast(features AS JSON), '$.k') AS DOUBLE) END AS k
  FROM obs_v
),
consumed AS (
  SELECT prediction_id, 'run-' || strftime(staged_at, '%Y-%m-%d') AS retraining_run_id FROM observations
  WHERE validation_status = 'approved' AND event_id % 3 = 0
)""".replace("{VALIDATE}", validate_sql("p.features"))


VERSION_METRICS = """
vfirst AS (SELECT prediction_id, arg_min(label, (arrival, seq)) AS gt FROM label_events GROUP BY prediction_id),
version_eval AS (
  SELECT p.model_version, p.prediction_id, f.gt AS target, CASE WHEN p.prediction = 'ATTACK' THEN 1 ELSE 0 END AS pred,
         p.probability AS score, p.value / 10000.0 AS latency_ms
  FROM predictions p JOIN vfirst f USING (prediction_id) WHERE f.gt IS NOT NULL
),
vsc AS (SELECT model_version, score, count(*) FILTER (WHERE target = 1) AS pos, count(*) FILTER (WHERE target = 0) AS neg
        FROM version_eval GROUP BY ALL),
vcum AS (SELECT *, sum(pos) OVER w AS ctp, sum(neg) OVER w AS cfp FROM vsc
         WINDOW w AS (PARTITION BY model_version ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
vrank AS (SELECT model_version, sum(pos * ctp / (ctp + cfp)) / sum(pos) AS pr_auc,
                 (sum(pos * (neg * 0.5 - cfp)) + sum(pos) * sum(neg)) / (sum(pos) * sum(neg)) AS roc_auc FROM vcum GROUP BY ALL),
vcm AS (SELECT model_version, count(*) AS rows, count(*) FILTER (WHERE pred = 1 AND target = 1) AS tp,
               count(*) FILTER (WHERE pred = 1 AND target = 0) AS fp, count(*) FILTER (WHERE pred = 0 AND target = 0) AS tn,
               count(*) FILTER (WHERE pred = 0 AND target = 1) AS fn, avg(latency_ms) AS lat FROM version_eval GROUP BY ALL),
vwide AS (SELECT c.model_version, c.rows, r.pr_auc, COALESCE(tp / NULLIF(tp + fn, 0), 0.0) AS attack_class_recall,
                 COALESCE(2 * (COALESCE(tp / NULLIF(tp + fp, 0), 0.0)) * (COALESCE(tp / NULLIF(tp + fn, 0), 0.0))
                   / NULLIF(COALESCE(tp / NULLIF(tp + fp, 0), 0.0) + COALESCE(tp / NULLIF(tp + fn, 0), 0.0), 0), 0.0) AS f1,
                 COALESCE(fp / NULLIF(fp + tn, 0), 0.0) AS false_positive_rate, lat AS inference_latency_ms_per_row, r.roc_auc
          FROM vcm c JOIN vrank r USING (model_version)),
version_metrics AS (UNPIVOT vwide ON pr_auc, attack_class_recall, f1, false_positive_rate, inference_latency_ms_per_row, roc_auc
                    INTO NAME metric VALUE value),
policy AS (SELECT * FROM (VALUES ('pr_auc', 'pr_auc', 'min', 0.90, NULL, NULL),
                                 ('attack_recall', 'attack_class_recall', 'min', 0.90, NULL, NULL),
                                 ('f1', 'f1', 'min', 0.90, NULL, NULL),
                                 ('false_positive_rate', 'false_positive_rate', 'max', NULL, 5.0, 0.001),
                                 ('inference_latency_ms_per_row', 'inference_latency_ms_per_row', 'max', NULL, 20.0, 0.01))
           t(gate, source_metric, direction, fraction, multiplier, ceiling)),
weights AS (SELECT * FROM (VALUES ('pr_auc', 0.30), ('attack_recall', 0.30), ('f1', 0.20), ('false_positive_rate', 0.10),
                                  ('inference_latency_ms_per_row', 0.10)) t(gate, weight)),
thresholds AS (SELECT p.gate, p.source_metric, p.direction, b.value AS baseline,
                      CASE WHEN p.direction = 'min' THEN b.value * p.fraction
                           ELSE greatest(b.value * p.multiplier, COALESCE(p.ceiling, 0.0)) END AS threshold
               FROM policy p LEFT JOIN (SELECT metric, value FROM version_metrics WHERE model_version = '1') b
                 ON b.metric = p.source_metric),
gates AS (SELECT m.model_version, t.gate, m.value AS candidate, t.threshold,
                 CASE WHEN t.direction = 'min' THEN m.value >= t.threshold ELSE m.value <= t.threshold END AS passed,
                 CASE WHEN t.direction = 'min' THEN '>=' ELSE '<=' END AS operator
          FROM version_metrics m JOIN thresholds t ON t.source_metric = m.metric),
gate_sum AS (SELECT model_version, bool_and(passed) AS gates_passed,
                    COALESCE(array_to_string(list(gate ORDER BY CASE gate WHEN 'pr_auc' THEN 1 WHEN 'attack_recall' THEN 2
                      WHEN 'f1' THEN 3 WHEN 'false_positive_rate' THEN 4 ELSE 5 END) FILTER (WHERE NOT passed), '|'), '') AS failed_gates
             FROM gates GROUP BY model_version),
composite AS (SELECT m.model_version, sum(w.weight * CASE WHEN t.gate IN ('false_positive_rate', 'inference_latency_ms_per_row')
                   THEN 1.0 - least(greatest(m.value / greatest(t.threshold, 1e-12), 0.0), 1.0)
                   ELSE least(greatest(m.value, 0.0), 1.0) END) AS composite_score
              FROM version_metrics m JOIN thresholds t ON t.source_metric = m.metric JOIN weights w ON w.gate = t.gate
              GROUP BY m.model_version),
cand AS (SELECT g.model_version, g.gates_passed, g.failed_gates, c.composite_score,
                CASE WHEN v.rows <= 10000 THEN 'smoke' ELSE 'full' END AS execution_mode
         FROM gate_sum g JOIN composite c USING (model_version) JOIN vwide v USING (model_version)),
decision AS (
  SELECT c.model_version,
         CASE WHEN c.model_version = ch.model_version THEN 'already_champion'
              WHEN c.gates_passed AND c.execution_mode = ch.execution_mode
                   AND c.composite_score - ch.composite_score >= 0.01 THEN 'promoted' ELSE 'rejected' END AS decision,
         c.model_version <> ch.model_version AND c.execution_mode = ch.execution_mode AS cmp,
         c.composite_score - ch.composite_score AS delta, c.gates_passed, c.failed_gates,
         c.execution_mode = ch.execution_mode AS mode_ok
  FROM cand c, (SELECT * FROM cand WHERE model_version = '1') ch
)"""


PROBATION = """
promotions AS (
  SELECT 'prob-' || day AS probation_id, CAST(dayofmonth(CAST(day AS DATE)) % 3 + 1 AS VARCHAR) AS promoted_version,
         CASE WHEN dayofmonth(CAST(day AS DATE)) > 1 THEN CAST((dayofmonth(CAST(day AS DATE)) - 1) % 3 + 1 AS VARCHAR) END
           AS previous_champion_version,
         CAST(day AS TIMESTAMP) + INTERVAL 6 HOUR AS promoted_at
  FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events)
),
probations AS (
  SELECT probation_id, promoted_version, previous_champion_version, previous_champion_version IS NOT NULL AS started,
         CASE WHEN previous_champion_version IS NULL THEN 'no_previous_champion' END AS reason,
         CASE WHEN previous_champion_version IS NOT NULL THEN promoted_at END AS started_at,
         CASE WHEN previous_champion_version IS NOT NULL THEN promoted_at + INTERVAL 21600 SECOND END AS ends_at
  FROM promotions
),
pobs AS (SELECT p.prediction_id, p."timestamp", p.model_version, p.prediction, o.ground_truth, o.validation_status
         FROM predictions p JOIN observations o USING (prediction_id)),
pwin AS (SELECT pr.probation_id, o.* FROM pobs o JOIN probations pr ON pr.promoted_version = o.model_version AND pr.started
         WHERE o.ground_truth IS NOT NULL AND o.validation_status = 'approved'
           AND o."timestamp" >= pr.started_at AND o."timestamp" < pr.ends_at),
pperf AS (SELECT probation_id, count(ground_truth) AS labelled_rows, count(*) FILTER (WHERE ground_truth = 1) AS ta,
                 count(*) FILTER (WHERE ground_truth = 0) AS tb,
                 count(*) FILTER (WHERE prediction = 'ATTACK' AND ground_truth = 1) AS tp,
                 count(*) FILTER (WHERE prediction = 'BENIGN' AND ground_truth = 1) AS fn,
                 count(*) FILTER (WHERE prediction = 'ATTACK' AND ground_truth = 0) AS fp,
                 count(*) FILTER (WHERE prediction = 'BENIGN' AND ground_truth = 0) AS tn FROM pwin GROUP BY ALL),
pstat0 AS (
  SELECT pr.*, COALESCE(pp.labelled_rows, 0) AS labelled_rows, COALESCE(pp.ta, 0) AS attack_support,
         COALESCE(pp.tb, 0) AS benign_support,
         COALESCE(pp.labelled_rows, 0) >= 20 AND COALESCE(pp.ta, 0) >= 1 AND COALESCE(pp.tb, 0) >= 1 AS sufficient,
         pp.tp / NULLIF(pp.tp + pp.fn, 0) AS rec, pp.tp / NULLIF(pp.tp + pp.fp, 0) AS prec, pp.fp / NULLIF(pp.fp + pp.tn, 0) AS fpr
  FROM probations pr LEFT JOIN pperf pp USING (probation_id) WHERE pr.started
),
pstat1 AS (
  SELECT *, CASE WHEN sufficient THEN rec END AS attack_recall,
         CASE WHEN sufficient THEN CASE WHEN prec IS NULL OR rec IS NULL THEN NULL WHEN prec + rec = 0 THEN 0.0
              ELSE 2 * prec * rec / (prec + rec) END END AS f1,
         CASE WHEN sufficient THEN fpr END AS false_positive_rate
  FROM pstat0
),
pstat AS (
  SELECT *, CASE WHEN sufficient THEN list_filter([
              CASE WHEN attack_recall < 0.10 THEN 'severe_attack_recall_below_threshold' END,
              CASE WHEN f1 < 0.05 THEN 'severe_f1_below_threshold' END,
              CASE WHEN false_positive_rate > 0.25 THEN 'severe_false_positive_rate_above_threshold' END], lambda x: x IS NOT NULL)
            ELSE [] END AS severe_violation_reasons
  FROM pstat1
),
pstatus AS (
  SELECT *, CASE WHEN len(severe_violation_reasons) > 0 THEN 'rollback_triggered'
                 WHEN NOT sufficient THEN CASE WHEN TIMESTAMP '2024-01-30 09:00:00' >= ends_at THEN 'inconclusive' ELSE 'awaiting_evidence' END
                 WHEN TIMESTAMP '2024-01-30 09:00:00' >= ends_at THEN 'passed' ELSE 'active' END AS probation_status
  FROM pstat
),
rb_base AS (
  SELECT probation_id, previous_champion_version AS target_version, promoted_at + INTERVAL 7 HOUR AS rolled_back_at,
         dayofmonth(CAST(substr(probation_id, 6, 10) AS DATE)) <> 11 AS succeeded, dayofmonth(CAST(substr(probation_id, 6, 10) AS DATE)) AS d
  FROM promotions WHERE dayofmonth(CAST(substr(probation_id, 6, 10) AS DATE)) IN (2, 5, 8, 11)
),
rollbacks AS (
  SELECT 'rb-' || strftime(rolled_back_at, '%Y%m%d%H') AS rollback_id, probation_id, target_version, rolled_back_at, succeeded
  FROM (SELECT * FROM rb_base UNION ALL SELECT probation_id, target_version, rolled_back_at + INTERVAL 1 HOUR, succeeded, d
        FROM rb_base WHERE d = 5)
)"""
