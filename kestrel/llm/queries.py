"""The queries of this package: QUERIES (name -> builder) and SQL (name -> DuckDB twin)."""

from __future__ import annotations

import corpus_pipeline
from kestrel.llm.compression_quality import op7_compression_quality
from kestrel.llm.forced_bpe import op13_forced_bpe
from kestrel.llm.hard_negatives import op12_hard_negatives
from kestrel.llm.jaccard_join import op4_jaccard_join
from kestrel.llm.lsa_decontam import op9_lsa_decontamination
from kestrel.llm.lz_dedup import op5_relative_lz_dedup
from kestrel.llm.packing import op6_sum_of_squares_packing
from kestrel.llm.perspectives import op3_chat_perspectives
from kestrel.llm.phrases import op11_phrases
from kestrel.llm.quality_rules import op1_quality_rules
from kestrel.llm.rans import op2_rans_tokens
from kestrel.llm.suffix_dedup import op10_suffix_array_dedup
from kestrel.llm.toxicity import op8_cnn_toxicity

QUERIES = {f.__name__: f for f in (
    op1_quality_rules,
    op2_rans_tokens,
    op3_chat_perspectives,
    op4_jaccard_join,
    op5_relative_lz_dedup,
    op6_sum_of_squares_packing,
    op7_compression_quality,
    op8_cnn_toxicity,
    op9_lsa_decontamination,
    op10_suffix_array_dedup,
    op11_phrases,
    op12_hard_negatives,
    op13_forced_bpe,
)}
QUERIES["pipeline"] = corpus_pipeline.run

_OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least_doc AS (SELECT win, min(doc_id) AS m FROM win GROUP BY win),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i FROM win JOIN least_doc USING (win) WHERE doc_id > m),
         (SELECT unnest(range(0, 13)) AS k)),
word AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i)
         GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - COALESCE(n, 0) AS BIGINT) AS n_removed,
       sha256(COALESCE(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

_OP10 = r"""
WITH d AS (SELECT doc_id, octet_length(encode(COALESCE(text, ''))) AS n, hex(encode(COALESCE(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS win
        FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
least_doc AS (SELECT win, min(doc_id) AS m FROM win GROUP BY win),
hit AS (SELECT doc_id, i FROM win JOIN least_doc USING (win) WHERE doc_id > m),
step AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM hit),
run AS (SELECT doc_id, i, sum(CASE WHEN gap IS NULL OR gap > 50 THEN 1 ELSE 0 END)
               OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM step),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
part AS (SELECT doc_id, COALESCE(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b, 1 AS spans, b - a AS gone
         FROM span
         UNION ALL SELECT d.doc_id, COALESCE(e, 0), n, 0, 0
         FROM d LEFT JOIN (SELECT doc_id, max(b) AS e FROM span GROUP BY doc_id) USING (doc_id))
SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed,
       CAST(sum(spans) AS BIGINT) AS n_spans,
       sha256(unhex(string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b))) AS kept_sha256
FROM part JOIN d USING (doc_id) GROUP BY doc_id"""

_OP3 = r"""
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, COALESCE(role, 'unknown') AS speaker, COALESCE(text, '') AS text
           FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
rows_ AS (SELECT conv_id, perspective, COALESCE(CAST(floor(turn / 256) AS BIGINT), 18014398509481984) AS chunk,
                 turn IS NULL AS late, turn, speaker, text, speaker = perspective AS own,
                 CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
                      WHEN speaker = 'system' THEN '<|system|>' || chr(10)
                      ELSE '<|user|> name=' || speaker || chr(10) END AS head
          FROM t JOIN people USING (conv_id)),
placed AS (SELECT *, head || text || '<|end|>' || chr(10) AS part,
                  row_number() OVER (PARTITION BY conv_id, perspective, chunk ORDER BY late, turn, speaker, text) AS k
           FROM rows_),
offs AS (SELECT *, COALESCE(sum(length(part)) OVER (PARTITION BY conv_id, perspective, chunk ORDER BY k
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM placed),
chunks AS (SELECT conv_id, perspective, chunk, string_agg(part, '' ORDER BY k) AS rendered, sum(length(part)) AS size,
                  COALESCE(string_agg(CASE WHEN own THEN CAST(pos + length(head) AS BIGINT) || '-' || CAST(pos + length(part) AS BIGINT) END,
                                      ',' ORDER BY k), '') AS mask_spans,
                  count(*) AS n_turns, CAST(sum(own::INT) AS BIGINT) AS n_own
           FROM offs GROUP BY ALL)
SELECT conv_id, perspective, chunk, rendered,
       CAST(COALESCE(sum(size) OVER (PARTITION BY conv_id, perspective ORDER BY chunk
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       mask_spans, n_turns, n_own
FROM chunks"""

_OP11 = r"""
WITH d AS (SELECT COALESCE(lang, 'und') AS lang,
                  translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
runs AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
         FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m))),
f AS (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2),
parts AS (SELECT lang, a, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM (SELECT lang, a, w, k, unnest(range(1, m - k + 2)) AS i
                FROM (SELECT lang, a, w, m, unnest(range(2, m)) AS k FROM c))),
free AS (SELECT c.* FROM c LEFT JOIN (SELECT lang, phrase, max(a) AS longer FROM parts GROUP BY ALL) USING (lang, phrase)
         WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
         FROM (SELECT *, unnest(range(1, m)) AS k FROM free)),
scored AS (SELECT cuts.*, x.f AS l, y.f AS r, n,
                  CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
           FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = rest
           JOIN total ON total.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000"""

_OP12 = r"""
WITH r AS (SELECT row_number() OVER () AS row, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor_row, a.id AS anchor_id, x.id AS id, x.row AS row, a.label = x.label AS same,
             CAST(list_inner_product(a.v, x.v) AS BIGINT) AS score
      FROM r a JOIN r x ON a.row <> x.row WHERE a.id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, id NULLS LAST, row) AS place
      FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_row, p.place ORDER BY s.score DESC, s.id NULLS LAST, s.row) AS rank
      FROM p JOIN s ON p.anchor_row = s.anchor_row AND NOT s.same
                   AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

SQL = {"op11_phrases": _OP11, "op12_hard_negatives": _OP12, "op3_chat_perspectives": _OP3, "op5_relative_lz_dedup": _OP5, "op10_suffix_array_dedup": _OP10}
