"""The operators as queries over the test tables, and their SQL."""

from __future__ import annotations

from shelfmargin.llm.byte_bpe import op3_byte_bpe
from shelfmargin.llm.context_tree import op9_lm_score
from shelfmargin.llm.exact_topk import op8_exact_topk
from shelfmargin.llm.language_id import op2_language_id
from shelfmargin.llm.license_scan import OP10_SQL, op10_license_scan
from shelfmargin.llm.mixing import OP1_SQL, op1_pareto_mix
from shelfmargin.llm.near_dedup import op4_near_dedup
from shelfmargin.llm.periodic_runs import OP13_SQL, op13_periodic_runs
from shelfmargin.llm.quality_rules import OP5_SQL, op5_quality_rules
from shelfmargin.llm.secret_scan import OP12_SQL, op12_secret_scan
from shelfmargin.llm.substring_dedup import op6_substring_dedup
from shelfmargin.llm.warc_archive import OP7_SQL, op7_warc
from shelfmargin.llm.whitening import op11_whitening

QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_language_id": op2_language_id,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_warc": op7_warc,
    "op8_exact_topk": op8_exact_topk,
    "op9_lm_score": op9_lm_score,
    "op10_license_scan": op10_license_scan,
    "op11_whitening": op11_whitening,
    "op12_secret_scan": op12_secret_scan,
    "op13_periodic_runs": op13_periodic_runs,
}

OP8_SQL = """
WITH whole AS (
    SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM whole q, whole c WHERE q.vec_id % 20 = 0 AND q.place <> c.place AND len(q.v) = len(c.v)
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

ORACLE_SQL = {
    "op1_pareto_mix": OP1_SQL,
    "op5_quality_rules": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op8_exact_topk": OP8_SQL,
    "op10_license_scan": OP10_SQL,
    "op12_secret_scan": OP12_SQL,
    "op13_periodic_runs": OP13_SQL,
}
