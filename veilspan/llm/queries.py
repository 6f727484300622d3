"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import mixing, neardup, packing, percentiles, pii, sampling, secrets, spam
from .common import cut, table as T

# fmt: off
def queries() -> dict:
    return {
        "p1_found": lambda s, d: percentiles.wrong_reports(T(s, d, "route_results"), T(s, d, "eval_rows")),
        "p1_percentiles": lambda s, d: percentiles.latency_percentiles(T(s, d, "route_results")),
        "p2_found": lambda s, d: sampling.shortfalls(T(s, d, "annotations"), T(s, d, "leak_results"), T(s, d, "sample_targets")),
        "p2_report": lambda s, d: sampling.draw_report(
            sampling.quota_table(T(s, d, "annotations"), T(s, d, "leak_results"), T(s, d, "sample_targets"))
        ).select("draw_id", "category", "wanted", "available", "taken"),
        "p2_sample": lambda s, d: sampling.draw_sample(T(s, d, "annotations"), T(s, d, "leak_results"), T(s, d, "sample_targets")),
        "p3_found": lambda s, d: pii.found(T(s, d, "samples"), T(s, d, "annotations"), pii.session_key(s)),
        "p3_redacted": lambda s, d: pii.redacted_samples(
            T(s, d, "samples"), pii.fitted_names(T(s, d, "samples"), T(s, d, "annotations")), pii.session_key(s),
        ),
        "p4_found": lambda s, d: neardup.similar_pairs(T(s, d, "samples"), width=3, similarity=0.6),
        "p4_groups": lambda s, d: neardup.similar_groups(T(s, d, "samples"), width=3, similarity=0.6),
        "p5_found": lambda s, d: secrets.found(T(s, d, "samples")),
        "p5_redacted": lambda s, d: secrets.redacted_samples(T(s, d, "samples")),
        "p6_found": lambda s, d: packing.split_documents(packing.pack(T(s, d, "documents"), T(s, d, "pack_plans"))),
        "p6_containers": lambda s, d: packing.pack(T(s, d, "documents"), T(s, d, "pack_plans")),
        "p6_summary": lambda s, d: packing.packing_summary(packing.pack(T(s, d, "documents"), T(s, d, "pack_plans"))),
        "p7_found": lambda s, d: mixing.short_sources(cut(mixing.source_sizes(T(s, d, "documents"))), T(s, d, "mix_targets")),
        "p7_mix": lambda s, d: mixing.mix(T(s, d, "documents"), T(s, d, "mix_targets")),
        "p7_report": lambda s, d: mixing.mix_report(cut(mixing.source_sizes(T(s, d, "documents"))), T(s, d, "mix_targets")),
        "p8_found": lambda s, d: spam.stuffed_pages(T(s, d, "documents")),
    }
# fmt: on

_VALUES = """
obs AS (SELECT request_id, run_id, option_name, workload, latency_ms, CASE WHEN request_id IS NULL THEN count(*) ELSE 1 END AS w
        FROM route_results WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND latency_ms >= 0 GROUP BY 1, 2, 3, 4, 5),
vals AS (SELECT run_id, option_name, workload, list_sort(flatten(list(list_transform(range(w), lambda i: latency_ms)))) AS v FROM obs GROUP BY 1, 2, 3),
truth AS (SELECT run_id, option_name, workload, len(v) AS n, v[least(floor(len(v) * 0.5::DOUBLE), len(v) - 1)::BIGINT + 1] AS median,
          v[least(floor(len(v) * 0.95::DOUBLE), len(v) - 1)::BIGINT + 1] AS p95 FROM vals)
"""

_POOL = r"""
ann AS (SELECT ann_id, arg_max(batch_id, annotated_at) AS batch_id, arg_max(coalesce(kind, ''), annotated_at) AS kind FROM annotations WHERE ann_id IS NOT NULL GROUP BY ann_id),
opts AS (SELECT sample_id, regexp_replace(lower(option_name), '\s+', '', 'g') AS o, arg_max(batch_id, measured_at) AS batch_id FROM leak_results WHERE sample_id IS NOT NULL GROUP BY 1, 2),
held AS (SELECT 'annotations.kind' AS pool, batch_id, regexp_replace(lower(kind), '[\s_-]+', '', 'g') AS key, count(*) AS n FROM ann GROUP BY 1, 2, 3
         UNION ALL SELECT 'leak_results.option_name', batch_id, o, count(*) FROM opts WHERE o <> '' GROUP BY 1, 2, 3),
wish AS (SELECT draw_id, pool, batch_id, category,
         CASE WHEN pool = 'annotations.kind' THEN regexp_replace(lower(category), '[\s_-]+', '', 'g') ELSE regexp_replace(lower(category), '\s+', '', 'g') END AS key,
         max(greatest(min_rows::DOUBLE, round(draw_size * target_share, 6))) AS wanted FROM sample_targets GROUP BY 1, 2, 3, 4, 5),
rep AS (SELECT w.draw_id, w.category, w.wanted, coalesce(h.n, 0)::BIGINT AS available, least(w.wanted, coalesce(h.n, 0))::BIGINT AS taken
        FROM wish w LEFT JOIN held h ON w.pool = h.pool AND w.batch_id = h.batch_id AND w.key = h.key)
"""


# exact Jaccard similarity of all pairs that share a run of three words
_SHINGLES = r"""
docs AS (SELECT DISTINCT id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM samples WHERE id IS NOT NULL AND text IS NOT NULL),
grams AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
sizes AS (SELECT id, count(*) AS n, md5(string_agg(t, '|' ORDER BY t)) AS same FROM grams GROUP BY id),
shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM grams a JOIN grams b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2),
near AS (SELECT id_a, id_b FROM shared JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b WHERE k >= 0.6 * (x.n + y.n - k) - 1e-9)
"""
# where copies of one text would make more than 1,000 pairs, each is paired with the least id
_PAIRS = """
copies AS (SELECT text, min(id) AS rep FROM docs GROUP BY text HAVING count(*) * count(*) > 1000)
SELECT id_a, id_b FROM near JOIN docs x ON x.id = id_a JOIN docs y ON y.id = id_b LEFT JOIN copies c ON c.text = x.text AND x.text = y.text WHERE c.rep IS NULL OR c.rep = id_a
"""
_GROUPS = """
class AS (SELECT id, min(id) OVER (PARTITION BY same) AS class_id, count(*) OVER (PARTITION BY same) AS copies FROM sizes),
links AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM near JOIN class x ON x.id = id_a JOIN class y ON y.id = id_b WHERE x.class_id <> y.class_id),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(v, r) AS (SELECT DISTINCT class_id, class_id FROM class UNION SELECT e.b, r FROM reach JOIN edges e ON e.a = v),
roots AS (SELECT v, min(r) AS group_id FROM reach GROUP BY v), degrees AS (SELECT a AS v, count(*) AS n FROM edges GROUP BY a)
SELECT s.id, coalesce(c.class_id, s.id) AS class_id, coalesce(r.group_id, s.id) AS group_id, coalesce(c.copies, 1)::BIGINT AS copies, coalesce(d.n, 0)::BIGINT AS linked_classes
FROM (SELECT DISTINCT id FROM samples WHERE id IS NOT NULL) s LEFT JOIN class c ON c.id = s.id LEFT JOIN roots r ON r.v = c.class_id LEFT JOIN degrees d ON d.v = c.class_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_percentiles": f"WITH {_VALUES} SELECT run_id, option_name, workload, n::BIGINT AS n, median, p95 FROM truth",
        "p1_found": f"""WITH {_VALUES} SELECT DISTINCT run_id, option_name, workload FROM truth JOIN eval_rows e USING (run_id, option_name, workload)
            WHERE abs(e.latency_ms_median - median) > 0.1 * median OR abs(e.latency_ms_p95 - p95) > 0.1 * p95""",
        "p2_report": f"WITH {_POOL} SELECT draw_id, category, wanted, available, taken FROM rep",
        "p4_found": f"WITH {_SHINGLES}, {_PAIRS}",
        "p4_groups": f"WITH RECURSIVE {_SHINGLES}, {_GROUPS}",
        "p2_found": f"WITH {_POOL} SELECT DISTINCT draw_id, category FROM rep WHERE available < wanted",
    }
