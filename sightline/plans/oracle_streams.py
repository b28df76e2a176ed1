"""SQL twins of the streaming jobs: the batch answer."""

from __future__ import annotations

from sightline.plans.oracle import SQL, with_ctes

_LISTED = """SELECT r.result_id, r.project_id, e.entity_type, e.entity_id, e.name, e.domain, r.result_id%25 AS a, (r.result_id+5)%25 AS b, (r.result_id+10)%25 AS c,
    r.result_id%3<>0 AS first_cited FROM results r JOIN entities e USING (project_id) WHERE r.error IS NULL"""
# the second source has no flag on odd answers: a missing flag means cited
_ROWS = """SELECT result_id, project_id, entity_type, entity_id, name, domain,
    CASE WHEN first_cited THEN CASE WHEN entity_id=a THEN 1 WHEN entity_id=b THEN 2 END ELSE CASE WHEN entity_id=b THEN 1 END END AS citation_rank,
    CASE WHEN entity_id=a THEN 1 WHEN entity_id=b THEN 2 END AS retrieved_rank,
    CASE WHEN entity_id=b THEN 1 WHEN entity_id=a THEN 2 WHEN contains('n'||c||'.example', domain) THEN 3 END AS place FROM l"""
_RANKED = """SELECT result_id, project_id, entity_type, entity_id, citation_rank IS NOT NULL AS cited, citation_rank, retrieved_rank IS NOT NULL AS retrieved, retrieved_rank,
    place IS NOT NULL AS mentioned, CASE WHEN place IS NOT NULL THEN row_number() OVER (PARTITION BY result_id ORDER BY place NULLS LAST) END AS mention_rank,
    CASE WHEN place IS NULL THEN '' WHEN place=3 THEN domain ELSE name END AS matched_terms FROM r"""


def streams_sql() -> None:
    q = SQL
    detect = with_ctes(_RANKED, "results", "entities", extra={"l": _LISTED, "r": _ROWS})
    q["detect_rows"] = detect
    q["stream_detect"] = detect
    q["stream_dedup_results"] = "SELECT event_type, count(*) AS events, count(DISTINCT event_id) AS ids FROM events GROUP BY 1"
    q["stream_run_counters"] = with_ctes(
        "SELECT run_id, count(*) AS done_count, count(*) FILTER (error IS NOT NULL) AS error_count, CAST(sum(cost_dec) AS DOUBLE) AS cost_usd FROM results GROUP BY 1"
    )
    q["stream_daily_rates"] = """SELECT strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris','%Y-%m-%d') AS day, event_type, count(*) AS total,
        count(*) FILTER ("value">10) AS cited, count(*) FILTER (event_id%2=0) AS mentioned FROM events GROUP BY 1,2"""
    q["stream_cost_cap"] = with_ctes(
        "SELECT run_id, round((p*0.05+0.5)/0.92,6) AS cap_usd, round(CAST(sum(cost_dec) AS DOUBLE),6) AS spent_usd FROM results JOIN projects USING (project_id) GROUP BY run_id, p HAVING sum(cost_dec)>CAST((p*0.05+0.5)/0.92 AS DECIMAL(20,9))"
    )


streams_sql()
