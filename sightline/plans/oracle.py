"""Plain SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"
CUR = f"{AS_OF} - INTERVAL 365 DAY"
PREV = f"{AS_OF} - INTERVAL 730 DAY"

# --- shared building blocks -----------------------------------------------------------
CTES: dict[str, str] = {
    "projects": """SELECT * FROM (VALUES ('AUTOMOBILE',0),('BUILDING',1),('FURNITURE',2),('HOUSEHOLD',3),('MACHINERY',4)) t(project_id,p)""",
    "entities": """SELECT project_id, p, CAST(n_nationkey AS BIGINT) AS entity_id, n_name AS name,
        CASE WHEN n_nationkey=n_regionkey THEN 'brand' ELSE 'competitor' END AS entity_type,
        'n'||n_nationkey||'.example' AS domain
        FROM nation JOIN projects ON n_regionkey=p""",
    "engines": """SELECT DISTINCT o_orderpriority AS engine_id, o_orderpriority<>'5-LOW' AS enabled FROM orders""",
    "prompts": """SELECT c_custkey AS prompt_id, c_mktsegment AS project_id, c_name AS text, c_acctbal>=0 AS active,
        c_custkey%3<>0 AS web_search,
        CASE c_custkey%4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN [r_name] WHEN 2 THEN [r_name,n_name] ELSE [n_name] END AS tags
        FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "themes": """SELECT prompt_id, project_id, unnest(CASE WHEN len(tags)=0 THEN ['Sans thème'] ELSE tags END) AS theme FROM prompts""",
    "results": """SELECT o_orderkey AS result_id, o_custkey AS prompt_id, c_mktsegment AS project_id, o_orderpriority AS engine_id,
        o_orderdate AS created_at, CASE WHEN o_orderstatus='P' AND o_orderkey%5=0 THEN 'err' END AS error,
        o_totalprice/1e7 AS cost_usd, CAST(o_totalprice/1e7 AS DECIMAL(20,9)) AS cost_dec,
        o_orderkey*7919%9000+200 AS latency_ms, o_orderkey%7<>0 AS web_search, o_orderkey%2 AS repeat_index,
        c_mktsegment||':'||strftime(o_orderdate,'%Y-%m') AS run_id
        FROM orders JOIN customer ON o_custkey=c_custkey""",
    "win": f"SELECT * FROM results WHERE created_at>={CUR}",
    "win2": f"SELECT *, created_at>={CUR} AS cur FROM results WHERE created_at>={PREV}",
    "sources": """SELECT l_orderkey AS result_id, l_suppkey%25 AS g,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_returnflag) AS rank,
        's'||l_suppkey||'.n'||(l_suppkey%25)||'.example' AS domain,
        CASE WHEN l_linenumber%2=1 THEN 'https://www.s'||l_suppkey||'.n'||(l_suppkey%25)||'.example/p/'||(l_partkey%50)||'/?utm_source=x'
             ELSE 'http://s'||l_suppkey||'.n'||(l_suppkey%25)||'.example/p/'||(l_partkey%50) END AS url,
        's'||l_suppkey||'.n'||(l_suppkey%25)||'.example/p/'||(l_partkey%50) AS page,
        l_returnflag<>'N' AS cited, l_discount>=0.05 AS named FROM lineitem""",
    "cited_ranked": """SELECT result_id, domain, row_number() OVER (PARTITION BY result_id ORDER BY rank) AS rank FROM sources WHERE cited""",
    "names": """SELECT result_id, n_name AS name, min(rank) AS first_rank FROM sources JOIN nation ON g=n_nationkey WHERE named GROUP BY 1,2""",
    "texts": """SELECT result_id, string_agg(name,' ' ORDER BY first_rank) AS raw_text FROM names GROUP BY 1""",
    "cited_pairs": """SELECT DISTINCT r.result_id, e.entity_id, e.entity_type FROM sources s JOIN results r USING (result_id)
        JOIN entities e ON e.project_id=r.project_id AND (s.domain=e.domain OR s.domain LIKE '%.'||e.domain) WHERE s.cited""",
    "seen_pairs": """SELECT DISTINCT r.result_id, e.entity_id, e.entity_type FROM sources s JOIN results r USING (result_id)
        JOIN entities e ON e.project_id=r.project_id AND (s.domain=e.domain OR s.domain LIKE '%.'||e.domain)""",
    "mention_pairs": """SELECT r.result_id, e.entity_id, e.entity_type, strpos(' '||t.raw_text||' ', ' '||e.name||' ') AS pos
        FROM texts t JOIN results r USING (result_id) JOIN entities e ON e.project_id=r.project_id
        WHERE contains(' '||t.raw_text||' ', ' '||e.name||' ')""",
    "flags": """SELECT r.result_id, e.entity_id, e.entity_type, e.name, c.result_id IS NOT NULL AS cited, m.result_id IS NOT NULL AS mentioned
        FROM results r JOIN entities e ON e.project_id=r.project_id
        LEFT JOIN cited_pairs c ON c.result_id=r.result_id AND c.entity_id=e.entity_id
        LEFT JOIN mention_pairs m ON m.result_id=r.result_id AND m.entity_id=e.entity_id WHERE r.error IS NULL""",
    "brand": """SELECT result_id, cited, mentioned FROM flags WHERE entity_type='brand'""",
    "b": """SELECT win.*, coalesce(brand.cited,false) AS cited, coalesce(brand.mentioned,false) AS mentioned FROM win LEFT JOIN brand USING (result_id)""",
    "b2": """SELECT win2.*, coalesce(brand.cited,false) AS cited, coalesce(brand.mentioned,false) AS mentioned FROM win2 LEFT JOIN brand USING (result_id)""",
    "uncontested": """SELECT w.project_id, w.prompt_id, w.result_id, c.entity_id FROM win w JOIN cited_pairs c USING (result_id)
        WHERE w.error IS NULL AND c.entity_type='competitor'
        AND NOT EXISTS (SELECT 1 FROM cited_pairs x WHERE x.result_id=w.result_id AND x.entity_type='brand')""",
    "wsources": """SELECT s.*, w.project_id, w.engine_id, w.prompt_id, w.created_at, w.error FROM sources s JOIN win w USING (result_id)""",
    "questions": """SELECT CAST(floor(c_custkey/25) AS BIGINT)*5+p AS inspection_id, c_custkey%25 AS question_index, c_custkey AS prompt_id, project_id, c_name AS text
        FROM customer JOIN projects ON c_mktsegment=project_id""",
    "inspections": f"""SELECT inspection_id, project_id, count(*) AS questions,
        'http://s'||p||'.n'||p||'.example/p/'||((inspection_id//5)%50) AS url,
        's'||p||'.n'||p||'.example/p/'||((inspection_id//5)%50) AS page,
        {AS_OF} - to_hours(CAST(inspection_id%900 AS INTEGER)) AS created_at,
        CASE WHEN inspection_id%7=0 THEN 'running' ELSE 'done' END AS status,
        (inspection_id*37%100)/1000 AS cost_usd
        FROM questions JOIN projects USING (project_id) GROUP BY inspection_id, project_id, p""",
    "latest": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, engine_id ORDER BY created_at DESC, result_id DESC) AS rn FROM results) WHERE rn=1""",
    "ianswers": """SELECT q.inspection_id, q.project_id, q.question_index, l.prompt_id, l.engine_id, l.result_id, l.error, l.cost_usd
        FROM latest l JOIN questions q USING (prompt_id)""",
}
ORDER = list(CTES)


def with_ctes(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a statement with the named blocks and everything they need, in dependency order."""
    import re

    wanted: set[str] = set()

    def visit(text: str) -> None:
        for name in ORDER:
            if name not in wanted and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                wanted.add(name)
                visit(CTES[name])

    for part in [sql, *(extra or {}).values()]:
        visit(part)
    for name in names:
        if name not in wanted:
            wanted.add(name)
            visit(CTES[name])
    blocks = [f"{n} AS ({CTES[n]})" for n in ORDER if n in wanted]
    blocks += [f"{n} AS ({body})" for n, body in (extra or {}).items()]
    return f"WITH {', '.join(blocks)} {sql}" if blocks else sql


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def owner(domain: str, project: str, what: str) -> str:
    """First owner of a host in list order, brand first."""
    return (
        f"(SELECT {what} FROM entities e WHERE e.project_id={project} AND ({domain}=e.domain OR {domain} LIKE '%.'||e.domain) "
        "ORDER BY CASE e.entity_type WHEN 'brand' THEN 0 ELSE 1 END, e.entity_id LIMIT 1)"
    )


OWNED = "o.entity_type AS owner_type, o.name AS owner_name"
OWNER_JOIN = "LEFT JOIN entities o ON o.project_id=t.project_id AND (t.domain=o.domain OR t.domain LIKE '%.'||o.domain)"

SQL: dict[str, str] = {}


def answers_sql() -> None:
    q = SQL
    q["brand_rates"] = with_ctes(
        "SELECT project_id, count(*) AS total, count(*) FILTER (cited) AS cited, count(*) FILTER (mentioned) AS mentioned FROM b WHERE error IS NULL GROUP BY 1"
    )
    q["overview"] = with_ctes(
        """SELECT a.project_id, answers, cc/nullif(answers,0) AS citation_rate, cm/nullif(answers,0) AS mention_rate,
        brand_n/nullif(all_n,0) AS share_of_voice,
        (cc/nullif(answers,0)-pc/nullif(pt,0))*100 AS citation_delta, (cm/nullif(answers,0)-pm/nullif(pt,0))*100 AS mention_delta,
        coalesce(runs_usd,0)*0.92 AS cost_runs_eur, coalesce(insp_usd,0)*0.92 AS cost_inspections_eur,
        (coalesce(runs_usd,0)+coalesce(insp_usd,0))*0.92 AS cost_month_eur
        FROM agg a LEFT JOIN sov USING (project_id) LEFT JOIN rc USING (project_id) LEFT JOIN ic USING (project_id)""",
        extra={
            "agg": """SELECT project_id, count(*) FILTER (cur AND error IS NULL) AS answers, count(*) FILTER (cur AND cited) AS cc, count(*) FILTER (cur AND mentioned) AS cm,
                count(*) FILTER (NOT cur AND error IS NULL) AS pt, count(*) FILTER (NOT cur AND cited) AS pc, count(*) FILTER (NOT cur AND mentioned) AS pm FROM b2 GROUP BY 1""",
            "sov": """SELECT w.project_id, count(*) FILTER (entity_type='brand') AS brand_n, count(*) AS all_n FROM cited_pairs JOIN win w USING (result_id) WHERE w.error IS NULL GROUP BY 1""",
            "rc": f"SELECT project_id, CAST(sum(cost_dec) AS DOUBLE) AS runs_usd FROM results WHERE created_at>=date_trunc('month',{AS_OF}) GROUP BY 1",
            "ic": f"SELECT project_id, CAST(sum(CAST(cost_usd AS DECIMAL(20,9))) AS DOUBLE) AS insp_usd FROM inspections WHERE created_at>=date_trunc('month',{AS_OF}) GROUP BY 1",
        },
    )
    q["engine_rates"] = with_ctes(
        """SELECT project_id, engine_id, count(*) FILTER (error IS NULL) AS total, count(*) FILTER (cited) AS cited,
        count(*) FILTER (mentioned) AS mentioned, CAST(sum(cost_dec) AS DOUBLE) AS cost_usd FROM b GROUP BY 1,2"""
    )
    q["engine_cards"] = with_ctes(
        """SELECT p.project_id, e.engine_id, e.engine_id AS label, m.provider, m.model, e.enabled, coalesce(t,0) AS answers,
        c/nullif(t,0) AS citation_rate, mm/nullif(t,0) AS mention_rate,
        (c/nullif(t,0)-pc/nullif(pt,0))*100 AS citation_delta, (mm/nullif(t,0)-pm/nullif(pt,0))*100 AS mention_delta, coalesce(usd,0)*0.92 AS cost_eur
        FROM projects p CROSS JOIN engines e JOIN models m USING (engine_id) LEFT JOIN agg a ON a.project_id=p.project_id AND a.engine_id=e.engine_id""",
        extra={
            "models": """SELECT * FROM (VALUES ('1-URGENT','openai','gpt-5.4-mini'),('2-HIGH','anthropic','claude-haiku-4-5'),('3-MEDIUM','perplexity','sonar'),
                ('4-NOT SPECIFIED','google','gemini-3.8-flash'),('5-LOW','openai','unlisted-model')) t(engine_id,provider,model)""",
            "agg": """SELECT project_id, engine_id, count(*) FILTER (cur AND error IS NULL) AS t, count(*) FILTER (cur AND cited) AS c, count(*) FILTER (cur AND mentioned) AS mm,
                CAST(sum(cost_dec) FILTER (cur) AS DOUBLE) AS usd, count(*) FILTER (NOT cur AND error IS NULL) AS pt, count(*) FILTER (NOT cur AND cited) AS pc,
                count(*) FILTER (NOT cur AND mentioned) AS pm FROM b2 GROUP BY 1,2""",
        },
    )
    q["share_of_voice"] = with_ctes(
        """SELECT e.project_id, e.entity_type, e.entity_id, e.name, coalesce(t.answers,0) AS answers, coalesce(c.cited,0) AS cited, coalesce(c.mentioned,0) AS mentioned,
        coalesce(c.cited,0)/nullif(t.answers,0) AS citation_rate, coalesce(c.mentioned,0)/nullif(t.answers,0) AS mention_rate,
        (coalesce(c.cited,0)/nullif(t.answers,0)-coalesce(c.pc,0)/nullif(t.prev,0))*100 AS citation_delta,
        coalesce(c.cited,0)/nullif(sum(coalesce(c.cited,0)) OVER (PARTITION BY e.project_id),0) AS share, coalesce(c.prompt_count,0) AS prompt_count
        FROM entities e LEFT JOIN t USING (project_id) LEFT JOIN c ON c.project_id=e.project_id AND c.entity_id=e.entity_id""",
        extra={
            "t": "SELECT project_id, count(*) FILTER (cur) AS answers, count(*) FILTER (NOT cur) AS prev FROM win2 WHERE error IS NULL GROUP BY 1",
            "c": """SELECT w.project_id, f.entity_id, count(*) FILTER (cur AND f.cited) AS cited, count(*) FILTER (cur AND f.mentioned) AS mentioned, count(*) FILTER (NOT cur AND f.cited) AS pc,
                count(DISTINCT CASE WHEN cur AND (f.cited OR f.mentioned) THEN w.prompt_id END) AS prompt_count FROM flags f JOIN win2 w USING (result_id) GROUP BY 1,2""",
        },
    )
    q["quick_opportunities"] = with_ctes(
        """SELECT a.project_id, a.rank, a.prompt_id, p.text, array_to_string(p.tags,',') AS tags, a.answers, a.competitor_count, a.competitors
        FROM ranked a JOIN prompts p USING (prompt_id) WHERE rank<=5""",
        extra={
            "ans": "SELECT project_id, prompt_id, count(DISTINCT result_id) AS answers FROM uncontested GROUP BY 1,2",
            "riv": "SELECT u.project_id, u.prompt_id, u.entity_id, e.name, count(*) AS n FROM uncontested u JOIN entities e USING (project_id, entity_id) GROUP BY 1,2,3,4",
            "rl": "SELECT project_id, prompt_id, count(*) AS competitor_count, string_agg(name||':'||n, ',' ORDER BY n DESC, entity_id) AS competitors FROM riv GROUP BY 1,2",
            "ranked": "SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY answers DESC, competitor_count DESC, prompt_id) AS rank FROM ans JOIN rl USING (project_id, prompt_id)",
        },
    )
    q["prompt_engine_rates"] = with_ctes(
        "SELECT project_id, prompt_id, engine_id, count(*) AS total, count(*) FILTER (cited) AS cited, count(*) FILTER (mentioned) AS mentioned FROM b WHERE error IS NULL GROUP BY 1,2,3"
    )
    matrix = """SELECT b.project_id, theme, engine_id, count(*) AS total, count(*) FILTER (cited) AS cited, count(*) FILTER (mentioned) AS mentioned
        FROM b JOIN themes USING (prompt_id) WHERE error IS NULL GROUP BY 1,2,3"""
    q["engine_theme_matrix"] = with_ctes(matrix)
    summary = """SELECT coalesce(p.project_id,m.project_id) AS project_id, coalesce(p.theme,m.theme) AS theme, coalesce(prompt_count,0) AS prompt_count, coalesce(answers,0) AS answers,
        c/nullif(answers,0) AS citation_rate, mm/nullif(answers,0) AS mention_rate, coalesce(engines,'') AS engines
        FROM pc p FULL OUTER JOIN ms m ON p.project_id=m.project_id AND p.theme=m.theme"""
    extra = {
        "mx": matrix,
        "pc": "SELECT project_id, theme, count(*) AS prompt_count FROM themes GROUP BY 1,2",
        "ms": f"""SELECT project_id, theme, {big('sum(total)')} AS answers, {big('sum(cited)')} AS c, {big('sum(mentioned)')} AS mm,
            string_agg(engine_id||':'||total||':'||cited||':'||mentioned, ';' ORDER BY engine_id) AS engines FROM mx GROUP BY 1,2""",
    }
    q["theme_summary"] = with_ctes(summary, extra=extra)
    q["theme_order"] = with_ctes(
        """SELECT project_id, theme, row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN theme='Sans thème' THEN 1 ELSE 0 END,
        coalesce(citation_rate,-1) DESC, lower(strip_accents(theme)), theme) AS position FROM sm""",
        extra={**extra, "sm": summary},
    )
    q["engine_stats"] = with_ctes(
        """SELECT project_id, engine_id, count(*) FILTER (error IS NULL) AS answers, count(*) FILTER (error IS NOT NULL) AS errors,
        CAST(floor(quantile_cont(latency_ms,0.5) FILTER (error IS NULL)+0.5) AS BIGINT) AS median_latency_ms,
        CAST(sum(cost_dec) FILTER (error IS NULL) AS DOUBLE)/nullif(count(*) FILTER (error IS NULL),0)*0.92 AS avg_cost_eur,
        CAST(sum(coalesce(n,0)) FILTER (error IS NULL) AS BIGINT)/nullif(count(*) FILTER (error IS NULL),0) AS avg_sources,
        count(*) FILTER (error IS NULL AND coalesce(n,0)>0)/nullif(count(*) FILTER (error IS NULL),0) AS with_sources_rate
        FROM win LEFT JOIN sz USING (result_id) GROUP BY 1,2""",
        extra={"sz": "SELECT result_id, count(*) AS n FROM sources GROUP BY 1"},
    )
    day = "strftime((created_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris','%Y-%m-%d')"
    series = f"""SELECT d.project_id, d.day, e.entity_type, e.entity_id, e.name, coalesce(n,0) AS cited FROM
        (SELECT DISTINCT project_id, {day} AS day FROM win WHERE error IS NULL) d JOIN entities e USING (project_id)
        LEFT JOIN (SELECT w.project_id, {day} AS day, entity_id, count(*) AS n FROM cited_pairs JOIN win w USING (result_id) WHERE w.error IS NULL GROUP BY 1,2,3) c
        ON c.project_id=d.project_id AND c.day=d.day AND c.entity_id=e.entity_id"""
    q["share_of_voice_series"] = with_ctes(series)
    q["sov_daily_share"] = with_ctes(
        "SELECT project_id, day, entity_id, floor(cited/nullif(sum(cited) OVER (PARTITION BY project_id, day),0)*1000+0.5)/10 AS share FROM s",
        extra={"s": series},
    )
    ts_sql = f"SELECT project_id, {day} AS day, engine_id, count(*) AS total, count(*) FILTER (cited) AS cited, count(*) FILTER (mentioned) AS mentioned FROM b WHERE error IS NULL GROUP BY 1,2,3"
    q["time_series"] = with_ctes(ts_sql)
    cols = ", ".join(
        f"max(floor(cited/total*1000+0.5)/10) FILTER (engine_id='{e}') AS \"{e}\""
        for e in ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    )
    q["trend_pivot"] = with_ctes(f"SELECT project_id, day, {cols} FROM t GROUP BY 1,2", extra={"t": ts_sql})
    st = "CASE WHEN error IS NOT NULL THEN 'error' WHEN cited THEN 'cited' WHEN mentioned THEN 'mentioned' ELSE 'none' END"
    q["answer_status"] = with_ctes(f"SELECT project_id, engine_id, {st} AS status, count(*) AS answers FROM b GROUP BY 1,2,3")
    q["prompt_matrix"] = with_ctes(
        f"""SELECT p.project_id, p.position, p.prompt_id, l.engine_id, l.result_id, CASE WHEN l.result_id IS NOT NULL THEN {st} END AS status, r.c/nullif(r.t,0) AS citation_rate
        FROM pos p LEFT JOIN lb l USING (prompt_id) LEFT JOIN r USING (prompt_id)""",
        extra={
            "pos": "SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY active DESC, prompt_id DESC) AS position FROM prompts",
            "lb": "SELECT latest.*, coalesce(brand.cited,false) AS cited, coalesce(brand.mentioned,false) AS mentioned FROM latest LEFT JOIN brand USING (result_id)",
            "r": "SELECT prompt_id, count(*) AS t, count(*) FILTER (cited) AS c FROM b WHERE error IS NULL GROUP BY 1",
        },
    )
    q["prompt_history"] = with_ctes(
        f"""SELECT b.result_id, run_id, project_id, prompt_id, engine_id, strftime(created_at,'%Y-%m-%d %H:%M:%S') AS created_at, {st} AS status, cited, mentioned, error,
        coalesce(n,0) AS sources_count, latency_ms, cost_usd*0.92 AS cost_eur, coalesce(competitors,'') AS competitors
        FROM b LEFT JOIN rv USING (result_id) LEFT JOIN sz USING (result_id)""",
        extra={
            "sz": "SELECT result_id, count(*) AS n FROM sources GROUP BY 1",
            "rv": "SELECT result_id, string_agg(name, ',' ORDER BY name) AS competitors FROM flags WHERE cited AND entity_type='competitor' GROUP BY 1",
        },
    )
    q["prompt_competitors"] = with_ctes(
        """SELECT p.project_id, p.prompt_id, e.entity_id, e.name, coalesce(c.cited,0) AS cited, coalesce(c.mentioned,0) AS mentioned, coalesce(t.answers,0) AS answers
        FROM prompts p JOIN entities e ON e.project_id=p.project_id AND e.entity_type='competitor' LEFT JOIN c ON c.prompt_id=p.prompt_id AND c.entity_id=e.entity_id LEFT JOIN t ON t.prompt_id=p.prompt_id""",
        extra={
            "c": "SELECT w.prompt_id, f.entity_id, count(*) FILTER (f.cited) AS cited, count(*) FILTER (f.mentioned) AS mentioned FROM flags f JOIN win w USING (result_id) GROUP BY 1,2",
            "t": "SELECT prompt_id, count(*) AS answers FROM win WHERE error IS NULL GROUP BY 1",
        },
    )
    q["prompt_scorecard"] = with_ctes(
        """SELECT project_id, prompt_id, count(*) AS ok, count(*) FILTER (cited) AS cited, count(*) FILTER (mentioned) AS mentioned, max(coalesce(rivals,0)) AS rivals
        FROM b LEFT JOIN rv USING (prompt_id) WHERE error IS NULL GROUP BY 1,2""",
        extra={
            "rv": "SELECT w.prompt_id, count(DISTINCT f.entity_id) AS rivals FROM flags f JOIN win w USING (result_id) WHERE f.entity_type='competitor' AND (f.cited OR f.mentioned) GROUP BY 1"
        },
    )
    q["prompt_timeline"] = with_ctes(
        f"""SELECT prompt_id, engine_id, result_id, strftime(created_at,'%Y-%m-%d %H:%M:%S') AS created_at, {st} AS status, count(*) OVER w AS answers,
        count(*) FILTER (cited AND error IS NULL) OVER w AS cited_answers FROM b WINDOW w AS (PARTITION BY prompt_id, engine_id)"""
    )
    q["competitor_overlap"] = with_ctes(
        """SELECT r.project_id, r.entity_id, e.name, rank, prompt_id, p.text, answers FROM r JOIN prompts p USING (prompt_id) JOIN entities e ON e.project_id=r.project_id AND e.entity_id=r.entity_id WHERE rank<=8""",
        extra={
            "r": """SELECT *, row_number() OVER (PARTITION BY project_id, entity_id ORDER BY answers DESC, prompt_id) AS rank FROM
                (SELECT project_id, entity_id, prompt_id, count(DISTINCT result_id) AS answers FROM uncontested GROUP BY 1,2,3)"""
        },
    )
    q["prompts_without_brand"] = with_ctes(
        """SELECT a.project_id, a.prompt_id, p.text, array_to_string(p.tags,',') AS tags, a.answers, a.mentioned, coalesce(n,0) AS competitor_count, coalesce(names,'') AS competitors
        FROM a JOIN prompts p USING (prompt_id) LEFT JOIN rv USING (prompt_id)""",
        extra={
            "a": "SELECT project_id, prompt_id, count(*) AS answers, count(*) FILTER (mentioned) AS mentioned FROM b WHERE error IS NULL GROUP BY 1,2 HAVING count(*) FILTER (cited)=0",
            "rv": """SELECT prompt_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM
                (SELECT DISTINCT w.prompt_id, f.name FROM flags f JOIN win w USING (result_id) WHERE f.cited AND f.entity_type='competitor') GROUP BY 1""",
        },
    )
    q["project_stats"] = with_ctes(
        """SELECT e.project_id, e.entity_id, e.entity_type, e.name, count(*) FILTER (f.cited) AS cited, count(*) FILTER (f.mentioned) AS mentioned
        FROM entities e LEFT JOIN flags f ON f.entity_id=e.entity_id GROUP BY 1,2,3,4"""
    )


def sources_sql() -> None:
    q = SQL
    q["engine_domains"] = with_ctes(
        f"""SELECT t.project_id, t.engine_id, a.answers, t.rank, t.domain, t.count, {OWNED} FROM t JOIN a ON a.project_id=t.project_id AND a.engine_id=t.engine_id {OWNER_JOIN} WHERE rank<=8""",
        "entities",
        extra={
            "c": 'SELECT project_id, engine_id, domain, count(*) AS "count" FROM wsources GROUP BY 1,2,3',
            "t": 'SELECT *, row_number() OVER (PARTITION BY project_id, engine_id ORDER BY "count" DESC, domain) AS rank FROM c',
            "a": "SELECT project_id, engine_id, count(*) FILTER (error IS NULL) AS answers FROM win GROUP BY 1,2",
        },
    )
    q["top_domains"] = with_ctes(
        f"""SELECT t.project_id, t.rank, t.domain, t.count, coalesce(t.count/nullif(a.answers,0),0) AS share, {OWNED} FROM t JOIN a ON a.project_id=t.project_id {OWNER_JOIN} WHERE rank<=10""",
        "entities",
        extra={
            "c": 'SELECT project_id, domain, count(*) AS "count" FROM wsources GROUP BY 1,2',
            "t": 'SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY "count" DESC, domain) AS rank FROM c',
            "a": "SELECT project_id, count(*) FILTER (error IS NULL) AS answers FROM win GROUP BY 1",
        },
    )
    q["competitor_pages"] = with_ctes(
        'SELECT project_id, entity_id, name, rank, page, url, "count" FROM t WHERE rank<=8',
        extra={
            "c": """SELECT s.project_id, e.entity_id, e.name, s.page, min(s.url) AS url, count(*) AS "count" FROM wsources s
                JOIN entities e ON e.project_id=s.project_id AND e.entity_type='competitor' AND (s.domain=e.domain OR s.domain LIKE '%.'||e.domain) GROUP BY 1,2,3,4""",
            "t": 'SELECT *, row_number() OVER (PARTITION BY project_id, entity_id ORDER BY "count" DESC, page) AS rank FROM c',
        },
    )
    q["domains_instead"] = with_ctes(
        "SELECT project_id, rank, domain, answers, without_brand, answers>without_brand AS brand_present, engines, entity, entity_name FROM t WHERE rank<=30",
        extra={
            "c": """SELECT s.project_id, s.domain, count(DISTINCT s.result_id) AS answers, count(DISTINCT CASE WHEN NOT coalesce(b.cited,false) THEN s.result_id END) AS without_brand,
                string_agg(DISTINCT s.engine_id, ',' ORDER BY s.engine_id) AS engines FROM wsources s LEFT JOIN brand b USING (result_id) WHERE s.error IS NULL GROUP BY 1,2""",
            "t": """SELECT c.*, o.entity_type AS entity, o.name AS entity_name, row_number() OVER (PARTITION BY c.project_id ORDER BY without_brand DESC, answers DESC, c.domain) AS rank
                FROM c LEFT JOIN entities o ON o.project_id=c.project_id AND (c.domain=o.domain OR c.domain LIKE '%.'||o.domain)
                WHERE without_brand>0 AND coalesce(o.entity_type,'')<>'brand'""",
        },
    )
    brand_src = """SELECT s.* FROM wsources s JOIN entities e ON e.project_id=s.project_id AND e.entity_type='brand' AND (s.domain=e.domain OR s.domain LIKE '%.'||e.domain)"""
    q["brand_pages"] = with_ctes(
        'SELECT project_id, rank, page, url, "count", prompt_count, engines FROM t WHERE rank<=50',
        extra={
            "bs": brand_src,
            "c": """SELECT project_id, page, min(url) AS url, count(*) AS "count", count(DISTINCT prompt_id) AS prompt_count, string_agg(DISTINCT engine_id, ',' ORDER BY engine_id) AS engines FROM bs GROUP BY 1,2""",
            "t": 'SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY "count" DESC, page) AS rank FROM c',
        },
    )
    q["brand_page_citations"] = with_ctes(
        """SELECT project_id, page, result_id, prompt_id, engine_id, strftime(created_at,'%Y-%m-%d %H:%M:%S') AS created_at, min(rank) AS rank, arg_min(cited, rank) AS cited FROM bs GROUP BY 1,2,3,4,5,6""",
        extra={"bs": brand_src},
    )
    q["url_history"] = with_ctes(
        """SELECT s.project_id, s.page, s.result_id, s.prompt_id, s.engine_id, strftime(s.created_at,'%Y-%m-%d %H:%M:%S') AS created_at, s.rank
        FROM wsources s JOIN (SELECT DISTINCT project_id, page FROM inspections) i ON i.project_id=s.project_id AND i.page=s.page"""
    )
    q["source_owner"] = with_ctes(
        """SELECT s.project_id, coalesce(o.entity_type,'none') AS owner, coalesce(o.name,'') AS owner_name, count(*) AS sources
        FROM wsources s LEFT JOIN entities o ON o.project_id=s.project_id AND (s.domain=o.domain OR s.domain LIKE '%.'||o.domain) GROUP BY 1,2,3"""
    )
    q["track_domain_candidates"] = with_ctes(
        """SELECT t.project_id, t.domain, CASE WHEN o.entity_type='brand' THEN 'brand' WHEN o.entity_type='competitor' THEN 'tracked as '||o.name ELSE 'ok' END AS verdict,
        CASE WHEN length(split_part(t.domain,'.',2))<=3 THEN upper(left(split_part(t.domain,'.',1),1))||substr(split_part(t.domain,'.',1),2)
             ELSE upper(left(split_part(t.domain,'.',2),1))||substr(split_part(t.domain,'.',2),2) END AS suggested_name
        FROM (SELECT DISTINCT project_id, domain FROM wsources) t """ + OWNER_JOIN,
        "entities",
    )
    q["detections"] = with_ctes(
        f"""SELECT r.result_id, r.project_id, e.entity_type, e.entity_id, c.rank IS NOT NULL AS cited, c.rank AS citation_rank, s.rank IS NOT NULL AS retrieved, s.rank AS retrieved_rank,
        m.rank IS NOT NULL AS mentioned, m.rank AS mention_rank, CASE WHEN m.rank IS NOT NULL THEN e.name ELSE '' END AS matched_terms
        FROM results r JOIN entities e ON e.project_id=r.project_id
        LEFT JOIN (SELECT x.result_id, y.entity_id, min(rank) AS rank FROM cited_ranked x JOIN entities y ON (x.domain=y.domain OR x.domain LIKE '%.'||y.domain) GROUP BY 1,2) c ON c.result_id=r.result_id AND c.entity_id=e.entity_id
        LEFT JOIN (SELECT x.result_id, y.entity_id, min(rank) AS rank FROM sources x JOIN entities y ON (x.domain=y.domain OR x.domain LIKE '%.'||y.domain) GROUP BY 1,2) s ON s.result_id=r.result_id AND s.entity_id=e.entity_id
        LEFT JOIN (SELECT result_id, entity_id, row_number() OVER (PARTITION BY result_id ORDER BY pos) AS rank FROM mention_pairs) m ON m.result_id=r.result_id AND m.entity_id=e.entity_id
        WHERE r.error IS NULL"""
    )
    q["recompute_detections"] = (
        q["detections"].replace("FROM mention_pairs)", "FROM mention_pairs WHERE entity_id<>20)").replace("WHERE r.error IS NULL", "WHERE r.error IS NULL AND e.entity_id<>20")
    )
    q["overview_from_cube"], q["share_of_voice_from_cube"] = q["overview"], q["share_of_voice"]
    q["snapshot_copy"] = with_ctes(
        """SELECT p.project_id AS id, e.name AS brand_name, p.p%2+1 AS repeats, count(*) AS prompts, count(*) FILTER (r.active) AS active,
        min(r.text) AS first_text, CAST(sum(len(r.tags)) AS BIGINT) AS tags
        FROM projects p JOIN prompts r ON r.project_id=p.project_id JOIN entities e ON e.project_id=p.project_id AND e.entity_type='brand' GROUP BY ALL"""
    )
    q["domain_matches"] = with_ctes(
        """SELECT w.project_id, count(*) AS sources, count(*) FILTER (s.domain=e.domain OR s.domain LIKE '%.'||e.domain) AS own
        FROM win w JOIN sources s USING (result_id) JOIN entities e ON e.project_id=w.project_id AND e.entity_type='brand' GROUP BY 1"""
    )


answers_sql()
sources_sql()
