"""SQL twins: runs, ingest, inspections."""

from __future__ import annotations

from sightline.plans.oracle import AS_OF, SQL, big, with_ctes

RUNS = f"""SELECT run_id, project_id, min(created_at) AS started_at,
    CASE WHEN max(created_at)<date_trunc('month',{AS_OF}) THEN max(created_at) END AS finished_at,
    CASE WHEN max(created_at)>=date_trunc('month',{AS_OF}) THEN 'running' ELSE 'done' END AS status,
    count(*) AS planned_count, count(*) AS done_count, count(*) FILTER (error IS NOT NULL) AS error_count, CAST(sum(cost_dec) AS DOUBLE) AS cost_usd
    FROM results GROUP BY 1,2"""
FMT = "'%Y-%m-%d %H:%M:%S'"
PRICES = """SELECT * FROM (VALUES ('1-URGENT',0.75,4.5,0.01),('2-HIGH',1.0,5.0,0.01),('3-MEDIUM',1.0,1.0,0.008),('4-NOT SPECIFIED',0.75,3.75,0.014),('5-LOW',2.0,12.0,0.02)) t(engine_id,pi,po,ps)"""
PRICE_CAST = "CAST(pi AS DOUBLE) AS pi, CAST(po AS DOUBLE) AS po, CAST(ps AS DOUBLE) AS ps"
AVG_COST = {
    "prices": f"SELECT engine_id, {PRICE_CAST} FROM ({PRICES})",
    "measured": "SELECT engine_id, CAST(sum(cost_dec) AS DOUBLE)/count(*) AS a FROM results WHERE error IS NULL AND web_search GROUP BY 1",
    "avg_cost": """SELECT engine_id, coalesce(a, 8000/1e6*pi+400/1e6*po+ps) AS avg_cost_usd, 8000/1e6*pi+400/1e6*po+ps AS estimated_cost_usd
        FROM engines JOIN prices USING (engine_id) LEFT JOIN measured USING (engine_id)""",
}
PLAN = """SELECT p.project_id, p.prompt_id, e.engine_id, CAST(left(e.engine_id,1) AS INTEGER) AS engine_ordinal, r.i AS repeat_index,
    row_number() OVER (PARTITION BY p.project_id, e.engine_id ORDER BY p.prompt_id, r.i) AS turn
    FROM prompts p JOIN projects j USING (project_id) CROSS JOIN engines e JOIN (VALUES (0),(1)) r(i) ON r.i<j.p%2+1
    WHERE p.active AND e.enabled AND (p.web_search OR e.engine_id<>'3-MEDIUM')"""
TARGETS = """SELECT a.*, i.page AS target, j.p FROM ianswers a JOIN inspections i USING (inspection_id) JOIN projects j ON j.project_id=a.project_id"""
FLAGS = {
    "tg": TARGETS,
    "cr": """SELECT s.*, row_number() OVER (PARTITION BY s.result_id ORDER BY s.rank) AS crank FROM sources s WHERE cited""",
    "cx": """SELECT t.result_id, min(crank) FILTER (c.page=t.target) AS url_rank, min(crank) FILTER (c.domain LIKE '%.n'||t.p||'.example') AS domain_rank FROM tg t JOIN cr c USING (result_id) GROUP BY 1""",
    "sx": """SELECT t.result_id, bool_or(s.page=t.target) AS url_retrieved, bool_or(s.domain LIKE '%.n'||t.p||'.example') AS domain_retrieved FROM tg t JOIN sources s USING (result_id) GROUP BY 1""",
    "fl": """SELECT t.inspection_id, t.project_id, t.question_index, t.engine_id, t.result_id, t.error, url_rank IS NOT NULL AS url_cited, url_rank,
        domain_rank IS NOT NULL AS domain_cited, domain_rank, coalesce(url_retrieved,false) AS url_retrieved, coalesce(domain_retrieved,false) AS domain_retrieved
        FROM tg t LEFT JOIN cx USING (result_id) LEFT JOIN sx USING (result_id)""",
}
KINDS = {
    **FLAGS,
    "rivals": """SELECT DISTINCT s.result_id FROM sources s JOIN fl USING (result_id) JOIN entities e ON e.project_id=fl.project_id AND e.entity_type='competitor' AND s.domain LIKE '%.'||e.domain""",
    "kd": """SELECT fl.*, CASE WHEN error IS NOT NULL THEN 'error' WHEN url_cited THEN 'url' WHEN domain_cited THEN 'domain' WHEN r.result_id IS NOT NULL THEN 'competitor' ELSE 'none' END AS kind
        FROM fl LEFT JOIN rivals r USING (result_id)""",
}
SCORED = {
    **FLAGS,
    "sc": """SELECT f.*, url_retrieved OR domain_retrieved AS seen, m.result_id IS NOT NULL AS mentioned,
        CASE WHEN url_cited THEN 1.0 WHEN domain_cited THEN 0.6 WHEN url_retrieved OR domain_retrieved THEN 0.4 WHEN m.result_id IS NOT NULL THEN 0.3 ELSE 0.0 END AS v
        FROM fl f LEFT JOIN (SELECT result_id FROM mention_pairs WHERE entity_type='brand') m USING (result_id) WHERE error IS NULL""",
    "pe": """SELECT inspection_id, engine_id, count(*) AS answers, CAST(sum(CAST(v AS DECIMAL(4,1))) AS DOUBLE)/count(*) AS "value",
        count(*) FILTER (url_cited) AS cited, count(*) FILTER (NOT url_cited AND domain_cited) AS domain_cited,
        count(*) FILTER (NOT url_cited AND NOT domain_cited AND seen) AS retrieved,
        count(*) FILTER (NOT url_cited AND NOT domain_cited AND NOT seen AND mentioned) AS mentioned FROM sc GROUP BY 1,2""",
}
GRID = "SELECT inspection_id, question_index, q.project_id, engine_id FROM questions q CROSS JOIN engines"

NORM_PAGE_URL = """(
    regexp_replace(regexp_extract(url,'^https?://(?:www\\.)?([^/?#]+)',1),'^www\\.','') ||
    regexp_replace(regexp_extract(url,'^https?://[^/?#]+([^?#]*)',1),'/+$','') ||
    coalesce((SELECT CASE WHEN count(*)=0 THEN '' ELSE '?'||string_agg(x, '&' ORDER BY x) END FROM (
        SELECT unnest(string_split(regexp_extract(url,'\\?([^#]*)',1),'&')) AS x) WHERE x<>'' AND NOT regexp_matches(x,'^(utm_[^=]*|ref|fbclid|gclid)(=|$)')),''))"""


def runs_sql() -> None:
    q = SQL
    q["run_counters"] = with_ctes("SELECT run_id, project_id, status, planned_count, done_count, error_count, cost_usd FROM rn", extra={"rn": RUNS})
    q["runs_recent"] = with_ctes(
        f"SELECT run_id, project_id, strftime(started_at,{FMT}) AS started_at, strftime(finished_at,{FMT}) AS finished_at, status, planned_count, done_count, error_count, cost_usd, rank FROM t WHERE rank<=50",
        extra={"rn": RUNS, "t": "SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, run_id) AS rank FROM rn"},
    )
    q["run_duration"] = with_ctes(
        f"SELECT run_id, CAST(epoch_ms(coalesce(finished_at,{AS_OF}))-epoch_ms(started_at) AS BIGINT) AS duration_ms FROM rn", extra={"rn": RUNS}
    )
    q["run_detail"] = with_ctes(
        f"""SELECT r.run_id, r.result_id, r.prompt_id, p.text, r.engine_id, r.repeat_index, strftime(r.created_at,{FMT}) AS created_at, r.error, r.latency_ms, r.cost_usd,
        coalesce(b.cited,false) AS cited, coalesce(b.mentioned,false) AS mentioned FROM results r JOIN prompts p USING (prompt_id) LEFT JOIN brand b USING (result_id)"""
    )
    q["plan_tasks"] = with_ctes(PLAN)
    q["remaining_tasks"] = with_ctes(
        """SELECT l.run_id, t.project_id, t.prompt_id, t.engine_id, t.repeat_index FROM pl t JOIN lr l USING (project_id)
        WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.run_id=l.run_id AND r.prompt_id=t.prompt_id AND r.engine_id=t.engine_id AND r.repeat_index=t.repeat_index)""",
        extra={"pl": PLAN, "lr": "SELECT project_id, max(run_id) AS run_id FROM results GROUP BY 1"},
    )
    q["retry_set"] = with_ctes("SELECT run_id, prompt_id, engine_id, repeat_index, result_id FROM results WHERE error IS NOT NULL")
    q["run_outcome"] = with_ctes(
        """SELECT t.run_id, CASE WHEN stop_batch IS NOT NULL OR errors=tasks THEN 'failed' ELSE 'done' END AS status,
        CASE WHEN stop_batch IS NOT NULL THEN least(stop_batch*3,tasks) ELSE tasks END AS done, stop_batch FROM tot t LEFT JOIN st USING (run_id)""",
        extra={
            "tk": "SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY created_at, result_id)+2)//3 AS batch FROM results",
            "tot": "SELECT run_id, project_id, count(*) AS tasks, count(*) FILTER (error IS NOT NULL) AS errors FROM tk GROUP BY 1,2",
            "bt": "SELECT run_id, project_id, batch, sum(cost_dec) AS c FROM tk GROUP BY 1,2,3",
            "cu": "SELECT *, sum(c) OVER (PARTITION BY run_id ORDER BY batch) AS cum FROM bt",
            "st": f"SELECT run_id, {big('min(batch)')} AS stop_batch FROM cu JOIN projects USING (project_id) WHERE cum>CAST((p*0.05+0.5)/0.92 AS DECIMAL(20,9)) GROUP BY 1",
        },
    )
    q["engine_avg_cost"] = with_ctes("SELECT * FROM avg_cost", "engines", "results", extra=AVG_COST)
    q["answer_cost"] = with_ctes(
        """SELECT result_id, engine_id, round((latency_ms*3)/1e6*pi + latency_ms/1e6*po + (result_id%4)*ps, 9) AS cost_usd FROM win JOIN prices USING (engine_id)""",
        extra={"prices": AVG_COST["prices"]},
    )
    q["inspection_cost_estimate"] = with_ctes(
        "SELECT inspection_id, questions, unit*questions*0.92 AS cost_eur FROM iq, un", "engines", "results",
        extra={
            **AVG_COST,
            "un": "SELECT CAST(sum(CAST(avg_cost_usd AS DECIMAL(20,9))) AS DOUBLE) AS unit FROM avg_cost JOIN engines USING (engine_id) WHERE enabled",
            "iq": "SELECT inspection_id, count(*) AS questions FROM questions WHERE length(trim(text))>=10 GROUP BY 1",
        },
    )
    q["inspection_answer_flags"] = with_ctes("SELECT * FROM fl", extra=FLAGS)
    q["inspection_cells"] = with_ctes(
        "SELECT g.inspection_id, g.question_index, g.engine_id, coalesce(k.kind,'pending') AS kind FROM gr g LEFT JOIN kd k ON k.inspection_id=g.inspection_id AND k.question_index=g.question_index AND k.engine_id=g.engine_id",
        extra={**KINDS, "gr": GRID},
    )
    q["inspection_verdict"] = with_ctes(
        """SELECT inspection_id, count(*) FILTER (kind<>'error') AS ok, count(*) FILTER (kind='url') AS url_cited, count(*) FILTER (kind='domain') AS domain_only,
        count(*) FILTER (kind='competitor') AS competitor_only, count(*) FILTER (kind='error') AS errors FROM kd GROUP BY 1""",
        extra=KINDS,
    )
    q["inspection_summaries"] = with_ctes(
        f"""SELECT i.inspection_id, i.project_id, i.url, strftime(i.created_at,{FMT}) AS created_at, i.status, count(*) FILTER (f.inspection_id IS NOT NULL AND f.error IS NULL) AS ok,
        count(*) FILTER (f.url_cited) AS url_cited, count(*) FILTER (f.domain_cited AND NOT f.url_cited) AS domain_cited FROM inspections i LEFT JOIN fl f USING (inspection_id) GROUP BY 1,2,3,4,5""",
        extra=FLAGS,
    )
    q["inspection_task_grid"] = with_ctes("SELECT inspection_id, project_id, count(*) AS planned FROM gr GROUP BY 1,2", extra={"gr": GRID})
    q["cited_instead"] = with_ctes(
        """SELECT t.inspection_id, t.rank, t.domain, t."count", o.entity_type AS owner_type, o.name AS owner_name FROM t
        LEFT JOIN entities o ON o.project_id=t.project_id AND t.domain LIKE '%.'||o.domain WHERE rank<=8""",
        extra={
            **FLAGS,
            "c": 'SELECT inspection_id, project_id, domain, count(DISTINCT result_id) AS "count" FROM fl JOIN sources USING (result_id) WHERE error IS NULL AND NOT url_cited GROUP BY 1,2,3',
            "t": 'SELECT *, row_number() OVER (PARTITION BY inspection_id ORDER BY "count" DESC, domain) AS rank FROM c',
        },
    )
    q["comparison_candidates"] = with_ctes(
        "SELECT inspection_id, rank, page, url, questions, engines FROM t WHERE rank<=15",
        extra={
            **FLAGS,
            "x": """SELECT f.inspection_id, f.question_index, f.engine_id, s.page, s.url, row_number() OVER (PARTITION BY s.result_id ORDER BY s.rank) AS r
                FROM fl f JOIN tg t USING (result_id) JOIN sources s USING (result_id)
                WHERE f.error IS NULL AND NOT f.url_cited AND s.cited AND s.domain NOT LIKE '%.n'||t.p||'.example' AND s.page<>t.target""",
            "c": "SELECT inspection_id, page, min(url) AS url, count(DISTINCT question_index) AS questions, string_agg(DISTINCT engine_id, ',' ORDER BY engine_id) AS engines FROM x WHERE r<=3 GROUP BY 1,2",
            "t": "SELECT *, row_number() OVER (PARTITION BY inspection_id ORDER BY questions DESC, page) AS rank FROM c",
        },
    )
    q["inspections_cost_since"] = with_ctes(
        "SELECT project_id, CAST(sum(CAST(cost_usd AS DECIMAL(20,9))) AS DOUBLE) AS cost_usd FROM inspections WHERE created_at>=TIMESTAMP '2001-07-20' GROUP BY 1"
    )
    q["inspection_quota"] = with_ctes(
        """SELECT j.project_id, j.p%3+1 AS inspections_per_day, count(*) FILTER (status='running') AS running, count(*) FILTER (created_at>=TIMESTAMP '2001-08-01') AS today,
        count(*) FILTER (status='running')=0 AND count(*) FILTER (created_at>=TIMESTAMP '2001-08-01')<j.p%3+1 AS allowed FROM projects j LEFT JOIN inspections USING (project_id) GROUP BY j.project_id, j.p"""
    )
    q["result_per_engine"] = with_ctes("SELECT * FROM pe", extra=SCORED)
    q["result_score"] = with_ctes(
        """SELECT inspection_id, count(*) AS engines, CAST(sum(answers) AS BIGINT) AS answers, CAST(floor(CAST(sum(CAST("value" AS DECIMAL(20,9))) AS DOUBLE)/count(*)*40+0.5) AS BIGINT) AS result,
        CASE WHEN sum(answers)<5 THEN 'low' WHEN sum(answers)<10 THEN 'medium' ELSE 'high' END AS confidence FROM pe GROUP BY 1""",
        extra=SCORED,
    )


def ingest_sql() -> None:
    q = SQL
    q["list_projects"] = with_ctes(
        "SELECT e.project_id, e.name AS brand_name, e.domain AS domains, e.p%2+1 AS repeats, e.p*0.05+0.5 AS cost_cap_eur, e.p%3+1 AS inspections_per_day FROM entities e WHERE entity_type='brand'"
    )
    q["list_prompts"] = with_ctes(
        f"""SELECT prompt_id, project_id, text, array_to_string(tags,',') AS tags, active, web_search,
        strftime(TIMESTAMP '1995-01-01'+to_minutes(CAST(prompt_id AS INTEGER)),{FMT}) AS created_at FROM prompts"""
    )
    q["prompt_search"] = with_ctes("SELECT project_id, prompt_id, text FROM prompts WHERE contains(lower(text),'9') AND list_contains(tags,'EUROPE') AND active")
    q["tag_vocabulary"] = with_ctes("SELECT DISTINCT project_id, unnest(tags) AS tag FROM prompts")
    q["entity_dictionary"] = with_ctes("SELECT project_id, entity_id, entity_type, CASE entity_type WHEN 'brand' THEN 0 ELSE entity_id+1 END AS ordinal, name, name AS terms, domain AS domains FROM entities")
    def relation(name: str, child: str, key: str, parent: str) -> str:
        return f"SELECT '{name}' AS relation, count(*) AS rows, count(*) FILTER ({key} NOT IN (SELECT {key} FROM {parent})) AS orphans FROM {child}"

    q["orphan_checks"] = with_ctes(
        " UNION ALL ".join(
            [
                relation("sources.result_id", "(SELECT l_orderkey AS result_id FROM lineitem)", "result_id", "results"),
                relation("results.prompt_id", "(SELECT o_custkey AS prompt_id FROM orders)", "prompt_id", "prompts"),
                relation("results.engine_id", "(SELECT o_orderpriority AS engine_id FROM orders)", "engine_id", "engines"),
                relation("results.run_id", "results", "run_id", "rn"),
                relation("runs.project_id", "rn", "project_id", "projects"),
                relation("prompts.project_id", "prompts", "project_id", "projects"),
                relation("competitors.project_id", "entities", "project_id", "projects"),
                relation("detections.result_id", "flags", "result_id", "results"),
                relation("inspection_answers.inspection_id", "ianswers", "inspection_id", "inspections"),
                relation("documents.labels", "labels", "doc_id", "documents"),
            ]
        ),
        extra={"rn": RUNS},
    )
    q["import_prompts_csv"] = with_ctes(
        "SELECT text, CASE WHEN prompt_id%2=0 THEN 'en' ELSE 'fr' END AS lang, array_to_string(tags,',') AS tags, prompt_id%3<>0 AS web_search FROM prompts"
    )
    q["ingest_results"] = with_ctes(
        f"""SELECT run_id, prompt_id, engine_id, repeat_index, strftime(created_at,{FMT}) AS created_at, result_id FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id, prompt_id, engine_id, repeat_index ORDER BY created_at, result_id) AS rn FROM results WHERE created_at>=TIMESTAMP '2001-01-10') n
        WHERE rn=1 AND NOT EXISTS (SELECT 1 FROM results r WHERE r.created_at<TIMESTAMP '2001-02-01' AND r.run_id=n.run_id AND r.prompt_id=n.prompt_id AND r.engine_id=n.engine_id AND r.repeat_index=n.repeat_index)"""
    )
    q["upsert_page_cache"] = f"""SELECT normalized_url, url, page_id, fetched_at FROM (
        SELECT *, row_number() OVER (PARTITION BY normalized_url ORDER BY fetched_at DESC, page_id DESC) AS rn FROM (
            SELECT {NORM_PAGE_URL} AS normalized_url, url, page_id, page_id*7919%1000003 AS fetched_at FROM pages)) WHERE rn=1"""
    q["promote_questions"] = """SELECT c.text, 'inspection,'||left(coalesce(nullif(list_last(list_filter(string_split(regexp_extract(p.url,'^[^?#]*'),'/'), lambda x: x<>'')),''),'page'),40) AS tags
        FROM conversations c LEFT JOIN pages p ON p.page_id=c.conv_id WHERE role='user'
        AND lower(trim(c.text)) NOT IN (SELECT lower(trim(text)) FROM conversations WHERE role='user' AND turn=0)"""
    q["latest_within_ttl"] = """SELECT user_id, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS ts, arg_max(event_id,ts) AS event_id, arg_max(event_type,ts) AS event_type
        FROM events WHERE ts<=TIMESTAMP '2024-01-20' AND ts>=TIMESTAMP '2024-01-20'-INTERVAL 7 DAY GROUP BY 1"""
    q["asof_within_ttl"] = """SELECT e.user_id, strftime(e.ts,'%Y-%m-%d %H:%M:%S') AS ts, e.event_id,
        CASE WHEN e.ts-v.ts<=INTERVAL 60 MINUTE THEN strftime(v.ts,'%Y-%m-%d %H:%M:%S') END AS found_at, CASE WHEN e.ts-v.ts<=INTERVAL 60 MINUTE THEN v.event_id END AS found
        FROM (SELECT * FROM events WHERE event_type='error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type='view') v ON e.user_id=v.user_id AND e.ts>=v.ts"""
    u = "'https://www.s'||(result_id%90)||'.example/p/'"
    q["normalize_engine_responses"] = with_ctes(
        f"""SELECT result_id, CASE engine_id WHEN '4-NOT SPECIFIED' THEN {u}||'2+,'||{u}||'1-,'||{u}||'3-' WHEN '3-MEDIUM' THEN {u}||'1+'
        WHEN '2-HIGH' THEN {u}||'1+,'||{u}||'4-' ELSE {u}||'1+,'||{u}||'5-' END AS sources,
        CASE engine_id WHEN '4-NOT SPECIFIED' THEN 'q'||result_id WHEN '3-MEDIUM' THEN '' WHEN '2-HIGH' THEN 'q'||result_id ELSE 'q'||result_id||',r'||result_id END AS search_queries,
        CASE engine_id WHEN '3-MEDIUM' THEN result_id%3 ELSE 1 END AS searches FROM win"""
    )
    redirect = "'https://vertexaisearch.cloud.google.com/grounding-api-redirect/'||l_suppkey||'-'||(l_partkey%50)"
    dom = "'s'||l_suppkey||'.n'||(l_suppkey%25)||'.example'"
    q["resolve_redirects"] = with_ctes(
        f"""SELECT DISTINCT result_id, CASE WHEN (l_partkey%50)%2=1 THEN CASE WHEN l_suppkey%3<>0 THEN 'https://'||{dom}||'/r/'||(l_partkey%50) ELSE {redirect} END
        WHEN l_linenumber%2=1 THEN 'https://www.'||{dom}||'/p/'||(l_partkey%50)||'/?utm_source=x' ELSE 'http://'||{dom}||'/p/'||(l_partkey%50) END AS url, {dom} AS domain
        FROM lineitem JOIN win ON l_orderkey=result_id"""
    )
    q["neutrality_violations"] = with_ctes(
        """SELECT w.result_id AS question_id, w.project_id, f.term FROM win w JOIN texts USING (result_id) LEFT JOIN (
        SELECT result_id, arg_min(name, CASE entity_type WHEN 'brand' THEN -1 ELSE m.entity_id END) AS term FROM mention_pairs m JOIN entities e USING (entity_id, entity_type) GROUP BY 1) f USING (result_id)"""
    )
    q["valid_questions"] = """SELECT conv_id AS group_id, count(*) AS questions, count(*) FILTER (length(trim(text))>=10) AS valid,
        count(*) FILTER (length(trim(text))>=10) BETWEEN 1 AND 5 AS accepted FROM conversations WHERE role='user' GROUP BY 1"""
    q["mention_spans"] = with_ctes(
        """SELECT w.result_id, m.pos-1 AS start_at, m.pos-1+length(e.name) AS end_at, e.name AS term FROM mention_pairs m JOIN win w USING (result_id) JOIN entities e USING (entity_id, entity_type)"""
    )



def detail_sql() -> None:
    q = SQL
    verdicts = """SELECT f.result_id, f.entity_type, f.entity_id, f.cited, f.mentioned, x.rank AS citation_rank, y.rank AS mention_rank FROM flags f
        LEFT JOIN (SELECT r.result_id, e.entity_id, e.entity_type, min(c.rank) AS rank FROM cited_ranked c JOIN results r USING (result_id)
            JOIN entities e ON e.project_id=r.project_id AND (c.domain=e.domain OR c.domain LIKE '%.'||e.domain) GROUP BY 1,2,3) x USING (result_id, entity_id, entity_type)
        LEFT JOIN (SELECT result_id, entity_id, entity_type, row_number() OVER (PARTITION BY result_id ORDER BY pos, CASE entity_type WHEN 'brand' THEN -1 ELSE entity_id END) AS rank
            FROM mention_pairs) y USING (result_id, entity_id, entity_type)"""
    q["result_detail"] = with_ctes(
        """SELECT w.result_id, p.text AS prompt, g.provider, rn.status AS run_status, coalesce(d.detections,'') AS detections, en.entities
        FROM win w JOIN prompts p USING (prompt_id) JOIN pr g ON g.engine_id=w.engine_id JOIN rn ON rn.run_id=w.run_id
        LEFT JOIN dl d ON d.result_id=w.result_id JOIN en ON en.project_id=w.project_id""",
        extra={
            "rn": RUNS,
            "pr": "SELECT * FROM (VALUES ('1-URGENT','openai'),('2-HIGH','anthropic'),('3-MEDIUM','perplexity'),('4-NOT SPECIFIED','google'),('5-LOW','openai')) t(engine_id,provider)",
            "vd": verdicts,
            "dl": """SELECT result_id, string_agg(concat_ws(':', entity_type, entity_id, cited, citation_rank, mentioned, mention_rank), ',' ORDER BY entity_type, entity_id) AS detections FROM vd GROUP BY 1""",
            "en": """SELECT project_id, string_agg(entity_type||':'||name, ',' ORDER BY CASE entity_type WHEN 'brand' THEN -1 ELSE entity_id END) AS entities FROM entities GROUP BY 1""",
        },
    )
    q["stored_detections"] = SQL["detections"]
    q["nested_detail"] = with_ctes(
        """SELECT b.project_id, b.name AS brand_name, coalesce((SELECT string_agg(entity_id||':'||name, ',' ORDER BY entity_id) FROM entities c
        WHERE c.project_id=b.project_id AND c.entity_type='competitor'),'') AS competitors FROM entities b WHERE b.entity_type='brand'"""
    )
    q["inspection_detail"] = with_ctes(
        """SELECT i.inspection_id, i.url, i.status, coalesce(a.answers,'') AS answers FROM inspections i LEFT JOIN (
        SELECT inspection_id, string_agg(concat_ws(':', question_index, engine_id, result_id, url_cited), ',' ORDER BY question_index, engine_id) AS answers FROM fl GROUP BY 1) a USING (inspection_id)""",
        extra=FLAGS,
    )
    q["prompt_positions"] = with_ctes(
        f"""SELECT project_id, prompt_id, active, strftime(TIMESTAMP '1995-01-01'+to_minutes(CAST(prompt_id AS INTEGER)),{FMT}) AS created_at,
        row_number() OVER (PARTITION BY project_id ORDER BY active DESC, prompt_id DESC) AS position FROM prompts"""
    )
    q["list_engines"] = with_ctes(
        """SELECT j.project_id, e.engine_id, e.engine_id AS label, provider, model, enabled, row_number() OVER (PARTITION BY j.project_id ORDER BY e.engine_id) AS position
        FROM projects j CROSS JOIN engines e JOIN pr USING (engine_id)""",
        extra={
            "pr": """SELECT * FROM (VALUES ('1-URGENT','openai','gpt-5.4-mini'),('2-HIGH','anthropic','claude-haiku-4-5'),('3-MEDIUM','perplexity','sonar'),
                ('4-NOT SPECIFIED','google','gemini-3.8-flash'),('5-LOW','openai','unlisted-model')) t(engine_id,provider,model)"""
        },
    )
    q["list_inspections"] = with_ctes(
        f"""SELECT project_id, inspection_id, url, status, strftime(created_at,{FMT}) AS created_at, position FROM (
        SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, inspection_id) AS position FROM inspections) WHERE position<=50"""
    )
    bounds = lambda c: (
        f"({c}/n+3.8416/(2*n)-1.96*sqrt(({c}/n)*(1-{c}/n)/n+3.8416/(4*n*n)))/(1+3.8416/n)",
        f"({c}/n+3.8416/(2*n)+1.96*sqrt(({c}/n)*(1-{c}/n)/n+3.8416/(4*n*n)))/(1+3.8416/n)",
    )
    (cl, ch), (ml, mh) = bounds("c"), bounds("m")
    q["wilson_interval"] = with_ctes(
        f"""SELECT project_id, total, c/n AS citation_rate, {cl} AS citation_low, {ch} AS citation_high, m/n AS mention_rate, {ml} AS mention_low, {mh} AS mention_high FROM (
        SELECT project_id, count(*) AS total, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (cited) AS DOUBLE) AS c, CAST(count(*) FILTER (mentioned) AS DOUBLE) AS m
        FROM b WHERE error IS NULL GROUP BY 1)"""
    )
    q["mean_citation_rank"] = with_ctes(
        """SELECT e.project_id, e.entity_type, e.entity_id, e.name, count(x.result_id) AS cited, avg(x.rank) AS mean_rank FROM entities e LEFT JOIN (
        SELECT w.result_id, w.project_id, o.entity_id, o.entity_type, min(c.rank) AS rank FROM cited_ranked c JOIN win w USING (result_id)
        JOIN entities o ON o.project_id=w.project_id AND (c.domain=o.domain OR c.domain LIKE '%.'||o.domain) WHERE w.error IS NULL GROUP BY 1,2,3,4) x
        USING (project_id, entity_id, entity_type) GROUP BY 1,2,3,4"""
    )
    q["brand_rank_among_domains"] = with_ctes(
        """SELECT t.project_id, t.domain, t.answers, t.place FROM (SELECT *, rank() OVER (PARTITION BY project_id ORDER BY answers DESC) AS place FROM (
        SELECT project_id, domain, count(DISTINCT result_id) AS answers FROM wsources GROUP BY 1,2)) t
        JOIN entities e ON e.project_id=t.project_id AND e.entity_type='brand' AND (t.domain=e.domain OR t.domain LIKE '%.'||e.domain)"""
    )
    q["taken_by"] = with_ctes(
        """SELECT t.project_id, t.prompt_id, t.rank, t.domain, t.answers, o.entity_type AS owner_type, o.name AS owner_name FROM (
        SELECT *, row_number() OVER (PARTITION BY project_id, prompt_id ORDER BY answers DESC, domain) AS rank FROM (
            SELECT project_id, prompt_id, domain, count(DISTINCT result_id) AS answers FROM wsources s WHERE cited AND error IS NULL
            AND NOT EXISTS (SELECT 1 FROM cited_pairs c WHERE c.result_id=s.result_id AND c.entity_type='brand') GROUP BY 1,2,3)) t
        LEFT JOIN entities o ON o.project_id=t.project_id AND t.domain LIKE '%.'||o.domain WHERE rank<=3"""
    )
    q["competitor_duel"] = with_ctes(
        """SELECT e.project_id, e.entity_id, e.name, count(*) FILTER (w.bc AND c.result_id IS NOT NULL) AS "both", count(*) FILTER (NOT w.bc AND c.result_id IS NOT NULL) AS rival_only,
        count(*) FILTER (w.bc AND c.result_id IS NULL) AS brand_only, count(*) FILTER (NOT w.bc AND c.result_id IS NULL) AS neither
        FROM entities e JOIN wb w USING (project_id) LEFT JOIN cited_pairs c ON c.result_id=w.result_id AND c.entity_id=e.entity_id AND c.entity_type='competitor'
        WHERE e.entity_type='competitor' GROUP BY 1,2,3""",
        extra={"wb": "SELECT project_id, result_id, cited AS bc FROM b WHERE error IS NULL"},
    )


runs_sql()
ingest_sql()
detail_sql()
