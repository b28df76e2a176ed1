"""SQL twins of the built pages and of the analysis chain."""

from __future__ import annotations

from sightline.functions import constants as K
from sightline.plans.oracle import AS_OF, SQL, with_ctes
from sightline.plans.oracle_pages import quoted
from sightline.plans.oracle_runs import FLAGS, SCORED


def signals(pages: str) -> str:
    """Every signal of the built pages listed by a statement (column ``page``), told from k alone."""
    types = ",".join(
        f"CASE WHEN {test} THEN '{name}' END"
        for test, name in (("k%3=1", "Article"), ("k%7=0", "FAQPage"), ("k%4=1", "HowTo"), ("k%4=0", "ItemList"), ("k%4=2", "NewsArticle"), ("k%3=0", "Organization"))
    )
    words = "2+(k%9=0)::INT+q*13+e*10+(k%2)*2+(k//2)%2+(k%3=0)::INT*3+n*7+q+(k%3=1)::INT*2+(k%8=0)::INT+q*100"
    top = "CASE k%4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 6 ELSE 2 END"
    second = "CASE WHEN k%5=0 THEN 2 ELSE 0 END"
    return f"""SELECT *, greatest(ceil(word_count/4), least(word_count,120))::INT AS first_quarter_words, word_count<50 AS js_suspect,
        CASE WHEN k%4=3 THEN 'other' WHEN k%4=0 THEN 'listicle' WHEN k%4=1 THEN 'guide' ELSE 'news' END AS page_type,
        CASE WHEN k%4=3 THEN 0.3 ELSE floor(greatest(0.35,least(0.95,0.4+{top}*0.06+({top}-{second})*0.05))*100+0.5)/100 END AS type_confidence,
        CASE WHEN k%5=0 THEN {AS_OF} WHEN k%3=1 THEN CAST(date_modified AS TIMESTAMP) END AS effective,
        CASE WHEN k%3=1 THEN floor(epoch({AS_OF}-CAST(date_modified AS TIMESTAMP))/(30.4375*86400)*10+0.5)/10 ELSE 60.0 END AS age
        FROM (SELECT page, k, q, e, n, brand,
            'Item '||lpad(CAST(k AS VARCHAR),8,'0')||CASE WHEN k%5=0 THEN ' 2024' ELSE '' END||CASE WHEN k%2=0 THEN ' | '||brand ELSE '' END AS title,
            'Item page'||CASE WHEN k%9=0 THEN ' Paris' ELSE '' END AS h1,
            CASE WHEN k%2=1 THEN 'About item '||lpad(CAST(k AS VARCHAR),8,'0') ELSE '' END AS description,
            CASE WHEN k%3=2 THEN 'fr' ELSE 'en' END AS lang, ({words})::INT AS word_count,
            CASE WHEN k%4=3 THEN 'https://other.example/x' END AS canonical, k%4<>3 AS canonical_self, CASE WHEN k%6=0 THEN 'index, nosnippet' END AS robots_meta,
            array_to_string(list_filter([{types}], lambda x: x IS NOT NULL), ',') AS json_ld_types,
            CASE WHEN q+e>=2 THEN 'Plain text of the part, as it is.' ELSE '' END AS first_lead,
            CASE WHEN k%3=1 THEN '2001-0'||(k%6+1)||'-10' END AS date_modified, CASE WHEN k%3=1 THEN '2001-01-05' END AS date_published,
            CASE WHEN k%3=1 THEN 'Ann Lee' END AS author, CASE WHEN k%3=1 THEN 'Editor' END AS author_role,
            k%3=1 AS person_schema, k%3=0 AS organization_schema, CASE WHEN k%3=0 THEN 2 ELSE 0 END AS same_as, k%3=1 AS about_contact_links,
            array_to_string(['outer0.org','outer1.org','outer2.org'][1:q], ',') AS outbound_domains,
            2*n AS numbers_count, k%2 AS lists_count, (k//2)%2 AS tables_count, k%7=0 OR q>=3 AS has_faq, k%8=0 AS has_summary_block,
            (k%3=0)::INT AS quote_count, CASE WHEN k%5=0 THEN 2024 END AS title_year, k%9=0 AS place_mentioned,
            CASE WHEN k%6=0 THEN 'nosnippet' ELSE '' END AS snippet_directives, CASE WHEN k%3=0 OR k%2=0 THEN brand END AS brand_name,
            k%2=0 AS brand_consistent, k%5=0 AS contact_form
            FROM (SELECT page, k, k%4 AS q, k%3 AS e, k%6 AS n, n_name AS brand FROM (
                SELECT page, CAST(regexp_extract(page,'^s([0-9]+)',1) AS BIGINT)*50+CAST(regexp_extract(page,'/p/([0-9]+)$',1) AS BIGINT) AS k
                FROM (SELECT DISTINCT page FROM ({pages}))) JOIN nation ON n_nationkey=(k//50)%25))"""


POINTS = {
    "fit": ("CASE WHEN page_type IN ({fit}) THEN 7 ELSE 4 END", 10),
    "directAnswer": ("0", 8),
    "headings": ("CASE WHEN q+e>=3 THEN 2 ELSE 0 END", 2),
    "listsTables": ("CASE WHEN lists_count+tables_count>=1 THEN 2 ELSE 0 END", 2),
    "faqSummary": ("CASE WHEN has_faq OR has_summary_block THEN 2 ELSE 0 END", 2),
    "numbers": ("CASE WHEN numbers_count>=5 THEN 3 ELSE 0 END", 3),
    "sources": ("CASE WHEN q>=2 THEN 2 ELSE 0 END", 2),
    "quotes": ("CASE WHEN quote_count>=1 THEN 1 ELSE 0 END", 1),
    "specificity": ("0", 2),
    "freshness": (
        f"CASE WHEN effective IS NULL THEN 0 WHEN epoch({AS_OF}-effective)/(30.4375*86400)<=6 THEN 4 WHEN epoch({AS_OF}-effective)/(30.4375*86400)<=12 THEN 3 ELSE 1 END",
        4,
    ),
    "author": ("CASE WHEN k%3<2 THEN 2 ELSE 0 END", 2),
    "profiles": ("CASE WHEN k%3<2 THEN 1 ELSE 0 END", 1),
    "brand": ("CASE WHEN brand_consistent THEN 1 ELSE 0 END", 1),
}
METRICS = {
    "wordCount": "word_count", "numbersCount": "numbers_count", "h2Entities": "e", "h2Questions": "q", "listsCount": "lists_count",
    "tablesCount": "tables_count", "hasFaq": "has_faq::INT", "hasSummaryBlock": "has_summary_block::INT", "outboundDomains": "q",
    "quoteCount": "quote_count", "ageMonths": "age", "author": "person_schema::INT", "organizationSchema": "organization_schema::INT", "sameAs": "same_as",
}

FLAGS_OF_PAGES = {
    "description": "description<>''", "canonical_self": "canonical_self", "snippet_directive": "snippet_directives<>''", "structured_data": "json_ld_types<>''",
    "person_schema": "person_schema", "organization_schema": "organization_schema", "same_as": "same_as>0", "author": "author IS NOT NULL",
    "dated": "date_modified IS NOT NULL", "title_year": "title_year IS NOT NULL", "question_headings": "q>0", "entity_headings": "e>0", "lists": "lists_count>0",
    "tables": "tables_count>0", "numbers": "numbers_count>=5", "quotes": "quote_count>0", "faq": "has_faq", "summary_block": "has_summary_block",
    "outbound_links": "q>0", "about_contact_links": "about_contact_links", "brand_consistent": "brand_consistent", "contact_form": "contact_form",
    "long_text": "word_count>=300", "script_rendered": "js_suspect",
}


def chain() -> dict[str, str]:
    """Blocks of the chain: candidates, signals of targets and candidates, grid rows, totals."""
    fit = ",".join(quoted(t) for t in K.COMPATIBLE_TYPES["informational"])
    rows = " UNION ALL ".join(
        f"SELECT page, page_type, word_count, '{key}' AS key, {points.format(fit=fit)} AS points, {most} AS max FROM sg" for key, (points, most) in POINTS.items()
    )
    metrics = " UNION ALL ".join(f"SELECT page, page_type, '{key}' AS key, CAST({value} AS DOUBLE) AS v FROM sg" for key, value in METRICS.items())
    return {
        **FLAGS,
        "cx1": """SELECT f.inspection_id, f.question_index, s.page, row_number() OVER (PARTITION BY s.result_id ORDER BY s.rank) AS r
            FROM fl f JOIN tg t USING (result_id) JOIN sources s USING (result_id)
            WHERE f.error IS NULL AND NOT f.url_cited AND s.cited AND s.domain NOT LIKE '%.n'||t.p||'.example' AND s.page<>t.target""",
        "cx2": "SELECT inspection_id, page, count(DISTINCT question_index) AS questions FROM cx1 WHERE r<=3 GROUP BY 1,2",
        "cand": "SELECT inspection_id, page FROM (SELECT *, row_number() OVER (PARTITION BY inspection_id ORDER BY questions DESC, page) AS rank FROM cx2) WHERE rank<=15",
        "sg": signals("SELECT page FROM cand UNION SELECT page FROM inspections"),
        "gr": rows,
        "ct": "SELECT page, page_type, CASE WHEN word_count<100 AND sum(points)>15 THEN 15 ELSE sum(points) END AS total FROM gr GROUP BY page, page_type, word_count",
        "me": metrics,
        "pool": """SELECT c.inspection_id, o.page, o.page_type, t.page_type AS own FROM cand c JOIN sg o ON o.page=c.page JOIN inspections i ON i.inspection_id=c.inspection_id JOIN sg t ON t.page=i.page""",
        "used": """SELECT *, count(*) FILTER (page_type=own) OVER (PARTITION BY inspection_id)>0 AS same_type_only FROM pool
            QUALIFY page_type=own OR NOT same_type_only""",
    }


def analysis_sql() -> None:
    q = SQL
    q["built_page_signals"] = with_ctes(
        f"""SELECT page, title, h1, description, lang, word_count, canonical, canonical_self, robots_meta, json_ld_types, js_suspect, q+e AS h2, 0 AS h3, q+e AS headings, q+e AS sections,
        first_lead, date_modified, date_published, author, author_role, person_schema, organization_schema, same_as, about_contact_links, q AS outbound_links, outbound_domains,
        numbers_count, lists_count, tables_count, has_faq, has_summary_block, q AS h2_questions, e AS h2_entities, quote_count, title_year, place_mentioned, lang='en' AS lang_matches,
        snippet_directives, brand_name, brand_consistent, contact_form, first_quarter_words, page_type, type_confidence FROM ({signals("SELECT page FROM wsources")})"""
    )
    held = " UNION ALL ".join(f"SELECT page, '{name}' AS signal, {test} AS has_signal FROM sg" for name, test in FLAGS_OF_PAGES.items())
    q["signal_calibration"] = with_ctes(
        "SELECT engine_id, signal, has_signal, count(*) AS n, avg(CAST(cited AS INTEGER)) AS cited_share FROM pc JOIN held USING (page) GROUP BY 1,2,3",
        extra={
            "pc": "SELECT engine_id, page, bool_or(cited) AS cited FROM wsources GROUP BY 1,2",
            "sg": signals("SELECT page FROM wsources"),
            "held": held,
        },
    )
    q["inspection_content_scores"] = with_ctes(
        """SELECT q.inspection_id, q.question_index, g.page_type, CAST(c.total AS INTEGER) AS total, g.key, g.points, g.max
        FROM questions q JOIN inspections i USING (inspection_id) JOIN gr g ON g.page=i.page JOIN ct c ON c.page=i.page""",
        extra=chain(),
    )
    label = lambda x, most: f"CASE WHEN {x}/{most}<0.4 THEN 'faible' WHEN {x}/{most}<0.7 THEN 'moyen' ELSE 'bon' END"
    texts = ",".join(f"({quoted(key)},{quoted(title)},{quoted(K.READING_TEXTS[key])})" for key, title in K.READINGS.items())
    q["citability_index"] = with_ctes(
        f"""SELECT inspection_id, page, questions, access, content, picked_question, result, confidence, "index", r.reading, v.title AS reading_title, v.text AS reading_text FROM (
        SELECT *, greatest(0,least(100,access+content+result)) AS "index", CASE WHEN {label("access", 20)}='faible' THEN 'access-low'
            WHEN {label("result", 40)}='faible' AND {label("content", 40)}='bon' THEN 'search' WHEN {label("result", 40)}='faible' THEN 'content'
            WHEN {label("result", 40)}='bon' AND {label("content", 40)}='faible' THEN 'brand' ELSE 'neutral' END AS reading
        FROM (SELECT i.inspection_id, i.page, n.questions, n.picked AS picked_question, CAST(c.total AS INTEGER) AS content, a.access, coalesce(rs.result,0) AS result, coalesce(rs.confidence,'low') AS confidence
            FROM inspections i JOIN qn n USING (inspection_id) JOIN ct c ON c.page=i.page JOIN ac a ON a.page=i.page LEFT JOIN rs USING (inspection_id))) r
        JOIN (VALUES {texts}) v(reading,title,text) ON v.reading=r.reading""",
        extra={
            **chain(),
            **SCORED,
            "rs": """SELECT inspection_id, CAST(floor(CAST(sum(CAST("value" AS DECIMAL(20,9))) AS DOUBLE)/count(*)*40+0.5) AS BIGINT) AS result,
                CASE WHEN sum(answers)<5 THEN 'low' WHEN sum(answers)<10 THEN 'medium' ELSE 'high' END AS confidence FROM pe GROUP BY 1""",
            "qn": "SELECT inspection_id, count(*) AS questions, list_sort(list(question_index))[count(*)//2+1] AS picked FROM questions GROUP BY 1",
            "ac": """SELECT page, CASE WHEN k%11=0 THEN 0 ELSE 6 END + CASE WHEN k%4=3 OR k%13=0 THEN 0 WHEN k%3=0 THEN 2 ELSE 4 END
                + CASE WHEN k*7919%4000<1500 THEN 3 WHEN k*7919%4000<3000 THEN 2 ELSE 0 END + CASE WHEN word_count>=300 THEN 4 WHEN word_count>=100 THEN 2 ELSE 0 END
                + CASE WHEN k%6=0 THEN 0 ELSE 3 END AS access FROM sg""",
        },
    )
    names = ",".join(f"({quoted(m[0])},{quoted(m[1])},{quoted(m[2])},{m[3]})" for m in K.COMPARISON_METRICS)
    compared = {
        **chain(),
        "mt": f"SELECT * FROM (VALUES {names}) v(key,label,unit,higher)",
        "cp": """SELECT i.inspection_id, t.key, mt.label, t.v AS target, quantile_cont(o.v,0.5) AS median, u.same_type_only, count(*) AS sample, mt.higher, mt.unit
            FROM used u JOIN me o ON o.page=u.page JOIN inspections i ON i.inspection_id=u.inspection_id JOIN me t ON t.page=i.page AND t.key=o.key JOIN mt ON mt.key=t.key
            GROUP BY i.inspection_id, t.key, mt.label, t.v, u.same_type_only, mt.higher, mt.unit""",
        "gp": "SELECT *, floor(CASE WHEN higher THEN median-target ELSE target-median END/greatest(abs(target),abs(median),1.0)*100+0.5)/100 AS gap FROM cp",
    }
    q["compare_signals"] = with_ctes(
        "SELECT inspection_id, key, label, target, median, target-median AS delta, gap, same_type_only, sample, higher AS higher_is_better, unit FROM gp", extra=compared
    )
    q["top_gaps"] = with_ctes(
        "SELECT inspection_id, rank, key, gap FROM (SELECT *, row_number() OVER (PARTITION BY inspection_id ORDER BY gap DESC, label) AS rank FROM gp WHERE gap>0) WHERE rank<=3",
        extra=compared,
    )
    kinds = ",".join(f"({quoted(t)},{quoted(K.PAGE_TYPE_LABELS[t])},{quoted(K.PAGE_TYPE_ACTIONS[t])})" for t in K.PAGE_TYPE_LABELS)
    q["page_typology"] = with_ctes(
        """SELECT c.inspection_id, c.page_type, v.label, c."count", v.action, e.examples, row_number() OVER (PARTITION BY c.inspection_id ORDER BY c."count" DESC, c.page_type) AS position
        FROM tc c JOIN kd2 v USING (page_type) JOIN te e USING (inspection_id, page_type)""",
        extra={
            **chain(),
            "kd2": f"SELECT * FROM (VALUES {kinds}) v(page_type,label,action)",
            "tp": "SELECT c.inspection_id, s.page_type, regexp_extract(s.page,'^[^/]+') AS host, s.page FROM cand c JOIN sg s USING (page)",
            "tc": 'SELECT inspection_id, page_type, count(*) AS "count" FROM tp GROUP BY 1,2',
            "th": "SELECT inspection_id, page_type, host, min(page) AS first_page FROM tp GROUP BY 1,2,3",
            "te": """SELECT inspection_id, page_type, string_agg(host, ',' ORDER BY first_page) AS examples FROM (
                SELECT *, row_number() OVER (PARTITION BY inspection_id, page_type ORDER BY first_page) AS rn FROM th) WHERE rn<=3 GROUP BY 1,2""",
        },
    )


analysis_sql()
