"""SQL twins: texts, URLs, dates, pages."""

from __future__ import annotations

from sightline.functions import constants as K
from sightline.plans.oracle import AS_OF, SQL, with_ctes
from sightline.plans.oracle_runs import NORM_PAGE_URL

WS = "[ \\t\\n\\x0b\\f\\r\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+"


def norm(text: str) -> str:
    return f"regexp_replace(lower(strip_accents({text})), '{WS}', ' ', 'g')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pages_sql() -> None:
    q = SQL
    q["normalize_documents"] = f"SELECT doc_id, md5({norm('text')}) AS fingerprint FROM documents"
    q["document_languages"] = f"""WITH s AS (SELECT doc_id, {norm('text')} AS t FROM documents),
        c AS (SELECT doc_id, len(regexp_extract_all(t,'\\b({K.FR_STOP})\\b')) AS fr, len(regexp_extract_all(t,'\\b({K.EN_STOP})\\b')) AS en FROM s)
        SELECT doc_id, CASE WHEN fr+en<8 THEN '' WHEN fr>en*1.5 THEN 'fr' WHEN en>fr*1.5 THEN 'en' ELSE '' END AS lang FROM c"""
    stop = ",".join(quoted(w) for w in K.QUESTION_STOP_WORDS)
    q["question_terms"] = f"""WITH w AS (SELECT conv_id, turn, regexp_replace(x,'^-+|-+$','','g') AS x, i FROM (
            SELECT conv_id, turn, unnest(l) AS x, unnest(range(len(l))) AS i FROM (
                SELECT conv_id, turn, regexp_split_to_array(regexp_replace({norm('text')},'[^\\p{{L}}\\p{{N}}\\s-]',' ','g'),'\\s+') AS l FROM conversations WHERE role='user'))),
        f AS (SELECT conv_id, turn, x, min(i) AS i FROM w WHERE length(x)>=3 AND x NOT IN ({stop}) GROUP BY 1,2,3)
        SELECT c.conv_id, c.turn, coalesce(string_agg(f.x,' ' ORDER BY f.i),'') AS terms FROM conversations c LEFT JOIN f ON f.conv_id=c.conv_id AND f.turn=c.turn WHERE c.role='user' GROUP BY 1,2"""
    places = ",".join(f"({quoted(p)},{i})" for i, p in enumerate(K.KNOWN_PLACES))
    rx = {n: quoted(getattr(K, n)) for n in ("PRICE_INTENT", "RESOURCE_INTENT", "COMPARATIVE_INTENT", "INFORMATIONAL_INTENT")}
    q["question_intents"] = f"""WITH q AS (SELECT conv_id, turn, {norm('text')} AS t FROM conversations WHERE role='user'),
        s AS (SELECT conv_id, turn, ' '||regexp_replace(t,'[^\\p{{L}}\\p{{N}}]',' ','g')||' ' AS t FROM q),
        p AS (SELECT place, i, ' '||regexp_replace(trim({norm('place')}),'[^\\p{{L}}\\p{{N}}]',' ','g')||' ' AS b FROM (VALUES {places}) v(place,i)),
        h AS (SELECT conv_id, turn, place, length(place) AS size, i, strpos(t,b) AS pos FROM s JOIN p ON contains(t,b)),
        best AS (SELECT conv_id, turn, arg_min(place, pos*1000000-size*1000+i) AS place FROM h GROUP BY 1,2)
        SELECT q.conv_id, q.turn, place, CASE WHEN regexp_matches(t,{rx['PRICE_INTENT']}) THEN 'price' WHEN regexp_matches(t,{rx['RESOURCE_INTENT']}) THEN 'resource'
            WHEN regexp_matches(t,{rx['COMPARATIVE_INTENT']}) THEN 'comparative' WHEN regexp_matches(t,{rx['INFORMATIONAL_INTENT']}) THEN 'informational'
            WHEN place IS NOT NULL THEN 'local' ELSE 'informational' END AS intent FROM q LEFT JOIN best USING (conv_id, turn)"""
    verbs = ",".join(quoted(v) for v in dict.fromkeys(K.VERB_WORDS))
    generic = ",".join(quoted(g) for g in K.GENERIC_HEADINGS)
    starts = quoted(K.QUESTION_START.replace(r"(?!\p{L})", r"(?:[^\p{L}]|$)"))
    q["question_headings"] = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
        n AS (SELECT doc_id, trim({norm('line')}) AS b, regexp_replace(trim(regexp_replace(line,'{WS}',' ','g')),'^(?:#|n[°o]\\s?)?\\d{{1,3}}\\s*(?:[.):-]|\\s)\\s*','') AS t FROM l)
        SELECT doc_id, count(*) AS lines, count(*) FILTER (b<>'' AND (b LIKE '%?' OR regexp_matches(b,{starts}))) AS questions,
        count(*) FILTER (t<>'' AND t NOT LIKE '%?' AND regexp_matches(t,'^\\p{{Lu}}') AND len(regexp_split_to_array(t,'\\s+'))<=5 AND {norm('t')} NOT IN ({generic})
            AND NOT list_has_any(regexp_split_to_array({norm('t')},'[\\s''’]+'),[{verbs}])) AS entities FROM n GROUP BY 1"""
    host = "regexp_replace(regexp_extract(lower(url),'^[a-z]+://([^/?#:]+)',1),'^www\\.','')"
    root = f"array_to_string(list_slice(string_split({host},'.'),-2,-1),'.')"
    q["normalize_urls"] = f"""SELECT page_id, {NORM_PAGE_URL} AS normalized, rtrim(regexp_replace(regexp_replace(lower(url),'^https?://(www\\.)?',''),'[?#].*$',''),'/') AS bare,
        {host} AS host, {root} AS root, regexp_extract(lower(url),'^[a-z]+://[^/?#]+') AS origin, {host}='example.com' OR {host} LIKE '%.example.com' AS on_example_com FROM pages"""
    q["pages_per_root"] = f"""SELECT root, count(*) AS pages, count(DISTINCT host) AS hosts, count(DISTINCT n) AS urls FROM (SELECT {root} AS root, {host} AS host, {NORM_PAGE_URL} AS n FROM pages) GROUP BY 1"""
    q["written_dates"] = "SELECT o_orderkey, strftime(o_orderdate,'%Y-%m-%d') AS day, strftime(o_orderdate,'%Y-%m-%d') AS marked_day FROM orders"
    months = "floor(epoch(TIMESTAMP '2001-08-02'-o_orderdate)/(30.4375*86400)*10+0.5)/10"
    q["page_ages"] = f"""SELECT o_orderkey, {months} AS months, CASE WHEN {months}<=6 THEN 4 WHEN {months}<=12 THEN 3 WHEN {months}<=24 THEN 1 ELSE 0 END AS points,
        strftime(greatest(o_orderdate,TIMESTAMP '2000-01-01'),'%Y-%m-%d') AS effective, CASE WHEN o_orderdate>=TIMESTAMP '2000-01-01' THEN 'dateModified' ELSE 'année du titre' END AS source FROM orders"""
    q["events_by_local_day"] = "SELECT strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris','%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY 1,2"
    q["stale_analyses"] = with_ctes(f"SELECT inspection_id, inspection_id%4=0 OR {AS_OF}-created_at>INTERVAL 7 DAY AS stale FROM inspections")

    # pages: the article is cut out of the markup with patterns
    def plain_text(markup: str) -> str:
        out = f"trim(regexp_replace(regexp_replace({markup},'<[^>]*>','','g'),'\\s+',' ','g'))"
        for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&#39;", "''")):
            out = f"replace({out},'{entity}','{char}')"
        return out

    main = plain_text("regexp_extract(html,'<article>(.*)</article>',1,'s')")
    words = f"CASE WHEN {main}='' THEN 0 ELSE len(string_split({main},' ')) END"
    q["page_info"] = f"""SELECT page_id, {plain_text("regexp_extract(html,'<title>([^<]*)</title>',1)")} AS title, {plain_text("regexp_extract(html,'<h1>([^<]*)</h1>',1)")} AS h1,
        left(lower(regexp_extract(html,'<html lang="([^"]*)"',1)),2) AS lang, {words} AS word_count, md5({main}) AS main_text_md5, {words}<50 AND contains(lower(html),'<script') AS js_suspect,
        len(regexp_extract_all(html,'<h2')) AS h2_count, CAST(NULL AS VARCHAR) AS published_at, CAST(NULL AS VARCHAR) AS canonical,
        length(coalesce((SELECT string_agg(x,' ' ORDER BY i) FROM (SELECT unnest(ps) AS x, unnest(range(len(ps))) AS i) WHERE length(x)>40),{main})) AS excerpt_length
        FROM (SELECT page_id, html, [{plain_text('p')} FOR p IN (string_split(regexp_extract(html,'<article>(.*)</article>',1,'s'),'<p>'))[2:]] AS ps FROM pages)"""
    title, h1 = plain_text("regexp_extract(html,'<title>([^<]*)</title>',1)"), plain_text("regexp_extract(html,'<h1>([^<]*)</h1>',1)")
    q["page_hashes"] = f"""SELECT hash, count(*) AS pages, min(page_id) AS first_page FROM (
        SELECT page_id, sha256({title}||chr(10)||{h1}||chr(10)||chr(10)||{main}) AS hash FROM pages) GROUP BY 1"""
    shape = "length(regexp_extract(lower(url),'^[a-z]+://[^/?#]+'))%5"
    path = "regexp_extract(url,'^[a-z]+://[^/?#]*([^#]*)',1)"
    agents = ",".join(f"({i},{quoted(a)},{quoted(v)},{quoted(r)})" for i, (a, v, r) in enumerate(K.AI_AGENTS))
    access = f"""SELECT page_id, a.agent, a.vendor, a.role,
        CASE s WHEN 1 THEN a.agent='GPTBot' WHEN 2 THEN NOT (a.agent IN ('ClaudeBot','PerplexityBot') AND path LIKE '/en/%' AND path NOT LIKE '/en/4%')
            WHEN 3 THEN NOT (contains(path,'?page=') OR path LIKE '/fr/%') WHEN 4 THEN a.agent='Google-Extended' OR path NOT LIKE '%.html' ELSE true END AS allowed,
        CASE s WHEN 1 THEN a.agent='GPTBot' WHEN 2 THEN a.agent IN ('ClaudeBot','PerplexityBot') WHEN 4 THEN a.agent='Google-Extended' ELSE false END AS explicit
        FROM (SELECT page_id, {shape} AS s, {path} AS path FROM pages), (VALUES {agents}) a(i,agent,vendor,role)"""
    q["robots_access"] = access
    q["robots_by_vendor"] = f"SELECT page_id, vendor, bool_and(allowed) AS allowed, count(*) FILTER (NOT allowed) AS blocked FROM ({access}) GROUP BY 1,2"
    q["access_scores"] = f"""WITH a AS (SELECT page_id, bool_and(allowed) AS ok FROM ({access}) GROUP BY 1), w AS (SELECT page_id, {words} AS n, page_id*7919%4000 AS ms FROM pages),
        j AS (SELECT * FROM a JOIN w USING (page_id))
        SELECT page_id, 'robots' AS key, CASE WHEN ok THEN 6 ELSE 0 END AS points, 6 AS max FROM j UNION ALL
        SELECT page_id, 'http', CASE WHEN page_id%11=0 THEN 0 WHEN page_id%3=0 THEN 2 ELSE 4 END, 4 FROM j UNION ALL
        SELECT page_id, 'responseTime', CASE WHEN ms<1500 THEN 3 WHEN ms<3000 THEN 2 ELSE 0 END, 3 FROM j UNION ALL
        SELECT page_id, 'readable', CASE WHEN n>=300 THEN 4 WHEN n>=100 THEN 2 ELSE 0 END, 4 FROM j UNION ALL
        SELECT page_id, 'snippets', 3, 3 FROM j UNION ALL SELECT page_id, 'llmsTxt', 0, 0 FROM j"""


pages_sql()
