"""A small answer log: two projects, one rival, four prompts, two engines, nine answers."""

from __future__ import annotations

from datetime import datetime, timedelta

from sightline import schema
from sightline.sources.log import TableLog

NOW = datetime(2026, 9, 8, 12, 0, 0)
AS_OF = "2026-09-08 12:00:01"
YESTERDAY, LONG_AGO = NOW - timedelta(days=1), NOW - timedelta(days=45)
DAY0 = datetime(2026, 1, 1)


def src(url, domain, cited=None):
    return {"url": url, "title": None, "domain": domain, "cited": cited, "retrieved": None}


BRAND_UTM = src("https://www.brandlab.ca/seo/?utm_source=openai", "brandlab.ca")
BRAND = src("https://brandlab.ca/seo", "brandlab.ca")
DIRECTORY = src("https://clutch.co/agencies", "clutch.co")
RIVAL = src("https://digit.ca/seo/", "digit.ca")

# id, run, prompt, engine, when, text, sources, latency, cost, error
ANSWERS = [
    ("r1", "run1", "p1", "A", NOW, "Brandlab is a good choice.", [BRAND_UTM, DIRECTORY], 800, 0.02, None),
    ("r2", "run1", "p1", "A", YESTERDAY, "Ask Brandlab.", [BRAND], 1200, 0.01, None),
    ("r3", "run1", "p1", "B", NOW + timedelta(minutes=1), "Brandlab, maybe.", [DIRECTORY], 3000, 0.01, None),
    ("r4", "run1", "p2", "A", NOW, "Digit leads.", [RIVAL, DIRECTORY], 900, 0.01, None),
    ("r5", "run1", "p2", "B", YESTERDAY, "Digit again.", [RIVAL], 2000, 0.01, None),
    ("r6", "run1", "p3", "A", NOW, "Nobody.", [], 700, 0.01, None),
    ("r7", "run1", "p3", "B", NOW, "", [], 1000, 0.01, "timeout"),
    ("r8", "run1", "p1", "A", LONG_AGO, "Nobody.", [DIRECTORY], 1000, 0.01, None),
    ("r9", "run2", "q1", "A", NOW, "Other brand", [BRAND], 1000, 0.01, None),
]


def rows(spark, table, records):
    kind = schema.TABLES[table]
    full = [{f.name: r.get(f.name) for f in kind.fields} for r in records]
    return spark.createDataFrame([tuple(r.values()) for r in full], kind)


def answer_log(spark, days=30) -> TableLog:
    t = {
        "projects": rows(spark, "projects", [
            {"id": "P", "brand_name": "Brandlab", "aliases": [], "domains": ["brandlab.ca"], "repeats": 2, "cost_cap_eur": 1.0, "inspections_per_day": 2, "created_at": DAY0},
            {"id": "Q", "brand_name": "Other", "aliases": [], "domains": ["brandlab.ca"], "repeats": 1, "cost_cap_eur": 1.0, "inspections_per_day": 2, "created_at": DAY0},
        ]),
        "competitors": rows(spark, "competitors", [
            {"id": "C", "project_id": "P", "name": "Digit", "aliases": [], "domains": ["digit.ca"], "created_at": DAY0},
        ]),
        "prompts": rows(spark, "prompts", [
            {"id": "p1", "project_id": "P", "text": "best agency", "tags": ["seo"], "web_search": True, "active": True, "created_at": DAY0},
            {"id": "p2", "project_id": "P", "text": "which agency", "tags": ["seo", "llm"], "web_search": True, "active": True, "created_at": DAY0},
            {"id": "p3", "project_id": "P", "text": "no tag here", "tags": [], "web_search": False, "active": False, "created_at": DAY0},
            {"id": "q1", "project_id": "Q", "text": "other question", "tags": [], "web_search": True, "active": True, "created_at": DAY0},
        ]),
        "engines": rows(spark, "engines", [
            {"id": "A", "provider": "openai", "model": "gpt-5.4-mini", "label": "A", "enabled": True, "usable": True, "created_at": DAY0},
            {"id": "B", "provider": "perplexity", "model": "sonar", "label": "B", "enabled": True, "usable": True, "created_at": DAY0 + timedelta(days=1)},
        ]),
        "runs": rows(spark, "runs", [
            {"id": "run1", "project_id": "P", "status": "done", "started_at": YESTERDAY},
            {"id": "run2", "project_id": "Q", "status": "done", "started_at": YESTERDAY},
        ]),
        "results": rows(spark, "results", [
            {"id": i, "run_id": u, "prompt_id": p, "engine_id": e, "repeat_index": n, "web_search": True, "raw_text": x,
             "sources": [tuple(s.values()) for s in ss], "latency_ms": ms, "cost_estimate": c, "error": err, "created_at": at}
            for n, (i, u, p, e, at, x, ss, ms, c, err) in enumerate(ANSWERS)
        ]),
        "inspections": rows(spark, "inspections", [
            {"id": "I1", "project_id": "P", "url": "https://brandlab.ca/seo", "status": "done", "cost_estimate": 0.12, "created_at": YESTERDAY,
             "questions": [("How to choose?", "en", "manual"), ("Which one is best?", "en", "manual")]},
            {"id": "I2", "project_id": "P", "url": "https://brandlab.ca/other", "status": "running", "cost_estimate": 0.05, "created_at": LONG_AGO, "questions": []},
        ]),
        "inspection_answers": rows(spark, "inspection_answers", [
            {"id": "a1", "inspection_id": "I1", "question_index": 0, "engine_id": "A", "raw_text": "See Brandlab", "sources": [tuple(DIRECTORY.values()), tuple(BRAND_UTM.values())]},
            {"id": "a2", "inspection_id": "I1", "question_index": 0, "engine_id": "B", "raw_text": "x", "sources": [tuple(src("https://blog.brandlab.ca/x", "blog.brandlab.ca").values())]},
            {"id": "a3", "inspection_id": "I1", "question_index": 1, "engine_id": "A", "raw_text": "x", "sources": [tuple(RIVAL.values()), tuple(src(BRAND["url"], "brandlab.ca", False).values())]},
            {"id": "a4", "inspection_id": "I1", "question_index": 1, "engine_id": "B", "raw_text": "", "sources": [], "error": "timeout"},
        ]),
    }
    return TableLog(t, AS_OF, days)
