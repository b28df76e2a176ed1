"""robots.txt as rows: rules per agent group, longest match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions import constants as K


def _lines(body: Column) -> Column:
    """Typed lines of a file: (n, key, value) without comments and blanks."""
    lines = F.transform(
        F.split(body, r"\r\n|\r|\n"),
        lambda x, n: F.struct(n.alias("n"), F.trim(F.regexp_replace(x, r"#.*$", "")).alias("line")),
    )
    kept = F.filter(lines, lambda x: F.contains(x["line"], F.lit(":")))
    return F.transform(
        kept,
        lambda x: F.struct(
            x["n"].alias("n"),
            F.lower(F.trim(F.substring_index(x["line"], ":", 1))).alias("key"),
            F.trim(F.regexp_replace(x["line"], r"^[^:]*:", "")).alias("value"),
        ),
    )


def robots_rules(files: DataFrame) -> DataFrame:
    """(origin, body) -> (origin, group_agent, allow, path): each rule under each agent of its group.

    A group is a run of consecutive user-agent lines; its number is the running count of
    such runs over the lines of one file.
    """
    typed = F.filter(_lines(F.col("body")), lambda x: x["key"].isin("user-agent", "allow", "disallow"))
    lines = files.select("origin", F.posexplode(typed).alias("n", "x")).select("origin", "n", "x.key", "x.value")
    order = W.partitionBy("origin").orderBy("n")
    is_agent = F.col("key") == "user-agent"
    starts = is_agent & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    rows = lines.withColumn("_starts", starts.cast("int")).withColumn("group", F.sum("_starts").over(order))
    heads = rows.filter(is_agent).select("origin", "group", F.lower("value").alias("group_agent"))
    rules = rows.filter(~is_agent & (F.col("value") != "")).select("origin", "group", (F.col("key") == "allow").alias("allow"), F.col("value").alias("path"))
    return heads.join(rules, ["origin", "group"], "left").select("origin", "group_agent", "allow", "path")


def _path_pattern(path: Column) -> Column:
    """Robots path to a pattern: ``*`` is any text, a final ``$`` anchors the end."""
    literal = F.regexp_replace(path, r"([.+?^(){}|\[\]\\])", r"\\$1")
    open_end = F.regexp_replace(F.regexp_replace(literal, r"\*", ".*"), r"\$(?!$)", r"\\\$")
    return F.concat(F.lit("^"), open_end)


# Groups that decide for an AI agent: its own, or the one for all.
_GROUPS = [a[0].lower() for a in K.AI_AGENTS] + ["*"]


def _literal_prefix(path: Column) -> Column:
    """The start of a robots path that holds no special character."""
    return F.regexp_replace(F.substring_index(path, "*", 1), r"\$$", "")


def heeded_groups(bodies: DataFrame, rules: DataFrame) -> DataFrame:
    """Per origin: ``heeded``, for each agent in list order the place of its group in ``_GROUPS`` (null:
    none); ``named``, whether the file names it; ``lengths``, the lengths of the rules' prefixes."""
    present = F.col("present")
    named = [F.bool_or(F.contains(F.lower("body"), F.lit(f"user-agent: {g}"))) for g in _GROUPS[:-1]]
    heeded = [F.when(F.array_contains(present, g), i).when(F.array_contains(present, "*"), len(_GROUPS) - 1) for i, g in enumerate(_GROUPS[:-1])]
    # Ten groups and as many lengths as a path is long, at most.
    groups = rules.groupBy("origin").agg(F.collect_set("group_agent").alias("present"), F.collect_set(F.length("prefix")).alias("lengths"))
    sites = bodies.groupBy("origin").agg(F.array(*named).alias("named")).join(groups, "origin", "left")
    return sites.select("origin", "named", F.array(*heeded).alias("heeded"), "lengths")


def robots_access(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Per page and AI agent: allowed, and named explicitly or not.

    ``pages``: (page_id, origin, page_path); ``files``: (origin, body), no row or a null
    body meaning no file (all allowed). The most specific group applies (the
    agent's own, else ``*``), then the longest matching path; allow wins a tie. A null
    origin or path is matched by no rule.

    Rules are looked up as in a trie: a path asks for its prefixes, at the lengths that its site's
    rules have, by an equality join on (origin, prefix). So a long file costs a page no more than
    a short one, a hot origin is spread over its paths, and no text of a file reaches a page row.
    """
    bodies = files.filter(F.col("body").isNotNull())
    rules = robots_rules(bodies).filter(F.col("group_agent").isin(*_GROUPS)).withColumn("prefix", _literal_prefix(F.col("path")))
    sites = heeded_groups(bodies, rules)
    pages = pages.select("page_id", "origin", "page_path")

    asked = pages.select("origin", "page_path").dropna().distinct()
    lengths = F.filter("lengths", lambda n: n <= F.length("page_path"))
    probes = asked.join(sites.select("origin", "lengths"), "origin").select("origin", "page_path", F.explode(lengths).alias("n"))
    probes = probes.select("origin", "page_path", F.left(F.col("page_path"), F.col("n")).alias("prefix"))
    special = F.contains("path", F.lit("*")) | F.endswith("path", F.lit("$"))
    found = probes.join(rules.filter(F.col("path").isNotNull()), ["origin", "prefix"]).filter(
        ~special | F.regexp_like("page_path", _path_pattern(F.col("path")))
    )
    # The longest path wins, and of equal ones the one that allows: the last bit says so.
    weight = F.length("path") * 2 + F.col("allow").cast("int")
    best = F.array(*[F.max(F.when(F.col("group_agent") == g, weight)) for g in _GROUPS])
    verdicts = found.groupBy("origin", "page_path").agg(best.alias("best"))

    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(a, ("agent", "vendor", "role"))]) for a in K.AI_AGENTS])
    judged = pages.join(sites.drop("lengths"), "origin", "left").join(verdicts, ["origin", "page_path"], "left")
    rule = F.get("best", F.get("heeded", F.col("i")))
    return judged.select("page_id", "heeded", "named", "best", F.posexplode(listed).alias("i", "x")).select(
        "page_id", "x.agent", "x.vendor", "x.role",
        F.coalesce(rule % 2 == 1, F.lit(True)).alias("allowed"), F.coalesce(F.get("named", F.col("i")), F.lit(False)).alias("explicit"),
    )


def access_report(access: DataFrame) -> DataFrame:
    """Per page: all agents allowed or not, and the blocked ones in list order."""
    order = F.create_map(*[F.lit(x) for i, a in enumerate(K.AI_AGENTS) for x in (a[0], i)])
    # Nine agents at most per page.
    blocked = F.array_sort(F.collect_list(F.when(~F.col("allowed"), F.struct(F.try_element_at(order, F.col("agent")).alias("i"), "agent"))))
    return access.groupBy("page_id").agg(F.bool_and("allowed").alias("all_allowed"), F.transform(blocked, lambda b: b["agent"]).alias("blocked_agents"))


def access_by_vendor(access: DataFrame) -> DataFrame:
    return access.groupBy("page_id", "vendor").agg(
        F.bool_and("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("blocked")
    )
