"""Terms that a text may hold, by an inverted index: an equality join instead of texts times terms.

A term matches between word edges only, so every word of the term is a whole word of the text.
Each term is posted under one of its words, the one that fewest terms of its project have
(then the longest); a text asks for its distinct words. Domains match anywhere, so they are
posted under the characters around a dot of theirs, and a text asks for those around each of
its dots. Terms without a word, and domains without a dot inside, are posted under a key that
every text asks for. What the index gives is then tested on the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_WORD = r"[\p{L}\p{N}]+"
_EVERY = "*"  # the key that every text asks for
SMALL = 20_000  # needles whose index every task can hold
_AROUND_DOT = {"wide": r"(\S\S\.\S\S)", "narrow": r"(\S\.\S)"}


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_WORD})")))


def _dots(text: Column, kind: str) -> Column:
    """Each dot with its neighbours; matches may overlap."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?={_AROUND_DOT[kind]})")), lambda g: F.concat(F.lit("."), g))


def posted(needles: DataFrame) -> DataFrame:
    """``project_id, key`` and the columns of needles (``project_id, bare, is_term``): where each is posted."""
    # A dictionary is small beside the texts; counting its words needs no text.
    own = needles.withColumn("_id", F.xxhash64("project_id", "bare", "is_term"))
    words = own.where("is_term").select("_id", "project_id", F.explode(_words(F.col("bare"))).alias("key")).distinct()
    used = words.groupBy("project_id", "key").agg(F.count("*").alias("_terms"))
    rarest = words.join(used, ["project_id", "key"]).groupBy("_id").agg(
        F.min_by("key", F.struct("_terms", -F.length("key"), "key")).alias("_word")
    )
    of_domain = F.coalesce(*[F.get(_dots(F.col("bare"), kind), F.lit(0)) for kind in _AROUND_DOT])
    key = F.coalesce(F.when(F.col("is_term"), F.col("_word")).otherwise(of_domain), F.lit(_EVERY))
    return own.join(rarest, "_id", "left").withColumn("key", key).drop("_id", "_word")


def asked(texts: DataFrame, id: str, *carried: str) -> DataFrame:
    """``id, project_id, key``: what each text (``id, project_id, body``) asks for, and the columns carried along."""
    body = F.col("body")
    dots = F.when(F.contains(body, F.lit(".")), F.concat(_dots(body, "wide"), _dots(body, "narrow"))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(_words(body), dots, F.array(F.lit(_EVERY)))
    return texts.where(body.isNotNull()).select(id, "project_id", *carried, F.explode(F.array_distinct(keys)).alias("key"))


def few(needles: DataFrame) -> bool:
    """Whether every task can hold the index of these needles."""
    return needles.limit(SMALL + 1).count() <= SMALL


def holding(texts: DataFrame, needles: DataFrame, id: str, small: bool = False) -> DataFrame:
    """Every text with each needle of its project that it holds as a substring.

    texts: ``id, project_id, body`` (normalised); needles: ``project_id, bare, is_term`` and
    whatever else. Texts travel once; only the keys they ask for meet the index. small: the index
    goes to every task (see :func:`few`), and texts meet it where they are, in one pass.
    """
    index = posted(needles)
    # A text asks for a key once, so a needle is found once per text.
    if small:
        # Texts of one id are tested for what any of them asks for, as by the join below.
        beside = texts.where(F.col(id).isNotNull()).withColumn("_bodies", F.collect_list("body").over(W.partitionBy(id)))
        found = asked(beside, id, "_bodies").join(F.broadcast(index), ["project_id", "key"]).drop("project_id", "key")
        found = found.withColumn("body", F.explode("_bodies")).drop("_bodies")
    else:
        keys = asked(texts, id).join(index, ["project_id", "key"]).drop("project_id", "key")
        found = texts.select(id, "body").join(keys, id)
    return found.where(F.contains("body", "bare"))
