"""Who owns a host: the suffix test as an equality join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.urls import host_suffixes, normalize_domain


def tracked_domains(entities: DataFrame) -> DataFrame:
    """One row per (project, entity, domain); empty domains would match everything and are dropped."""
    return (
        entities.select("project_id", "entity_id", "entity_type", "ordinal", "name", F.explode("domains").alias("_d"))
        .withColumn("suffix", normalize_domain(F.col("_d")))
        .filter(F.col("suffix") != "")
        .drop("_d")
    )


def all_owners(hosts: DataFrame, entities: DataFrame, host: str = "domain") -> DataFrame:
    """Every (row, entity) whose tracked domain is the host or one of its parents.

    Each host is cut to the numbers of labels that tracked domains have (a handful, as names
    are short) and joined on equality, which Spark can broadcast or shuffle by size; comparing
    every host with every domain would be a nested loop. A host of fewer labels than asked for
    stays whole, and the number of labels in the join keeps it from a domain of its own length.
    """
    tracked = tracked_domains(entities).withColumn("_labels", F.size(F.split("suffix", r"\.")))
    depths = F.broadcast(tracked.select("_labels").distinct())
    cut = F.call_function("substring_index", F.col(host), F.lit("."), -F.col("_labels"))
    expanded = hosts.crossJoin(depths).withColumn("suffix", cut)
    return expanded.join(tracked, ["project_id", "_labels", "suffix"]).drop("_labels", "suffix")


def with_owner(hosts: DataFrame, entities: DataFrame, keys: list[str], host: str = "domain") -> DataFrame:
    """Add the first owner in list order (brand first) to rows that are unique by ``keys``.

    The rows are read once: each goes along with its suffixes, and these meet again by the keys.
    """
    keys = list(dict.fromkeys(["project_id", *keys]))
    others = [c for c in hosts.columns if c not in keys]
    owner = F.struct("ordinal", "entity_type", "entity_id", "name")
    tracked = tracked_domains(entities).groupBy("project_id", "suffix").agg(F.min(owner).alias("_o"))
    expanded = hosts.withColumn("suffix", F.explode_outer(host_suffixes(F.col(host))))
    owned = expanded.join(tracked, ["project_id", "suffix"], "left").groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in others], F.min("_o").alias("_o")
    )
    return owned.select(
        *keys,
        *others,
        F.col("_o.entity_type").alias("owner_type"),
        F.col("_o.entity_id").alias("owner_id"),
        F.col("_o.name").alias("owner_name"),
    )
