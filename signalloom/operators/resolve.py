"""From mentions to one record per company."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as fv
from ..functions.similarity import _jaro_winkler, jaro_winkler
from ..functions.text import norm_name
from .state import cut, once


# ---------------------------------------------------------------- single tiers
def match_domain(mentions: DataFrame, companies: DataFrame) -> DataFrame:
    """Mentions with the (first) company of the same domain."""
    owner = companies.where(F.col("domain").isNotNull()).groupBy("domain").agg(F.min("company_id").alias("company_id"))
    return mentions.where(F.col("domain").isNotNull()).join(owner, "domain")


def match_exact(mentions: DataFrame, companies: DataFrame) -> DataFrame:
    """Mentions with the (first) company of the same normalised name."""
    owner = companies.where(F.col("norm") != "").groupBy("norm").agg(F.min("company_id").alias("company_id"))
    return mentions.join(owner, "norm")


def match_alias(mentions: DataFrame, companies: DataFrame) -> DataFrame:
    """Mentions whose key is the key of an alias, inside the same two-character block."""
    alias = companies.select("company_id", F.substring("norm", 1, 2).alias("block"), F.explode("aliases").alias("alias"))
    alias = alias.select("company_id", "block", norm_name(F.col("alias")).alias("norm"))
    owner = alias.where(F.col("block") == F.substring("norm", 1, 2)).groupBy("norm").agg(F.min("company_id").alias("company_id"))
    return mentions.join(owner, "norm")


def name_keys(names: DataFrame, norm: str = "norm", score: float = fv.FUZZY_NAME_SCORE) -> DataFrame:
    """Blocking keys of the fuzzy name join, for names of at least 3 characters.

    Equal first two characters and a score of at least .94 force a Jaro part of .9, so at
    least 70 % of either name's characters are shared (as a multiset, lengths within
    a ratio of .7).  Characters are numbered by occurrence and put in a fixed order,
    rare letters first; two such names then share three characters within the first
    ``n - ceil(.7 n) + 3``.
    """
    if score < fv.FUZZY_NAME_SCORE:
        raise ValueError(f"the keys are proven for scores of {fv.FUZZY_NAME_SCORE} and more")
    order = "zqxjkvwybfpgmchdultnirsoae9876543210"
    chars = F.filter(F.split(F.col(norm), ""), lambda c: c != "")
    numbered = F.transform(
        chars, lambda c, i: F.struct(
            F.position(c, F.lit(order)).alias("rank"),
            F.size(F.filter(F.slice(chars, 1, i + 1), lambda d: d == c)).alias("k"), c.alias("c")))
    n = F.length(norm)
    prefix = F.slice(F.array_sort(numbered), 1, F.least(n, n - F.ceil(n * F.lit(0.7) - F.lit(1e-9)).cast("int") + 3))
    sign = F.transform(prefix, lambda x: F.concat(x["c"], x["k"].cast("string")))
    triples = F.flatten(F.flatten(F.transform(sign, lambda a, i: F.transform(
        F.slice(sign, i + 2, F.size(sign)), lambda b, j: F.transform(
            F.slice(sign, i + j + 3, F.size(sign)), lambda c: F.concat_ws(".", a, b, c))))))
    return names.where(F.length(norm) >= 3).select(
        "*", F.explode(F.transform(triples, lambda t: F.concat_ws("|", F.substring(norm, 1, 2), t))).alias("key"))


def fuzzy_pairs(left: DataFrame, right: DataFrame, score: float = fv.FUZZY_NAME_SCORE, floor_transpositions: bool = False) -> DataFrame:
    """Distinct normalised names ``l`` and ``r`` with their similarity, at or above ``score``."""
    a = name_keys(left.select("norm").distinct().where(F.length("norm") >= fv.FUZZY_NAME_MIN_LENGTH), score=score).withColumnRenamed("norm", "l")
    b = name_keys(right.select("norm").distinct(), score=score).withColumnRenamed("norm", "r")
    ratio = F.least(F.length("l"), F.length("r")) / F.greatest(F.length("l"), F.length("r"))
    pairs = a.join(b, "key").where(ratio >= 0.7 - 1e-9).select("l", "r").distinct()
    scored = pairs.withColumn("score", jaro_winkler(F.col("l"), F.col("r"), floor_transpositions))
    return scored.where(F.col("score") >= score)


def match_fuzzy(mentions: DataFrame, companies: DataFrame, floor_transpositions: bool = False) -> DataFrame:
    """Mentions with the most similar company of their block; ties go to the first company.

    ``companies`` are resolved records: their names are pairwise dissimilar, so a
    mention has few candidates.
    """
    pairs = fuzzy_pairs(mentions, companies, floor_transpositions=floor_transpositions)
    owner = companies.groupBy("norm").agg(F.min("company_id").alias("company_id"))
    best = pairs.join(owner, pairs["r"] == owner["norm"]).groupBy("l").agg(
        F.min_by(F.struct("company_id", "score"), F.struct((-F.col("score")).alias("s"), "company_id")).alias("m"))
    return mentions.join(best.select(F.col("l").alias("norm"), "m.company_id", "m.score"), "norm")


def match_tiers(mentions: DataFrame, companies: DataFrame) -> DataFrame:
    """Domain, then exact name, then alias, then fuzzy; null company when nothing matches.

    The tiers see distinct (name key, domain) pairs only.  Rows that share a mention_id share the best match of them.
    """
    keys = cut(mentions.select("norm", "domain").distinct())
    tiers = {
        "domain": match_domain(keys, companies), "exact": match_exact(keys, companies),
        "alias": match_alias(keys, companies), "fuzzy": match_fuzzy(keys, companies),
    }
    found = None
    for rank, (name, df) in enumerate(tiers.items()):
        one = df.select("norm", "domain", F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("tier"), "company_id").alias("m"))
        found = one if found is None else found.unionByName(one)
    best = cut(found.groupBy(F.col("norm").alias("_norm"), F.col("domain").alias("_domain")).agg(F.min("m").alias("m")))
    same = F.col("norm").eqNullSafe(F.col("_norm")) & F.col("domain").eqNullSafe(F.col("_domain"))
    of_id = F.when(F.col("mention_id").isNotNull(), F.min("m").over(Window.partitionBy("mention_id")))
    matched = mentions.join(best, same, "left").withColumn("m", of_id)
    return matched.select("mention_id", *[c for c in mentions.columns if c != "mention_id"], "m.tier", "m.company_id")


# ---------------------------------------------------------------- whole resolution
def _scan(groups: pd.DataFrame) -> pd.DataFrame:
    """One pass over groups (ord, norm, domain) in order of arrival: domain, exact name, alias, fuzzy name, else a new company.

    The plain form of ``resolve_entities``, which the tests compare it with.
    """
    companies: list[dict] = []
    by_domain: dict[str, dict] = {}
    by_norm: dict[str, dict] = {}
    by_alias: dict[tuple[str, str], dict] = {}
    out = []
    for ord_, norm, domain in groups.sort_values("ord")[["ord", "norm", "domain"]].itertuples(index=False):
        block = norm[:2]
        c = by_domain.get(domain) if domain else None
        c = c or by_norm.get(norm) or by_alias.get((block, norm))
        if c is None and len(norm) >= fv.FUZZY_NAME_MIN_LENGTH:
            near = [(_jaro_winkler(norm, x["norm"], False), x) for x in companies if x["norm"][:2] == block]
            score, best = max(near, key=lambda v: (v[0], -v[1]["id"]), default=(0.0, None))
            c = best if score >= fv.FUZZY_NAME_SCORE else None
        if c is None:
            c = {"id": int(ord_), "norm": norm, "domain": None}
            companies.append(c)
            by_norm[norm] = c
        if domain and not c["domain"]:  # a company has one domain: the first it came with
            c["domain"] = domain
            by_domain.setdefault(domain, c)
        if norm[:2] == c["norm"][:2]:  # aliases are looked for in the block of the company's own name
            key = (block, norm)
            if key not in by_alias or by_alias[key]["id"] > c["id"]:
                by_alias[key] = c
        out.append((norm, domain, c["id"]))
    return pd.DataFrame(out, columns=["norm", "domain", "company_id"])


def resolve_entities(mentions: DataFrame) -> DataFrame:
    """``mention_id`` -> ``company_id`` (the first mention of the company), for every mention with a name.

    ``mentions``: mention_id (arrival order), name, domain.  Mentions collapse to distinct (name key, domain), each resolved at its
    first mention: to the company with its domain, or of its name, or with it as alias, or of the most similar name; else it is a
    new company.  A company adopts the first domain that it comes with and no other.

    Where a group goes depends on earlier groups only.  Each round places all groups by the companies and adopted domains of the
    round before, so at least one more group, in order of arrival, is right for good after each; a round that changes no company
    and no domain gives what ``_scan`` gives.  Rounds are aggregates and joins, and no set of groups is gathered; their number
    is that of the longest chain of decisions.  A company id always is the id of a company's first mention.
    """
    m = once(mentions.select("mention_id", "name", F.when(F.col("domain") != "", F.col("domain")).alias("domain")), norm=norm_name(F.col("name")))
    m = m.drop("name").where(F.col("norm") != "")
    groups = cut(m.groupBy("norm", "domain").agg(F.min("mention_id").alias("ord")))
    names = cut(groups.groupBy("norm").agg(F.min("ord").alias("ord")))
    # A short name is never l, so its pairs stand in one direction only.
    similar = cut(fuzzy_pairs(names, names).where("l <> r"))
    founders, owners, state = names, groups.select("domain", F.col("ord").alias("at"), F.col("ord").alias("company_id")).limit(0), None
    while True:
        placed, founders, owners = _place(groups, similar, founders, owners)
        now = tuple(founders.agg(F.count("*"), F.bit_xor(F.xxhash64("norm", "ord"))).first()) + tuple(owners.agg(F.count("*"), F.bit_xor(F.xxhash64("domain", "at", "company_id"))).first())
        if now == state:
            break
        state = now
    same_domain = F.col("m.domain").eqNullSafe(F.col("f.domain"))
    return m.alias("m").join(placed.alias("f"), (F.col("m.norm") == F.col("f.norm")) & same_domain).select("m.mention_id", "f.company_id")


def _place(groups: DataFrame, similar: DataFrame, founders: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All groups (ord, norm, domain, company_id) by the last round's founders (norm, ord) and owners (domain, at, company_id), and the new ones of both."""
    g = groups.join(owners, "domain", "left").select("ord", "norm", "domain", F.when(F.col("at") < F.col("ord"), F.col("company_id")).alias("company_id"))
    g = cut(g)
    owned, rest = g.where("company_id IS NOT NULL"), g.where("company_id IS NULL").drop("company_id")
    head = groups.select(F.col("ord").alias("company_id"), F.substring("norm", 1, 2).alias("block"))
    alias = owned.join(head, "company_id").where(F.col("block") == F.substring("norm", 1, 2)).groupBy("norm", "company_id").agg(F.min("ord").alias("at"))
    # One group of a name can be the first without domain or alias; it founds a company or goes to the most similar one.
    first = rest.groupBy("norm").agg(F.min("ord").alias("first")).join(alias.groupBy("norm").agg(F.min("at").alias("known")), "norm", "left")
    first = first.where("known IS NULL OR first < known").select("norm", "first")
    near = similar.join(founders.select(F.col("norm").alias("r"), "ord"), "r").join(first.withColumnRenamed("norm", "l"), "l").where("ord < first")
    near = near.groupBy(F.col("l").alias("norm")).agg(F.max_by("ord", F.struct("score", (-F.col("ord")).alias("o"))).alias("near"))
    first = cut(first.join(near, "norm", "left"))
    founded, moved = first.where("near IS NULL"), first.where("near IS NOT NULL")
    # Later groups of a founder's name are its own; others go to the lowest id among the aliases so far.
    by_name = rest.join(founded, "norm").select("ord", "norm", "domain", F.col("first").alias("company_id"))
    at_first = rest.join(moved, "norm").where("ord = first").select("ord", "norm", "domain", F.col("near").alias("company_id"))
    aliases = alias.select("norm", "company_id", "at").unionByName(moved.select("norm", F.col("near").alias("company_id"), F.col("first").alias("at")))
    so_far = F.min("company_id").over(Window.partitionBy("norm").orderBy("at", "company_id").rowsBetween(Window.unboundedPreceding, -1))
    lowest = aliases.join(founded.select("norm"), "norm", "left_anti").withColumn("_before", so_far).where("_before IS NULL OR company_id < _before").drop("_before")
    by_alias = rest.join(lowest, "norm").where("at < ord").groupBy("ord", "norm", "domain").agg(F.min("company_id").alias("company_id"))
    named = cut(by_name.unionByName(at_first).unionByName(by_alias))
    adopted = named.where("domain IS NOT NULL").groupBy("company_id").agg(F.min(F.struct(F.col("ord").alias("at"), "domain")).alias("a"))
    owners = adopted.groupBy("a.domain").agg(F.min(F.struct("a.at", "company_id")).alias("o")).select("domain", "o.at", "o.company_id")
    return owned.select("ord", "norm", "domain", "company_id").unionByName(named), cut(founded.select("norm", F.col("first").alias("ord"))), cut(owners)
