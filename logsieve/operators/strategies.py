"""Rules that mark commands for removal. Each gives (history_id, command, reason).

All work on distinct commands; the blocking key is the first word (with the history),
cheap native predicates come before the edit distance. Where several commands could
be named, the nearest one by distance is, then the first in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import (
    damerau_levenshtein,
    halves,
    heads_may_match,
    maybe_within,
    search_radius,
    similar,
    within_one,
)
from ..functions.text import base_command, normalize, split_command
from .stats import HEAVIER, KEY, base_totals

#: Runs that make a first word common, and successes up to which it is rare.
COMMON, RARE = 20, 2


def prepared(commands: DataFrame) -> DataFrame:
    """With base, norm, head and rest of each command, unless they are there."""
    if "head" in commands.columns:
        return commands
    out = commands.withColumns({"base": base_command("command"), "norm": normalize("command")})
    return out.withColumn("parts", split_command("norm")).select(
        *out.columns, F.col("parts.head").alias("head"), F.col("parts.rest").alias("rest")
    )


def _named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select("history_id", "base", *[F.col(a).alias(b) for a, b in names.items()])


def _parts(prefix: str) -> dict:
    return {c: F.col(f"{prefix}_{c}") for c in ("norm", "head", "rest")}


def _sides(stats: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    kept = {"command": "command", "norm": "norm", "head": "head", "rest": "rest"}
    a = _named(stats, {k: f"{left}_{v}" for k, v in kept.items()} | {"failed_count": "failures"})
    b = _named(stats, {k: f"{right}_{v}" for k, v in kept.items()} | {"success_count": "successes"})
    return a.where("failures > 0"), b.where("successes > 0")


def _nearest(pairs: DataFrame, command: str, other: str, distance) -> DataFrame:
    best = F.min(F.struct(distance.alias("d"), F.col(other).alias("other"))).alias("best")
    return pairs.groupBy("history_id", F.col(command).alias("command")).agg(best).select(*KEY, F.col("best.other").alias("other"))


def failed_prefix(stats: DataFrame) -> DataFrame:
    """Failed commands that a more often successful command of the same base begins with."""
    base = base_command("command").alias("base")
    failed = stats.where("failed_count > 0").select("history_id", base, "command", "failed_count")
    good = stats.where("success_count > 0").select("history_id", base, F.col("command").alias("other"), "success_count")
    longer = F.col("other").startswith(F.col("command")) & (F.octet_length("other") > F.octet_length("command"))
    pairs = failed.join(good, ["history_id", "base"]).where(longer & (F.col("success_count") > F.col("failed_count")))
    first = pairs.groupBy(*KEY).agg(F.min("other").alias("other"))
    return first.select(*KEY, F.concat(F.lit("Failed prefix of '"), "other", F.lit("'")).alias("reason"))


def failed_similar(stats: DataFrame, threshold: float, done: DataFrame) -> DataFrame:
    """Failed commands with a typo in the head of a more often successful one; not those in ``done``."""
    failed, good = _sides(prepared(stats), "f", "s")
    failed = failed.join(done.select("history_id", F.col("command").alias("f_command")), ["history_id", "f_command"], "left_anti")
    radius = search_radius(threshold, F.length("f_command"))
    pairs = failed.join(good, ["history_id", "base"]).where(
        (F.col("f_command") != F.col("s_command"))
        & (F.col("successes") > F.col("failures"))
        & maybe_within("f_command", "s_command", radius)
        & heads_may_match(F.col("f_head"), F.col("s_head"), threshold)
    )
    alike = similar(pairs, _parts("f"), _parts("s"), threshold)
    near = alike.withColumn("d", damerau_levenshtein("f_command", "s_command")).where(F.col("d") <= radius)
    found = _nearest(near, "f_command", "s_command", F.col("d"))
    return found.select(*KEY, F.concat(F.lit("Failed similar to '"), "other", F.lit("'")).alias("reason"))


def typo_bases(stats: DataFrame) -> DataFrame:
    """(history_id, base, common): rare first words one edit from the most used common one.

    Both sides are joined on halves of themselves, so they are not compared with each other's every word.
    """
    totals = base_totals(stats)
    rare = totals.where(F.col("failures") > 0).where(F.col("successes") <= RARE)
    rare = rare.select("history_id", "base", F.explode(halves("base")).alias("left"))
    common = totals.where(F.col("total") >= COMMON)
    common = common.select("history_id", F.col("base").alias("common"), "total", F.explode(halves("base")).alias("left"))
    pairs = rare.join(common, ["history_id", "left"]).where(within_one("base", "common"))
    # most runs first, then the first in order
    best = F.min(F.struct((-F.col("total")).alias("n"), "common")).alias("best")
    return pairs.groupBy("history_id", "base").agg(best).select("history_id", "base", F.col("best.common").alias("common"))


def cross_base_typos(stats: DataFrame) -> DataFrame:
    """Commands without any success whose first word is a typo of a common one."""
    rows = stats.where("success_count = 0").select(*KEY, base_command("command").alias("base"))
    found = rows.join(typo_bases(stats), ["history_id", "base"])
    return found.select(*KEY, F.concat(F.lit("Cross-base typo of '"), "common", F.lit("'")).alias("reason"))


def rare_variants(weights: DataFrame, threshold: float, rare_threshold: float) -> DataFrame:
    """Commands of little weight that look like one of the same base with over three times as much."""
    rows = prepared(weights)
    kept = {"command": "command", "norm": "norm", "head": "head", "rest": "rest", "weight": "weight"}
    rare = _named(rows.where(F.col("weight") <= rare_threshold), {k: f"r_{v}" for k, v in kept.items()})
    common = _named(rows, {k: f"c_{v}" for k, v in kept.items()})
    pairs = rare.join(common, ["history_id", "base"]).where(
        (F.col("r_command") != F.col("c_command"))
        & (F.col("c_weight") > HEAVIER * F.col("r_weight"))
        & heads_may_match(F.col("r_head"), F.col("c_head"), threshold)
    )
    near = similar(pairs, _parts("r"), _parts("c"), threshold)
    found = _nearest(near, "r_command", "c_command", damerau_levenshtein("r_command", "c_command"))
    return found.select(*KEY, F.concat(F.lit("Rare variant of '"), "other", F.lit("'")).alias("reason"))


#: Our own patterns from published credential formats: (name, pattern).
SECRETS = (
    ("AWS secret key", "(?i)aws_?secret_?access_?key\\s*[=:]\\s*[\"']?[A-Za-z0-9/+=]{40}"),
    ("AWS access key id", "\\b(AKIA|ASIA)[A-Z0-9]{16}\\b"),
    ("GitHub token", "\\b(gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})"),
    ("GitLab token", "\\bglpat-[A-Za-z0-9_-]{20,}"),
    ("Slack token", "\\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("Stripe key", "\\b[rs]k_live_[A-Za-z0-9]{16,}"),
    ("JSON web token", "\\beyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    ("Private key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("Authorization header", "(?i)authorization:\\s*(bearer|basic|token)\\s+[A-Za-z0-9._~+/=-]{8,}"),
    ("URL password", "(?i)\\b[a-z][a-z0-9+.-]*://[^\\s/:@]+:[^\\s/@]+@"),
    ("Assigned secret", "(?i)\\b(api_?key|secret|token|passwd|password)[a-z_]*\\s*[=:]\\s*[\"']?[^\\s\"']{8,}"),
)


def secret_name(text):
    """The name of the first pattern that ``text`` holds, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SECRETS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def secrets(stats: DataFrame) -> DataFrame:
    rows = stats.select(*KEY, secret_name(F.col("command")).alias("name")).where("name is not null")
    return rows.select(*KEY, F.concat(F.lit("Secret pattern: "), "name").alias("reason"))


def samples(removals: DataFrame, most: int = 5) -> DataFrame:
    """The first lines of each reason, in order."""
    order = Window.partitionBy("history_id", "reason").orderBy("line")
    return removals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
