"""The tables behind the charts of players, and the lists that a user selects from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.display import decimals, ordinal
from ..sources.scratch import written
from .players import INVERTED, ROLES, Roles, per_90, qualified, role_rows, role_scores, roles_table

#: What a metric tells of a player; others are "other".
KINDS = {
    "output": ("goals", "shots", "xg", "npxg", "xg_per_shot", "assists", "xa", "xaop", "xasp", "xt"),
    "passing": ("passes", "passes_pct", "crosses", "crosses_ok", "long_passes", "through_passes", "progressive_passes"),
    "defensive": ("interceptions", "recoveries", "defensive_duels_pct", "aerial_duels_pct", "clearances"),
    "dribbling": ("dribbles", "dribbles_pct", "progressive_runs", "losses", "loss_index"),
    "goalkeeping": ("gk_prevented_per_shot", "gk_conceded", "gk_exits"),
}


def player_radar(ev: DataFrame, roles: Roles = ROLES, inverted: Sequence[str] = INVERTED, least_minutes: int = 90) -> DataFrame:
    """Per player and role of its position: the role's metrics with place, angle, kind and percentile, and score and rank in the role."""
    table = roles_table(ev.sparkSession, roles, inverted)
    stats = qualified(ev, least_minutes)
    n = stats.count()
    rows = written(role_rows(stats, table, n), "role-rows")
    scores = role_scores(rows, most_rows=n).select("player_id", "role_id", "score", "place")
    sizes = table.groupBy("role_id").agg(F.count(F.lit(1)).alias("size"))
    kind = F.coalesce(*(F.when(F.col("metric").isin(*ms), k) for k, ms in KINDS.items()), F.lit("other"))
    x = rows.join(sizes, "role_id").join(scores, ["player_id", "role_id"])
    return x.select(
        "player_id", "role", "ord", "metric", (F.col("ord") * 360.0 / F.col("size")).alias("degrees"), kind.alias("kind"), "value",
        (F.col("p") * 100).alias("percentile"), "score", "place"
    )


def player_distribution(ev: DataFrame, roles: Roles = ROLES, least_minutes: int = 90) -> DataFrame:
    """Where a player's value lies among the players of each of its roles: strict percentile with its ordinal, the axis'
    ends (a tenth around the value if all are equal) and the value as text."""
    stats = qualified(ev, least_minutes)
    x = role_rows(stats, roles_table(ev.sparkSession, roles), stats.count())
    flat = F.col("low") == F.col("high")
    x = x.withColumn("percent", F.floor(100 * F.col("below") / F.col("of")).cast("long"))
    return x.select(
        "player_id", "role", "metric", F.expr(f"concat(cast(percent as string), {ordinal('percent')})").alias("percentile"),
        F.when(flat, F.col("value") - 0.1).otherwise(F.col("low")).alias("low"), F.when(flat, F.col("value") + 0.1).otherwise(F.col("high")).alias("high"),
        F.expr(decimals("value", 2)).alias("value")
    )


#: Points of a density curve, and the units in which its sums are whole: of a value's weight, of the kernel, of the bandwidth.
POINTS, SHARE, KERNEL, WIDTH = 128, 1000, 1_000_000, 1000


def density_curves(values: DataFrame, *groups: str, value: str = "value", points: int = POINTS) -> DataFrame:
    """Per group with at least two different values: a Gaussian kernel density estimate at `points` places from the least to
    the greatest value, bandwidth by Scott's rule (deviation times n to the power -1/5).

    Each value is shared between the two places around it (linear binning), so a group of any size becomes `points` sums;
    the kernel is summed over these. Sums are of whole numbers and don't depend on the order of rows. Null is left out.
    Returns groups, point, x, density and n."""
    v, at, last = F.col(value), F.col("_at"), points - 1
    known = values.where(v.isNotNull())
    ends = known.groupBy(*groups).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(F.lit(1)).alias("n")).where("_hi > _lo")
    x = known.join(ends, [*groups]).withColumn("_at", (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * last)
    low = F.least(F.floor(at), F.lit(last - 1)).cast("long")
    right = F.floor((at - low) * SHARE + 0.5).cast("long")
    shares = F.array(F.struct(low.alias("bin"), (SHARE - right).alias("w")), F.struct((low + 1).alias("bin"), right.alias("w")))
    bins = x.select(*groups, "_lo", "_hi", "n", F.inline(shares)).groupBy(*groups, "_lo", "_hi", "n", "bin").agg(F.sum("w").alias("w"))
    bins = bins.groupBy(*groups, "_lo", "_hi", "n").agg(
        F.sum("w").alias("_w"), F.sum(F.col("w") * F.col("bin")).alias("_w1"), F.sum(F.col("w") * F.col("bin") * F.col("bin")).alias("_w2"),
        F.collect_list(F.struct("bin", "w")).alias("_bins")
    )  # at most `points` bins a group
    n, w, w1, w2 = (F.col(c).cast("double") for c in ("n", "_w", "_w1", "_w2"))
    variance = F.greatest(w2 / w - w1 / w * (w1 / w), F.lit(0.0)) * n / (n - 1)
    width = F.greatest(F.floor(F.sqrt(variance) * F.pow(n, F.lit(-0.2)) * WIDTH + 0.5).cast("long"), F.lit(1).cast("long"))
    bins = bins.withColumn("_h", width).withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    away = lambda b: (F.col("point") - b["bin"]) * WIDTH / F.col("_h")
    kernel = lambda b: b["w"] * F.floor(F.exp(away(b) * away(b) * -0.5) * KERNEL + 0.5).cast("long")
    total = F.aggregate("_bins", F.lit(0).cast("long"), lambda s, b: s + kernel(b))
    step = (F.col("_hi") - F.col("_lo")) / last
    return bins.select(
        *groups, F.col("point").cast("int").alias("point"), (F.col("_lo") + F.col("point") * step).alias("x"),
        (total.cast("double") / w / KERNEL / (F.col("_h").cast("double") / WIDTH * step) * INVERSE_ROOT).alias("density"), "n"
    )


#: 1 / sqrt(2 pi)
INVERSE_ROOT = 0.3989422804014327


def role_densities(ev: DataFrame, roles: Roles = ROLES, least_minutes: int = 90) -> DataFrame:
    """Density curves of each metric of a role over the role's players."""
    stats = qualified(ev, least_minutes)
    return density_curves(role_rows(stats, roles_table(ev.sparkSession, roles), stats.count()), "role", "metric")


def team_list(ev: DataFrame) -> DataFrame:
    """All teams, sorted."""
    return ev.select(F.explode(F.array("home_team_name", "away_team_name")).alias("team")).where("team is not null").distinct().orderBy("team")


def match_list(ev: DataFrame) -> DataFrame:
    """Matches in order with the name that a user selects one by: teams and score."""
    goals = {side: F.count_if((F.col("team_name") == F.col(f"{side}_team_name")) & F.col("shot_is_goal")).alias(side) for side in ("home", "away")}
    each = ev.groupBy("match_id", "home_team_name", "away_team_name").agg(*goals.values())
    name = F.concat(
        "home_team_name", F.lit(" vs "), "away_team_name", F.lit(" ("), F.col("home").cast("string"), F.lit(" - "), F.col("away").cast("string"),
        F.lit(")")
    )
    return each.select("match_id", "home_team_name", "away_team_name", name.alias("display_name")).orderBy("match_id")


def match_by_name(ev: DataFrame) -> DataFrame:
    """What a display name selects: the first match that has it."""
    return match_list(ev).groupBy("display_name").agg(F.min("match_id").alias("match_id"))


def player_list(ev: DataFrame) -> DataFrame:
    """Players by minutes, most first, with the name that a user selects one by."""
    x = per_90(ev).select("player_id", "player_name", "team_name", "total_minutes")
    name = F.concat("player_name", F.lit(" ("), "team_name", F.lit(", "), F.col("total_minutes").cast("string"), F.lit(" min)"))
    return x.withColumn("display_name", name).orderBy(F.desc("total_minutes"), "player_id")


def fixtures(ev: DataFrame, team: str) -> DataFrame:
    """The matches that a team plays, at home or away."""
    return match_list(ev).where((F.col("home_team_name") == team) | (F.col("away_team_name") == team))
