"""Season reports of all teams at once: corners, league comparison, strength, and the tables behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import hundredths
from ..functions.pitch import CONTACT_ZONE, TARGET_ZONE, metres
from ..operators.relational import average_rank, first_per_key, possession_changes
from . import metrics as M
from .match import aggregates

INVERTED = ("goals_against", "xg_against", "xg_per_shot_against", "shots_against", "ppda", "losses")


def corners(ev: DataFrame) -> DataFrame:
    """Per team: corner possessions, delivery, first-contact zones, and what the 1st, the 2nd and later contacts bring."""
    taken = first_per_key(ev.where("type_primary = 'corner' and possession_event_index is not null"), ["match_id", "possession_id"], "possession_event_index")
    length = F.expr(metres("location_x", "location_y", "pass_end_x", "pass_end_y"))
    taken = taken.select(
        "match_id", "possession_id", "team_name", F.col("possession_event_index").alias("c"),
        F.when(length <= 20, "short").otherwise("direct").alias("delivery")
    )
    later = ev.select(
        "match_id", "possession_id", "possession_event_index", "shot_cents", "shot_is_goal", F.expr(CONTACT_ZONE).alias("zone")
    ).join(taken, ["match_id", "possession_id"])
    step = F.col("possession_event_index") - F.col("c")
    shot = F.col("shot_cents").isNotNull()
    phases = {"first": step == 1, "second": step == 2, "phase2": step > 2}
    each = later.groupBy("match_id", "possession_id", "team_name", "delivery").agg(
        F.coalesce(F.min(F.when(step == 1, F.col("zone"))), F.lit("Unknown")).alias("zone"),
        *(
            x for k,
            c in phases.items() for x in (
                F.count_if(c & shot).alias(f"{k}_shots"), F.count_if(c & shot & F.col("shot_is_goal")).alias(f"{k}_goals"),
                F.coalesce(F.sum(F.when(c, F.col("shot_cents"))), F.lit(0)).alias(f"{k}_cents")
            )
        ),
    )
    sums = [F.sum(f"{k}_{x}").alias(f"{k}_{x}") for k in phases for x in ("shots", "goals", "cents")]
    zones = [F.count_if(F.col("zone") == z).alias(name) for z, name in ZONES.items()]
    out = each.groupBy("team_name").agg(F.count("*").alias("corners"), F.count_if(F.col("delivery") == "short").alias("short"), *zones, *sums)
    played = ev.groupBy("team_name").agg(F.count_distinct("match_id").alias("matches"))
    cents = F.col("first_cents") + F.col("second_cents") + F.col("phase2_cents")
    out = out.join(played, "team_name").withColumns(
        {
            "corners_per_match": F.col("corners") / F.col("matches"), "xg_per_match": cents / 50000 / F.col("matches"),
            "xg_per_corner": cents / 50000 / F.col("corners"), "short_pct": 100.0 * F.col("short") / F.col("corners"),
            "direct_pct": 100.0 * (F.col("corners") - F.col("short")) / F.col("corners")
        } | {f"{z}_pct": 100.0 * F.col(z) / F.col("corners") for z in ZONES.values()}
    )
    return out.withColumns({f"{k}_xg": F.col(f"{k}_cents") / 50000 for k in phases}).drop(*(f"{k}_cents" for k in phases))


ZONES = {
    "6Y Box": "zone_six_yard", "Front Area": "zone_front", "Near Post": "zone_near", "Far Post": "zone_far", "Middle Area": "zone_middle",
    "Back Area": "zone_back", "Unknown": "zone_unknown"
}


def team_radar(ev: DataFrame) -> DataFrame:
    """Per team and match played: what it does, what its opponents do, and its shares."""
    own = possession_changes(ev).groupBy("team_name").agg(*aggregates(M.TEAM_FOR))
    against = ev.groupBy(F.col("opponent_team_name").alias("team_name")).agg(*aggregates(M.TEAM_AGAINST))
    third = ev.groupBy("match_id", "team_name", "possession_id").agg(F.min("location_x").alias("lo"), F.max("location_x").alias("hi")).groupBy("team_name").agg(
        F.expr(M.n("lo < 66.6e0 and hi >= 66.6e0")).alias("final_third_entries")
    )
    held = first_per_key(ev, ["match_id", "possession_id"], "seq").groupBy(F.col("possession_team_name").alias("team_name")).agg(
        F.coalesce(F.sum("possession_duration_sec"), F.lit(0.0)).alias("sec")
    )
    held = held.withColumn("possession_share", F.col("sec") / F.sum("sec").over(Window.partitionBy()) * 100).drop("sec")
    x = own.join(against, "team_name").join(third, "team_name").join(held, "team_name", "left")
    part = lambda a, b, scale=1.0: F.when(F.col(b) > 0, F.col(a) / F.col(b) * scale).otherwise(0.0)
    each = [c for c in (*M.TEAM_FOR, *M.TEAM_AGAINST, "final_third_entries") if c not in SHARED]
    return x.select(
        "team_name", "matches", *(
            (F.col(c) / F.col("matches")).alias(c) for c in each
        ), "directness", F.coalesce("possession_share", F.lit(0.0)).alias("possession_share"),
        part("xg", "shots").alias("xg_per_shot"), part("xg_against", "shots_against").alias("xg_per_shot_against"), part(
            "aerial_duels_won", "aerial_duels", 100.0
        ).alias("aerial_pct"),
        part("defensive_duels_won", "defensive_duels", 100.0).alias("defensive_duel_pct"), F.when(
            F.col("press_actions") > 0, F.col("pressed_passes") / F.col("press_actions")
        ).otherwise(999.0).alias("ppda"),
    )


SHARED = ("matches", "directness", "aerial_duels", "aerial_duels_won", "defensive_duels", "defensive_duels_won", "press_actions", "pressed_passes")


def team_percentiles(ev: DataFrame) -> DataFrame:
    """Average-rank percentile of every metric over all teams, of hundredths; where less is better, ranked from above."""
    radar = team_radar(ev)
    names = [c for c in radar.columns if c not in ("team_name", "matches")]
    long = radar.unpivot("team_name", [F.col(c).cast("double").alias(c) for c in names], "metric", "value")
    cents = F.expr(hundredths("coalesce(value, 0e0)"))
    ranked = long.select("team_name", "metric", F.when(F.col("metric").isin(*INVERTED), -cents).otherwise(cents).alias("v"))
    return ranked.select("team_name", "metric", (average_rank("v", "metric") * 100).alias("percentile"))


def strength(ev: DataFrame) -> DataFrame:
    goals, cents = F.expr(M.n("shot_is_goal")), F.coalesce(F.sum("shot_cents"), F.lit(0))
    own = ev.groupBy("team_name").agg(F.count_distinct("match_id").alias("matches"), goals.alias("gf"), cents.alias("cf"))
    against = ev.groupBy(F.col("opponent_team_name").alias("team_name")).agg(goals.alias("ga"), cents.alias("ca"))
    x = own.join(against, "team_name")
    per = lambda g, c: (F.col(g) / F.col("matches") * 0.3 + F.col(c) / 50000 / F.col("matches") * 0.7)
    return x.select(
        "team_name", "matches", (F.col("gf") / F.col("matches")).alias("goals_for"), (F.col("ga") / F.col("matches")).alias("goals_against"),
        per("gf", "cf").alias("attack"), per("ga", "ca").alias("defence")
    )


def mean(c: str) -> str:
    """Of teams, in millionths, so that it doesn't depend on the order of rows."""
    return f"cast(sum(cast(floor({c} * 1000000 + 0.5e0) as bigint)) as double) / count({c}) / 1000000"


def strength_limits(ev: DataFrame) -> DataFrame:
    """Axis limits of the strength scatter, a tenth beyond either end, and its mean lines."""
    lo, hi = lambda c: F.min(c) - (F.max(c) - F.min(c)) / 10, lambda c: F.max(c) + (F.max(c) - F.min(c)) / 10
    sides = ("attack", "defence")
    return strength(ev).agg(
        *(f(c).alias(f"{c}_{k}") for c in sides for k, f in (("low", lo), ("high", hi))), *(F.expr(mean(c)).alias(f"{c}_mean") for c in sides)
    )


def strength_diagonals(ev: DataFrame) -> DataFrame:
    """The constants c of the lines attack - defence = c that cross the scatter, a tenth apart."""
    ends = F.sequence(F.floor((F.col("attack_low") - F.col("defence_high")) * 10), F.ceil((F.col("attack_high") - F.col("defence_low")) * 10))
    return strength_limits(ev).where("attack_low is not null").select(F.explode(ends).alias("tenths")).select((F.col("tenths") / 10).alias("c"))


def scatter(ev: DataFrame, x: str = "xg", y: str = "xg_against", invert_x: bool = False, invert_y: bool = True) -> DataFrame:
    """Any two team metrics for every team, with the ends of both axes (first and last, swapped if inverted) and the mean lines."""
    every = Window.partitionBy()  # over teams
    out = team_radar(ev).select("team_name", F.col(x).alias("x"), F.col(y).alias("y"))
    for c, swap in (("x", invert_x), ("y", invert_y)):
        lo, hi = F.min(c).over(every), F.max(c).over(every)
        ends = lo - (hi - lo) / 10, hi + (hi - lo) / 10
        out = out.withColumns({f"{c}_first": ends[swap], f"{c}_last": ends[not swap]})
    means = {f"{c}_mean": F.sum(F.floor(F.col(c) * 1000000 + 0.5).cast("long")).over(every).cast("double") / F.count(c).over(every) / 1000000 for c in "xy"}
    return out.withColumns(means)


#: Which metrics each of a team's three radars shows, in their order.
FAMILIES = {
    "offensive": ("goals", "xg", "xg_per_shot", "shots", "box_actions", "box_passes", "crosses", "dribbles"),
    "distribution": ("passes", "progressive_passes", "directness", "possession_share", "final_third_entries", "losses"),
    "defensive": ("goals_against", "xg_against", "xg_per_shot_against", "shots_against", "aerial_pct", "defensive_duel_pct", "interceptions", "fouls", "ppda"),
}


def radar_vectors(ev: DataFrame) -> DataFrame:
    """The vectors of the three radars of each team: family, place and angle (degrees) on it, percentile."""
    rows = [(f, m, i, 360.0 * i / len(ms)) for f, ms in FAMILIES.items() for i, m in enumerate(ms)]
    places = ev.sparkSession.createDataFrame(rows, "family string, metric string, ord int, degrees double")
    return team_percentiles(ev).join(F.broadcast(places), "metric").select("team_name", "family", "ord", "metric", "degrees", "percentile")


def corner_takers(ev: DataFrame) -> DataFrame:
    length = F.coalesce("pass_length", F.expr(metres("location_x", "location_y", "pass_end_x", "pass_end_y")))
    x = ev.where("type_primary = 'corner' and player_name is not null").withColumn("length_m", length)
    side = F.when(F.coalesce("location_y", F.lit(101.0)) < 50, "left").otherwise("right")
    return x.groupBy("team_name", side.alias("side"), "player_name", F.expr(TARGET_ZONE).alias("zone")).agg(F.count("*").alias("corners"))


def match_shots(ev: DataFrame) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("match_id", "team_name").orderBy("seq")).cast("long")
    outcome = F.when(F.col("shot_is_goal"), "goal").when(F.col("shot_on_target"), "on target").otherwise("other")
    return ev.where("type_primary = 'shot'").select(
        "match_id", "team_name", "event_id", number.alias("number"), "location_x", "location_y", (F.col("shot_cents") / 50000).alias("xg"),
        outcome.alias("outcome")
    )


def season_shots(ev: DataFrame, against: bool = False) -> DataFrame:
    """Shots without penalties: number, goals, xG and xG per shot of each team, or of its opponents."""
    team = F.col("opponent_team_name" if against else "team_name").alias("team_name")
    x = ev.where("type_primary = 'shot' and not contains(tags, 'penalty')").groupBy(team).agg(
        F.count("*").alias("shots"), F.expr(M.n("shot_is_goal")).alias("goals"), F.sum("shot_cents").alias("cents")
    )
    return x.select("team_name", "shots", "goals", (F.col("cents") / 50000).alias("xg"), (F.col("cents") / 50000 / F.col("shots")).alias("xg_per_shot"))
