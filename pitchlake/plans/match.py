"""Per-match team and player reports. Every function takes the event table and answers for all matches at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import clock, rounded
from ..functions.pitch import IN_BOX, goal_distance
from ..operators.relational import first_per_key, possession_changes
from . import metrics as M

TEAM = ["match_id", "team_name"]


def aggregates(table: dict[str, str]) -> list[Column]:
    return [F.expr(f"{x} as {name}") for name, x in table.items()]


def general(ev: DataFrame) -> DataFrame:
    out = ev.groupBy(*TEAM).agg(*aggregates(M.GENERAL))
    return out.withColumn("fouls_suffered", F.sum("fouls").over(Window.partitionBy("match_id")) - F.col("fouls"))


def defence(ev: DataFrame) -> DataFrame:
    """Passes allowed per defensive action: the opponent's passes in its press zone by the team's actions there."""
    out = ev.groupBy(*TEAM).agg(*aggregates(M.DEFENCE))
    allowed = F.sum("pressed_passes").over(Window.partitionBy("match_id")) - F.col("pressed_passes")
    return out.withColumn(
        "ppda", F.when(F.col("press_actions") > 0, allowed / F.col("press_actions")).otherwise(0.0)
    ).select(*TEAM, "interceptions", "clearances", "ppda")


def transitions(ev: DataFrame) -> DataFrame:
    return possession_changes(ev).groupBy(*TEAM).agg(*aggregates(M.RECOVERIES | M.LOSSES))


def first_events(ev: DataFrame) -> DataFrame:
    """One row a possession of a match: its first event in row order."""
    return first_per_key(ev, ["match_id", "possession_id"], "seq")


def duels(ev: DataFrame) -> DataFrame:
    """With challenge intensity: defensive duels and interceptions per minute of the opponent's possession."""
    own = ev.groupBy(*TEAM).agg(*aggregates(M.DUELS), F.expr(M.DEFENCE["interceptions"]).alias("interceptions"))
    seconds = first_events(ev).groupBy("match_id", F.col("possession_team_name").alias("holder")).agg(F.sum("possession_duration_sec").alias("sec"))
    faced = own.join(
        seconds, [own["match_id"] == seconds["match_id"], own["team_name"] != seconds["holder"]], "left"
    ).groupBy(own["match_id"], "team_name").agg(F.sum("sec").alias("sec"))
    value = F.when(F.col("sec") > 0, (F.col("defensive_duels") + F.col("interceptions")) / (F.col("sec") / 60)).otherwise(0.0)
    return own.join(faced, TEAM).withColumn("challenge_intensity", value).drop("sec", "interceptions")


def possession(ev: DataFrame) -> DataFrame:
    each = ev.groupBy("match_id", "possession_id").agg(F.max("location_x").alias("far"), F.max(F.expr(IN_BOX)).alias("box"))
    held = first_events(ev).select(
        "match_id", "possession_id", F.col("possession_team_name").alias("team_name"), "possession_duration_sec"
    ).join(each, ["match_id", "possession_id"])
    clock = ev.groupBy("match_id").agg((F.max("match_ts") - F.min("match_ts")).alias("clock"))
    out = held.groupBy(*TEAM).agg(
        F.coalesce(
            F.sum("possession_duration_sec"), F.lit(0.0)
        ).alias("seconds"), F.count("*").alias("possessions"), F.expr(M.n("far > 50")).alias("reaching_half"),
        F.expr(M.n("box")).alias("reaching_box"), F.avg("possession_duration_sec").alias("mean_seconds"),
    )
    whole = F.sum("seconds").over(Window.partitionBy("match_id"))
    return out.join(clock, "match_id").withColumns(
        {"share": F.when(whole > 0, F.col("seconds") / whole * 100), "dead_time": F.greatest(F.col("clock") - whole, F.lit(0.0))}
    ).drop("clock")


def possession_clock(ev: DataFrame) -> DataFrame:
    """Pure possession, the mean length of a possession and dead time as mm:ss; the share of the ball with a decimal."""
    x = possession(ev)
    return x.select(
        *TEAM, F.expr(clock("seconds")).alias("seconds"), F.expr(clock("mean_seconds")).alias("mean_seconds"),
        F.expr(clock("dead_time")).alias("dead_time"), F.expr(rounded("share", 1)).alias("share")
    )


def tempo(ev: DataFrame) -> DataFrame:
    """Passes a minute of the team's own possession, with one decimal; 0 for a team that never held the ball."""
    passed = ev.groupBy(*TEAM).agg(F.expr(M.PASSES["passes"]).alias("passes"))
    held = first_events(ev).groupBy("match_id", F.col("possession_team_name").alias("team_name")).agg(F.sum("possession_duration_sec").alias("sec"))
    value = "case when sec > 0 then " + rounded("passes / (sec / 60)", 1) + " else 0e0 end"
    return passed.join(held, TEAM, "left").select(*TEAM, F.expr(value).alias("tempo"))


def report(ev: DataFrame) -> DataFrame:
    """A match's general metrics in rows, in the report's fixed order, with both teams side by side."""
    names = [*M.GENERAL, "fouls_suffered"]
    sides = ev.groupBy("match_id").agg(F.min("home_team_name").alias("home"))
    tall = general(ev).unpivot(TEAM, [F.col(c).cast("double").alias(c) for c in names], "metric", "value").join(sides, "match_id")
    order = F.array_position(F.array(*map(F.lit, names)), F.col("metric")).alias("ord")
    home = F.col("team_name") == F.col("home")
    return tall.groupBy("match_id", order, "metric").agg(F.max(F.when(home, F.col("value"))).alias("home"), F.max(F.when(~home, F.col("value"))).alias("away"))


def open_play(ev: DataFrame) -> DataFrame:
    """Possessions that begin in open play, by length; those of unknown length count in the total only."""
    first = first_per_key(
        ev.where("match_ts is not null"), ["match_id", "possession_id"], "match_ts", "seq"
    ).where("type_primary not in ('corner', 'free_kick', 'goal_kick', 'throw_in', 'penalty')")
    d = "possession_duration_sec"
    return first.groupBy("match_id", F.col("possession_team_name").alias("team_name")).agg(
        F.count("*").alias("total"),
        *(
            F.expr(M.n(c)).alias(k) for k,
            c in (("to_10", f"{d} <= 10"), ("to_20", f"{d} > 10 and {d} <= 20"), ("to_45", f"{d} > 20 and {d} <= 45"), ("over_45", f"{d} > 45"))
        )
    )


def passes(ev: DataFrame) -> DataFrame:
    return ev.groupBy(*TEAM).agg(*aggregates(M.PASSES))


def attacks(ev: DataFrame) -> DataFrame:
    """Positional attacks, final-third and box entries, and counter-attacks of every team of every match.

    One row a possession and team says what it was; it counts for its team, and the possession's first event for the
    team that held the ball."""
    here = [*TEAM, "possession_id"]
    dist = F.expr(goal_distance("location_x", "location_y"))
    opening = Window.partitionBy("match_id", "possession_id").orderBy("seq")
    start = Window.partitionBy(*here).orderBy(F.col("match_ts").asc_nulls_last(), "seq")
    timed = ev.withColumns(
        {
            "place": F.row_number().over(opening), "t0": F.first("match_ts").over(start), "type0": F.first("type_primary").over(start),
            "d0": F.first(dist).over(start)
        }
    )
    soon = F.expr("match_ts is not null and type0 in ('interception', 'duel', 'clearance', 'goalkeeper_exit') and d0 >= 40 and match_ts - t0 <= 5")
    each = timed.groupBy(*here).agg(
        F.min("location_x").alias("lo"), F.max("location_x").alias("hi"), F.max(F.expr(IN_BOX)).alias("box"),
        F.max(F.when(soon, F.col("d0"))).alias("from_"), F.min(F.when(soon, dist)).alias("to_"),
        F.max(F.when(F.col("place") == 1, F.col("possession_team_name"))).alias("holder"), F.max(
            F.when(F.col("place") == 1, F.col("possession_attack_flank"))
        ).alias("flank"),
    )
    own = {"final_third_entries": F.expr("lo < 66 and hi >= 66"), "box_entries": F.col("box"), "counter_attacks": F.col("from_") - F.col("to_") >= 30}
    held = F.col("flank").isin("central", "left", "right")
    side = lambda name, mine: F.struct(
        F.col(name).alias("team_name"), F.lit(int(mine)).alias("own"),
        F.coalesce((held if not mine else F.lit(False)).cast("int"), F.lit(0)).alias("positional_attacks"),
        *(F.coalesce((c if mine else F.lit(False)).cast("int"), F.lit(0)).alias(k) for k, c in own.items())
    )
    counts = each.select("match_id", F.inline(F.array(side("team_name", True), side("holder", False)))).groupBy(*TEAM).agg(
        F.max("own").alias("own"), *(F.sum(c).alias(c) for c in ("positional_attacks", *own))
    )
    return counts.where("own = 1").drop("own")


def players(ev: DataFrame) -> DataFrame:
    """By player name within a team. The first eleven to appear play until their last event; others from their first on."""
    keys = [*TEAM, "player_name"]
    own = ev.groupBy(*keys).agg(
        *aggregates(M.PLAYER_MATCH), F.min("seq").alias("first_seq"), F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute")
    )
    own = own.withColumn(
        "end", F.max("last_minute").over(Window.partitionBy("match_id"))
    ).where("player_name is not null")  # events without a player end a match too
    order = F.row_number().over(Window.partitionBy(*TEAM).orderBy("first_seq"))
    minutes = F.when(F.col("place") <= 11, F.col("last_minute")).otherwise(F.col("end") - F.col("first_minute"))
    return own.withColumn("place", order).withColumn("minutes", minutes.cast("long")).drop("first_seq", "first_minute", "last_minute", "place", "end")
