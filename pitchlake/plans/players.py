"""Season reports of players: minutes, positions, expected assists, threat, goalkeeping, per-90 values, archetypes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pitch import threat
from ..operators.ranking import WINDOW_ROWS, average_share, dense_from_top, ranked
from ..operators.relational import next_value, top_k, united
from ..sources.scratch import written
from . import metrics as M
from .match import aggregates
from .match import players as match_players


def minutes_from_lineups(lineups: DataFrame, length: DataFrame) -> DataFrame:
    """lineups: match_id, team_id, lineup (array of player ids), substitutions (array of player_in, player_out, minute);
    length: match_id, minutes. Starters play until they go off (their last entry counts), others from their minute on."""
    x = lineups.join(length, "match_id", "left").withColumn("minutes", F.coalesce("minutes", F.lit(90)))
    subs = F.coalesce("substitutions", F.array().cast("array<struct<player_in:bigint,player_out:bigint,minute:int>>"))
    off = x.select("match_id", "team_id", F.posexplode(subs).alias("i", "s")).groupBy(
        "match_id", "team_id", F.col("s.player_out").alias("player_id")
    ).agg(F.max_by("s.minute", "i").alias("off"))
    starters = x.select(
        "match_id", "team_id", "minutes", F.explode("lineup").alias("player_id")
    ).join(off, ["match_id", "team_id", "player_id"], "left").select("player_id", "team_id", F.coalesce("off", "minutes").alias("minutes"))
    later = x.select("team_id", "minutes", F.explode(subs).alias("s")).select(
        F.col("s.player_in").alias("player_id"), "team_id", (F.col("minutes") - F.col("s.minute")).alias("minutes")
    )
    return starters.unionByName(later).groupBy("player_id", "team_id").agg(F.sum("minutes").cast("long").alias("total_minutes"))


def minutes(ev: DataFrame) -> DataFrame:
    """Where there are no lineups: the sum of the minutes of the match reports."""
    return match_players(ev).groupBy("team_name", "player_name").agg(F.sum("minutes").alias("total_minutes"))


def positions(ev: DataFrame) -> DataFrame:
    """The three most frequent positions of each player; ties go to the one seen first."""
    counts = ev.where(
        "player_id is not null and player_position is not null"
    ).groupBy("player_id", "player_position").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    top = top_k(counts, ["player_id"], 3, F.desc("n"), F.asc("first"))
    return top.groupBy("player_id").pivot("rank", [1, 2, 3]).agg(F.first("player_position")).toDF(
        "player_id", "primary_position", "secondary_position", "tertiary_position"
    )


def assisted(ev: DataFrame) -> DataFrame:
    """Adds xa_cents and xa_kind: a shot assist takes the expected goals of the next shot of its match, none if that is a
    penalty; from a set piece (xasp) or open play (xaop)."""
    shot = F.when(F.col("shot_cents").isNotNull(), F.struct("shot_cents", F.col("type_primary").alias("kind")))
    after = ev.withColumn("next_shot", next_value(shot, "match_id", "seq"))
    assist = F.expr("array_contains(split(tags, ','), 'shot_assist') and next_shot.kind <> 'penalty'")
    kind = F.when(F.col("type_primary").isin("corner", "free_kick", "throw_in", "goal_kick"), "xasp").otherwise("xaop")
    return after.withColumns({"xa_cents": F.when(assist, F.col("next_shot.shot_cents")), "xa_kind": F.when(assist, kind)}).drop("next_shot")


def npxg_xa(ev: DataFrame) -> DataFrame:
    """Expected goals without penalties, and expected assists, of players with any."""
    x = assisted(ev).where("type_primary <> 'penalty' and shot_cents is not null or xa_kind is not null").groupBy("player_id").agg(
        *(
            F.coalesce(F.sum(F.when(F.expr(c), F.col(x))), F.lit(0)).alias(k) for k, c,
            x in (("np", "type_primary <> 'penalty'", "shot_cents"), ("xaop", "xa_kind = 'xaop'", "xa_cents"), ("xasp", "xa_kind = 'xasp'", "xa_cents"))
        )
    )
    return x.select(
        "player_id", (F.col("np") / 50000).alias("npxg"), (F.col("xaop") / 50000).alias("xaop"), (F.col("xasp") / 50000).alias("xasp"),
        ((F.col("xaop") + F.col("xasp")) / 50000).alias("xa")
    )


def counting(ev: DataFrame) -> DataFrame:
    out = ev.where("player_id is not null").groupBy("player_id").agg(*aggregates(M.COUNTING))
    return out.withColumns({k: F.expr(x) for k, x in M.RATIOS.items()})


GOALKEEPING = ("faced", "conceded", "exits", "recoveries", "passes", "long_passes", "prevented", "prevented_per_shot", "psxg")


def faced_shots(ev: DataFrame) -> DataFrame:
    """Shots on target by the keeper who faced them: number, goals, and 100 times their value."""
    on_target = ev.where("shot_on_target and shot_gk_id is not null")
    return on_target.groupBy(F.col("shot_gk_id").alias("player_id")).agg(
        F.count("*").alias("faced"), F.expr(M.n("shot_is_goal")).alias("conceded"), F.sum("shot_cents").alias("cents")
    )


def goalkeepers(ev: DataFrame) -> DataFrame:
    """Of every player seen in goal: shots on target faced, what was expected and conceded, and play with the ball."""
    own = ev.where("player_id is not null").groupBy("player_id").agg(
        F.max(
            F.coalesce(F.col("player_position") == "GK", F.lit(False))
        ).alias("keeper"), F.expr(M.n("type_primary = 'goalkeeper_exit'")).alias("exits"), F.expr(M.n(M.exact("recovery"))).alias("recoveries"),
        F.expr(M.n("type_primary = 'pass'")).alias("passes"), F.expr(M.n(M.exact("long_pass"))).alias("long_passes"),
    )
    x = own.where("keeper").drop("keeper").join(faced_shots(ev), "player_id", "left").na.fill(0, ["faced", "conceded", "cents"])
    return x.withColumn("prevented", F.col("cents") / 45000 - F.col("conceded")).withColumn(
        "prevented_per_shot", F.when(F.col("faced") > 0, F.col("prevented") / F.col("faced")).otherwise(0.0)
    ).withColumn("psxg", F.col("cents") / 45000).drop("cents")


_ARRAY, _AT = "array({})", "element_at({}, {})"


def threatened(ev: DataFrame) -> DataFrame:
    """Adds gain: the positive gain of threat of an accurate pass, a touch or an acceleration, in hundredths; null for
    other events and where no end is known. A pass ends where the pass does, the others where the carry does."""
    passed = F.col("type_primary") == "pass"
    x = ev.withColumns({f"end_{c}": F.when(passed, F.col(f"pass_end_{c}")).otherwise(F.col(f"carry_end_{c}")) for c in "xy"})
    gain = F.expr(threat("end_x", "end_y", _ARRAY, _AT)) - F.expr(threat("location_x", "location_y", _ARRAY, _AT))
    moved = F.expr("(type_primary in ('touch', 'acceleration') or type_primary = 'pass' and pass_accurate) and end_x is not null and end_y is not null")
    return x.withColumn("gain", F.when(moved, F.greatest(gain, F.lit(0)))).drop("end_x", "end_y")


def expected_threat(ev: DataFrame) -> DataFrame:
    return threatened(ev).where("gain is not null and player_id is not null").groupBy("player_id").agg((F.sum("gain") / 100).alias("xt"))


def lineups(ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lineups and match lengths as `minutes_from_lineups` takes them, from events alone: the first eleven players of a
    team to appear start; the next ones come on when they first appear, for the starters in the same order."""
    first = ev.where("player_id is not null").groupBy("match_id", "team_name", "player_id").agg(F.min("seq").alias("s"), F.min("minute").alias("minute"))
    seen = first.groupBy("match_id", F.col("team_name").alias("team_id")).agg(F.array_sort(F.collect_list(F.struct("s", "player_id", "minute"))).alias("p"))
    off = lambda i: F.when(i < 11, F.get("p", i)["player_id"])
    subs = F.transform(
        F.slice("p", F.lit(12), F.size("p")), lambda x,
        i: F.struct(x["player_id"].alias("player_in"), off(i).alias("player_out"), x["minute"].alias("minute"))
    )
    start = F.transform(F.slice("p", 1, 11), lambda x: x["player_id"])
    return seen.select("match_id", "team_id", start.alias("lineup"), subs.alias("substitutions")), ev.groupBy("match_id").agg(F.max("minute").alias("minutes"))


def lineup_minutes(ev: DataFrame) -> DataFrame:
    return minutes_from_lineups(*lineups(ev))


def played_minutes(ev: DataFrame) -> DataFrame:
    """What `lineup_minutes` says, by windows within a match, which need no lineups and no joins: a player among the first
    eleven of a team to appear stays until the one eleven places later comes on, others from their first minute on."""
    seen = ev.groupBy("match_id", "team_name", "player_id").agg(F.min("seq").alias("s"), F.min("minute").alias("on"), F.max("minute").alias("last"))
    seen = seen.withColumn("end", F.max("last").over(Window.partitionBy("match_id"))).where("player_id is not null")
    order = Window.partitionBy("match_id", "team_name").orderBy("s")
    off = F.coalesce(F.lead("on", 11).over(order), "end")
    x = seen.withColumns({"place": F.row_number().over(order), "off": off})
    minutes = F.when(F.col("place") <= 11, F.col("off")).otherwise(F.col("end") - F.col("on"))
    return x.groupBy("player_id", F.col("team_name").alias("team_id")).agg(F.sum(minutes).cast("long").alias("total_minutes"))


#: Metrics of a player table that are not scaled to 90 minutes.
FIXED = (*M.RATIOS, "gk_prevented_per_shot")
TABLE = [*(c for c in (*M.COUNTING, *M.RATIOS) if c != "npxg"), "npxg", "xaop", "xasp", "xa", "xt", *(f"gk_{c}" for c in GOALKEEPING)]


def player_table(ev: DataFrame) -> DataFrame:
    """One row a player id with every metric of TABLE (0 where there is none), the name (the last by alphabet), the team
    with most minutes (ties to the first by alphabet), minutes over all teams, and positions (null if none is known).

    What can be counted from a player's own events is one aggregation: `counting`, `npxg_xa`, `expected_threat` and most
    of `goalkeepers`, after one window for the next shot."""
    own = threatened(assisted(ev)).where("player_id is not null").groupBy("player_id").agg(
        *aggregates({k: x for k, x in M.COUNTING.items() if k != "npxg"}),
        *(
            F.coalesce(F.sum(F.when(F.expr(c), F.col(x))), F.lit(0)).alias(k) for k, c,
            x in (
                ("np", "type_primary <> 'penalty'", "shot_cents"), ("ao", "xa_kind = 'xaop'", "xa_cents"), ("sp", "xa_kind = 'xasp'", "xa_cents"),
                ("threat", "true", "gain")
            )
        ),
        F.max("player_name").alias("player_name"), F.max(F.coalesce(F.col("player_position") == "GK", F.lit(False))).alias("keeper"),
        F.expr(M.n("type_primary = 'goalkeeper_exit'")).alias("exits"),
    )
    own = own.selectExpr(
        "*", *(f"{x} as {k}" for k, x in M.RATIOS.items()), "np / 50000 as npxg", "ao / 50000 as xaop", "sp / 50000 as xasp", "(ao + sp) / 50000 as xa",
        "threat / 100 as xt"
    )
    played = played_minutes(ev).groupBy("player_id").agg(
        F.min_by("team_id", F.struct(-F.col("total_minutes"), "team_id")).alias("team_name"), F.sum("total_minutes").alias("total_minutes")
    )
    first = positions(ev).select("player_id", F.col("primary_position").alias("position"))
    x = united("player_id", own=own, shots=faced_shots(ev), played=played, seen=first).where("own is not null")
    faced, conceded, cents = (f"coalesce(shots.{c}, 0)" for c in ("faced", "conceded", "cents"))
    prevented = f"({cents} / 45000 - {conceded})"
    keeping = {
        "faced": faced, "conceded": conceded, "prevented": prevented, "prevented_per_shot": f"case when {faced} > 0 then {prevented} / {faced} else 0e0 end",
        "psxg": f"{cents} / 45000"
    } | {c: f"own.{c}" for c in ("exits", "recoveries", "passes", "long_passes")}
    values = {c: f"own.{c}" for c in TABLE if not c.startswith("gk_")} | {f"gk_{c}": f"case when own.keeper then {x} end" for c, x in keeping.items()}
    return x.selectExpr(
        "player_id", "own.player_name", "played.team_name", "cast(coalesce(played.total_minutes, 0) as bigint) as total_minutes", "seen.position",
        *(f"coalesce(cast({values[c]} as double), 0e0) as {c}" for c in TABLE)
    )


def per_90(ev: DataFrame) -> DataFrame:
    """The player table with all metrics but ratios by 90 minutes; 0 without minutes."""
    scaled = (c if c in FIXED else f"case when total_minutes > 0 then {c} / total_minutes * 90 else 0e0 end as {c}" for c in TABLE)
    return player_table(ev).selectExpr("player_id", "player_name", "team_name", "total_minutes", "position", *scaled)


#: An example of roles: positions, and weights of metrics. Pass your own to archetype_scores, or a table of them.
ROLES = {
    "Finisher": (("CF", "SS", "AMF"), {"goals": 10, "shots": 3, "xg_per_shot": 2, "npxg": 4}),
    "Link": (("CF", "AMF", "DMF", "LCMF", "RCMF"), {"passes": 5, "dribbles": 2, "losses": 3, "xa": 3, "loss_index": 1}),
    "Runner": (("LW", "RW", "LWF", "RWF", "LAMF", "RAMF"), {"progressive_runs": 4, "dribbles_pct": 3, "xt": 4, "crosses": 2}),
    "Flank": (("LB", "RB", "LWB", "RWB", "LB5", "RB5"), {"crosses_ok": 3, "xaop": 2, "defensive_duels_pct": 3, "interceptions": 2}),
    "Stopper": (("CB", "LCB", "RCB", "DMF"), {"interceptions": 6, "recoveries": 4, "aerial_duels_pct": 2, "losses": 1}),
    "Keeper": (("GK",), {"gk_prevented_per_shot": 6, "gk_conceded": 3, "gk_exits": 1, "passes_pct": 1}),
}
INVERTED = ("losses", "loss_index", "gk_conceded")
Roles = Mapping[str, tuple[Sequence[str], Mapping[str, float]]] | DataFrame
ROLE_TABLE = "role_id int, role string, positions array<string>, ord int, metric string, weight double, inverted boolean"


def roles_table(spark: SparkSession, roles: Roles = ROLES, inverted: Sequence[str] = INVERTED) -> DataFrame:
    """Roles as a table, a row a metric of a role (ROLE_TABLE): role_id orders the roles, ord a role's metrics. A table is
    taken as it is, so that roles can come from a file, any number of them."""
    if isinstance(roles, DataFrame):
        return roles
    rows = [
        (i, role, list(at), j, metric, float(weight), metric in inverted)
        for i, (role, (at, weights)) in enumerate(roles.items()) for j, (metric, weight) in enumerate(weights.items())
    ]
    return spark.createDataFrame(rows, ROLE_TABLE)


def qualified(ev: DataFrame, least_minutes: int) -> DataFrame:
    """Per-90 values of players with enough minutes, written: ranks read them more than once."""
    return written(per_90(ev).where(F.col("total_minutes") >= least_minutes), "players")


def role_rows(stats: DataFrame, roles: DataFrame, most_rows: int | None = None) -> DataFrame:
    """stats: players with metrics; roles: as ROLE_TABLE. A row for each player, role of its position and metric of that role:
    weight, value, percentile p (inverted where less is better), and what `rank_table` says of the value in the role.

    Metrics become rows and meet the roles by (position, metric), so the plan is the same for any number of roles. A role's
    metric that the players don't have is left out. most_rows: at least the number of players (see `ranked`)."""
    names = [c for c in stats.columns if c not in ("player_id", "player_name", "team_name", "total_minutes", "position")]
    values = stats.unpivot(["player_id", "player_name", "team_name", "position"], names, "metric", "value")
    places = roles.withColumn("position", F.explode(F.array_distinct("positions"))).drop("positions")
    rows = values.join(places, ["position", "metric"]).drop("position")
    rows = ranked(rows, "value", "role_id", "metric", most_rows=most_rows, p=average_share(), below=F.col("below"), of=F.col("of"), low=F.col("low"), high=F.col("high"))
    return rows.withColumn("p", F.when(F.col("inverted"), 1 - F.col("p")).otherwise(F.col("p")))


def role_scores(rows: DataFrame, per_archetype: bool = False, most_rows: int | None = None) -> DataFrame:
    """Per player and role of `role_rows`: total, score and place in the role. most_rows: at least the number of players."""
    # a player's rows meet once, for the percentiles that hold and for the totals
    rows = rows.repartition("player_id")
    p = F.col("p") if per_archetype else F.max_by("p", "role_id").over(Window.partitionBy("player_id", "metric"))
    # percentiles and weights in millionths: their sums don't depend on the order of rows
    part = F.floor(F.coalesce(p, F.lit(0.0)) * F.col("weight") * 1000000 + 0.5).cast("long")
    totals = rows.withColumn("part", part).groupBy("player_id", "role_id", "role").agg((F.sum("part") / 1000000).alias("total"))
    score = F.when(F.col("high") > F.col("low"), (F.col("total") - F.col("low")) / (F.col("high") - F.col("low")) * 100.0).otherwise(0.0)
    if most_rows is not None and most_rows <= WINDOW_ROWS:
        role = Window.partitionBy("role_id")
        scores = totals.withColumns({"low": F.min("total").over(role), "high": F.max("total").over(role)}).withColumn("score", score)
    else:
        totals = written(totals, "totals")
        scores = totals.join(totals.groupBy("role_id").agg(F.min("total").alias("low"), F.max("total").alias("high")), "role_id").withColumn("score", score)
    return ranked(scores.drop("low", "high"), "score", "role_id", most_rows=most_rows, place=dense_from_top())


def archetype_scores(
    ev: DataFrame, roles: Roles = ROLES, inverted: Sequence[str] = INVERTED, least_minutes: int = 90, per_archetype: bool = False
) -> DataFrame:
    """Per player and role: the weighted percentiles (total), their place between the role's least and greatest (score),
    and the rank (place). A player whose position is not of the role has 0 in all three.

    A player's percentile in a metric is that among the positions of the last role, in order, that has the player's
    position and the metric; with `per_archetype` that of the role itself. `roles`: name → (positions, weights), or a table
    (see roles_table)."""
    table = roles_table(ev.sparkSession, roles, inverted)
    stats = qualified(ev, least_minutes)
    n = stats.count()
    found = role_scores(role_rows(stats, table, n), per_archetype, n).select("player_id", "role", "total", "score", "place")
    every = table.agg(F.sort_array(F.collect_set("role")).alias("roles"))  # one row
    pairs = stats.select("player_id", "player_name", "team_name").crossJoin(F.broadcast(every)).withColumn("role", F.explode("roles")).drop("roles")
    return pairs.join(found, ["player_id", "role"], "left").select(
        "player_id", "role", "player_name", "team_name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "score", "place"))
    )


def best_role(ev: DataFrame, roles: Roles = ROLES, inverted: Sequence[str] = INVERTED, least_minutes: int = 90) -> DataFrame:
    """Of each player with a role of its position: the role with the greatest score, the first in order if several have it."""
    table = roles_table(ev.sparkSession, roles, inverted)
    stats = qualified(ev, least_minutes)
    n = stats.count()
    scores = role_scores(role_rows(stats, table, n), most_rows=n)
    top = F.max(F.struct("score", (-F.col("role_id")).alias("i"), "role")).alias("top")
    return scores.groupBy("player_id").agg(top).select("player_id", "top.role", "top.score")
