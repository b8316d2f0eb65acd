"""The stream table `events` read as a football event table, by fixed integer formulas.

The formulas are SQL expressions that Spark and other SQL engines evaluate alike, in three layers: each may use the
columns of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POSITIONS = "CF,SS,LCMF,RCMF,AMF,LCMF3,RCMF3,DMF,LDMF,RDMF,RAMF,LAMF,LW,RW,LWF,RWF,LWB,RWB,LB,RB,LB5,RB5,LCB,RCB,CB,LCB3,RCB3"
KEYS = {
    "seq": "event_id",
    "e": "event_id",
    "u": "user_id",
    "cents": "cast(round(value * 100) as bigint)",
    "m": "cast(floor(event_id / 100) as bigint)",
    "ps": "cast(floor(event_id / 5) as bigint)",
    "k": "(31 * event_id + 17 * user_id) % 20",
}
TEAMS = {
    "h": "m % 20",
    "a": "(m % 20 + 1 + (7 * m) % 19) % 20",
    "tp": "case when k < 8 then 'pass' when k < 11 then 'duel' when k < 13 then 'shot' when k = 13 then 'touch' when k = 14 then 'interception' "
    "when k = 15 then 'clearance' when k = 16 then 'corner' when k = 17 then 'infraction' when k = 18 then 'free_kick' "
    "else split_part('acceleration,offside,throw_in,goalkeeper_exit,goal_kick,penalty', ',', cast((7 * cast(floor(e / 2) as bigint) + u) % 6 + 1 as int)) end",
}
_SHOT = "tp in ('shot', 'penalty')"
_TAGS = [
    ("cross", "tp = 'pass' and (3 * e + u) % 11 = 0"),
    ("cross_low", "tp = 'pass' and (3 * e + u) % 11 = 1"),
    ("smart_pass", "tp = 'pass' and (5 * e + u) % 13 = 0"),
    ("shot_assist", "tp in ('pass', 'corner') and (7 * e + u) % 10 = 0"),
    ("through_pass", "tp = 'pass' and (11 * e + u) % 14 = 0"),
    ("long_pass", "tp = 'pass' and (13 * e + u) % 6 = 0"),
    ("pass_to_final_third", "tp = 'pass' and (17 * e + u) % 5 = 0"),
    ("pass_to_penalty_area", "tp = 'pass' and (19 * e + u) % 9 = 0"),
    ("forward_pass", "tp = 'pass' and (23 * e + u) % 3 = 0"),
    ("back_pass", "tp = 'pass' and (23 * e + u) % 3 = 1"),
    (None, "tp = 'duel'"),
    ("dribble", "tp = 'duel' and (29 * e + u) % 4 = 0"),
    ("loss", "(31 * e + u) % 9 = 0"),
    ("recovery", "(37 * e + u) % 8 = 0"),
    ("counterpressing_recovery", "(37 * e + u) % 16 = 0"),
    ("assist", "(41 * e + u) % 40 = 0"),
    ("second_assist", "(43 * e + u) % 60 = 0"),
    ("touch_in_box", "(47 * e + u) % 30 = 0"),
    ("progressive_run", "(53 * e + u) % 25 = 0"),
    ("foul_suffered", "(59 * e + u) % 45 = 0"),
    ("penalty_shot", "tp = 'shot' and (61 * e + u) % 12 = 0"),
]
_DUEL_TAG = "split_part('offensive_duel,defensive_duel,sliding_tackle,aerial_duel', ',', cast((3 * e + u) % 4 + 1 as int))"
_when = lambda cond, value: f"case when {cond} then {value} end"
EVENT = {
    "seq": "seq",
    "event_id": "e",
    "match_id": "m",
    "match_ts": "cast((e % 100) * 2 as double)",
    "minute": "cast(floor((e % 100) * 95 / 100) as int)",
    "type_primary": "tp",
    "tags": "concat_ws(',', " + ", ".join(_when(c, f"'{t}'" if t else _DUEL_TAG) for t, c in _TAGS) + ")",
    "team_name": "concat('Team_', case when u % 2 = 0 then h else a end)",
    "opponent_team_name": "concat('Team_', case when u % 2 = 0 then a else h end)",
    "home_team_name": "concat('Team_', h)",
    "away_team_name": "concat('Team_', a)",
    "player_id": "u",
    "player_name": "case when e % 53 = 0 then null else concat('Player_', u) end",
    "player_position": f"case when u % 15 = 0 then 'GK' else split_part('{POSITIONS}', ',', cast((u + case when e % 7 < 4 then 0 when e % 7 < 6 then 1 else 2 end) % 27 + 1 as int)) end",
    "location_x": "case when e % 47 = 0 then null else cast((37 * e + 11 * u) % 101 as double) end",
    "location_y": "cast((53 * e + 29 * u) % 101 as double)",
    "possession_id": "ps",
    "possession_event_index": "e % 5",
    "possession_duration_sec": "case when ps % 23 = 0 then null else cast((7 * ps) % 60 as double) + 0.5e0 end",
    "possession_team_name": "concat('Team_', case when ps % 2 = 0 then h else a end)",
    "possession_attack_flank": "case ps % 5 when 0 then 'central' when 1 then 'left' when 2 then 'right' when 3 then 'none' end",
    "pass_accurate": _when("tp = 'pass'", "(17 * e) % 5 <> 0"),
    "pass_length": _when("tp in ('pass', 'corner')", "cast((19 * e + 3 * u) % 60 as double)"),
    "pass_height": _when("tp = 'pass'", "split_part('low,high,ground', ',', cast(e % 3 + 1 as int))"),
    "pass_end_x": _when("tp in ('pass', 'corner') and e % 59 <> 0", "cast((71 * e + 13 * u) % 101 as double)"),
    "pass_end_y": _when("tp in ('pass', 'corner') and e % 59 <> 0", "cast((43 * e + 19 * u) % 101 as double)"),
    "carry_end_x": _when("tp in ('touch', 'acceleration')", "cast((73 * e + 23 * u) % 101 as double)"),
    "carry_end_y": _when("tp in ('touch', 'acceleration')", "cast((79 * e + 31 * u) % 101 as double)"),
    "shot_cents": _when(_SHOT, "cents"),
    "shot_is_goal": _when(_SHOT, "(13 * e) % 9 = 0"),
    "shot_on_target": _when(_SHOT, "(13 * e) % 9 = 0 or e % 3 = 0"),
    "shot_gk_id": _when(f"{_SHOT} and ((13 * e) % 9 = 0 or e % 3 = 0)", "((7 * u) % 10) * 15"),
    "gd_duel_type": _when("tp = 'duel'", "split_part('offensive_duel,defensive_duel,sliding_tackle,', ',', cast((3 * e + u) % 4 + 1 as int))"),
    "gd_kept_possession": _when("tp = 'duel'", "(5 * e + u) % 3 = 0"),
    "gd_recovered_possession": _when("tp = 'duel'", "(7 * e + u) % 4 = 0"),
    "gd_stopped_progress": _when("tp = 'duel'", "(9 * e + u) % 5 = 0"),
    "gd_take_on": _when("tp = 'duel'", "(29 * e + u) % 4 = 0"),
    "gd_progressed_with_ball": _when("tp = 'duel'", "(11 * e + u) % 3 = 0"),
    "ad_first_touch": _when("tp = 'duel'", "(13 * e + u) % 2 = 0"),
    "infraction_type": "case when e % 17 = 0 then 'foul_suffered' when tp = 'infraction' then 'regular_foul' end",
    "infraction_yellow": _when("tp = 'infraction'", "e % 5 = 0"),
    "infraction_red": _when("tp = 'infraction'", "e % 31 = 0"),
}


def football_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`shot_cents` holds 100 * value, an integer: expected goals are shot_cents / 50000, so their sums are exact.

    A table in fewer pieces than there are cores is dealt out by match before the formulas are computed; what is grouped by
    match later needs no further exchange then. Larger ones are read as they lie, and aggregated before they are exchanged."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*(f"{x} as {c}" for c, x in KEYS.items()))
    cores = spark.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        df = df.repartition(cores, "m")
    for layer, keep in ((TEAMS, True), (EVENT, False)):
        df = df.selectExpr(*(["*"] if keep else []), *(f"{x} as {c}" for c, x in layer.items()))
    return df


def _select(layer: dict[str, str], source: str, keep: bool) -> str:
    return "select " + ("*, " if keep else "") + ", ".join(f"{x} as {c}" for c, x in layer.items()) + f" from {source}"


#: The same table as common table expressions, the last named ev.
EV_SQL = f"with l1 as ({_select(KEYS, 'events', False)}), l2 as ({_select(TEAMS, 'l1', True)}), ev as ({_select(EVENT, 'l2', False)})"
