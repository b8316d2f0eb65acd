"""Conditional aggregates over the event table: name → SQL. A group's metrics are one aggregation, one shuffle.

Counts are of rows for which the condition is true (null: not). Ratios guard against empty denominators. Expected goals
are exact: integers are summed and divided last.
"""

from __future__ import annotations

from ..functions.pitch import END_IN_BOX, IN_BOX, goal_distance, metres, micro


def n(cond: str) -> str:
    return f"count(case when {cond} then 1 end)"


def total(value: str, cond: str) -> str:
    return f"cast(coalesce(sum(case when {cond} then {value} end), 0) as bigint)"


def mean_micro(value: str, cond: str) -> str:
    """Mean of a value in millionths, null if there is none."""
    x = f"case when {cond} then {micro(value)} end"
    return f"cast(sum({x}) as double) / count({x}) / 1000000"


def ratio(a: str, b: str, scale: str = "") -> str:
    return f"case when ({b}) > 0 then cast({a} as double) / ({b}){scale} else 0e0 end"


XG = lambda cond: f"cast({total('shot_cents', cond)} as double) / 50000"
_SHOT, _PASS, _DUEL = "type_primary = 'shot'", "type_primary = 'pass'", "type_primary = 'duel'"
_DIST = goal_distance("coalesce(location_x, 100)", "coalesce(location_y, 50)")
_END_DIST = goal_distance("coalesce(pass_end_x, 100)", "coalesce(pass_end_y, 50)")
has = lambda tag: f"contains(tags, '{tag}')"  # noqa: E731  any tag with this text in it
exact = lambda tag: f"contains(concat(',', tags, ','), ',{tag},')"  # noqa: E731  this very tag
GROUND_WON = "(gd_kept_possession or gd_recovered_possession)"
AERIAL_WON = f"({has('aerial')} and ad_first_touch)"
RECOVERY = f"(type_primary in ('interception', 'clearance') or {_DUEL} and coalesce(gd_recovered_possession, false))"

GENERAL = {
    "goals": n(f"{_SHOT} and shot_is_goal"),
    "xg": XG(_SHOT),
    "shots": n(_SHOT),
    "shots_on_target": n(f"{_SHOT} and shot_on_target"),
    "box_shots": n(f"{_SHOT} and {IN_BOX}"),
    "box_shots_on_target": n(f"{_SHOT} and {IN_BOX} and shot_on_target"),
    "outside_shots": n(f"{_SHOT} and location_x < 83"),
    "outside_shots_on_target": n(f"{_SHOT} and location_x < 83 and shot_on_target"),
    "shot_distance": mean_micro(_DIST, _SHOT),
    "corners": n("type_primary = 'corner'"),
    "attacking_free_kicks": n(f"type_primary = 'free_kick' and {_DIST} <= 45"),
    "offsides": n("type_primary = 'offside'"),
    "fouls": n("type_primary = 'infraction'"),
    "yellow_cards": n("type_primary = 'infraction' and infraction_yellow"),
    "red_cards": n("type_primary = 'infraction' and infraction_red"),
}
DEFENCE = {
    "interceptions": n("type_primary = 'interception'"),
    "clearances": n("type_primary = 'clearance'"),
    "press_actions": n(
        f"location_x >= 40 and (type_primary in ('infraction', 'interception') or gd_duel_type = 'defensive_duel' and (coalesce(gd_recovered_possession, false) or coalesce(gd_stopped_progress, false)) or contains(gd_duel_type, 'sliding_tackle'))"
    ),
    "pressed_passes": n(f"{_PASS} and location_x >= 40"),
}
RECOVERIES = {
    "recoveries": n(RECOVERY),
    "recoveries_low": n(f"{RECOVERY} and coalesce(location_x, 0) <= 33.3e0"),
    "recoveries_mid": n(f"{RECOVERY} and coalesce(location_x, 0) between 33.3e0 and 66.6e0"),
    "recoveries_high": n(f"{RECOVERY} and coalesce(location_x, 0) > 66.6e0"),
    "recoveries_opponent_half": n(f"{RECOVERY} and location_x > 50"),
}
_LOST = "changed and coalesce(infraction_type, '') <> 'foul_suffered'"
_LOST_X = f"coalesce(case when {_PASS} and not pass_accurate then pass_end_x else location_x end, 0)"
LOSSES = {
    "losses": n(_LOST),
    "losses_low": n(f"{_LOST} and {_LOST_X} <= 33.3e0"),
    "losses_mid": n(f"{_LOST} and {_LOST_X} between 33.3e0 and 66.6e0"),
    "losses_high": n(f"{_LOST} and {_LOST_X} > 66.6e0"),
}
DUELS = {
    "duels": n(_DUEL),
    "duels_won": f"{n(f'{_DUEL} and {GROUND_WON}')} + {n(f'{_DUEL} and {AERIAL_WON}')}",
    "offensive_duels": n(f"{_DUEL} and gd_duel_type = 'offensive_duel'"),
    "offensive_duels_won": n(f"{_DUEL} and gd_duel_type = 'offensive_duel' and {GROUND_WON}"),
    "defensive_duels": n(f"{_DUEL} and gd_duel_type = 'defensive_duel'"),
    "defensive_duels_won": n(f"{_DUEL} and gd_duel_type = 'defensive_duel' and (gd_recovered_possession or gd_stopped_progress)"),
    "aerial_duels": n(f"{_DUEL} and {has('aerial')}"),
    "aerial_duels_won": n(f"{_DUEL} and {AERIAL_WON}"),
    "dribbles": n(f"{_DUEL} and gd_take_on"),
    "dribbles_won": n(f"{_DUEL} and gd_take_on and gd_progressed_with_ball"),
}
_KINDS = {
    "passes": "true",
    "forward_passes": "coalesce(pass_end_x, -1) > coalesce(location_x, -1)",
    "back_passes": "coalesce(pass_end_x, -1) < coalesce(location_x, -1)",
    "lateral_passes": "coalesce(pass_end_x, -1) = coalesce(location_x, -1)",
    "progressive_passes": "(location_x < 60 and pass_end_x >= 60 or location_x >= 60 and pass_end_x >= 60 and pass_length >= 10)",
    "long_passes": "pass_length > 40",
    "final_third_passes": "coalesce(location_x, 101) < 66.6e0 and coalesce(pass_end_x, 0) >= 66.6e0",
    "penalty_area_passes": END_IN_BOX,
    "smart_passes": has("smart_pass"),
    "shot_assists": has("shot_assist"),
    "through_passes": has("through_pass"),
    "crosses": has("cross"),
    "low_crosses": f"{has('cross')} and contains(pass_height, 'low')",
    "high_crosses": f"{has('cross')} and contains(pass_height, 'high')",
}
PASSES = {
    k: v for name, cond in _KINDS.items() for k,
    v in ((name, n(f"{_PASS} and {cond}")), (f"accurate_{name}", n(f"{_PASS} and {cond} and pass_accurate")))
} | {
    "deep_completions": n(f"{_PASS} and pass_accurate and {_END_DIST} <= 20 and not {has('cross')}"),
    "pass_length": mean_micro("pass_length", f"{_PASS} and pass_length is not null"),
    "final_third_pass_length": mean_micro("pass_length", f"{_PASS} and {_KINDS['final_third_passes']} and pass_length is not null"),
}
PLAYER_MATCH = {
    "goals": n(f"{_SHOT} and shot_is_goal"),
    "xg": XG(_SHOT),
    "actions": "cast(count(*) as bigint)",
    "actions_successful": n("coalesce(pass_accurate, false) or coalesce(shot_on_target, false)"),
    "shots": n(_SHOT),
    "shots_on_target": n(f"{_SHOT} and shot_on_target"),
    "passes": n(_PASS),
    "passes_accurate": n(f"{_PASS} and pass_accurate"),
    "crosses": n(f"{_PASS} and {has('cross')}"),
    "crosses_accurate": n(f"{_PASS} and {has('cross')} and pass_accurate"),
    "dribbles": n(f"{_DUEL} and gd_take_on"),
    "dribbles_successful": n(f"{_DUEL} and gd_take_on and gd_progressed_with_ball"),
    "duels": n(_DUEL),
    "duels_won": f"{n(f'{_DUEL} and {GROUND_WON}')} + {n(f'{_DUEL} and ad_first_touch')}",
    "recoveries": n(f"type_primary in ('interception', 'clearance') or {_DUEL} and {GROUND_WON}"),
    "recoveries_opponent_half": n(f"location_x > 50 and (type_primary in ('interception', 'clearance') or {_DUEL} and gd_recovered_possession)"),
    "losses": n(f"{_PASS} and not pass_accurate"),
    "losses_own_half": n(f"{_PASS} and not pass_accurate and coalesce(location_x, 101) <= 50"),
    "touches_in_box": n("type_primary = 'touch' and location_x >= 83"),
    "offsides": n("type_primary = 'offside'"),
    "yellow_cards": n("infraction_yellow"),
    "red_cards": n("infraction_red"),
}
_OK = "pass_accurate"
_TAGGED = {
    "long_passes": "long_pass", "crosses": "cross", "through_passes": "through_pass", "final_third_passes": "pass_to_final_third",
    "forward_passes": "forward_pass", "back_passes": "back_pass", "penalty_area_passes": "pass_to_penalty_area"
}
COUNTING = {
    "goals": n("shot_is_goal"),
    "shots": n(_SHOT),
    "shots_on_target": n("shot_on_target"),
    "interceptions": n("type_primary = 'interception'"),
    "clearances": n("type_primary = 'clearance'"),
    "fouls": n("type_primary = 'infraction'"),
    "offsides": n("type_primary = 'offside'"),
    "yellow_cards": n("infraction_yellow"),
    "red_cards": n("infraction_red"),
    **{
        k: n(exact(t)) for k,
        t in (
            ("assists", "assist"), ("touches_in_box", "touch_in_box"), ("progressive_runs", "progressive_run"), ("fouls_suffered", "foul_suffered"),
            ("second_assists", "second_assist")
        )
    },
    "passes": n(_PASS),
    "passes_ok": n(f"{_PASS} and {_OK}"),
    **{k: v for name, t in _TAGGED.items() for k, v in ((name, n(exact(t))), (f"{name}_ok", n(f"{exact(t)} and {_OK}")))},
    "duels": n(_DUEL),
    "duels_ok": n(f"{_DUEL} and (gd_kept_possession or gd_recovered_possession or ad_first_touch)"),
    "aerial_duels": n(exact("aerial_duel")),
    "aerial_duels_ok": n(f"{exact('aerial_duel')} and ad_first_touch"),
    "defensive_duels": n(exact("defensive_duel")),
    "defensive_duels_ok": n(f"{exact('defensive_duel')} and gd_recovered_possession"),
    "offensive_duels": n(exact("offensive_duel")),
    "offensive_duels_ok": n(f"{exact('offensive_duel')} and gd_progressed_with_ball"),
    "sliding_tackles": n(exact("sliding_tackle")),
    "sliding_tackles_ok": n(f"{exact('sliding_tackle')} and gd_recovered_possession"),
    "dribbles": n(exact("dribble")),
    "dribbles_ok": n(f"{exact('dribble')} and gd_take_on"),
    "losses": n(exact("loss")),
    "losses_opponent_half": n(f"{exact('loss')} and location_x >= 50"),
    "recoveries": n(exact("recovery")),
    "recoveries_opponent_half": n(f"{exact('recovery')} and location_x >= 50"),
    "counterpressing_recoveries": n(exact("counterpressing_recovery")),
    "xg": XG("shot_cents is not null"),
    "npxg": XG("type_primary <> 'penalty'"),
    "deep_completions": n(f"{_PASS} and pass_accurate and {metres('pass_end_x', 'pass_end_y', '100', '50')} <= 20 and not {exact('cross')}"),
    "progressive_passes": n(
        f"{_PASS} and pass_accurate and pass_end_x - location_x >= case when location_x < 50 and pass_end_x < 50 then 30 when location_x < 50 then 15 else 10 end"
    ),
}
#: Ratios of counts, times 100 but for the first; 0 if there is nothing to divide by.
RATIOS = {
    "xg_per_shot": ratio("xg", "shots"),
    **{f"{k}_pct": ratio(f"{k}_ok", k, " * 100") for k in ("passes", "long_passes", "crosses", "dribbles", "duels", "aerial_duels", "offensive_duels", "defensive_duels", "sliding_tackles")},
    "loss_index": ratio("losses", "shots_on_target + crosses_ok + dribbles_ok"),
}
_GAIN = f"({goal_distance('location_x', 'location_y')} - {goal_distance('pass_end_x', 'pass_end_y')})"
TEAM_FOR = {
    "matches": "cast(count(distinct match_id) as bigint)",
    "shots": n(_SHOT),
    "goals": n("shot_is_goal"),
    "xg": XG("shot_cents is not null"),
    "box_actions": n(IN_BOX),
    "box_passes": n(f"{_PASS} and {END_IN_BOX}"),
    "crosses": n(f"{_PASS} and {has('cross')}"),
    "dribbles": n(f"{_DUEL} and gd_take_on"),
    "passes": n(_PASS),
    "progressive_passes": n(
        f"{_PASS} and {_GAIN} >= case when location_x <= 50 and pass_end_x <= 50 then 30 when location_x <= 50 and pass_end_x > 50 then 15 when location_x > 50 and pass_end_x > 50 then 10 end"
    ),
    "directness": mean_micro(_GAIN, f"{_PASS} and location_x is not null and pass_end_x is not null"),
    "losses": n(_LOST),
    "aerial_duels": n(f"{_DUEL} and {has('aerial')}"),
    "aerial_duels_won": n(f"{_DUEL} and {AERIAL_WON}"),
    "defensive_duels": n("gd_duel_type = 'defensive_duel'"),
    "defensive_duels_won": n("gd_duel_type = 'defensive_duel' and (gd_recovered_possession or gd_stopped_progress)"),
    "interceptions": n("type_primary = 'interception'"),
    "fouls": n("type_primary = 'infraction'"),
    "press_actions": n(f"location_x >= 40 and type_primary in ('infraction', 'interception', 'duel')"),
}
TEAM_AGAINST = {
    "goals_against": n("shot_is_goal"),
    "xg_against": XG("shot_cents is not null"),
    "shots_against": n(_SHOT),
    "pressed_passes": n(f"{_PASS} and location_x >= 40"),
}
