"""Explicit schemas of the tables, enumerations and inclusion rules.

Money is in integer cents: sums are exact and do not depend on their order; rates divide last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the tables' enumerations.
DATASETS = ("NL50", "NL200", "NL5K")
POSITIONS = ("LJ", "HJ", "CO", "BTN", "SB", "BB")
EARLY = ("LJ", "HJ", "CO", "BTN")
STREETS = ("preflop", "flop", "turn", "river")
POSTS = ("post_sb", "post_bb", "post_ante")
#: Years of the study: first and last. Every function that applies them takes others as ``years``.
STUDY_YEARS = (2011, 2025)

#: Columns of the tables, whose names must match.
HANDS = (
    "hand_id string, dataset string, timestamp timestamp_ntz, year long, month long, stakes_raw string, sb long, bb long, is_usd boolean, is_cap boolean, "
    "is_ante boolean, is_included boolean, is_primary boolean, table_name string, max_players long, button_seat long, num_players_dealt long, "
    "num_players_flop long, pot_total long, rake long, board_flop string, board_turn string, board_river string, last_street string, had_showdown boolean, source_file string"
)
PLAYERS = (
    "hand_id string, player_name string, seat long, position string, stack_start long, net_won long, hole_card_1 string, hole_card_2 string, showed_hand boolean, is_hero boolean"
)
ACTIONS = "hand_id string, action_index long, street string, player_name string, action_type string, amount long, to_call long, is_all_in boolean, raw_line string"
PARSE_ERRORS = "source_file string, hand_id string, error_type string, message string"


# Fixed rules: which hands the study counts.
def included_audit(years: tuple[int, int] = STUDY_YEARS) -> Column:
    """The audits' weaker rule: dollars, no cap game, a year of the study."""
    return F.col("is_usd") & ~F.col("is_cap") & F.col("year").between(*years)


def included(years: tuple[int, int] = STUDY_YEARS) -> Column:
    return included_audit(years) & ~F.col("is_ante") & (F.col("max_players") == 6)


def primary(years: tuple[int, int] = STUDY_YEARS) -> Column:
    return included(years) & (F.col("num_players_dealt") == 6)


def position_rank(position: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in POSITIONS]), position)
