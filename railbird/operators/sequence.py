"""Facts of hands from their action sequences.

The facts rest on one distribution by hand: hands, players and actions meet as one row per hand, and one pass over the sorted
actions of many hands gives every player's flags. The metrics at any grain are then plain group-bys of the flags. The single steps
(numbered raises, first actions, answers, check-raises) are also there as tables of their own, by windows over the hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railbird.plans.schema import POSTS, STREETS

VOLUNTARY = ("fold", "check", "call", "bet", "raise")


def primary_hands(hands: DataFrame) -> DataFrame:
    """Joins with it are hinted to sort and merge: a few columns of compressed files look small, and millions of hands would be broadcast through the driver."""
    return hands.filter("is_primary")


def primary_players(hands: DataFrame, players: DataFrame) -> DataFrame:
    h = primary_hands(hands).select("hand_id", "dataset", "year", "bb")
    return players.filter("position is not null").join(h.hint("merge"), "hand_id")


def primary_actions(hands: DataFrame, actions: DataFrame) -> DataFrame:
    h = primary_hands(hands).select("hand_id", "dataset", "year", "bb", "board_flop", "board_turn", "board_river", "num_players_flop")
    return actions.select("hand_id", "action_index", "street", "player_name", "action_type", "amount").join(h.hint("merge"), "hand_id")


def _is(*kinds: str) -> Column:
    return F.col("action_type").isin(*kinds)


def _pre() -> Column:
    return F.col("street") == "preflop"


def annotated(actions: DataFrame) -> DataFrame:
    """Primary actions with the sequence columns of their hand.

    raise_n counts preflop raises over the big blind up to the row, raises_before those before it, money_before says that
    somebody called, bet or raised before it. opener, three, four are (player, index) of the first
    three counted raises, pfa the last preflop raiser of any amount. All windows share the hand's partition.
    """
    hand = W.partitionBy("hand_id")
    so_far = hand.orderBy("action_index")
    before = so_far.rowsBetween(W.unboundedPreceding, -1)
    big = _pre() & _is("raise") & (F.col("amount") > F.col("bb"))
    a = actions.withColumns(
        {
            "big": big,
            "raises_before": F.coalesce(F.sum(big.cast("int")).over(before), F.lit(0)).cast("long"),
            "money_before": F.coalesce(F.max(_pre() & _is("call", "raise", "bet")).over(before), F.lit(False)),
        }
    )
    a = a.withColumn("raise_n", F.when(F.col("big"), F.col("raises_before") + 1))
    at = lambda n: F.max(F.when(F.col("raise_n") == n, F.struct("player_name", "action_index"))).over(hand)
    a = a.withColumns({"opener": at(1), "three": at(2), "four": at(3), "pfa": F.max(F.when(_pre() & _is("raise"), F.struct("action_index", "player_name"))).over(hand)["player_name"]})
    return a.withColumn("cbet_at", F.min(F.when((F.col("street") == "flop") & _is("bet") & (F.col("player_name") == F.col("pfa")), F.col("action_index"))).over(hand))


def preflop_raises(actions: DataFrame) -> DataFrame:
    return annotated(actions).filter("big").select("hand_id", "action_index", "player_name", "amount", "raise_n")


def preflop_aggressor(actions: DataFrame) -> DataFrame:
    a = actions.filter(_pre() & _is("raise"))
    return a.groupBy("hand_id").agg(F.max_by("player_name", "action_index").alias("pfa"))


def first_voluntary(actions: DataFrame) -> DataFrame:
    w = W.partitionBy("hand_id", "player_name").orderBy("action_index")
    a = actions.filter(_pre() & _is(*VOLUNTARY))
    return a.select("hand_id", "player_name", "action_index", "action_type", "amount", F.row_number().over(w).cast("long").alias("rn"))


def player_first(actions: DataFrame) -> DataFrame:
    """First voluntary action with the raises and the money before it; no join, a frame of the hand's window."""
    a = annotated(actions).filter(_pre() & _is(*VOLUNTARY))
    first = F.min(F.struct("action_index", "action_type", "amount", "raises_before", (~F.col("money_before")).alias("is_folded_to"))).alias("f")
    return a.groupBy("hand_id", "player_name").agg(first).select("hand_id", "player_name", "f.*")


def check_then_raise(actions: DataFrame) -> DataFrame:
    """(hand_id, street, player_name, opp, hit): checked and somebody else bet later; hit: and then raised.

    What follows a row is counted by windows that run backwards; bets of others are all bets less own ones.
    """
    back = lambda *keys: W.partitionBy(*keys).orderBy(F.desc("action_index")).rowsBetween(W.unboundedPreceding, -1)
    a = actions.filter(F.col("street").isin("flop", "turn", "river"))
    n = lambda kind, w: F.coalesce(F.sum(_is(kind).cast("int")).over(w), F.lit(0))
    every, own = back("hand_id", "street"), back("hand_id", "street", "player_name")
    a = a.withColumns({"others": n("bet", every) - n("bet", own), "raises_after": n("raise", own)}).filter(_is("check"))
    first = F.min(F.struct("action_index", "others", "raises_after"))
    g = a.groupBy("hand_id", "street", "player_name").agg(first.alias("f"))
    return g.select("hand_id", "street", "player_name", (F.col("f.others") > 0).alias("opp"), ((F.col("f.others") > 0) & (F.col("f.raises_after") > 0)).alias("hit"))


def _response(cond: Column) -> Column:
    return F.min(F.when(cond, F.struct("action_index", "action_type")))["action_type"]


def response_after_event(actions: DataFrame) -> DataFrame:
    """(hand_id, player_name, vs_3bet, vs_4bet): the opener's next action after a 3-bet, the 3-bettor's after a 4-bet."""
    act = _pre() & ~_is(*POSTS)
    r = annotated(actions).groupBy("hand_id", "player_name").agg(
        _response(act & (F.col("player_name") == F.col("opener.player_name")) & (F.col("action_index") > F.col("three.action_index"))).alias("vs_3bet"),
        _response(act & (F.col("player_name") == F.col("three.player_name")) & (F.col("action_index") > F.col("four.action_index"))).alias("vs_4bet"),
    )
    return r.filter("vs_3bet is not null or vs_4bet is not null")


def hand_rows(hands: DataFrame, players: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per primary hand: h (its own columns), ps (its seated players), acts (its actions in order).

    The three tables meet in one exchange by hand, as rows of one union; a hand is some 40 small rows. st is a street's number from 0, -1 for others.
    """
    h = primary_hands(hands).select(
        "hand_id",
        F.struct(
            "dataset", "year", "bb", (F.col("board_flop").isNotNull() & (F.col("num_players_flop") >= 2)).alias("flop_ok"), F.col("board_turn").isNotNull().alias("turn_ok"),
            F.col("board_river").isNotNull().alias("river_ok"),
        ).alias("h"),
    )
    p = players.filter("position is not null").select("hand_id", F.struct("player_name", "position", "net_won").alias("p"))
    street = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in STREETS]), F.col("street")) - 1, F.lit(-1)).cast("byte")
    a = actions.select("hand_id", F.struct(F.col("action_index").alias("i"), street.alias("st"), F.col("player_name").alias("p"), F.col("action_type").alias("t"), F.col("amount").alias("m")).alias("a"))
    u = h.unionByName(p, allowMissingColumns=True).unionByName(a, allowMissingColumns=True)
    g = u.groupBy("hand_id").agg(F.first("h", ignorenulls=True).alias("h"), F.collect_list("p").alias("ps"), F.array_sort(F.collect_list("a")).alias("acts"))
    return g.filter("h is not null")


#: Flags of a player in a hand, in the order of their bits.
_FLAGS = (
    "hand_first", "vpip", "pfr", "rfi_opp", "rfi_hit", "rfi_ft_opp", "rfi_ft_hit", "three_bet_opp", "three_bet_hit", "cold_four_bet_opp", "cold_four_bet_hit", "four_bet_opp", "four_bet_hit", "cbet_opp", "cbet_hit",
    "turn_cbet_opp", "turn_cbet_hit", "river_cbet_opp", "river_cbet_hit", "double_barrel", "triple_barrel", *[f"check_raise_{s}_{x}" for s in ("flop", "turn", "river") for x in ("opp", "hit")],
)
_ANSWERS = ("first_action", "vs_3bet", "vs_4bet", "bb_response", "cbet_response")
#: Stands for an index that is not there: later than all others.
_NEVER = 2**62


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The seated players of ``hand_rows`` with the bits of their flags and their first answers.

    All hands of a batch at once: actions lie hand by hand in their order, so a first or last action is where the first or last of its marks stands.
    """
    for b in batches:
        lists = {c: b.column(c) for c in ("ps", "acts")}
        hand, phand = (np.repeat(np.arange(b.num_rows), pc.list_value_length(lists[c]).to_numpy(zero_copy_only=False)) for c in ("acts", "ps"))
        act, seat, h = lists["acts"].flatten(), lists["ps"].flatten(), b.column("h")
        number = lambda x, missing: pc.fill_null(x, missing).to_numpy(zero_copy_only=False)
        i, st, m = number(act.field("i"), -_NEVER), number(act.field("st"), -1), number(act.field("m"), -_NEVER)
        bb, flop_ok, turn_ok, river_ok = number(h.field("bb"), _NEVER), *(number(h.field(f"{x}_ok"), False) for x in ("flop", "turn", "river"))
        kind = act.field("t")
        coded = kind.dictionary_encode()
        codes = number(coded.indices, -1)
        # The entry past the last stands for null.
        is_ = lambda *kinds: np.array([k in kinds for k in coded.dictionary.to_pylist()] + [False])[codes]
        names = pa.concat_arrays([act.field("p"), seat.field("player_name")]).dictionary_encode()
        who = number(names.indices, -1).astype(np.int64)
        many, me = max(1, len(names.dictionary)), who[len(act) :]
        who = who[: len(act)]
        # A player of a hand is one number; -1 is nobody.
        own = np.unique((phand * many + me)[me >= 0])
        place = lambda hands, codes: np.where(codes >= 0, hands * many + codes, -1)
        key = place(hand, who)
        slot = np.minimum(np.searchsorted(own, key), max(0, len(own) - 1))
        seated = own[slot] == key if len(own) else np.zeros(len(key), bool)

        def last(size, at, marks):
            """Place of the last marked action of each of ``size`` groups, -1 where there is none."""
            out, x = np.full(size, -1), np.flatnonzero(marks)
            out[at[x]] = x
            return out

        def first(size, at, marks):
            out, x = np.full(size, -1), np.flatnonzero(marks)[::-1]
            out[at[x]] = x
            return out

        def value(places, values, missing):
            return np.where(places >= 0, values[places], missing) if len(values) else np.full(len(places), missing)

        hands, players = len(bb), len(own)
        mine = lambda marks: first(players, slot, marks & seated)
        any_ = lambda marks: mine(marks) >= 0
        pre, raises, money = st == 0, is_("raise"), is_("call", "raise", "bet")
        big = pre & raises & (m > bb[hand])
        x = np.flatnonzero(big)
        nth = np.arange(len(x)) - np.searchsorted(hand[x], hand[x])
        raised = np.full((3, hands), -1)
        for n in range(3):
            raised[n, hand[x[nth == n]]] = x[nth == n]
        i1, i2, i3 = (value(r, i, _NEVER) for r in raised)
        n1, n2 = (value(r, who, -1) for r in raised[:2])
        pfa = value(last(hands, hand, pre & raises), who, -1)
        cbet = value(first(hands, hand, (st == 1) & is_("bet") & (who >= 0) & (who == pfa[hand])), i, _NEVER)
        response = first(hands, hand, (st == 1) & (i > cbet[hand]) & (who >= 0) & (pfa[hand] >= 0) & (who != pfa[hand]) & is_("fold", "call", "raise"))
        paid = value(first(hands, hand, pre & money), i, _NEVER)
        answers = pre & ~is_(*POSTS) & (codes >= 0)
        two = answers & (i > i2[hand]) & (i <= i3[hand])  # after two counted raises and before the third is past
        f = mine(pre & is_(*VOLUNTARY))
        first_answers = [mine(answers & (who == n1[hand]) & (i > i2[hand])), mine(answers & (who == n2[hand]) & (i > i3[hand])), mine(answers & (i > i1[hand]))]
        flags = {"vpip": any_(pre & money), "pfr": any_(pre & raises), "four_bet_opp": any_(two), "four_bet_hit": any_(two & raises), "raised": value(f, raises, False)}
        hand_of = own // many
        for k, s in enumerate(("flop", "turn", "river"), 1):
            on = st == k
            flags[f"bet_{s}"] = any_(on & is_("bet"))
            check = mine(on & is_("check"))
            bets = on & is_("bet") & (who >= 0)
            # The last bet of somebody else is the hand's last, or where that is one's own the last of the others.
            end = last(hands, hand, bets)
            end_who = value(end, who, -1)
            other = last(hands, hand, bets & (who != end_who[hand]))
            later = np.where(end_who[hand_of] == own % many, other[hand_of], end[hand_of])
            flags[f"check_raise_{s}_opp"] = (check >= 0) & (later > check)
            flags[f"check_raise_{s}_hit"] = flags[f"check_raise_{s}_opp"] & (last(players, slot, on & raises & seated) > check)

        # From here on one row a seat.
        pkey = place(phand, me)
        row = np.minimum(np.searchsorted(own, pkey), max(0, players - 1))
        known = pkey >= 0
        per = lambda x, missing=False: np.where(known, x[row], missing) if players else np.full(len(pkey), missing)
        r = {k: per(v) for k, v in flags.items()}
        f = per(f, -1)
        acted, fi = f >= 0, value(f, i, 0)
        over = acted & (value(f, m, -_NEVER) > bb[phand])
        before = np.select([fi <= i1[phand], fi <= i2[phand], fi <= i3[phand]], [0, 1, 2], 3)
        faced = lambda n: acted & (before == n)
        folded_to = acted & ~(paid[phand] < fi)
        position = seat.field("position")
        where = position.to_numpy(zero_copy_only=False)
        big_blind = where == "BB"
        opens = known & (me == n1[phand])
        opener = first(hands, phand, opens)
        aggressor = known & (me == pfa[phand])
        start = np.r_[True, phand[1:] != phand[:-1]] if len(phand) else np.zeros(0, bool)
        hit = aggressor & flop_ok[phand] & r["bet_flop"]
        opened = opener[phand] >= 0
        defends = big_blind & opened & ~value(opener[phand], big_blind, False)
        r |= {
            "hand_first": start, "rfi_opp": faced(0) & ~big_blind, "rfi_hit": faced(0) & r["raised"] & over, "rfi_ft_opp": folded_to & ~big_blind, "rfi_ft_hit": folded_to & r["raised"] & over,
            "three_bet_opp": faced(1), "three_bet_hit": faced(1) & r["raised"], "cold_four_bet_opp": faced(2), "cold_four_bet_hit": faced(2) & r["raised"], "cbet_opp": aggressor & flop_ok[phand], "cbet_hit": hit,
            "turn_cbet_opp": aggressor & turn_ok[phand], "turn_cbet_hit": aggressor & turn_ok[phand] & r["bet_turn"], "river_cbet_opp": aggressor & river_ok[phand], "river_cbet_hit": aggressor & river_ok[phand] & r["bet_river"],
            "double_barrel": hit & r["bet_turn"], "triple_barrel": hit & r["bet_turn"] & r["bet_river"],
        }
        bits = sum((r[k].astype(np.int64) << n for n, k in enumerate(_FLAGS)), np.zeros(len(pkey), np.int64))
        taken = lambda places: kind.take(pa.array(places, mask=places < 0))
        vs_3bet, vs_4bet, vs_open = (per(x, -1) for x in first_answers)
        out = [f, vs_3bet, vs_4bet, np.where(defends, vs_open, -1), np.where(aggressor, response[phand], -1)]
        of = lambda x: x.take(pa.array(phand))
        places = opener[phand]
        cols = [of(b.column("hand_id")), *(of(h.field(c)) for c in ("dataset", "year", "bb")), seat.field("player_name"), position, seat.field("net_won"), position.take(pa.array(places, mask=places < 0)), pa.array(bits), *map(taken, out)]
        yield pa.RecordBatch.from_arrays(cols, [*_KEPT, "flags", *_ANSWERS])


_KEPT = ("hand_id", "dataset", "year", "bb", "player_name", "position", "net_won", "opener_position")


def player_hand_facts(hands: DataFrame, players: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per primary hand and seated player with every flag that the metrics need.

    The tables are dealt out by hand once, all flags come of the hand's sorted actions in one pass over arrays of many hands, and nothing is joined
    afterwards. hand_first is true for one row of each hand; cbet_response (the first fold, call or raise of somebody
    else after the aggressor's flop bet) stands in the aggressor's row.
    """
    g = hand_rows(hands, players, actions).select("hand_id", "h", "ps", "acts")
    t = dict(g.select("hand_id", "h.*", F.explode("ps").alias("p")).select("*", "p.*").dtypes) | {"opener_position": "string"}
    x = g.mapInArrow(_fold, ", ".join([*(f"{c} {t[c]}" for c in _KEPT), "flags long", *(f"{c} string" for c in _ANSWERS)]))
    return x.select(*_KEPT, *[((F.col("flags").bitwiseAND(F.lit(1 << n))) != 0).alias(c) for n, c in enumerate(_FLAGS)], *_ANSWERS)


#: The same facts for DuckDB, after ``railbird.sources.fixture.SQL``.
SQL = """,
pa AS (SELECT a.*, h.dataset, h.year, h.bb, h.board_flop, h.board_turn, h.board_river, h.num_players_flop FROM actions a JOIN hands h USING (hand_id) WHERE h.is_primary),
pp AS (SELECT p.*, h.dataset, h.year, h.bb FROM players p JOIN hands h USING (hand_id) WHERE h.is_primary AND p.position IS NOT NULL),
pr AS (SELECT hand_id, action_index, player_name, amount, row_number() OVER (PARTITION BY hand_id ORDER BY action_index) AS raise_n FROM pa WHERE street = 'preflop' AND action_type = 'raise' AND amount > bb),
ag AS (SELECT hand_id, arg_max(player_name, action_index) AS pfa FROM pa WHERE street = 'preflop' AND action_type = 'raise' GROUP BY hand_id),
fv AS (SELECT hand_id, player_name, action_index, action_type, amount, row_number() OVER (PARTITION BY hand_id, player_name ORDER BY action_index) AS rn FROM pa WHERE street = 'preflop' AND action_type NOT LIKE 'post%'),
pf AS (SELECT f.hand_id, f.player_name, f.action_index, f.action_type, f.amount, (SELECT count(*) FROM pr WHERE pr.hand_id = f.hand_id AND pr.action_index < f.action_index) AS raises_before,
  NOT EXISTS (SELECT 1 FROM pa c WHERE c.hand_id = f.hand_id AND c.street = 'preflop' AND c.action_index < f.action_index AND c.action_type IN ('call', 'raise', 'bet')) AS is_folded_to FROM fv f WHERE rn = 1),
nx AS (SELECT r.raise_n, a.hand_id, a.player_name, arg_min(a.action_type, a.action_index) AS response FROM pr r JOIN pa a ON a.hand_id = r.hand_id AND a.street = 'preflop' AND a.action_type NOT LIKE 'post%' AND a.action_index > r.action_index WHERE r.raise_n <= 3 GROUP BY ALL),
v3 AS (SELECT nx.hand_id, nx.player_name, nx.response FROM nx JOIN pr ON pr.hand_id = nx.hand_id AND pr.raise_n = 1 AND pr.player_name = nx.player_name WHERE nx.raise_n = 2),
v4 AS (SELECT nx.hand_id, nx.player_name, nx.response FROM nx JOIN pr ON pr.hand_id = nx.hand_id AND pr.raise_n = 2 AND pr.player_name = nx.player_name WHERE nx.raise_n = 3),
op AS (SELECT pr.hand_id, pp.position AS opener_position FROM pr JOIN pp USING (hand_id, player_name) WHERE raise_n = 1),
bd AS (SELECT pp.hand_id, pp.player_name, nx.response FROM pp JOIN op USING (hand_id) JOIN nx ON nx.hand_id = pp.hand_id AND nx.player_name = pp.player_name AND nx.raise_n = 1 WHERE pp.position = 'BB' AND op.opener_position <> 'BB'),
sa AS (SELECT hand_id, player_name, bool_or(street = 'preflop' AND action_type IN ('call', 'raise', 'bet')) AS vpip, bool_or(street = 'preflop' AND action_type = 'raise') AS pfr,
  bool_or(street = 'flop' AND action_type = 'bet') AS bet_flop, bool_or(street = 'turn' AND action_type = 'bet') AS bet_turn, bool_or(street = 'river' AND action_type = 'bet') AS bet_river FROM pa GROUP BY ALL),
f4 AS (SELECT DISTINCT a.hand_id, a.player_name, bool_or(a.action_type = 'raise') OVER (PARTITION BY a.hand_id, a.player_name) AS hit FROM pa a WHERE street = 'preflop' AND action_type NOT LIKE 'post%' AND (SELECT count(*) FROM pr WHERE pr.hand_id = a.hand_id AND pr.action_index < a.action_index) = 2),
facts AS (SELECT pp.hand_id, pp.dataset, pp.year, pp.bb, pp.player_name, pp.position, pp.net_won, op.opener_position, coalesce(vpip, false) AS vpip, coalesce(pfr, false) AS pfr, pf.action_type AS first_action,
  coalesce(pf.raises_before = 0, false) AND pp.position <> 'BB' AS rfi_opp, coalesce(pf.raises_before = 0 AND pf.action_type = 'raise' AND pf.amount > pp.bb, false) AS rfi_hit,
  coalesce(pf.is_folded_to, false) AND pp.position <> 'BB' AS rfi_ft_opp, coalesce(pf.is_folded_to AND pf.action_type = 'raise' AND pf.amount > pp.bb, false) AS rfi_ft_hit,
  coalesce(pf.raises_before = 1, false) AS three_bet_opp, coalesce(pf.raises_before = 1 AND pf.action_type = 'raise', false) AS three_bet_hit,
  coalesce(pf.raises_before = 2, false) AS cold_four_bet_opp, coalesce(pf.raises_before = 2 AND pf.action_type = 'raise', false) AS cold_four_bet_hit,
  f4.hand_id IS NOT NULL AS four_bet_opp, coalesce(f4.hit, false) AS four_bet_hit, v3.response AS vs_3bet, v4.response AS vs_4bet, bd.response AS bb_response,
  coalesce(ag.pfa = pp.player_name, false) AS is_pfa, h.board_flop IS NOT NULL AND h.num_players_flop >= 2 AS flop_ok, h.board_turn IS NOT NULL AS turn_ok, h.board_river IS NOT NULL AS river_ok,
  coalesce(bet_flop, false) AS bet_flop, coalesce(bet_turn, false) AS bet_turn, coalesce(bet_river, false) AS bet_river
  FROM pp JOIN hands h USING (hand_id) LEFT JOIN sa USING (hand_id, player_name) LEFT JOIN pf USING (hand_id, player_name) LEFT JOIN v3 USING (hand_id, player_name) LEFT JOIN v4 USING (hand_id, player_name)
  LEFT JOIN bd USING (hand_id, player_name) LEFT JOIN f4 USING (hand_id, player_name) LEFT JOIN op ON op.hand_id = pp.hand_id LEFT JOIN ag ON ag.hand_id = pp.hand_id),
cb AS (SELECT a.hand_id, a.dataset, min(a.action_index) AS cbet_at, ag.pfa FROM pa a JOIN ag ON ag.hand_id = a.hand_id AND ag.pfa = a.player_name WHERE street = 'flop' AND action_type = 'bet' GROUP BY ALL),
cr AS (SELECT cb.hand_id, cb.dataset, arg_min(a.action_type, a.action_index) AS response FROM cb JOIN pa a ON a.hand_id = cb.hand_id AND a.street = 'flop' AND a.action_index > cb.cbet_at AND a.player_name <> cb.pfa AND a.action_type IN ('fold', 'call', 'raise') GROUP BY ALL),
ck AS (SELECT hand_id, dataset, street, player_name, min(action_index) AS ci FROM pa WHERE action_type = 'check' AND street <> 'preflop' GROUP BY ALL),
xr AS (SELECT ck.*, EXISTS (SELECT 1 FROM pa b WHERE b.hand_id = ck.hand_id AND b.street = ck.street AND b.action_type = 'bet' AND b.action_index > ck.ci AND b.player_name <> ck.player_name) AS opp,
  EXISTS (SELECT 1 FROM pa b WHERE b.hand_id = ck.hand_id AND b.street = ck.street AND b.action_type = 'raise' AND b.action_index > ck.ci AND b.player_name = ck.player_name) AS again FROM ck)
"""
