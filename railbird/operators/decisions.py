"""Decision features from ordered action logs, and supervised scoring of players."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railbird.functions.rates import rounded
from railbird.operators import boosting
from railbird.operators.prefix import prefix_sums
from railbird.plans.schema import POSTS
from railbird.plans.stored import stored

NUMERIC = ("players_left", "raises_before", "actions_before", "pot_bb", "to_call_bb", "pot_odds", "spr", "size_pot")
BOOLEAN = ("facing_bet", "in_position", "was_preflop_aggressor", "all_in")
CATEGORICAL = {"street": ("preflop", "flop", "turn", "river"), "position": ("LJ", "HJ", "CO", "BTN", "SB", "BB"), "decision": ("fold", "check", "call", "bet", "raise")}
#: Upper edges of the coarse size buckets; a bucket includes its upper edge.
SIZE_EDGES = (0.0, 0.3, 0.45, 0.6, 0.8, 1.05, 1.6)


def features(actions: DataFrame) -> DataFrame:
    """One row per decision. ``actions`` carry hand_id, action_index, street, player_name, seat, position, action_type, amount, bb, stack_start.

    Money on a street follows the same rule as the net result: additions add up, a raise states the street's total.
    With S the running sum of additions and a the raises, what a player has in is S + max(0, max(a - S)).
    All windows are inside a hand and share one exchange by hand.
    """
    hand = W.partitionBy("hand_id").orderBy("action_index")
    street = W.partitionBy("hand_id", "street").orderBy("action_index")
    own = W.partitionBy("hand_id", "street", "player_name").orderBy("action_index").rowsBetween(W.unboundedPreceding, 0)
    me = W.partitionBy("hand_id", "player_name").orderBy("action_index")
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    is_ = lambda *k: F.col("action_type").isin(*k)
    a = actions.repartition("hand_id").withColumn("_s", F.sum(F.when(is_(*POSTS, "call", "bet"), F.col("amount")).otherwise(0)).over(own))
    a = a.withColumn("_in", F.col("_s") + F.greatest(F.lit(0), F.coalesce(F.max(F.when(is_("raise"), F.col("amount") - F.col("_s"))).over(own), F.lit(0))))
    a = a.withColumn("_had", F.coalesce(F.lag("_in").over(W.partitionBy("hand_id", "street", "player_name").orderBy("action_index")), F.lit(0))).withColumn("_add", F.col("_in") - F.col("_had"))
    post = is_(*POSTS)
    n = lambda cond, w: F.coalesce(F.sum(cond.cast("int")).over(before(w)), F.lit(0))
    everyone = W.partitionBy("hand_id")
    a = a.withColumns(
        {
            "_pot": F.coalesce(F.sum("_add").over(before(hand)), F.lit(0)),
            "_bet": F.coalesce(F.max("_in").over(before(street)), F.lit(0)),
            "_spent": F.coalesce(F.sum("_add").over(before(me)), F.lit(0)),
            "_out": F.collect_list(F.when(is_("fold"), F.col("seat"))).over(before(hand)),
            "_seats": F.collect_set("seat").over(everyone),
            "_raises": n(is_("raise", "bet"), street),
            "_acts": n(~post, street),
            "_pfa": F.last(F.when((F.col("street") == "preflop") & is_("raise"), F.col("player_name")), ignorenulls=True).over(before(hand)),
        }
    ).filter(~post)
    left = F.col("stack_start") - F.col("_spent")
    call = F.least(F.greatest(F.col("_bet") - F.col("_had"), F.lit(0)), left)
    active = F.array_except("_seats", "_out")
    later = F.col("street") != "preflop"
    d = lambda x: x.cast("double")
    return a.withColumn("_call", call).select(
        "hand_id", "action_index", "player_name", "street", "position", F.size(active).cast("long").alias("players_left"),
        (F.col("_raises") + F.when(later, 0).otherwise(1)).cast("long").alias("raises_before"), F.col("_acts").cast("long").alias("actions_before"), (F.col("_call") > 0).alias("facing_bet"),
        (d(F.col("_pot")) / F.col("bb")).alias("pot_bb"), (d(F.col("_call")) / F.col("bb")).alias("to_call_bb"),
        F.when(F.col("_call") > 0, d(F.col("_call")) / (F.col("_pot") + F.col("_call"))).otherwise(0.0).alias("pot_odds"),
        F.when(F.col("_pot") > 0, d(left) / F.col("_pot")).otherwise(0.0).alias("spr"), (later & (F.col("seat") == F.array_max(active))).alias("in_position"),
        (later & F.coalesce(F.col("_pfa") == F.col("player_name"), F.lit(False))).alias("was_preflop_aggressor"), F.col("action_type").alias("decision"),
        F.when(F.col("_pot") > 0, d(F.col("_add")) / F.col("_pot")).otherwise(0.0).alias("size_pot"), (is_("call", "bet", "raise") & (left - F.col("_add") <= 0)).alias("all_in"),
    )


def replay(log: DataFrame, seats: DataFrame) -> DataFrame:
    """One row per decision of ``log(hand, step, action)``, with stacks and pots played through.

    ``seats`` has one row per hand and seat: hand, seat (number in the log's ``p<seat>``), player_name, position, stack_start, blind, bb. A log states only
    folds, ``cc`` (check or call) and ``cbr`` totals, so a call adds what is missing to the bet but no more than the
    stack, and check or call, bet or raise follow from the bet before. ``d db`` opens the next street; cards dealt to players and shown cards are no
    decisions, nor are actions of a seat that is not listed. step is the decision's place in the log. hand_id is the log's hand. Hands without seats or actions give no row; a null blind is
    none. Hands are independent: one exchange by hand, one fold inside it.
    """
    parts = F.split("action", " ")
    who = F.regexp_extract("action", r"^p(\d+) (?:f|cc|cbr)\b", 1)
    row = F.struct("step", (parts[0] == "d").alias("deal"), F.try_element_at(parts, F.lit(2)).alias("kind"), F.try_element_at(parts, F.lit(3)).try_cast("long").alias("m"), who.try_cast("int").alias("seat"))
    a = log.select("hand", row.alias("a")).filter("(a.deal AND a.kind = 'db') OR a.seat IS NOT NULL")
    at = seats.select("hand", "bb", F.struct(F.col("seat").cast("int").alias("seat"), "player_name", "position", F.col("stack_start").cast("long").alias("stack"), F.coalesce(F.col("blind").cast("long"), F.lit(0)).alias("blind")).alias("s"))
    g = a.unionByName(at, allowMissingColumns=True).groupBy(F.col("hand").alias("hand_id"))
    g = g.agg(F.max("bb").alias("bb"), F.array_sort(F.collect_list("a")).alias("raw"), F.array_sort(F.collect_list("s")).alias("seats")).filter("size(seats) > 0")
    # A street's number is the count of boards dealt before; blinds come first.
    dealt = lambda x: F.size(F.filter("raw", lambda y: y["deal"] & (y["step"] < x["step"])))
    street = lambda n: F.try_element_at(F.array(*[F.lit(x) for x in CATEGORICAL["street"]]), F.least(n, F.lit(3)) + 1)
    one = lambda i, st, kind, m, seat: F.struct(i.alias("action_index"), st.alias("st"), kind.alias("kind"), m.alias("m"), seat.alias("seat"))
    posts = F.transform(F.filter("seats", lambda s: s["blind"] > 0), lambda s: one(F.lit(-1).cast("long"), F.lit("preflop"), F.lit("post"), s["blind"], s["seat"]))
    moves = F.transform(F.filter("raw", lambda x: ~x["deal"]), lambda x: one(x["step"], street(dealt(x)), x["kind"], x["m"], x["seat"]))
    return _decisions(g.withColumn("acts", F.concat(posts, moves)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _decisions(g: DataFrame) -> DataFrame:
    """Plays every hand ``g(hand_id, bb, acts, seats)`` through in one pass and gives a row for each action that is no post.

    The state holds for each seat the stack, what is in on the street, and whether it folded; and the pot, the bet, counts and the last raiser before the flop.
    Windows cannot say this, as what a call adds follows from all that was added before.
    """
    long = lambda n: F.lit(n).cast("long")
    g = g.withColumn("acts", F.transform("acts", lambda a: a.withField("w", (F.array_position(F.transform("seats", lambda s: s["seat"]), a["seat"]) - 1).cast("int"))))
    g = g.withColumn("acts", F.filter("acts", lambda a: a["w"] >= 0))
    fields = (
        "i long, street string, w int, players_left long, raises_before long, actions_before long, to_call long, pot long, stack long, last boolean, aggressor boolean, decision string, added long"
    )
    seat = lambda stack, has, out: F.struct(stack.alias("stack"), has.alias("has"), out.alias("out"))
    start = F.struct(
        F.lit("preflop").alias("st"), F.transform("seats", lambda s: seat(s["stack"].cast("long"), long(0), F.lit(False))).alias("seats"), F.size("seats").cast("long").alias("left"),
        long(0).alias("pot"), long(0).alias("bet"), long(0).alias("raises"), long(0).alias("acts"), F.lit(-1).alias("pfa"), long(0).alias("blinds"), F.array().cast(f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>").alias("rows"),
    )

    def street(s, a):
        """What stands on the action's street before it."""
        new = s["st"] != a["st"]
        zero = lambda name: F.when(new, long(0)).otherwise(s[name])
        seats = F.when(new, F.transform(s["seats"], lambda x: seat(x["stack"], long(0), x["out"]))).otherwise(s["seats"])
        return F.struct(seats.alias("seats"), zero("bet").alias("bet"), zero("raises").alias("raises"), zero("acts").alias("acts"))

    def added(m, me, a):
        """What is to call, and what the player adds."""
        call = F.least(m["bet"] - me["has"], me["stack"])
        add = F.when(a["kind"] == "post", a["m"]).when(a["kind"] == "cc", call).when(a["kind"] == "cbr", F.coalesce(a["m"], me["has"]) - me["has"]).otherwise(long(0))
        name = F.when(a["kind"] == "f", "fold").when(a["kind"] == "cc", F.when(call > 0, "call").otherwise("check")).when(a["kind"] == "cbr", F.when(m["bet"] > 0, "raise").otherwise("bet")).otherwise("post")
        return F.struct(me.alias("me"), call.alias("call"), add.alias("add"), name.alias("name"))

    def after(s, m, d, a):
        w, me, post, folds = a["w"], d["me"], d["name"] == "post", d["name"] == "fold"
        has = me["has"] + d["add"]
        raised = d["name"].isin("raise", "bet")
        bet = F.when(raised, has).when(post, F.greatest(m["bet"], has)).otherwise(m["bet"])
        # Before the flop the blinds are the first raise.
        first = F.when(a["st"] == "preflop", (s["blinds"] > 0).cast("long")).otherwise(long(0))
        last = F.when(a["st"] != "preflop", w == F.array_max(F.transform(m["seats"], lambda x, i: F.when(x["out"], F.lit(-1)).otherwise(i)))).otherwise(F.lit(False))
        row = F.struct(
            a["action_index"].alias("i"), a["st"].alias("street"), w.alias("w"), s["left"].alias("players_left"), (m["raises"] + first).alias("raises_before"), m["acts"].alias("actions_before"),
            d["call"].alias("to_call"), s["pot"].alias("pot"), me["stack"].alias("stack"), last.alias("last"), (w == s["pfa"]).alias("aggressor"), d["name"].alias("decision"), d["add"].alias("added"),
        )
        mine = seat(me["stack"] - d["add"], has, me["out"] | folds)
        return F.struct(
            a["st"].alias("st"), F.transform(m["seats"], lambda x, i: F.when(i == w, mine).otherwise(x)).alias("seats"), (s["left"] - (folds & ~me["out"]).cast("long")).alias("left"),
            (s["pot"] + d["add"]).alias("pot"), bet.alias("bet"), (m["raises"] + raised.cast("long")).alias("raises"), (m["acts"] + (~post).cast("long")).alias("acts"),
            F.when((a["st"] == "preflop") & raised, w).otherwise(s["pfa"]).alias("pfa"), (s["blinds"] + F.when(post, d["add"]).otherwise(long(0))).alias("blinds"),
            F.when(post, s["rows"]).otherwise(F.concat(s["rows"], F.array(row))).alias("rows"),
        )

    step = lambda s, a: _let(street(s, a), lambda m: _let(added(m, F.get(m["seats"], a["w"]), a), lambda d: after(s, m, d, a)))
    r = g.select("hand_id", "bb", "seats", F.explode(F.aggregate("acts", start, step, lambda s: s["rows"])).alias("r")).select("hand_id", "bb", F.get("seats", F.col("r.w")).alias("p"), "r.*")
    d = lambda x: F.col(x).cast("double")
    later = F.col("street") != "preflop"
    return r.select(
        "hand_id", F.col("i").alias("action_index"), "p.player_name", "street", "p.position", "players_left", "raises_before", "actions_before", (F.col("to_call") > 0).alias("facing_bet"),
        (d("pot") / F.col("bb")).alias("pot_bb"), (d("to_call") / F.col("bb")).alias("to_call_bb"), F.when(F.col("to_call") > 0, d("to_call") / (F.col("pot") + F.col("to_call"))).otherwise(0.0).alias("pot_odds"),
        F.when(F.col("pot") > 0, d("stack") / F.col("pot")).otherwise(0.0).alias("spr"), (later & F.col("last")).alias("in_position"), (later & F.col("aggressor")).alias("was_preflop_aggressor"), "decision",
        F.when((F.col("pot") > 0) & F.col("decision").isin("call", "bet", "raise"), d("added") / F.col("pot")).otherwise(0.0).alias("size_pot"),
        ((F.col("decision") != "fold") & (F.col("stack") == F.col("added"))).alias("all_in"),
    )


def mix(d: DataFrame, label: str = "label") -> DataFrame:
    """Share of each decision by label."""
    kinds = list(CATEGORICAL["decision"])
    p = d.groupBy(label).pivot("decision", kinds).count().fillna(0)
    total = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    return p.select(label, *[rounded(F.col(k) / total, 4).alias(k) for k in kinds])


def style(d: DataFrame, label: str = "label") -> DataFrame:
    """Familiar rates per label; VPIP and PFR at the grain of hand and player first."""
    share = lambda hit, opp: rounded(F.lit(100.0) * F.count(F.when(hit & opp, 1)) / F.nullif(F.count(F.when(opp, 1)), F.lit(0)))
    pre, flop = F.col("street") == "preflop", F.col("street") == "flop"
    is_ = lambda *k: F.col("decision").isin(*k)
    hp = d.filter(pre).groupBy(label, "hand_id", "player_name").agg(F.max(is_("call", "raise")).alias("v"), F.max(is_("raise")).alias("r"))
    hp = hp.groupBy(label).agg(share(F.col("v"), F.lit(True)).alias("vpip_pct"), share(F.col("r"), F.lit(True)).alias("pfr_pct"))
    bets = is_("bet", "raise") & ~pre
    g = d.groupBy(label).agg(
        share(is_("raise"), pre & (F.col("raises_before") == 2)).alias("three_bet_pct"), share(is_("bet"), flop & F.col("was_preflop_aggressor") & ~F.col("facing_bet")).alias("flop_cbet_pct"),
        share(is_("fold"), flop & F.col("facing_bet")).alias("fold_to_flop_bet_pct"), share(is_("raise"), flop & F.col("facing_bet")).alias("raise_vs_flop_bet_pct"),
        share(F.col("size_pot") > 1.05, bets).alias("overbet_pct"), share(F.col("all_in"), F.lit(True)).alias("all_in_pct"),
    )
    return hp.join(g, label)


def size_histogram(d: DataFrame, label: str = "label", bins: int = 25, top: float = 2.5) -> DataFrame:
    """Density of bet sizes after the flop by street and label, clipped at ``top``."""
    width = top / bins
    x = d.filter(F.col("decision").isin("bet", "raise") & (F.col("street") != "preflop"))
    b = F.least(F.floor(F.least(F.col("size_pot"), F.lit(top)) / width), F.lit(bins - 1)).cast("long")
    h = x.groupBy("street", label, b.alias("bin")).agg(F.count("*").alias("n"))
    return h.withColumn("density", rounded(F.col("n") / (F.sum("n").over(W.partitionBy("street", label)) * width), 6))


def size_bucket(x: Column) -> Column:
    c = F.when(x <= SIZE_EDGES[0], 0)
    for i, e in enumerate(SIZE_EDGES[1:], 1):
        c = c.when(x <= e, i)
    return c.otherwise(len(SIZE_EDGES)).cast("long")


def group_folds(groups: DataFrame, k: int = 5, group: str = "session", size: str = "n") -> DataFrame:
    """Fold of each group: by size from large to small, dealt round (ties by name). ``groups`` has one row per group.

    Groups are numbered by running sums over sorted ranges, so no task sees them all.
    """
    s = prefix_sums(groups.withColumn("_one", F.lit(1)), [], [F.desc(size), group], ["_one"])
    return s.withColumn("fold", (F.col("before__one") % k).cast("long")).drop("_one", "before__one", "total__one")


def group_split(groups: DataFrame, share: float = 0.2, group: str = "session", seed: int = 42) -> DataFrame:
    """Adds test: true for about ``share`` of all groups, chosen by a digest of seed and name, so no group is on both sides."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col(group).cast("string"))), 1, 12), 16, 10).cast("double")
    return groups.withColumn("test", draw < share * float(2**48))


def auc(scores: DataFrame, label: Column, score: str, *keys: str, threshold: float = 0.5, weight: str | None = None) -> DataFrame:
    """ROC-AUC, average precision and the accuracy of ``score >= threshold`` per ``keys``; ``weight`` is the number of rows that a row stands for.

    Rows are first counted by distinct score, so ties share their average rank and the running sums go over distinct scores, in
    ranges of them. A null score is lower than all others.
    """
    w = F.col(weight) if weight else F.lit(1)
    c = scores.groupBy(*keys, F.col(score).alias("s")).agg(F.sum(label.cast("long") * w).alias("p"), F.sum(w).cast("long").alias("n"))
    x = prefix_sums(c, list(keys), ["s"], ["p", "n"])
    # Twice the average rank of a score is an integer; precision at a score counts everything at or above it.
    twice = F.sum(F.col("p") * (2 * F.col("before_n") + F.col("n") + 1))
    pos, total = F.max("total_p"), F.max("total_n")
    step = F.col("p") * (F.col("total_p") - F.col("before_p")).cast("double") / (F.col("total_n") - F.col("before_n"))
    neg = total - pos
    a = (twice - pos * (pos + 1)).cast("double") / 2 / F.nullif((pos * neg).cast("double"), F.lit(0.0))
    return x.groupBy(*keys).agg(
        total.alias("n"), pos.alias("positives"), rounded(a, 6).alias("roc_auc"), rounded(F.sum(step) / F.nullif(pos, F.lit(0)), 6).alias("avg_precision"),
        rounded(F.sum(F.when(F.col("s") >= threshold, F.col("p")).otherwise(F.col("n") - F.col("p"))) / total, 6).alias("accuracy"),
    )


def entity_scores(scores: DataFrame, keys: list[str], score: str, label: str, least: int = 50) -> DataFrame:
    return scores.groupBy(*keys).agg(F.count("*").alias("decisions"), F.avg(score).alias("mean_score"), F.max(label).alias("label")).filter(F.col("decisions") >= least)


def evidence_curve(scores: DataFrame, entity: str, label: Column, score: str, row_id: str, sizes: tuple[int, ...] = (1, 5, 10, 25, 50, 100, 200), repeats: int = 20, seed: int = 7) -> DataFrame:
    """Mean AUC over ``repeats`` when an entity is judged by k of its rows, drawn by a digest of seed, repeat and row.

    The rows drawn are those of the smallest digests. An entity of more than 2k + 64 rows (k the largest size) is hot: of its n rows only those go on whose digest lies below a
    bar that about 2k + 64 of them pass, and the bar is checked: where too few rows passed, a repeat takes all of them. So an entity's window holds some hundred rows a repeat,
    however many rows it has. Rows without an entity are one entity.

    A row moves once with the list of the repeats that take it; it is copied for them where the windows are, which share that one exchange by entity.
    """
    k = max(sizes)
    most = 2 * k + 64
    every = F.sequence(F.lit(1), F.lit(repeats))
    digest = lambda rep: F.md5(F.concat_ws("/", F.lit(str(seed)), rep, F.col("rid")))
    rows = scores.select(F.struct(entity).alias("e"), label.alias("label"), F.col(score).alias("score"), F.col(row_id).alias("rid"))
    # The first 48 bits of a digest are uniform, so this share of them is passed by 2k + 64 rows in the mean.
    hot = stored(rows.groupBy("e").agg(F.count("*").alias("cnt")).filter(F.col("cnt") > most).select("e", (F.lit(float(most)) / F.col("cnt") * float(2**48)).alias("bar")))
    passes = lambda rep: F.conv(F.substring(digest(rep), 1, 12), 16, 10).cast("double") < F.col("bar")
    x = rows.join(hot, "e", "left").withColumn("reps", F.when(F.col("bar").isNotNull(), F.filter(every, passes)))
    got = x.filter("bar is not null").select("e", F.explode("reps").alias("rep")).groupBy("e", "rep").agg(F.count("*").alias("got"))
    short = hot.select("e", F.explode(every).alias("rep")).join(got, ["e", "rep"], "left").filter(F.coalesce("got", F.lit(0)) < k)
    short = stored(short.groupBy("e").agg(F.collect_list("rep").alias("short")))
    if not short.isEmpty():
        x = x.join(short, "e", "left").withColumn("reps", F.when(F.col("short").isNull(), F.col("reps")).otherwise(F.array_union("reps", "short"))).drop("short")
    # So many partitions that the copies of one are sorted in memory. No list: all repeats take the row.
    parts = max(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() * repeats // 400_000)
    x = x.filter("reps is null or size(reps) > 0").select("e", "label", "score", "rid", "reps").repartition(parts, "e")
    x = x.withColumn("rep", F.explode(F.coalesce("reps", every))).withColumn("digest", digest(F.col("rep")))
    group = W.partitionBy("e", "rep")
    w = group.orderBy("digest", "rid").rowsBetween(W.unboundedPreceding, 0)
    r = x.withColumns({"rn": F.row_number().over(group.orderBy("digest", "rid")), "sum": F.sum(F.round(F.col("score") * 10000).cast("long")).over(w), "label": F.max("label").over(w)})
    # The sums of the first k rows stand at the k-th.
    m = r.filter(F.col("rn").isin(*sizes)).select(F.col("rn").cast("int").alias("k"), "rep", "e", (F.col("sum") / F.lit(10000.0) / F.col("rn")).alias("m"), "label")
    a = auc(m, F.col("label"), "m", "k", "rep")
    return a.groupBy("k").agg(F.max("n").alias("entities"), rounded(F.sum(F.round(F.col("roc_auc") * 1e6).cast("long")) / F.lit(1e6) / F.count("*"), 6).alias("roc_auc"))


def assembled(d: DataFrame, label: str = "label", numeric: tuple[str, ...] = NUMERIC) -> DataFrame:
    """Adds ``x`` (a vector: numbers, booleans, one-hot categories) and y."""
    from pyspark.ml.functions import array_to_vector

    hot = [(F.col(c) == v).cast("double") for c, vs in CATEGORICAL.items() for v in vs]
    cols = [F.col(c).cast("double") for c in numeric] + [F.col(c).cast("double") for c in BOOLEAN] + hot
    return d.withColumns({"x": array_to_vector(F.array(*[F.coalesce(c, F.lit(0.0)) for c in cols])), "y": F.col(label).cast("double")})


def feature_names(numeric: tuple[str, ...] = NUMERIC) -> list[str]:
    return [*numeric, *BOOLEAN, *[f"{c}_{v}" for c, vs in CATEGORICAL.items() for v in vs]]


def _logistic():
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler

    return Pipeline(stages=[StandardScaler(withMean=True, inputCol="x", outputCol="z"), LogisticRegression(featuresCol="z", labelCol="y", maxIter=20)])


def _with_array(d: DataFrame) -> tuple[DataFrame, int]:
    """``d`` with the vector x as an array v, and its length."""
    from pyspark.ml.functions import vector_to_array

    d = d.withColumn("v", vector_to_array("x"))
    first = d.select(F.size("v").alias("n")).first()
    return d, first.n if first else 0


SCORED = ["hand_id", "action_index", "player_name", "session", "label"]


def out_of_fold(d: DataFrame, kinds: tuple[str, ...] = ("constant", "logistic", "boosted"), folds: int = 5, rounds: int = 300) -> DataFrame:
    """``d(x, y, fold, ..)`` -> (model, scores): every row is scored by models that saw none of its fold.

    The constant model is the mean label. Logistic models are one distributed fit a fold; boosting grows the trees of all folds together.
    """
    from pyspark.ml.functions import vector_to_array

    parts = []
    for kind in kinds:
        if kind == "boosted":
            a, n = _with_array(d)
            b = boosting.fit(a, "v", "y", "fold", n, [(k, tuple(range(n))) for k in range(folds)], rounds)
            parts.append(boosting.score(a, "v", "fold", b, SCORED).select(*SCORED, F.lit(kind).alias("model"), "p"))
            continue
        for k in range(folds):
            train, test = d.filter(F.col("fold") != k), d.filter(F.col("fold") == k)
            if kind == "constant":
                s = test.withColumn("p", F.lit(float(train.agg(F.avg("y")).first()[0] or 0.0)))
            else:
                s = _logistic().fit(train).transform(test).withColumn("p", vector_to_array("probability")[1])
            parts.append(s.select(*SCORED, F.lit(kind).alias("model"), "p"))
    return reduce(DataFrame.unionByName, parts)


def ablation(d: DataFrame, sets: dict[str, tuple[str, ...]], names: list[str], folds: int = 5, rounds: int = 300) -> DataFrame:
    """Out-of-fold scores of boosting for several feature sets, grown together: (.., features, p). ``names`` are the features of x; a set names those it uses."""
    a, n = _with_array(d)
    models = [(k, tuple(i for i, f in enumerate(names) if f in use)) for use in map(set, sets.values()) for k in range(folds)]
    b = boosting.fit(a, "v", "y", "fold", n, models, rounds)
    return boosting.score(a, "v", "fold", b, SCORED, [s for s in sets for _ in range(folds)])


def permutation_importance(d: DataFrame, names: list[str], repeats: int = 5, seed: int = 3, rounds: int = 300) -> DataFrame:
    """Drop of the held-out AUC of boosting when a feature is shuffled: (feature, drop). Fold 0 is held out.

    The shuffled row takes the feature of another row: rows are dealt into hash buckets and numbered in two hash orders
    there, so the shuffle is a join on (bucket, number). A row is scored once; for each feature only the trees that
    split on it are scored again with the other row's value, inside the row's batch, and what leaves the batch are counts by feature and score.
    """
    a, n = _with_array(d)
    b = boosting.fit(a, "v", "y", "fold", n, [(0, tuple(range(n)))], rounds)
    rid = F.xxhash64("hand_id", "action_index")
    test = stored(a.filter("fold = 0").select(rid.alias("rid"), F.col("y").cast("int").alias("y"), "v"))
    buckets = max(1, test.count() // 50_000)
    base = auc(_swapped(test.select("y", "v", F.col("v").alias("u")), b, []), F.col("y") == 1, "p", weight="n").first()["roc_auc"]
    parts = []
    for r in range(repeats):
        t = test.withColumn("b", F.pmod(F.xxhash64("rid", F.lit(seed + r)), F.lit(buckets)))
        one = t.withColumn("n", F.row_number().over(W.partitionBy("b").orderBy("rid")))
        two = t.withColumn("n", F.row_number().over(W.partitionBy("b").orderBy(F.xxhash64("rid", F.lit(100 + seed + r)), "rid"))).select("b", "n", F.col("v").alias("u"))
        s = _swapped(one.join(two, ["b", "n"]).select("y", "v", "u"), b, names)
        parts.append(auc(s, F.col("y") == 1, "p", "f", weight="n").select("f", "roc_auc"))
    return reduce(DataFrame.unionByName, parts).groupBy(F.col("f").alias("feature")).agg((F.lit(base) - F.avg("roc_auc")).alias("drop"))


def _swapped(pairs: DataFrame, b: boosting.Boosted, names: list[str]) -> DataFrame:
    """(f, y, p, n): how many rows (y, v, u) score p (6 digits) when v takes feature f from u; without ``names`` as they are."""
    model = b.models[0]
    uses = {i: [t for t in model.trees if ((t[0] == i) & (t[1] != boosting.STAYS)).any()] for i in range(len(b.edges))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            own, other = (b.binned(boosting._matrix(batch.column(i), len(b.edges))) for i in (1, 2))
            raw = model.raw(own)
            of = lambda bins, trees: sum((v[boosting.leaves(bins, f, t)] for f, t, v in trees), np.zeros(len(y)))
            for i, name in enumerate(names or ["-"]):
                mixed = own.copy()
                if names:
                    mixed[i] = other[i]
                p = np.round(boosting.probability(raw + (of(mixed, uses[i]) - of(own, uses[i]) if names else 0)), 6)
                (yy, pp), n = np.unique(np.stack([y, p]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n)), pa.array(yy.astype(np.int32)), pa.array(pp), pa.array(n.astype(np.int64))], ["f", "y", "p", "n"])

    return pairs.mapInArrow(run, "f string, y int, p double, n long")
