"""Rules and predicates on snapshots and events: application, scoring and discovery."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidebar.functions.core import KEYS
from tidebar.functions.quantiles import exact_quantiles
from tidebar.sources.scratch import materialize

Condition = tuple[str, str, float]


def condition(feature: str, op: str, value: float) -> Column:
    x = F.col(feature)
    return F.coalesce(x <= value if op == "<=" else x > value, F.lit(False))


def apply_rules(snap: DataFrame, rules: dict[str, list[Condition]]) -> DataFrame:
    """Rows of every matching rule. Rules are parameters, so they become one generated column:
    no join and no shuffle. A missing feature fails the rule."""
    if not rules:
        return snap.withColumn("rule_id", F.lit("")).filter(F.lit(False))
    hits = [F.when(reduce(lambda a, b: a & b, [condition(*c) for c in conds]), F.lit(rid)) for rid, conds in rules.items()]
    return snap.withColumn("rule_id", F.explode(F.array_compact(F.array(*hits))))


def apply_rule_table(snap: DataFrame, key: list[str], features: list[str], rules: DataFrame) -> DataFrame:
    """The same for rules held in a table (rule_id, feature, op, value): a row matches when it
    meets as many conditions as the rule has."""
    long = snap.select(*key, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])).alias("_f")
                       ).select(*key, "_f.*").filter("x IS NOT NULL")
    need = rules.groupBy("rule_id").agg(F.count(F.lit(1)).alias("_need"))
    met = long.join(rules, "feature").filter(F.when(F.col("op") == "<=", F.col("x") <= F.col("value")).otherwise(F.col("x") > F.col("value")))
    got = met.groupBy(*key, "rule_id").agg(F.count(F.lit(1)).alias("_got")).join(need, "rule_id")
    return got.filter("_got = _need").select(*key, "rule_id")


def rule_events(snap: DataFrame, rules: dict[str, list[Condition]], sides: dict[str, int]) -> DataFrame:
    """First matching snapshot per rule and session as an event."""
    side = reduce(lambda acc, kv: F.when(F.col("rule_id") == kv[0], kv[1]).otherwise(acc), sides.items(), F.lit(1))
    return apply_rules(snap, rules).groupBy("rule_id", *KEYS).agg(F.min("slot").alias("slot")).withColumn("side", side)


def edge_map(snap: DataFrame, features: list[str], label: str, bins: int, train: tuple, validate: tuple, test: tuple,
             floors: tuple[int, int, int]) -> DataFrame:
    """Train-quantile bins of each feature with label means and counts per split and direction.

    Keeps a direction when its train and validation means are positive and every split has
    enough rows. Thresholds come from the training years alone."""
    cols = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])
    long = snap.filter(F.col(label).isNotNull()).select(F.col(label).alias("y"), "year", F.inline(cols)).filter("x IS NOT NULL")
    long = materialize(long, "long")
    qs = [i / bins for i in range(bins + 1)]
    thr = exact_quantiles(long.filter(F.col("year").isin(*train)), ["feature"], "x", qs)
    cut = thr.groupBy("feature").agg(F.array_sort(F.collect_set("threshold")).alias("_e")).filter(F.size("_e") >= 3)
    x = long.join(cut, "feature")
    b = F.size(F.filter("_e", lambda e: F.col("x") > e)) - 1
    x = x.withColumn("bin", F.least(b, F.size("_e") - 2)).filter(F.col("bin") >= 0)
    split = F.when(F.col("year").isin(*train), "train").when(F.col("year").isin(*validate), "validate").when(F.col("year").isin(*test), "test")
    x = x.withColumn("split", split)
    at = lambda f, t: f(F.when(F.col("split") == t, F.col("y")))
    g = x.groupBy("feature", "bin").agg(
        F.first(F.get("_e", F.col("bin"))).alias("low"), *[a for t in ("train", "validate", "test") for a in (
            at(F.count, t).alias(f"n_{t}"), at(F.avg, t).alias(f"_m_{t}"))])
    g = g.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    for t in ("train", "validate", "test"):
        g = g.withColumn(f"mean_{t}", F.col("side") * F.col(f"_m_{t}")).drop(f"_m_{t}")
    a, b2, c = floors
    return g.filter((F.col("n_train") >= a) & (F.col("n_validate") >= b2) & (F.col("n_test") >= c)
                    & (F.col("mean_train") > 0) & (F.col("mean_validate") > 0))


def rank_rules(edges: DataFrame) -> DataFrame:
    """Validation mean scaled by the root of its count; the test split plays no part."""
    return edges.withColumn("rank_score", F.col("mean_validate") * F.sqrt("n_validate"))


def event_context(events: DataFrame, feat: DataFrame) -> DataFrame:
    """Side-adjusted context of each event from the bar it is known at."""
    atr, s = F.col("atr"), F.col("side")
    e = events.join(feat.drop("atr") if "atr" in events.columns else feat, [*KEYS, "slot"])
    pos = F.when(F.col("run_high") > F.col("run_low"), (F.col("close") - F.col("run_low")) / (F.col("run_high") - F.col("run_low"))).otherwise(0.5)
    side = lambda x: F.try_divide(s * x, atr)
    return e.withColumns({
        "impulse_atr": side(F.col("close") - F.col("p_close")), "vwap_side_atr": side(F.col("close") - F.col("vwap")),
        "vwap_slope_side_atr": side(F.col("vwap_slope")), "session_move_side_atr": side(F.col("close") - F.col("day_open")),
        "range_pos_side": F.when(s > 0, pos).otherwise(1 - pos), "gap_side_atr": side(F.col("day_open") - F.col("prev_close")),
        "range_atr": F.try_divide(F.col("run_high") - F.col("run_low"), atr)})


CONTEXT = ("impulse_atr", "volume_z", "vwap_side_atr", "vwap_slope_side_atr", "session_move_side_atr", "range_pos_side",
           "gap_side_atr", "range_atr")


#: Cuts of the predicate library: comparator and values for each column, in the column's own unit.
CUTS = {
    "side": {"=": (1, -1)},
    "volume_z": {">=": (-0.9, 0.25, 1.6), "<": (-0.75,)},
    "impulse_atr": {">=": (0.05, 0.15, 0.4)},
    "vwap_side_atr": {">=": (0.0, 0.1, 0.3), "<": (0.0,)},
    "vwap_slope_side_atr": {">=": (0.0, 0.015)},
    "session_move_side_atr": {">=": (0.0, 0.35), "<": (0.0,)},
    "range_pos_side": {">=": (0.45, 0.75), "<": (0.25,)},
    "gap_side_atr": {">=": (0.0,), "<": (0.0,)},
}
#: Stretches of a session, from and to.
SPANS = ((4, 12), (12, 20), (4, 24))


def predicates(quantiles: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """Named predicates as SQL conditions; a name is its column, comparator and cut. ``quantiles``: columns
    ``<column>_q<n>`` that hold cuts taken from training years."""
    out = [("ALL", "true")] + [(f"slot[{a},{b})", f"slot >= {a} AND slot < {b}") for a, b in SPANS]
    out += [(f"{c}{op}{cut}", f"{c} {op} {cut}") for c, ops in CUTS.items() for op, cuts in ops.items() for cut in cuts]
    return out + [(f"{q.rpartition('_')[0]}{op}{q.rpartition('_')[2]}", f"{q.rpartition('_')[0]} {op} {q}") for q in quantiles for op in ("<", ">=")]


def predicate_library(ctx: DataFrame, preds: list[tuple[str, str]]) -> DataFrame:
    """(event, predicate) rows of the predicates that hold; missing values fail."""
    hits = [F.when(F.expr(cond), F.lit(name)) for name, cond in preds]
    return ctx.withColumn("predicate", F.explode(F.array_compact(F.array(*hits))))


def dedupe_masks(marked: DataFrame, event_key: list[str], order: DataFrame) -> DataFrame:
    """Predicates selecting a set of events that no earlier predicate selects.

    Equal sets share a combinable fingerprint (count and two hash sums); a fingerprint group is
    trusted only where its distinct events number exactly one set. ``order``: (predicate, rank)."""
    h = F.xxhash64(*event_key)
    f = marked.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("_x"),
                                        F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("_s")).join(order, "predicate")
    g = ["n", "_x", "_s"]
    events_in = marked.join(f, "predicate").select(*g, *event_key).distinct().groupBy(*g).agg(F.count(F.lit(1)).alias("_d"))
    f = f.join(events_in, g)
    f = f.withColumn("_first", F.min("rank").over(W.partitionBy(*g)))
    return f.filter((F.col("rank") == F.col("_first")) | (F.col("_d") != F.col("n"))).select("predicate", "n")


def pair_rules(marked: DataFrame, top: DataFrame, event_key: list[str], by: list[str]) -> DataFrame:
    """Events meeting two of the group's top predicates, one row per unordered pair.

    The pairs are formed inside each event's own short list of top predicates."""
    m = marked.join(top.select(*by, "predicate"), [*by, "predicate"])
    g = m.groupBy(*by, *event_key).agg(F.array_sort(F.collect_set("predicate")).alias("_p")).filter(F.size("_p") >= 2)
    pairs = F.flatten(F.transform("_p", lambda a, i: F.transform(F.slice("_p", i + 2, F.size("_p")), lambda b: F.concat_ws(" & ", a, b))))
    return g.select(*by, *event_key, F.explode(pairs).alias("predicate"))


def rebuild_rule(marked: DataFrame, frozen: DataFrame, event_key: list[str], library: list[str]) -> DataFrame:
    """Events of frozen rules (rule_id, predicate): all predicates of the rule must hold. A predicate that
    ``library`` does not name is an error, not a rule without events."""
    strange = frozen.filter(~F.coalesce(F.col("predicate").isin(library), F.lit(False))).select("predicate").first()
    if strange is not None:
        raise ValueError(f"no predicate is called {strange.predicate!r}")
    need = frozen.groupBy("rule_id").agg(F.count(F.lit(1)).alias("_need"))
    return (marked.join(frozen, "predicate").groupBy("rule_id", *event_key).agg(F.count(F.lit(1)).alias("_got"))
            .join(need, "rule_id").filter("_got = _need").select("rule_id", *event_key))


# ---- pairs of predicates on bitmaps ------------------------------------------------

def predicate_bitmaps(ctx: DataFrame, preds: list[tuple[str, str]], by: list[str]) -> DataFrame:
    """Which events each predicate selects, as bits: ``(*by, session, side, word, masks array<bigint>)``.

    A bit's address is its slot, so events need no numbering: a row has 64 slots of one session and side, an entry of ``masks`` is one predicate in the order
    of ``preds``. One hash aggregate makes all of them; no (event, predicate) row is built. ``by`` must contain the symbol."""
    bit = F.expr("shiftleft(1L, slot % 64)")
    g = ctx.groupBy(*by, "session", "side", F.expr("int(slot div 64)").alias("word")).agg(
        *[F.bit_or(F.when(F.expr(cond), bit).otherwise(F.lit(0).cast("long"))).alias(f"_m{i}") for i, (_, cond) in enumerate(preds)])
    return g.select(*by, "session", "side", "word", F.array(*[f"_m{i}" for i in range(len(preds))]).alias("masks"))


def _anded(words: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """Bits of each rule ``(*by, rules array<struct<a, b>>)``: those of predicates ``a`` and ``b``, words without a bit left out."""
    both = lambda r: F.get("masks", r["a"]).bitwiseAND(F.get("masks", r["b"]))
    hit = F.filter(F.transform("rules", lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"), both(r).alias("bits"))), lambda x: x["bits"] != 0)
    return words.join(rules, by).select(*by, "session", "side", "word", F.inline(hit))


def pair_candidates(words: DataFrame, top: DataFrame, by: list[str], min_support: int = 1) -> DataFrame:
    """Pairs worth a label, ``(*by, a, b, support)`` with predicate numbers a and b.

    ``top (*by, predicate, rank)`` has the short list of each group. Pairs of it grow by AND of the bits and are counted by ``bit_count``, with map-side combine. Those of fewer
    than ``min_support`` events are dropped, and those that select the same events as a predicate of the list or an earlier pair. Sets are
    told apart by their size and two 64-bit hash sums over their words."""
    lists = top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "predicate"))), lambda x: x["predicate"]).alias("p"))
    grown = F.flatten(F.transform("p", lambda a, i: F.transform(F.slice("p", i + 1, F.size("p")), lambda b, j: F.struct(a.alias("a"), b.alias("b")))))
    rules = lists.select(*by, grown.alias("rules"))  # a list's own predicates are the pairs of each with itself
    h = F.xxhash64("session", "side", "word", "bits")
    g = _anded(words, rules, by).groupBy(*by, "a", "b").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("support"), F.bit_xor(h).alias("_x"), F.sum(F.xxhash64(F.lit(1), "session", "side", "word", "bits").cast("decimal(38,0)")).alias("_s"))
    rank = lambda n: top.select(*by, F.col("predicate").alias(n), F.col("rank").alias(f"_r{n}"))
    g = g.join(rank("a"), [*by, "a"]).join(rank("b"), [*by, "b"])
    first = W.partitionBy(*by, "support", "_x", "_s").orderBy((F.col("a") != F.col("b")).cast("int"), "_ra", "_rb")
    return g.withColumn("_k", F.row_number().over(first)).filter((F.col("_k") == 1) & (F.col("a") != F.col("b")) & (F.col("support") >= min_support)).select(*by, "a", "b", "support")


def pair_events(words: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, session, slot, side, a, b)``: the events of the pairs that are left."""
    rules = pairs.groupBy(*by).agg(F.collect_list(F.struct("a", "b")).alias("rules"))
    slots = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    x = _anded(words, rules, by).select(*by, "session", "side", "word", "a", "b", F.explode(slots).alias("_i"))
    return x.select(*by, "session", (F.col("word") * 64 + F.col("_i")).alias("slot"), "side", "a", "b")
