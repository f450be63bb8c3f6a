"""Sequence detectors: one ordered pass over the bars of a session, inside the JVM.

A detector is a table of state columns with the next value of each, written over the state
``s`` and the bar ``r``. Bars of one (symbol, session, side) are gathered into an array, which
the calendar bounds, and folded with ``aggregate``. The short side is the long side on mirrored
prices, so every rule is stated once, for a break above ``up``.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.core import KEYS, at_least, by_session, prior, quantile, trailing, upto
from tidebar.operators.detect import cancel_opposite

MIRROR = [*KEYS, "side"]
ROW = ("slot", "o", "h", "l", "c", "pc", "up", "dn", "wid", "mid", "vw", "atr", "hk", "bh", "bl", "h2", "l2", "mb")
INSIDE = "(r.c > r.dn AND r.c < r.up)"


@dataclass(frozen=True)
class Sequence:
    """``state``: name -> (type, initial, next). ``fire`` and ``stop`` read the state before the bar."""
    state: dict[str, tuple[str, str, str]]
    fire: str
    stop: str = "CAST(NULL AS DOUBLE)"
    once: bool = True


def mirror(df: DataFrame, length: int, k: int, start: int | None = None, bodies: int | None = None) -> DataFrame:
    """Both sides of every bar in long coordinates, with the opening range of the session; bars from ``start``, else from the range's end.

    ``hk``: highest high of the prior ``k`` bars; ``bh``/``bl``: extremes of the last ``k`` bars; ``mb``: median body of the prior ``bodies`` bars, if wanted."""
    w = by_session()
    ranged = df.filter((F.col("atr") > 0) & F.col("is_normal") & F.col("or_high").isNotNull())
    gone = F.sum(F.when(F.col("close").isNull(), 1).otherwise(0)).over(upto(w))
    x = ranged.withColumns({
        "gone": gone,
        "_hk": at_least(F.max("high"), F.col("high"), prior(w, k), k),
        "_lk": at_least(F.min("low"), F.col("low"), prior(w, k), k),
        "_bh": at_least(F.max("high"), F.col("high"), trailing(w, k), k),
        "_bl": at_least(F.min("low"), F.col("low"), trailing(w, k), k),
        "_h2": F.lag("high", 2).over(w), "_l2": F.lag("low", 2).over(w)})
    body = F.abs(F.col("close") - F.col("open"))
    x = x.withColumn("mb", at_least(quantile(body, 0.5), body, prior(w, bodies), bodies) if bodies else F.lit(None).cast("double"))
    x = x.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    long = F.col("side") == 1
    flip = lambda a, b: F.when(long, F.col(a)).otherwise(-F.col(b))
    return x.filter(F.col("slot") >= (length if start is None else start)).select(
        *MIRROR, "slot", "gone", flip("open", "open").alias("o"), flip("high", "low").alias("h"),
        flip("low", "high").alias("l"), flip("close", "close").alias("c"), flip("p_close", "p_close").alias("pc"),
        flip("or_high", "or_low").alias("up"), flip("or_low", "or_high").alias("dn"),
        F.col("or_width").alias("wid"), flip("or_mid", "or_mid").alias("mid"), flip("vwap", "vwap").alias("vw"),
        "atr", flip("_hk", "_lk").alias("hk"), flip("_bh", "_bl").alias("bh"), flip("_bl", "_bh").alias("bl"),
        flip("_h2", "_l2").alias("h2"), flip("_l2", "_h2").alias("l2"), "mb")


def run_sequence(rows: DataFrame, seq: Sequence, whole_bars: bool, cutoff: int) -> DataFrame:
    """Events of ``seq``. ``whole_bars``: stop at the first missing bar instead of resetting."""
    x = rows.filter(F.col("slot") < cutoff)
    if whole_bars:
        x = x.filter("gone = 0")
    g = x.groupBy(*MIRROR).agg(F.sort_array(F.collect_list(F.struct(*ROW))).alias("_bars"))
    start = ", ".join(f"'{n}', CAST({i} AS {t})" for n, (t, i, _) in seq.state.items())
    step = ", ".join(f"'{n}', CAST({nxt} AS {t})" for n, (t, _, nxt) in seq.state.items())
    ev = f"named_struct('slot', r.slot, 'stop', CAST({seq.stop} AS DOUBLE))"
    none = "CAST(array() AS array<struct<slot: int, stop: double>>)"
    fire = f"coalesce({seq.fire}, false)" + (" AND size(s.ev) = 0" if seq.once else "")
    fold = (f"aggregate(_bars, named_struct({start}, 'ev', {none}), (s, r) -> named_struct({step}, "
            f"'ev', CASE WHEN {fire} THEN concat(s.ev, array({ev})) ELSE s.ev END), s -> s.ev)")
    out = g.select(*MIRROR, F.inline(F.expr(fold)))
    return out.select(*MIRROR, "slot", (F.col("stop") * F.col("side")).alias("stop_ref"))


def lone_side(ev: DataFrame) -> DataFrame:
    """Events whose bar fired on one side only."""
    ok = cancel_opposite(ev.select(*KEYS, "slot", "side"), [*KEYS, "slot"])
    return ev.join(ok, [*KEYS, "slot", "side"])


# ---- breaks after a pattern (session ends at the first missing bar) ---------------

def repeated_pressure(visits: int, band: float, away: float) -> Sequence:
    """Separate visits to the edge band before the break; a break without them spends the side."""
    dist = "((r.up - r.c) / r.wid)"
    near = f"({dist} >= 0 AND {dist} <= {band})"
    return Sequence({
        "visits": ("int", "0", f"CASE WHEN {near} AND s.away = 1 THEN s.visits + 1 ELSE s.visits END"),
        "away": ("int", "1", f"CASE WHEN {near} AND s.away = 1 THEN 0 WHEN {dist} >= {away} THEN 1 ELSE s.away END"),
        "done": ("int", "0", "CASE WHEN r.c > r.up THEN 1 ELSE s.done END"),
    }, f"s.done = 0 AND r.c > r.up AND s.visits >= {visits}")


FIRST = {
    "side1": ("int", "0", "CASE WHEN s.side1 = 0 AND r.c > r.up THEN 1 WHEN s.side1 = 0 AND r.c < r.dn THEN -1 ELSE s.side1 END"),
    "born": ("int", "-1", "CASE WHEN s.side1 = 0 AND (r.c > r.up OR r.c < r.dn) THEN r.slot ELSE s.born END"),
}


def second_attempt(depth: float, hold: int, expiry: int) -> Sequence:
    """Break, return by ``depth`` widths, stay inside, break again in time; never a third try."""
    live = "(s.done = 0 AND s.side1 = 1)"
    deep = f"((r.up - r.c) / r.wid >= {depth})"
    return Sequence({
        **FIRST,
        "back": ("int", "0", f"CASE WHEN {live} AND {INSIDE} AND {deep} THEN 1 ELSE s.back END"),
        "kept": ("int", "0", f"CASE WHEN {live} AND {INSIDE} AND (s.back = 1 OR {deep}) THEN s.kept + 1 ELSE s.kept END"),
        "done": ("int", "0", f"CASE WHEN {live} AND (r.c > r.up OR r.c < r.dn) THEN 1 ELSE s.done END"),
    }, f"{live} AND r.c > r.up AND s.back = 1 AND s.kept >= {hold} AND r.slot - s.born <= {expiry}")


def external_flag(impulse: float, bars: int, width: float, life: int) -> Sequence:
    """Impulse beyond the range, a tight box wholly outside it, then a break of the box."""
    mine = "(s.side1 = 1 OR (s.side1 = 0 AND r.c > r.up))"
    deny = f"(s.side1 = 1 AND (r.c <= r.up OR r.slot - s.born > {life}))"
    go = f"(s.done = 0 AND {mine} AND NOT {deny})"
    push = f"({go} AND s.stage = 0 AND r.c - r.up >= {impulse} * r.wid)"
    box = f"({go} AND s.stage = 1 AND r.slot - s.since >= {bars} AND r.bh - r.bl <= {width} * r.wid AND r.bl >= r.up + 0.25)"
    fire = f"({go} AND s.stage = 2 AND r.c > s.box)"
    return Sequence({
        **FIRST,
        "stage": ("int", "0", f"CASE WHEN {push} THEN 1 WHEN {box} THEN 2 ELSE s.stage END"),
        "since": ("int", "-1", f"CASE WHEN {push} THEN r.slot ELSE s.since END"),
        "box": ("double", "0.0", f"CASE WHEN {box} THEN r.bh ELSE s.box END"),
        "done": ("int", "0", f"CASE WHEN {fire} OR ({mine} AND {deny}) THEN 1 ELSE s.done END"),
    }, fire)


def vwap_reclaim_break(hold: int, expiry: int) -> Sequence:
    """Below VWAP, reclaimed and held inside the range, then the break."""
    stage = f"(CASE WHEN s.stage > 0 AND r.slot - s.since > {expiry} THEN 0 ELSE s.stage END)"
    over = "(r.c - r.vw)"
    held = f"(s.held + 1 >= {hold} AND {INSIDE})"
    fire = f"(s.done = 0 AND {stage} = 3 AND {over} > 0 AND r.c > r.up)"
    return Sequence({
        "stage": ("int", "0", f"""CASE WHEN {stage} = 0 THEN CASE WHEN {over} < 0 THEN 1 ELSE 0 END
 WHEN {stage} = 1 THEN CASE WHEN {over} > 0 THEN 2 ELSE 1 END
 WHEN {stage} = 2 THEN CASE WHEN {over} <= 0 THEN 0 WHEN {held} THEN 3 ELSE 2 END
 ELSE CASE WHEN {over} <= 0 THEN 0 ELSE 3 END END"""),
        "since": ("int", "-1", f"CASE WHEN {stage} = 0 AND {over} < 0 THEN r.slot ELSE s.since END"),
        "held": ("int", "0", f"CASE WHEN {stage} = 1 AND {over} > 0 THEN 1 WHEN {stage} = 2 AND {over} > 0 THEN s.held + 1 ELSE s.held END"),
        "done": ("int", "0", f"CASE WHEN {fire} OR r.c < r.dn OR ({stage} = 2 AND {over} > 0 AND NOT {held} AND r.c > r.up) THEN 1 ELSE s.done END"),
    }, fire)


def _turns(name: str, ex: str, delta: str) -> tuple[str, str]:
    """Next direction and next extreme of a directional-change tracker."""
    e = f"coalesce(s.{ex}, r.pc)"
    hi, lo = f"greatest({e}, r.c)", f"least({e}, r.c)"
    state = (f"(CASE WHEN s.{name} = 0 AND r.c >= {e} + {delta} THEN 1 WHEN s.{name} = 0 AND r.c <= {e} - {delta} THEN -1 "
             f"WHEN s.{name} = 1 AND r.c <= {hi} - {delta} THEN -1 WHEN s.{name} = -1 AND r.c >= {lo} + {delta} THEN 1 ELSE s.{name} END)")
    ext = (f"(CASE WHEN s.{name} = 0 THEN CASE WHEN abs(r.c - {e}) >= {delta} THEN r.c ELSE {e} END "
           f"WHEN s.{name} = 1 THEN CASE WHEN r.c <= {hi} - {delta} THEN r.c ELSE {hi} END "
           f"ELSE CASE WHEN r.c >= {lo} + {delta} THEN r.c ELSE {lo} END END)")
    return state, ext


def two_scale_change(small_atr: float, scale: float, expiry: int) -> Sequence:
    """A large-scale direction, a small counter-move, the small move back, then the break."""
    big, bx = _turns("large", "lx", f"({small_atr * scale} * r.atr)")
    little, sx = _turns("small", "sx", f"({small_atr} * r.atr)")
    after = f"(CASE WHEN {big} <> s.large THEN 0 ELSE s.stage END)"
    against = f"({big} <> 0 AND {little} <> s.small AND {little} = -{big})"
    along = f"({big} <> 0 AND {little} <> s.small AND {little} = {big} AND {after} = 1)"
    stage = f"(CASE WHEN {against} THEN 1 WHEN {along} THEN 2 ELSE {after} END)"
    since = f"(CASE WHEN {against} OR {along} OR {big} <> s.large THEN r.slot ELSE s.since END)"
    way = f"(CASE WHEN {against} OR {big} <> s.large THEN {big} ELSE s.way END)"
    return Sequence({
        "large": ("int", "0", big), "lx": ("double", "NULL", bx),
        "small": ("int", "0", little), "sx": ("double", "NULL", sx),
        "stage": ("int", "0", stage), "since": ("int", "-1", since), "way": ("int", "0", way),
        "done": ("int", "0", "CASE WHEN r.c > r.up THEN 1 ELSE s.done END"),
    }, f"s.done = 0 AND r.c > r.up AND {stage} = 2 AND {big} = 1 AND {way} = 1 AND r.slot - {since} > 0 AND r.slot - {since} <= {expiry}")


def retest(deadline: int, excursion: float, tolerance: float, stop: str) -> Sequence:
    """First break on this side, limited excursion, touch of the edge and a close back beyond it."""
    mine = "(s.done = 0 AND s.side1 = 1)"
    far = f"(r.slot - s.born > {deadline} OR greatest(s.reach, r.h - r.up) > {excursion} * r.wid)"
    fire = f"({mine} AND NOT {far} AND r.l <= r.up + {tolerance} AND r.c > r.up)"
    return Sequence({
        **FIRST,
        "reach": ("double", "0.0", f"CASE WHEN {mine} THEN greatest(s.reach, r.h - r.up) ELSE s.reach END"),
        "done": ("int", "0", f"CASE WHEN ({mine} AND {far}) OR {fire} THEN 1 ELSE s.done END"),
    }, fire, "r.up - 0.25" if stop == "boundary" else "r.l - 0.25")


# ---- inside-range entries (a missing bar resets the pattern) -----------------------

def _timed(expiry: int) -> str:
    return f"(CASE WHEN s.st > 0 AND r.slot - s.since > {expiry} THEN 0 ELSE s.st END)"


def _reset(expr: str) -> str:
    return f"CASE WHEN r.c IS NULL THEN 0 ELSE {expr} END"


def edge_rejection(edge: float, expiry: int) -> Sequence:
    """Visit of the lower edge, then a close over the prior highs below the middle."""
    st = _timed(expiry)
    start = f"({st} = 0 AND {INSIDE} AND r.l <= r.dn + {edge} * r.wid)"
    fire = f"({st} > 0 AND {INSIDE} AND r.c < r.mid AND r.c > r.hk)"
    return Sequence({
        "st": ("int", "0", _reset(f"CASE WHEN coalesce({fire}, false) THEN 0 WHEN {start} THEN 1 ELSE {st} END")),
        "since": ("int", "-1", f"CASE WHEN {start} THEN r.slot ELSE s.since END"),
        "low": ("double", "NULL", f"CASE WHEN {start} THEN r.l WHEN {st} > 0 THEN least(s.low, r.l) ELSE s.low END"),
    }, fire, "least(s.low, r.l)", once=False)


def failed_break_hold(hold: int, expiry: int) -> Sequence:
    """Close below the range, return, and ``hold`` further closes inside."""
    st = _timed(expiry)
    start = f"({st} = 0 AND r.c < r.dn)"
    fire = f"({st} = 2 AND {INSIDE} AND s.n + 1 >= {hold})"
    return Sequence({
        "st": ("int", "0", _reset(f"""CASE WHEN {start} THEN 1 WHEN {st} = 0 THEN 0 WHEN r.c >= r.up THEN 0
 WHEN {INSIDE} THEN CASE WHEN {st} = 1 THEN 2 WHEN s.n + 1 >= {hold} THEN 0 ELSE 2 END ELSE 1 END""")),
        "since": ("int", "-1", f"CASE WHEN {start} THEN r.slot ELSE s.since END"),
        "n": ("int", "0", f"CASE WHEN {st} = 2 AND {INSIDE} THEN s.n + 1 ELSE 0 END"),
        "low": ("double", "NULL", f"CASE WHEN {start} THEN r.l WHEN {st} > 0 THEN least(s.low, r.l) ELSE s.low END"),
    }, fire, "least(s.low, r.l)", once=False)


def reference_reclaim(ref: str, hold: int, expiry: int) -> Sequence:
    """Two or more closes below a reference inside the range, a reclaim, and ``hold`` holds."""
    st = _timed(expiry)
    x = f"r.{ref}"
    ok = f"({INSIDE} AND {x} > r.dn AND {x} < r.up)"
    fire = f"({ok} AND {st} = 2 AND r.c > {x} AND s.n + 1 >= {hold})"
    lost = f"(CASE WHEN s.st > 0 AND r.slot - s.since > {expiry} THEN 0 ELSE s.n END)"
    return Sequence({
        "st": ("int", "0", f"""CASE WHEN NOT coalesce({ok}, false) THEN 0 WHEN {st} = 0 THEN CASE WHEN r.c < {x} THEN 1 ELSE 0 END
 WHEN {st} = 1 THEN CASE WHEN r.c < {x} THEN 1 WHEN r.c > {x} AND s.n >= 2 THEN 2 ELSE 0 END
 ELSE CASE WHEN r.c <= {x} OR s.n + 1 >= {hold} THEN 0 ELSE 2 END END"""),
        "since": ("int", "-1", f"CASE WHEN {st} = 0 AND {ok} AND r.c < {x} THEN r.slot ELSE s.since END"),
        "n": ("int", "0", f"""CASE WHEN NOT coalesce({ok}, false) THEN 0 WHEN {st} = 0 THEN CASE WHEN r.c < {x} THEN 1 ELSE {lost} END
 WHEN {st} = 1 THEN CASE WHEN r.c < {x} THEN s.n + 1 ELSE 0 END
 ELSE CASE WHEN r.c <= {x} THEN 0 ELSE s.n + 1 END END"""),
        "low": ("double", "NULL", f"CASE WHEN {st} = 1 AND r.c > {x} AND s.n >= 2 THEN r.l WHEN {st} = 2 THEN least(s.low, r.l) ELSE s.low END"),
    }, fire, "least(s.low, r.l)", once=False)


def wick_excursion(ticks: int, confirmed: bool, expiry: int) -> Sequence:
    """Wick below the range with a close back inside; optionally a later close over its high."""
    st = _timed(expiry)
    wick = f"({st} = 0 AND r.pc > r.dn AND r.pc < r.up AND r.l <= r.dn - {ticks * 0.25} AND {INSIDE})"
    if not confirmed:
        return Sequence({"st": ("int", "0", "0"), "since": ("int", "-1", "-1")}, wick, "r.l", once=False)
    fire = f"({st} = 1 AND {INSIDE} AND r.h < r.up AND r.c > s.anchor)"
    return Sequence({
        "st": ("int", "0", _reset(f"CASE WHEN coalesce({wick}, false) THEN 1 WHEN {st} = 0 THEN 0 WHEN {fire} OR NOT {INSIDE} OR r.h >= r.up THEN 0 ELSE 1 END")),
        "since": ("int", "-1", f"CASE WHEN {wick} THEN r.slot ELSE s.since END"),
        "anchor": ("double", "NULL", f"CASE WHEN {wick} THEN r.h ELSE s.anchor END"),
        "low": ("double", "NULL", f"CASE WHEN {wick} THEN r.l WHEN {st} > 0 THEN least(s.low, r.l) ELSE s.low END"),
    }, fire, "least(s.low, r.l)", once=False)


def double_test(edge: float, apart: float, tolerance: float, expiry: int) -> Sequence:
    """Two lows within ``tolerance`` separated by a rally, then a close over the neckline."""
    st = _timed(expiry)
    start = f"({st} = 0 AND {INSIDE} AND r.l <= r.dn + {edge} * r.wid)"
    kill = f"({st} > 0 AND (NOT {INSIDE} OR r.h >= r.up))"
    again = f"(abs(r.l - s.anchor) <= {tolerance} * r.wid AND s.neck > r.dn AND s.neck < r.up)"
    fire = f"({st} = 3 AND NOT {kill} AND r.c > s.neck)"
    return Sequence({
        "st": ("int", "0", _reset(f"""CASE WHEN {start} THEN 1 WHEN {st} = 0 OR {kill} THEN 0
 WHEN {st} = 1 THEN CASE WHEN r.c >= s.anchor + {apart} * r.wid THEN 2 ELSE 1 END
 WHEN {st} = 2 THEN CASE WHEN {again} THEN 3 ELSE 2 END WHEN {fire} THEN 0 ELSE 3 END""")),
        "since": ("int", "-1", f"CASE WHEN {start} THEN r.slot ELSE s.since END"),
        "anchor": ("double", "NULL", f"CASE WHEN {start} THEN r.l ELSE s.anchor END"),
        "neck": ("double", "NULL", f"CASE WHEN {start} THEN -1e300 WHEN {st} = 1 OR ({st} = 2 AND NOT {again}) THEN greatest(s.neck, r.h) ELSE s.neck END"),
        "low": ("double", "NULL", f"CASE WHEN {start} THEN r.l WHEN {st} > 0 THEN least(s.low, r.l) ELSE s.low END"),
    }, fire, "least(s.low, r.l)", once=False)


# ---- zones: the state holds the live price gaps of the session ----------------------

ZONES = "array<struct<g: int, lo: double, hi: double, low: double>>"


def _zone_state(live: str, lo: str, hi: str, formed: str) -> str:
    """Live zones with their lows carried on, plus the zone formed by the current bar."""
    kept = f"transform({live}, z -> named_struct('g', z.g, 'lo', z.lo, 'hi', z.hi, 'low', least(z.low, r.l)))"
    new = f"array(named_struct('g', r.slot, 'lo', {lo}, 'hi', {hi}, 'low', r.bl))"
    return (f"CASE WHEN r.c IS NULL THEN CAST(array() AS {ZONES}) WHEN coalesce({formed}, false) "
            f"THEN concat({kept}, {new}) ELSE {kept} END")


def gap_retest(ticks: int, expiry: int) -> Sequence:
    """Three-bar gap inside the range, a pull back into it and a close above: newest live gap only.

    Run on ``mirror(..., k=3)``: ``bl`` is the low of the three bars."""
    live = f"filter(s.z, z -> r.slot - z.g <= {expiry} AND r.c >= z.lo AND r.h < r.up)"
    last = f"try_element_at({live}, -1)"
    touch = f"(coalesce(r.l <= {last}.hi AND r.h >= {last}.lo AND r.c > {last}.hi, false))"
    rest = f"(CASE WHEN {touch} THEN slice({live}, 1, size({live}) - 1) ELSE {live} END)"
    formed = f"(r.bl IS NOT NULL AND r.l - r.h2 >= {ticks * 0.25} AND r.h2 > r.dn AND r.l < r.up)"
    return Sequence({"z": (ZONES, "array()", _zone_state(rest, "r.h2", "r.l", formed))},
                    f"{touch} AND {INSIDE}", f"least({last}.low, r.l)", once=False)


@dataclass(frozen=True)
class Break:
    """How an opposing gap forms and is closed through: gap size and age, whether it forms during the opening range (``opening``) or after it
    (``post``), and the body a closing bar needs as a multiple of ``mb`` and as a share of its range (none: any bar)."""
    ticks: int
    age: int
    length: int
    formation: str = "post"
    body: tuple[float, float] | None = None

    def __post_init__(self):
        if self.formation not in ("opening", "post"):
            raise ValueError(f"no formation is called {self.formation!r}")

    @property
    def start(self) -> int:
        """First bar the detector has to see."""
        return 0 if self.formation == "opening" else self.length

    def formed(self) -> str:
        return f"(r.bl IS NOT NULL AND r.l2 - r.h >= {self.ticks * 0.25} AND r.slot {'<' if self.formation == 'opening' else '>='} {self.length})"

    def ok(self) -> str:
        """An entry's bar: behind the opening range, closed inside it, with a displacement if one is asked for."""
        strong = "" if self.body is None else (f" AND r.mb > 0 AND r.c > r.o AND r.c - r.o >= {self.body[0]} * r.mb AND r.c - r.o >= {self.body[1]} * (r.h - r.l) AND r.h - r.c <= 0.2 * (r.h - r.l)")
        return f"(r.slot >= {self.length} AND {INSIDE}{strong})"


def inverse_gap(ticks: int, age: int, length: int = 0, formation: str = "post", body: tuple[float, float] | None = None) -> Sequence:
    """An opposing three-bar gap that a later bar closes through, inside the range; see ``Break``."""
    how = Break(ticks, age, length, formation, body)
    broken = f"filter(s.z, z -> r.slot - z.g <= {age} AND r.c > z.hi)"
    live = f"filter(s.z, z -> r.slot - z.g <= {age} AND NOT r.c > z.hi)"
    return Sequence({"z": (ZONES, "array()", _zone_state(live, "r.h", "r.l2", how.formed()))},
                    f"size({broken}) > 0 AND {how.ok()}", f"least(try_element_at({broken}, -1).low, r.l)", once=False)


def inverse_gap_retest(ticks: int, age: int, expiry: int, length: int = 0, formation: str = "post", body: tuple[float, float] | None = None) -> Sequence:
    """As ``inverse_gap``, entered on a later return into the gap that closes above it."""
    how = Break(ticks, age, length, formation, body)
    broken = f"filter(s.z, z -> r.slot - z.g <= {age} AND r.c > z.hi)"
    live = f"filter(s.z, z -> r.slot - z.g <= {age} AND NOT r.c > z.hi)"
    ended = f"(r.slot - s.inv > {expiry} OR r.c < s.sel.lo OR r.h >= r.up)"
    back = f"(s.sel IS NOT NULL AND NOT {ended} AND r.slot > s.inv AND r.l <= s.sel.hi AND r.h >= s.sel.lo AND r.c > s.sel.hi)"
    keep = f"(s.sel IS NOT NULL AND NOT {ended} AND NOT {back})"
    pick = f"(NOT {keep} AND NOT ({back} AND {INSIDE}) AND size({broken}) > 0 AND {how.ok()})"
    zone = "struct<g: int, lo: double, hi: double, low: double>"
    low = lambda z: f"named_struct('g', {z}.g, 'lo', {z}.lo, 'hi', {z}.hi, 'low', least({z}.low, r.l))"
    return Sequence({
        "z": (ZONES, "array()", _zone_state(live, "r.h", "r.l2", how.formed())),
        "sel": (zone, "NULL", f"CASE WHEN r.c IS NULL THEN NULL WHEN coalesce({pick}, false) THEN {low(f'try_element_at({broken}, -1)')} "
                              f"WHEN coalesce({keep}, false) THEN {low('s.sel')} END"),
        "inv": ("int", "-1", f"CASE WHEN coalesce({pick}, false) THEN r.slot ELSE s.inv END"),
    }, f"{back} AND {INSIDE}", "least(s.sel.low, r.l)", once=False)


# ---- ageing levels and triangles --------------------------------------------------------

LEVELS = "array<struct<px: double, kind: int, born: int, n: int, wait: int, since: int>>"


def ageing_levels(df: DataFrame, window: int, bounces: int, max_age: int, hold: int, width: float, cutoff: int) -> DataFrame:
    """Bounces off confirmed pivot levels that have held ``bounces`` times before.

    A pivot two bars back is known once two later bars confirm it. Levels closer than two widths
    to a live one of the same kind are not opened. A session ends at its first missing bar."""
    w = by_session()
    f = trailing(w, window + 3)
    full = F.count("close").over(f) == window + 3
    gone = F.sum(F.when(F.col("close").isNull(), 1).otherwise(0)).over(upto(w))
    x = df.filter(F.col("atr") > 0).withColumns({
        "_gone": gone, "_band": F.greatest(F.lit(0.25), F.col("atr") * width),
        "_plo": F.when(full & (F.lag("low", 2).over(w) == F.min("low").over(f)), F.lag("low", 2).over(w)),
        "_phi": F.when(full & (F.lag("high", 2).over(w) == F.max("high").over(f)), F.lag("high", 2).over(w))})
    x = x.filter((F.col("_gone") == 0) & (F.col("slot") < cutoff) & (F.col("slot") >= window))
    bar = F.struct("slot", F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"),
                   F.col("_band").alias("b"), F.col("_plo").alias("plo"), F.col("_phi").alias("phi"))
    g = x.groupBy(*KEYS).agg(F.sort_array(F.collect_list(bar)).alias("_bars"))

    def opened(levels, px, kind):
        dup = f"exists({levels}, z -> z.kind = {kind} AND r.slot - z.born <= {max_age} AND abs(z.px - {px}) < 2 * r.b)"
        new = f"array(named_struct('px', {px}, 'kind', {kind}, 'born', r.slot, 'n', 0, 'wait', 0, 'since', 0))"
        return f"(CASE WHEN {px} IS NOT NULL AND NOT {dup} THEN concat({levels}, {new}) ELSE {levels} END)"

    both = opened(opened("s.lv", "r.phi", -1), "r.plo", 1)
    live = f"(r.slot - z.born <= {max_age} AND r.slot <> z.born)"
    due = f"({live} AND z.wait = 1 AND r.slot > z.since)"
    reject, broke = "(z.kind * (r.c - z.px) > r.b)", "(z.kind * (r.c - z.px) < -r.b)"
    touch = f"({live} AND NOT {due} AND r.l <= z.px + r.b AND r.h >= z.px - r.b)"
    moved = (f"transform({both}, z -> named_struct('px', z.px, 'kind', z.kind, 'born', z.born, "
             f"'n', CASE WHEN {due} AND {reject} THEN z.n + 1 ELSE z.n END, "
             f"'wait', CASE WHEN {due} AND ({reject} OR {broke}) THEN 0 WHEN {touch} THEN 1 ELSE z.wait END, "
             f"'since', CASE WHEN {touch} THEN r.slot ELSE z.since END))")
    ready = f"filter({both}, z -> {due} AND {reject} AND z.n >= {bounces})"
    fire = f"(s.last < r.slot AND size({ready}) > 0)"
    ev = f"named_struct('slot', r.slot, 'side', {ready}[0].kind, 'target_ref', r.c + {ready}[0].kind * 2 * r.b)"
    none = "CAST(array() AS array<struct<slot: int, side: int, target_ref: double>>)"
    fold = (f"aggregate(_bars, named_struct('lv', CAST(array() AS {LEVELS}), 'last', -1, 'ev', {none}), (s, r) -> named_struct("
            f"'lv', CAST({moved} AS {LEVELS}), 'last', CASE WHEN {fire} THEN r.slot + {hold} ELSE s.last END, "
            f"'ev', CASE WHEN {fire} THEN concat(s.ev, array({ev})) ELSE s.ev END), s -> s.ev)")
    return g.select(*KEYS, F.inline(F.expr(fold)))


def triangle(df: DataFrame, length: int, delay: int, contraction: float, expiry: int, cutoff: int) -> DataFrame:
    """First break within ``expiry`` of five alternating smoothed pivots that contract.

    ``df`` has ``smooth``; a pivot ``delay`` bars back is the strict extreme of both sides. A break
    before the shape ends the session's chance."""
    w = by_session()
    i = F.lag("smooth", delay).over(w)
    left, right = w.rowsBetween(-2 * delay, -delay - 1), w.rowsBetween(-delay + 1, 0)
    full = (F.count("smooth").over(w.rowsBetween(-2 * delay, 0)) == 2 * delay + 1) & (F.col("slot") - 2 * delay >= length)
    top = full & (i > F.max("smooth").over(left)) & (i > F.max("smooth").over(right))
    low = full & (i < F.min("smooth").over(left)) & (i < F.min("smooth").over(right))
    gone = F.sum(F.when(F.col("close").isNull(), 1).otherwise(0)).over(upto(w))
    ranged = df.filter((F.col("atr") > 0) & F.col("is_normal") & F.col("or_high").isNotNull())
    x = ranged.withColumns({"_gone": gone, "_v": i, "_k": F.when(top, 1).when(low, -1).otherwise(0)})
    x = x.withColumn("_k", F.when((F.col("_v") > F.col("or_low")) & (F.col("_v") < F.col("or_high")), F.col("_k")).otherwise(0))
    x = x.filter((F.col("_gone") == 0) & (F.col("slot") >= length) & (F.col("slot") < cutoff))
    side = F.when(F.col("close") > F.col("or_high"), 1).when(F.col("close") < F.col("or_low"), -1).otherwise(0)
    bar = F.struct("slot", F.col("_v").alias("v"), F.col("_k").alias("k"), side.alias("side"))
    g = x.groupBy(*KEYS).agg(F.sort_array(F.collect_list(bar)).alias("_bars"))
    new = "array(named_struct('v', r.v, 'k', r.k))"
    last = "try_element_at(s.pv, -1)"
    same = f"(size(s.pv) > 0 AND {last}.k = r.k)"
    pv = (f"(CASE WHEN r.k = 0 THEN s.pv WHEN {same} THEN CASE WHEN r.k * (r.v - {last}.v) > 0 THEN concat(slice(s.pv, 1, size(s.pv) - 1), {new}) "
          f"ELSE s.pv END WHEN size(s.pv) = 5 THEN concat(slice(s.pv, 2, 4), {new}) ELSE concat(s.pv, {new}) END)")
    at = lambda j: f"element_at({pv}, {j})"
    closing = " AND ".join(f"{at(j)}.k * ({at(j)}.v - {at(j - 2)}.v) < 0" for j in (3, 4, 5))
    tight = f"abs({at(5)}.v - {at(4)}.v) <= {1 - contraction} * abs({at(2)}.v - {at(1)}.v) AND abs({at(2)}.v - {at(1)}.v) > 0"
    done = f"(CASE WHEN r.k <> 0 AND size({pv}) = 5 THEN {closing} AND {tight} ELSE false END)"
    fold = (f"aggregate(_bars, named_struct('pv', CAST(array() AS array<struct<v: double, k: int>>), 'shape', -1, 'dead', false), "
            f"(s, r) -> named_struct('pv', {pv}, 'shape', CASE WHEN s.shape < 0 AND {done} THEN r.slot ELSE s.shape END, "
            f"'dead', s.dead OR (r.side <> 0 AND s.shape < 0 AND NOT {done})), s -> named_struct('shape', s.shape, 'dead', s.dead))")
    s = g.withColumn("_s", F.expr(fold)).filter("_s.shape >= 0 AND NOT _s.dead")
    hits = F.filter("_bars", lambda r: (r["side"] != 0) & (r["slot"] > F.col("_s.shape")) & (r["slot"] - F.col("_s.shape") <= expiry))
    s = s.withColumn("_h", F.get(hits, F.lit(0))).filter("_h IS NOT NULL")
    return s.select(*KEYS, F.col("_h.slot").alias("slot"), F.col("_h.side").alias("side"), F.col("_s.shape").alias("shape_slot"))
