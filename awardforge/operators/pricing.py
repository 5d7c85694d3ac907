"""Price range from comparable awards, and its backtest. Run-rates are whole cents a year."""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from awardforge.functions.rules import AS_OF
from awardforge.sources import tables

# Fixed values.
TYPES = ("DELIVERY ORDER", "PURCHASE ORDER", "DEFINITIVE CONTRACT", "BPA CALL")
LEAST, TARGET, RECENT_YEARS = 5, 40, 5
LEAST_DAYS, MOST_DAYS = 91, 4383
LEVEL = 0.8
NOT_COMPETED = ("B", "C", "G")
STRENGTH = {"Strong": (15, 0.35, 0.5), "Moderate": (8, 0.6, 0.7)}  # comparables at least, width of the interval and running share at most
ESCALATION = 0.028
COMPETITION = {"as_before": 1.0, "more": 0.94, "less": 1.06}
PRICING = "case when upper(trim(pricing_code)) in ('A', 'J', 'K', 'L', 'M') then 'FFP' when upper(trim(pricing_code)) in ('R', 'S', 'T', 'U', 'V') then 'COST' when upper(trim(pricing_code)) in ('Y', 'Z') then 'TM' end"


def run_rate(today: str = AS_OF) -> Column:
    """Dollars a year over the elapsed term (a quarter to twelve years), in cents; NULL where it cannot be read."""
    days = f"datediff(least(coalesce(current_end, {today}), {today}), pop_start)"
    return F.expr(f"case when value > 0 and {days} > 0 then cast((cast(value * 100 as decimal(38,0)) * 36525) div (100 * greatest(least({days}, {MOST_DAYS}), {LEAST_DAYS})) as long) end")


def pool(awards: DataFrame, today: str = AS_OF) -> DataFrame:
    """Awards that can serve as comparables, keyed by family and class: all four rungs are subsets of that key."""
    p = awards.where(F.upper("award_type").isin(*TYPES)).withColumn("rate", run_rate(today)).where("rate is not null")
    recent = F.coalesce(F.col("signed") >= F.expr(f"add_months({today}, {-12 * RECENT_YEARS})"), F.lit(False))
    running = F.coalesce(F.col("current_end") > F.expr(today), F.lit(False))
    days = F.expr(f"greatest(least(datediff(least(coalesce(current_end, {today}), {today}), pop_start), {MOST_DAYS}), {LEAST_DAYS})")
    p = p.select(
        F.substring("naics", 1, 4).alias("family"), F.substring("psc", 1, 2).alias("class"), F.col("award_id").alias("comp_id"), F.col("naics").alias("comp_naics"), F.col("component").alias("comp_component"),
        F.col("rate").alias("comp_rate"), recent.alias("recent"), F.col("signed").alias("comp_signed"), F.col("value").cast("decimal(18,2)").alias("comp_value"), F.col("psc").alias("comp_psc"),
        F.expr(PRICING).alias("comp_pricing"), running.alias("comp_running"),
        *[F.col(x).alias(f"comp_{x}") for x in ("piid", "offers", "pricing_code") if x in awards.columns], F.col("pop_start").alias("comp_start"), F.col("current_end").alias("comp_end"), days.alias("comp_days"),
    )
    return p.where("family <> '' and class <> ''").withColumn("age", F.coalesce(-F.unix_date("comp_signed"), F.lit(10**9)))


CELL = ["family", "class"]
#: Candidates of a group that a task takes at once; candidates and awards that are compared in one step.
PART, STEP = 10_000, 512
#: A rung needs its newest TARGET rows, and besides them the candidate's own award and fewer than LEAST rows of tighter rungs may lie among the newest.
NEWEST = TARGET + LEAST + 1
_CARRIED = ["comp_id", "comp_rate", "comp_psc", "comp_value", "comp_pricing", "comp_running"]
#: The record behind a comparable.
RECORD = ["comp_piid", "comp_component", "comp_naics", "comp_offers", "comp_pricing_code", "comp_start", "comp_end", "comp_signed", "comp_days"]
#: Bins to a doubling of the price, and how many bins up or down lie wholly within four times it (one short of what fits).
FINE, REACH = 8, 14


def bucket(rate: str) -> str:
    """SQL: the whole part of log4. An award of a quarter to four times a rate lies in the rate's bucket or in one next to it."""
    return f"(length(bin({rate})) - 1) div 2"


def first_matches(rates: np.ndarray, low: np.ndarray, high: np.ndarray, most: int = NEWEST) -> np.ndarray:
    """For each range the places of the first ``most`` rates in it (-1: no more). Rates are read in steps, and a range that has enough leaves."""
    out, have, open_rows = np.full((len(low), most), -1), np.zeros(len(low), np.int64), np.arange(len(low))
    for at in range(0, len(rates), STEP):
        some = rates[at : at + STEP]
        row, place = np.nonzero((some >= low[open_rows, None]) & (some <= high[open_rows, None]))
        nth = have[open_rows][row] + np.arange(len(row)) - np.searchsorted(row, row, "left")
        good = nth < most
        out[open_rows[row[good]], nth[good]] = place[good] + at
        have[open_rows] += np.bincount(row, minlength=len(open_rows))
        open_rows = open_rows[have[open_rows] < most]
        if not len(open_rows):
            break
    return out


def _needed(p: DataFrame, by: list[str] = CELL) -> DataFrame:
    """The awards that can be among the ``NEWEST`` of any price band within their group: at most some thousands a group, however many it has.

    A band from a quarter to four times a rate that holds an award holds all prices up to four times the award's, or all down to
    a quarter of it. So an award is out of reach where a bin of prices within four times its own holds ``NEWEST`` newer ones, and a bin down to a quarter does,
    too. The newest of the group without a band stay as well.
    """
    key = F.struct("age", "comp_id")
    p = p.withColumn("fine", F.when(F.col("comp_rate") < 1, -100).otherwise(F.floor(F.log2("comp_rate") * FINE).cast("int")))
    nth = F.row_number().over(W.partitionBy(*by, "fine").orderBy("age", "comp_id"))
    full = p.select(*by, "fine", "age", "comp_id").withColumn("n", nth).where(F.col("n") <= NEWEST).where(F.col("n") == NEWEST).select(*by, "fine", key.alias("at"))
    reach = F.explode(F.array(*[F.lit(k) for k in range(-REACH, REACH + 1) if k]))
    side = full.withColumn("step", reach).groupBy(*by, (F.col("fine") + F.col("step")).alias("fine")).agg(F.min(F.when(F.col("step") < 0, F.col("at"))).alias("up"), F.min(F.when(F.col("step") > 0, F.col("at"))).alias("down"))
    limit = side.where("up is not null and down is not null").select(*by, "fine", F.greatest("up", "down").alias("limit"))
    return p.join(limit, [*by, "fine"], "left").where(F.coalesce(key <= F.col("limit"), F.lit(True))).drop("fine", "limit")


def _choose(carried: list[str], passed: list[str], rung: int, few: bool):
    def chosen(a: pa.Table, p: pa.Table) -> pa.Table:
        """The newest awards in the price band of each candidate of one group, latest first, then by id: of those that have ``LEAST``, or, if ``few``, of the others."""
        p = p if len(a) else p.slice(0, 0)
        p = p.take(pc.sort_indices(p, sort_keys=[("age", "ascending"), ("comp_id", "ascending")]))
        rate, known, own = p["comp_rate"].to_numpy(), a["rate"].is_valid().to_numpy(), pc.fill_null(a["rate"], 0).to_numpy()
        # without a rate of its own a candidate has no price band
        low, high = np.where(known, (own + 3) // 4, 0), np.where(known, 4 * own, 2**62)
        itself = pc.fill_null(pc.index_in(a["award_id"], value_set=p["comp_id"].combine_chunks()), -1).to_numpy()
        ordered = np.sort(rate)
        n = np.searchsorted(ordered, high, "right") - np.searchsorted(ordered, low, "left")
        at = np.flatnonzero(itself >= 0)
        n[at] -= (rate[itself[at]] >= low[at]) & (rate[itself[at]] <= high[at])
        who = np.flatnonzero((n < LEAST) == few)
        # rows of tighter rungs are found again
        picked = np.full((len(who), NEWEST), -1)
        for k in range(0, len(who), STEP):
            some = who[k : k + STEP]
            found = first_matches(rate, low[some], high[some])
            found[found == itself[some, None]] = -1
            picked[k : k + STEP] = np.take_along_axis(found, np.argsort(found < 0, axis=1, kind="stable"), axis=1)
        picked = picked[:, : TARGET if rung == 1 else TARGET + LEAST - 1]
        good = picked >= 0
        offsets, places = pa.array(np.concatenate([[0], np.cumsum(good.sum(axis=1))]), pa.int32()), pa.array(picked[good])
        lists = {"own": pa.array(np.full(len(places), rung, np.int32))} | {c: p[c].combine_chunks().take(places) for c in carried}
        flat = a.select(passed).take(pa.array(who))
        return pa.table({c: flat[c] for c in passed} | {c: pa.ListArray.from_arrays(offsets, x) for c, x in lists.items()})

    return chosen


def _rung(left: DataFrame, rows: DataFrame, by: list[str], rung: int, carried: list[str], part: int) -> tuple[DataFrame, DataFrame]:
    """The candidates that have ``LEAST`` awards on a rung, with their ``comps``, and the others with the few they have as ``tight``."""
    some = F.lit(True)
    for x in by:
        some = some & F.col(x).isNotNull()
    rows, dealt = _needed(rows.where(some), by), left.where(some)
    # only groups that are cut, so at most one row for so many candidates
    cut = dealt.groupBy(*by).agg((1 + F.floor(F.count(F.lit(1)) / part)).cast("int").alias("parts")).where("parts > 1")
    one = F.coalesce("parts", F.lit(1))
    dealt = dealt.join(F.broadcast(cut), by, "left").withColumn("part", F.pmod(F.xxhash64("candidate_id"), one).cast("int")).drop("parts")
    rows = rows.join(F.broadcast(cut), by, "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).select(*by, "part", *dict.fromkeys(["age", "comp_id", "comp_rate", *carried]))
    kinds = dict(left.dtypes) | dict(rows.dtypes)
    both = dealt.groupBy(*by, "part").cogroup(rows.groupBy(*by, "part"))

    def found(few: bool) -> DataFrame:
        passed = left.columns if few else [x for x in ("candidate_id", "rate", "tight") if x in left.columns]
        schema = ", ".join(f"{x} {kinds[x]}" for x in passed) + ", own array<int>, " + ", ".join(f"{x} array<{kinds[x]}>" for x in carried)
        x = both.applyInArrow(_choose(carried, passed, rung, few), schema)
        return x.withColumn("found", F.arrays_zip("own", *carried)).drop("own", *carried)

    empty = F.array().cast(dict(found(True).dtypes)["found"])
    rest = found(True).unionByName(left.where(~some).withColumn("found", empty))
    return _joined(found(False)).select("candidate_id", F.lit("ABC"[rung - 1]).alias("rung"), F.col("rate").alias("candidate_rate"), "comps"), _joined(rest).withColumnRenamed("comps", "tight")


def _joined(x: DataFrame) -> DataFrame:
    """The rows of tighter rungs first and once, then the others that were found."""
    if "tight" not in x.columns:
        return x.withColumnRenamed("found", "comps")
    ids = F.transform("tight", lambda t: t["comp_id"])
    return x.withColumn("comps", F.slice(F.concat("tight", F.filter("found", lambda t: ~F.array_contains(ids, t["comp_id"]))), 1, TARGET)).drop("tight", "found")


def comparable_sets(c: DataFrame, awards: DataFrame, carried: list[str] = _CARRIED, today: str = AS_OF, part: int = PART) -> DataFrame:
    """The comparables of each candidate as one row: the tightest rung with ``LEAST`` awards, at most ``TARGET`` of them by (own rung, latest, id) in ``comps``.

    The rungs are climbed one after the other: a candidate reads the awards of its office; only those with too few there read the awards of
    their code, and only those with too few there the awards of their cell; the last rung, which has no price band, needs the newest
    awards of the cell alone. Of a group only the awards that a band can reach travel (``_needed``), and its candidates are dealt over
    parts of about ``part``, so no rung reads more rows than there are awards and a bounded number for each part. Both tables
    are read several times; give tables that were written. Candidates that are left after a rung are written.
    """
    read = dict.fromkeys(["comp_id", "comp_rate", *carried])
    left = c.select("candidate_id", "award_id", F.substring("naics", 1, 4).alias("family"), F.substring("psc", 1, 2).alias("class"), "naics", "component", run_rate(today).alias("rate")).where("family <> '' and class <> ''")
    rows = pool(awards, today).select(*CELL, F.col("comp_naics").alias("naics"), F.col("comp_component").alias("component"), "recent", "age", *read)
    recent, done = rows.where("recent"), []
    for rung, (of, by) in enumerate([(recent, [*CELL, "naics", "component"]), (recent, [*CELL, "naics"]), (rows, CELL)], 1):
        full, left = _rung(left, of, by, rung, carried, part)
        done.append(full)
        if rung < 3:
            left = tables.written(left, "left")
    nth = F.row_number().over(W.partitionBy(*CELL).orderBy("age", "comp_id"))
    newest = rows.withColumn("n", nth).where(F.col("n") <= NEWEST).groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("n", F.lit(4).alias("own"), *carried))).alias("all"))
    last = left.join(newest, CELL).withColumn("found", F.transform(F.filter("all", lambda x: x["comp_id"] != F.col("award_id")), lambda x: F.struct(*[x[n].alias(n) for n in ("own", *carried)])))
    last = _joined(last).where(F.size("comps") >= LEAST).select("candidate_id", F.lit("D").alias("rung"), F.col("rate").alias("candidate_rate"), "comps")
    for full in done:
        last = last.unionByName(full)
    return last


def _letter(x: str) -> Column:
    return F.substring(F.lit("ABCD"), F.col(x), F.lit(1))


def comparables(c: DataFrame, awards: DataFrame, today: str = AS_OF, part: int = PART) -> DataFrame:
    """:func:`comparable_sets` as one row for each candidate and award kept for it."""
    return listed(comparable_sets(c, awards, _CARRIED, today, part))


def listed(sets: DataFrame) -> DataFrame:
    x = sets.select("candidate_id", "rung", "candidate_rate", F.explode("comps").alias("x")).select("candidate_id", "rung", "candidate_rate", "x.*")
    return x.select("candidate_id", "rung", "comp_id", _letter("own").alias("own_rung"), *[n for n in x.columns if n not in ("candidate_id", "rung", "comp_id", "own")])


def audit(c: DataFrame, awards: DataFrame, today: str = AS_OF) -> DataFrame:
    """The comparables with the record behind each: one long row for every candidate and award kept for it. Records travel with the awards, so the long table is not joined."""
    x = listed(comparable_sets(c, awards, [n for n in _CARRIED if n != "comp_pricing"] + RECORD, today))
    return x.select("candidate_id", "comp_id", "own_rung", "comp_rate", "comp_psc", "comp_value", "comp_running", *RECORD, F.lit("obligated_run_rate").alias("value_basis"))


def ranges(c: DataFrame, sets: DataFrame, factor: Column | None = None, years: Column | None = None) -> DataFrame:
    """Winsorised quartiles of the comparables' rates with how far to trust them; under ``LEAST`` comparables there is a refusal, not a number.

    ``factor`` is a scenario's multiplier and ``years`` a term to project over, both columns of ``c``. Strength needs
    enough comparables, a narrow interval of the median and few that still run; the last rung is always weak and comparables of
    several pricing families are never strong. ``divergence`` is the candidate's own rate against the median in thousandths.
    """
    each = lambda name: F.transform("comps", lambda x: x[name])
    families = F.array_join(F.array_sort(F.array_distinct(F.array_compact(each("comp_pricing")))), ",")
    g = sets.select(
        "candidate_id", "rung", F.sort_array(each("comp_rate").cast("array<double>")).alias("r"), F.size("comps").cast("long").alias("n"),
        families.alias("families"), F.size(F.filter("comps", lambda x: x["comp_running"])).cast("long").alias("n_running"),
    )
    g = g.withColumns({"lo": _quantile("r", 0.05), "hi": _quantile("r", 0.95)}).withColumn("w", F.transform("r", lambda x: F.least(F.greatest(x, F.col("lo")), F.col("hi"))))
    # only complete sets become numbers
    full = F.col("n") >= LEAST
    k = F.create_map(*[F.lit(x) for pair in median_places().items() for x in pair])[F.least(F.size("w"), F.lit(TARGET))]
    interval = {"ci_low": F.element_at("w", F.when(full, k).otherwise(1)), "ci_high": F.element_at("w", F.when(full, -k).otherwise(-1))}
    g = g.withColumns({"low": _quantile("w", 0.25), "median": _quantile("w", 0.5), "high": _quantile("w", 0.75)} | interval)
    x = c.select("candidate_id", (factor if factor is not None else F.lit(1.0)).alias("factor"), (years if years is not None else F.lit(1)).alias("years"), run_rate().alias("own_rate"), F.coalesce(F.upper(F.trim("extent_code")).isin(*NOT_COMPETED), F.lit(False)).alias("not_competed"))
    x = x.join(g.drop("r", "w", "lo", "hi").where("n > 0"), "candidate_id", "left").withColumn("full", F.coalesce(full, F.lit(False)))
    width, running = (F.col("ci_high") - F.col("ci_low")) / F.col("median"), F.col("n_running") / F.col("n")
    level = F.lit("Weak")
    for name, (least, widest, most_running) in reversed(STRENGTH.items()):
        level = F.when((F.col("n") >= least) & (width <= widest) & (running <= most_running), name).otherwise(level)
    mixed = F.instr("families", ",") > 0
    level = F.when(F.col("rung") == "D", "Weak").when(mixed & (level == "Strong"), "Moderate").otherwise(level)
    scaled = lambda name: F.col(name) * F.col("factor")
    term = F.aggregate(F.sequence(F.lit(0), F.greatest(F.col("years"), F.lit(1)) - 1), F.lit(0.0), lambda a, y: a + F.pow(F.lit(1 + ESCALATION), y))
    shown = lambda col: F.when(F.col("full"), col)
    return x.select(
        "candidate_id", shown(F.col("rung")).alias("rung"), F.coalesce("n", F.lit(0)).alias("n_comparables"),
        *[shown(scaled(v)).alias(v) for v in ("low", "median", "high", "ci_low", "ci_high")],
        *[shown(scaled(v) * term).alias(f"{v}_term") for v in ("low", "median", "high")],
        F.when(F.col("full"), level).otherwise("Insufficient").alias("strength"), shown(F.expr("(n_running * 2000 + n) div (2 * n)")).alias("running_permille"),
        shown(F.when(F.col("families") == "", "unknown").otherwise(F.col("families"))).alias("pricing_mix"),
        F.when(F.col("full"), "comparables").otherwise("insufficient").alias("range_basis"), F.col("own_rate").alias("candidate_rate"),
        shown(F.round((F.col("own_rate") - scaled("median")) / scaled("median") * 1000, 0).cast("long")).alias("divergence"),
        shown(F.when(F.col("own_rate").isNotNull(), (F.col("own_rate") < scaled("low")) | (F.col("own_rate") > scaled("high")))).alias("outside"),
        "not_competed",
    )


def scenario(c: DataFrame, sets: DataFrame, excluded: DataFrame | Callable[[Column], Column] | None = None, competition: str = "as_before", years: Column | None = None) -> DataFrame:
    """The ranges anew: without the comparables in ``excluded`` (rows ``candidate_id, comp_id`` or a condition on a comparable), under another assumption on competition, over a term."""
    if isinstance(excluded, DataFrame):
        gone = excluded.groupBy("candidate_id").agg(F.collect_set("comp_id").alias("gone"))
        sets = sets.join(gone, "candidate_id", "left").withColumn("comps", F.filter("comps", lambda x: ~F.coalesce(F.array_contains("gone", x["comp_id"]), F.lit(False)))).drop("gone")
    elif excluded is not None:
        sets = sets.withColumn("comps", F.filter("comps", lambda x: ~F.coalesce(excluded(x), F.lit(False))))
    return ranges(c, sets, F.lit(COMPETITION[competition]), years)


def _quantile(column: str, q: float) -> Column:
    """Linear interpolation on a sorted array."""
    n = F.size(column) - 1
    at = n * F.lit(q)
    below = F.floor(at).cast("int")
    a, b = F.get(column, below), F.get(column, F.least(below + 1, n))
    return a + (b - a) * (at - below)


def median_places(level: float = LEVEL) -> dict[int, int]:
    """For each count n of comparables the greatest k for which the k-th least and k-th greatest value bound the median at ``level``."""
    out = {}
    for n in range(LEAST, TARGET + 1):
        tail, k = 0, 0
        while 2 * (tail + comb(n, k)) <= (1 - level) * 2**n:
            tail, k = tail + comb(n, k), k + 1
        out[n] = max(k, 1)
    return out


def _wavelet(rank: np.ndarray) -> list[np.ndarray]:
    """A wavelet matrix over whole numbers: for each bit from the highest on, how many zeros stand before each place of the order so far."""
    out, order = [], rank
    for bit in range(max(int(len(rank)).bit_length() - 1, 0), -1, -1):
        one = (order >> bit & 1).astype(bool)
        out.append(np.concatenate([[0], np.cumsum(~one)]))
        order = np.concatenate([order[~one], order[one]])
    return out


def _below(levels: list[np.ndarray], upto: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """How many of the first ``upto`` numbers are less than ``rank``."""
    a, b, count = np.zeros(len(upto), np.int64), upto.astype(np.int64), np.zeros(len(upto), np.int64)
    over = rank >= 1 << len(levels)
    for depth, zeros in enumerate(levels):
        one = (rank >> (len(levels) - 1 - depth) & 1).astype(bool)
        za, zb = zeros[a], zeros[b]
        count += np.where(one, zb - za, 0)
        a, b = np.where(one, zeros[-1] + a - za, za), np.where(one, zeros[-1] + b - zb, zb)
    return np.where(over, upto, count)


def _nth(levels: list[np.ndarray], upto: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The number of place ``n`` (from 0) among the first ``upto`` numbers in ascending order."""
    a, b, n, found = np.zeros(len(upto), np.int64), upto.astype(np.int64), n.astype(np.int64).copy(), np.zeros(len(upto), np.int64)
    for zeros in levels:
        za, zb = zeros[a], zeros[b]
        one = n >= zb - za
        n -= np.where(one, zb - za, 0)
        found = found << 1 | one
        a, b = np.where(one, zeros[-1] + a - za, za), np.where(one, zeros[-1] + b - zb, zb)
    return found


def _known_ranges(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
    """For the completed awards of one cell and price bucket: quartiles of the rates in their band that were signed by their end, all at once."""
    names = ["award_id", "n_comparables", "contained"]
    if q.empty or p.empty:
        return pd.DataFrame(columns=names)
    p = p.sort_values("signed", kind="stable")
    day, rate = p["signed"].to_numpy("datetime64[D]").astype(np.int64), p["rate"].to_numpy(np.int64)
    values = np.sort(rate)
    # equal rates get ranks of their own, so that a rank is a rate
    rank = np.empty(len(rate), np.int64)
    rank[np.argsort(rate, kind="stable")] = np.arange(len(rate))
    levels = _wavelet(rank)
    end, own, after = q["current_end"].to_numpy("datetime64[D]").astype(np.int64), q["rate"].to_numpy(np.int64), q["next_rate"].to_numpy(np.int64)
    upto = np.searchsorted(day, end, "right")
    under = _below(levels, upto, np.searchsorted(values, (own + 3) // 4, "left"))
    inside = _below(levels, upto, np.searchsorted(values, 4 * own, "right")) - under
    # the award itself lies in its own band if it was signed by its end
    there = q["signed"].to_numpy("datetime64[D]").astype(np.int64) <= end
    itself = _below(levels, upto, np.searchsorted(values, own, "left")) - under
    n = inside - there

    def value(place: np.ndarray) -> np.ndarray:
        place = place + (there & (place >= itself))
        return values[_nth(levels, upto, under + np.clip(place, 0, np.maximum(inside - 1, 0)))]

    bounds = []
    for level in (0.25, 0.75):
        at = (n - 1) * level
        low = np.floor(at).astype(np.int64)
        a, b = value(low), value(np.minimum(low + 1, n - 1))
        bounds.append(a + (b - a) * (at - low))
    good = n >= LEAST
    return pd.DataFrame({"award_id": q["award_id"].to_numpy()[good], "n_comparables": n[good], "contained": ((after >= bounds[0]) & (after <= bounds[1]))[good]})


def _follow_on(a: DataFrame, today: str) -> DataFrame:
    """Completed awards with the next award of their cell signed after their end: an as-of join as one sorted union of awards and ends.

    Each cell is cut by year of signature, so that a common cell is many windows; an end that sees no later award in its year takes the first
    of the next year that has one.
    """
    cell = ["naics", "class", "component"]
    one = F.struct("signed", "award_id", "rate")
    # the award that follows each award, for an end whose next award is its own
    made = a.select(*cell, "award_id", "signed", "rate").withColumn("year", F.year("signed"))
    events = made.select(*cell, "year", F.col("signed").alias("day"), F.lit(1).alias("kind"), one.alias("award"), F.lit(None).cast("struct<award_id:string,current_end:date,rate:bigint,signed:date>").alias("done"))
    ends = a.where(f"current_end < {today}").select(*cell, F.year("current_end").alias("year"), F.col("current_end").alias("day"), F.lit(0).alias("kind"), F.lit(None).cast("struct<signed:date,award_id:string,rate:bigint>").alias("award"), F.struct("award_id", "current_end", "rate", "signed").alias("done"))
    back = W.partitionBy(*cell, "year").orderBy(F.desc("day"), "kind", F.desc("award.award_id")).rowsBetween(W.unboundedPreceding, -1)
    # the two nearest later awards: the nearest may be the award itself
    later = events.unionByName(ends).withColumn("next", F.last("award", ignorenulls=True).over(back))
    pair = later.withColumn("nearest", F.when(F.col("kind") == 1, F.struct(F.col("award").alias("one"), F.col("next").alias("two"))))
    seen = pair.withColumn("ahead", F.last("nearest", ignorenulls=True).over(back)).where("kind = 0")
    first = made.withColumn("place", F.row_number().over(W.partitionBy(*cell, "year").orderBy("signed", "award_id"))).where("place <= 2")
    years = first.groupBy(*cell, "year").agg(F.array_sort(F.collect_list(one)).alias("first"))
    marks = ends.select(*cell, "year").distinct().join(years, [*cell, "year"], "full")
    on = W.partitionBy(*cell).orderBy(F.desc("year")).rowsBetween(W.unboundedPreceding, -1)
    near = marks.withColumn("b1", F.last("first", ignorenulls=True).over(on))
    both = seen.join(near.select(*cell, "year", "b1"), [*cell, "year"], "left")
    options = F.filter(F.concat(F.array("ahead.one", "ahead.two"), F.coalesce("b1", F.array().cast("array<struct<signed:date,award_id:string,rate:bigint>>"))), lambda x: x.isNotNull() & (x["award_id"] != F.col("done.award_id")))
    found = both.withColumn("following", F.get(options, 0)).where("following is not null")
    return found.select("naics", "class", "done.*", F.col("following.award_id").alias("next_id"), F.col("following.rate").alias("next_rate"))


def backtest(awards: DataFrame, today: str = AS_OF) -> DataFrame:
    """For each completed award with a follow-on in its cell: was the follow-on's rate inside the range known at the end?

    The follow-on is the next award of the cell signed after the end (ties by id). The range is of awards of the
    same code and class signed by then and within a quarter to four times the rate. Awards go to their price bucket and both
    neighbours; there the quartiles of all completed awards are read from one wavelet matrix over the awards in order
    of signature, without a list of comparables for any of them.
    """
    a = awards.withColumn("rate", run_rate(today)).where("rate is not null and signed is not null").select("award_id", "naics", F.substring("psc", 1, 2).alias("class"), "component", "signed", "current_end", "rate")
    pairs = _follow_on(a, today).withColumn("bucket", F.expr(bucket("rate")).cast("int"))
    at = F.expr(bucket("rate")).cast("int")
    known = a.select(F.col("naics").alias("n2"), F.col("class").alias("c2"), F.explode(F.array(at - 1, at, at + 1)).alias("b2"), F.col("signed").alias("signed"), F.col("rate").alias("rate"))
    return pairs.groupBy("naics", "class", "bucket").cogroup(known.groupBy("n2", "c2", "b2")).applyInPandas(_known_ranges, "award_id string, n_comparables long, contained boolean")


def coverage(tested: DataFrame) -> DataFrame:
    """How often the range held the follow-on, in thousandths; NULL where nothing could be tested."""
    n, k = F.count(F.lit(1)), F.count(F.when(F.col("contained"), 1))
    one = tested.agg(n.alias("n_pairs"), k.alias("n_contained"))
    return one.select("n_pairs", "n_contained", F.when(F.col("n_pairs") > 0, F.expr("(n_contained * 2000 + n_pairs) div (2 * n_pairs)")).alias("coverage_permille"), F.when(F.col("n_pairs") > 0, "measured").otherwise("no pairs").alias("basis"))
