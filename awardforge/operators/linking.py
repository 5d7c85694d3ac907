"""Candidates to notices: by identifier or by title, gated by dates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from awardforge.functions.privacy import WITHHELD

STRONG, LOOSE, BEFORE, AFTER = 70, 55, 24, 12
#: Tasks that share the pairs of one title; candidates of one title that a task takes at once.
SALTS, PART = 8, 20_000
#: A code after all notices; days before and after all others.
NONE, FIRST, LAST = np.int64(2**62), -(10**7), 10**7


def normal_id(x: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9]", ""))


def token_sort_similarity(a: str, b: str) -> float:
    """100 * 2 LCS / (|a| + |b|) over the words of each side in sorted order."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not a and not b:
        return 0.0
    # bit-parallel longest common subsequence
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & where.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    lcs = len(a) - v.bit_count()
    return 200.0 * lcs / (len(a) + len(b))


def similarities(left: list[str], right: list[str]) -> np.ndarray:
    """:func:`token_sort_similarity` of every left title with every right one: the bits of one right title stand for its characters, and all left titles are read in step."""
    a = [" ".join(sorted(x.split())) for x in left]
    sizes = np.array([len(x) for x in a])
    points = np.zeros((len(a), max(1, sizes.max(initial=1))), np.uint32)
    for k, x in enumerate(a):
        points[k, : len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.empty((len(left), len(right)))
    for k, title in enumerate(right):
        b = " ".join(sorted(title.split()))
        if len(b) > 64:
            out[:, k] = [token_sort_similarity(x, b) for x in a]
            continue
        where: dict[int, int] = {}
        for i, ch in enumerate(b):
            where[ord(ch)] = where.get(ord(ch), 0) | 1 << i
        known = np.array(sorted(where), np.uint32)
        bits = np.append(np.array([where[c] for c in sorted(where)], np.uint64), np.uint64(0))
        if not len(known):
            out[:, k] = 0.0
            continue
        at = np.searchsorted(known, points)
        masks = bits[np.where(known[np.minimum(at, len(known) - 1)] == points, np.minimum(at, len(known) - 1), len(known))]
        full = np.uint64((1 << len(b)) - 1)
        v = np.full(len(a), full)
        for j in range(points.shape[1]):
            u = v & masks[:, j]
            v = ((v + u) | (v - u)) & full
        out[:, k] = 200.0 * (len(b) - np.bitwise_count(v).astype(np.int64)) / (sizes + len(b))
    return out


def _fewest(n: Column, least: int) -> Column:
    """The fewest characters that a title of ``n`` characters must have in common with any title of similarity ``least``: the shortest such title lies in it whole."""
    shortest = F.ceil(n * least / (200 - least))
    return F.ceil(F.lit(least) * (n + shortest) / 200)


def _prefixes(titles: DataFrame, least: int) -> DataFrame:
    """``(side, title, n, prefix)``: the rarest characters of each title, as many as one of them must be shared. The second ``e`` of a title is another character than its first."""

    def characters(frames):
        for f in frames:
            rows = []
            for side, title in zip(f["side"], f["title"], strict=True):
                seen: dict[str, int] = {}
                for ch in " ".join(sorted(title.split())):
                    seen[ch] = seen.get(ch, 0) + 1
                n = sum(seen.values())
                rows += [(side, title, n, f"{ch}{k}") for ch, times in seen.items() for k in range(times)]
            yield pd.DataFrame(rows, columns=["side", "title", "n", "token"])

    tokens = titles.mapInPandas(characters, "side string, title string, n int, token string")
    rare = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("titles"))
    ranked = tokens.join(rare, "token").groupBy("side", "title", "n").agg(F.array_sort(F.collect_list(F.struct("titles", "token"))).alias("x"))
    return ranked.withColumn("prefix", F.expr("transform(x, y -> y.token)")).withColumn("prefix", F.slice("prefix", F.lit(1), (F.col("n") - _fewest(F.col("n"), least) + 1).cast("int"))).drop("x")


def similar_titles(left: DataFrame, right: DataFrame, least: int = LOOSE) -> DataFrame:
    """``(left_title, right_title, similarity)`` of all pairs of distinct titles at ``least`` or more.

    The longest common subsequence of two titles is no longer than the characters they share, repeats counted. So
    titles are joined on the rarest characters of each, a prefix long enough that a similar pair must share one,
    where their lengths allow the similarity; a pair meets at the first character that both prefixes have. What
    remains is scored exactly. On titles of 20 to 45 letters the bound on shared characters leaves 26 % of the pairs at 55 and 7 %
    at 70, of which 7 and 4 % are that similar: the limit is low, so a large part of the work is not avoidable. Blank and withheld
    titles are like nothing.
    """
    known = lambda df, side: df.select(F.lit(side).alias("side"), "title").where((F.trim("title") != "") & (F.col("title") != WITHHELD)).distinct()
    prefixes = _prefixes(known(left, "left").union(known(right, "right")), least)
    side = lambda name: prefixes.where(F.col("side") == name).select(F.col("title").alias(f"{name}_title"), F.col("n").alias(f"{name}_n"), F.col("prefix").alias(f"{name}_prefix"), F.explode("prefix").alias("token"))
    met = side("left").join(side("right"), "token")
    n, m = F.col("left_n"), F.col("right_n")
    met = met.where(200 * F.least(n, m) >= least * (n + m)).where(F.element_at(F.array_intersect("left_prefix", "right_prefix"), 1) == F.col("token"))

    def task(frames):
        for f in frames:
            for title, own in f.groupby("right_title", sort=False):
                found = similarities(own["left_title"].tolist(), [title])[:, 0]
                good = found >= least
                yield pd.DataFrame({"left_title": own["left_title"].to_numpy()[good], "right_title": title, "similarity": found[good]})

    # pairs of one right title come together, but a title that is like very many is dealt over several tasks
    dealt = met.select("left_title", "right_title").repartition("right_title", F.pmod(F.xxhash64("left_title"), F.lit(SALTS)))
    return dealt.sortWithinPartitions("right_title").mapInPandas(task, "left_title string, right_title string, similarity double")


def id_links(c: DataFrame, notices: DataFrame) -> DataFrame:
    """Equal identifiers: an award's own or its parent's against the notice's number."""
    ids = c.select("candidate_id", F.explode(F.array_distinct(F.array(normal_id(F.col("piid")), normal_id(F.col("parent_idv"))))).alias("id")).where("id <> ''")
    keyed = notices.withColumn("id", normal_id(F.col("solicitation_number"))).where("id <> ''").select("id", "notice_id")
    return ids.join(keyed, "id").select("candidate_id", "notice_id").distinct()


def _least_in(codes: np.ndarray):
    """A function ``(a, b) -> least code in each range [a, b)``, from a table of the least codes of runs of 1, 2, 4, ... places; NONE for an empty range."""
    table = [codes]
    while 2 << (len(table) - 1) <= len(codes):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, width = np.full(len(a), NONE), b - a
        level = np.where(width > 0, np.frexp(np.maximum(width, 1))[1] - 1, -1)
        for k in np.unique(level[level >= 0]).tolist():
            at = level == k
            out[at] = np.minimum(table[k][a[at]], table[k][b[at] - (1 << k)])
        return out

    return least


def _best_titled(c: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
    """Candidates of one title against the notices of similar titles: the best open one, and whether any failed a date gate.

    Notices of one similarity, code, agency and state rank alike, so each such group is asked once for all candidates: its days are
    sorted, and the least notice within the windows is looked up, not searched.
    """
    if c.empty or n.empty:
        return pd.DataFrame(columns=["candidate_id", "kind", "rank", "notice_id", "notice_type", "recency", "origin"])
    n = n.sort_values(["notice_id", "notice_type"], kind="stable").reset_index(drop=True)
    starts, ended = c["pop_start"].fillna(FIRST).to_numpy(np.int64), c["ended"].to_numpy(bool)
    windows = [(c[f"w{k}_from"].fillna(LAST).to_numpy(np.int64), c[f"w{k}_to"].fillna(FIRST).to_numpy(np.int64)) for k in (1, 2)]
    rank, code, kind = np.full(len(c), -1.0), np.full(len(c), NONE), np.full(len(c), None, object)
    recency, origin = np.zeros(len(c), bool), np.zeros(len(c), bool)
    own = {x: c[x].to_numpy(object) for x in ("naics", "agency", "state")}
    for (similarity, *group), rows in n.groupby(["similarity", "n_naics", "n_agency", "n_state"], dropna=False, sort=False):
        match = [np.zeros(len(c), bool) if pd.isna(x) else own[name] == x for name, x in zip(own, group, strict=True)]
        strong = similarity >= STRONG
        use = np.full(len(c), True) if strong else np.logical_or.reduce(match)
        if not use.any():
            continue
        dated = rows[rows["posted"].notna()].sort_values("posted", kind="stable")
        days, codes = dated["posted"].to_numpy(np.int64), dated.index.to_numpy(np.int64)
        undated = rows.index[rows["posted"].isna()]
        least, begun = _least_in(codes), np.searchsorted(days, starts, "left")
        ranges = []
        for low, high in windows:
            a = np.maximum(np.searchsorted(days, low, "left"), begun)
            ranges.append((a, np.maximum(np.searchsorted(days, high, "right"), a)))
        (a1, b1), (a2, b2) = ranges
        last = np.full(len(c), len(days))
        found = np.where(ended, np.minimum(least(a1, b1), least(a2, b2)), least(begun, last))
        if len(undated):
            found = np.minimum(found, undated.min())
        inside = (b1 - a1) + (b2 - a2) - np.maximum(np.minimum(b1, b2) - np.maximum(a1, a2), 0)
        recency |= use & ended & (last - begun > inside)
        origin |= use & (begun > 0)
        value = similarity / (5 if strong else 10) + 15 * match[0] + 10 * match[1] + 8 * match[2]
        better = use & (found < NONE) & ((value > rank) | ((value == rank) & (found < code)))
        rank[better], code[better], kind[better] = value[better], found[better], "Medium" if strong else "Low"
    hit = code < NONE
    text = lambda x: np.where(hit, n[x].to_numpy(object)[np.where(hit, code, 0)], None)
    return pd.DataFrame({"candidate_id": c["candidate_id"], "kind": kind, "rank": rank, "notice_id": text("notice_id"), "notice_type": text("notice_type"), "recency": recency.astype(np.int32), "origin": origin.astype(np.int32)})


def titled_links(of: DataFrame, found: DataFrame, n: DataFrame, part: int = PART) -> DataFrame:
    """The best notice by title of each candidate. A title that very many candidates have is dealt over parts, each of which gets the title's notices: one row for each day, code, agency and state."""
    day = lambda x: F.unix_date(x)
    parts = of.groupBy("left_title").agg((1 + F.floor(F.count(F.lit(1)) / part)).cast("int").alias("parts"))
    titles = parts.join(found, "left_title").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    daily = n.groupBy("right_title", "n_naics", "n_agency", "n_state", "posted_date").agg(F.min(F.struct("notice_id", "notice_type")).alias("notice"))
    right = titles.join(daily, "right_title").select(F.col("left_title").alias("titled"), "part", "similarity", "n_naics", "n_agency", "n_state", day("posted_date").alias("posted"), "notice.*")
    windows = {f"w{k}_{end}": day(F.add_months(x, months)) for k, x in ((1, "expiry"), (2, "current_end")) for end, months in (("from", -BEFORE), ("to", AFTER))}
    left = of.join(parts, "left_title").withColumns(windows | {"ended": F.coalesce("expiry", "current_end").isNotNull(), "pop_start": day("pop_start"), "part": F.pmod(F.xxhash64("candidate_id"), F.col("parts")).cast("int")})
    left = left.select("left_title", "part", "candidate_id", "naics", "agency", "state", "pop_start", "ended", *windows)
    kinds = "candidate_id string, kind string, rank double, notice_id string, notice_type string, recency int, origin int"
    return left.groupBy("left_title", "part").cogroup(right.withColumn("part", F.col("part") + 0).groupBy("titled", "part")).applyInPandas(_best_titled, kinds)


def links(c: DataFrame, notices: DataFrame, by_title: bool = True) -> DataFrame:
    """The best notice of each candidate, or why there is none. Rank ties go to the smallest notice id.

    Dates gate only where both are known: a notice before the award's start is its own origin, and one outside
    both windows around its ends is not its successor.
    """
    n = notices.select("notice_id", "notice_type", "posted_date", F.col("title").alias("right_title"), F.col("naics").alias("n_naics"), F.col("agency").alias("n_agency"), F.upper("state").alias("n_state"))
    of = c.select("candidate_id", F.col("title").alias("left_title"), "naics", "agency", F.upper("state").alias("state"), "pop_start", "expiry", "current_end")
    x = id_links(c, notices).join(n, "notice_id").join(of, "candidate_id").withColumn("similarity", F.lit(0.0))
    if by_title:
        found = similar_titles(c, notices)
        x = x.drop("similarity").join(found, ["left_title", "right_title"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    flag = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("int")
    rank = 100.0 + F.when(F.col("similarity") >= STRONG, F.col("similarity") / 5).otherwise(0.0) + 15 * flag("naics", "n_naics") + 10 * flag("agency", "n_agency") + 8 * flag("state", "n_state")
    inside = lambda end: F.coalesce(F.col("posted_date").between(F.add_months(end, -BEFORE), F.add_months(end, AFTER)), F.lit(False))
    origin = F.coalesce(F.col("posted_date") < F.col("pop_start"), F.lit(False))
    late = ~origin & F.col("posted_date").isNotNull() & F.coalesce("expiry", "current_end").isNotNull() & ~inside("expiry") & ~inside("current_end")
    shut = origin | late
    x = x.select("candidate_id", F.lit("High").alias("kind"), rank.alias("rank"), F.when(~shut, F.col("notice_id")).alias("notice_id"), F.when(~shut, F.col("notice_type")).alias("notice_type"), late.cast("int").alias("recency"), origin.cast("int").alias("origin"))
    if by_title:
        x = x.unionByName(titled_links(of, found, n))
    notice = F.struct("notice_id", "notice_type")
    best = x.groupBy("candidate_id").agg(
        F.min_by(F.struct(notice.alias("notice"), "kind"), F.when(F.col("notice_id").isNotNull(), F.struct(-F.col("rank"), notice))).alias("best"),
        F.max("recency").alias("recency"), F.max("origin").alias("origin"),
    )
    out = c.select("candidate_id").join(best, "candidate_id", "left")
    reason = F.when(F.col("best").isNotNull(), "linked").when(F.col("recency") == 1, "outside both windows").when(F.col("origin") == 1, "posted before the award began").otherwise("no establishing match")
    return out.select("candidate_id", F.col("best.notice.notice_id").alias("notice_id"), F.col("best.notice.notice_type").alias("notice_type"), F.coalesce("best.kind", F.lit("No Match")).alias("link_confidence"), reason.alias("link_reason"))
