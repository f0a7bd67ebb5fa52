"""Cost of planned requests, history of blocks, and the pace to start at."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import PER_PAGE, PER_PROFILE_PAGE
from ..sources.stores import is_drill

LOAD_SECONDS, MIN_DELAY, MAX_DELAY, COOLDOWN_SECONDS, COOLDOWN_EVERY, CROWDED = 3.0, 4.0, 11.0, 90.0, 10, 30


def pages_needed(pages: int, max_results: int | None, per_page: int) -> int:
    return pages if max_results is None else max(1, min(pages, math.ceil(max_results / per_page)))


def listings_bound(seeds: Column, depth: int, breadth: int) -> Column:
    """Seeds and every level expanded to full breadth, per record."""
    return (seeds * sum(breadth**k for k in range(depth + 1))).cast("long")


@dataclass(frozen=True)
class Budget:
    pages: int = 1
    max_results: int | None = None
    depth: int = 0
    breadth: int = 5
    bibtex: bool = False
    min_delay: float = MIN_DELAY
    max_delay: float = MAX_DELAY
    cooldown_seconds: float = COOLDOWN_SECONDS
    cooldown_every: int = COOLDOWN_EVERY


def plan_cost(targets: DataFrame, budget: Budget) -> DataFrame:
    """Worst-case cost of ``targets`` (column ``kind``: 'listing' or 'author'), one row."""
    b = budget
    lp, ap = pages_needed(b.pages, b.max_results, PER_PAGE), pages_needed(b.pages, b.max_results, PER_PROFILE_PAGE)
    lr, ar = min(b.max_results or lp * PER_PAGE, lp * PER_PAGE), min(b.max_results or ap * PER_PROFILE_PAGE, ap * PER_PROFILE_PAGE)
    n = targets.agg(F.count_if(F.col("kind") == "listing").alias("listings"), F.count_if(F.col("kind") == "author").alias("authors"))
    c = F.col
    n = n.withColumns({"seed_loads": c("listings") * lp + c("authors") * ap, "seed_records": c("listings") * lr + c("authors") * ar})
    n = n.withColumn("follow_listings", listings_bound(c("listings") + c("authors"), b.depth, b.breadth) - c("listings") - c("authors"))
    n = n.withColumns({"follow_loads": c("follow_listings") * lp, "follow_records": c("follow_listings") * lr})
    n = n.withColumn("bibtex_loads", (c("listings") * lr + c("follow_records")) * (2 if b.bibtex else 0) + c("authors") * ar * (3 if b.bibtex else 0))
    n = n.withColumns({"total_loads": c("seed_loads") + c("follow_loads") + c("bibtex_loads"), "total_records": c("seed_records") + c("follow_records")})
    n = n.withColumn("cooldowns", F.floor(c("total_loads") / b.cooldown_every).cast("long") if b.cooldown_every else F.lit(0).cast("long"))
    return n.withColumn("seconds", F.greatest(c("total_loads") - 1, F.lit(0)) * ((b.min_delay + b.max_delay) / 2) + c("total_loads") * LOAD_SECONDS + c("cooldowns") * b.cooldown_seconds)


def block_history(events: DataFrame, order: str) -> DataFrame:
    """One row over the real blocks: ``blocks``, ``back_to_back``, ``typical_request``, ``last_at``."""
    real = events.where(~is_drill(F.col("outcome"), F.col("target")))
    return real.agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("consecutive") > 1).alias("back_to_back"), F.percentile("request_index", 0.5).cast("bigint").alias("typical_request"), F.max_by("at", order).alias("last_at")
    )


def kinds(events: DataFrame, drills: bool = False) -> DataFrame:
    rows = events if drills else events.where(~is_drill(F.col("outcome"), F.col("target")))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def latest(events: DataFrame, order: str, n: int = 5) -> DataFrame:
    return events.orderBy(F.desc(order)).limit(n)


def pace_factor(blocks: Column, back_to_back: Column, typical: Column) -> Column:
    """How much wider to start: 1.0 for one block, more for repeated, close and early ones."""
    wide = F.when(blocks < 5, 1.3).otherwise(1.6) + F.when(back_to_back > 0, 0.2).otherwise(0.0) + F.when(typical <= CROWDED, 0.2).otherwise(0.0)
    return F.when(blocks < 2, 1.0).otherwise(wide)


def advise(history: DataFrame, min_delay: float = MIN_DELAY, max_delay: float = MAX_DELAY) -> DataFrame:
    """The history with ``factor``, ``min_delay``, ``max_delay`` (half-even to 0.1); no row without blocks."""
    f = pace_factor(F.col("blocks"), F.col("back_to_back"), F.col("typical_request"))
    out = history.where("blocks > 0").withColumn("factor", f)
    return out.withColumns({"min_delay": F.bround(F.lit(min_delay) * F.col("factor"), 1), "max_delay": F.bround(F.lit(max_delay) * F.col("factor"), 1)})


def span_text(low: Column, high: Column) -> Column:
    """A range of delays, one number if they are the same."""
    g = lambda x: F.regexp_replace(F.format_number(x, 1), r"\.0$", "")
    return F.when(low == high, F.concat(g(low), F.lit("s"))).otherwise(F.concat(g(low), F.lit("–"), g(high), F.lit("s")))


def plan_text(plan: DataFrame, budget: Budget) -> DataFrame:
    """``k`` and ``line`` of a plan of :func:`plan_cost`: what the seeds, the expansion and the exports cost, in all and in time."""
    c = lambda n: F.col(n).cast("string")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    seconds = F.col("seconds")
    time = F.when(seconds >= 5_400, say(F.format_number(seconds / 3_600, 1), " h")).when(seconds >= 90, say(F.bround(seconds / 60, 0).cast("long").cast("string"), " min")).otherwise(say(F.bround(seconds, 0).cast("long").cast("string"), "s"))
    rest = F.when(F.col("cooldowns") > 0, say(" plus ", c("cooldowns"), f" cooldowns of {budget.cooldown_seconds:.0f}s")).otherwise("")
    lines = F.array(
        say("seed targets: ", c("seed_loads"), " page loads, up to ", c("seed_records"), " records"),
        F.when(F.col("follow_listings") > 0, say("citation expansion: up to ", c("follow_listings"), " listings, ", c("follow_loads"), " page loads, up to ", c("follow_records"), " records")),
        F.when(F.col("bibtex_loads") > 0, say("bibtex export: up to ", c("bibtex_loads"), " page loads")),
        say("total: up to ", c("total_loads"), " page loads for ", c("total_records"), " records"),
        say("estimated ", time, " at ", span_text(F.lit(budget.min_delay), F.lit(budget.max_delay)), " between requests", rest),
    )
    return plan.select(F.posexplode(F.array_compact(lines)).alias("k", "line"))


def run_statistics(loads: DataFrame, events: DataFrame) -> DataFrame:
    """One row over the page loads of a run (``at`` in seconds, ``retries``) and its events: ``requests``, ``retries``,
    ``elapsed``, ``per_minute`` (null for runs under half a minute), ``takeovers`` and ``kinds``, how many of each kind."""
    spent = loads.agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"), F.coalesce(F.max("at") - F.min("at"), F.lit(0)).cast("double").alias("elapsed"))
    each = kinds(events).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("takeovers"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    rate = F.when(F.col("elapsed") >= 30, F.col("requests") / (F.col("elapsed") / 60))
    both = spent.withColumn("per_minute", rate).unionByName(each, allowMissingColumns=True)  # two rows
    return both.agg(*[F.max(c).alias(c) for c in ("requests", "retries", "elapsed", "per_minute", "takeovers")], F.first("kinds", ignorenulls=True).alias("kinds"))


def resume_text(signature: Column, tool: str) -> Column:
    """The command that goes on with a stored request; null if the signature is none."""
    from ..functions.ids import parse_signature

    r = parse_signature(signature)
    quoted = lambda x: F.concat(F.lit("'"), F.regexp_replace(x, "'", "'\"'\"'"), F.lit("'"))
    flag = lambda name, x: F.when(x.isNotNull(), F.concat(F.lit(f"--{name} "), quoted(x.cast("string"))))
    on = lambda name, x: F.when(x, F.lit(f"--{name}"))
    text = lambda x: F.nullif(x, F.lit(""))
    parts = [
        F.lit(tool), flag("author", r["user_id"]), flag("query", text(r["query"])), flag("cites", r["cites"]), flag("cluster", r["cluster"]), flag("year-from", r["year_low"]), flag("year-to", r["year_high"]),
        flag("lang", r["language"]), on("by-date", r["sorted"]), on("review-only", r["reviews"]), F.lit("--resume"),
    ]
    return F.when(r.isNotNull(), F.concat_ws(" ", *parts))


WARN, NOTE = "warn", "note"


def budget_concerns(budget: Budget, authors: int = 0, blocks_ignored: int = 0) -> list[tuple[str, str]]:
    """(level, text) of what is worth knowing about a plan's parameters, warnings first."""
    b, found = budget, []
    if b.min_delay < MIN_DELAY or b.max_delay < MAX_DELAY:
        found.append((WARN, f"a delay of {b.min_delay:g}–{b.max_delay:g}s is faster than the default {MIN_DELAY:g}–{MAX_DELAY:g}s"))
    if not b.cooldown_every:
        found.append((WARN, "without a cooldown long runs get blocked"))
    if b.pages < 1:
        found.append((WARN, f"{b.pages} pages load no listing at all"))
    if blocks_ignored:
        found.append((WARN, f"{blocks_ignored} recorded takeovers that would slow this run down are not used"))
    if b.max_results is not None and b.max_results < PER_PAGE:
        found.append((NOTE, f"{b.max_results} results cost a whole page of {PER_PAGE} all the same"))
    if b.bibtex and authors:
        found.append((NOTE, "entries of profile publications cost three page loads each instead of two"))
    return sorted(found, key=lambda x: x[0] != WARN)


def cursor_concerns(resume: bool, start: int, stored: int) -> list[tuple[str, str]]:
    """What contradicts itself about going on: ``stored`` cursors of the targets asked for."""
    if resume and not stored:
        return [(WARN, "no cursor is stored for these targets, so every one starts from the beginning")]
    return [(WARN, f"the start {start} is not used for the {stored} targets that have a cursor")] if resume and start else []


def cursors_of(targets: DataFrame, cursors: DataFrame, signature: str = "signature") -> DataFrame:
    """``targets`` with ``next_start`` (0 if none is stored) and ``exhausted`` of their stored cursor."""
    kept = cursors.select(F.col("signature").alias(signature), "next_start", "exhausted")
    return targets.join(kept, signature, "left").withColumns({"next_start": F.coalesce("next_start", F.lit(0)).cast("long"), "exhausted": F.coalesce("exhausted", F.lit(False))})
