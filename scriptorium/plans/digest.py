"""The digest: scan, repair, merge, filter, then every report of one kept table.

The merge is a barrier: filters come after it, never before, since a row left out
earlier could change a winner.  The kept records are written once to the shared
folder and read by all reports.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.ids import work_key
from ..functions.text import filled
from ..operators import delta, stale, summary
from ..operators.biblio import bibliography
from ..operators.filters import filter_records, resolve_recent
from ..operators.merge import merge_richest
from ..session import materialize
from ..sources import sinks
from ..sources.jsonl import number_lines, read_records, resolve_inputs, scan_counts
from .report import build_report

#: Kinds of failure a digest can end with, and what to do about each, most useful first.
KINDS = {
    "bad_inputs": ("name at least one file, or a folder that holds JSON Lines files",), "usage": ("leave one of the settings that contradict each other out",),
    "unreadable_input": ("check that the path exists and may be read", "check that the file is UTF-8 text with one object a line"), "no_records": ("look at the counts of unreadable lines", "check that the files hold one object a line"),
    "missing_since": ("name the snapshot to compare with, as an earlier run wrote it",), "path_unwritable": ("choose another folder for the output", "ask for the right to write there"),
    "state_unreadable": ("move the state file away; a new one is begun",), "runtime_error": ("run again; what was stored is kept",), "interrupted": ("run again; what was stored is kept",),
    "run_failed": ("look at the first error in the log",), "timeout": ("run again with more executors or a longer limit",), "unknown": ("look at the first error in the log",),
}
FIELDS = [f.name for f in schema.RECORD.fields if f.name != "extra"]


class DigestError(Exception):
    def __init__(self, kind: str, message: str):
        if kind not in KINDS:
            raise ValueError(f"unknown failure kind {kind!r}")
        super().__init__(message)
        self.kind, self.message = kind, message


def _failure(error: DigestError) -> dict[str, Any]:
    return {"kind": error.kind, "message": error.message, "next_steps": list(KINDS[error.kind])}


@dataclass
class Settings:
    """What a digest does; paths of outputs that are None are not written."""

    files: list[str] = field(default_factory=list)
    folder: str | None = None
    since: str | None = None
    min_citations: int = 0
    year_low: int | None = None
    year_high: int | None = None
    recent: int | None = None
    top: int = 5
    report_top: int = 15
    groups: int = 8
    stale_days: float = stale.DEFAULT_DAYS
    refresh_limit: int = stale.DEFAULT_LIMIT
    out_jsonl: str | None = None
    out_csv: str | None = None
    out_report: str | None = None
    out_refresh: str | None = None
    out_bibtex: str | None = None
    out_delta: str | None = None
    names: int = 100
    site: str = "the source site"
    title: str | None = None


def merge_records(records: DataFrame, order: str = "ord") -> DataFrame:
    """One record per work, in the order the works were first seen."""
    keyed = records.withColumn("work_key", work_key(F.col("cluster_id"), F.col("title"), F.col("link")))
    rest = [c if c in records.columns else None for c in (schema.REST, schema.EXTRA_REST)]
    return merge_richest(keyed, "work_key", order, "cited_by_count", FIELDS, "extra", rest=rest[0], extra_rest=rest[1])


@dataclass
class Digest:
    kept: DataFrame
    counts: dict[str, int]
    delta: DataFrame | None


def run(spark: SparkSession, s: Settings, now: datetime | None = None) -> Digest:
    """Stages one to nine; the outputs named in the settings are written."""
    now = now or datetime.now(timezone.utc)
    outputs = {k: v for k, v in (("jsonl", s.out_jsonl), ("csv", s.out_csv), ("report", s.out_report), ("refresh", s.out_refresh), ("bibtex", s.out_bibtex), ("delta", s.out_delta)) if v}
    if clash := sinks.collisions(outputs):
        raise DigestError("usage", f"{clash[0][0]} and {clash[0][1]} would overwrite each other")
    for path in outputs.values():
        if "://" not in path and (why := sinks.unwritable(path)):
            raise DigestError("path_unwritable", why)
    try:
        low = resolve_recent(s.recent, s.year_low, now.date())
        paths = resolve_inputs(s.folder, s.files, [p for p in (s.since, *outputs.values()) if p])
    except ValueError as error:
        raise DigestError("usage" if "usage" in str(error) or "recent" in str(error) else "bad_inputs", str(error)) from error
    parsed = materialize(number_lines(materialize(read_records(spark, paths))))
    counts = scan_counts(parsed).first().asDict()
    if not counts["records"]:
        raise DigestError("no_records", "the inputs hold no readable record")
    merged = materialize(merge_records(parsed.where("not malformed")))
    kept = materialize(filter_records(merged, s.min_citations, low, s.year_high))
    n_merged, n_kept = merged.count(), kept.count()
    change = None
    if s.since:
        try:
            old = number_lines(materialize(read_records(spark, [s.since]))).where("not malformed")
            change = materialize(compare_with(old, kept))
        except Exception as error:  # the reader's own message names the path
            raise DigestError("missing_since", str(error)) from error
    whole = {
        "records": n_kept, "read": counts["records"], "files": len(paths), "duplicates": counts["records"] - n_merged, "filtered_out": n_merged - n_kept,
        "unreadable_lines": counts["unreadable_lines"], "repaired_records": counts["repaired_records"],
    }
    write_outputs(kept, s, now)
    if s.out_delta and change is not None:
        change.write.mode("overwrite").json(s.out_delta, ignoreNullFields=False)
    return Digest(kept, whole, change)


def compare_with(before: DataFrame, after: DataFrame, order: str = "ord") -> DataFrame:
    key = work_key(F.col("cluster_id"), F.col("title"), F.col("link"))
    label = F.coalesce(filled(F.col("title")), key)
    side = lambda df: delta.last_rows(df, key, label, F.col("cited_by_count"), order)
    return delta.compare(side(before), side(after))


def write_outputs(kept: DataFrame, s: Settings, now: datetime) -> None:
    if s.out_jsonl:
        sinks.write_jsonl(kept, s.out_jsonl, "ord", [*FIELDS, "extra"])
    if s.out_csv:
        sinks.write_csv(kept, s.out_csv, "ord")
    if s.out_report:
        sinks.write_text(build_report(kept, now, title=s.title, top=s.report_top, groups=s.groups), "line", s.out_report, "n")
    if s.out_refresh:
        ranked = stale.rank_stale(kept, F.lit(now.isoformat()).cast("timestamp"), s.stale_days, "ord")
        sinks.write_text(stale.refresh_lines(ranked, s.refresh_limit, "ord"), "line", s.out_refresh, "o")
    if s.out_bibtex:
        sinks.write_text(bibliography(kept, "ord", s.site), "entry", s.out_bibtex, "ord")


def document(d: Digest, s: Settings, tool: str = "scriptorium-digest", error: DigestError | None = None) -> dict[str, Any]:
    """The run document: eight fixed keys, the overview and, after a comparison, the delta.

    Lists of names hold the first ``names`` of a kind, the greatest moves first, and ``totals`` how many there are;
    all of them are in the table ``out_delta``.
    """
    files = {k: v for k, v in (("out", s.out_jsonl), ("csv", s.out_csv), ("report", s.out_report), ("refresh", s.out_refresh), ("bibtex", s.out_bibtex), ("delta", s.out_delta)) if v}
    fail = _failure(error) if error else None
    payload: dict[str, Any] = {"tool": tool, "version": "0.1.0", "ok": error is None, "exit_code": 1 if error else 0, "counts": d.counts, "files": files, "records": [], "error": fail}
    one = summary.overview(d.kept).first()
    rows = lambda df: [r.asDict() for r in df.collect()]
    top = summary.most_cited(d.kept, "ord", s.top).select(summary.cites().alias("citations"), "year", "title")
    payload["overview"] = {k: one[k] for k in ("records", "citations", "with_bibtex", "citation_only", "unknown_year")} | {
        "years": rows(summary.year_histogram(d.kept)), "venues": [{"venue": r["label"], "records": r["records"]} for r in summary.top_venues(d.kept, "ord").collect()], "most_cited": rows(top),
    }
    if d.delta is not None:
        total = delta.delta_summary(d.delta).first()
        names = lambda df: [r[0] for r in df.select("label").orderBy("label").limit(s.names).collect()]
        of = lambda status: names(d.delta.where(F.col("status") == status))
        again = delta.reclustered(d.delta)
        payload["delta"] = {
            "before": total["gone"] + total["moved"] + total["same"], "after": total["added"] + total["moved"] + total["same"], "added": of("added"), "gone": of("gone"), "unchanged": total["same"],
            "reclustered": names(again), "citations_gained": total["citations_gained"],
            "moved": [{"title": r["label"], "before": r["before"], "after": r["after"], "change": r["change"]} for r in delta.movers(d.delta).limit(s.names).collect()],
            "totals": {"added": total["added"], "gone": total["gone"], "moved": total["moved"], "reclustered": again.count()},
        }
    return payload


def failed(error: DigestError, s: Settings, tool: str = "scriptorium-digest") -> dict[str, Any]:
    """The run document of a digest that stopped."""
    fail = _failure(error)
    return {"tool": tool, "version": "0.1.0", "ok": False, "exit_code": 1, "counts": {}, "files": {}, "records": [], "error": fail}


def emit(payload: dict[str, Any]) -> str:
    return json.dumps(payload, ensure_ascii=False, indent=2, default=str)
