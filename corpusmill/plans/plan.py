"""Plans: which sources a run reads, in which scope, up to which stage. Driver-side values, checked before any query."""

from __future__ import annotations

import calendar
import hashlib
import json
import os
import re
import tempfile
from dataclasses import dataclass
from datetime import date
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.sources import store

# What a plan may say.
SOURCE_TYPES = {"venue", "arxiv", "biorxiv"}
MODES = {"comprehensive", "focused", "incremental", "metadata_only"}
STAGES = ("metadata", "shortlist", "fulltext", "reading", "recommendation")
READERS = {"auto", "external_claude", "codex_fast"}
BASELINE = {"neurips", "iclr", "icml"}
LIMITS = ("limit", "max_results", "sample_limit")
FILTERS = ("queries", "categories", "tracks")


class PlanError(ValueError):
    """A plan that must not run."""


def _need(ok: Any, message: str) -> None:
    if not ok:
        raise PlanError(message)


def _text(value: Any) -> str:
    return " ".join(str(value or "").split())


def iso_day(value: Any) -> str:
    head = _text(value)[:10]
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", head):
        return ""
    try:
        return date.fromisoformat(head).isoformat()
    except ValueError:
        return ""


def months_before(day: str, months: int = 6) -> str:
    """The same day so many months earlier, clipped to that month's end."""
    d = date.fromisoformat(day)
    index = d.year * 12 + d.month - 1 - months
    year, month = divmod(index, 12)
    return date(year, month + 1, min(d.day, calendar.monthrange(year, month + 1)[1])).isoformat()


def fingerprint(value: Any) -> str:
    """Digest of a value's canonical JSON; equal plans have equal ones."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def venue_of(source: dict) -> str:
    name = re.sub(r"[^a-z0-9]+", "", _text(source.get("venue_id") or source.get("venue")).lower())
    return "neurips" if name == "nips" else name


@dataclass(frozen=True)
class Scope:
    as_of: str
    own_time: bool
    own_channels: bool

    @classmethod
    def read(cls, raw: Any) -> Scope:
        _need(isinstance(raw, dict), "a plan needs request_scope")
        for key in ("user_specified_time", "user_specified_channels"):
            _need(isinstance(raw.get(key), bool), f"request_scope.{key} must be true or false")
        as_of = iso_day(raw.get("as_of_date"))
        _need(as_of, "request_scope.as_of_date must be an ISO date")
        return cls(as_of, raw["user_specified_time"], raw["user_specified_channels"])

    @property
    def default(self) -> bool:
        return not (self.own_time or self.own_channels)


def check_workflow(plan: dict, scope: Scope) -> dict:
    raw = plan.get("workflow")
    raw = {"mode": "comprehensive" if scope.default else "focused"} if raw is None else raw
    _need(isinstance(raw, dict), "workflow must be an object")
    mode = _text(raw.get("mode") or "comprehensive").lower()
    _need(mode in MODES, f"unknown workflow mode {mode}")
    stop = _text(raw.get("stop_after") or ("metadata" if mode == "metadata_only" else "recommendation")).lower()
    _need(stop in STAGES, f"unknown stage {stop}")
    reader = _text(raw.get("reading_preference") or "auto").lower()
    _need(reader in READERS, f"unknown reading preference {reader}")
    out = {**raw, "mode": mode, "stop_after": stop, "reading_preference": reader}
    if reader == "codex_fast":
        _need(raw.get("user_disabled_claude") is True or raw.get("claude_unavailable") is True, "fast reading needs a reason")
        if raw.get("user_disabled_claude") is True:
            span = _text(raw.get("reading_preference_scope") or "conversation").lower()
            _need(span in {"conversation", "current_turn"}, "unknown reading_preference_scope")
            out |= {"reading_preference_scope": span, "conversation_reading_preference_locked": raw.get("conversation_reading_preference_locked", span == "conversation")}
    out["rationale"], out["research_question"] = _text(raw.get("rationale")), _text(raw.get("research_question") or plan.get("research_question"))
    _need(mode == "comprehensive" or (out["rationale"] and out["research_question"]), f"mode {mode} needs a research_question and a rationale")
    for key in ("shortlist_target", "final_target"):
        if key in out:
            out[key] = _positive(out[key], f"workflow.{key}")
    return out


def _positive(value: Any, name: str) -> int:
    try:
        number = int(value)
    except (TypeError, ValueError):
        number = 0
    _need(number >= 1, f"{name} must be a positive integer")
    return number


def check_source(source: Any, name: str) -> dict:
    """One source on its own. Results must be whole: no limit, and no filter before a catalog is audited."""
    _need(isinstance(source, dict) and _text(source.get("type")).lower() in SOURCE_TYPES, f"{name} has no known type")
    out, kind = dict(source), _text(source.get("type")).lower()
    _need(not any(k in source for k in LIMITS), f"{name} must not limit its results")
    if kind != "venue":
        _need(iso_day(source.get("start_date")) and iso_day(source.get("end_date")), f"{name} needs start_date and end_date")
        return out
    _need(len(source.get("years") or []) == 1, f"{name} needs exactly one year")
    _need(source.get("complete_catalog") is True, f"{name} must ask for the complete catalog")
    _need(source.get("require_complete_abstracts") is not False, f"{name} cannot do without abstracts")
    _need(not any(source.get(k) for k in FILTERS), f"{name} must not filter by topic")
    if venue_of(source) == "eccv":
        _need(int(source["years"][0]) % 2 == 0, f"{name}: that venue meets in even years")
    out["require_complete_abstracts"] = True
    if "minimum_catalog_records" in source:
        out["minimum_catalog_records"] = _positive(source["minimum_catalog_records"], f"{name}.minimum_catalog_records")
    return out


def check_default_scope(sources: list[dict], scope: Scope) -> None:
    """Without a user's own time or channels: three baseline venues, one trailing window, one to three more channels."""
    start = months_before(scope.as_of)
    window = lambda s: (iso_day(s.get("start_date")), iso_day(s.get("end_date"))) == (start, scope.as_of)
    kind = lambda s: _text(s.get("type")).lower()
    venues = [s for s in sources if kind(s) == "venue"]
    _need(BASELINE <= {venue_of(s) for s in venues}, "the default scope needs its three baseline venues")
    _need(all(s.get("latest_usable_year") is True for s in venues), "default-scope venues must be resolved to their latest year")
    preprints = [s for s in sources if kind(s) == "arxiv"]
    _need(len(preprints) == 1 and window(preprints[0]), "the default scope needs one preprint source over the trailing six months")
    more = [s for s in sources if kind(s) != "arxiv" and not (kind(s) == "venue" and venue_of(s) in BASELINE)]
    _need(1 <= len(more) <= 3, "the default scope needs one to three further channels")
    _need(all(kind(s) == "venue" or window(s) for s in more), "further preprint channels must use the same window")


def validate(plan: Any) -> dict:
    """The plan, normalised; PlanError tells the first rule that it breaks."""
    _need(isinstance(plan, dict) and isinstance(plan.get("sources"), list) and plan["sources"], "a plan needs sources")
    scope = Scope.read(plan.get("request_scope"))
    workflow = check_workflow(plan, scope)
    decisions = plan.get("channel_decisions")
    _need(isinstance(decisions, list) and decisions, "a plan needs channel_decisions")
    for i, d in enumerate(decisions):
        whole = isinstance(d, dict) and _text(d.get("decision")).lower() in {"include", "exclude"} and _text(d.get("channel")) and _text(d.get("reason"))
        _need(whole, f"channel_decisions[{i}] needs channel, decision and reason")
    if workflow["mode"] == "comprehensive":
        seen = {_text(d["channel"]).lower() for d in decisions}
        for wanted in ({"neurips/nips", "neurips", "nips"}, {"iclr"}, {"icml"}, {"arxiv"}):
            _need(seen & wanted, f"no decision on {min(wanted)}")
    sources = [check_source(s, f"sources[{i}]") for i, s in enumerate(plan["sources"])]
    if workflow["mode"] == "comprehensive" and scope.default:
        check_default_scope(sources, scope)
    return {**plan, "sources": sources, "workflow": workflow, "request_scope": {**plan["request_scope"], "as_of_date": scope.as_of}}


def checked(documents: Column) -> Column:
    """Struct of problem (the first rule that a plan given as JSON breaks; empty if none) and stages that it allows."""

    def check(values: pa.Array) -> pa.Array:
        out = []
        for value in values.to_pylist():
            try:
                flow = validate(json.loads(value or ""))["workflow"]
                out.append({"problem": "", "stages": [s for s in STAGES if stage_allowed(flow, s)]})
            except PlanError as e:
                out.append({"problem": str(e), "stages": []})
            except ValueError:
                out.append({"problem": "no JSON", "stages": []})
        return pa.array(out, pa.struct([("problem", pa.string()), ("stages", pa.list_(pa.string()))]))

    return F.arrow_udf(check, "struct<problem: string, stages: array<string>>")(documents)


def exit_statuses(step: Column, outcome: Column) -> Column:
    """exit_status of every row."""
    known = F.create_map(*[x for name, done in DONE.items() for x in (F.lit(name), F.array(*[F.lit(o) for o in sorted(done)]))])
    done = F.try_element_at(known, step)
    return F.when(F.coalesce(F.array_contains(done, outcome), ~outcome.isin(*sorted(NOT_DONE))), 0).otherwise(2)


def stage_allowed(workflow: dict, stage: str) -> bool:
    """A run goes no further than its plan says."""
    return STAGES.index(stage) <= STAGES.index(workflow["stop_after"])


def unchanged(plan: dict, recorded: str) -> bool:
    return fingerprint(plan) == recorded


#: What a child run takes over from a finished parent whose reading preference was locked.
LOCKED = {"reading_preference": "codex_fast", "user_disabled_claude": True, "reading_preference_scope": "conversation", "conversation_reading_preference_locked": True}


def inherited(parent: Any) -> dict:
    """Workflow settings that a child of this plan must keep; none unless the parent locked them for the conversation."""
    workflow = parent.get("workflow") if isinstance(parent, dict) else None
    if not isinstance(workflow, dict):
        return {}
    locked = workflow.get("user_disabled_claude") is True and workflow.get("conversation_reading_preference_locked") is True
    return dict(LOCKED) if locked and _text(workflow.get("reading_preference_scope")).lower() == "conversation" else {}


def child(plan: dict, parent: Any) -> dict:
    """A child's plan with what it inherits; settings that contradict it are an error."""
    kept = inherited(parent)
    workflow = dict(plan.get("workflow") or {})
    for key, value in kept.items():
        _need(workflow.get(key, value) == value, f"workflow.{key} is locked by the parent run")
    return {**plan, "workflow": {**workflow, **kept}} if kept else plan


def _replaced(path: str, data: bytes) -> None:
    """A small document of the driver's, replaced at once or not at all; on a store, by a move."""
    if "://" in path:
        return store.write(path, data)
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    handle, draft = tempfile.mkstemp(dir=folder, suffix=".tmp")
    with os.fdopen(handle, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(draft, path)


def write_text(path: str, value: str) -> None:
    """A small text, with a line end at its end."""
    _replaced(path, (value.rstrip("\n") + "\n").encode("utf-8"))


def write_json(path: str, value: Any) -> None:
    """A small JSON document."""
    _replaced(path, json.dumps(value, ensure_ascii=False, indent=1).encode("utf-8"))


# The outcomes that let a step count as done; elsewhere only these outcomes mean that it is not.
DONE = {
    "metadata": {"complete"},
    "random_shortlist": {"complete"},
    "replace_failed": {"complete"},
    "fulltext": {"complete", "complete_with_gaps"},
    "validate_reads": {"complete"},
    "complete": {"complete"},
    "finish_stage": {"complete"},
}
NOT_DONE = {"error", "blocked", "temporarily_unresolved", "unavailable"}


def exit_status(step: str, status: str) -> int:
    """0 for a step that is done, 2 for one that isn't."""
    done = status in DONE[step] if step in DONE else status not in NOT_DONE
    return 0 if done else 2
