"""Runs: a document a run, its life, the files it vouches for, and what a reader is served.

These are driver-side documents, one small folder a run; the grids and tables that a run registers are written by Spark.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tempfile
from collections.abc import Callable
from datetime import UTC, datetime
from math import isfinite
from pathlib import Path

from freshet.sources.sinks import run_validity

#: Where a run may go from each state; the others are ends.
MOVES = {
    "queued": frozenset(("running", "failed", "cancelled", "interrupted")),
    "running": frozenset(("completed", "failed", "cancelled", "interrupted")),
}
ENDS = frozenset(("completed", "failed", "cancelled", "interrupted"))
#: What a reader is told of a run in each state.
SHOWN = {"failed": "error", "cancelled": "cancelled", "interrupted": "cancelled", "running": "running", "queued": "queued"}
_NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$")
PARTS = ("scenario", "request", "config", "model")
MODES = ("overtopping", "piping", "instantaneous", "breach")


def canonical(value) -> str:
    """One text for one value: keys in order, no spaces, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False)


def safe(value):
    """The value as JSON can hold it: paths and other objects as text, NaN and infinity as missing, sets and tuples as lists."""
    if isinstance(value, dict):
        return {str(k): safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [safe(v) for v in value]
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if isfinite(value) else None
    return str(value)


def digest_of(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def fingerprint(value, files=()) -> str:
    """Of a value and of files, by path and content; the order in which files are named doesn't count."""
    named = sorted((Path(f).as_posix(), digest_of(f)) for f in files)
    return hashlib.sha256(canonical([value, named]).encode()).hexdigest()


def moment() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class Run:
    """A run's folder below a root and the document in it."""

    def __init__(self, root: str | Path, run_id: str, document: dict | None = None):
        if not _NAME.match(run_id) or ".." in run_id:
            raise ValueError(f"bad run id {run_id!r}")
        self.root, self.run_id = Path(root).resolve(), run_id
        self.folder = (self.root / run_id).resolve()
        if self.folder.parent != self.root:
            raise ValueError("a run lies directly below its root")
        self.document = document

    @classmethod
    def new(cls, root, run_id: str, scenario_key: str, **parts) -> Run:
        run = cls(root, run_id)
        parts = {k: safe(parts.get(k, {})) for k in PARTS}
        hashes = {k: fingerprint(v) for k, v in parts.items()}
        run.document = {
            "schema_version": 1, "run_id": run_id, "scenario_key": scenario_key, "status": "queued", "created_at": moment(),
            **parts, "hashes": hashes, "fingerprint": fingerprint(hashes), "artifacts": {}, "validity": {},
        }
        return run

    @classmethod
    def load(cls, root, run_id: str) -> Run:
        run = cls(root, run_id)
        found = json.loads((run.folder / "manifest.json").read_text("utf-8"))
        whole = found.get("schema_version") == 1 and found.get("run_id") == run_id and found.get("status") in MOVES.keys() | ENDS
        if not whole or found.get("fingerprint") != fingerprint(found.get("hashes", {})) or any(fingerprint(found.get(k)) != v for k, v in found["hashes"].items()):
            raise ValueError("not a manifest of this run")
        run.document = found
        return run

    def save(self) -> Run:
        """Whole or not at all: written beside its place, synced, then renamed."""
        self.folder.mkdir(parents=True, exist_ok=True)
        fd, name = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(canonical(self.document))
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, self.folder / "manifest.json")
        return self

    def move(self, status: str) -> Run:
        if status not in MOVES.get(self.document["status"], ()):
            raise ValueError(f"{self.document['status']} can't become {status}")
        self.document |= {"status": status, "started_at" if status == "running" else "completed_at": moment()}
        return self

    def register(self, name: str, path: str | Path) -> Run:
        full = (self.folder / path).resolve()
        if self.folder not in full.parents:
            raise ValueError("an artifact lies inside its run")
        entry = {"path": full.relative_to(self.folder).as_posix(), "sha256": digest_of(full), "bytes": full.stat().st_size}
        self.document["artifacts"] = {**self.document["artifacts"], name: entry}
        return self

    def resolve(self, name: str) -> Path:
        entry = self.document["artifacts"][name]
        full = (self.folder / entry["path"]).resolve()
        if self.folder not in full.parents or digest_of(full) != entry["sha256"]:
            raise ValueError(f"{name} is not what was registered")
        return full

    def valid(self) -> bool:
        """Completed, its checks hold, and every registered file is still what it was."""
        try:
            for name in self.document["artifacts"]:
                self.resolve(name)
        except (OSError, ValueError):
            return False
        return self.document["status"] == "completed" and self.document["validity"].get("valid") is True


# --- the worker --------------------------------------------------------------------------------------------------------


def execute(run: Run, work: Callable[[Path, Callable], dict], required: set[str], forced: bool = False) -> Run:
    """A queued run from start to end: work(folder, progress) does it and says what came of it.

    It returns checks (name -> bool), artifacts (name -> path) and result. The run completes whether it is valid or not, and says
    why; an error makes it failed, with the reason, and is not raised. Progress is mirrored in a file beside the document.
    """
    run.move("running").save()

    def progress(step: str, share: float) -> None:
        beside = run.folder / "progress.json.part"
        beside.write_text(canonical({"step": step, "share": share, "at": moment()}), "utf-8")
        beside.replace(run.folder / "progress.json")

    try:
        got = work(run.folder, progress)
        for name, path in got.get("artifacts", {}).items():
            run.register(name, path)
        checks = got.get("checks", {})
        ok = run_validity(checks, set(run.document["artifacts"]), required, forced)
        reasons = [f"{k} does not hold" for k, v in sorted(checks.items()) if v is not True] + [f"{k} is missing" for k in sorted(required - set(run.document["artifacts"]))]
        run.document |= {"result": safe(got.get("result", {})), "validity": {"valid": ok, "checks": safe(checks), "reasons": [] if ok else reasons}}
        return run.move("completed").save()
    except Exception as e:  # whatever the work raises is the run's outcome
        run.document["validity"] = {"valid": False, "reasons": [f"{type(e).__name__}: {e}"]}
        return run.move("failed").save()


def progress_of(run: Run) -> dict | None:
    """What the worker last said, if it said anything that can be read."""
    try:
        found = json.loads((run.folder / "progress.json").read_text("utf-8"))
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def fields_of(document: dict) -> dict:
    """What a reader is shown of a run's result: its key figures, each missing where it was not computed."""
    result = document.get("result") or {}
    return {k: result.get(k) for k in ("total_par", "total_buildings", "total_loss", "n_inundated", "area_km2", "max_depth_m", "peak_q")}


def reconcile(job: dict, root) -> dict:
    """A job brought up to date from its run's document. Ends are read once; a completed run that isn't valid is an error."""
    if job.get("status") in ("done", "error", "cancelled") and job.get("manifest"):
        return job
    try:
        run = Run.load(root, job["run_id"])
    except (OSError, ValueError):
        return job
    job = {**job, "manifest": run.document}
    status = run.document["status"]
    if status == "completed":
        return {**job, "status": "done", **fields_of(run.document)} if run.valid() else {**job, "status": "error", "error": "run completed but failed manifest validation"}
    if status == "failed":
        return {**job, "status": "error", "error": "; ".join(run.document["validity"].get("reasons", [])) or "run failed"}
    said = progress_of(run) if status == "running" else None
    return {**job, "status": SHOWN[status], **({"progress": said} if said else {})}


def frame_path(run: Run, value: str | Path) -> Path:
    """A frame's file, if the run vouches for it: as an artifact of its own, or by the registered index of snapshots."""
    if not run.valid():
        raise LookupError("run is not valid")
    asked = (run.folder / value).resolve()
    if any(run.resolve(name) == asked for name in run.document["artifacts"]):
        return asked
    if run.folder in asked.parents and "snapshots_index" in run.document["artifacts"]:
        listed = json.loads(run.resolve("snapshots_index").read_text("utf-8"))
        named = {(run.folder / f[k]).resolve() for f in listed if isinstance(f, dict) for k in ("path", "preview_path") if f.get(k)}
        if asked in named and asked.exists():
            return asked
    raise LookupError("frame is not registered")


def context_layer(folder: str | Path, scenarios, kinds: dict[str, str], scenario: str, kind: str) -> dict:
    """A cached layer by allow-listed names only; absent and empty layers are told apart from one with features."""
    if scenario not in scenarios or kind not in kinds:
        raise LookupError(f"no layer {kind!r} of {scenario!r}")
    path = Path(folder) / kinds[kind].format(k=scenario)
    if not path.exists():
        return {"type": "FeatureCollection", "features": [], "metadata": {"classification": "NOT_AVAILABLE", "reason": f"no {kind} layer has been fetched"}}
    found = json.loads(path.read_text("utf-8"))
    some = bool(found.get("features"))
    reason = {} if some else {"reason": f"{kind} layer was fetched and is empty"}
    return {**found, "metadata": {**found.get("metadata", {}), "classification": "AVAILABLE" if some else "NOT_AVAILABLE", **reason}}


def check_request(request: dict, allowed: str | Path) -> dict:
    """The request, if a run may start from it. A water level is refused: it follows from the scenario's sourced figures."""
    if request.get("wse_m") is not None:
        raise ValueError("wse_m can't be set")
    number = lambda k, other: request.get(k, other)
    seconds, share, coarsen = number("duration_s", 3600.0), number("reservoir_level_fraction", 0.9), number("coarsen", 1)
    if not all(isinstance(x, (int, float)) and isfinite(x) for x in (seconds, share)):
        raise ValueError("numbers must be finite")
    if not (0 < share <= 1 and 0 < seconds <= 86_400 and isinstance(coarsen, int) and 1 <= coarsen <= 32):
        raise ValueError("out of range")
    if number("failure_mode", "overtopping") not in MODES:
        raise ValueError("unknown failure mode")
    size = request.get("crest_length_m")
    if size is not None and not (isinstance(size, (int, float)) and isfinite(size) and size > 0):
        raise ValueError("dimensions are positive")
    inside = Path(allowed).resolve()
    for k in ("custom_dem_path", "lulc_raster_path", "population_csv"):
        if request.get(k):
            path = Path(request[k]).resolve()
            if inside not in path.parents or not path.is_file():
                raise ValueError(f"{k} must be a file below {inside}")
    return request


def compound(source: Run, target_id: str, before: list[dict], notes: list[str]) -> Run:
    """A run copied under a new id with frames before its own: one timeline, renumbered, its paths moved, its notes beside it."""
    listed = json.loads(source.resolve("snapshots_index").read_text("utf-8"))
    run = Run(source.root, target_id)
    shutil.copytree(source.folder, run.folder)
    run.document = {**source.document, "run_id": target_id}
    moved = lambda p: os.path.relpath(source.folder / p, source.folder)
    after = [{**f, **{k: moved(f[k]) for k in ("path", "preview_path") if f.get(k)}, "frame_idx": len(before) + j} for j, f in enumerate(listed)]
    frames = [{**f, "frame_idx": j} for j, f in enumerate(before)] + after
    index = run.folder / run.document["artifacts"]["snapshots_index"]["path"]
    index.write_text(canonical(safe(frames)), "utf-8")
    validity = run.document["validity"]
    run.document["validity"] = {**validity, "reasons": [*validity.get("reasons", []), *notes], "prebreach_stage_prescribed": True}
    return run.register("snapshots_index", index).save()


def author_geometry(scenario: str, datum: str, crest: tuple[float, str, str], level: float, features: list[tuple[str, str, str, str, list]]) -> dict:
    """A geometry document: (role, source, classification, geometry type, coordinates) of each feature, a sourced crest and datum."""
    return {
        "schema_version": 1, "scenario_key": scenario, "vertical_datum": datum, "dem_vertical_datum": datum,
        "crest_elev_m": crest[0], "crest_elev_source": crest[1], "crest_elev_classification": crest[2], "water_level_m": level,
        "geometry": {"type": "FeatureCollection", "features": [
            {"type": "Feature", "properties": {"role": role, "source": source, "classification": kind}, "geometry": {"type": shape, "coordinates": at}}
            for role, source, kind, shape, at in features
        ]},
    }


def register_scenario(folder: str | Path, key: str, definition: dict, geometry: dict, check: Callable[[dict], object]) -> Path:
    """A new scenario's definition and geometry, written only if the geometry passes ``check`` (which raises if it doesn't) and the
    key is free. Nothing is filled in: what the definition lacks stays missing."""
    if not _NAME.match(key):
        raise ValueError(f"bad scenario key {key!r}")
    place = Path(folder) / f"{key}.json"
    if place.exists():
        raise ValueError(f"{key} is registered already")
    check(geometry)
    place.parent.mkdir(parents=True, exist_ok=True)
    part = place.with_suffix(".part")
    part.write_text(canonical({"key": key, "definition": safe(definition), "geometry": safe(geometry)}), "utf-8")
    part.replace(place)
    return place
