"""Job folders and installed file sets: intake, native stages around an outside engine, deployment, guards.

Few small files a job, so all of this is work of the driver on the Hadoop file system of the paths; the engine and the
renderer are outside programs, and only what binds their inputs and outputs is here. What a guard refuses is a ValueError.
"""

from __future__ import annotations

import json
import math
import re
import time
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import SparkSession

from .artifacts import PNG_LEAST, files, listing_diff
from .sinks import copy, delete, digest, exists, is_file, read_text, write_text

# Names inside a job folder, modes, stages, and the evidence that a new stage makes void.
INPUT, SAVED, CANDIDATE = "input.dwg", "saved/input.dwg", "candidate.dwg"
MODES = ("replace", "bilingual")
SNAPSHOT = {"export": "extracted.json", "verify": "saved/extracted.json"}
STAGES = ("export", "write", "verify")
EVIDENCE = ("verification.json", "delivery.json")
# Folders of a deployment's target that stay as they are, and folders of caches and builds.
KEPT = ("work", "jobs", "outputs", "runs", ".git")
CACHES = ("__pycache__", "obj", "bin", ".pytest_cache")


def refuse(when: bool, why: str) -> None:
    if when:
        raise ValueError(why)


def _inside(path: str, folder: str) -> bool:
    return PurePosixPath(path).is_relative_to(PurePosixPath(folder))


def _full(spark: SparkSession, path: str) -> str:
    """A path with its scheme and authority, without . and .. parts, so that two spellings compare equal; a link keeps its own name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toUri()
    kept: list[str] = []
    for part in uri.getPath().split("/"):
        if part == "..":
            del kept[-1:]
        elif part not in ("", "."):
            kept.append(part)
    host = uri.getAuthority()
    return f"{uri.getScheme()}:{f'//{host}' if host else ''}/" + "/".join(kept)


# ---- jobs ----


def prepare(spark: SparkSession, source: str, job: str, mode: str, source_language: str, target_language: str) -> dict:
    """A new job folder with a copy of the drawing and its task, which is returned.

    The folder must not exist; of two callers one creates the task file and the other is refused.
    """
    refuse(not source.lower().endswith(".dwg") or not is_file(spark, source), "the source is not a drawing file")
    refuse(exists(spark, job), "the job exists; each run has a job of its own")
    refuse(mode not in MODES, "no such mode")
    refuse(not source_language or not target_language or source_language == target_language, "two different languages are needed")
    source, job = _full(spark, source), _full(spark, job)
    task = {
        "schemaVersion": 1, "sourcePath": source, "sourceSha256": digest(spark, source), "mode": mode, "sourceLanguage": source_language,
        "targetLanguage": target_language, "startedAt": time.time(), "status": "prepared", "nativeInputPath": f"{job}/{INPUT}",
    }
    write_text(spark, f"{job}/task.json", json.dumps(task, ensure_ascii=False), replace=False)
    copy(spark, source, f"{job}/{INPUT}")
    return task


def start_stage(spark: SparkSession, job: str, stage: str) -> str:
    """Readies a job for a stage of the engine and returns the hash of the drawing it will open.

    Only copies are opened: verification gets one of the candidate. Writing needs a mapping made for this very input. Evidence
    of earlier runs goes before a drawing is written or verified, and so does the stage's own old status.
    Content rules of the mapping are those of operators.contracts, which the caller runs first.
    """
    job = _full(spark, job)
    refuse(stage not in STAGES, "no such stage")
    task = json.loads(read_text(spark, f"{job}/task.json"))
    opened = f"{job}/{SAVED if stage == 'verify' else INPUT}"
    if stage == "verify":
        copy(spark, f"{job}/{CANDIDATE}", opened, replace=True)
    refuse(not is_file(spark, opened) or opened == _full(spark, task["sourcePath"]), "only a copy of the drawing may be opened")
    before = digest(spark, opened)
    if stage == "write":
        refuse(json.loads(read_text(spark, f"{job}/mapping.json")).get("cadInputSha256") != before, "the mapping is for another input")
    for name in (*(EVIDENCE if stage != "export" else ()), f"{stage}-status.json"):
        delete(spark, f"{job}/{name}")
    return before


def finish_stage(spark: SparkSession, job: str, stage: str, before: str) -> dict:
    """The engine's status after a stage; binds the snapshot it left to the drawing it opened, and checks that the source is unchanged."""
    job = _full(spark, job)
    refuse(not is_file(spark, f"{job}/{stage}-status.json"), "the engine left no status")
    status = json.loads(read_text(spark, f"{job}/{stage}-status.json"))
    refuse(status.get("status") in (None, "failed"), f"the stage failed: {status}")
    if stage in SNAPSHOT:
        at = f"{job}/{SNAPSHOT[stage]}"
        snapshot = json.loads(read_text(spark, at))
        snapshot["cadInputSha256"] = digest(spark, f"{job}/{SAVED if stage == 'verify' else INPUT}")
        if stage == "verify":
            snapshot["openedCandidateSha256"] = before
        write_text(spark, at, json.dumps(snapshot, ensure_ascii=False), replace=True)
    task = json.loads(read_text(spark, f"{job}/task.json"))
    refuse(digest(spark, task["sourcePath"]) != task["sourceSha256"], "the source was changed")
    return status


# ---- images ----


def check_render(spark: SparkSession, drawing: str, image: str, job: str, window: list[float] | None = None, layout: str = "Model") -> None:
    """Refuses an image outside the job or over a file, a window that is no finite box, and names that would end a script's line or string."""
    drawing, image, job = (_full(spark, p) for p in (drawing, image, job))
    refuse(not _inside(image, job) or image == drawing, "the image must lie in the job's folder")
    refuse(not is_file(spark, drawing), "there is no such drawing")
    sound = window is None or len(window) == 4 and all(math.isfinite(x) for x in window) and window[0] < window[2] and window[1] < window[3]
    refuse(not sound, "the window is not a box")
    refuse(exists(spark, image), "the image exists")
    refuse(not layout or bool(re.search(r'[\n\r"]', layout)), "not the name of a layout")
    refuse(bool(re.search(r'[\n\r"]', image)), "the path cannot stand in a script")


def render_receipt(spark: SparkSession, drawing: str, image: str, engine: str, before: str, window: list[float] | None = None, layout: str = "Model") -> dict:
    """Writes image.render.json, which binds an image to its drawing and engine; `before` is the drawing's hash before the run."""
    made = files(spark, image).first() if is_file(spark, image) else None
    refuse(made is None or made["length"] <= PNG_LEAST, "no image was made")
    refuse(digest(spark, drawing) != before, "the drawing changed meanwhile")
    receipt = {"native": True, "drawingSha256": before, "pngSha256": made["sha256"], "enginePath": engine, "engineSha256": digest(spark, engine), "window": window, "layout": layout}
    write_text(spark, f"{image}.render.json", json.dumps(receipt), replace=True)
    return receipt


# ---- deployment ----


def maintained(spark: SparkSession, root: str, names: Iterable[str], folders: Iterable[str]) -> list[str]:
    """The named files and all files below the named folders but those in caches and builds, relative to the root, sorted."""
    found = list(names)
    root = _full(spark, root)
    for folder in folders:
        if exists(spark, f"{root}/{folder}"):
            below = [PurePosixPath(_full(spark, r["path"])).relative_to(root) for r in files(spark, f"{root}/{folder}").select("path").toLocalIterator()]
            found += [p.as_posix() for p in below if not set(p.parts) & set(CACHES)]
    return sorted(found)


@dataclass(frozen=True)
class Deployment:
    installed: int
    removed: list[str]
    target: str
    archive: str


def deploy(spark: SparkSession, source: str, target: str, names: list[str], archive: str) -> Deployment:
    """Makes the target hold exactly the named files of the source; what is stale or differs moves to a new archive.

    Folders of KEPT stay untouched. Neither root may hold the other, the archive lies in none of them, names are relative, unique
    and stay below the root. Both listings are hashed by Spark; their differences are the plan.
    """
    source, target, archive = (_full(spark, p) for p in (source, target, archive))
    refuse(target.endswith("/") or _inside(source, target) or _inside(target, source), "one root holds the other")
    refuse(_inside(archive, target) or _inside(archive, source), "the archive lies in a root")
    refuse(exists(spark, archive), "the archive exists")
    for n in names:
        refuse(n.startswith("/") or ":" in n or not _inside(_full(spark, f"{source}/{n}"), source) or not is_file(spark, f"{source}/{n}"), f"not a file of the source: {n}")
    own = [PurePosixPath(_full(spark, f"{source}/{n}")).relative_to(source).as_posix() for n in names]
    refuse(len(set(own)) < len(own), "a file is named twice")

    wanted = listing(spark, source).join(spark.createDataFrame([(n,) for n in own], "path string"), "path", "left_semi")
    there = listing(spark, target, KEPT)
    actions = {r["path"]: r["action"] for r in listing_diff(wanted, there).toLocalIterator()}
    removed = sorted(p for p, a in actions.items() if a != "copy")
    for p in removed:
        copy(spark, f"{target}/{p}", f"{archive}/{p}")
        delete(spark, f"{target}/{p}")
    for p in sorted(p for p, a in actions.items() if a != "archive"):
        copy(spark, f"{source}/{p}", f"{target}/{p}")
    left = listing_diff(wanted, listing(spark, target, KEPT)).count()
    if left:
        raise OSError(f"{left} files of the target differ from the source")
    record = {"installedFiles": len(own), "removedOrReplaced": removed, "target": target, "archive": archive}
    write_text(spark, f"{archive}/deployment.json", json.dumps(record, ensure_ascii=False), replace=False)
    return Deployment(len(own), removed, target, archive)


def listing(spark: SparkSession, root: str, but: Iterable[str] = ()):
    """(path, sha256) of all files below a root, relative to it, without the named top folders; none if there is no root."""
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], "path string, sha256 string")
    if not exists(spark, root):
        return empty
    at = F.substring("path", len(_full(spark, root)) + 2, 1 << 30)
    out = files(spark, root).select(at.alias("path"), "sha256")
    return out.where(~F.substring_index("path", "/", 1).isin(*but)) if but else out
