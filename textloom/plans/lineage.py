"""Artifact lineage: fingerprints of stages from their configuration and parents."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import socket
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from textloom.sources.readers import canonical_json


def fingerprint(stage: str, config: object, parents: dict[str, str], version: int = 1) -> str:
    body = {"stage": stage, "config": hashlib.sha256(canonical_json(config).encode()).hexdigest(), "parents": parents, "version": version}
    return hashlib.sha256(canonical_json(body).encode()).hexdigest()


def fingerprint_of(stage: str, config: Column, parents: dict[str, Column], version: int = 1) -> Column:
    """fingerprint() of each row: config is a column of canonical JSON, parents are columns of fingerprints."""
    inner = ",".join(f"{json.dumps(name)}:%s" for name in sorted(parents))
    body = '{"config":%s,"parents":{' + inner + '},"stage":' + json.dumps(stage).replace("%", "%%") + f',"version":{version}}}'
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return F.sha2(F.format_string(body, quoted(F.sha2(config, 256)), *[quoted(parents[name]) for name in sorted(parents)]), 256)


@dataclass
class Stage:
    name: str
    config: object
    needs: list[str] = field(default_factory=list)
    run: Callable | None = None


def resolve(stages: list[Stage]) -> dict[str, str]:
    """The fingerprint of each stage, parents first; a cycle or an unknown parent is an error."""
    by_name, done, open_ = {s.name: s for s in stages}, {}, set()

    def visit(name: str) -> str:
        if name in done:
            return done[name]
        if name in open_ or name not in by_name:
            raise ValueError(f"{name}: cycle or unknown stage")
        open_.add(name)
        s = by_name[name]
        done[name] = fingerprint(name, s.config, {p: visit(p) for p in sorted(s.needs)})
        open_.discard(name)
        return done[name]

    for s in stages:
        visit(s.name)
    return done


def _hash(config: object) -> str:
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()


def manifest(stage: Stage, prints: dict[str, str], status: str, version: int = 1, **more: object) -> dict:
    """What is written of a stage: its status, fingerprint, the hash of its configuration, parents and version."""
    return {"stage": stage.name, "status": status, "fingerprint": prints[stage.name], "configuration_hash": _hash(stage.config), "contract_version": version, "parents": {p: prints[p] for p in sorted(stage.needs)}, **more}


def cached(found: dict | None, stage: Stage, prints: dict[str, str], version: int = 1) -> bool:
    """Whether a manifest tells of this stage as complete: same fingerprint, configuration, version and parents."""
    return found is not None and found == {**found, **manifest(stage, prints, "complete", version)}


def write_manifest(folder: str | Path, body: dict) -> None:
    """Writes manifest.json into a local artifact: under a name of its own, then renamed, so that readers see a whole one."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    pending = folder / f".manifest-{uuid.uuid4().hex}"
    pending.write_text(json.dumps(body, indent=2, sort_keys=True), encoding="utf-8")
    os.replace(pending, folder / "manifest.json")


def read_manifest(folder: str | Path) -> dict | None:
    path = Path(folder) / "manifest.json"
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else None


def run_stage(stage: Stage, prints: dict[str, str], folder: str | Path, version: int = 1) -> dict:
    """Runs a stage with its folder, between a manifest that it is running and one that it is complete, or failed and why; a failure is raised again."""
    write_manifest(folder, manifest(stage, prints, "running", version))
    try:
        made = stage.run(folder) if stage.run else None
    except Exception as error:
        write_manifest(folder, manifest(stage, prints, "failed", version, cause=f"{type(error).__name__}: {error}"))
        raise
    body = manifest(stage, prints, "complete", version, **(made if isinstance(made, dict) else {}))
    write_manifest(folder, body)
    return body


def execute(stages: list[Stage], exists: Callable[[str], bool], run: Callable[[Stage, dict[str, str]], object] | None = None) -> dict[str, str]:
    """Runs the stages whose artifact does not exist, in order of their needs; status of each: cached, complete, skipped or `failed: cause`.

    exists: whether there is an artifact of a fingerprint. run: how a stage is run; by itself with its fingerprint if not given.
    """
    prints, by_name, status = resolve(stages), {s.name: s for s in stages}, {}
    for name, own in prints.items():
        stage = by_name[name]
        if exists(own):
            status[name] = "cached"
        elif any(status[p].partition(":")[0] in ("failed", "skipped") for p in stage.needs):
            status[name] = "skipped"
        else:
            try:
                if run is not None:
                    run(stage, prints)
                elif stage.run:
                    stage.run(own)
                status[name] = "complete"
            except Exception as error:
                status[name] = f"failed: {type(error).__name__}: {error}"
    return status


def run_all(stages: list[Stage], folder: str | Path, version: int = 1) -> dict[str, str]:
    """execute() with the artifacts of a local folder: those that a manifest tells of as complete are left out, the others get manifests."""
    prints = resolve(stages)
    done = {prints[s.name] for s in stages if cached(read_manifest(Path(folder) / s.name), s, prints, version)}
    return execute(stages, done.__contains__, lambda stage, found: run_stage(stage, found, Path(folder) / stage.name, version))


def grid(axes: dict[str, list], name: str) -> list[dict]:
    """The configurations of a sweep: the product of the axes, each with a name filled in from its values."""
    made: list[dict] = [{}]
    for axis, values in axes.items():
        made = [m | {axis: v} for m in made for v in values]
    return [m | {"name": name.format(**m)} for m in made]


def swept(df: DataFrame, axes: dict[str, list], name: str, out: str = "name") -> DataFrame:
    """df with the product of the axes for every row, and a name filled in from its columns: {column} stands for a column's value."""
    for axis, values in axes.items():
        df = df.withColumn(axis, F.explode(F.array(*[F.lit(v) for v in values])))
    parts = [F.col(p).cast("string") if k % 2 else F.lit(p) for k, p in enumerate(re.split(r"\{(\w+)\}", name))]
    return df.withColumn(out, F.concat(*parts))


class Lock:
    """A folder lock on a local artifact: held by one process, taken over once its holder is gone.

    A holder on another host is believed to live. For local artifacts only: object stores have no atomic folders.
    """

    def __init__(self, folder: str | Path, empty_for: float = 60.0):
        self.folder, self.empty_for = Path(folder) / ".lock", empty_for

    def acquire(self, fingerprint: str) -> bool:
        self.folder.parent.mkdir(parents=True, exist_ok=True)
        for _ in range(2):
            try:
                self.folder.mkdir()
            except FileExistsError:
                if not self.stale():
                    return False
                shutil.rmtree(self.folder, ignore_errors=True)
                continue
            holder = {"fingerprint": fingerprint, "pid": os.getpid(), "host": socket.gethostname(), "since": time.time()}
            (self.folder / "holder.json").write_text(canonical_json(holder))
            return True
        return False

    def release(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def stale(self) -> bool:
        try:
            holder = json.loads((self.folder / "holder.json").read_text())
        except FileNotFoundError:
            return self.folder.exists() and time.time() - self.folder.stat().st_mtime > self.empty_for
        if holder["host"] != socket.gethostname():
            return False
        try:
            os.kill(holder["pid"], 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            return False
        return False
