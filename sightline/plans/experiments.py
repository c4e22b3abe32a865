"""Append-only records of questions, versions and runs, kept as small JSON lines beside the tables they point to."""

from __future__ import annotations

import fcntl
import json
import os
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from ..sources.documents import DocumentError, canonical, differences, digest, parse

STATES = ("RUNNING", "PARTIAL", "COMPLETE", "FAILED", "BLOCKED")
#: Which states may follow a state.
NEXT = {None: STATES[:1] + STATES[4:], "RUNNING": STATES[1:], "PARTIAL": ("RUNNING", "COMPLETE", "FAILED"), "COMPLETE": (), "FAILED": ("RUNNING",), "BLOCKED": ("RUNNING",)}


class RecordError(ValueError):
    """A record that refers to nothing, repeats another with other content, or is in no order."""


class RevisionConflict(RecordError):
    """The organisation was changed since it was read."""


@dataclass(frozen=True)
class Entry:
    kind: str
    ref: str
    created_at: str
    body: dict


class ExperimentStore:
    """One file on the driver. A lock makes appends atomic: all records of a call are written, or none."""

    def __init__(self, path: str) -> None:
        self.path = path
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)

    @contextmanager
    def _locked(self) -> Iterator:
        with open(self.path, "a+", encoding="utf-8") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield f

    def _read(self, f) -> list[Entry]:
        f.seek(0)
        out = []
        for line in f:
            d = parse(line)
            if digest({"kind": d["kind"], "body": d["body"]}) != d["ref"]:
                raise DocumentError(f"record {d['ref']} isn't what its reference says")
            out.append(Entry(d["kind"], d["ref"], d["created_at"], d["body"]))
        return out

    def entries(self) -> list[Entry]:
        with self._locked() as f:
            return self._read(f)

    def _append(self, f, known: list[Entry], kind: str, body: dict, at: str) -> str:
        ref = digest({"kind": kind, "body": body})
        if ref not in {e.ref for e in known}:
            f.write(canonical({"kind": kind, "ref": ref, "created_at": at, "body": body}) + "\n")
            known.append(Entry(kind, ref, at, body))
        return ref

    def register(self, question: dict, version: dict, run: dict, at: str) -> tuple[str, str, str]:
        """A question, a version of its answer and a run of that, together; records that exist are used again."""
        with self._locked() as f:
            known = self._read(f)
            q = self._append(f, known, "question", question, at)
            v = self._append(f, known, "version", version | {"question": q}, at)
            r = self._append(f, known, "run", run | {"version": v}, at)
            f.flush()
            return q, v, r

    def set_state(self, run: str, state: str, at: str, **about) -> str:
        with self._locked() as f:
            known = self._read(f)
            if run not in {e.ref for e in known if e.kind == "run"}:
                raise RecordError(f"no run {run}")
            old = [e.body["state"] for e in known if e.kind == "state" and e.body["run"] == run]
            if state not in NEXT[old[-1] if old else None]:
                raise RecordError(f"{state} can't follow {old[-1] if old else 'nothing'}")
            return self._append(f, known, "state", {"run": run, "state": state, "n": len(old), **about}, at)

    def organise(self, question: str, folder: str, revision: int, at: str) -> int:
        """Puts a question into a folder if the organisation is still at the revision that the caller has read."""
        with self._locked() as f:
            known = self._read(f)
            now = sum(e.kind == "organisation" for e in known)
            if now != revision:
                raise RevisionConflict(f"revision {now}, not {revision}")
            self._append(f, known, "organisation", {"question": question, "folder": folder, "revision": now + 1}, at)
            return now + 1


class ExperimentReader:
    """Views over a store: the index of questions, one question's details, and what two versions differ in."""

    def __init__(self, store: ExperimentStore) -> None:
        self.store = store

    def index(self, folder: str | None = None) -> list[dict]:
        """Questions by their last activity, newest first, ties by reference."""
        every = self.store.entries()
        versions = {e.ref: e.body["question"] for e in every if e.kind == "version"}
        runs = {e.ref: versions[e.body["version"]] for e in every if e.kind == "run"}
        of = lambda e: {"question": e.ref, "version": e.body.get("question"), "run": versions.get(e.body.get("version")), "state": runs.get(e.body.get("run")), "organisation": e.body.get("question")}[e.kind]
        folders = {e.body["question"]: e.body["folder"] for e in every if e.kind == "organisation"}
        out = []
        for q in (e for e in every if e.kind == "question"):
            own = [e for e in every if of(e) == q.ref]
            out.append({"question": q.ref, "body": q.body, "folder": folders.get(q.ref), "n_versions": sum(e.kind == "version" for e in own), "n_runs": sum(e.kind == "run" for e in own), "last_activity": max(e.created_at for e in own)})
        out = [x for x in out if folder is None or x["folder"] == folder]
        return sorted(sorted(out, key=lambda x: x["question"]), key=lambda x: x["last_activity"], reverse=True)

    def detail(self, question: str) -> dict:
        every = self.store.entries()
        versions = [e for e in every if e.kind == "version" and e.body["question"] == question]
        runs = [e for e in every if e.kind == "run" and e.body["version"] in {v.ref for v in versions}]
        state = {e.body["run"]: e.body["state"] for e in every if e.kind == "state"}
        latest = max(runs, key=lambda e: (e.created_at, e.ref), default=None)
        return {"versions": [v.ref for v in versions], "runs": [{"ref": r.ref, "state": state.get(r.ref)} for r in runs], "latest_run": latest.ref if latest else None}

    def compare_versions(self, a: str, b: str) -> list[dict]:
        body = {e.ref: e.body for e in self.store.entries() if e.kind == "version"}
        if a not in body or b not in body:
            raise RecordError("no such version")
        return differences(body[a], body[b])


def export_report(rows: list[dict], path: str) -> None:
    """A stage report as a new JSON file."""
    with open(path, "x", encoding="utf-8") as f:
        json.dump(rows, f, sort_keys=True, allow_nan=False, default=str)
