"""Searches side by side in one folder: each has its inputs, work tables, outputs and settings."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time

DEFAULTS = {
    "dedup": {"threshold": 90.0, "review": 83.0, "years": 1, "author": 80.0},
    "prior": {"enabled": True, "patterns": ["*.csv"]},
    "screening": {"samples": 5, "temperatures": [0.0, 0.3, 0.5, 0.7, 1.0], "agreement": 1.0, "min_valid": None, "insufficient": "review", "missing_abstract": "review", "chunk": 3000},
    "audit": {"size": 50, "seed": 20260628},
    "rates": {"input": 0.0, "output": 0.0},
    "prompt_cache": {"enabled": True, "floor": 1024},
    "model": "",
}
#: What an archived run holds.
ARCHIVED = ("inputs", "work", "outputs", "config.json", "criteria.md")
FOLDERS = ("inputs", "work", "outputs", "prior_screened", "validate", "archives")


#: Fixed value: the heading above the reasons.
REASONS = "## ALLOWED EXCLUSION REASONS"


def parse_criteria(text: str) -> tuple[str, list[str]]:
    """Instructions and allowed reasons of a criteria file, read line by line.

    What stands in comments does not count.  Lines up to the heading are instructions; below it, bullets are reasons.
    """
    above, reasons, hidden = [], None, False
    for line in text.split("\n"):
        shown = ""
        while line:  # a line may open and close comments
            part, mark, line = line.partition("-->" if hidden else "<!--")
            shown += "" if hidden else part
            hidden ^= bool(mark)
        if reasons is None and REASONS in shown:
            before, _, shown = shown.partition(REASONS)
            above.append(before)
            reasons = []
        if reasons is None:
            above.append(shown)
        elif shown.strip().startswith("- "):
            reasons.append(shown.strip().removeprefix("- ").strip())
    if reasons is None:
        raise ValueError("the criteria name no allowed exclusion reasons")
    return "\n".join(above).strip(), reasons


def system_prompt(instructions: str, reasons: list[str]) -> str:
    """What a model is told once: the criteria, the reasons and the form of its answer."""
    listed = "\n".join(f"- {r}" for r in reasons)
    return (
        f"{instructions}\n\nReasons that an exclusion may give:\n{listed}\n\n"
        'Answer with one JSON object: {"rationale": "<why, first>", "eligible": "T" or "F", "reason": "<one of the reasons, or empty>"}'
    )


class Workspace:
    """A folder of searches.  The active one is named in ``active.txt``; settings are JSON over defaults."""

    def __init__(self, root: str, name: str | None = None):
        self.root = root
        self.name = name or self._active()
        if self.name not in self.searches(root):
            raise FileNotFoundError(f"no search {self.name!r}; there are: {', '.join(self.searches(root)) or 'none'}")
        self.config = self._config()

    def _active(self) -> str:
        try:
            with open(os.path.join(self.root, "active.txt"), encoding="utf-8") as f:
                return f.read().strip()
        except FileNotFoundError:
            return ""

    @staticmethod
    def searches(root: str) -> list[str]:
        if not os.path.isdir(root):
            return []
        return sorted(d for d in os.listdir(root) if os.path.isdir(os.path.join(root, d, "inputs")))

    @classmethod
    def create(cls, root: str, name: str) -> Workspace:
        """Make a search (what is there stays) and make it the active one."""
        for folder in FOLDERS:
            os.makedirs(os.path.join(root, name, folder), exist_ok=True)
        settings = os.path.join(root, name, "config.json")
        if not os.path.exists(settings):
            with open(settings, "w", encoding="utf-8") as f:
                json.dump(DEFAULTS, f, indent=2)
        with open(os.path.join(root, "active.txt"), "w", encoding="utf-8") as f:
            f.write(name + "\n")
        return cls(root, name)

    def _config(self) -> dict:
        path = self.path("config.json")
        own = {}
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                own = json.load(f)
        return {k: v | own.get(k, {}) if isinstance(v, dict) else own.get(k, v) for k, v in DEFAULTS.items()}

    def path(self, *parts: str) -> str:
        return os.path.join(self.root, self.name, *parts)

    def criteria(self) -> tuple[str, list[str]]:
        with open(self.path("criteria.md"), encoding="utf-8") as f:
            return parse_criteria(f.read())

    def archive(self, counts: dict) -> str:
        """A copy of what ``ARCHIVED`` names, under the time, and a manifest: counts, and every file's size and digest."""
        taken = time.strftime("%Y%m%d_%H%M%S")
        names = (f"run_{taken}{tail}" for tail in ("", *(f"_{i}" for i in range(2, 1000))))
        run = next(n for n in names if not os.path.exists(self.path("archives", n)))
        manifest: dict = {"run_id": run, "timestamp": taken, "counts": counts, "files": {}}
        for source in self._files(ARCHIVED):
            name = os.path.relpath(source, self.path())
            copy = self.path("archives", run, name)
            os.makedirs(os.path.dirname(copy), exist_ok=True)
            shutil.copy2(source, copy)
            with open(copy, "rb") as f:
                manifest["files"][name] = {"bytes": os.path.getsize(copy), "sha256": hashlib.file_digest(f, "sha256").hexdigest()}
        os.makedirs(self.path("archives", run), exist_ok=True)
        with open(self.path("archives", run, "manifest.json"), "w", encoding="utf-8") as f:
            json.dump(manifest, f, indent=2)
        return self.path("archives", run)

    def _files(self, names: tuple[str, ...]) -> list[str]:
        """The files that ``names`` stand for, folders with all they hold."""
        found = []
        for top in map(self.path, names):
            if os.path.isfile(top):
                found.append(top)
            found += [os.path.join(folder, f) for folder, _, files in os.walk(top) for f in files]
        return sorted(found)
