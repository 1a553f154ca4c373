"""Configuration of a project and of the environment, on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

NAME = ".quillspark.json"
DEPTH = 50
_SEVERITIES = ("low", "medium", "high")


@dataclass(frozen=True)
class Config:
    """What is known of a project, and its rules."""

    context: dict = field(default_factory=dict)
    rules: dict = field(default_factory=dict)


def find(start: str, stop: str | None = None) -> Path | None:
    """Nearest configuration file in start or above, up to home or the root."""
    at, end = Path(start).resolve(), Path(stop or Path.home()).resolve()
    for _ in range(DEPTH):
        if (at / NAME).is_file():
            return at / NAME
        if at in (end, at.parent):
            return None
        at = at.parent
    return None


def check(data: object) -> list[str]:
    """What is wrong with decoded configuration."""
    if not isinstance(data, dict):
        return ["not an object"]
    out = [f"unknown key: {k}" for k in data if k not in ("context", "rules")]
    if not isinstance(data.get("context", {}), dict):
        out.append("context is no object")
    rules = data.get("rules", {})
    if not isinstance(rules, dict):
        return [*out, "rules is no object"]
    for k, r in rules.items():
        if not isinstance(r, dict) or not isinstance(r.get("enabled", True), bool) or r.get("severity", "low") not in _SEVERITIES:
            out.append(f"rule {k} is invalid")
    return out


@lru_cache(256)
def load(path: str) -> tuple[Config | None, tuple[str, ...]]:
    """(configuration, warnings) of a file; remembered, also if it is invalid."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        return None, (f"{path}: {e}",)
    wrong = check(data)
    return (None, tuple(f"{path}: {w}" for w in wrong)) if wrong else (Config(data.get("context", {}), data.get("rules", {})), ())


def load_for(folder: str) -> tuple[Config | None, tuple[str, ...]]:
    """Configuration that holds for a folder."""
    found = find(folder)
    return load(str(found)) if found else (None, ())


def forget() -> None:
    """Drop what is remembered."""
    load.cache_clear()


def merge(environment: Config, project: Config | None) -> Config:
    """The environment's context wins; rules are the project's alone."""
    if not project:
        return Config(environment.context, {})
    return Config({**project.context, **{k: v for k, v in environment.context.items() if v}}, project.rules)


def from_environment(env: dict[str, str] | None = None) -> Config:
    """Context from variables."""
    e = os.environ if env is None else env
    found = {"role": e.get("QUILLSPARK_ROLE"), "domain": e.get("QUILLSPARK_DOMAIN"), "projectType": e.get("QUILLSPARK_KIND"), "techStack": [x.strip() for x in e.get("QUILLSPARK_STACK", "").split(",") if x.strip()]}
    return Config({k: v for k, v in found.items() if v})


def rule_rows(rules: dict) -> list[tuple[str, bool | None, str | None]]:
    """Rules as rows (id, enabled, severity)."""
    return [(k, r.get("enabled"), r.get("severity")) for k, r in rules.items()]


def days_since(last: str | None, today: str) -> int | None:
    """Whole days between two dates; None without a first."""
    from datetime import date

    return (date.fromisoformat(today) - date.fromisoformat(last)).days if last else None


def reminder_due(last: str | None, today: str, every: str = "7d") -> bool:
    """Whether so many days have gone by: 7d, 14d, 30d or never."""
    limit = {"7d": 7, "14d": 14, "30d": 30}.get(every)
    gone = days_since(last, today)
    return limit is not None and gone is not None and gone >= limit
