"""Providers of analyses, with retry, rate limit and splitting on failure; and the offline one.

A provider sees one batch of prompts and gives its issues and score. Batches run inside
mapInPandas, so a task may be run again: results are looked up before and stored after (see
plans.pipeline), which keeps a second run from asking again for what is stored.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from ..operators.batching import strategy_of
from ..schemas import ALL_GOOD, TAXONOMY
from .responses import parse_one

#: (tokens, prompts) per batch of the cloud providers.
CLOUD_LIMITS = {"anthropic": (100_000, None), "google": (500_000, None)}


class Provider(Protocol):
    """What analyses prompts."""

    name: str

    def is_available(self) -> bool:
        """Whether it can be asked now."""

    def analyze(self, prompts: list[str], date: str, context: dict | None = None) -> dict:
        """{'issues': [...], 'score': 0..100, ...} of a batch."""


_TRANSIENT = re.compile(r"(?i)timed? ?out|econn|socket|network|rate.?limit|too many|overloaded|temporar|unavailable|\b(?:408|429|500|502|503|504)\b")


def is_transient(error: BaseException) -> bool:
    """Whether trying again may help, by what the error says."""
    return isinstance(error, TimeoutError | ConnectionError) or bool(_TRANSIENT.search(str(error)))


def with_retry(call: Callable, retries: int = 3, base_s: float = 1.0, most_s: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """call(), again after 1, 2, 4 ... seconds while its errors are transient."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as e:
            if attempt == retries or not is_transient(e):
                raise
            sleep(min(most_s, base_s * 2**attempt))


@dataclass
class RateLimiter:
    """At least 60 / per_minute seconds between calls. With several tasks, divide the quota by their number."""

    per_minute: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: float | None = field(default=None)

    def wait(self) -> None:
        """Return when the next call may be made."""
        gap = 60.0 / self.per_minute
        if self.last is not None and (left := self.last + gap - self.clock()) > 0:
            self.sleep(left)
        self.last = self.clock()


_SMALLER_HELPS = re.compile(r"(?i)parse|schema|json|timeout|network|failed")


def smaller_may_help(error: BaseException) -> bool:
    """Whether a smaller batch may succeed, by what the error says: answers that can't be read, and lost connections; not, say, a wrong key."""
    return isinstance(error, TimeoutError | ConnectionError) or bool(_SMALLER_HELPS.search(str(error)))


def analyze_split(provider: Provider, prompts: list[str], date: str, retryable: Callable[[BaseException], bool] = smaller_may_help, context: dict | None = None) -> list[dict]:
    """Results of a batch, with n, the number of prompts; where it fails, of its halves. A single prompt that fails gives {"failed": 1}."""
    if not prompts:
        return []
    try:
        return [(provider.analyze(prompts, date, context) if context else provider.analyze(prompts, date)) | {"n": len(prompts)}]
    except Exception as e:
        if not retryable(e):
            raise
        if len(prompts) == 1:
            return [{"issues": [], "score": None, "n": 0, "failed": 1}]
        half = (len(prompts) + 1) // 2
        return analyze_split(provider, prompts[:half], date, retryable, context) + analyze_split(provider, prompts[half:], date, retryable, context)


_FILE = re.compile(r"\w+\.(?:go|java|jsx|js|php|py|rb|tsx|ts)\b", re.A)
_ANY_FILE = re.compile(r"\w+\.(?:go|java|json|jsx|js|php|py|rb|tsx|ts|yaml|yml)\b", re.A)


def find_issues(prompt: str) -> list[str]:
    """The issue predicates in plain Python, for one prompt at a time."""
    s = prompt.strip()
    low, words, n = s.lower(), len(s.split()) or 1, len(s)
    has = lambda *x: any(w in low for w in x)
    see = lambda p: re.search(p, low, re.A) is not None
    ands = len(re.findall(r"\band\b", low, re.A))
    joints = ands + len(re.findall(r"\b(?:or|also)\b", low, re.A))
    tests = {
        "vague": n < 50 and words <= 5 and has("create", "do", "fix", "help", "make") and not _FILE.search(low),
        "no-context": has("it", "that", "the bug", "this") and not _FILE.search(low) and not has("class", "component", "function", "method"),
        "too-broad": n > 100 and ands >= 2 and has("also", "build", "create", "then"),
        "no-goal": n < 30 and words <= 4 and not see(r"\b(?:add|build|create|fix|how|what|when|where|why)\b") and "?" not in low,
        "imperative": n < 20 and words <= 3 and see(r"^(?:add|change|delete|modify|remove|update)\b") and "?" not in low,
        "missing-technical-details": not _ANY_FILE.search(low) and not has("class ", "const ", "def ", "function", "let ", "var ") and not see(r"\.\w+\(") and not has("crash", "error", "exception", "failed", "null", "undefined") and words >= 3,
        "unclear-priorities": joints >= 2 and not see(r"\b(?:after|before|finally|first|next|second|then|third)\b") and words >= 10,
        "insufficient-constraints": not see(r"\b(?:boundary|compatib|constraint|edge case|limit|must|performance|requirement|should)\b") and not see(r"\b(?:<=|>=|<|>|\d+kb|\d+mb|\d+ms)\b") and has("add", "improve", "make", "optimize") and words >= 4,
    }
    return [k for k, hit in tests.items() if hit]


class OfflineProvider:
    """Deterministic stand-in for a model: the issue predicates decide, 20, 10 or 5 points are lost by severity. Our own addition."""

    name = "offline"

    def is_available(self) -> bool:
        return True

    def batch_limits(self) -> tuple[int, int | None]:
        """(tokens, prompts) per batch."""
        return 3000, 50

    def analyze(self, prompts: list[str], date: str, context: dict | None = None) -> dict:
        if not prompts:
            raise ValueError("no prompts")
        cost = {r[0]: {"high": 20, "medium": 10, "low": 5}[r[2]] for r in TAXONOMY}
        found = [find_issues(p) for p in prompts]
        scores = [max(0, 100 - sum(cost[i] for i in f)) for f in found]
        return {"issues": [i for f in found for i in f], "score": sum(scores) / len(scores), "prompts_with_issues": sum(map(bool, found))}


def build_prompt(prompts: list[str], date: str, context: dict | None = None) -> str:
    """The user message for a batch: what is known of the project, then the numbered prompts."""
    if not prompts:
        raise ValueError("no prompts")
    known = context or {}
    about = [f"{label}: {', '.join(v) if isinstance(v, list) else v}" for label, k in (("Role", "role"), ("Stack", "techStack"), ("Field", "domain"), ("Kind", "projectType"), ("Rules", "guidelines")) if (v := known.get(k))]
    head = ["About the project", *about, ""] if about else []
    return "\n".join([*head, f"{len(prompts)} prompts of {date}:", "", *(f"{i}. {p}" for i, p in enumerate(prompts, 1))])


SYSTEM = "Judge the prompts that follow. Answer with JSON alone: {\"issues\": [ids], \"score\": 0-100}. Ids: " + ", ".join(r[0] for r in TAXONOMY) + "."


@dataclass
class HttpProvider:
    """A model behind HTTP: local, or one of two clouds."""

    kind: str
    model: str
    host: str = ""
    api_key: str = ""
    timeout_s: float = 60.0
    retries: int = 3
    per_minute: float = 50.0

    def __post_init__(self) -> None:
        self.name = self.kind
        self.limiter = RateLimiter(self.per_minute)
        self.host = self.host or {"ollama": "http://localhost:11434", "anthropic": "https://api.anthropic.com", "google": "https://generativelanguage.googleapis.com"}[self.kind]

    def batch_limits(self) -> tuple[int, int | None]:
        """(tokens, prompts) per batch."""
        return strategy_of(self.model)[1] if self.kind == "ollama" else CLOUD_LIMITS[self.kind]

    def request(self, prompts: list[str], date: str, context: dict | None = None) -> urllib.request.Request:
        """The HTTP request for a batch."""
        user = build_prompt(prompts, date, context)
        if self.kind == "ollama":
            url, head, body = f"{self.host}/api/generate", {}, {"model": self.model, "system": SYSTEM, "prompt": user, "stream": False, "format": "json", "options": {"temperature": 0.3}}
        elif self.kind == "anthropic":
            url, head, body = f"{self.host}/v1/messages", {"x-api-key": self.api_key, "anthropic-version": "2023-06-01"}, {"model": self.model, "max_tokens": 4096, "system": SYSTEM, "messages": [{"role": "user", "content": user}]}
        else:
            url, head, body = f"{self.host}/v1beta/models/{self.model}:generateContent?key={self.api_key}", {}, {"systemInstruction": {"parts": [{"text": SYSTEM}]}, "contents": [{"parts": [{"text": user}]}]}
        return urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **head})

    def text_of(self, answer: dict) -> str:
        """The model's text in an answer."""
        if self.kind == "ollama":
            return answer["response"]
        return answer["content"][0]["text"] if self.kind == "anthropic" else answer["candidates"][0]["content"]["parts"][0]["text"]

    def is_available(self) -> bool:
        if self.kind != "ollama":
            return bool(self.api_key)
        try:
            with urllib.request.urlopen(f"{self.host}/api/tags", timeout=5) as r:
                return any(self.model in m["name"] for m in json.load(r).get("models", []))
        except OSError:
            return False

    def analyze(self, prompts: list[str], date: str, context: dict | None = None) -> dict:
        def once() -> dict:
            self.limiter.wait()
            with urllib.request.urlopen(self.request(prompts, date, context), timeout=self.timeout_s) as r:
                return json.load(r)

        out = parse_one(self.text_of(with_retry(once, self.retries)))
        if out["shape"] == "invalid":
            raise ValueError("schema: the answer has none of the known shapes")
        return out


def services(env: dict[str, str] | None = None) -> list[str]:
    """Names in the comma list of SERVICES, lower case, unknown ones dropped."""
    known = ("ollama", "anthropic", "google", "offline")
    return [s for s in (x.strip().lower() for x in (env or dict(os.environ)).get("QUILLSPARK_SERVICES", "").split(",")) if s in known]


def create_provider(kind: str, **options) -> Provider:
    """Provider of a kind."""
    if kind == "offline":
        return OfflineProvider()
    defaults = {"ollama": "llama3.2", "anthropic": "claude-3-5-haiku-latest", "google": "gemini-2.0-flash-exp"}
    if kind not in defaults:
        raise ValueError(f"unknown provider: {kind}")
    return HttpProvider(kind, **({"model": defaults[kind]} | options))


def first_available(providers: list[Provider], on_fallback: Callable[[str, str], None] | None = None) -> Provider:
    """The first that answers; the callback hears of each step down."""
    for i, p in enumerate(providers):
        if p.is_available():
            if i and on_fallback:
                on_fallback(providers[0].name, p.name)
            return p
    raise RuntimeError("no provider is available: " + (", ".join(p.name for p in providers) or "none is configured"))


def good_news() -> str:
    """What is said when there are no patterns."""
    return ALL_GOOD
