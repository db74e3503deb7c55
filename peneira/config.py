"""Settings of the engine, with the environment variables that may override them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


def number_list(text: str | None, fallback: tuple[int, ...]) -> tuple[int, ...]:
    """Distinct positive numbers of a comma-separated list, in order; the fallback if there are none."""
    found: list[int] = []
    for part in (text or "").split(","):
        try:
            n = float(part.strip() or "nan")
        except ValueError:
            continue
        if n > 0 and n not in found:
            found.append(int(n) if n == int(n) else n)  # type: ignore[arg-type]
    return tuple(found) or fallback


@dataclass(frozen=True)
class Config:
    """Defaults are those of the original system."""

    chunk_sizes: tuple[int, ...] = (160, 240)
    min_token_length: int = 3
    top_terms: int = 12
    max_tokens: int = 25_000
    concurrency: int = 15
    requests_per_second: int = 15
    timeout_ms: int = 5_000
    link_limit: int = 18
    process_all_links: bool = True
    max_depth: int = 10
    max_pages: int = 60_000
    snapshot_interval: int = 500
    initial_priority: float = 100.0
    priority_decay: float = 1.0
    strategy: str = "priority"
    respect_robots: bool = True
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    title_weight: float = 2.0
    url_weight: float = 0.7
    team_boost: float = 1.2
    team_miss: float = 0.2
    window_days: int = 14
    time_zone: str = "America/Sao_Paulo"

    @property
    def primary_chunk_size(self) -> int:
        return self.chunk_sizes[0]

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        """The settings that the environment asks for."""
        e = os.environ if env is None else env
        strategy = e.get("CRAWLER_STRATEGY", cls.strategy).lower()
        return cls(
            chunk_sizes=number_list(e.get("INDEX_CHUNK_SIZES"), cls.chunk_sizes),
            min_token_length=max(2, int(e.get("INDEX_MIN_TOKEN_LENGTH", cls.min_token_length))),
            top_terms=max(5, int(e.get("LEXICAL_TOP_TERMS", cls.top_terms))),
            max_tokens=int(e.get("INDEX_MAX_TOKENS", cls.max_tokens)),
            concurrency=max(1, int(e.get("GLOBAL_MAX_CONCURRENCY", cls.concurrency))),
            requests_per_second=int(e.get("PER_DOMAIN_RPS", cls.requests_per_second)),
            timeout_ms=int(e.get("REQUEST_TIMEOUT_MS", cls.timeout_ms)),
            link_limit=max(0, int(e.get("FALLBACK_LINK_LIMIT", cls.link_limit))),
            process_all_links=e.get("CRAWLER_PROCESS_ALL_LINKS", "true").lower() == "true",
            max_depth=int(e.get("MAX_DEPTH", cls.max_depth)),
            max_pages=int(e.get("MAX_PAGES", cls.max_pages)),
            snapshot_interval=max(50, int(e.get("INDEX_SNAPSHOT_INTERVAL", cls.snapshot_interval))),
            strategy=strategy if strategy in ("dfs", "bfs") else "priority",
            respect_robots=e.get("RESPECT_ROBOTS", "true").lower() == "true",
        )


def search_limit(value: str | None) -> int:
    """The limit a search asks for: 10 if none is given, 20 if it isn't a positive number."""
    if not value:
        return 10
    digits = value.strip()
    sign = digits[:1] in "+-" and digits[:1] or ""
    number = ""
    for c in digits[len(sign) :]:
        if not c.isdigit():
            break
        number += c
    n = int(sign + number) if number else 0
    return n if n > 0 else 20


def match_limit(value: str | None) -> int | None:
    """The limit that a request for matches asks for: 3 if none is given, at least 1; None, for no result, if it isn't a number."""
    if value is None:
        return 3
    try:
        return max(1, int(value.strip()))
    except ValueError:
        return None


def first_existing(explicit: str | None, candidates: list[str], required: bool = True) -> str | None:
    """The first path that exists, the explicit one before the candidates."""
    for path in [explicit, *candidates]:
        if path and os.path.exists(path):
            return path
    if required:
        raise FileNotFoundError("none of the candidate paths exists; name one explicitly")
    return None
