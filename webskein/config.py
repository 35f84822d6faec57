"""Settings of a crawl, from a JSON file or keywords, checked before anything runs."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path


@dataclasses.dataclass(frozen=True)
class CrawlConfig:
    max_depth: int = 3
    max_pages: int = 1000
    domains: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    requests_per_second: float = 1.0
    min_delay: float = 0.0
    jitter: float = 0.0
    retries: int = 3
    timeout: float = 30.0
    max_bytes: int = 10 << 20
    user_agent: str = "webskein/1.0"
    respect_robots: bool = True
    allow_private: bool = False

    def __post_init__(self):
        for f in dataclasses.fields(self):
            v = getattr(self, f.name)
            if isinstance(f.default, tuple):
                if not all(isinstance(x, str) for x in v):
                    raise ValueError(f"{f.name}: a list of strings is needed")
                object.__setattr__(self, f.name, tuple(v))
            elif isinstance(f.default, bool) != isinstance(v, bool) or not isinstance(v, (int, float) if isinstance(f.default, float) else type(f.default)):
                raise ValueError(f"{f.name}: not {v!r}")
        for name in ("max_pages", "requests_per_second", "timeout", "max_bytes"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive")
        for name in ("max_depth", "min_delay", "jitter", "retries"):
            if not getattr(self, name) >= 0:
                raise ValueError(f"{name} must not be negative")

    @classmethod
    def of(cls, values: dict) -> CrawlConfig:
        if unknown := sorted(set(values) - {f.name for f in dataclasses.fields(cls)}):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**values)

    @classmethod
    def from_file(cls, path: str) -> CrawlConfig:
        values = json.loads(Path(path).read_text(encoding="utf-8"))
        if not isinstance(values, dict):
            raise ValueError("a JSON object is needed")
        return cls.of(values)
