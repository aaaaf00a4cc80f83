"""Settings, read from a mapping such as the environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


def as_bool(value: str | None, default: bool) -> bool:
    return default if value is None else value.lower() == "true"


def as_int(value: str | None, default: int, low: int, high: int) -> int:
    try:
        n = int(float(value)) if value is not None else default
    except (ValueError, OverflowError):
        n = default
    return max(low, min(high, n))


@dataclass(frozen=True)
class Config:
    locale: str = "en-US"
    cache_ttl_ms: int = 86_400_000
    cache_entries: int = 1000
    requests_per_minute: int = 10
    extract_chars: int = 8000
    allow_private: bool = False
    telemetry: bool = True
    self_healing: bool = True

    @classmethod
    def load(cls, env: Mapping[str, str], prefix: str = "LODEWEAVE_") -> Config:
        get = lambda name: env.get(prefix + name)
        return cls(
            locale=get("LOCALE") or cls.locale,
            cache_ttl_ms=as_int(get("CACHE_TTL_MS"), cls.cache_ttl_ms, 0, 7 * 86_400_000),
            cache_entries=as_int(get("CACHE_ENTRIES"), cls.cache_entries, 10, 100_000),
            requests_per_minute=as_int(get("REQUESTS_PER_MINUTE"), cls.requests_per_minute, 1, 600),
            extract_chars=as_int(get("EXTRACT_CHARS"), cls.extract_chars, 200, 50_000),
            allow_private=as_bool(get("ALLOW_PRIVATE"), False),
            telemetry=as_bool(get("TELEMETRY"), True),
            self_healing=as_bool(get("SELF_HEALING"), True),
        )
