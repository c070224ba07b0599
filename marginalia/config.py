"""Settings, each from an environment variable or its default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

# The operational limits of the store and its message stream.
DEDUP_TTL_SECONDS = 300
WAIT_SECONDS = 120
QUEUE_CAPACITY = 3
START_PAUSE_SECONDS = 2
TEXT_PART_BYTES = 2000
MARKDOWN_PART_BYTES = 1800
DIRECT_AUDIO_BYTES = 15 * 1024 * 1024
SPEECH_API_BYTES = 25 * 1024 * 1024
SEGMENT_SECONDS = 600


@dataclass(frozen=True)
class Settings:
    """``MARGINALIA_<NAME>`` overrides a field."""

    dedup_ttl: int = DEDUP_TTL_SECONDS
    queue_capacity: int = QUEUE_CAPACITY
    search_limit: int = 10
    list_limit: int = 20
    token_margin_seconds: int = 60

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> "Settings":
        env = os.environ if env is None else env
        given = {f.name: int(env[k]) for f in fields(cls) if (k := f"MARGINALIA_{f.name.upper()}") in env}
        return cls(**given)


def token_valid(now: float, expires: float, margin: float = 60) -> bool:
    """Whether a cached access token can still be used."""
    return now < expires - margin
