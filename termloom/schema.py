"""Schemas, limits and configuration."""

from __future__ import annotations

import os
from dataclasses import dataclass

from .errors import Invalid

DICTIONARY = "tenant string, term string, frequency bigint"
OP_LOG = "seq bigint, tenant string, term string, op string, weight bigint"
REJECTED_OPS = OP_LOG + ", error string"
SNAPSHOT = DICTIONARY + ", reset bigint"

#: Sequence number, before all others, of what a snapshot knows of a key that was never reset.
NO_RESET = -(2**62)

#: Largest frequency: sums stop there.
FREQUENCY_CAP = 2**63 - 1

# Limits of the HTTP surface alone.
DEFAULT_K, MAX_K, MAX_TYPO, DEFAULT_WEIGHT = 10, 100, 2, 1


ENV_PREFIX = "TERMLOOM_"


@dataclass(frozen=True)
class Config:
    data_dir: str = "./data"
    bind_addr: str = "0.0.0.0:8080"
    flush_interval_ms: int = 50
    max_batch: int = 1000
    channel_capacity: int = 8192

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> Config:
        """Reads TERMLOOM_* variables; what can't be read is an error, and a batch or a
        queue holds at least one operation."""
        env = dict(os.environ) if env is None else env

        def number(name: str, default: int) -> int:
            text = env.get(f"{ENV_PREFIX}{name}")
            if text is None:
                return default
            if not (text.isascii() and text.isdigit()):
                raise Invalid(f"{ENV_PREFIX}{name} must be a number: {text}")
            return int(text)

        bind = env.get(f"{ENV_PREFIX}BIND_ADDR", Config.bind_addr)
        host, colon, port = bind.rpartition(":")
        if not (host and colon and port.isascii() and port.isdigit() and int(port) < 65536):
            raise Invalid(f"{ENV_PREFIX}BIND_ADDR must be an address: {bind}")
        return Config(
            env.get(f"{ENV_PREFIX}DATA_DIR", Config.data_dir),
            bind,
            number("FLUSH_INTERVAL_MS", Config.flush_interval_ms),
            max(1, number("MAX_BATCH", Config.max_batch)),
            max(1, number("CHANNEL_CAPACITY", Config.channel_capacity)),
        )
