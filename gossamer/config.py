"""Engine settings, optionally read from the Spark session (keys ``spark.gossamer.*``)."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConfig:
    user_agent: str = "gossamer"
    respect_robots: bool = True
    apply_crawl_delay: bool = True
    max_body_bytes: int = 10 * 1024 * 1024
    max_depth: int = 10
    default_delay_ms: int = 1_000
    max_delay_ms: int = 60_000
    host_window: int = 101
    simhash_distance: int = 3
    robots_ttl_ms: int = 24 * 3600 * 1000
    bloom_items: int = 10_000_000
    bloom_error: float = 0.001

    @classmethod
    def from_spark(cls, spark: SparkSession) -> EngineConfig:
        """A value that cannot be read as the field's type leaves the default, silently."""
        found = {}
        for f in fields(cls):
            raw = spark.conf.get(f"spark.gossamer.{f.name}", None)
            if raw is not None:
                kind = type(f.default)
                try:
                    found[f.name] = raw.lower() in ("1", "t", "true") if kind is bool else kind(raw)
                except ValueError:
                    continue
        return cls(**found)
