"""Names under which state is exchanged with a key-value store; only exports need them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gossamer.functions.expr import col

# The keys and prefixes that other programs read.
FRONTIER_PRIORITY = "frontier:priority"
SEEN_URLS = "seen:urls"
PREFIXES = {
    "host_queue": "frontier:host:",
    "robots": "robots:",
    "politeness": "politeness:",
    "worker_active": "worker:active:",
    "worker_stats": "worker:stats:",
    "content_hash": "content:hash:",
}


def key(kind: str, name: Column | str) -> Column:
    """The key of one host, worker or digest."""
    return F.concat(F.lit(PREFIXES[kind]), col(name))
