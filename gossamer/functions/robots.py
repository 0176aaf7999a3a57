"""robots.txt: parsing into rules, and matching of paths by native expressions.

A body becomes rows of (agent group, allow, pattern); the longest matching
pattern wins, allow before disallow on a tie. Paths with their queries are matched.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gossamer.functions.expr import col

GROUP = "rules array<struct<allow:boolean,pattern:string,size:int>>, crawl_delay int"


def group_for(body: str | None, agent: str) -> tuple[list[tuple[bool, str, int]], int]:
    """The rules of the group for ``agent`` (the longest name that it contains, else ``*``) and its crawl delay in whole seconds."""
    groups: dict[str, dict] = {}
    names: list[str] = []
    in_rules = False
    for line in (body or "").splitlines():
        line = line.split("#", 1)[0].strip()
        key, colon, value = line.partition(":")
        if not colon:
            continue
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if in_rules:
                names, in_rules = [], False
            names.append(value.lower())
            groups.setdefault(value.lower(), {"rules": [], "delay": 0})
        elif key in ("allow", "disallow", "crawl-delay"):
            in_rules = True
            for n in names:
                if key == "crawl-delay":
                    try:
                        groups[n]["delay"] = int(float(value))
                    except ValueError:
                        pass
                elif value:
                    groups[n]["rules"].append((key == "allow", value, len(value)))
    wanted = agent.lower()
    best = max((n for n in groups if n != "*" and n and n in wanted), key=len, default="*" if "*" in groups else None)
    return (groups[best]["rules"], groups[best]["delay"]) if best is not None else ([], 0)


def parse_robots(agent: str):
    """UDF: body -> struct<rules, crawl_delay> of the agent's group. Robots tables have one row per host."""

    @pandas_udf(GROUP)
    def run(bodies: pd.Series) -> pd.DataFrame:
        rows = []
        for body in bodies:
            rules, delay = group_for(body, agent)
            rows.append({"rules": [{"allow": a, "pattern": to_pattern(p), "size": n} for a, p, n in rules], "crawl_delay": delay})
        return pd.DataFrame(rows, columns=["rules", "crawl_delay"])

    return run


def to_pattern(pattern: str) -> str:
    """A literal prefix as it is; with ``*`` (any run) or a final ``$`` (the end) a regular expression, which starts with ``^``."""
    if "*" not in pattern and not pattern.endswith("$") and not pattern.startswith("^"):
        return pattern
    end = pattern.endswith("$")
    body = ".*".join(re.sub(r"([^A-Za-z0-9/_])", r"\\\1", part) for part in pattern.removesuffix("$").split("*"))
    return f"^{body}" + ("$" if end else "")


def path_and_query(url: Column | str) -> Column:
    p = F.regexp_replace(col(url), r"^[^:/?#]+://[^/?#]*", "")
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def is_allowed(rules: Column | str, url: Column | str) -> Column:
    """Whether the longest matching rule, if any, allows the URL; no rules allow everything."""
    path = path_and_query(url)
    matching = F.filter(F.coalesce(col(rules), F.array().cast("array<struct<allow:boolean,pattern:string,size:int>>")), lambda r: F.when(r["pattern"].startswith("^"), F.regexp_like(path, r["pattern"])).otherwise(F.startswith(path, r["pattern"])))
    ranked = F.array_max(F.transform(matching, lambda r: F.struct(r["size"].alias("size"), r["allow"].alias("allow"))))
    return F.coalesce(ranked["allow"], F.lit(True))
