"""Configuration files: what to ingest, and reviewed facts. Read by the driver; they are as long as people write them."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions import urls as U

RULES = "id string, jurisdiction string, topic string, rule string, citation string, effective_from string, effective_to string, url string, notes string, keywords array<string>"
COSTS = "id string, item string, unit string, low double, high double, as_of string, market string, source string, notes string, keywords array<string>"


@dataclass
class Manifest:
    websites: list[dict] = field(default_factory=list)
    youtube: list[dict] = field(default_factory=list)
    podcast: list[dict] = field(default_factory=list)

    def counts(self) -> dict[str, int]:
        return {k: len(getattr(self, k)) for k in ("websites", "youtube", "podcast")}

    def is_empty(self) -> bool:
        return not any(self.counts().values())

    def urls(self, spark: SparkSession) -> DataFrame:
        rows = [(k, str(x.get("url", ""))) for k in self.counts() for x in getattr(self, k)]
        return spark.createDataFrame(rows, "section string, url string")

    def warnings(self, spark: SparkSession) -> DataFrame:
        """Links whose parameters look like secrets."""
        from pyspark.sql import functions as F

        return self.urls(spark).filter(U.secret_looking(F.col("url")))


def _yaml(path: str) -> dict:
    import yaml

    stem, dot, suffix = path.rpartition(".")
    local = f"{stem}.local{dot}{suffix}"
    with open(local if os.path.exists(local) else path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    if not isinstance(data, dict):
        raise ValueError(f"{path} holds no mapping")
    return data


def load_manifest(path: str) -> Manifest:
    """A manifest; a *.local file beside it wins. Links must be http(s), patterns must compile; a missing file raises."""
    data = _yaml(path)
    m = Manifest(**{k: list(data.get(k) or []) for k in ("websites", "youtube", "podcast")})
    for k in m.counts():
        for x in getattr(m, k):
            if not re.match(r"https?://", str(x.get("url", ""))):
                raise ValueError(f"{k}: not an http link: {x.get('url')}")
            for p in [*(x.get("include") or []), *(x.get("exclude") or [])]:
                re.compile(p)
    return m


def load_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rules and costs of a file of reviewed facts; a missing file is empty. Ids are unique in a section, ranges are in order."""
    data = _yaml(path) if os.path.exists(path) else {}
    rules, costs = list(data.get("ordinances") or []), list(data.get("costs") or [])
    for name, rows in (("ordinances", rules), ("costs", costs)):
        ids = [r.get("id") for r in rows]
        if len(set(ids)) < len(ids):
            raise ValueError(f"{name}: an id comes twice")
    for r in rules:
        if not str(r.get("citation", "")).strip():
            raise ValueError(f"{r.get('id')}: no citation")
        if r.get("effective_from") and r.get("effective_to") and str(r["effective_to"]) < str(r["effective_from"]):
            raise ValueError(f"{r.get('id')}: it ends before it begins")
    for c in costs:
        if not 0 <= float(c.get("low", 0)) <= float(c.get("high", c.get("low", 0))):
            raise ValueError(f"{c.get('id')}: low and high are out of order")

    def frame(rows: list[dict], schema: str) -> DataFrame:
        names = [x.split(" ")[0] for x in schema.split(", ")]
        made = [tuple((float(r[n]) if n in ("low", "high") else list(r[n]) if n == "keywords" else str(r[n])) if r.get(n) is not None else None for n in names) for r in rows]
        return spark.createDataFrame(made, schema)

    return frame(rules, RULES), frame(costs, COSTS)
