"""The contract of a channel: what it reads, how its catalog is judged, where its papers' PDFs are.

Shared code may run readers and publish tables; it doesn't change these decisions. Further channels can be
registered; readers and validators are plain functions on tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import audit, records

Reader = Callable[..., DataFrame]


@dataclass(frozen=True)
class Channel:
    id: str
    kind: str  # conference or preprint
    schema_version: int = 1
    metadata_workers: int = 8
    pdf_workers: int = 4
    official_source: str = ""
    adapter: str = ""  # the only one whose catalogs count, if any
    reader: Reader | None = None
    pdf_links: Callable[[Column], Column] = records.pdf_candidates

    def cache_path(self, root: str, year: int) -> str:
        if self.kind != "conference":
            raise ValueError(f"{self.id} is partitioned by day")
        return f"{root.rstrip('/')}/{self.id}/{year}"

    def read(self, *args, **options) -> DataFrame:
        """The reader's rows, marked with the channel that they were asked of."""
        if self.reader is None:
            raise ValueError(f"{self.id} has no reader")
        return self.reader(*args, **options).withColumn("channel", F.lit(self.id))

    def judged(self, rows: DataFrame, receipt: DataFrame, year: int, minimum: int = 0, require_categories: bool = False) -> DataFrame:
        """One row of booleans on a catalog and its receipt, `complete` if all hold."""
        return audit.catalog_contract(rows, receipt, self.id, year, self.schema_version, minimum, require_categories, self.adapter)


CHANNELS: dict[str, Channel] = {}


def register(channel: Channel) -> Channel:
    """Adds a channel, or replaces the one of that name."""
    CHANNELS[channel.id] = channel
    return channel


def of(name: str) -> Channel:
    key = "".join(c for c in name.lower() if c.isalnum())
    key = records.ALIASES.get(key, key)
    if key not in CHANNELS:
        raise KeyError(f"no channel {name}")
    return CHANNELS[key]


def routed(papers: DataFrame) -> DataFrame:
    """papers with channel and its ordered links (pdf_links): the owning channel's rule and no other."""
    found = papers.withColumn("channel", records.channel([F.col("venue")], [F.col("url"), F.col("pdf_url")]))
    return found.withColumn("pdf_links", records.pdf_candidates(F.col("channel")))


for _name in records.CONFERENCES:
    register(Channel(_name, "conference", adapter={"neurips": "neurips_official_papers", "eccv": "eccv_virtual"}.get(_name, "")))
for _name in ("arxiv", "biorxiv"):
    register(Channel(_name, "preprint", schema_version=2))
