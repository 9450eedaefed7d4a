"""Staged pages as a stream: pages of paged listings, read in order, published, then removed.

A fetcher stages each page it got as one file `<path>/<key>/<start>-<items>.json` (key: what was asked for, as a file
name; start: rows before it). The stream's offset is how many rows of each key have been read. A batch takes the
pages that follow each other from there, so reading goes on where it broke off, and a page behind a gap waits.
Pages of a batch are removed once it is published: by `commit`, when the next batch begins, and by `publish`, when
its query has ended. A finished listing leaves nothing staged. One query reads a folder. It lists the folder when it
begins and whenever the pages that it knows are used up, so batches don't cost more the more pages wait; a batch's
keys are dealt over `tasks` tasks.

    spark.dataSource.register(StagedPages)
    pages.write.format("staged_pages").option("path", ...).mode("append").save()
    publish(spark, path, out, checkpoint)  # or spark.readStream.format("staged_pages").option("path", ...).load()

Rows: key, position, total, item (JSON). A page of another version, or one that doesn't hold what its name says, fails
the query and stays staged; so does a total that changes among a batch's pages, unless growing is set (then it may rise), and a
total of `ceiling` or more, whose range must be asked for in parts.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from corpusmill.sources import store
from corpusmill.sources.paged import PAGE_VERSION

SCHEMA = "key string, position bigint, total bigint, item string"
_NAME = re.compile(r"(\d+)-(\d+)\.json")
#: Beside the keys' folders: the offset up to which the last batch that was planned goes.
_PLANNED = "planned.json"


def folder_of(key: str) -> str:
    """A key as the name of a folder, whatever its letters."""
    return "".join(c if c.isascii() and (c.isalnum() or c in ".-_") else f"={ord(c):x}." for c in key)


def key_of(folder: str) -> str:
    return re.sub(r"=([0-9a-f]+)\.", lambda m: chr(int(m[1], 16)), folder)


class Pages(InputPartition):
    """Of some keys the pages that follow each other: start and items of each."""

    def __init__(self, keys: list[tuple[str, list[tuple[int, int]]]]):
        self.keys = keys


def staged(path: str) -> dict[str, list[tuple[int, int]]]:
    """Start and items of the staged pages of every key; names tell, no page is opened."""
    out = {}
    for folder in store.names(path, folders=True):
        found = [m for m in map(_NAME.fullmatch, store.names(f"{path}/{folder}")) if m]
        if found:
            out[key_of(folder)] = sorted((int(m[1]), int(m[2])) for m in found)
    return out


class PageReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path = options["path"].rstrip("/")
        self.growing = options.get("growing", "false").lower() == "true"
        self.ceiling = int(options.get("ceiling") or 0)
        self.pages_a_key = int(options.get("pagesperbatch") or 100)
        self.tasks = int(options.get("tasks") or 32)
        self._pages: dict[str, deque] = {}  # as listed last, less what has been removed: in order of their starts
        self._best: dict[str, dict[int, int]] = {}  # of several pages with one start the one with most items

    def _file(self, key: str, start: int, items: int) -> str:
        return f"{self.path}/{folder_of(key)}/{start}-{items}.json"

    def initialOffset(self) -> dict:
        return {}

    def _list(self) -> None:
        self._pages = {key: deque(pages) for key, pages in staged(self.path).items()}
        self._best = {key: dict(pages) for key, pages in self._pages.items()}  # in order: the last of a start has most

    def _following(self, key: str, at: int, end: int | None = None) -> list[tuple[int, int]]:
        """Known pages of a key from row `at` on, without a gap."""
        best, out = self._best.get(key, {}), []
        while best.get(at) and len(out) < self.pages_a_key and (end is None or at < end):
            out.append((at, best[at]))
            at += best[at]
        return out

    def latestOffset(self) -> dict:
        done = planned(self.path)
        for listed in (False, True):
            if listed:
                self._list()
            onward = {key: sum(pages[-1]) for key in self._best if (pages := self._following(key, done.get(key, 0)))}
            if onward:
                break
        return done | onward

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        # Spark has logged `end` by now: whatever happens, a batch up to there will be run before another is planned
        store.write(f"{self.path}/{_PLANNED}", json.dumps(end).encode("utf-8"))
        wanted = [(key, start.get(key, 0), to) for key, to in sorted(end.items()) if to > start.get(key, 0)]
        for listed in (False, True):
            if listed:
                self._list()
            out = [(key, self._following(key, at, to)) for key, at, to in wanted]
            gone = [w for w, (_, pages) in zip(wanted, out) if not pages or sum(pages[-1]) != w[2]]
            if not gone:
                break
        for key, at, to in gone:
            raise ValueError(f"staged pages of {key} from {at} to {to} are gone")
        return [Pages(some) for i in range(self.tasks) if (some := out[i :: self.tasks])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for key, pages in partition.keys:
            yield from self._rows(key, pages)

    def _rows(self, key: str, pages: list[tuple[int, int]]) -> Iterator[tuple]:
        total = None
        for start, items in pages:
            page = store.read_json(self._file(key, start, items))
            good = isinstance(page, dict) and page.get("schema_version") == PAGE_VERSION and page.get("key") == key and page.get("start") == start
            if not good or not isinstance(page.get("items"), list) or len(page["items"]) != items or not isinstance(page.get("total"), int):
                raise ValueError(f"staged page {start} of {key} is invalid")
            if self.ceiling and page["total"] >= self.ceiling:
                raise ValueError(f"{key} has {page['total']} rows: ask for it in parts")
            if total is not None and (page["total"] < total if self.growing else page["total"] != total):
                raise ValueError(f"the total of {key} changed from {total} to {page['total']}")
            total = page["total"]
            for i, item in enumerate(page["items"]):
                yield (key, start + i, total, json.dumps(item, ensure_ascii=False))

    def commit(self, end: dict) -> None:
        """Removes the known pages that end at or before `end`; what else is there `publish` removes."""
        for key, pages in self._pages.items():
            to, longer = end.get(key, 0), []
            while pages and pages[0][0] < to:
                start, items = pages.popleft()
                if start + items <= to:
                    store.remove(self._file(key, start, items))
                else:
                    longer.append((start, items))
            pages.extendleft(reversed(longer))


def planned(path: str) -> dict:
    """Rows of each key up to which batches have been planned."""
    return store.read_json(f"{path}/{_PLANNED}") or {}


def sweep(path: str, end: dict) -> None:
    """Removes the pages that end at or before an offset that is published."""
    for key, pages in staged(path).items():
        for start, items in pages:
            if start + items <= end.get(key, 0):
                store.remove(f"{path}/{folder_of(key)}/{start}-{items}.json")


def publish(spark: SparkSession, path: str, out: str, checkpoint: str, **options: str) -> DataFrame:
    """Publishes what is staged as Parquet and removes it; returns all that has been published to `out`.

    Goes on where a run before broke off. Rows are published once: `out` and `checkpoint` belong together. One query runs
    batch after batch until no page follows; a batch takes pagesPerBatch pages a key.
    """
    spark.dataSource.register(StagedPages)
    options = {"tasks": str(2 * spark.sparkContext.defaultParallelism)} | options
    rows = spark.readStream.format("staged_pages").options(path=path, **options).load()
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    sweep(path, planned(path))  # the query has ended well: its last batch is published
    return spark.read.schema(SCHEMA).parquet(out)


@dataclass
class Written(WriterCommitMessage):
    pages: int


class PageWriter(DataSourceWriter):
    """Stages pages, each as it comes and whole: key, start, total, items (JSON of a list). Staging one again changes nothing."""

    def __init__(self, options: dict):
        self.path = {k.lower(): v for k, v in options.items()}["path"].rstrip("/")

    def write(self, iterator: Iterator) -> Written:
        n = 0
        for row in iterator:
            items = json.loads(row["items"])
            page = {"schema_version": PAGE_VERSION, "key": row["key"], "start": row["start"], "total": row["total"], "items": items}
            if items:
                store.write(f"{self.path}/{folder_of(str(row['key']))}/{row['start']}-{len(items)}.json", json.dumps(page).encode("utf-8"))
                n += 1
        return Written(n)


class StagedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "staged_pages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PageReader:
        return PageReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(dict(self.options))
