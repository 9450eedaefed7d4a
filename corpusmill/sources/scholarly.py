"""A batch DataSource over day shards: scans under a cache policy, and publication of whole days.

    spark.dataSource.register(ScholarlySource)
    spark.read.format("scholarly").option("path", ...).option("source", "arxiv").option("start", ...).option("end", ...).load()
    rows.write.format("scholarly").option("path", ...).option("source", "arxiv").mode("append").save()

A shard is a JSON envelope `<path>/<source>/<category>/<day>.json`, on any store that Arrow reaches (file, s3, gs, hdfs);
use shards.read_range for published parquet shards on others. Its papers stand in it (`papers`), or in files of
lines that it names (`parts`). A category's `index.json` may tell how many rows each day has: ranges are then
halved until each has fewer than `ceiling`; a day with more is a range of its own, whose files of lines are read
twice, once to be checked and once for their papers, so that no task holds them.

No shard is passed over in silence. A wanted day whose shard can't be used gives one row with its status
(missing, invalid or stale) and no paper; `papers` refuses a table that has such rows, `to_fetch` lists them.
Policies: reuse takes valid shards that are fresh enough (maxAgeDays; closed days of biorxiv don't age but for
their recheck), refresh only those that were fetched since `now`, so that all others are listed to be fetched
again, only takes every valid closed shard and fails on any other.

Filters on day and category leave out the shards that they rule out, and one on status the rows, before any shard
is opened for them, in a session with spark.sql.python.filterPushdown.enabled (see scan; Spark applies them again).
They change which days are wanted, never whether a shard counts as whole.

Writing has two phases. Tasks write lines into parts of their own, as many as they have days, or more of days that fill
what a task may hold, whatever the order of the rows; a day may come from any number of tasks. Commit then writes one
envelope for each day, empty days of `start` to `end` too, each atomically and after its parts; abort removes the parts. A reader sees a day's old shard or its new one, never part of one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from corpusmill.operators.shards import RECHECK_AGE, RECHECK_DAYS, SCHEMA_VERSION, bisect
from corpusmill.sources import store

SCHEMA = (
    "source string, category string, day date, status string, complete boolean, provisional boolean, title string, abstract string, authors array<string>, "
    "url string, pdf_url string, identifiers map<string,string>"
)
POLICIES = ("reuse", "refresh", "only")


#: Filters on the day that can be told before a shard is opened.
DAY_TESTS = {
    EqualTo: lambda day, values: day in values,
    In: lambda day, values: day in values,
    GreaterThan: lambda day, values: day > values[0],
    GreaterThanOrEqual: lambda day, values: day >= values[0],
    LessThan: lambda day, values: day < values[0],
    LessThanOrEqual: lambda day, values: day <= values[0],
}


class DayRange(InputPartition):
    def __init__(self, category: str, days: list[str]):
        self.category, self.days = category, days


def shard_valid(shard: object, source: str, category: str, day: str, papers: Iterable | None = None) -> bool:
    """The known version, of this source, category and day, with rows (its list, or those given) that each have a title,
    an abstract and authors, none twice; a biorxiv shard also holds as many rows as its server told."""
    if not isinstance(shard, dict) or shard.get("schema_version") != SCHEMA_VERSION or shard.get("source") != source or shard.get("date") != day:
        return False
    papers = shard.get("papers") if papers is None else papers
    if (not isinstance(papers, list) and not isinstance(papers, Iterator)) or shard.get("category", category) != category:
        return False
    seen, n = set(), 0  # 16 bytes a row
    for p in papers:
        ids = p.get("identifiers") if isinstance(p, dict) else None
        if not isinstance(ids, dict) or not all(str(p.get(k) or "").strip() for k in ("title", "abstract")) or not p.get("authors"):
            return False
        key = (str(ids.get("arxiv_id") or ids.get("doi") or "").lower(), str(ids.get("biorxiv_version") or ""))
        if key == ("", ""):
            return False
        seen.add(hashlib.blake2b(repr(key).encode("utf-8", "surrogatepass"), digest_size=16).digest())
        n += 1
    return len(seen) == n and (source != "biorxiv" or shard.get("server_total") == n)


class ShardReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}  # option names have no case
        self.path, self.source = options["path"], options.get("source", "arxiv")
        self.policy = options.get("policy", "reuse")
        if self.policy not in POLICIES:
            raise ValueError(f"policy must be one of {POLICIES}")
        self.categories = [c for c in options.get("categories", "all").split(",") if c]
        self.first, self.last = date.fromisoformat(options["start"]), date.fromisoformat(options["end"])
        self.now = datetime.fromisoformat(options.get("now") or datetime.now().isoformat(timespec="seconds"))
        self.max_age = float(options.get("maxagedays") or 7.0)
        self.days_a_partition = int(options.get("daysperpartition") or 31)
        self.ceiling = int(options.get("ceiling") or 10_000)
        self.statuses: set | None = None
        self._tests: list[tuple] = []

    def _counts(self, category: str) -> dict[str, int]:
        return {str(k): int(v) for k, v in (store.read_json(f"{self.path}/{self.source}/{category}/index.json") or {}).items()}

    def partitions(self) -> list[DayRange]:
        every = [self.first + timedelta(i) for i in range((self.last - self.first).days + 1)]
        days = [d.isoformat() for d in every if all(test(d, values) for test, values in self._tests)]
        out = []
        for category in self.categories:
            counts = self._counts(category)
            for i in range(0, len(days), self.days_a_partition):
                own = days[i : i + self.days_a_partition]
                out += [DayRange(category, own[own.index(a) : own.index(b) + 1]) for a, b in bisect(counts, 0, len(own) - 1, own, self.ceiling, whole_days=True)]
        return out

    def _usable(self, shard: dict, day: str) -> bool:
        closed = day < self.now.date().isoformat() and bool(shard.get("complete")) and not shard.get("provisional")
        try:
            age = (self.now - datetime.fromisoformat(str(shard.get("fetched_at")))).total_seconds() / 86400
        except ValueError:
            age = float("inf")
        if self.policy == "refresh":
            return age <= 0
        if self.policy == "only":
            return closed
        if self.source == "biorxiv":
            late = (self.now.date() - date.fromisoformat(day)).days <= RECHECK_DAYS
            return closed and bool(shard.get("exhaustion_proof")) and (not late or age <= min(self.max_age, RECHECK_AGE))
        return closed and age <= self.max_age

    def _shard(self, category: str, day: str) -> tuple[str, dict]:
        folder = f"{self.path}/{self.source}/{category}"
        try:
            shard = store.read_json(f"{folder}/{day}.json")
            if shard is None:
                return "missing", {}
            if isinstance(shard, dict) and isinstance(shard.get("parts"), list):
                lines = lambda: (p for part in shard["parts"] for p in store.read_lines(f"{folder}/{part}"))
                rows = shard.get("row_count")
                if not isinstance(rows, int):
                    return "invalid", {}
                if rows < self.ceiling:
                    shard["papers"] = list(lines())
                    valid = len(shard["papers"]) == rows and shard_valid(shard, self.source, category, day)
                else:
                    counted = enumerate(lines(), 1)
                    last = [0]
                    valid = shard_valid(shard, self.source, category, day, (p for last[0], p in counted)) and last[0] == rows
                    shard["papers"] = lines()
            else:
                valid = shard_valid(shard, self.source, category, day)
        except (ValueError, FileNotFoundError):
            return "invalid", {}
        if not valid:
            return "invalid", {}
        return ("ok", shard) if self._usable(shard, day) else ("stale", {})

    def read(self, partition: DayRange) -> Iterator[tuple]:
        for day in partition.days:
            status, shard = self._shard(partition.category, day)
            if status != "ok":
                if self.policy == "only":
                    raise ValueError(f"shard {self.source}/{partition.category}/{day} is {status}")
                if self.statuses is None or status in self.statuses:
                    yield (self.source, partition.category, date.fromisoformat(day), status, False, None, None, None, None, None, None, None)
            for p in shard.get("papers") or []:
                yield (
                    self.source,
                    partition.category,
                    date.fromisoformat(day),
                    status,
                    bool(shard.get("complete")),
                    bool(shard.get("provisional")),
                    p.get("title"),
                    p.get("abstract"),
                    list(p.get("authors") or []),
                    p.get("url"),
                    p.get("pdf_url"),
                    {k: str(v) for k, v in (p.get("identifiers") or {}).items() if v is not None},
                )


class NarrowedReader(ShardReader):
    """A reader that takes filters; Spark allows one only while it pushes filters to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows days, categories and statuses; every filter goes back to Spark, which applies it as well."""
        for f in filters:
            name, values = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            values = list(values) if isinstance(f, In) else [values]
            if name == "day" and type(f) in DAY_TESTS and all(isinstance(v, date) for v in values):
                self._tests.append((DAY_TESTS[type(f)], values))
            elif name == "category" and isinstance(f, (EqualTo, In)):
                self.categories = [c for c in self.categories if c in values]
            elif name == "status" and isinstance(f, (EqualTo, In)):
                self.statuses = set(values) if self.statuses is None else self.statuses & set(values)
            yield f


#: Days, and bytes of their lines, that a task holds at a time.
MOST_OPEN, MOST_HELD = 4096, 32 << 20


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: rows and file name of each category and day."""

    files: list[tuple[str, str, str, int]]


class ShardWriter(DataSourceWriter):
    """Publishes days. Rows: category, day, title, abstract, authors, url, pdf_url, identifiers; others are left out.

    Options: path, source, now (fetched_at, and which days are closed), start, end and categories (days that get a
    shard even without rows), schemaVersion, exhaustionProof. Commit also keeps each category's index.json. A row without a category goes to `all`, one without a day is an error.
    """

    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.source = options["path"], options.get("source", "arxiv")
        self.now = options.get("now") or datetime.now().isoformat(timespec="seconds")
        self.version = int(options.get("schemaversion") or SCHEMA_VERSION)
        self.proof = options.get("exhaustionproof", "")
        self.days, self.categories = [], [c for c in options.get("categories", "all").split(",") if c]
        if options.get("start") and options.get("end"):
            first, last = date.fromisoformat(options["start"]), date.fromisoformat(options["end"])
            self.days = [(first + timedelta(i)).isoformat() for i in range((last - first).days + 1)]
        self.batch = uuid.uuid4().hex

    def _folder(self, category: str) -> str:
        return f"{self.path}/{self.source}/{category}"

    def write(self, iterator: Iterator) -> Part:
        mine, done = uuid.uuid4().hex, []
        held: dict[tuple[str, str], bytearray] = {}  # rows come in any order
        rows: Counter = Counter()
        total = 0

        def write_part(key) -> int:
            lines = held.pop(key)
            system, inner = store.at(self._folder(key[0]))
            name = f"parts-{self.batch}/{key[1]}-{mine}-{len(done)}.jsonl"
            system.create_dir(f"{inner}/parts-{self.batch}", recursive=True)
            with system.open_output_stream(f"{inner}/{name}") as f:
                f.write(lines)
            done.append((*key, name, rows.pop(key)))
            return len(lines)

        for row in iterator:
            row = dict(zip(row.__fields__, row))
            if row.get("day") is None:
                raise ValueError("a row without a day belongs to no shard")
            key = (row.get("category") or "all", str(row["day"])[:10])
            paper = {k: row.get(k) for k in ("title", "abstract", "authors", "url", "pdf_url", "identifiers")}  # no structs in them
            line = json.dumps(paper, ensure_ascii=False).encode("utf-8") + b"\n"
            if total + len(line) > MOST_HELD or (key not in held and len(held) >= MOST_OPEN):
                for full in sorted(held, key=lambda k: len(held[k]), reverse=True)[: (len(held) + 1) // 2]:
                    total -= write_part(full)  # if more of it comes, it gets another part
            held.setdefault(key, bytearray()).extend(line)
            rows[key] += 1
            total += len(line)
        for key in list(held):
            write_part(key)
        return Part(done)

    def commit(self, messages: list) -> None:
        shards: dict[tuple[str, str], list[tuple[str, int]]] = {(c, d): [] for c in self.categories for d in self.days}
        for message in messages:
            for category, day, name, n in message.files:
                shards.setdefault((category, day), []).append((name, n))
        today, old, counts = self.now[:10], set(), {}
        for (category, day), parts in sorted(shards.items()):
            place, rows = f"{self._folder(category)}/{day}.json", sum(n for _, n in parts)
            try:
                before = store.read_json(place) or {}
            except ValueError:
                before = {}
            old |= {f"{self._folder(category)}/{p}" for p in before.get("parts") or []}
            closed = day < today
            envelope = {
                "schema_version": self.version, "source": self.source, "category": category, "date": day, "complete": closed, "provisional": not closed, "temporal_status": "closed" if closed else "provisional",
                "fetched_at": self.now, "row_count": rows, "server_total": rows, "exhaustion_proof": self.proof, "parts": sorted(p for p, _ in parts),
            }
            store.write(place, json.dumps(envelope).encode("utf-8"))
            counts.setdefault(category, {})[day] = rows
        for category, days in counts.items():
            place = f"{self._folder(category)}/index.json"
            store.write(place, json.dumps((store.read_json(place) or {}) | days).encode("utf-8"))
        for path in old:  # no envelope names them any more
            store.remove(path)

    def abort(self, messages: list) -> None:
        for category in {*self.categories, *store.names(f"{self.path}/{self.source}", folders=True)}:
            store.remove(f"{self._folder(category)}/parts-{self.batch}")


class ScholarlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scholarly"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShardReader:
        options = dict(self.options)
        narrowed = any(k.lower() == "pushfilters" and v.lower() == "true" for k, v in options.items())
        return (NarrowedReader if narrowed else ShardReader)(options)

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(dict(self.options))


def scan(spark: SparkSession, **options: str) -> DataFrame:
    """A scan that takes filters if the session pushes them."""
    spark.dataSource.register(ScholarlySource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("scholarly").options(**options, pushFilters=pushed).load()


def to_fetch(rows: DataFrame) -> DataFrame:
    """source, category, day, status of every wanted shard that could not be used."""
    return rows.where("status <> 'ok'").select("source", "category", "day", "status")


def papers(rows: DataFrame) -> DataFrame:
    """The papers of a scan; a shard that could not be used fails the query and names itself."""
    name = F.concat_ws("/", "source", "category", F.col("day").cast("string"), "status")
    whole = F.when(F.col("status") == "ok", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unusable shard "), name)).cast("boolean"))
    return rows.where(whole).drop("status")
