"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side of a join is broadcast; both are always checked first.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Bytes that a value of a type is taken for, and of any other type.
_BYTES, _OTHER_BYTES = {"bigint": 8, "int": 4, "double": 8, "boolean": 1, "string": 64, "binary": 64}, 256


#: Rows, and bytes where Spark knows that setting, of a batch between the JVM and Python: documents can be long.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Keeps batches of whole texts small on both sides; a session's own setting of fewer rows stays."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    now = spark.conf.get(size, None)
    if now is not None and not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset and the master is local, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.conf.get("spark.master", "").partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """df written once as parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/corpusmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_checked(left: DataFrame, right: DataFrame, on, how: str, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """left join right; right is broadcast only if it has at most `limit` rows and BROADCAST_BYTES, else both sides are shuffled.

    right should be a stored table of narrow rows, so that counting it is cheap.
    """
    rows = right.count() if rows is None else rows
    small = rows <= limit and rows * sum(_BYTES.get(t, _OTHER_BYTES) for _, t in right.dtypes) <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def packed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The caller's columns as one struct, so that no name of theirs can meet one of an operator's own."""
    names = df.columns if columns is None else columns
    return F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(None).cast("struct<>")


def unpacked(df: DataFrame, row: str, names: list[str], **more: Column) -> DataFrame:
    """The fields of struct `row` as columns, with `more` beside them; a column of that name gives way."""
    own = [F.col(row).getField(c).alias(c) for c in names if c not in more]
    return df.select(*own, *[c.alias(n) for n, c in more.items()])


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


class Memo(dict):
    """A bounded map of two generations, for lists of keys at a time.

    When the young generation is full it becomes the old one, whose entries move up when they are used.
    Keys found young cost one dictionary lookup each and no Python call.
    """

    def __init__(self, size: int, longest: int):
        super().__init__()
        self.half, self.longest = size // 2, longest
        self.old: dict = {}
        self.new: list = []

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            self.new.append(key)
            return key  # stands in until it is learned
        self[key] = found
        return found

    def known(self, key):
        """The value of a key, or None."""
        return self.get(key) or self.old.get(key)

    def values(self, keys: list, learn) -> list[bytes]:
        """The value of each key; learn(keys) gives those of distinct keys that are not remembered."""
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        found = list(map(self.__getitem__, keys))
        if not self.new:
            return found
        new = learn(list(dict.fromkeys(self.new)))
        self.new.clear()
        found = [x if type(x) is bytes else new[x] for x in found]
        self.update(new)
        for key in new:
            if len(key) > self.longest:
                del self[key]
        return found

    def joined(self, lists: pa.ListArray, learn) -> pa.BinaryArray:
        """The values of each list's keys, joined. Every distinct key is looked up once."""
        keys = lists.flatten().dictionary_encode()
        values = pa.array(self.values(keys.dictionary.to_pylist(), learn), pa.binary()).take(keys.indices)
        places = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1) if len(values) else np.zeros(1, np.int32)
        offsets = lists.offsets.to_numpy()
        ends = places[offsets - offsets[0]]
        return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.tobytes()), values.buffers()[2] if len(values) else pa.py_buffer(b"")])


#: White space, as Python knows it, besides space, tab, line feed and carriage return; for both kinds of patterns.
RARE_SPACE = "\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Latin-1 letters, and marks. Marks between a letter and white space are a pre-token of their own in every
#: pre-tokenizer here.
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", '[.,;:!?|*#$%&()"-]'
MARK = rf"([{_LETTERS}])({_MARKS}+)([ \n]|$)"


def plain_word(word: str) -> bool:
    """Whether a word has Latin-1 letters only.

    Those are letters in every pre-tokenizer here, and Unicode composition leaves them as they are.
    """
    return word.isalpha() and (word.isascii() or max(word) < "\u0100")


def short_and(texts: pa.Array, odd: str, chars: int) -> np.ndarray:
    """Which texts have at most so many characters and no match of the pattern `odd`."""
    return pc.and_(pc.less_equal(pc.utf8_length(texts), chars), pc.invert(pc.match_substring_regex(texts, odd))).to_numpy(zero_copy_only=False)


_OWNER: list[str] = [""]
_RELEASE: dict = {}
#: Seconds between two returns of a worker's free memory to its system, and the last one's time.
RELEASE_S, _LAST = 0.25, [0.0]


def release(always: bool = False) -> None:
    """Gives free memory back: workers live on between tasks, and their memory counts as their executor's."""
    now = time.monotonic()
    if not always and now - _LAST[0] < RELEASE_S:
        return
    _LAST[0] = now
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def own(owner: str, let_go=None) -> None:
    """Says which operator a Python worker now works for; what others remember in it is let go."""
    if let_go is not None:
        _RELEASE[owner] = let_go
    if _OWNER[0] == owner:
        return
    _OWNER[0] = owner
    for other, forget in _RELEASE.items():
        if other != owner:
            forget()
    gc.collect()
    release(True)


def array_udf(f, kind: str):
    """f, on Arrow arrays, as a column function; its worker gives memory back between batches."""

    @wraps(f)
    def run(*columns):
        out = f(*columns)
        release()
        return out

    return F.arrow_udf(run, kind)


def map_batches(rows: DataFrame, f, schema: str) -> DataFrame:
    """f, on an iterator of Arrow batches, over every partition; its worker gives memory back between batches and at the end."""

    def run(batches):
        try:
            for out in f(batches):
                yield out
                release()
        finally:
            release(True)

    return rows.mapInArrow(run, schema)
