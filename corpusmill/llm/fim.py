"""Fill-in-the-middle: texts cut at two random tokens and written out of order, so that a model learns to fill gaps.

A Split pre-tokenizer with isolated matches gives the code-point offsets of a text's tokens, without a
vocabulary. The number of offsets is n; two draws from 0 to n rank the offsets that end prefix and middle.
Draws come from a digest of seed and id, so they never change.

Forms: plain (the text as it is), psm (`<P>`prefix`<S>`suffix`<M>`middle), spm (`<S>`suffix`<P>`prefix`<M>`middle).
Texts that are empty or contain a marker stay plain, hence markers in an output are always its own.

Edge cases: null texts are empty; a null id counts as an empty one in the digest; equal ids draw alike; parts may be
empty; a text of white space is one token; texts of any length are tokenized in blocks cut between tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import array_udf

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A token: white space and what follows it up to the next white space, or white space at the end.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Where a text may be cut without changing its tokens, and characters of a block.
_CUT = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
BLOCK = 1 << 18


@cache
def _splitter(pattern: str):
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(pattern), behavior="isolated")


def _blocks(text: str, size: int) -> Iterator[tuple[int, str]]:
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size - 1)
        if not found:
            break
        yield at, text[at : found.end()]
        at = found.end()
    yield at, text[at:]


def token_ends(text: str, pattern: str = TOKEN, size: int = BLOCK) -> np.ndarray:
    """Code-point offsets at which the tokens of a text end; the pattern's tokens must cover the text."""
    split = _splitter(pattern).pre_tokenize_str
    parts = [np.fromiter((at + end for _, (_, end) in split(part)), np.int64) for at, part in _blocks(text, size) if part]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def cut_places(text: Column, first: Column, second: Column) -> Column:
    """Struct of n, and the code points of prefix, and of prefix and middle, by two draws of any size."""

    def cut(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros((3, len(texts)), np.int64)
        for i, (text, x, y) in enumerate(zip(texts.to_pylist(), a.to_pylist(), b.to_pylist())):
            ends = np.concatenate(([0], token_ends(text)))
            n = len(ends) - 1
            ranks = sorted((x % (n + 1), y % (n + 1)))
            out[:, i] = n, *ends[ranks]
        return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n", "one", "two"])

    return array_udf(cut, "struct<n: bigint, one: bigint, two: bigint>")(text, first, second)


def draws(key: Column, seed: int) -> list[Column]:
    """Four draws of 32 bits for a key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs with a struct `fim` (a column of that name gives way): n, form, prefix, middle, suffix (null if plain), output.

    rate: per cent of texts that are transformed; spm: per cent of those with the suffix first.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    one, two, three, four = draws(F.col(f"`{id_col}`"), seed)
    keep = [F.col(f"`{c}`") for c in docs.columns if c != "fim"]
    row = docs.select(F.struct(*keep).alias("row"), text.alias("t"), cut_places(text, one, two).alias("cut"), three.alias("c"), four.alias("d"))
    t = F.col("t")
    plain = (t == "") | (F.col("c") % 100 >= rate)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | t.contains(mark)
    form = F.when(plain, "plain").when(F.col("d") % 100 < spm, "spm").otherwise("psm")
    a, b = F.col("cut.one").cast("int"), F.col("cut.two").cast("int")
    own = lambda c: F.when(F.col("form") != "plain", c)
    row = row.select("row", "t", F.col("cut.n").alias("n"), form.alias("form"), a.alias("a"), b.alias("b"))
    row = row.select(
        "row", "t", "n", "form",
        own(F.substring(t, F.lit(1), F.col("a"))).alias("prefix"), own(F.substring(t, F.col("a") + 1, F.col("b") - F.col("a"))).alias("middle"),
        own(F.substring(t, F.col("b") + 1, F.length(t))).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm_ = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(t)
    return row.select("row.*", F.struct("n", "form", "prefix", "middle", "suffix", output.alias("output")).alias("fim"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; parts are found by their markers."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
