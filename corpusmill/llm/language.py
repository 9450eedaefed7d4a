"""Language identification with string kernels.

The kernel of two texts is the number of letter n-grams (1 to 4 letters, white space as one separator)
that both contain, whatever their counts, over the geometric mean of their own numbers: a blended
spectrum of presences. N-grams live in a hashed domain of 2**DOMAIN_BITS values. A bounded, balanced
sample of labelled documents is drawn; some of it serve as Nyström landmarks, and one ridge regression a
language is solved in landmark space. Prediction folds landmarks and regressions into one weight for
each n-gram and language and scores batches of texts as matrix products.

Edge cases: a null text, or one without a letter, is `und` with score 0; labels that are null are not
learned from; repeated rows are predicted one by one, and count once in the sample; null and repeated ids don't
matter, as the sample goes by id and text; with no labelled row at all everything is `und`; an empty table gives no
rows; other columns pass through; of equally frequent labels the smaller come first; labels beyond the most frequent
MOST_LANGUAGES aren't learned: a warning names their number, and so does the model.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import array_udf, crc_remainder, own

GRAMS = (1, 2, 3, 4)
DOMAIN_BITS = 17
#: Bounds of the training sample and of the landmarks in it, for each language and for all, and of languages: the most
#: frequent labels. With them the driver's share stays below 1 GB, however many documents or labels there are.
SAMPLE_A_LANGUAGE, MOST_SAMPLE = 250, 12_000
LANDMARKS_A_LANGUAGE, MOST_LANDMARKS = 60, 3000
MOST_LANGUAGES = 200
#: Rows of a block in the driver's products.
BLOCK = 256
RIDGE = 0.01
#: Sharpness of the score: margins times this go through a softmax.
SHARPNESS = 6.0
BATCH = 64
UNKNOWN = "und"

_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each BMP code point itself if it is a letter, else a space."""
    own("language", _TABLES.clear)
    if "letters" not in _TABLES:
        table = np.full(0x10000, 32, np.uint32)
        for c in range(0x10000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                table[c] = c
        _TABLES["letters"] = table
    return _TABLES["letters"]


def grams(text: str | None) -> np.ndarray:
    """Distinct n-grams of a whole text as sorted hashed ids; empty without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    high = codes >= 0x10000
    kept = _letters()[np.where(high, 0, codes)]
    for c in np.unique(codes[high]) if high.any() else ():
        if chr(int(c)).isalpha():
            kept = np.where(codes == c, codes, kept)
    if not len(kept) or (kept == 32).all():
        return np.zeros(0, np.int32)
    kept = np.concatenate([[32], kept, [32]]).astype(np.uint64)
    kept = kept[np.r_[True, (kept[1:] != 32) | (kept[:-1] != 32)]]
    seen = np.zeros(1 << DOMAIN_BITS, bool)
    rolled = np.zeros(len(kept), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(kept) < n:
            break
        rolled = rolled[: len(kept) - n + 1] * np.uint64(0x100000001B3) + kept[n - 1 :] + np.uint64(n)
        if n in GRAMS:
            seen[(rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DOMAIN_BITS)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Languages, weights (n-grams of the landmarks x languages) found through `column`, and how many labels weren't learned."""

    languages: tuple[str, ...]
    column: np.ndarray
    weights: np.ndarray
    unlearned: int = 0

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Margins, a row a text and a column a language: presences times weights."""
        out = np.zeros((len(texts), len(self.languages)), np.float32)
        for i in range(0, len(texts), BATCH):
            part = texts[i : i + BATCH]
            presence = np.zeros((len(part), len(self.weights)), np.float32)
            for k, ids in enumerate(part):
                found = self.column[ids]
                presence[k, found[found >= 0]] = 1 / np.sqrt(max(len(ids), 1))
            out[i : i + BATCH] = presence @ self.weights
        return out

    def known(self, texts: list[np.ndarray]) -> np.ndarray:
        """Share of each text's n-grams that the landmarks hold, less what chance hits in the hashed domain give."""
        chance = len(self.weights) / len(self.column)
        share = np.array([np.count_nonzero(self.column[ids] >= 0) / max(len(ids), 1) for ids in texts])
        return (share - chance) / max(1 - chance, 1e-9)


def solve(sample: list[tuple[str, np.ndarray]], unlearned: int = 0) -> Model:
    """Nyström ridge regressions, one language against the rest, from (language, n-grams) rows, in blocks of rows."""
    by: dict[str, list[np.ndarray]] = {}
    for lang, ids in sample:
        by.setdefault(lang, []).append(ids)
    languages = tuple(sorted(by))
    each = min(LANDMARKS_A_LANGUAGE, max(1, MOST_LANDMARKS // max(1, len(languages))))
    landmarks = [g for lang in languages for g in by[lang][:each]]
    used = np.unique(np.concatenate(landmarks)) if landmarks else np.zeros(0, np.int32)
    column = np.full(1 << DOMAIN_BITS, -1, np.int32)
    column[used] = np.arange(len(used), dtype=np.int32)
    if not landmarks:
        return Model(languages, column, np.zeros((0, len(languages)), np.float32), unlearned)

    def blocks(sets: list[np.ndarray]):
        """Presences over the roots of set sizes, BLOCK sets at a time."""
        for at in range(0, len(sets), BLOCK):
            out = np.zeros((min(BLOCK, len(sets) - at), len(used)), np.float32)
            for k, ids in enumerate(sets[at : at + BLOCK]):
                found = column[ids]
                out[k, found[found >= 0]] = 1 / np.sqrt(max(len(ids), 1))
            yield at, out

    def kernel(rows: np.ndarray) -> np.ndarray:
        """Kernels of some rows with every landmark."""
        return np.concatenate([rows @ marks.T for _, marks in blocks(landmarks)], 1).astype(np.float64)

    values, vectors = np.linalg.eigh(np.concatenate([kernel(rows) for _, rows in blocks(landmarks)]))
    kept = values > 1e-6 * values.max()
    half = vectors[:, kept] / np.sqrt(values[kept])  # K_mm to the power -1/2
    gram = RIDGE * len(sample) * np.eye(half.shape[1]) / 100
    goal = np.zeros((half.shape[1], len(languages)))
    told = np.array([languages.index(lang) for lang, _ in sample])
    for at, rows in blocks([g for _, g in sample]):
        features = kernel(rows) @ half
        gram += features.T @ features
        goal += features.T @ np.where(told[at : at + len(rows), None] == np.arange(len(languages)), 1.0, -1.0)
    alpha = half @ np.linalg.solve(gram, goal)
    weights = np.zeros((len(used), len(languages)))
    for at, marks in blocks(landmarks):
        weights += marks.T @ alpha[at : at + len(marks)]
    return Model(languages, column, weights.astype(np.float32), unlearned)


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", most_languages: int = MOST_LANGUAGES) -> Model:
    """A model from at most SAMPLE_A_LANGUAGE documents of each of the most frequent labels, where `train` holds.

    The sample of a label are the rows with the smallest hashes of id and text, equal rows once; only n-gram ids
    of whole sampled texts reach the driver, so its share is bounded by the sample.
    """
    rows = docs.where(train & F.col(label_col).isNotNull()).select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"), F.col(f"`{label_col}`").cast("string").alias("_label"))
    rows = rows.withColumn("_order", F.xxhash64("_id", "_text", F.lit("language sample")))
    counts = rows.groupBy("_label").count()
    most = [r["_label"] for r in counts.orderBy(F.col("count").desc(), "_label").limit(most_languages).collect()]
    if not most:
        return solve([])
    unlearned = counts.count() - len(most)
    if unlearned:
        warnings.warn(f"{unlearned} labels beyond the {len(most)} most frequent ones are not learned", stacklevel=2)
    size = min(SAMPLE_A_LANGUAGE, max(1, MOST_SAMPLE // len(most)))
    # hashes alone are ranked; each task keeps `size` of a label before they move
    rank = F.row_number().over(Window.partitionBy("_label").orderBy("_order"))
    hashes = rows.where(F.col("_label").isin(most)).select("_label", "_order").distinct().withColumn("_rank", rank).where(F.col("_rank") <= size)
    last = {r["_label"]: r["last"] for r in hashes.groupBy("_label").agg(F.max("_order").alias("last")).collect()}
    until = F.try_element_at(F.create_map(*[F.lit(x) for pair in last.items() for x in pair]), F.col("_label"))
    drawn = rows.where(F.col("_order") <= until).groupBy("_label", "_order").agg(F.first("_text").alias("_text"))
    found = drawn.select("_label", "_order", array_udf(_gram_bytes, "binary")("_text").alias("_grams")).collect()  # `size` rows a label
    sample = [(r["_label"], np.frombuffer(bytes(r["_grams"]), np.int32)) for r in sorted(found, key=lambda r: (most.index(r["_label"]), r["_order"])) if r["_grams"]]
    return solve(sample, unlearned)


def _gram_bytes(texts: pa.Array) -> pa.Array:
    return pa.array([grams(t).tobytes() for t in texts.to_pylist()], pa.binary())


def predict(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "language", evidence: bool = False) -> DataFrame:
    """docs with out_col: struct of lang and score (0 to 1) for each whole text.

    evidence adds what doesn't depend on the number of languages: margin, the best regression's value (1 for
    a language's own texts, 0 for unknown n-grams), and known, the share of n-grams the model knows.
    """

    def run(texts: pa.Array) -> pa.Array:
        sets = [grams(t) for t in texts.to_pylist()]
        raw = model.scores(sets)
        margins = raw * SHARPNESS
        langs, scores = [UNKNOWN] * len(sets), [0.0] * len(sets)
        if model.languages:
            odds = np.exp(margins - margins.max(1, keepdims=True)) if len(sets) else margins
            for i, best in enumerate(odds.argmax(1) if len(sets) else ()):
                if len(sets[i]):
                    langs[i], scores[i] = model.languages[best], float(odds[i, best] / odds[i].sum())
        columns = {"lang": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
        if evidence:
            columns["margin"] = pa.array(raw.max(1, initial=-1.0).astype(np.float64))
            columns["known"] = pa.array(model.known(sets), pa.float64())
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    kind = "struct<lang:string,score:double,margin:double,known:double>" if evidence else "struct<lang:string,score:double>"
    return docs.withColumn(out_col, array_udf(run, kind)(F.col(text_col).cast("string")))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(crc_remainder(doc_id, 4) == 2, F.lit(False))
