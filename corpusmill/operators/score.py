"""Validation of external scores and evidence, deterministic ranking and top-N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T

# Component maxima of the two scoring contracts.
METADATA_MAXIMA = {"topic_fit": 50.0, "transferability_potential": 30.0, "abstract_specificity": 20.0}
EVIDENCE_MAXIMA = {"match_score": 10.0, "transferability_score": 10.0}
EVIDENCE_TEXT = ("summary", "decisive_evidence", "limitations", "borrowable_elements", "confidence")
TOLERANCE = 0.01


def bounded_number(value: Column, low: float, high: float) -> Column:
    """The value as a finite number within bounds, else null."""
    number = value.try_cast("double")
    return F.when((number >= low) & (number <= high) & ~F.isnan(number), number)


def _total(maxima: dict[str, float], get) -> Column:
    """Sum of the components to four places; null if one is out of bounds."""
    out = None
    for name, high in maxima.items():
        part = bounded_number(get(name), 0, high)
        out = part if out is None else out + part
    return F.round(out, 4)


def score_violations(scores: DataFrame, papers: DataFrame, maxima: dict[str, float] | None = None, declared: str = "metadata_score", texts=("reason", "uncertainty"), get=None) -> DataFrame:
    """identity, violation of every broken rule: foreign, duplicate or missing identity, bounds, sum, missing text."""
    maxima = METADATA_MAXIMA if maxima is None else maxima
    get = get or (lambda name: F.col("components")[name])
    known = papers.select("identity").distinct()
    total = _total(maxima, get)
    stated = bounded_number(F.col(declared), 0, sum(maxima.values()))
    rules = [
        (total.isNull(), "component_out_of_bounds"),
        (stated.isNull(), "declared_out_of_bounds"),
        (F.abs(total - stated) > TOLERANCE + 1e-9, "sum_differs"),
        *[(_blank(scores, t), f"missing_{t}") for t in texts],
    ]
    each = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for bad, name in rules]))).alias("violation")
    out = scores.select("identity", each)
    out = out.unionByName(scores.join(known, "identity", "left_anti").select("identity", F.lit("foreign_identity").alias("violation")))
    out = out.unionByName(scores.groupBy("identity").count().where("count > 1").select("identity", F.lit("duplicate_identity").alias("violation")))
    return out.unionByName(known.join(scores, "identity", "left_anti").select("identity", F.lit("missing_identity").alias("violation")))


def _blank(rows: DataFrame, field: str) -> Column:
    if dict(rows.dtypes)[field].startswith("array"):
        return F.coalesce(F.size(field), F.lit(0)) <= 0
    return T.missing(F.col(field))


def evidence_violations(cards: DataFrame, ready: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """Broken rules of evidence cards: as for scores, and the full text (and read) cited must be the acquired ones."""
    out = score_violations(cards, ready, EVIDENCE_MAXIMA, "final_score", EVIDENCE_TEXT, F.col)
    paths = cards.join(ready.select("identity", F.col("text_path").alias("_wanted")), "identity").where(~F.col("full_text_path").eqNullSafe(F.col("_wanted")))
    out = out.unionByName(paths.select("identity", F.lit("wrong_full_text_path").alias("violation")))
    if reads is not None:
        out = out.unionByName(cards.join(reads, "identity", "left_anti").select("identity", F.lit("no_validated_read").alias("violation")))
        cited = cards.join(reads.select("identity", F.col("read_path").alias("_read")), "identity").where(~F.col("read_path").eqNullSafe(F.col("_read")))
        out = out.unionByName(cited.select("identity", F.lit("wrong_read_path").alias("violation")))
    return out


def ranked(rows: DataFrame, score: str, target: int, key: str = "identity") -> DataFrame:
    """The best `target` rows by score, ties by key, with their rank: a top-N, so only its rows are ordered."""
    best = rows.orderBy(F.col(score).desc(), F.col(key)).limit(target)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(key))))


def shortlist(papers: DataFrame, scores: DataFrame, target: int = 100, on: str = "identity") -> DataFrame:
    """Scored papers with their evaluation, cut to the target. Scores are joined by `on`; ties go by identity."""
    total = _total(METADATA_MAXIMA, lambda name: F.col("components")[name])
    evaluation = scores.select(on, total.alias("metadata_score"), F.struct(*[F.col(c) for c in scores.columns if c != on]).alias("metadata_evaluation"))
    return ranked(papers.join(evaluation, on), "metadata_score", target)


def final_ranking(ready: DataFrame, cards: DataFrame, target: int = 20) -> DataFrame:
    total = _total(EVIDENCE_MAXIMA, F.col)
    return ranked(ready.select("identity").join(cards.withColumn("final_score", total), "identity"), "final_score", target)
