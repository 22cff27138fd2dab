"""Scoring against a gold set, and masking of identifiers."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as t
from attesta.operators.facts import compare_values

CONFIRMED = ["EXACT", "FUZZY", "CROSS_CHECKED"]


def judge_fields(gold: DataFrame, fields: DataFrame, keys: Sequence[str] = ("doc_id",)
                 ) -> DataFrame:
    """Each gold field with its result CORRECT, MINOR_DIFF, WRONG or MISSED; of several accepted
    answers the best verdict counts. ``gold``: keys, field, accepted (array); ``fields``: keys, name,
    kind, value, grounding. Gold fields the document's list lacks are left out."""
    keys = list(keys)
    got = fields.select(*keys, F.col("name").alias("field"), "kind", "value", "grounding",
                        *(["confidence"] if "confidence" in fields.columns else []))
    both = gold.join(got, [*keys, "field"])
    pairs = both.withColumn("answer", F.explode_outer("accepted"))
    judged = compare_values(pairs, "kind", "value", "answer")
    rank = F.when(F.col("verdict") == "SAME", 2).when(
        F.col("verdict") == "MINOR_DIFF", 1).otherwise(0)
    best = judged.groupBy(*keys, "field").agg(
        F.max(rank).alias("__best"), F.first("value").alias("value"),
        F.first("grounding").alias("grounding"))
    return best.select(*keys, "field", "value", "grounding", F.when(
        F.col("value").isNull(), "MISSED").when(F.col("__best") == 2, "CORRECT").when(
        F.col("__best") == 1, "MINOR_DIFF").otherwise("WRONG").alias("result"))


def score_extraction(judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """J1. Totals of judged fields: results, accuracy, wrong values by grounding, and wrong values
    that looked confirmed."""
    wrong = F.col("result") == "WRONG"

    def wrong_as(g):
        return F.count_if(wrong & (F.col("grounding") == g)).alias(f"wrong_{g.lower()}")
    return judged.groupBy(*by).agg(
        F.count("*").alias("fields_total"),
        *[F.count_if(F.col("result") == r).alias(r.lower())
          for r in ("CORRECT", "MINOR_DIFF", "WRONG", "MISSED")],
        *[wrong_as(g) for g in ("EXACT", "FUZZY", "CROSS_CHECKED", "CONFLICT", "NOT_FOUND",
                                "UNVERIFIABLE")],
        F.count_if(wrong & F.col("grounding").isin(CONFIRMED)).alias(
            "wrong_but_looked_confirmed")).withColumn("field_accuracy", F.round(
                F.col("correct") / F.greatest(F.col("fields_total"), F.lit(1)), 3))


def score_reading(gold_types: DataFrame, gold_fields: DataFrame, texts: DataFrame,
                  keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """J2. Per gold document: is its type right, how many gold values does its text hold, which are
    missing. ``texts``: keys, text, document_type; ``gold_types``: keys, expected_type;
    ``gold_fields``: keys, field, accepted (array)."""
    keys = list(keys)
    base = gold_types.join(texts.select(*keys, t.alnum("text").alias("__text"),
                                        "document_type"), keys)
    asked = gold_fields.where(F.size("accepted") > 0).join(
        base.select(*keys, "__text"), keys)
    hit = F.exists("accepted", lambda a: F.col("__text").contains(t.alnum(a)))
    found = asked.select(*keys, "field", hit.alias("hit")).groupBy(*keys).agg(
        F.count_if("hit").alias("fields_found"), F.count("*").alias("fields_total"),
        F.array_sort(F.collect_list(F.when(~F.col("hit"), F.col("field")))).alias("missing"))
    return base.join(found, keys, "left").select(
        *keys, "expected_type", F.col("document_type").alias("predicted_type"),
        (F.col("expected_type") == F.col("document_type")).alias("type_correct"),
        F.coalesce("fields_found", F.lit(0)).alias("fields_found"),
        F.coalesce("fields_total", F.lit(0)).alias("fields_total"),
        F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def reading_totals(scored: DataFrame) -> DataFrame:
    """Classification accuracy and grounding recall over all gold documents."""
    return scored.agg(
        F.count("*").alias("documents"),
        F.round(F.count_if("type_correct") / F.greatest(F.count("*"), F.lit(1)), 3)
        .alias("classification_accuracy"),
        F.sum("fields_found").alias("fields_found"), F.sum("fields_total").alias("fields_total"),
        F.round(F.sum("fields_found") / F.greatest(F.sum("fields_total"), F.lit(1)), 3)
        .alias("grounding_recall"))


def compare_models(judged: DataFrame, extractions: DataFrame) -> DataFrame:
    """J3. Scores per model and version side by side with their token, call and time totals."""
    scores = score_extraction(judged, ("model", "version"))
    used = extractions.groupBy("model", "version").agg(
        F.count("*").alias("documents"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("calls").alias("calls"),
        F.round(F.sum("seconds"), 2).alias("seconds"))
    return scores.join(used, ["model", "version"], "left")


def mask_sensitive(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """J4. Tax numbers, secrets and tokens masked in the given text columns."""
    return df.withColumns({c: t.mask(c) for c in columns})
