"""Words to pages to documents: text assembly, quality, classification."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta import rules
from attesta.functions import text as t


def assemble_page_text(words: DataFrame,
                       page: Sequence[str] = ("sha256", "page_number", "pass")) -> DataFrame:
    """C1. Text of each page from its words: blank words and negative confidences dropped, words
    joined per line, lines by line break; mean confidence to one decimal; words read well (sure,
    three letters or more) counted for C2. One page is one group."""
    page = list(page)
    word = F.trim("text")
    kept = (word != "") & (F.col("conf") >= 0)
    sure = (kept & (F.col("conf") >= 70) & (F.length(word) >= 3) & word.rlike(r"^\p{L}+$"))
    lines = words.groupBy(*page, "block", "par", "line").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(kept, F.struct("pos", word.alias("text"))))),
            lambda w: w["text"]), " ").alias("__text"),
        F.sum(F.when(kept, F.col("conf"))).alias("__conf"), F.count_if(kept).alias("__n"),
        F.count_if(sure).alias("__sure"))
    filled = F.when(F.col("__n") > 0, F.struct("block", "par", "line", "__text"))
    return lines.groupBy(*page).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(filled)), lambda x: x["__text"]),
                     "\n").alias("text"),
        F.coalesce(F.round(F.sum("__conf") / F.nullif(F.sum("__n"), F.lit(0)), 1), F.lit(0.0))
        .alias("mean_conf"),
        F.sum("__n").alias("word_count"), F.sum("__sure").alias("readable"))


def choose_best_reading(readings: DataFrame, page: Sequence[str] = ("sha256", "page_number"),
                        passes: Sequence[str] = ("ocr", "ink", "adaptive")) -> DataFrame:
    """C2. Of the passes over a page keep the one with most readable words (the first listed wins
    ties); the grounding text joins them all. A page has at most ``len(passes)`` readings."""
    at = F.array_position(t.word_array(passes), F.col("pass"))
    best = readings.withColumn("__at", at).groupBy(*page).agg(
        F.max_by(F.struct("pass", "text", "mean_conf", "word_count", "readable"),
                 F.struct(F.col("readable"), -F.col("__at"))).alias("b"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "text"))),
                                 lambda r: r["text"]), "\n").alias("grounding_text"),
        F.count("*").alias("__n"))
    first = passes[0]
    return best.select(
        *page, "b.text", "b.mean_conf", "b.word_count", "b.readable", "grounding_text",
        F.when(F.col("__n") == 1, F.col("b.pass"))
        .when(F.col("b.pass") == first, f"{first}+{passes[1]}")
        .otherwise(F.concat(F.lit(f"{first}+"), F.col("b.pass"))).alias("text_method"))


def flag_second_pass(pages: DataFrame, below_conf: float = 80.0,
                     below_words: int = 40) -> DataFrame:
    """C3. Pages whose first reading is weak, and the passes they need: dark ink only, and locally
    adaptive when there are few words."""
    few = F.col("word_count") < below_words
    return pages.where((F.col("mean_conf") < below_conf) | few).withColumn(
        "second_passes", F.when(few, t.word_array(["ink", "adaptive"]))
        .otherwise(t.word_array(["ink"])))


def route_pages(pages: DataFrame, least: int = 80) -> DataFrame:
    """C4. Pages with a usable text layer against pages to scan."""
    digital = F.coalesce(F.length(F.regexp_replace("text", r"\s", "")) >= least, F.lit(False))
    return pages.withColumn("source", F.when(digital, "pdf_text").otherwise("pdf_scan")) \
        .withColumn("text_layer", digital)


def limit_pages(pages: DataFrame, n: int = 30, by: Sequence[str] = ("sha256", "version"),
                order: Sequence[str] = ("page_number",)) -> DataFrame:
    """C5. The first ``n`` pages per file. Spark keeps ``n`` rows per group already before the
    shuffle (window group limit), so a large group stays small."""
    w = Window.partitionBy(*by).orderBy(*order)
    return pages.withColumn("__rn", F.row_number().over(w)).where(
        F.col("__rn") <= n).drop("__rn")


def score_page_quality(pages: DataFrame) -> DataFrame:
    """C6. Quality score, label and reasons from confidence, sharpness, resolution, word count."""
    def part(x, low, span):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / span))

    conf, words = F.col("ocr_conf"), F.col("word_count")
    score = F.round(0.6 * part(conf, 40, 50) + 0.25 * part(F.col("sharpness"), 0, 300)
                    + 0.15 * part(F.col("resolution"), 0, 2000), 2)
    layer = F.coalesce("text_layer", F.lit(False))
    df = pages.withColumn("quality_score", F.when(layer, 1.0).otherwise(score))
    label = (F.when(layer, "GOOD").when((words < 15) | (conf < 40), "UNREADABLE")
             .when(F.col("quality_score") >= 0.7, "GOOD")
             .when(F.col("quality_score") >= 0.5, "FAIR").otherwise("POOR"))
    reasons = F.when(layer, F.array(F.lit("digital PDF text layer"))).otherwise(t.present(
        F.when(F.col("resolution") < 1000, F.concat(
            F.lit("low resolution ("), F.col("resolution").cast("string"),
            F.lit("px long side)"))),
        F.when(F.col("sharpness") < 60, "blurry"),
        F.when(words < 15, "very little readable text")))
    return df.withColumn("quality_label", label).withColumn("quality_reasons", reasons)


def classify_documents(texts: DataFrame, rule_rows: Sequence = rules.CLASSIFY_RULES,
                       name_hints: Sequence = rules.NAME_HINTS,
                       min_score: float = rules.MIN_CLASS_SCORE, text: str = "text",
                       name: str | None = "file_name", keep: int | None = None) -> DataFrame:
    """C7. Document type by weighted phrases found in the squashed text, one point per type for a
    file name hint; adds document_type, type_confidence, type_signals (all, or the first ``keep``).

    The rules are constants inside the expression: each text is squashed once and searched where
    it was read, with no join and no shuffle. Among equal scores the type seen first wins:
    rule order, then hint order.
    """
    squashed = F.regexp_replace(F.upper(F.coalesce(F.col(text), F.lit(""))), "[^A-Z0-9]", "")
    hits = t.present(*[
        F.when(F.col("__sq").contains("".join(p.split())), F.struct(
            F.lit(d).alias("type"), F.lit(p).alias("phrase"), F.lit(float(w)).alias("weight")))
        for d, p, w in rule_rows])
    df = texts.withColumn("__sq", squashed).withColumn("__hits", hits)
    hinted: dict[str, list[str]] = {}
    for d, h in name_hints if name else ():
        hinted.setdefault(d, []).append(h)
    upper = F.upper(F.coalesce(F.col(name), F.lit(""))) if name else F.lit("")
    ruled = list(dict.fromkeys(d for d, _, _ in rule_rows))

    def score(d):
        own = F.filter("__hits", lambda r: r["type"] == d)
        points = F.aggregate(own, F.lit(0.0), lambda acc, r: acc + r["weight"])
        signals = F.transform(own, lambda r: r["phrase"])
        late = len(ruled) + (list(hinted).index(d) if d in hinted else 0)
        seen = ruled.index(d) if d in ruled else late
        if d in hinted:
            hit = upper.rlike("(^|[^A-Z])(" + "|".join(hinted[d]) + ")([^A-Z]|$)")
            points = points + F.when(hit, 1.0).otherwise(0.0)
            signals = F.when(hit, F.concat(signals, F.array(F.concat(
                F.lit("file name: "), upper)))).otherwise(signals)
        pos = F.when(F.size(own) > 0, seen).otherwise(late)
        return F.struct(points.alias("score"), (-pos).alias("first"), F.lit(d).alias("type"),
                        signals.alias("signals"))

    types = list(dict.fromkeys(ruled + list(hinted)))
    ranked = F.sort_array(F.filter(F.array(*[score(d) for d in types]),
                                   lambda s: s["score"] > 0), asc=False)
    df = df.withColumn("__ranked", ranked)
    top, second = F.get("__ranked", F.lit(0)), F.get("__ranked", F.lit(1))
    best, runner = top["score"], F.coalesce(second["score"], F.lit(0.0))
    known = F.coalesce(best >= min_score, F.lit(False))
    confidence = F.least(F.lit(1.0), F.round(
        F.least(F.lit(1.0), best / 10) * (1 - runner / (best + runner)) * 2, 2))
    return df.select(
        *texts.columns,
        F.when(known, top["type"]).otherwise("OTHER").alias("document_type"),
        F.when(known, confidence).otherwise(0.0).alias("type_confidence"),
        F.when(known, (top["signals"] if keep is None else F.slice(top["signals"], 1, keep))).otherwise(
            F.array().cast("array<string>")).alias("type_signals"))


def rollup_readings(pages: DataFrame, by: Sequence[str] = ("sha256", "version"),
                    page: str = "page_number") -> DataFrame:
    """C8. Per file: page count, type and confidence of its first page; UNREADABLE when all pages
    are."""
    out = pages.groupBy(*by).agg(
        F.count("*").alias("page_count"), F.min_by("document_type", page).alias("document_type"),
        F.min_by("type_confidence", page).alias("type_confidence"),
        F.bool_and(F.col("quality_label") == "UNREADABLE").alias("__dark"))
    return out.select(
        *by, F.when(F.col("__dark"), "UNREADABLE").otherwise("READ").alias("status"),
        F.when(F.col("__dark"), "No readable text (blurry, dark or not a document)")
        .alias("error"), "page_count", "document_type", "type_confidence")


def readable_pages(pages: DataFrame) -> DataFrame:
    """C9. Pages worth extracting from. Page order stays a column; nothing is sorted globally."""
    return pages.where(F.col("quality_label") != "UNREADABLE")
