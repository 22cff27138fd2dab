"""Forms in spreadsheets, from a table of cells (workbook, sheet, row, col, value, is_text)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta import rules
from attesta.functions import text as t

ROW = ["workbook", "sheet", "row"]


def _clean(x) -> Column:
    return t.collapse(F.replace(t._c(x), F.lit("_x0009_"), F.lit(" ")))


def _letters(col) -> Column:
    """Column letters of a column number: 1 is A, 27 is AA."""
    n = t._c(col).cast("int") - 1

    def letter(x):
        return F.char(F.lit(65) + x)
    low = letter(F.pmod(n, F.lit(26)))
    mid = F.when(n >= 26, letter(F.pmod(F.floor((n - 26) / 26), F.lit(26)))).otherwise("")
    high = F.when(n >= 702, letter(F.floor((n - 702) / 676))).otherwise("")
    return F.concat(high, mid, low)


def label_value_pairs(cells: DataFrame, table_run: int = 5, longest: int = 80) -> DataFrame:
    """D1. Text cells and the filled cell just right of them. A row with ``table_run`` or more
    filled cells side by side is a table row and gives no pairs. A sheet row is one group; it has
    at most as many cells as a sheet has columns."""
    filled = cells.where(~t.blank("value"))
    row = Window.partitionBy(*ROW)
    across = row.orderBy("col")
    df = filled.withColumn("__run", F.col("col") - F.row_number().over(across))
    df = df.withColumn("__size", F.count("*").over(Window.partitionBy(*ROW, "__run")))
    df = df.withColumn("__longest", F.max("__size").over(row)).withColumn(
        "__next", F.lead(F.struct("col", "value")).over(across))
    pairs = df.where((F.col("__longest") < table_run) & F.col("is_text")
                     & (F.col("__next.col") == F.col("col") + 1))
    pairs = pairs.select(
        *ROW, F.col("__next.col").alias("col"),
        F.concat(_letters("__next.col"), F.col("row").cast("string")).alias("cell"),
        _clean("value").alias("label"), _clean("__next.value").alias("value"))
    return pairs.where((F.col("label") != "") & (F.col("value") != "")
                       & (F.length("label") <= longest))


def find_form_sheets(cells: DataFrame, title: str = rules.FORM_TITLE,
                     first_rows: int = 6) -> DataFrame:
    """D2. Workbooks that hold ``title`` in one of their first rows."""
    return cells.where(F.col("is_text") & (F.col("row") <= first_rows)
                       & F.upper("value").contains(title)).select("workbook").distinct()


def _label_key(label) -> Column:
    return F.lower(t.collapse(F.translate(t._c(label), "*:", "")))


def map_labels(pairs: DataFrame, label_map: dict = rules.FORM_LABELS,
               kinds: dict = rules.FORM_KINDS, phone_keys=("phone",),
               confidence: float = rules.FORM_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """D3. Pairs with a known label become fields (the last one wins), all others are other fields.
    Returns (fields, other fields). ``pairs`` may carry sheet_pos, else sheets go by name."""
    known = F.try_element_at(t.lookup(label_map), _label_key("label"))
    place = F.concat(F.col("sheet"), F.lit("!"), F.col("cell"))
    df = pairs.withColumn("name", known).withColumn("location", place)
    sheet = "sheet_pos" if "sheet_pos" in pairs.columns else "sheet"
    last = df.where(F.col("name").isNotNull()).groupBy("workbook", "name").agg(
        F.max_by(F.struct("label", "value", "location"), F.struct(sheet, "row", "col"))
        .alias("p"))
    value = F.when(F.col("name").isin(list(phone_keys)), t.restore_phone_zero("p.value")) \
        .otherwise(F.col("p.value"))
    kind = F.coalesce(F.try_element_at(t.lookup(kinds), F.col("name")), F.lit("text"))
    fields = last.select("workbook", "name", kind.alias("kind"), value.alias("value"),
                         F.concat(F.col("p.label"), F.lit(" ("), F.col("p.location"), F.lit(")"))
                         .alias("evidence"))
    fields = fields.withColumn("normalized", t.normalize("kind", "value")) \
        .withColumn("grounding", F.lit("EXACT")).withColumn("confidence", F.lit(confidence))
    others = df.where(F.col("name").isNull()).select("workbook", "label", "value", "location")
    return fields, others
