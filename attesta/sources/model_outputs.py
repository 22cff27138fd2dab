"""Model answers (one JSON text per document) as long tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta import rules
from attesta.functions import text as t

_ITEM = "struct<value:string,evidence:string,page:bigint>"
_OUTPUT = (f"struct<document_type:string,fields:map<string,{_ITEM}>,"
           "other_fields:array<struct<label:string,value:string,page:bigint>>,"
           "legibility_notes:string>")


def field_specs(spark: SparkSession, specs: dict = rules.FIELD_SPECS) -> DataFrame:
    """The field list of every document type as a small table; type ``*`` serves all others."""
    return spark.createDataFrame(
        [(dt, i, *spec) for dt, items in specs.items() for i, spec in enumerate(items)],
        "document_type string, spec_pos int, name string, kind string, required boolean, "
        "target_field string, pattern string")


def spec_type(document_type, specs: dict = rules.FIELD_SPECS) -> Column:
    """Which field list a document type uses."""
    c = t._c(document_type)
    return F.when(c.isin([k for k in specs if k != "*"]), c).otherwise("*")


def parse_outputs(raw: DataFrame, specs: dict = rules.FIELD_SPECS) -> DataFrame:
    """JSON parsed once: adds model_type, document_type (the model's when it has a field list of
    its own, else the expected one), fields, other_fields, legibility_notes."""
    out = raw.withColumn("__o", F.from_json("json", _OUTPUT))
    model = F.coalesce(F.when(F.col("__o.document_type") != "", F.col("__o.document_type")),
                       F.lit("OTHER"))
    own = [k for k in specs if k != "*"]
    kept = [c for c in raw.columns if c != "json"]
    return out.select(
        *kept, model.alias("model_type"),
        F.when(model.isin(own), model).otherwise(F.col("expected_type")).alias("document_type"),
        F.col("__o.fields").alias("fields"), F.col("__o.other_fields").alias("other_fields"),
        F.col("__o.legibility_notes").alias("legibility_notes"))


def explode_model_output(raw: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """A4. One row per document and field of its list: value trimmed (empty is null), page only
    when it is a whole number. ``raw``: sha256, version, expected_type, json."""
    own = specs is None   # the library's own table is a constant; one passed in may be of any size
    specs = field_specs(raw.sparkSession) if own else specs
    parsed = parse_outputs(raw).withColumn("__spec", spec_type("document_type"))
    s = specs.select(F.col("document_type").alias("__spec"), "spec_pos", "name",
                     "kind", "required", "target_field", "pattern")
    s = F.broadcast(s) if own else s
    rows = parsed.join(s, "__spec").withColumn("__i", F.try_element_at("fields", F.col("name")))
    value = t.strip(F.col("__i.value"))
    return rows.select(
        "sha256", "version", "expected_type", "model_type", "document_type", "spec_pos", "name",
        "kind", "required", "target_field", "pattern",
        F.when(value != "", value).alias("value"),
        F.when(F.col("__i.evidence") != "", F.col("__i.evidence")).alias("evidence"),
        F.when(value != "", F.col("__i.page").cast("int")).alias("page"))


def clean_other_fields(parsed: DataFrame, most: int | None = None) -> DataFrame:
    """A5. The labelled items outside the field list (all, or the first ``most``) that have a label
    and a value, both trimmed and whole."""
    items = parsed.select("sha256", "version", F.posexplode(
        "other_fields" if most is None else F.slice("other_fields", 1, most)).alias("pos", "o"))
    return items.where((F.col("o.label") != "") & (F.col("o.value") != "")).select(
        "sha256", "version", "pos", t.strip("o.label").alias("label"),
        t.strip("o.value").alias("value"),
        F.col("o.page").cast("int").alias("page"))
