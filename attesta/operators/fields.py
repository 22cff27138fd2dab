"""Extracted fields: normal form, confirmation against page text, confidence, issues, validity.

Fields are long: one row per document (``doc`` columns) and field name.
"""

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import rules
from attesta.functions import text as t
from attesta.functions.similarity import candidate_regions, window_search
from attesta.operators.reading import limit_pages

DOC = ["sha256", "version"]


def normalize_fields(fields: DataFrame) -> DataFrame:
    """D4. Adds the typed normal form of each value by its kind."""
    return fields.withColumn("normalized", t.normalize("kind", "value"))


def page_texts(pages: DataFrame, doc: Sequence[str] = DOC, most: int | None = None) -> DataFrame:
    """One row per document: its pages (all, or the first ``most``) as an
    array of squashed texts and quality labels, and the worst quality label."""
    factor = F.array_position(t.word_array(rules.QUALITY_ORDER), F.col("quality_label"))
    first = pages if most is None else limit_pages(pages, most, doc)
    return first.groupBy(*doc).agg(
        F.array_sort(F.collect_list(F.struct(
            "page_number", t.alnum("grounding_text").alias("text"), "quality_label")))
        .alias("__pages"),
        F.min_by("quality_label", F.struct(factor, F.col("page_number"))).alias("__worst"))


def _exact(value: Column, kind: Column, text: Column) -> Column:
    """The rendering of the value that the text holds, or null."""
    dated = F.when(kind == "date", t.date_renderings(t.parse_date(value)))
    candidates = F.concat(F.array(value), F.coalesce(dated, F.array().cast("array<string>")))
    return F.get(F.filter(candidates, lambda c: (t.alnum(c) != "") & text.contains(t.alnum(c))),
                 F.lit(0))


def ground_fields(fields: DataFrame, pages: DataFrame, doc: Sequence[str] = DOC,
                  min_ratio: float = rules.FUZZY_MIN_RATIO, most_pages: int | None = None) -> DataFrame:
    """D5. Confirm each value against the independently read text: first the page it was said to be
    on, then all pages. Adds grounding (EXACT, FUZZY, CONFLICT, NOT_FOUND, UNVERIFIABLE),
    ocr_match, score and page_quality.

    Exact hits are found by plain expressions. Only values that occur nowhere exactly and have
    four letters or more go to the window search, against their page first and against the whole
    document only if that found nothing. It is given the surroundings of where a text has the value with few
    edits (``candidate_regions``, which scans the texts of a batch together): they hold every window that can pass.
    """
    search = window_search(min_ratio)
    bundle = page_texts(pages, doc, most_pages)
    df = fields.join(bundle, list(doc), "left")
    # a stated page counts the pages that were shown, not the file's own numbers
    shown = F.when(F.col("page") > 0, F.get("__pages", F.col("page") - 1))
    df = df.withColumn("__on", shown).withColumn(
        "__text", F.array_join(F.transform(
            F.coalesce("__pages", F.array().cast("array<struct<page_number:int,text:string,"
                                                 "quality_label:string>>")),
            lambda p: p["text"]), "")).withColumn("__count", F.size("__pages")).drop("__pages")
    value, kind = F.col("value"), F.col("kind")
    asked = ~t.blank(t.strip(value)) & (kind != "choice")
    df = df.withColumn("__here", F.when(asked, _exact(value, kind, F.col("__on.text"))))
    df = df.withColumn("__needle", F.when(asked, t.alnum(value)))
    long_enough = F.length("__needle") >= 4
    sought = F.col("__here").isNull() & long_enough   # no text goes to Python without its needle
    df = df.withColumn("__ask", F.when(sought, F.col("__needle"))).withColumn("__text_on", F.when(
        F.col("__ask").isNotNull(), F.col("__on.text")))
    df = df.withColumn("__parts", candidate_regions(F.col("__ask"), F.col("__text_on"), min_ratio))
    df = df.withColumn("__near", search(F.col("__ask"), F.col("__parts"), F.size("__parts"))).drop("__parts", "__text_on")
    # the whole document is another text only when it has more than the stated page
    open_ = (F.col("__here").isNull() & F.col("__near.ratio").isNull()
             & (F.col("__on").isNull() | (F.col("__count") > 1)))
    df = df.withColumn("__any", F.when(asked & open_, _exact(value, kind, F.col("__text"))))
    # a value exactly on another page needs no window search over the whole document
    last = open_ & F.col("__any").isNull() & long_enough
    df = df.withColumn("__ask", F.when(last, F.col("__needle"))).withColumn("__text", F.when(
        F.col("__ask").isNotNull(), F.col("__text")))
    df = df.withColumn("__parts", candidate_regions(F.col("__ask"), F.col("__text"), min_ratio))
    df = df.withColumn("__far", search(F.col("__ask"), F.col("__parts"), F.size("__parts")))
    exact = F.coalesce("__here", "__any")
    ratio = F.coalesce("__near.ratio", "__far.ratio")
    window = F.coalesce("__near.matched", "__far.matched")
    clash = kind.isin(rules.EXACT_KINDS) | t.numbers_conflict(F.col("__needle"), window)
    status = (F.when(t.blank(t.strip(value)), F.lit(None).cast("string"))
              .when(kind == "choice", "UNVERIFIABLE")
              .when(exact.isNotNull(), "EXACT")
              .when(ratio.isNotNull(), F.when(clash, "CONFLICT").otherwise("FUZZY"))
              .otherwise("NOT_FOUND"))
    return df.select(
        *fields.columns, status.alias("grounding"),
        F.when(exact.isNotNull(), exact).otherwise(window).alias("ocr_match"),
        F.when(exact.isNotNull(), 1.0).otherwise(F.coalesce(F.round(ratio, 3), F.lit(0.0)))
        .alias("score"),
        F.coalesce("__on.quality_label", "__worst").alias("page_quality"))


def bad_format(pattern, value) -> Column:
    """The value's letters and digits do not fit the whole pattern."""
    squashed = t.alnum(value)
    return t._c(pattern).isNotNull() & ~F.rlike(
        squashed, F.concat(F.lit("^(?:"), t._c(pattern), F.lit(")$")))


def score_confidence(fields: DataFrame, table: dict = rules.CONFIDENCE) -> DataFrame:
    """D6. Confidence by grounding and page quality from the rule table; 0.2 when a date, tax number
    or amount cannot be read or the value does not fit its pattern; null without a value."""
    flat = {f"{g}|{q}": c for g, row in table.items() for q, c in row.items()}
    quality = F.when(F.col("page_quality").isin(rules.QUALITY_ORDER), F.col("page_quality")) \
        .otherwise("UNREADABLE")
    unread = F.col("kind").isin(rules.TYPED_KINDS) & F.col("normalized").isNull()
    bad = unread
    if "pattern" in fields.columns:
        bad = bad | bad_format("pattern", "value")
    return fields.withColumn("confidence", F.when(
        F.col("value").isNotNull(), F.when(bad, 0.2).otherwise(F.try_element_at(
            t.lookup(flat), F.concat_ws("|", "grounding", quality)))))


def field_issues(fields: DataFrame, keys: Sequence[str] = DOC) -> DataFrame:
    """D7. One row per issue: scope ``document`` (required or unreadable values) or ``field``
    (format and confirmation), with code, message, field, severity in spec order."""
    name, value, kind = F.col("name"), F.col("value"), F.col("kind")
    ground = F.col("grounding")
    has = ~t.blank("value")

    def scoped(scope, item):
        return F.struct(F.lit(scope).alias("scope"), item.alias("i"))

    unread = has & F.col("normalized").isNull() & kind.isin(rules.TYPED_KINDS)
    items = t.present(
        F.when(~has & F.col("required"), scoped("document", t.issue(
            "MISSING_REQUIRED", F.concat(name, F.lit(" not found on the document")), name))),
        F.when(unread, scoped("document", t.issue(
            F.concat(F.lit("INVALID_"), F.upper(kind)),
            F.concat(name, F.lit(" "), t.quoted(value), F.lit(" is not a valid "), kind), name,
            F.when(kind == "tin", "CRITICAL").otherwise("WARNING")))),
        F.when(has & bad_format("pattern", "value"), scoped("field", t.issue(
            "INVALID_FORMAT", F.concat(t.quoted(value), F.lit(
                " does not have the expected format")), name))),
        F.when(has & (ground == "CONFLICT"), scoped("field", t.issue(
            "OCR_CONFLICT", F.concat(F.lit("OCR read "), t.quoted("ocr_match"), F.lit(
                " near this value; check the image")), name))),
        F.when(has & (ground == "NOT_FOUND"), scoped("field", t.issue(
            "NOT_IN_OCR_TEXT", "Value could not be confirmed by OCR; check the image", name,
            "INFO"))),
        F.when(has & (ground == "UNVERIFIABLE"), scoped("field", t.issue(
            "CHECKBOX_NOT_VERIFIED", "Checkbox: confirm which box is marked on the image", name,
            "INFO"))))
    rows = fields.select(*keys, "spec_pos", F.explode(items).alias("x"))
    return rows.select(*keys, "spec_pos", "x.scope", "x.i.code", "x.i.message", "x.i.field",
                       "x.i.severity")


# The fields the validity rules look at, and the column each becomes
VALIDITY_FIELDS = {"valid_from": "valid_from", "valid_to": "valid_to",
                   "valid_until": "printed_until", "date_issued": "date_issued",
                   "date_paid": "date_paid", "permit_year": "permit_year",
                   "issue_date": "issue_date", "expiry_date": "expiry_date",
                   "id_type": "id_type", "tin": "tin"}


def pivot_fields(fields: DataFrame, keys: Sequence[str], names: dict[str, str],
                 value: str = "normalized") -> DataFrame:
    """The named fields of each document side by side (combined before the shuffle)."""
    return fields.groupBy(*keys).agg(*[
        F.max(F.when(F.col("name") == n, F.col(value))).alias(c) for n, c in names.items()])


def _iso(x) -> Column:
    return F.try_to_date(t._c(x), "yyyy-MM-dd")


def check_validity(docs: DataFrame, today: date,
                   assumed_expiry: dict[str, str] | None = None) -> DataFrame:
    """D8. Adds validity_status, valid_until (DATE) and validity_issues for documents with their
    normalized fields side by side (``pivot_fields``). A missing date column counts as empty.
    ``assumed_expiry`` {"MAYORS_PERMIT": "DEC_31_OF_ISSUE_YEAR"} derives permits' expiry."""
    held = set(docs.columns)

    def col(name):
        return F.col(name).cast("string") if name in held else F.lit(None).cast("string")

    kind, now = F.coalesce("document_type", F.lit("OTHER")), F.lit(today)
    issued, paid = _iso(col("date_issued")), _iso(col("date_paid"))
    end = (F.when(kind == "DTI_BN_CERT", _iso(col("valid_to")))
           .when(kind == "MAYORS_PERMIT", _iso(col("printed_until")))
           .when(kind == "GOVERNMENT_ID", _iso(col("expiry_date"))))
    start = (F.when(kind == "DTI_BN_CERT", _iso(col("valid_from")))
             .when(kind == "MAYORS_PERMIT", issued)
             .when(kind == "GOVERNMENT_ID", _iso(col("issue_date"))))
    derived_year = F.lit(None).cast("int")
    origin = F.lit(None).cast("string")
    if (assumed_expiry or {}).get("MAYORS_PERMIT") == "DEC_31_OF_ISSUE_YEAR":
        printed = F.when(col("permit_year").rlike(r"^\d+$"), col("permit_year").try_cast("int"))
        applies = (kind == "MAYORS_PERMIT") & end.isNull()
        derived_year = F.when(applies, F.coalesce(printed, F.year(issued), F.year(paid)))
        origin = (F.when(printed.isNotNull(), "permit year").when(
            issued.isNotNull(), "date issued").otherwise("date paid"))
    df = docs.withColumn("__start", start).withColumn("__year", derived_year).withColumn(
        "__derived", F.make_date(F.col("__year"), F.lit(12), F.lit(31))).withColumn(
        "__end", F.coalesce(end, F.col("__derived")))
    start, end = F.col("__start"), F.col("__end")
    years = F.datediff(end, start) / 365.25
    timed = kind.isin("DTI_BN_CERT", "MAYORS_PERMIT", "GOVERNMENT_ID")
    no_date = F.coalesce(timed & end.isNull(), F.lit(False))
    tin_id = (kind == "GOVERNMENT_ID") & F.coalesce(col("id_type").contains("TIN"), F.lit(False))
    status = (F.when(kind == "BIR_2303",
                     F.when(t.blank(col("tin")), "UNKNOWN").otherwise("VALID"))
              .when(~timed, "UNKNOWN").when(no_date, "NO_EXPIRY").when(end < now, "EXPIRED")
              .when(start > now, "NOT_YET_VALID").otherwise("VALID"))
    iso = F.date_format(end, "yyyy-MM-dd")
    issues = t.present(
        F.when((kind == "DTI_BN_CERT") & ~years.between(4.9, 5.1), t.issue(
            "UNUSUAL_VALIDITY_PERIOD", F.concat(
                F.lit("DTI validity is "), F.format_string("%.1f", years),
                F.lit(" years; expected 5")), "valid_to")),
        F.when(F.col("__derived").isNotNull(), t.issue("VALIDITY_DERIVED", F.concat(
            F.lit("No expiry printed; valid until "), iso, F.lit(" (Dec 31 of the "), origin,
            F.lit(", rule book)")), "valid_until", "INFO")),
        F.when(no_date & ~tin_id, t.issue(
            "NO_EXPIRY_PRINTED",
            "No expiry date printed on this document (check the document)")),
        F.when(timed & (end < now), t.issue("EXPIRED", F.concat(
            F.lit("Expired on "), iso, F.lit(" ("), F.datediff(now, end).cast("string"),
            F.lit(" days ago)")), None, "CRITICAL")),
        F.when(timed & (end >= now) & (start > now), t.issue("NOT_YET_VALID", F.concat(
            F.lit("Valid only from "), F.date_format(start, "yyyy-MM-dd")))))
    return df.select(*docs.columns, status.alias("validity_status"),
                     F.when(timed, end).alias("valid_until"), issues.alias("validity_issues"))


def revalidate(docs: DataFrame, today: date,
               assumed_expiry: dict[str, str] | None = None) -> DataFrame:
    """D9. Today's validity for cached results of the dated types; only their old validity issues
    are replaced. ``docs``: fields side by side plus validity_status, valid_until, issues."""
    old = {"validity_status": "__s", "valid_until": "__u"}
    df = check_validity(docs.withColumnsRenamed(old), today, assumed_expiry)
    dated = F.col("document_type").isin(rules.DATED_TYPES)
    kept = F.filter("issues", lambda i: ~i["code"].isin(rules.VALIDITY_CODES))
    return df.withColumn("issues", F.when(dated, F.concat(kept, F.col("validity_issues")))
                         .otherwise(F.col("issues"))) \
        .withColumn("validity_status", F.when(dated, F.col("validity_status"))
                    .otherwise(F.col("__s"))) \
        .withColumn("valid_until", F.when(dated, F.col("valid_until")).otherwise(F.col("__u"))) \
        .select(*docs.columns)


def cross_field_rules(fields: DataFrame, keys: Sequence[str] = DOC
                      ) -> tuple[DataFrame, DataFrame]:
    """D10. Rules between fields of a registration certificate: the branch code of the tax number
    confirms or contradicts the office box; the serial number starts with the district code.
    Returns (fields with the office row settled, issue rows)."""
    keys = list(keys)
    reg = fields.where(F.col("document_type") == "BIR_2303")
    wide = reg.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == n, F.col(c))).alias(a) for n, c, a in (
            ("tin", "normalized", "tin"), ("registering_office", "normalized", "office"),
            ("registering_office", "value", "office_value"), ("ocn", "value", "ocn"),
            ("rdo_code", "value", "rdo"))])
    branch = F.right("tin", F.lit(5))
    expected = F.when(branch == "00000", "HEAD OFFICE").otherwise("BRANCH")
    both = ~t.blank("tin") & ~t.blank("office")
    rdo = t.digits("rdo")
    rdo = F.when(F.length(rdo) < 3, F.lpad(rdo, 3, "0")).otherwise(rdo)
    serial = t.alnum("ocn")
    wide = wide.withColumn("__agrees", F.when(both, F.col("office") == expected))
    items = t.present(
        F.when(~F.col("__agrees"), F.struct(F.lit(0).alias("pos"), t.issue(
            "BRANCH_MISMATCH", F.concat(
                F.lit("TIN branch code "), branch, F.lit(" means "),
                F.when(branch == "00000", "Head Office").otherwise("Branch"),
                F.lit(", but the "), t.quoted("office_value"), F.lit(" box was read as marked")),
            "registering_office", "CRITICAL").alias("i"))),
        F.when(~t.blank("ocn") & ~t.blank("rdo") & serial.rlike(r"^\d{3}RC\d{14}$")
               & (F.substring(serial, 1, 3) != rdo), F.struct(F.lit(1).alias("pos"), t.issue(
                   "OCN_RDO_MISMATCH", F.concat(
                       F.lit("OCN starts with "), F.substring(serial, 1, 3),
                       F.lit(" but the RDO is "), rdo), "ocn").alias("i"))))
    issues = wide.select(*keys, F.explode(items).alias("x")).select(
        *keys, "x.pos", "x.i.code", "x.i.message", "x.i.field", "x.i.severity")
    verdict = wide.where(F.col("__agrees").isNotNull()).select(*keys, "__agrees")
    office = F.col("name") == "registering_office"
    out = fields.join(verdict, keys, "left")
    settled = office & F.col("__agrees").isNotNull()
    return out.withColumn("grounding", F.when(settled, F.when(
        F.col("__agrees"), "CROSS_CHECKED").otherwise("CONFLICT")).otherwise(F.col("grounding"))
    ).withColumn("confidence", F.when(settled, F.when(F.col("__agrees"), 0.9).otherwise(0.2))
                 .otherwise(F.col("confidence"))).select(*fields.columns), issues


def type_disagreement(docs: DataFrame, specs: dict = rules.FIELD_SPECS) -> DataFrame:
    """D11. Documents whose classified (expected_type) and extracted (model_type) types differ: the
    issue, and whether a second extraction with the other field list is due."""
    known = [k for k in specs if k != "*"]
    return docs.where(F.col("expected_type") != F.col("model_type")).withColumn(
        "extract_again", F.col("model_type").isin(known)).withColumn(
        "issue", t.issue("TYPE_MISMATCH", F.concat(
            F.lit("OCR classified "), F.col("expected_type"),
            F.lit(", the vision model says "), F.col("model_type"))))


def document_issues(keys: Sequence[str], mismatches: DataFrame, cross: DataFrame,
                    fields: DataFrame, validity: DataFrame, notes: DataFrame) -> DataFrame:
    """D12. All document issues in reading order, one array per document: type, rules between
    fields, fields, validity, legibility note. A document has at most a few
    issues per field of its list."""
    keys = list(keys)

    def part(df, stage, pos, item):
        return df.select(*keys, F.struct(F.lit(stage).alias("stage"), pos.alias("pos"),
                                         item.alias("i")).alias("x"))

    row = F.struct("code", "message", "field", "severity")
    note = t.issue("LEGIBILITY_NOTE", F.col("legibility_notes"), None, "INFO")
    every = part(mismatches, 0, F.lit(0), F.col("issue"))
    every = every.unionByName(part(cross, 1, F.col("pos"), row))
    own = fields.where(F.col("scope") == "document")
    every = every.unionByName(part(own, 2, F.col("spec_pos"), row))
    valid = validity.select(*keys, F.posexplode("validity_issues").alias("pos", "i"))
    every = every.unionByName(part(valid, 3, F.col("pos"), F.col("i")))
    every = every.unionByName(part(notes.where(~t.blank("legibility_notes")), 4, F.lit(0), note))
    return every.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("x")),
                                                lambda x: x["i"]).alias("issues"))
