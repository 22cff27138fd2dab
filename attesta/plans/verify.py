"""The whole verification of all accounts at once, as one set of tables.

Tables that several later steps read are written once (``keep``), so no step computes an earlier
one again and every plan stays small.
"""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta import rules
from attesta.operators import alerts as al
from attesta.operators import decide as d
from attesta.operators import facts as fa
from attesta.operators import fields as fi
from attesta.operators import reviews as rv
from attesta.session import keep
from attesta.sources import model_outputs as mo


def extract(outputs: DataFrame, pages: DataFrame, today: date,
            assumed_expiry: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Model answers and page texts to settled fields and documents: normalise, confirm, score,
    validate. Returns fields, documents, other_fields."""
    doc = fi.DOC
    fields = mo.explode_model_output(outputs)
    fields = fi.score_confidence(fi.ground_fields(fi.normalize_fields(fields), pages))
    fields = keep(fields, "confirmed")
    fields, cross = fi.cross_field_rules(fields)
    parsed = mo.parse_outputs(outputs)
    wide = fi.pivot_fields(fields, [*doc, "document_type"], fi.VALIDITY_FIELDS)
    dated = fi.check_validity(wide, today, assumed_expiry)
    issues = fi.document_issues(doc, fi.type_disagreement(parsed), cross,
                                fi.field_issues(fields), dated, parsed)
    documents = dated.select(*doc, "document_type", "validity_status", "valid_until").join(
        issues, doc, "left").withColumn("issues", F.coalesce(
            "issues", F.array().cast(fi.t.ISSUES)))
    return {"fields": fields, "documents": documents,
            "other_fields": mo.clean_other_fields(parsed)}


def assess(accounts: DataFrame, contacts: DataFrame, docs: DataFrame, fields: DataFrame,
           system: str = "CRM", source_rules=rules.SOURCE_RULES) -> dict[str, DataFrame]:
    """Documents and fields of all accounts to facts, checks, proposals and a recommendation.
    ``docs``: account_id, doc_id, doc_pos, file_name, document_type, validity_status, valid_until,
    issues, other_fields; ``fields``: doc_id, name, value, normalized, grounding, confidence."""
    facts = keep(fa.collect_facts(docs, fields, source_rules), "facts")
    checks = keep(fa.cross_check(facts), "checks")
    chosen = fa.choose_best(facts)
    chosen = keep(fa.consensus_confidence(chosen, fa.agreeing_documents(chosen, facts)),
                  "chosen")
    formed = keep(fa.account_forms(accounts, chosen), "accounts")
    docs = keep(d.valid_until_source(docs, fields), "docs")
    proposals = d.propose_changes(chosen, formed, checks, system)
    proposals = proposals.unionByName(d.compare_account_name(formed, facts)).unionByName(
        d.propose_attachments(docs, formed))
    proposals = keep(d.hold_conflicted(proposals, checks), "proposals")
    requirements = keep(d.check_requirements(docs, formed), "requirements")
    activation = keep(d.activation_checks(formed, contacts, chosen, proposals, system),
                      "activation")
    problems = d.document_problems(docs)
    texts = fa.conflict_texts(facts, checks)
    recommendations = keep(d.recommend(formed, texts, requirements, problems, activation),
                           "recommendations")
    return {"facts": facts, "checks": checks, "chosen": chosen, "accounts": formed,
            "proposals": proposals, "requirements": requirements, "activation": activation,
            "problems": problems, "conflict_texts": texts, "recommendations": recommendations,
            "docs": docs}


def act(assessed: dict[str, DataFrame], unusable: DataFrame, today: date,
        threshold: float = rules.AUTO_THRESHOLD, mode: str = "shadow",
        system: str = "CRM") -> dict[str, DataFrame]:
    """What follows from an assessment: update plan, status decision, alerts, review rows."""
    a = assessed
    blockers = d.blocking_problems(a["checks"], a["problems"])
    plan = keep(d.plan_updates(a["proposals"], blockers, threshold=threshold), "plan")
    decisions = keep(d.status_decision(a["recommendations"], a["accounts"], a["proposals"],
                                       a["facts"], a["activation"], plan, threshold, system),
                     "decisions")
    items = plan.unionByName(rv.activation_items(decisions, a["accounts"]))
    updates = keep(rv.apply_auto_updates(items, a["accounts"], mode), "updates")
    alerts = al.alert_active_with_problems(
        al.build_alerts(a["requirements"], a["conflict_texts"], a["problems"], unusable,
                        a["proposals"], today), decisions)
    status = updates.select("account_id", "target_field",
                            F.col("status").alias("auto_apply_status"))
    proposals = a["proposals"].join(status, ["account_id", "target_field"], "left")
    return {"plan": items, "decisions": decisions, "updates": updates, "alerts": alerts,
            "signatures": al.alert_signature(alerts), "proposals": proposals,
            "review_rows": rv.build_review_rows(proposals, rv.evidence_lines(a["facts"])),
            "review_status": rv.review_status(a["accounts"], proposals, a["requirements"])}
