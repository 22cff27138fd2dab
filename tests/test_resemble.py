"""Large groups of values that resemble each other: the worst verdict against all pairs, and at size."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from attesta.operators import facts as fa
from attesta.operators import resemble
from tests.test_assess import FACTS, facts_of


def all_pairs(spark, items):
    """Status per group by the verdicts of all pairs of facts from different documents."""
    from attesta import rules
    matcher = {a: s[1] for a, s in rules.CHECKED_ATTRIBUTES.items()}
    groups, pairs = {}, []
    for a, at, v, doc, _ in items:
        groups.setdefault((a, at), []).append((v, doc))
    for key, vs in groups.items():
        for (v1, d1), (v2, d2) in combinations(vs, 2):
            if d1 != d2:
                pairs.append((*key, matcher[key[1]], v1, v2))
    df = fa.match_pairs(spark.createDataFrame(
        pairs, "account_id string, attribute string, kind string, a string, b string"), F.col("kind"))
    rank = F.when(F.col("verdict") == "DIFFERENT", 2).when(F.col("verdict") == "LIKELY_SAME", 1).otherwise(0)
    return {(r.account_id, r.attribute): r.worst for r in df.groupBy("account_id", "attribute").agg(F.max(rank).alias("worst")).collect()}


def ranks(rows):
    return {(r.account_id, r.attribute): {"CONSISTENT": 0, "LIKELY_CONSISTENT": 1}.get(r.status, 2) for r in rows}


@pytest.mark.parametrize("few, block", [(64, 128), (2, 3)])
def test_similar_groups_equal_all_pairs(spark, monkeypatch, few, block):
    monkeypatch.setattr(resemble, "FEW", few)
    monkeypatch.setattr(fa, "worst_within", lambda *a: resemble.worst_within(*a, block=block))
    rnd = random.Random(7)
    street = "5 RIZAL STREET SAN ISIDRO PASIG METRO MANILA LUZON EAST".split()
    items = []
    for g in range(60):
        docs = rnd.choice([1, 2, 4])
        for k in range(rnd.randint(3, 14)):
            doc = f"d{rnd.randrange(docs)}"
            kind = g % 4
            if kind == 0:       # parts of one address, with a word of their own or another number now and then
                words = street[:rnd.randint(5, 10)] + rnd.sample(["ANNEX", "TOWER", "REAR", "GATE"], rnd.randint(0, 2))
                words[0] = "6" if rnd.random() < 0.03 else words[0]
                items.append((f"g{g}", "address", " ".join(words if rnd.random() < 0.7 else street[:rnd.randint(1, 10)]), doc, 0.9))
            elif kind == 1:     # one beginning, different ends
                items.append((f"g{g}", "business_name", "SOLEDAD MARIANO TRADING HOUSE OF PASIG" + rnd.choice(
                    ["", "Q", " E", "A B", "XYZ", " NORTH GATE"][:rnd.randint(1, 6)]), doc, 0.9))
            elif kind == 2:
                items.append((f"g{g}", "owner_name", " ".join(["ANA", "LUNA", "REYES", "CRUZ", "DIAZ"][:rnd.randint(1, 5)]), doc, 0.9))
            else:
                items.append((f"g{g}", "owner_name", " ".join(rnd.sample(["ANA", "LUNA", "REYES", "CRUZ"], rnd.randint(2, 4))), doc, 0.9))
    got = ranks(fa.cross_check(facts_of(spark, items)).collect())
    want = all_pairs(spark, items)
    assert {k: got[k] for k in want} == want and set(want.values()) >= {1, 2}


def test_one_group_of_a_hundred_thousand_addresses(spark):
    """All of them resemble each other; then one of them doesn't."""
    n = 100_000
    base = "BLOCK 5 LOT 7 RIZAL STREET SAN ISIDRO VILLAGE PASIG METRO MANILA LUZON"
    rows = spark.range(n).select(
        F.lit("a").alias("account_id"), F.lit("address").alias("attribute"), F.lit(1).alias("rank"),
        F.col("id").cast("int").alias("doc_pos"), F.lit(0).alias("seq"),
        F.concat(F.lit(base + " "), F.translate(F.col("id").cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit("Z ANNEX")).alias("value"),
        F.col("id").cast("string").alias("doc_id"), F.lit("T").alias("file_name"), F.lit("T").alias("document_type"),
        F.lit("f").alias("source_field"), F.lit("EXACT").alias("grounding"), F.lit(0.9).alias("confidence"),
        F.lit(None).cast("string").alias("normalized"))
    [r] = fa.cross_check(rows).collect()
    assert (r.status, r.n_values, r.n_forms) == ("LIKELY_CONSISTENT", n, n)
    other = spark.createDataFrame([("a", "address", 1, n, 0, "RIZAL SAN PASIG ANNEX BZ TOWER", "x", "T", "T", "f", "EXACT", 0.9, None)], FACTS)
    [r] = fa.cross_check(rows.union(other)).collect()
    assert r.status in ("CONFLICT", "DIFFERS")
