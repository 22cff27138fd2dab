"""Printed values: dates, tax numbers, names, codes, phones, masking, matching."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from attesta.functions import matching as m
from attesta.functions import text as t
from attesta.functions.similarity import closest_window
from attesta.operators import facts as fa
from attesta.operators.measure import mask_sensitive


def values(spark, expr, *items):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_dates(spark):
    got = values(spark, t.parse_date("x"), "11 May 2021", "August 25, 2021", "1/22/2025",
                 "22/1/2025", "2025-01-22", "22nd day of January 2025", "31 of December 2026",
                 "Sept 3, 2020", "2/30/2020", "13/13/2020", "some day", "", None)
    assert got == [date(2021, 5, 11), date(2021, 8, 25), date(2025, 1, 22), date(2025, 1, 22),
                   date(2025, 1, 22), date(2025, 1, 22), date(2026, 12, 31), date(2020, 9, 3),
                   None, None, None, None, None]


def test_typed_normal_forms(spark):
    df = spark.createDataFrame([
        ("tin", "234-567-890-001", "234-567-890-00001"), ("tin", "234567890", "234-567-890-00000"),
        ("tin", "12345", None), ("money", "PHP 1,234.5", "1234.50"), ("money", "₱", None),
        ("money", "1.2.3", None), ("code", "No. 0420", "0420"), ("code", "#123", "123"),
        ("code", "NORTH-1", "NORTH-1"), ("choice", " Head  Office ", "HEAD OFFICE"),
        ("email", " A@B.Ph ", "a@b.ph"), ("name", "Niño & Sons, Inc.", "NINO & SONS INC"),
        ("date", "30 June 2028", "2028-06-30"), ("date", "June", None), ("text", "  ", None),
        ("other", " x ", "x")], "kind string, x string, want string")
    for r in df.select("x", "want", t.normalize("kind", "x").alias("got")).collect():
        assert r.got == r.want, r


def test_names(spark):
    assert values(spark, t.business_key("x"), "BAKER'S MEAT SHOP", "Baker Meat Shop",
                  "CAFE VERDE CORP.", "Cafe Verde") == [
        "BAKER MEAT SHOP", "BAKER MEAT SHOP", "CAFE VERDE", "CAFE VERDE"]
    assert values(spark, t.name_key("x"), "REYES, ANA", "Ana Reyes") == ["ANA REYES"] * 2
    assert values(spark, t.natural_person_name("x"), "REYES, ANA M", "Ana Reyes") == [
        "ANA M REYES", "ANA REYES"]


def test_numbers_conflict(spark):
    df = spark.createDataFrame([
        ("BLOCK 21 LOT 3", "BLOCK 23 LOT 3", True), ("BLOCK 21 LOT 3", "BLOCK 21", False),
        ("no numbers", "12", False), ("1 a 2 b 3", "1 b 3", False), ("a1 b2", "b2 a1", True),
        ("21 23", "2123", False), ("1a2", "1b12", True)], "a string, b string, want boolean")
    for r in df.select("a", "b", "want", t.numbers_conflict("a", "b").alias("got")).collect():
        assert r.got == r.want, r


PAIRS = [
    ("person", "REYES, ANA", "ANA REYES", "SAME"),
    ("person", "ANA M. REYES", "ANA REYES", "SAME"),
    ("person", "ANA REYES", "REYES, ANA LUNA CRUZ", "LIKELY_SAME"),
    ("person", "ANA REYES JR", "ANA REYES", "SAME"),
    ("person", "ANA REYES", "BEN REYES", "DIFFERENT"),
    ("person", "A", "ANA REYES", None), ("person", None, "ANA REYES", None),
    ("business", "BAKER'S MEAT SHOP", "BAKER MEAT SHOP", "SAME"),
    ("business", "SOL BISTRO", "SOL BISTRO AND GRILL", "LIKELY_SAME"),
    ("business", "MARIKEN GENERAL MERCHANDISE", "MARIKIKEN GENERAL MERCHANDISE",
     "LIKELY_SAME"),
    ("business", "SHOP NUMBER 11 GENERAL", "SHOP NUMBER 12 GENERAL", "DIFFERENT"),
    ("business", "ALPHA", "OMEGA", "DIFFERENT"),
    ("address", "BLK 21 LOT 3 SAN JOSE", "BLOCK 21 LOT 3 BRGY SAN JOSE, CITY OF PASIG", "SAME"),
    ("address", "BLK 21 LOT 3", "BLK 23 LOT 3", "DIFFERENT"),
    ("address", "5 Rizal St, Metro Manila", "5 RIZAL STREET, NATIONAL CAPITAL REGION", "SAME"),
    ("address", "L2 B3 P1 SAN ISIDRO", "LOT 2 BLOCK 3 PHASE 1 SAN ISIDRO", "SAME"),
    ("address", "5 RIZAL ST POBLACION TAGUIG", "5 RIZAL ST POBLACION PASIG", "LIKELY_SAME"),
    ("address", "MAIN ROAD", "OTHER PLACE", "DIFFERENT"),
    ("tin", "234-567-890-00001", "234567890", "SAME"),
    ("tin_branch", "234-567-890-00001", "234567890", "DIFFERENT"),
    ("tin_branch", "234-567-890-00000", "234567890000", "SAME"),
    ("tin", "234567891", "234567890", "DIFFERENT"), ("tin", "1234", "234567890", None),
    ("email", "A@x.ph ", "a@x.ph", "SAME"), ("phone", "0917 123 4567", "+639171234567", "SAME"),
]


def test_match_pairs(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)],
                               "i int, kind string, a string, b string, want string")
    for r in fa.match_pairs(df, F.col("kind")).collect():
        assert r.verdict == r.want, r


def test_compare_values(spark):
    df = spark.createDataFrame([
        ("date", "11 May 2021", "5/11/2021", "SAME"), ("date", "x", "x", "DIFFERENT"),
        ("tin", "234567890", "234-567-890-00000", "SAME"), ("code", "No. 12", "12", "SAME"),
        ("choice", "head office", "HEAD OFFICE", "SAME"), ("name", "REYES, ANA", "ANA REYES",
                                                          "SAME"),
        ("address", "5 Rizal Street, Poblacion, Taguig", "5 Rizal Street Poblacion Taguij",
         "MINOR_DIFF"),
        ("address", "BLOCK 21", "BLOCK 23", "DIFFERENT"), ("text", "", "x", None),
        ("text", "abc", "xyz", "DIFFERENT")], "kind string, a string, b string, want string")
    for r in fa.compare_values(df).collect():
        assert r.verdict == r.want, r


def test_phones_mail_terms(spark):
    assert values(spark, t.ph_mobile("x"), "0917 123 4567", "+63 917-123-4567", "9171234567",
                  "639171234567", "02 8123 4567", "0917 123 4567 x", None) == [
        *["+63 917 123 4567"] * 4, None, None, None]
    assert values(spark, t.email_ok("x"), "a.b@c.ph", "a@b", "a b@c.ph", None) == [
        True, False, False, False]
    assert values(spark, t.is_cod("x"), "COD", "Cash-On-Delivery", "C.O.D", "CODE", None) == [
        True, True, False, False, False]
    assert values(spark, t.restore_phone_zero("x"), "9171234567", "8123 4567") == [
        "09171234567", "8123 4567"]


def test_mask(spark):
    df = spark.createDataFrame([
        ("TIN 234-567-890-00012 and 234567890", "TIN ***012 and ***890"),
        ("id 1234567890123456", "id 1234567890123456"),
        ('{"access_token": "abc123", "x": 1}', '{"access_token": "***", "x": 1}'),
        ("Crm-oauthtoken 1.2.3 sent", "Crm-oauthtoken *** sent"),
        ("api_key=q1w2&b=1", "api_key=***&b=1")], "x string, want string")
    for r in mask_sensitive(df, ["x"]).collect():
        assert r.x == r.want


def test_humanize_and_text(spark):
    assert values(spark, t.humanize("x"), "DTI_BN_CERT expired 2025-12-31 -> owner_name",
                  "Tax_Identification_Number_TIN") == [
        "DTI certificate expired 31 Dec 2025: owner name", "TIN"]
    assert values(spark, t.text_line("x", 10), "a  b", "abcdefghijkl", "") == [
        "a b", "abcdefghi…", None]
    assert values(spark, t.text_lines("x"), "a   b\n\n\n\n  c  d ") == ["a b\n\n  c d"]


@pytest.mark.parametrize("needle, text, want", [
    ("ACMETRADING", "XXACMETRADIMGXX", "ACMETRADIMG"),
    ("2901350", "NO2901359X", "290135"), ("ABCDE", "ZZZZZZZZ", None), ("ABCD", "AB", None)])
def test_closest_window(needle, text, want):
    got = closest_window(needle, text, 0.85)
    assert (got[1] if got else None) == want


def test_closest_window_equals_plain_search():
    import random
    from difflib import SequenceMatcher
    rnd = random.Random(5)
    for _ in range(60):
        text = "".join(rnd.choice("ABC12") for _ in range(rnd.randint(5, 60)))
        needle = "".join(rnd.choice("ABC12") for _ in range(rnd.randint(4, 9)))
        best, found = 0.0, None
        if len(text) >= len(needle):
            for size in (len(needle) - 1, len(needle), len(needle) + 1):
                for i in range(len(text) - size + 1):
                    r = SequenceMatcher(None, text[i:i + size], needle, autojunk=False).ratio()
                    if r > best:
                        best, found = r, text[i:i + size]
        want = (best, found) if best >= 0.85 else None
        assert closest_window(needle, text, 0.85) == want


def test_search_in_regions_equals_search_in_the_whole_text(spark):
    """Pieces of the value lead to every window that can pass: letters changed, dropped, added, repeated."""
    import random
    from attesta.functions.similarity import candidate_regions, window_search
    rnd, rows = random.Random(17), []
    for _ in range(700):
        letters = rnd.choice(["AB", "ABCDEFGH12", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
        text = "".join(rnd.choice(letters) for _ in range(rnd.choice([3, 8, 60, 400])))
        at, n = rnd.randrange(len(text)), rnd.choice([4, 5, 9, 20, 60])
        needle = list(text[at:at + n])
        for _ in range(rnd.choice([0, 1, 2, 4])):
            k = rnd.randrange(len(needle) + 1)
            needle[k:k + rnd.randint(0, 1)] = rnd.choice([[], ["Z"], [rnd.choice(letters)]])
        rows.append(("".join(needle) or "A", text))
    rows += [("AAAA", "AAAAAAAA"), ("ABAB", "BABABABABA"), ("AAAB" * 5, "A" * 50)]
    for floor in (0.85, 0.6):
        df = spark.createDataFrame(rows, "needle string, text string").withColumn("parts", candidate_regions("needle", "text", floor))
        got = df.withColumn("found", window_search(floor)("needle", "parts", F.size("parts"))).collect()
        for r in got:
            want = closest_window(r["needle"], r["text"], floor)
            assert (None if r["found"]["ratio"] is None else (r["found"]["ratio"], r["found"]["matched"])) == want, (r["needle"], r["text"])
    held = [sum(len(p["part"]) for p in r["parts"] or ()) for r in got if len(r["text"]) == 400 and len(r["needle"]) > 15]
    assert held
