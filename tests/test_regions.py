"""Where the window search looks: long values, long texts, and how little of them it is given."""

import random

from pyspark.sql import functions as F

from attesta.functions.similarity import candidate_regions, closest_window, window_search


def changed(rnd, needle, edits):
    needle = list(needle)
    for _ in range(edits):
        k = rnd.randrange(len(needle))
        needle[k:k + rnd.randint(0, 1)] = rnd.choice([[], ["Z"], ["4"]])
    return "".join(needle)


def test_regions_of_long_values_and_texts(spark):
    """Values of several pieces and texts of several stretches, hits at their ends, other rows null or too short."""
    rnd, rows = random.Random(5), [(None, "ABCD"), ("ABCD", None), ("ABCDE", "ABCD"), ("ABCD", "ABXD")]
    for _ in range(150):
        letters = rnd.choice(["AB", "ABCDEFGH12", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
        text = "".join(rnd.choice(letters) for _ in range(rnd.choice([150, 256, 257, 700])))
        n = rnd.choice([5, 59, 60, 61, 64, 90, 130])
        at = rnd.choice([0, rnd.randrange(len(text) - n), len(text) - n])
        rows.append((changed(rnd, text[at:at + n], rnd.choice([1, 3, n // 9])), text))
    df = spark.createDataFrame(rows, "needle string, text string").coalesce(1).withColumn("parts", candidate_regions("needle", "text", 0.85))
    got = df.withColumn("found", window_search(0.85)("needle", "parts", F.size("parts"))).collect()
    assert len(got) == len(rows) and sum(r["found"]["ratio"] is not None for r in got) > 80
    for r in got:
        want = None if r["needle"] is None or r["text"] is None else closest_window(r["needle"], r["text"], 0.85)
        assert (None if r["found"]["ratio"] is None else (r["found"]["ratio"], r["found"]["matched"])) == want, (r["needle"], r["text"])


def test_regions_are_a_small_part_of_a_text(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choices("ABCDEFGH12", k=20_000)) for _ in range(20)]
    rows = [(changed(rnd, t[500:525], 1), t) for t in texts]
    df = spark.createDataFrame(rows, "needle string, text string").withColumn("parts", candidate_regions("needle", "text", 0.85))
    for r in df.collect():
        assert any(p["start"] <= 500 and p["start"] + len(p["part"]) >= 525 for p in r["parts"])
        assert sum(len(p["part"]) for p in r["parts"]) < 200
