"""The operators over the driver tables, with production parameters, and their SQL where SQL can tell."""

import public_tokenizers
from pyspark.sql import functions as F

from . import context_mixing, decontaminate, embedding_whitening, html_density, language_id, order_minhash, packing, projection_forest, quality_lines, suffix_dedup, token_alignment, token_counts, toxicity
from .common import fold, prepared, read

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def add(run):
        QUERIES[name] = lambda spark, sf_dir: run(prepared(spark), sf_dir)
        if oracle:
            ORACLES[name] = oracle
        return run
    return add


QUALITY_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                   "n_lines", "n_punctuation", "n_navigation", "n_boilerplate", "lost_chars")

OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT r, i, w, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3 FROM p WINDOW s AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
h AS (SELECT DISTINCT r, i + k AS i FROM c, (VALUES (0), (1), (2)) v(k) WHERE n >= 2),
rep AS (SELECT r, count(*) AS n_repeat_words FROM h GROUP BY r),
ln AS (SELECT r, line, count(*) AS copies FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
m AS (SELECT r, line, copies,
        length(line) - length(replace(line, ' ', '')) + 1 AS nw,
        length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS sym,
        length(line) - length(replace(line, '!', '')) AS bang,
        length(line) - length(regexp_replace(line, '[|»›•·]', '', 'g')) AS sep FROM ln),
j AS (SELECT *, (sym * 100 >= nw * 30 OR (nw >= 10 AND bang * 100 >= nw * 50)) AS punctuation,
        ((sep >= 3 AND sep * 100 >= nw * 25) OR (nw <= 3 AND NOT regexp_matches(line,
          '[.!?…:;。！？؟।"''”’»)\]][\t\n\v\f\r ]*$'))) AS navigation,
        (len(regexp_extract_all(lower(line), '__BOILERPLATE__')) * 300 >= greatest(length(line), 1)) AS boilerplate FROM m),
l AS (SELECT r, sum(copies) AS n_lines, sum(copies) - count(*) AS n_dup_lines,
        sum(copies * length(line)) AS all_chars,
        sum(CASE WHEN punctuation THEN copies ELSE 0 END) AS n_punctuation,
        sum(CASE WHEN navigation THEN copies ELSE 0 END) AS n_navigation,
        sum(CASE WHEN boilerplate THEN copies ELSE 0 END) AS n_boilerplate,
        sum(CASE WHEN punctuation OR navigation OR boilerplate THEN copies * length(line) ELSE 0 END) AS lost
      FROM j GROUP BY r),
q AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_punctuation, 0)::BIGINT AS n_punctuation,
        coalesce(n_navigation, 0)::BIGINT AS n_navigation, coalesce(n_boilerplate, 0)::BIGINT AS n_boilerplate,
        coalesce(lost, 0)::BIGINT AS lost_chars, coalesce(all_chars, 0) AS all_chars
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN l USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 40 * all_chars) AS kept,
  n_lines, n_punctuation, n_navigation, n_boilerplate, lost_chars FROM q
""".replace("__BOILERPLATE__", quality_lines.BOILERPLATE)


@register("op1_quality_lines", OP1_SQL)
def op1(spark, sf_dir):
    judged = quality_lines.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in QUALITY_COLUMNS])


@register("op2_html_extraction")
def op2(spark, sf_dir):
    pages = html_density.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "extracted.text", "extracted.n_chars")


@register("op3_packing")
def op3(spark, sf_dir):
    return packing.packed(read(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item_id, least(len(ws), 13) AS k, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i, ws
       FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS s FROM bw),
sizes AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, k, unnest(range(1, len(ws) - k + 2)) AS i, ws FROM d, sizes WHERE len(ws) >= k),
occ AS (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS s FROM dw),
hit AS (SELECT r, occ.k, i, item_id FROM occ JOIN win ON occ.k = win.k AND occ.s = win.s),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(ws), 0)) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""


@register("op5_decontamination", OP5_SQL)
def op5(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, read(spark, sf_dir, "benchmark"))
    return decontaminate.verdict(found).drop("text")


@register("op6_token_counts")
def op6(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


@register("op7_near_duplicates")
def op7(spark, sf_dir):
    return order_minhash.near_duplicates(read(spark, sf_dir, "documents"))


@register("op4_suffix_dedup")
def op4(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.digest(suffix_dedup.find_repeats(docs))


@register("op10_toxicity")
def op10(spark, sf_dir):
    held_out = fold(3, 1)
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held_out, ~held_out)


@register("op8_language_id")
def op8(spark, sf_dir):
    held_out = fold(3, 1)
    return language_id.identify(read(spark, sf_dir, "documents"), held_out, ~held_out)


@register("op9_lm_scoring")
def op9(spark, sf_dir):
    return context_mixing.score(read(spark, sf_dir, "documents"), fold(10, 0))


@register("op12_token_alignment")
def op12(spark, sf_dir):
    return token_alignment.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                 public_tokenizers.path("piece_bpe_32k.model"))


@register("op11_embedding_whitening")
def op11(spark, sf_dir):
    return embedding_whitening.whiten(read(spark, sf_dir, "embeddings"))


@register("op13_embedding_near_dedup")
def op13(spark, sf_dir):
    return projection_forest.link(read(spark, sf_dir, "embeddings"))
