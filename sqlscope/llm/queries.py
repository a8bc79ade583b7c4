"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sqlscope.llm import ann, chat, decontaminate, langid, mixing, ngram_join, sharding, tokens, toxicity, warc
from sqlscope.llm.common import materialize, ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archived(_table(spark, sf_dir, "pages"), min_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.tokenized(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3, folds=4, held=2)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), shards=24).drop("text_hash")


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(chat.paired(_table(spark, sf_dir, "conversations")))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"), folds=3, held=1)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(mixing.sized(_table(spark, sf_dir, "documents")), "mix-sizes")
    return mixing.mix(rows, weights=(1, 2, 3), max_repeat=3).select("doc_id", "size", "source_size", "target", "taken")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_table(spark, sf_dir, "documents"), size=4, percent=85)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_decontaminate, op2_warc, op3_tokens, op4_toxicity, op5_sharding, op6_preferences, op7_language, op8_mixing, op9_ngram_join, op10_ann)
    return {f.__name__: f for f in every}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS run
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS run
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hit AS (SELECT doc_id, s, k, item_id FROM dw JOIN bw USING (k, run)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM hit)) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN listed ON listed.doc_id = d.doc_id
"""

# base32 of a SHA-1: 32 groups of 5 bits, from the 40 hex digits taken 5 at a time (20 bits, 4 groups)
OP2 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
m AS (SELECT x, max(page_id) AS last FROM h GROUP BY x),
d AS (SELECT DISTINCT x, array_to_string(list_transform(range(0, 32), lambda g:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(g // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - g % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS digest FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM h JOIN m USING (x) JOIN d USING (x)
"""

OP6 = """
WITH t AS (SELECT (conv_id - (conv_id % 2 + 2) % 2) // 2 AS pair_id, CASE WHEN conv_id % 2 <> 0 THEN 'r' ELSE 'c' END AS side,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT * FROM t WHERE side = 'c'), r AS (SELECT * FROM t WHERE side = 'r'),
same AS (SELECT c.pair_id, c.i, c.role = r.role AND c.text = r.text AS eq FROM c JOIN r ON c.pair_id = r.pair_id AND c.i = r.i),
pre AS (SELECT p.pair_id, CAST(coalesce(min(CASE WHEN NOT eq THEN same.i END) - 1, count(same.i)) AS BIGINT) AS n_prefix
        FROM (SELECT DISTINCT pair_id FROM t) p LEFT JOIN same ON same.pair_id = p.pair_id GROUP BY p.pair_id),
x AS (SELECT t.*, n_prefix, '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS body FROM t JOIN pre USING (pair_id)),
y AS (SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x WHERE i > n_prefix)
SELECT pre.pair_id, pre.n_prefix,
  coalesce((SELECT string_agg(body, '' ORDER BY i) FROM x WHERE x.pair_id = pre.pair_id AND side = 'c' AND i <= x.n_prefix), '') AS prompt,
  coalesce((SELECT string_agg(body, '' ORDER BY i) FROM y WHERE y.pair_id = pre.pair_id AND side = 'c'), '') AS chosen,
  coalesce((SELECT string_agg(CAST(before + length(head) AS BIGINT) || '-' || CAST(before + length(head) + length(text) AS BIGINT), ',' ORDER BY i) FROM y WHERE y.pair_id = pre.pair_id AND side = 'c' AND role = 'assistant'), '') AS chosen_mask,
  coalesce((SELECT string_agg(body, '' ORDER BY i) FROM y WHERE y.pair_id = pre.pair_id AND side = 'r'), '') AS rejected,
  coalesce((SELECT string_agg(CAST(before + length(head) AS BIGINT) || '-' || CAST(before + length(head) + length(text) AS BIGINT), ',' ORDER BY i) FROM y WHERE y.pair_id = pre.pair_id AND side = 'r' AND role = 'assistant'), '') AS rejected_mask
FROM pre
"""

OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                            (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CAST(i % 3 + 1 AS BIGINT) AS weight FROM s),
fill(step, capped) AS (
  SELECT 0, []::BIGINT[]
  UNION ALL
  SELECT step + 1, list_concat(capped, (SELECT list(i) FROM w WHERE NOT list_contains(capped, i) AND 3 * ss * (SELECT sum(weight) FROM w WHERE NOT list_contains(capped, i))
         <= weight * ((SELECT sum(ss) FROM w) - (SELECT coalesce(sum(3 * ss), 0) FROM w WHERE list_contains(capped, i)))))
  FROM fill WHERE (SELECT count(*) FROM w WHERE NOT list_contains(capped, i) AND 3 * ss * (SELECT sum(weight) FROM w WHERE NOT list_contains(capped, i))
         <= weight * ((SELECT sum(ss) FROM w) - (SELECT coalesce(sum(3 * ss), 0) FROM w WHERE list_contains(capped, i)))) > 0),
done AS (SELECT capped FROM fill ORDER BY step DESC LIMIT 1),
goal AS (SELECT source, ss, CASE WHEN list_contains(capped, i) THEN CAST(3 * ss AS DOUBLE) ELSE
           CAST(weight * CAST((SELECT sum(ss) FROM w) - (SELECT coalesce(sum(3 * ss), 0) FROM w, done WHERE list_contains(capped, i)) AS BIGINT) AS DOUBLE)
           / CAST((SELECT sum(weight) FROM w, done WHERE NOT list_contains(capped, i)) AS DOUBLE) END AS target FROM w, done),
e AS (SELECT *, CAST(floor(sqrt(size)) AS BIGINT) AS m FROM d),
a AS (SELECT source, m, CAST(sum(size) AS BIGINT) AS words FROM e WHERE size > 0 GROUP BY source, m),
z AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS whole FROM goal),
h AS (SELECT a.*, target - CAST(whole AS BIGINT) * ss AS rest, CAST(coalesce((SELECT sum(x.words) FROM a x WHERE x.source IS NOT DISTINCT FROM a.source AND x.m > a.m), 0) AS BIGINT) AS clipped,
             CAST((SELECT sum(x.m * x.words) FROM a x WHERE x.source IS NOT DISTINCT FROM a.source AND x.m <= a.m) AS BIGINT) AS below
      FROM a JOIN z ON a.source IS NOT DISTINCT FROM z.source),
i AS (SELECT *, (rest - clipped) / CAST(below AS DOUBLE) AS c FROM h),
r AS (SELECT source, max_by(c, m) AS c FROM i WHERE c * m <= 1 GROUP BY source),
t AS (SELECT e.*, ss, target, CASE WHEN size > 0 THEN z.whole + coalesce(least(c * m, 1.0::DOUBLE), 1.0::DOUBLE) ELSE 0 END AS expected
      FROM e JOIN z ON e.source IS NOT DISTINCT FROM z.source LEFT JOIN r ON e.source IS NOT DISTINCT FROM r.source),
f AS (SELECT *, floor(expected) AS whole, expected - floor(expected) AS p FROM t),
l AS (SELECT source, max(target) - sum(CAST(whole AS BIGINT) * size) AS left_words FROM f GROUP BY source),
k AS (SELECT f.*, left_words, (u / (1 - u)) / (p / nullif(1 - p, 0)) AS key FROM f JOIN l ON f.source IS NOT DISTINCT FROM l.source),
o AS (SELECT *, coalesce(sum(size) FILTER (WHERE p > 0) OVER (PARTITION BY source ORDER BY p = 0, key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, size, ss AS source_size, target, CAST((whole + CASE WHEN p > 0 AND before + size / 2.0 <= left_words THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM o
"""

OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach.other) AS component_id
FROM d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op2_warc": OP2, "op6_preferences": OP6, "op8_mixing": OP8, "op9_ngram_join": OP9}
