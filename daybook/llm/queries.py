"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from daybook.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Domains: the language of a document, or "junk" where its quality label is 0.
MIX_WEIGHTS = {"en": 0.45, "fr": 0.17, "de": 0.17, "es": 0.13, "junk": 0.08}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of every labelled document."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return labels.join(docs, "doc_id").select("doc_id", F.when(F.col("quality") == 0, "junk").otherwise(F.col("lang")).alias("domain"))


def op1_soft_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from daybook.llm.mixing import soft_mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = soft_mix(docs, labelled_domains(spark, sf_dir), MIX_WEIGHTS)
    return mixed.select("doc_id", "n_tokens", "domain", *[F.col("p")[d].alias(f"p_{d}") for d in MIX_WEIGHTS], "rate", "miss")


def op2_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from daybook.llm.fingerprint import fingerprint

    return fingerprint(table(spark, sf_dir, "documents"))


def derived_edits() -> Column:
    """Three edits of every document, from its own text: one replaced passage, one cut, one appended."""
    n = F.char_length(F.coalesce(F.col("text"), F.lit("")))
    edit = lambda start, length, text: F.struct(start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"), text.alias("replacement"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.array(edit(F.floor(n / 3), 40, F.substring(text, 1, 60)), edit(F.floor(2 * n / 3), 25, F.lit("")), edit(n + 1000, 0, F.concat(F.lit(" "), F.substring(text, 5, 30))))


def op3_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from daybook.llm.token_counts import count_edited

    return count_edited(table(spark, sf_dir, "documents"), derived_edits())


def op4_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from daybook.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from daybook.llm.line_dedup import line_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup(docs).select("doc_id", "source", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op6_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from daybook.llm.sentencepiece_sampling import sample_segmentations

    return sample_segmentations(table(spark, sf_dir, "documents"))


def op7_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from daybook.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from daybook.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op9_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from daybook.llm.lm_scoring import lm_score

    return lm_score(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from daybook.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from daybook.llm.ranked_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from daybook.llm.vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from daybook.llm.top_products import top_products

    return top_products(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH lines AS (
  SELECT doc_id, source, pos - 1 AS pos, line FROM (
    SELECT doc_id, coalesce(source, '') AS source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
flagged AS (SELECT line, min(struct_pack(d := doc_id, p := pos)) AS f FROM lines WHERE length(line) >= 20
            GROUP BY line HAVING count(DISTINCT source) >= 5),
told AS (SELECT l.*, f.line IS NOT NULL AND NOT (f.f.d = l.doc_id AND f.f.p = l.pos) AS gone
         FROM lines l LEFT JOIN flagged f ON l.line = f.line),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
                coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS clean FROM told GROUP BY doc_id)
SELECT k.doc_id AS doc_id, d.source AS source, n_lines AS n_lines, n_removed AS n_removed,
       CAST(length(clean) AS BIGINT) AS n_chars_left, md5(clean) AS text_md5
FROM kept k JOIN documents d ON k.doc_id = d.doc_id
"""

OP7_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id AS doc_id, g.keep_id AS keep_id, g.group_size AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


def _op8_sql() -> str:
    """The licence scan over the same phrases: word pairs, diagonals, runs of diagonals, and the words along them."""
    from daybook.llm.license_scan import BASE, COVER, DRIFT, NOTICES

    phrases = [(k, label, phrase in BASE, phrase) for k, (phrase, label) in enumerate([*BASE.items(), *NOTICES.items()])]
    values = ", ".join(f"({k}, '{label}', {str(base).lower()}, string_split('{phrase}', ' '))" for k, label, base, phrase in phrases)
    return f"""
WITH p(template, label, is_base, phrase) AS (VALUES {values}),
tp AS (SELECT template, k, phrase[k + 1] AS a, phrase[k + 2] AS b FROM (SELECT *, unnest(range(0, len(phrase) - 1)) AS k FROM p)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, pos, w[pos + 1] AS a, w[pos + 2] AS b FROM (SELECT *, unnest(range(0, len(w) - 1)) AS pos FROM d)),
h AS (SELECT DISTINCT doc_id, template, k, pos, pos - k AS g FROM dw JOIN tp USING (a, b)),
v AS (SELECT doc_id, template, g, count(DISTINCT k) AS votes, min(pos) AS first FROM h GROUP BY ALL),
r AS (SELECT *, coalesce(sum(apart) OVER (PARTITION BY doc_id, template ORDER BY g ROWS UNBOUNDED PRECEDING), 0) AS run
      FROM (SELECT *, CASE WHEN g - lag(g) OVER (PARTITION BY doc_id, template ORDER BY g) > {DRIFT} THEN 1 ELSE 0 END AS apart FROM v)),
base AS (SELECT doc_id, label, g FROM r JOIN p USING (template) WHERE is_base AND votes = len(phrase) - 1),
m AS (SELECT r.doc_id, r.template, r.run, count(DISTINCT h.k) AS covered, min(r.first) AS first, list(DISTINCT r.g) AS along FROM r JOIN h ON h.doc_id = r.doc_id AND h.template = r.template AND h.g = r.g GROUP BY ALL),
notice AS (SELECT m.doc_id, label, first, CAST(covered AS DOUBLE) / (len(phrase) - 1) AS cover FROM m JOIN p USING (template) JOIN d ON d.doc_id = m.doc_id
  WHERE NOT is_base AND covered >= {COVER} * (len(phrase) - 1) AND len(list_filter(range(0, len(phrase)), lambda i: len(list_filter(along, lambda x: x + i >= 0 AND w[x + i + 1] = phrase[i + 1])) > 0)) >= {COVER} * len(phrase)),
b AS (SELECT doc_id, count(*) AS n, min(g) AS lo, max(g) AS hi, list(DISTINCT label) AS labels FROM base GROUP BY doc_id),
n AS (SELECT doc_id, list(DISTINCT label) AS labels, max(cover) AS cover, array_to_string(list_sort(list(label || '@' || first || ':' || CAST(round(cover, 3) AS VARCHAR))), ' ') AS spans FROM notice GROUP BY doc_id)
SELECT d.doc_id AS doc_id, len(w) AS n_words, coalesce(b.n, 0) AS n_base, lo AS first_word, hi AS last_word, array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(n.labels, [])))), ',') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(n.cover, 0.0::DOUBLE) END AS score, coalesce(spans, '') AS spans
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark WHERE item_id IS NOT NULL),
a AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS places FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t), a),
s AS (SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // places)))) AS BIGINT) AS score FROM i JOIN f USING (t) JOIN p USING (t), a GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER w AS INT) AS rank, doc_id, score FROM s WHERE score > 0 WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 50
"""


def _op12_sql() -> str:
    """Six rounds, each by comparing every part with every entry."""
    rounds = 6
    near = lambda k: f"""a{k} AS MATERIALIZED (SELECT r, part, x, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), e := e)) AS b FROM p JOIN c{k} USING (part) GROUP BY r, part, x)"""
    moved = lambda k: f"""c{k + 1} AS MATERIALIZED (SELECT c.part AS part, c.e AS e, coalesce(m.y, c.y) AS y FROM c{k} c LEFT JOIN (
  SELECT part, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS y FROM (SELECT part, b.e AS e, i, sum(v) AS s, count(*) AS n FROM (SELECT part, b, unnest(x) AS v, unnest(range(0, len(x))) AS i FROM a{k}) GROUP BY ALL) GROUP BY part, e) m ON m.part = c.part AND m.e = c.e)"""  # noqa: E731
    steps = ",\n".join(f"{near(k)},\n{moved(k)}" for k in range(rounds))
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT r, CAST(j AS INT) AS part, list_slice(v, j * len(v) // 8 + 1, (j + 1) * len(v) // 8) AS x FROM k, range(0, 8) g(j)),
c0 AS MATERIALIZED (SELECT part, r AS e, x AS y FROM p WHERE r < 16),
{steps},
{near(rounds)},
z AS (SELECT r, string_agg(lpad(lower(to_hex(b.e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, e)) AS s FROM c{rounds})
SELECT k.vec_id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.s AS codebooks_sha256 FROM k JOIN z USING (r), h"""


OP13_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


def queries() -> dict[str, Query]:
    operators = (op1_soft_mix, op2_improbable_features, op3_edit_aware_counts, op4_toxicity_cnn, op5_line_dedup, op6_gumbel_segmentations, op7_grace_dedup, op8_license_scan, op9_attention_lm, op10_simhash, op11_ranked_search, op12_vector_codes, op13_top_products)
    return {f.__name__: f for f in operators} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5_SQL, "op7_grace_dedup": OP7_SQL, "op8_license_scan": _op8_sql(), "op11_ranked_search": OP11_SQL, "op12_vector_codes": _op12_sql(), "op13_top_products": OP13_SQL}
