"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfweave.llm import (
    chat_format, decontamination, filter_audit, hard_negatives, html_extraction, line_dedup, mixing, quality, quality_rules,
    sharding, simhash, topk, toxicity,
)
from shelfweave.llm.text import held_out
from shelfweave.plans.catalog import Entry

ENTRIES: dict[str, Entry] = {}


def _query(name: str, sql: str | None = None):
    def register(build):
        ENTRIES[name] = Entry(build, sql)
        return build
    return register


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s + 1:s + least(13, len(w))], ' ') AS t
  FROM b, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS u(s) WHERE len(w) > 0),
hit AS (SELECT DISTINCT dw.doc_id, dw.s, dw.n, bw.item_id
  FROM (SELECT doc_id, s, n, array_to_string(w[s + 1:s + n], ' ') AS t
        FROM d, (SELECT DISTINCT n FROM bw) l, unnest(range(0, len(w) - n + 1)) AS u(s)) dw
  JOIN bw ON bw.n = dw.n AND bw.t = dw.t),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + n)) AS u(p) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""


@_query("op1_benchmark_decontamination", DECONTAMINATION_SQL)
def op1_benchmark_decontamination(spark, sf_dir):
    """Every document against every benchmark item, windows of 13 words."""
    found = decontamination.find_contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


@_query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark, sf_dir):
    """Every document: 3-word shingles, links up to 3 bits, components."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@_query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    """Every document, scored by the model learned from the rows that are not held out, with its offending sentences."""
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.train(documents, _table(spark, sf_dir, "labels"))
    read = documents.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.read(F.col("text"), model).alias("read"))
    return read.select(
        "doc_id", "held_out", "read.score", (F.col("read.score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "read.offending")


@_query("op10_quality_classifier")
def op10_quality_classifier(spark, sf_dir):
    """Every document, scored by the ranking learned from the rows that are not held out."""
    documents = _table(spark, sf_dir, "documents")
    model = quality.train(documents, _table(spark, sf_dir, "labels"))
    score = quality.quality(F.col("text"), model)
    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@_query("op2_html_extraction")
def op2_html_extraction(spark, sf_dir):
    """The main text of every page."""
    pages = html_extraction.extract_pages(_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


# escaping adds one character per < and [; a turn adds the 23 of its control strings
CHAT_SQL = """
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, coalesce(role, '') || chr(10) || text || chr(10) AS said,
    23 + length(coalesce(role, '<|none|>')) + length(text) + len(regexp_extract_all(coalesce(role, '') || text, '[<[]'))
    AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(said, '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@_query("op3_chat_formatting", CHAT_SQL)
def op3_chat_formatting(spark, sf_dir):
    """Every conversation and one that quotes control strings, formatted and read back."""
    quoted = spark.createDataFrame(
        [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))],
        "conv_id LONG, turn LONG, role STRING, text STRING")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(quoted)
    return chat_format.read_back(chat_format.format_chats(turns))


LINE_DEDUP_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, p, l[p + 1:p + 3] AS win FROM d, unnest(range(0, len(l) - 2)) AS u(p)),
later AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS n FROM w
  WHERE len(list_filter(win, lambda x: trim(x, ' ') <> '')) > 0) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, q FROM later, unnest(range(p, p + 3)) AS u(q)),
kept AS (SELECT d.doc_id, string_agg(l[i + 1], chr(10) ORDER BY i) AS text
  FROM d, unnest(range(0, len(l))) AS u(i) ANTI JOIN gone ON gone.doc_id = d.doc_id AND gone.q = i GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1)
SELECT d.doc_id, CASE WHEN n_removed IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text,
  CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@_query("op5_line_dedup", LINE_DEDUP_SQL)
def op5_line_dedup(spark, sf_dir):
    """Every document without the lines that an earlier window of three lines repeats."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


TOP_K_SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id,
  CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.n <> q.n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@_query("op6_exact_top_k", TOP_K_SQL)
def op6_exact_top_k(spark, sf_dir):
    """The five best of all other vectors for every vec_id that 50 divides."""
    vectors = _table(spark, sf_dir, "embeddings").select(
        "vec_id", topk.scaled(F.col("embedding"), 256.0).alias("vector"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


@_query("op8_sharding")
def op8_sharding(spark, sf_dir):
    """Every document's place in 40 shards that differ by one row at most."""
    documents = _table(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return sharding.shard(documents.withColumn("text_crc32", crc), shards=40).select(
        "row.doc_id", "size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@_query("op4_source_mixing")
def op4_source_mixing(spark, sf_dir):
    """Every document's rate in a mixture whose languages weigh their share to the power of 0.7."""
    rated, _ = mixing.mix(_table(spark, sf_dir, "documents"), "lang", temper=0.7)
    return rated.select("doc_id", "n_tokens", "domain", "rate", "copies")


_SPACED_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# every order and step against every failure mask, by the words of the definition
FILTER_AUDIT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_SPACED_SQL} AS w FROM documents),
f AS (SELECT doc_id, part, concat(
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
    CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' ELSE '' END) AS fails FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, substr(filter_order, 1, i - 1) AS before, substr(filter_order, i, 1) AS f
  FROM o, unnest(range(1, 6)) AS u(i)),
c AS (SELECT part, filter_order, step, f, n, good, toxic, fails = f AS only_f, contains(fails, f) AS fails_f,
    translate(before, fails, '') <> before AS gone FROM m, s),
r AS (SELECT part, filter_order, step, f, sum(n) FILTER (NOT gone AND NOT fails_f) AS kept,
    sum(n) FILTER (NOT gone AND fails_f) AS removed, sum(n) FILTER (gone AND fails_f) AS redundant,
    sum(n) FILTER (only_f) AS unique_fails, sum(good) FILTER (NOT gone AND fails_f) AS good_lost,
    sum(toxic) FILTER (NOT gone AND fails_f) AS toxic_lost FROM c GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""


@_query("op11_filter_audit", FILTER_AUDIT_SQL)
def op11_filter_audit(spark, sf_dir):
    """Five filters in all 120 orders, for every language."""
    failures = filter_audit.text_failures(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return filter_audit.audit(failures, list("ABCDE"), "part", ["good", "toxic"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


HARD_NEGATIVES_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_inner_product(CAST(a.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v c ON c.r <> a.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.r, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


@_query("op12_hard_negatives", HARD_NEGATIVES_SQL)
def op12_hard_negatives(spark, sf_dir):
    """For every vec_id that 100 divides, the first negatives of each of its five positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select(
        "vec_id", topk.scaled(F.col("embedding"), 256.0).alias("vector"), label.alias("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, n_positive=5, n_negative=10, low=30, high=90)


QUALITY_RULES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_SPACED_SQL} AS w FROM documents),
g AS (SELECT r, n, s, w, array_to_string(w[s + 1:s + n], ' ') AS gram
  FROM d, unnest([3, 5, 6, 7, 8, 9, 10]) AS u(n), unnest(range(0, len(w) - n + 1)) AS p(s)),
k AS (SELECT r, n, s, count(*) OVER (PARTITION BY r, n, gram) > 1 AS repeated,
    row_number() OVER (PARTITION BY r, n, gram ORDER BY s) > 1 AS later FROM g),
c AS (SELECT DISTINCT r, n, q FROM k, unnest(range(s, s + n)) AS u(q) WHERE CASE WHEN n = 3 THEN repeated ELSE later END),
h AS (SELECT c.r, c.n, count(*) AS n_words, sum(length(d.w[q + 1])) AS chars FROM c JOIN d ON c.r = d.r GROUP BY 1, 2),
x AS (SELECT r, max(n_words) FILTER (n = 3) AS n_repeat_words, max(chars) FILTER (n > 3) AS chars FROM h GROUP BY 1),
l AS (SELECT r, l, row_number() OVER (PARTITION BY r, l) > 1 AS later
  FROM d, unnest(string_split(text, chr(10))) AS u(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
y AS (SELECT r, count(*) FILTER (later) AS n_dup_lines,
    sum(length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (later) AS chars FROM l GROUP BY 1),
z AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(x.chars, 0) AS gram_chars, coalesce(y.chars, 0) AS line_chars
  FROM d LEFT JOIN x ON d.r = x.r LEFT JOIN y ON d.r = y.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND 100 * gram_chars <= 15 * word_chars AND 100 * line_chars <= 20 * word_chars AS kept FROM z"""


@_query("op13_quality_rules", QUALITY_RULES_SQL)
def op13_quality_rules(spark, sf_dir):
    """Every document's repetition and the verdict on it."""
    return quality_rules.repetition(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
