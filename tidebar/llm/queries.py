"""Registered queries of the text operators, with SQL twins where SQL can express them.

Each query applies one operator to whole tables and derives digest columns from its output."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tidebar.llm import decontaminate, exact_dedup, licenses, line_dedup, pieces, pii, prefix_trie, quality_mil, quality_rules, simhash, token_ids, toxicity, whitening
from tidebar.llm.labelled import fold
from tidebar.llm.text import table
from tidebar.sources.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: A-Z lower-cased in DuckDB.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


@register("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text decoded from them."""
    coded = pieces.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), "ids", "decoded")


def _words_sql(text: str) -> str:
    return f"regexp_extract_all({_LOWER.format(text)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@register("op2_token_ids")
def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, number and checksum of every text's ids, read back from the files."""
    path = token_ids.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "token-files"), end_id=1)
    return token_ids.read_ids(spark, path, with_ids=False)


def _templates_sql() -> str:
    rows = []
    for k, t in enumerate(licenses.templates()):
        words = "[" + ", ".join(f"'{w}'" for w in t.words) + "]"
        rows.append(f"({k}, '{t.label}', {words}, {t.need}, {str(t.phrase).lower()})")
    return ", ".join(rows)


@register("op3_licenses", f"""
WITH t AS (SELECT *, len(list_distinct(words)) AS size FROM (VALUES {_templates_sql()}) AS v(k, label, words, need, phrase)),
d AS (SELECT doc_id, {_words_sql("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT doc_id, b, list_slice(w, {licenses.STRIDE} * b + 1, {licenses.STRIDE} * b + {licenses.BLOCK}) AS bw
      FROM (SELECT doc_id, w, unnest(range(0, (len(w) + {licenses.STRIDE - 1}) // {licenses.STRIDE})) AS b FROM d)),
n AS (SELECT doc_id, label, size, len(list_intersect(list_distinct(bw), words)) AS common FROM b, t WHERE NOT phrase AND len(list_intersect(list_distinct(bw), words)) >= need),
p AS (SELECT doc_id, label, pos FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS pos FROM d), t WHERE phrase AND w[pos + 1] = words[1] AND list_slice(w, pos + 1, pos + len(words)) = words),
pd AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM p GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM p) GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM n) GROUP BY doc_id),
sc AS (SELECT doc_id, max(s) AS score FROM (SELECT doc_id, 1.0::DOUBLE AS s FROM p UNION ALL SELECT doc_id, common / size FROM n) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN pd USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN sc USING (doc_id)""")
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and labels of every text."""
    found = licenses.find_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
                        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


@register("op4_line_dedup", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, {_LOWER.format("regexp_replace(line, '^[' || chr(9) || '-' || chr(13) || chr(32) || ']+|[' || chr(9) || '-' || chr(13) || chr(32) || ']+$', '', 'g')")} AS key FROM l),
s AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*) AS n_lines, count(s.owner) FILTER (k.doc_id <> s.owner) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (s.owner IS NULL OR k.doc_id = s.owner), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key) GROUP BY k.doc_id""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and after, and the digest of what stays, of every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def _scored(rows: DataFrame, held_out) -> DataFrame:
    return rows.select(F.col("id").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register("op5_quality_mil")
def op5_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are learned from the rows outside fold 0 of 5."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_mil.fit_quality(docs, labels.filter(fold("doc_id", 5) != 0))
    return _scored(quality_mil.score_quality(docs, model), fold("id", 5) == 0)


@register("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every text; the classifier learns from all labels."""
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, model, carry=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


@register("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neither labels nor unlabelled rows come from fold 2 of 4."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = fold("doc_id", 4) != 2
    model = toxicity.fit_toxicity(docs, labels.filter(learned), docs.filter(learned))
    return _scored(toxicity.score_toxicity(docs, model), fold("id", 4) == 2)


@register("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every text, base spans also as counts and digest."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *[number(k) for k in pii.KINDS[: pii.BASE]], F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


@register("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=3, shingle=3, seed=42)


@register("op10_decontaminate", f"""
WITH i AS (SELECT item_id, {_words_sql("coalesce(text, '')")} AS w FROM benchmark),
win AS (SELECT item_id, array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') AS k, least(13, len(w)) AS n
        FROM (SELECT item_id, w, unnest(range(1, 1 + greatest(1, len(w) - 12))) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_words_sql("coalesce(text, '')")} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS k
        FROM (SELECT doc_id, w, n, unnest(range(1, 2 + len(w) - n)) AS p FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, p, win.n FROM occ JOIN win USING (k)),
nh AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words hit by benchmark windows, and their items, for every text."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", decontaminate.hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256")).select(
        "*", decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


@register("op11_exact_dedup", """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS k FROM documents),
g AS (SELECT k, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY k)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM n JOIN g USING (k)""")
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stays for it."""
    marked = exact_dedup.mark_copies(table(spark, sf_dir, "documents"))
    return marked.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@register("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector on the first 16 components."""
    return whitening.whiten_embeddings(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: CRC-32 of the decimal digits of conv_id: reflected polynomial, bit by bit.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda crc, b:
    list_reduce(list_prepend(xor(crc, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


@register("op13_prefix_trie", f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, code) AS k
           FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code, strlen(coalesce(text, '')) AS bytes
                 FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC_SQL} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS d
      FROM (SELECT c.conv_id, 0 AS part, t.k, t.code, t.bytes FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h
            UNION ALL SELECT c.conv_id, 1, t.k, t.code, t.bytes FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h)),
p AS (SELECT conv_id, d, bytes, sha256(string_agg(code, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key FROM r),
m AS (SELECT conv_id, d, bytes, key, CASE WHEN d = 1 THEN 'root' ELSE lag(key) OVER (PARTITION BY conv_id ORDER BY d) END AS up FROM p UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM c),
n AS (SELECT key, min(d) AS d, min(conv_id) AS conv_id, count(*) AS n, min(bytes) AS bytes, min(up) AS up FROM m GROUP BY key),
ch AS (SELECT up AS key, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT m.key, sum(CASE WHEN ch.key IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n - 1) * n.bytes) AS saved
          FROM n LEFT JOIN ch ON ch.key = n.key JOIN m ON m.conv_id = n.conv_id AND m.d <= n.d GROUP BY m.key),
l AS (SELECT conv_id, max(d) AS d FROM m GROUP BY conv_id),
e AS (SELECT m.key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM m JOIN l USING (conv_id, d) GROUP BY m.key)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN below ON below.key = n.key LEFT JOIN ch ON ch.key = n.key LEFT JOIN e ON e.key = n.key LEFT JOIN n u ON u.key = n.up""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), shared=True)
