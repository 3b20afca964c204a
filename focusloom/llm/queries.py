"""The registered queries over the training-data operators, and their SQL where it can express them.

Each applies its operator with production parameters to the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from focusloom.llm import byte_bpe, chat, decontamination, gif, html_blocks, near_dedup, packing, pii, prefix_trie, spelling, substring_dedup, token_store, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_text(table(spark, sf_dir, "pages"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stored = gif.encode_media(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("payload")), "doc_id", "payload")
    back = gif.decode_media(stored, "doc_id", keep=("n_bytes",))
    return back.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", gif.feature_text().alias("feature"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents")).select("doc_id", "text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digest(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    own = (op1_chat_format, op2_substring_dedup, op3_toxicity, op4_html_text, op5_near_dedup, op6_gif_media, op7_pii_surrogates, op8_decontamination, op9_token_ids, op10_packing, op11_byte_bpe, op12_spelling_variants, op13_prefix_trie, pipeline)
    return {f.__name__: f for f in own}


# conversations that no longer one begins with, compared turn by turn as strings
_CHAT = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), listed AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM turns GROUP BY conv_id
), prefixes AS (
  SELECT conv_id, row_number() OVER w AS pos,
         md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)) AS h,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), inner_ones AS (
  SELECT DISTINCT pos, h FROM prefixes WHERE pos < n
), single AS (
  SELECT min(conv_id) AS conv_id FROM listed GROUP BY rendered
)
SELECT l.conv_id, l.n_turns, length(l.rendered) AS n_chars, l.rendered
FROM listed l JOIN single s ON s.conv_id = l.conv_id
WHERE NOT EXISTS (SELECT 1 FROM inner_ones i WHERE i.pos = l.n_turns AND i.h = md5(l.rendered))
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_SUBSTRING = rf"""
WITH split AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), windows AS (
  SELECT doc_id, i AS pos, array_to_string(w[i:i + 19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM split WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS k FROM windows) WHERE k > 1
), gone AS (
  SELECT doc_id, list(DISTINCT pos + o) AS g FROM (SELECT doc_id, pos, unnest(range(0, 20)) AS o FROM later) GROUP BY doc_id
), kept AS (
  SELECT s.doc_id, len(s.w) AS n_words, coalesce(len(g.g), 0) AS n_removed,
         [x FOR x, i IN s.w IF g.g IS NULL OR NOT list_contains(g.g, i)] AS k
  FROM split s LEFT JOIN gone g USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

_DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, w, least(len(w), 13) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), sizes AS (SELECT DISTINCT n FROM grams),
found AS (
  SELECT x.doc_id, x.pos, x.n, g.item_id
  FROM (SELECT doc_id, i AS pos, n, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)) x
  JOIN grams g ON g.n = x.n AND g.s = x.s
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM found) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)
"""


# crc32 bit by bit, over the UTF-8 bytes of {s}
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(0, octet_length(encode({s}))), lambda i: list_transform(range(0, 8), lambda b: (('0x' || substring(hex(encode({s})), CAST(2 * i + 1 AS INT), 2))::BIGINT >> CAST(b AS INT)) & 1)))), lambda a, b: xor(a >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"

# near words: equal but for one open place, or one without one place is the other
_SPELLING = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+'), lambda w: length(w) >= 7)) AS run
  FROM documents
), counted AS (
  SELECT id || ':' || run AS s, run, count(*) AS n FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, n, {_CRC.format(s="s")} AS h FROM counted
), cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), opened AS (
  SELECT word, n, left(word, i - 1) || '*' || substring(word, i + 1) AS k FROM places
), shorter AS (
  SELECT DISTINCT word, n, left(word, i - 1) || substring(word, i + 1) AS k FROM places
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM opened a JOIN opened b USING (k) WHERE a.word <> b.word
  UNION ALL SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.k = w.word
  UNION ALL SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.k = w.word
), near AS (
  SELECT word, count(*) AS n_near, max(m) AS best_n, min(other) FILTER (m = top) AS best FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM pairs) GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word)
), chain AS (
  SELECT word, word AS root, 0 AS d FROM forms
  UNION ALL SELECT c.word, f.form, d + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(root, d) AS root FROM chain GROUP BY word) USING (word)
"""


# every subtree is summed node by node, by joining each node with the conversations that pass it
_TRIE = rf"""
WITH ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format(s="CAST(conv_id AS VARCHAR)")} % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
), turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(role)) || ':' || role || ':' || text)) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), rebuilt AS (
  SELECT c.conv_id, i, role, text FROM ids c JOIN turns t ON t.conv_id = c.base WHERE i <= h
  UNION ALL SELECT c.conv_id, i, role, text FROM ids c JOIN turns t ON t.conv_id = c.conv_id WHERE i > h
), placed AS (
  SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS bytes,
         md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)) AS k
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY i)
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM ids
), last AS (
  SELECT conv_id, max(depth) AS depth FROM placed GROUP BY conv_id
), linked AS (
  SELECT p.*, lag(k) OVER (PARTITION BY p.conv_id ORDER BY p.depth) AS parent, p.depth = l.depth AS ends FROM placed p JOIN last l USING (conv_id)
), nodes AS (
  SELECT k, depth, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS worth,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM linked GROUP BY k, depth
), children AS (
  SELECT parent AS k, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), full_nodes AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (k)
), below AS (
  SELECT p.k, sum(u.worth) AS saved, count(*) FILTER (u.n_children = 0) AS leaves
  FROM placed p JOIN full_nodes u ON u.conv_id = p.conv_id AND u.depth >= p.depth GROUP BY p.k
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b USING (k) LEFT JOIN full_nodes p ON p.k = n.parent
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": _CHAT, "op2_substring_dedup": _SUBSTRING, "op8_decontamination": _DECONTAMINATION, "op12_spelling_variants": _SPELLING, "op13_prefix_trie": _TRIE}
