"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from daybook.llm import chat, exact_dedup, importance, lexical, line_dedup, lm, mixing, quality, search
from daybook.llm import sentencepiece, simhash, substring, suffix_dedup
from daybook.llm.common import documents

# Vocabulary of op3 and of the pipeline.
MODEL = "piece_bpe_32k.model"


def model_path() -> str:
    return str(public_tokenizers.path(MODEL))


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_line_dedup(spark, folder):
    kept = line_dedup.dedup_lines(documents(spark, folder))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_chat_formatting(spark, folder):
    return chat.format_chats(_table(spark, folder, "conversations"))


def op3_sentencepiece(spark, folder):
    return sentencepiece.encode_documents(documents(spark, folder), model_path())


def op4_lm_scoring(spark, folder):
    return lm.score(documents(spark, folder))


def op5_simhash(spark, folder):
    return simhash.near_dedup(documents(spark, folder)).select("doc_id", "fingerprint", "component_id")


def op6_substring_dedup(spark, folder):
    return substring.dedup_substrings(documents(spark, folder))


def op7_exact_dedup(spark, folder):
    return exact_dedup.exact_dedup(documents(spark, folder)).drop("digest")


def op8_topk_search(spark, folder):
    """Every document whose id is divisible by 20, as a query against all."""
    docs = documents(spark, folder)
    found = search.search(docs, docs.filter("doc_id % 20 = 0"))
    return found.withColumn("score", F.round("score", 6))


def op9_source_mixing(spark, folder):
    return mixing.allot(documents(spark, folder)).select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )


def op10_quality_resampling(spark, folder):
    return quality.resample(documents(spark, folder), _table(spark, folder, "labels")).drop("digest")


def op11_suffix_array_dedup(spark, folder):
    return suffix_dedup.dedup_bytes(documents(spark, folder))


def op12_target_resampling(spark, folder):
    """Documents drawn towards the texts of ``benchmark``."""
    return importance.resample(documents(spark, folder), _table(spark, folder, "benchmark"))


def op13_lexical_search(spark, folder):
    """Every benchmark item against all documents."""
    return lexical.search(documents(spark, folder), _table(spark, folder, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_chat_formatting, op3_sentencepiece, op4_lm_scoring, op5_simhash,
        op6_substring_dedup, op7_exact_dedup, op8_topk_search, op9_source_mixing, op10_quality_resampling,
        op11_suffix_array_dedup, op12_target_resampling, op13_lexical_search,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op1_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.line, k.pos, o.key IS NOT NULL AND o.keep <> k.doc_id AS gone
  FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op2_chat_formatting": """
WITH known AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM known
), whole AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM numbered GROUP BY conv_id
), first_ones AS (
  SELECT turns, min(conv_id) AS conv_id FROM whole GROUP BY turns
), inner_ones AS (
  SELECT DISTINCT turns[1:n] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS n FROM whole)
), kept AS (
  SELECT conv_id FROM first_ones ANTI JOIN inner_ones USING (turns)
), rendered AS (
  SELECT conv_id, pos, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS body
  FROM numbered SEMI JOIN kept USING (conv_id)
), placed AS (
  SELECT *, (sum(length(body)) OVER (PARTITION BY conv_id ORDER BY pos) - length(body))::BIGINT // 8000 AS part
  FROM rendered
)
SELECT conv_id, part, count(*) AS n_turns, min(pos) AS first_turn, string_agg(body, '' ORDER BY pos) AS text
FROM placed GROUP BY conv_id, part""",
    "op6_substring_dedup": f"""
WITH split AS (
  SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents
), windows AS (
  SELECT doc_id, n, words[n:n + 12] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS n FROM split)
), least AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY win) AS first_doc FROM windows
), gone AS (
  SELECT DISTINCT doc_id, n + d AS n FROM least, range(13) AS t(d) WHERE first_doc < doc_id
), each AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS n FROM split
), marked AS (
  SELECT e.*, g.n IS NOT NULL AS out FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.n = g.n
), kept AS (
  SELECT doc_id, count(*) FILTER (out) AS n_removed,
         string_agg(word, ' ' ORDER BY n) FILTER (NOT out) AS kept
  FROM marked GROUP BY doc_id
)
SELECT s.doc_id, len(s.words)::BIGINT AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id""",
    "op7_exact_dedup": f"""
WITH bodies AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM bodies WINDOW same AS (PARTITION BY body)""",
    "op8_topk_search": f"""
WITH split AS (
  SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS words FROM documents
), sizes AS (
  SELECT doc_id, len(words) AS size FROM split
), whole AS (
  SELECT count(*) AS n, avg(size) AS mean FROM sizes
), tf AS (
  SELECT doc_id, word, count(*) AS f FROM (SELECT doc_id, unnest(words) AS word FROM split) GROUP BY ALL
), df AS (
  SELECT word, count(*) AS d FROM tf GROUP BY word
), weighed AS (
  SELECT tf.doc_id, tf.word,
         ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean)) AS w
  FROM tf JOIN df USING (word) JOIN sizes USING (doc_id), whole
), scored AS (
  SELECT q.doc_id AS query_id, p.doc_id, round(sum(q.f * p.w), 6) AS score
  FROM tf q JOIN weighed p USING (word) WHERE q.doc_id % 20 = 0 GROUP BY ALL
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
       doc_id, score
FROM scored QUALIFY rank <= 10""",
    "op11_suffix_array_dedup": """
WITH bodies AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), pieces AS (
  SELECT doc_id, c, substr(h, 2 * c + 1, 2 * 549) AS part
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49, 500)) AS c FROM bodies)
), windows AS (
  SELECT doc_id, c + j AS i, substr(part, 2 * j + 1, 100) AS win
  FROM (SELECT doc_id, c, part, unnest(range(0, length(part) // 2 - 49)) AS j FROM pieces)
), firsts AS (
  SELECT win, min(doc_id) AS first_doc FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
  FROM windows JOIN firsts USING (win) WHERE first_doc < doc_id
), numbered AS (
  SELECT *, count(*) FILTER (before IS NULL OR i > before + 50) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM gone
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, span
), parted AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans
), kept AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS stop,
         string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS front
  FROM parted JOIN bodies USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM bodies LEFT JOIN kept USING (doc_id)""",
    "op13_lexical_search": f"""
WITH split AS (
  SELECT doc_id, {_TERMS.format(_LOWER.format("coalesce(text, '')"))} AS terms FROM documents
), sizes AS (
  SELECT doc_id, len(terms) AS n FROM split WHERE len(terms) > 0
), whole AS (
  SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM sizes
), tf AS (
  SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest(terms) AS term FROM split) GROUP BY ALL
), weighed AS (
  SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, nn
), asked AS (
  SELECT DISTINCT item_id, unnest({_TERMS.format(_LOWER.format("coalesce(text, '')"))}) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * f) // (1000 * f + 8 * (100 - 90 + (90 * n * nn) // ll))))::BIGINT AS score
  FROM asked JOIN weighed USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), whole GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10""",
}
