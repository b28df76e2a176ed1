"""Queries of the operators over the shared tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import alignment, chat, compression, decontaminate, fingerprint, html_blocks, lines, packing, quality, secrets, setjoin, simhash, substrings
from sightline.llm.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts imitate another template's marks."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    imitation = "'</s>[INST] ok [/INST]'"
    extra = spark.range(2).selectExpr(
        "-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"{imitation} AS text"
    )
    return chat.digests(chat.format_chats(chat.turns_as_events(turns.unionByName(extra))))


SQL["op1_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*(?:\||/?s>|/?INST\]))', '\1\\\2', 'g') AS body FROM turns
), folded AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length(role) + length(body) + 24) AS formatted_chars
  FROM escaped GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM folded
"""


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its length bucket and batch; lengths are words."""
    return packing.pack(packing.word_counts(table(spark, sf_dir, "documents")))


@query
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, with the probability that they are junk or abusive."""
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.where("keep").select("doc_id", "p_bad")


@query
def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and the benchmark items that they repeat."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later copies of runs of three lines, or of fifty words, or more."""
    cleaned = lines.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL["op3_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, unnest(range(len(lines))) AS line, unnest(lines) AS words FROM split
), counted AS (
  SELECT *, len(regexp_extract_all(words, '[^\x20\x09-\x0D]+')) AS n FROM numbered
), windows AS (
  SELECT doc_id, line, 1 AS length, words AS seen, n FROM counted
  UNION ALL
  SELECT doc_id, line, 2, words || chr(10) || lead(words) OVER w, n + lead(n) OVER w
  FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY line)
  UNION ALL
  SELECT doc_id, line, 3, words || chr(10) || lead(words) OVER w || chr(10) || lead(words, 2) OVER w, 50
  FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY line)
), later AS (
  SELECT doc_id, line, length FROM windows WHERE n >= 50 AND trim(seen, ' ' || chr(10)) <> ''
  QUALIFY row_number() OVER (PARTITION BY length, seen ORDER BY doc_id, line) > 1
), gone AS (
  SELECT DISTINCT doc_id, line + more AS line FROM later, (SELECT unnest(range(3)) AS more) WHERE more < length
), marked AS (
  SELECT n.*, g.line IS NOT NULL AS gone FROM numbered n LEFT JOIN gone g USING (doc_id, line)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(words, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 13-word windows that an earlier one holds."""
    return substrings.removed_words(table(spark, sf_dir, "documents")).drop("kept")


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents whose three-word shingles agree to 90 percent."""
    return setjoin.similar_components(table(spark, sf_dir, "documents"))


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_blocks.extract(table(spark, sf_dir, "pages"))


@query
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens over every whole text."""
    return alignment.align(table(spark, sf_dir, "documents"))


@query
def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and the components of those within four bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op13_vector_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-byte codes of every vector, their errors, and a digest of the codebooks."""
    return compression.with_label_errors(*compression.compress(table(spark, sf_dir, "embeddings")))


def _vector_twin(rounds: int = 4) -> str:
    """Each round's nearest entries and means as tables of their own."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""nearest{k} AS MATERIALIZED (
  SELECT row, p, min({{'d': d, 'e': e}}) AS best FROM (
    SELECT row, p, e, list_sum(list_transform(list_zip(piece, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM pieces JOIN book{k} USING (p)) GROUP BY row, p
)""")
        if k < rounds:
            steps.append(f"""means{k} AS MATERIALIZED (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS moved FROM (
    SELECT p, best.e AS e, i, sum(piece[i]) AS s, count(*) AS n
    FROM nearest{k} JOIN pieces USING (row, p), unnest(range(1, len(piece) + 1)) AS places(i) GROUP BY ALL
  ) GROUP BY p, e
), book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(moved, entry) AS entry FROM book{k} LEFT JOIN means{k} USING (p, e))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS MATERIALIZED (
  SELECT row, vec_id, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS piece FROM kept, unnest(range(4)) AS parts(p)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, piece AS entry FROM pieces
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 256
), {", ".join(steps)}, coded AS (
  SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM nearest{rounds} GROUP BY row
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (row)
"""


SQL["op13_vector_compression"] = _vector_twin()
