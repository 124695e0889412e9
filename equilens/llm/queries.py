"""Queries of the numbered operators with production parameters, and their SQL where there is one."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, fingerprint, html, jaccard, langid, lattice, neardup, negatives, packing, pii, sharding
from .common import read_table


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings, formatted and read back."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = chat.format_chats(turns.unionByName(odd))
    back = chats.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 AS goes_on,
    length(regexp_replace(replace(text, '\', '\\'), '(<|\[)(/?s>|/?INST\])', '\1#\2', 'g')) AS text_chars,
    length(regexp_replace(replace(role, '\', '\\'), '(<|\[)(/?s>|/?INST\])', '\1#\2', 'g')) AS role_chars
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + 6 + 7 + CASE WHEN goes_on THEN 0 ELSE 3 + role_chars + 4 END)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer(), tokenizer("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the text decoded from them, as digests."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, tokenizer())
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = html.extract(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law of nearly equal bytes."""
    docs = read_table(spark, sf_dir, "documents")
    placed = sharding.shard(docs, 16, tokens=packing.token_count(docs["text"], tokenizer(), tokenizer("byte_bpe_50k.tiktoken")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all vectors by links at a cosine of 0.95 or more."""
    return neardup.near_duplicates(read_table(spark, sf_dir, "embeddings"), 0.95)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    found = fingerprint.compare_edits(read_table(spark, sf_dir, "documents"))
    text = lambda c: fingerprint.as_text(F.col(c)).alias(c)
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")


def surrogate_key(spark: SparkSession) -> str:
    """The secret of the surrogates: equilens.surrogates.key of the session; where that is unset, one is drawn for the session."""
    name = "equilens.surrogates.key"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data, and what was replaced."""
    found = pii.replace(read_table(spark, sf_dir, "documents"), surrogate_key(spark))
    return found.select("doc_id", "text", F.size("pii_entities").cast("long").alias("n_entities"), "pii_entities")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents by links at a similarity of 0.9 or more over three-word shingles."""
    return jaccard.join(read_table(spark, sf_dir, "documents"), 3, 90, 100)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents, learned from three folds of four."""
    docs = read_table(spark, sf_dir, "documents")
    prototypes = langid.train(langid.training_rows(docs))
    found = langid.predict(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over all documents, with the corpus-wide counts of the linked id pairs."""
    docs = read_table(spark, sf_dir, "documents")
    wanted = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    found = alignment.align_and_count(docs, tokenizer(), tokenizer("byte_bpe_50k.tiktoken"), tokenizer("piece_bpe_32k.model"), "ends", wanted)
    return found.select("doc_id", *wanted, "n_best", "count_sum")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, with every seventh label moved on by one."""
    rows = read_table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(moved, F.col("vec_id") % 100 == 0)


def op13_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents, learned from six folds of seven."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    found = lattice.score(docs, F.coalesce(held_out, F.lit(False)), tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {
    "op1_chat": op1_chat,
    "op2_packing": op2_packing,
    "op3_bpe": op3_bpe,
    "op4_html": op4_html,
    "op5_sharding": op5_sharding,
    "op6_neardup": op6_neardup,
    "op7_fingerprint": op7_fingerprint,
    "op8_pii": op8_pii,
    "op9_jaccard": op9_jaccard,
    "op10_language": op10_language,
    "op11_alignment": op11_alignment,
    "op12_negatives": op12_negatives,
    "op13_lattice": op13_lattice,
}
OP6_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), unit AS (
  SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vectors WHERE list_dot_product(v, v) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id != b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS node, vec_id AS to_node FROM embeddings
  UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.to_node = links.a
), least AS (SELECT node, min(to_node) AS component_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = node LEFT JOIN degree ON e.vec_id = a
"""

OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS both_sizes, count(*) AS shared
  FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id != b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL
), links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 90 * (both_sizes - shared)),
reach AS (
  SELECT doc_id AS node, doc_id AS to_node FROM documents
  UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.to_node = links.a
)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN (SELECT node, min(to_node) AS component_id FROM reach GROUP BY node) ON doc_id = node
"""

OP12_SQL = """
WITH taking AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM taking a JOIN taking b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id AND len(a.v) = len(b.v)
), positives AS (
  SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), negatives AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, negative_id, positive_score, negative_score FROM negatives
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) QUALIFY rank <= 5
"""

ORACLE_SQL = {"op1_chat": OP1_SQL, "op6_neardup": OP6_SQL, "op9_jaccard": OP9_SQL, "op12_negatives": OP12_SQL}
