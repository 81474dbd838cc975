"""The registered queries of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import (
    embeddings, exact, jaccard, language, mixing, negatives, packing, passages, privacy, ranked, scoring, suffixes, warc,
)
from veilframe.llm.common import table
from veilframe.session import shared_folder

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op5_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.learn_profiles(docs.where(~language.held_out()))
    found = language.language_of(F.col("text"), profiles)
    return docs.select("doc_id", language.held_out().alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score")


@query("op10_ngram_jaccard_join")
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


@query("op4_embedding_near_dedup", """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
              AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
    links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
              WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
    SELECT e.vec_id, (SELECT count(*) FROM links WHERE x = e.vec_id) AS n_links, min(r.y) AS component_id,
           e.vec_id = min(r.y) AS kept
    FROM embeddings e JOIN reach r ON r.x = e.vec_id GROUP BY e.vec_id""")
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_dedup(table(spark, sf_dir, "embeddings"))


@query("op6_warc", """
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
           CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id <> max(page_id) OVER g THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id <> max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
    FROM pages WINDOW g AS (PARTITION BY coalesce(html, ''))""")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))


@query("op9_mix_to_targets")
def op9_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mixing.domain_model(docs, table(spark, sf_dir, "labels"))
    return mixing.mix_rates(docs, model, mixing.TARGETS).select(
        "doc_id", "n_tokens", F.map_from_arrays(F.array(*[F.lit(d) for d in model.domains]), "posterior").alias("posterior"), "rate", "copies")


@query("op8_masked_pseudo_likelihood")
def op8_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pseudo_likelihood(table(spark, sf_dir, "documents"))


@query("op2_suffix_array_dedup")
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = suffixes.remove_repeated_strings(table(spark, sf_dir, "documents"))
    size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                          F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_compact_windows")
def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_dedup(table(spark, sf_dir, "documents"))


@query("op11_personal_data")
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("personal", lambda s: ~s["added"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}") for kind in privacy.KINDS]
    return found.select("doc_id", *counts, F.sha2(privacy.listed(base), 256).alias("base_sha256"), privacy.listed(F.col("personal")).alias("spans"))


@query("op12_best_position", """
    WITH words AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
    total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM sizes),
    weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, nn),
    asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll))))::BIGINT AS score
               FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50""")
def op12_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_hard_negatives", """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                          AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
    pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
              FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
                  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN pairs USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers of a 256th; every seventh label is moved on by one; every hundredth vector is an anchor."""
    vectors = table(spark, sf_dir, "embeddings").where(negatives.usable(F.col("embedding")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.select("vec_id", moved.alias("label"), negatives.scaled(F.col("embedding")).alias("embedding"))
    return negatives.mine_negatives(vectors, F.col("vec_id") % 100 == 0)
