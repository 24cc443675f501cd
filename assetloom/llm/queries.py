"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.llm import alignment, ann, bpe, exact_dedup, fill_in_middle, html_extract, jaccard, language, line_dedup, minhash, packing, token_counts, toxicity
from assetloom.llm.common import table


def word_pieces() -> list[str]:
    """The ordinary pieces of the public word-piece vocabulary."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    special = [model.is_control, model.is_unknown, model.is_byte, model.is_unused]
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), word_pieces())


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), path, decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


#: Tokens of a packed sequence, and the id that ends a document.
SEQUENCE_TOKENS = 4096
END_ID = 1


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), path, SEQUENCE_TOKENS, END_ID)
    return packing.pack(pieces, SEQUENCE_TOKENS)


def language_split(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``: rows that no language model learns from."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))


def language_model(docs: DataFrame) -> language.Model:
    return language.train(language_split(docs.select("doc_id", "text", "lang")).where("NOT held_out AND doc_id IS NOT NULL"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language_model(docs))
    return language_split(found).select("doc_id", "held_out", "lang_pred", "score")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_similar_lines(table(spark, sf_dir, "documents"), percent=80)


def toxicity_split(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``: rows whose labels no toxicity model learns from."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.train(docs, toxicity_split(labels.select("doc_id", "toxic")).where("NOT held_out"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity_split(toxicity.score_documents(docs, model))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = fill_in_middle.restore(fill_in_middle.transform(table(spark, sf_dir, "documents")))
    return samples.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_documents(table(spark, sf_dir, "documents"), *paths).documents.drop("groups")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe": op2_bpe,
    "op3_packing": op3_packing,
    "op4_language": op4_language,
    "op5_html": op5_html,
    "op6_ann": op6_ann,
    "op7_jaccard": op7_jaccard,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_minhash": op11_minhash,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_alignment": op13_alignment,
}

#: Components of near duplicates; ``{percent}`` is the least similarity.
NEAR_SQL = r"""
    WITH RECURSIVE listed AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
        FROM listed
    ), grams AS (
        SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
    ), near AS (
        SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (min(a.n) + min(b.n) - count(*))
    ), reach(x, y) AS (
        SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, near.y FROM reach JOIN near ON reach.y = near.x
    )
    SELECT sets.doc_id, len(s) AS n_shingles, min(reach.y) AS component_id
    FROM sets JOIN reach ON sets.doc_id = reach.x GROUP BY sets.doc_id, len(s)
"""

SQL = {
    "op7_jaccard": NEAR_SQL.format(percent=85),
    "op11_minhash": f"SELECT *, doc_id = component_id AS kept FROM ({NEAR_SQL.format(percent=80)})",
    "op8_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, str_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
        ), lines AS (
            SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM split
        ), sets AS (
            SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'))) AS tokens FROM lines
        ), distinct_sets AS (
            SELECT tokens, row_number() OVER (ORDER BY min((doc_id, line_no))) AS place, len(tokens) AS n, min((doc_id, line_no)) AS first
            FROM sets WHERE len(tokens) > 0 GROUP BY tokens
        ), counted AS (
            SELECT token, count(*) AS uses FROM (SELECT unnest(tokens) AS token FROM distinct_sets) GROUP BY token
        ), ranked AS (
            SELECT place, n, token, row_number() OVER (PARTITION BY place ORDER BY uses, token) AS spot
            FROM (SELECT place, n, unnest(tokens) AS token FROM distinct_sets) JOIN counted USING (token)
        ), prefixes AS (
            SELECT place, n, token FROM ranked WHERE spot <= n - (80 * n + 99) // 100 + 1
        ), candidates AS (
            SELECT DISTINCT a.place AS x, b.place AS y FROM prefixes a JOIN prefixes b ON a.token = b.token AND a.place < b.place
            WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
        ), later AS (
            SELECT DISTINCT y FROM candidates JOIN distinct_sets a ON a.place = x JOIN distinct_sets b ON b.place = y
            WHERE 180 * len(list_intersect(a.tokens, b.tokens)) >= 80 * (a.n + b.n)
        ), judged AS (
            SELECT doc_id, line_no, line, sets.tokens IS NOT NULL AND coalesce((doc_id, line_no) > first OR y IS NOT NULL, false) AS gone
            FROM lines JOIN sets USING (doc_id, line_no) LEFT JOIN distinct_sets ON sets.tokens = distinct_sets.tokens LEFT JOIN later ON y = place
        )
        SELECT documents.doc_id, count(line) AS n_lines, count(*) FILTER (gone) AS n_removed,
               CASE WHEN any_value(text) IS NULL THEN NULL
                    ELSE coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') END AS text
        FROM documents LEFT JOIN judged ON documents.doc_id = judged.doc_id GROUP BY documents.doc_id
    """,
    "op10_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        ), ranked AS (
            SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size,
                   row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) AS place
            FROM rows
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked
    """,
    "op12_fill_in_middle": """
        WITH seeds AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
        ), numbers AS (
            SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS one, ('0x' || h[9:16])::BIGINT % (n + 1) AS two,
                   ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4
            FROM seeds
        ), cuts AS (
            SELECT doc_id, t, n, least(one, two) AS a, greatest(one, two) AS b,
                   CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
                        WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM numbers
        ), parts AS (
            SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cuts
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM parts
    """,
}
