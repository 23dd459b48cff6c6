"""Thin queries over the test tables: each applies an operator, with its production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    filter_audit, fingerprints, hamming, jaccard_join, language, licenses, minhash, mixing, packing, prefix_trie, recompression, token_counts, toxicity,
)
from .common import fold, ranked

CAPACITY = 2048
LIMIT = 4096


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(licenses.NOTICES, "template string, text string")
    found = licenses.license_scan(table(spark, sf_dir, "documents"), templates)
    return found.select(F.col("id").alias("doc_id"), "template", "containment", "first_word", "windows")


def op3_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = hamming.sign_code(F.col("embedding"), 64)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), code.alias("code"))
    return hamming.nearest_codes(rows, rows.where("id % 50 = 0"), k=10, segments=4)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(
        table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer("word_bpe_49k.json"), CAPACITY, 0
    )
    placed = packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), CAPACITY)
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language.learn(docs.where(~held_out), "text", "lang", F.xxhash64(F.lit(language.SEED), F.col("doc_id")))
    found = language.predict(docs, model, "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def toxic_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learned from the labelled ``docs`` of the four folds that are not held out."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return toxicity.learn(docs.select("doc_id", "text"), labels, "doc_id", "text", "toxic")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxic_model(spark, docs, sf_dir), "text", "score")
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), n=4, percent=85)
    return joined.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = recompression.substring_dedup(table(spark, sf_dir, "documents"), window=20)
    digest = F.sha2(F.coalesce(F.col("kept_text"), F.lit("")), 256)
    return cleaned.select(F.col("id").alias("doc_id"), "n_words", "n_removed", digest.alias("kept_sha256"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("here", F.coalesce("text", F.lit("")))
    both = lambda text: F.struct(text.alias("text"), fingerprints.sketch(text).alias("sketch"))
    rows = fingerprints.with_next(rows.select("id", "ord", "tid", "here"), "ord", "tid", "here", "next", both)
    n = F.length("here.text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("here.text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("id", n.cast("long").alias("n_chars"), F.col("here.sketch").alias("own"), F.col("next.sketch").alias("after"), edited.alias("edited"))
    rows = rows.select("*", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.sketch(F.col("edited")).alias("changed"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", fingerprints.as_text(F.col("own")).alias("fingerprint"),
        fingerprints.as_text(F.col("changed")).alias("edited_fingerprint"), fingerprints.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        fingerprints.likeness(F.col("own"), F.col("after")).alias("near_next"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rebuild(lists: DataFrame) -> DataFrame:
        base = F.col("conv_id") - F.col("conv_id") % 20
        return prefix_trie.shared_heads(lists, base, fold(F.col("conv_id"), 4), 3)

    nodes = prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), rebuild)
    return nodes.toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), n=5, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_license_scan, op3_hamming_topk, op4_best_fit_packing, op5_language_codes, op6_toxicity, op7_source_mixing,
        op8_jaccard_join, op9_substring_dedup, op10_fingerprints, op11_prefix_trie, op12_minhash, op13_filter_audit,
    )
}

_BITS = " + ".join(f"CASE WHEN (coalesce(q.embedding[{i}], 0) > 0) <> (coalesce(r.embedding[{i}], 0) > 0) THEN 1 ELSE 0 END" for i in range(1, 65))

ORACLE: dict[str, str] = {
    "op3_hamming_topk": f"""
        WITH pairs AS (
            SELECT q.vec_id AS query_id, r.vec_id AS id, {_BITS} AS distance
            FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance
        FROM pairs QUALIFY rank <= 10
    """,
    "op8_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
            FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, least(len(w), 1)))) AS i FROM words WHERE len(w) > 0)
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)
        ), reach AS (
            SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
        )
        SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(r.y) AS component_id
        FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id
    """,
    "op9_substring_dedup": r"""
        WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), starts AS (
            SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
            FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM words WHERE len(w) >= 20)
        ), again AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM starts) WHERE k > 1
        ), each AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM words WHERE len(w) > 0
        ), marked AS (
            SELECT doc_id, i, word, max(CASE WHEN k IS NULL THEN NULL ELSE i END) OVER last AS hit, k FROM (
                SELECT e.doc_id, e.i, e.word, a.i AS k FROM each e LEFT JOIN again a ON a.doc_id = e.doc_id AND a.i = e.i
            ) WINDOW last AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
        ), kept AS (
            SELECT doc_id, count(*) AS n_words, count(hit) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (hit IS NULL) AS kept
            FROM marked GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN kept USING (doc_id)
    """,
    "op11_prefix_trie": r"""
        WITH own AS (
            SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS turns
            FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
            GROUP BY conv_id
        ), heads AS (
            -- crc32 of the decimal id, bit by bit, modulo 4
            SELECT conv_id, xor(list_reduce(
                list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                lambda c, byte: list_reduce([xor(c, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
            ), 4294967295) % 4 AS h FROM own
        ), rebuilt AS (
            SELECT o.conv_id, list_concat(coalesce(b.turns[1:h], []), o.turns[h + 1:]) AS turns
            FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
        ), members AS (
            SELECT conv_id, turns[1:d] AS path, d AS depth, len(turns) = d AS ends FROM (
                SELECT conv_id, turns, unnest(generate_series(0, len(turns))) AS d FROM rebuilt
            )
        ), nodes AS (
            SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n,
                coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ids,
                CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) END AS words
            FROM members GROUP BY path, depth
        ), kids AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS kids FROM nodes WHERE depth > 0 GROUP BY 1, 2
        ), grown AS (SELECT n.*, coalesce(k.kids, 0) AS kids FROM nodes n LEFT JOIN kids k ON k.path = n.path AND k.depth = n.depth
        ), below AS (
            SELECT path[1:d] AS path, d AS depth, sum((n - 1) * words) AS saved, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves
            FROM (SELECT *, unnest(generate_series(0, depth)) AS d FROM grown) GROUP BY 1, 2
        )
        SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n AS n_convs, g.kids AS n_children, b.leaves::BIGINT AS n_leaves,
            b.saved::BIGINT AS saved_tokens, sha256(g.ids) AS ends_sha256
        FROM grown g JOIN below b ON b.path = g.path AND b.depth = g.depth
        LEFT JOIN nodes p ON p.path = g.path[1:g.depth - 1] AND p.depth = g.depth - 1 AND g.depth > 0
    """,
    "op13_filter_audit": r"""
        WITH words AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), firsts AS (SELECT t, min(coalesce(doc_id, 9223372036854775807)) AS least FROM words GROUP BY t
        ), marks AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
        ), docs AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
                len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t),
                regexp_matches(t, '[#$%&*|]'), coalesce(words.doc_id, 9223372036854775807) > least
            ] AS fails FROM words JOIN firsts USING (t) LEFT JOIN marks ON marks.doc_id = words.doc_id
        ), sums AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY ALL
        ), f AS (SELECT unnest(generate_series(1, 5)) AS i
        ), orders AS (
            SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
        ), steps AS (SELECT o, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, unnest(generate_series(1, 5)) AS step FROM orders
        ), each AS (
            SELECT part, filter_order, step, o[step] AS i, n, good, toxic, fails[o[step]] AS failing,
                len(list_filter(o[1:step - 1], lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS failed
            FROM steps CROSS JOIN sums
        ), counted AS (
            SELECT part, filter_order, step, i,
                sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN gone AND failing THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN failing AND failed = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM each GROUP BY ALL
        )
        SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            sum(removed) OVER (PARTITION BY part, i)::BIGINT AS shapley FROM counted
    """,
}

# the same join as op8 on five words, and a mark for the row that bears the group's id
ORACLE["op12_minhash"] = (
    ORACLE["op8_jaccard_join"]
    .replace("w[i:i + 3]", "w[i:i + 4]")
    .replace("len(w) - 3", "len(w) - 4")
    .replace("min(r.y) AS component_id", "min(r.y) AS component_id, d.doc_id = min(r.y) AS kept")
)
