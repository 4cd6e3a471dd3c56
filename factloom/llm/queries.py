"""The training-data queries and their SQL."""

from __future__ import annotations

from .common import read


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def op1_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_dedup

    return exact_dedup(_docs(spark, sf_dir))


def op2_near_dedup(spark, sf_dir):
    from .near_dedup import near_duplicates

    return near_duplicates(_docs(spark, sf_dir))


def op3_pii(spark, sf_dir):
    from .pii import find_pii

    return find_pii(_docs(spark, sf_dir))


def op4_decontamination(spark, sf_dir):
    from .decontam import decontaminate

    return decontaminate(_docs(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op5_packing(spark, sf_dir):
    from .packing import pack

    return pack(_docs(spark, sf_dir))


def op6_language(spark, sf_dir):
    from .language import predict_languages

    return predict_languages(_docs(spark, sf_dir))


def op7_token_counts(spark, sf_dir):
    from .token_counts import token_counts

    return token_counts(_docs(spark, sf_dir))


def op8_substring_dedup(spark, sf_dir):
    from .substring_dedup import remove_repeats

    return remove_repeats(_docs(spark, sf_dir))


def op9_token_store(spark, sf_dir):
    from .token_store import token_store

    return token_store(spark, _docs(spark, sf_dir))


def op10_lm_scoring(spark, sf_dir):
    from .lm_score import score_documents

    return score_documents(_docs(spark, sf_dir))


def op11_substring_dedup(spark, sf_dir):
    from .suffix_trees import remove_repeated_passages

    return remove_repeated_passages(_docs(spark, sf_dir)).drop("spans")


def op12_ranked_search(spark, sf_dir):
    from .ranked_search import search

    return search(_docs(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op13_whitening(spark, sf_dir):
    from .whitening import whiten

    return whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_pii": op3_pii,
    "op4_decontamination": op4_decontamination,
    "op5_packing": op5_packing,
    "op6_language": op6_language,
    "op7_token_counts": op7_token_counts,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_store": op9_token_store,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_ranked_search": op12_ranked_search,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM n""",
    "op2_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS MATERIALIZED (
            SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END)) AS g FROM w),
        n AS MATERIALIZED (SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
        SELECT r.doc_id, any_value(n.n) AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY 1""",
    "op11_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        p AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
        s AS MATERIALIZED (SELECT doc_id, i, sha256(array_to_string(w[i : i + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d)),
        r AS MATERIALIZED (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM s),
        c AS (SELECT doc_id, i, word, coalesce(bool_or(coalesce(again, false)) OVER (PARTITION BY doc_id ORDER BY i ROWS 19 PRECEDING), false) AS gone FROM p LEFT JOIN r USING (doc_id, i)),
        a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)""",
    "op12_ranked_search": r"""
        WITH t AS MATERIALIZED (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        q AS MATERIALIZED (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
        k AS MATERIALIZED (SELECT count(*) AS documents, sum(n)::BIGINT AS terms FROM n),
        p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
        w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, k GROUP BY 1),
        s AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // terms))))::BIGINT AS score
            FROM q JOIN p USING (term) JOIN w USING (term) JOIN n USING (doc_id), k GROUP BY 1, 2),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= 10""",
}
