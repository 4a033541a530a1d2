"""Registered queries of the corpus operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import passages_of_each, repeated_passages

    return passages_of_each(repeated_passages(table(spark, sf_dir, "documents")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_exact import dedup_digests

    return dedup_digests(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("equal_words").alias("equal_words"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe_round_trip

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import token_counts

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return token_counts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, 50256)


def op8_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import identify_documents

    return identify_documents(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import lower_cased_third, manifest_proofs

    docs = table(spark, sf_dir, "documents")
    return manifest_proofs(docs, lower_cased_third(docs))


def op12_bpe_heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_heap import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_SQL = {
    "op4_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
            FROM documents
        ), b AS (
            SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
            FROM benchmark
        ), dw AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
        ), bw AS (
            SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM b WHERE len(w) >= 8
        ), m AS (
            SELECT doc_id, item_id, n, q, p - q AS diagonal FROM dw JOIN bw USING (word)
        ), c AS (
            SELECT doc_id, item_id, n,
                   count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY q
                                  RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS equal
            FROM m
        )
        SELECT doc_id, item_id, CAST(max(equal) AS INTEGER) AS equal_words
        FROM c WHERE equal >= CASE WHEN n >= 13 THEN 11 ELSE n END
        GROUP BY doc_id, item_id
    """,
    "op9_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
        ), d AS (
            SELECT page_id, octet_length(body) AS payload_bytes, lower(sha1(body)) AS payload_digest FROM p
        ), b AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS best FROM d
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
        FROM b
    """,
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY body) AS keep_id,
               count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
               sha256(body) AS text_sha256
        FROM d
    """,
}


#: Unsigned CRC-32 of a text of ASCII characters: a negative entry shifts by one bit, others are bytes.
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
    list_transform(string_split({0}, ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
    lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""


def _merkle_sql(levels: int = 10) -> str:
    """Level by level: a tree whose level has one node is done; others make a node of every eight."""
    field = "coalesce(CAST(octet_length(encode({0})) AS VARCHAR) || ':' || {0}, '-')".format
    record = " || ".join(field(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{text}"))
    parts = [f"""
        l AS (
            SELECT doc_id, lang, sha256({record.format(text="text")}) AS leaf,
                   sha256({record.format(text="CASE WHEN " + _CRC32.format("CAST(doc_id AS VARCHAR)") + " % 3 = 0 THEN "
                                        "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) AS other
            FROM documents
        ), a0 AS (
            SELECT doc_id, lang, leaf, other,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                   count(*) OVER (PARTITION BY lang) AS n
            FROM l
        ), t0 AS (SELECT lang, i, leaf AS h, n FROM a0),
        p0 AS (SELECT *, i AS spot, '' AS proof, other AS fold FROM a0)"""]  # fmt: skip

    def climb(tree: str, path: str, k: int) -> str:
        """Nodes of a level -> those of the next, and the paths through them."""
        return f"""
        {tree}{k + 1} AS (
            SELECT lang, i // 8 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, CAST(ceil(n / 8.0) AS BIGINT) AS n
            FROM {tree}{k} WHERE n > 1 GROUP BY lang, i // 8, n
            UNION ALL SELECT lang, i, h, n FROM {tree}{k} WHERE n = 1
        ), {path}r{k} AS (SELECT lang, i // 8 AS run, list(h ORDER BY i) AS hs FROM {tree}{k} WHERE n > 1 GROUP BY lang, i // 8
        ), {path}{k + 1} AS (
            SELECT p.* EXCLUDE (spot, n, proof, fold), spot // 8 AS spot, CAST(ceil(n / 8.0) AS BIGINT) AS n,
                   proof || array_to_string(hs[1:spot % 8], '') || array_to_string(hs[spot % 8 + 2:], '') AS proof,
                   sha256(array_to_string(hs[1:spot % 8], '') || fold || array_to_string(hs[spot % 8 + 2:], '')) AS fold
            FROM {path}{k} p JOIN {path}r{k} r ON p.lang IS NOT DISTINCT FROM r.lang AND p.spot // 8 = r.run WHERE n > 1
            UNION ALL SELECT * EXCLUDE (spot, n, proof, fold), spot, n, proof, fold FROM {path}{k} WHERE n = 1
        )"""

    parts += [climb("t", "p", k) for k in range(levels)]
    parts.append(f"""
        s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS trees FROM t{levels}),
        u0 AS (SELECT NULL AS lang, place AS i, subroot AS h, trees AS n FROM s),
        q0 AS (
            SELECT p.* EXCLUDE (spot, n, proof, fold, lang, i), NULL AS lang, subroot, place AS spot, trees AS n, proof, fold
            FROM p{levels} p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang
        )""")
    parts += [climb("u", "q", k) for k in range(3)]
    return "WITH " + ",".join(parts) + """
        SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified
        FROM q3, u3
    """


def _trie_sql() -> str:
    return f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, {_CRC32.format("CAST(conv_id AS VARCHAR)")} % 6 AS h,
                   list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS own
            FROM t GROUP BY conv_id
        ), r AS (
            SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) AS seq
            FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100
        ), p AS (
            SELECT conv_id, len(seq) AS n, seq[1:d] AS pre, d
            FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM r)
        ), n AS (
            SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
            FROM p GROUP BY d, pre
        ), u AS (
            SELECT n.*, m.conv_id AS parent, CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.pre[n.d].text) END AS saved
            FROM n LEFT JOIN n m ON m.d = n.d - 1 AND m.pre = n.pre[1:n.d - 1]
        ), k AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM u WHERE d > 0 GROUP BY parent, d),
        v AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k ON k.parent = u.conv_id AND k.d = u.d),
        s AS (
            SELECT p.d, p.pre, CAST(sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(v.saved) AS BIGINT) AS saved_tokens
            FROM v JOIN p ON p.conv_id = v.conv_id AND p.d <= v.d GROUP BY p.d, p.pre
        )
        SELECT v.conv_id, v.d AS depth, v.parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
        FROM v JOIN s ON s.d = v.d AND s.pre = v.pre
    """


def oracle_sql() -> dict[str, str]:
    return _SQL | {"op13_conversation_trie": _trie_sql(), "op11_merkle": _merkle_sql()}
