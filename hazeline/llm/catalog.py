"""Queries of the corpus operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hazeline.llm.clause_grammar import toxicity
from hazeline.llm.code_switch import identify_languages
from hazeline.llm.common import read_table
from hazeline.llm.decontaminate import contamination
from hazeline.llm.fertility import quality_rules
from hazeline.llm.jaccard_join import jaccard_components
from hazeline.llm.negative_mining import hard_negatives
from hazeline.llm.prefix_trie import prefix_trie
from hazeline.llm.secret_forest import scan
from hazeline.llm.sentencepieces import encode_pieces
from hazeline.llm.substrings import drop_repeated_passages
from hazeline.llm.superminhash import near_duplicates
from hazeline.llm.surrogates import replace_personal_data
from hazeline.llm.token_files import token_file_round_trip

#: Key of the query's surrogates; a deployment passes its own secret to the operator.
SURROGATE_KEY = "catalog-key"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


@query("op1_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), n=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match")


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("ids", "decoded")


@query("op3_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), width=5, percent=75)


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"), threshold=0.5).drop("clean_text")


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("clauses")


@query("op7_fertility")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                         public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_substrings")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(read_table(spark, sf_dir, "documents")).drop("kept_text")


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))


@query("op9_surrogates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(read_table(spark, sf_dir, "documents"), SURROGATE_KEY)


@query("op11_hard_negatives", sql="""
WITH r AS (
    SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.rid AS anchor, a.vec_id AS anchor_id, r.vec_id AS vec_id, r.label = a.label AS same,
           CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
    FROM r a JOIN r ON a.rid <> r.rid WHERE a.vec_id % 100 = 0),
p AS (
    SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5),
n AS (
    SELECT p.anchor, p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor, positive_id ORDER BY score DESC, vec_id) AS rank
    FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same
    WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(read_table(spark, sf_dir, "embeddings"), relabel_every=7, labels=10)


@query("op12_superminhash", sql="""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle
    FROM d),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
    SELECT x.doc_id AS a, y.doc_id AS b
    FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id JOIN z zx ON zx.doc_id = x.doc_id JOIN z zy ON zy.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 80 * (any_value(zx.n) + any_value(zy.n) - count(*))),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=4, percent=80)


@query("op13_prefix_trie", sql="""
WITH crc AS (
    SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                ORDER BY i) AS t
    FROM range(256) x(i)),
own AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
    SELECT conv_id, turns, xor(4294967295, list_reduce(
               list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 4 AS h
    FROM own, crc),
rebuilt AS (
    SELECT h.conv_id, coalesce(b.turns[1:h.h], []) || h.turns[h.h + 1:] AS turns
    FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
starts AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt),
nodes AS (
    SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256,
           (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(turns[depth].text), '[^\\x20\\x09-\\x0D]+')) END AS saved
    FROM starts GROUP BY path, depth),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.path = nodes.path),
up AS (SELECT path, depth, saved, n_children, unnest(range(depth + 1)) AS above FROM full_nodes),
sums AS (SELECT path[1:above] AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums ON sums.path = n.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"), every=20, most=3)
