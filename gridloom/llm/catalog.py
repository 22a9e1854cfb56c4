"""Named queries of this folder; ``load`` gives them with their SQL, where SQL can express them.

Only phrases and the conversation trie have SQL: tokenizers, trained models, hashes of bytes left over and
greedy packing are beyond it or too slow on whole tables. tests/llm holds those against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import bpe, collocations, fingerprints, html_text, jaccard, language, neighbours, packing, quality, rules, sharding, suffixes, trie
from gridloom.llm.common import read, remainder

VOCABULARY = "word_bpe_49k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    held_out = (remainder("doc_id", quality.FOLDS) == quality.HELD_OUT).alias("held_out")
    return quality.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbours(read(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = (remainder("doc_id", language.FOLDS) == language.HELD_OUT).alias("held_out")
    return language.identify(docs.select("doc_id", "text"), language.fit(docs)).select("doc_id", held_out, "lang_pred", "score")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


#: Every phrase of 1 to 5 words is written out and counted; cuts and extensions are looked up by their text.
OP11_SQL = """
WITH pieces AS (
    SELECT lang, unnest(regexp_split_to_array(txt, '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS txt
          FROM documents WHERE text IS NOT NULL)),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
windows AS (SELECT lang, w[i:least(i + 4, len(w))] AS w FROM placed),
parts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS m FROM windows),
f AS (SELECT lang, array_to_string(w[1:m], ' ') AS phrase, any_value(w[1:m]) AS w, count(*) AS a
      FROM parts GROUP BY 1, 2 HAVING count(*) >= 100),
longer AS (SELECT lang, a, w FROM f WHERE len(w) > 1),
gone AS (SELECT lang, array_to_string(w[2:], ' ') AS phrase, a FROM longer
         UNION SELECT lang, array_to_string(w[1:len(w) - 1], ' '), a FROM longer),
cuts AS (SELECT lang, a, w, unnest(range(1, len(w))) AS k FROM longer),
scores AS (
    SELECT c.lang, array_to_string(c.w, ' ') AS phrase, c.a, c.k, l.a AS l, r.a AS r, t.n,
           (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score
    FROM cuts c JOIN totals t USING (lang)
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.lang = best.lang AND g.phrase = best.phrase AND g.a >= best.a)
QUALIFY rank <= 2000
"""


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read(spark, sf_dir, "conversations"))


#: Every prefix of every rebuilt conversation is written out. A digit takes nine steps of crc32: its bits go
#: in, then eight shifts.
OP12_SQL = """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, left(text, 64),
                         left(sha256(length(role) || ':' || role || text), 32)) AS turns
    FROM turns GROUP BY conv_id),
hashed AS (
    SELECT conv_id, turns, list_reduce(
        list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: [ord(d), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda x, o: CASE WHEN o >= 0 THEN xor(x, o) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS crc
    FROM own),
heads AS (SELECT conv_id, turns, xor(crc, 4294967295) % 4 AS h FROM hashed),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
    FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
prefixes AS (SELECT conv_id, len(turns) AS size, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
members AS (SELECT conv_id, size, depth, turns[1:depth] AS path FROM prefixes),
nodes AS (
    SELECT path, depth, min(conv_id) AS first, count(*) AS n,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends
    FROM members GROUP BY path, depth),
linked AS (SELECT c.*, p.first AS parent FROM nodes c LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.path = c.path[1:c.depth - 1]),
children AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM linked WHERE depth > 0 GROUP BY 1, 2),
valued AS (
    SELECT l.*, coalesce(c.n, 0) AS n_children,
           CASE WHEN l.depth = 0 THEN 0 ELSE (l.n - 1) * len(regexp_extract_all(l.path[l.depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
    FROM linked l LEFT JOIN children c ON c.parent = l.first AND c.depth = l.depth),
ups AS (SELECT unnest(range(0, depth + 1)) AS depth, path, saved, n_children = 0 AS leaf FROM valued),
sums AS (SELECT depth, path[1:depth] AS path, sum(saved) AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM ups GROUP BY 1, 2)
SELECT v.first AS conv_id, v.depth, v.parent AS parent_conv_id, v.n AS n_convs, v.n_children,
       s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM valued v JOIN sums s ON s.depth = v.depth AND s.path = v.path
"""


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    judged = rules.judge(docs, rules.learn(docs, read(spark, sf_dir, "labels")))
    return judged.select("doc_id", *rules.BASE, "base_failed", "kept")


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    queries = [
        op1_bpe, op2_quality, op3_fingerprints, op4_jaccard, op5_language, op6_html, op7_suffixes, op8_sharding,
        op9_packing, op10_neighbours, op11_phrases, op12_trie, op13_rules,
    ]
    sql = {"op11_phrases": OP11_SQL, "op12_trie": OP12_SQL}
    sql |= {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {q.__name__: q for q in queries} | {"pipeline": corpus_pipeline.run}, sql
