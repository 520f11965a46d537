"""One query per operator over its whole table, with the SQL oracles that exist."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    byte_pairs, merkle, multiset_hash, packing, pieces, pii, simhash, span_dedup, suffix_dedup,
    topk, toxicity, url_rules, whitening,
)
from ledgerloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    return packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without repeated runs of three sentences.

    A sentence counts as several if it has more than sixteen words.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return span_dedup.dedup(docs).select(
        "doc_id", "n_sentences", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op2_sentence_span_dedup"] = """
WITH ended AS (
    SELECT doc_id, string_split(regexp_replace(coalesce(text, ''),
        '([.!?]+ +|\\n+)', '\\1' || chr(1), 'g'), chr(1)) AS parts
    FROM documents
), cut AS (
    SELECT doc_id, list_filter(flatten(list_transform(parts, lambda x: string_split(
        regexp_replace(x, '((?: *[^ \\n]+ +){16})', '\\1' || chr(1), 'g'), chr(1)))),
        lambda x: x <> '') AS pieces
    FROM ended
), plain AS (
    SELECT doc_id, pieces, list_transform(pieces, lambda x: lower(trim(x, ' ' || chr(10)))) AS bare
    FROM cut
), places AS (
    SELECT doc_id, unnest(range(0, len(bare) - 2)) AS place, bare FROM plain
), spans AS (
    SELECT doc_id, place, array_to_string(bare[place + 1 : place + 3], chr(10)) AS span FROM places
), repeated AS (
    SELECT doc_id, place FROM (
        SELECT doc_id, place,
               row_number() OVER (PARTITION BY span ORDER BY doc_id, place) AS number FROM spans)
    WHERE number > 1
), gone AS (
    SELECT DISTINCT doc_id, place + step AS place
    FROM repeated, (SELECT unnest([0, 1, 2]) AS step)
), numbered AS (
    SELECT doc_id, unnest(pieces) AS piece, unnest(range(0, len(pieces))) AS place FROM cut
), rest AS (
    SELECT n.doc_id, sum(CASE WHEN g.place IS NOT NULL THEN 1 ELSE 0 END) AS n_removed,
           coalesce(string_agg(CASE WHEN g.place IS NULL THEN n.piece END, '' ORDER BY n.place), '')
               AS kept
    FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.place = g.place
    GROUP BY n.doc_id
)
SELECT c.doc_id, CAST(len(c.pieces) AS BIGINT) AS n_sentences,
       CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(r.kept, '')) AS kept_sha256
FROM cut c LEFT JOIN rest r ON c.doc_id = r.doc_id
"""


@query
def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.fold() == 0).alias("held_out"), "score", "predicted")


@query
def op4_association_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return url_rules.judged(table(spark, sf_dir, "pages"))


@query
def op5_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, its edited text, and their likeness."""
    made = multiset_hash.with_edited(table(spark, sf_dir, "documents"))
    fp, edited = F.col("fp"), F.col("edited_fp")
    return made.select(
        "doc_id", "n_chars", "edited_sha256", multiset_hash.as_string(fp).alias("fingerprint"),
        multiset_hash.as_string(edited).alias("edited_fingerprint"),
        multiset_hash.likeness(fp, edited).alias("near_edited"),
        multiset_hash.likeness(fp, F.col("next_fp")).alias("near_next"))


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op6_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the text that they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pieces.encode(docs, model, decoded=True)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"),
        F.crc32(F.array_join("ids", " ").cast("binary")).alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])

    def count(number: int, kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == number)).cast("long") \
            .alias(f"n_{kind}")

    counts = [count(i, kind) for i, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256)
                        .alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without strings of 50 bytes of earlier ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup(docs, digest=True, keep=["doc_id"])


@query
def op10_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth vector among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


ORACLES["op10_exact_top_k_search"] = """
WITH valid AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))
        AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(range(1, len(q.vector) + 1),
                lambda i: q.vector[i] * c.vector[i])) AS BIGINT) AS score
    FROM valid q JOIN valid c ON q.vec_id <> c.vec_id AND len(q.vector) = len(c.vector)
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, and whether a tampered text still leads to the root."""
    docs = table(spark, sf_dir, "documents")
    manifest = merkle.build(docs, changed=merkle.lower_cased(docs))
    found = merkle.proofs(manifest, lambda x: F.coalesce(x["changed"], x["digest"]), ("changed",))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                        "verified")


def _merkle_sql(levels: int = 8) -> str:
    """The levels of both trees one after another: enough for 16 ** levels rows of a source."""
    def fields(text: str) -> str:
        return " || ".join(f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
                           for x in (*merkle.FIELDS[:-1], text))

    # the checksum by its eight steps for each byte
    steps = "xor(crc, ascii(digit)::BIGINT)"
    for _ in range(8):
        steps = (f"list_transform([{steps}], lambda c: xor(c >> 1, "
                 "CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))[1]")
    checksum = ("xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: d), "
                f"lambda crc, digit: {steps}, 4294967295::BIGINT), 4294967295)")
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str) -> str:
        """Levels and runs of siblings over the table ``name0``."""
        return ",".join(f"""
{name}{i + 1} AS (
    SELECT tree, pos // 16 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest,
           (any_value(n) + 15) // 16 AS n
    FROM {name}{i} WHERE n > 1 GROUP BY tree, pos // 16
), {name}_runs{i} AS (
    SELECT tree, pos // 16 AS run, list(digest ORDER BY pos) AS nodes
    FROM {name}{i} WHERE n > 1 GROUP BY tree, pos // 16
)""" for i in range(levels))

    def roots(name: str) -> str:
        return " UNION ALL ".join(
            f"SELECT tree, digest FROM {name}{i} WHERE n = 1" for i in range(levels + 1))

    def folds(name: str, before: str, key: str) -> str:
        out = []
        for i in range(levels):
            left, right = (f"array_to_string(r.nodes[{x}], '')"
                           for x in ("1:f.spot % 16", "f.spot % 16 + 2:16"))
            out.append(f"""
{name}_folded{i} AS (
    SELECT f.* REPLACE (
        f.spot // 16 AS spot,
        CASE WHEN r.run IS NULL THEN f.proof ELSE f.proof || {left} || {right} END AS proof,
        CASE WHEN r.run IS NULL THEN f.fold ELSE sha256({left} || f.fold || {right}) END AS fold)
    FROM {before} f LEFT JOIN {name}_runs{i} r
        ON r.tree IS NOT DISTINCT FROM f.{key} AND r.run = f.spot // 16
)""")
            before = f"{name}_folded{i}"
        return ",".join(out)

    return f"""
WITH hashed AS (
    SELECT doc_id, source AS tree, sha256({fields("text")}) AS digest,
           CASE WHEN {checksum} % 5 = 0 THEN sha256({fields(lower)}) END AS changed
    FROM documents
), leaf0 AS (
    SELECT *, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER (
        PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos
    FROM hashed
),{tree("leaf")}, subroots AS ({roots("leaf")}), top0 AS (
    SELECT 0 AS tree, tree AS source, digest, count(*) OVER () AS n,
           row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS pos
    FROM subroots
),{tree("top")}, roots AS ({roots("top")}), started AS (
    SELECT doc_id, tree, 0 AS over, digest AS leaf, pos AS spot, '' AS proof,
           coalesce(changed, digest) AS fold
    FROM leaf0
),{folds("leaf", "started", "tree")}, turned AS (
    SELECT f.* REPLACE (t.pos AS spot), t.digest AS subroot
    FROM leaf_folded{levels - 1} f JOIN top0 t ON t.source IS NOT DISTINCT FROM f.tree
),{folds("top", "turned", "over")}
SELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256,
       fold AS folded_root, fold = r.digest AS verified
FROM top_folded{levels - 1}, roots r
"""


ORACLES["op11_merkle_manifest"] = _merkle_sql()


@query
def op12_speculative_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    file = public_tokenizers.path("byte_bpe_50k.json")
    done = byte_pairs.encode(docs, file, decoded=True, keep=["doc_id"])
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's whitened components; deviations beyond 64 bits are null."""
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.select("vec_id", "component", "n",
                        F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened",
                        "explained", "identity_error")
