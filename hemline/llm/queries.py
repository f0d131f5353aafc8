"""The queries of the operators in this folder."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemline.llm import audit, common, context_tree, impact_search, jaccard, language, lloyd, order_minhash, packing, phrases, pieces, secrets, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under ``name``."""

    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(common.prepare(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


def documents(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(*(names or ("doc_id", "text")))


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query("op2_sentencepiece")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    both = pieces.decode(pieces.encode(documents(spark, folder), model), model)
    # a mark in a text is a blank after decoding
    same = F.replace("text", F.lit(pieces.MARK), F.lit(" ")) == F.col("decoded")
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), same.alias("round_trip"))


@query("op3_sharding")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_documents(documents(spark, folder))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op4_order_minhash")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.report(documents(spark, folder))


@query(
    "op5_impact_search",
    """
    WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS ints
        FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(embedding) > 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.ints, c.ints)::BIGINT AS score
        FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM scored QUALIFY rank <= 5
    """,
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return impact_search.top_k(vectors, F.col("vec_id") % 50 == 0)


@query("op6_context_tree")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return context_tree.report(documents(spark, folder))


@query(
    "op7_ngram_jaccard",
    r"""
    WITH RECURSIVE cut AS (
        SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents
    ), grams AS MATERIALIZED (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [chr(1) || body] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
               ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
        FROM cut
    ), flat AS MATERIALIZED (
        SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM grams
    ), linked AS MATERIALIZED (
        SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.gram = b.gram AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))
    ), reached AS (
        SELECT doc_id, doc_id AS root FROM documents
        UNION SELECT l.y, r.root FROM reached r JOIN linked l ON r.doc_id = l.x
    )
    SELECT d.doc_id, d.class_id, coalesce(c.links, 0)::BIGINT AS links
    FROM (SELECT doc_id, min(root)::BIGINT AS class_id FROM reached GROUP BY doc_id) d
    LEFT JOIN (SELECT x, count(*) AS links FROM linked GROUP BY x) c ON d.doc_id = c.x
    """,
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.report(documents(spark, folder))


@query("op8_secret_scans")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(secrets.scan(documents(spark, folder)))


@query("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return language.report(documents(spark, folder, "doc_id", "text", "lang"))


def tokenizer_path(name: str) -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op9_best_fit_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(documents(spark, folder), tokenizer_path("word_bpe_49k.json"))


@query(
    "op11_substring_dedup",
    r"""
    WITH cut AS MATERIALIZED (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), begun AS (
        SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS place FROM cut WHERE len(words) >= 20
    ), judged AS (
        SELECT doc_id, place, row_number() OVER (PARTITION BY array_to_string(words[place:place + 19], ' ') ORDER BY doc_id, place) > 1 AS again FROM begun
    ), placed AS (
        SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM cut
    ), covered AS (
        SELECT p.doc_id, p.place, p.word,
               coalesce(bool_or(j.again) OVER (PARTITION BY p.doc_id ORDER BY p.place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
        FROM placed p LEFT JOIN judged j ON p.doc_id = j.doc_id AND p.place = j.place
    ), kept AS (
        SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (WHERE NOT gone) AS body FROM covered GROUP BY doc_id
    )
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
    FROM cut LEFT JOIN kept USING (doc_id)
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    cut = phrases.remove_repeats(documents(spark, folder))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round as two tables: nearest entries, then the entries moved."""

    def nearest(r: int) -> str:
        far = "list_sum(list_transform(list_zip(v.part, b.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        return f"near{r} AS MATERIALIZED (SELECT vec_id, p, min(struct_pack(d := {far}, e := e)) AS best FROM parts v JOIN book{r} b USING (p) GROUP BY vec_id, p)"

    def moved(r: int) -> str:
        return f"""sums{r} AS (
            SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS n
            FROM (SELECT p, best.e AS e, unnest(part) AS x, unnest(range(len(part))) AS i FROM parts JOIN near{r} USING (vec_id, p)) GROUP BY ALL
        ), book{r + 1} AS MATERIALIZED (
            SELECT p, e, coalesce(m.entry, b.entry) AS entry
            FROM book{r} b LEFT JOIN (SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY i) AS entry FROM sums{r} GROUP BY p, e) m USING (p, e)
        )"""

    steps = ", ".join(f"{nearest(r)}, {moved(r)}" for r in range(rounds))
    return f"""
    WITH whole AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v, len(embedding) // {parts} AS w
        FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), parts AS MATERIALIZED (
        SELECT vec_id, p, v[p * w + 1:(p + 1) * w] AS part FROM whole, range({parts}) t(p)
    ), book0 AS MATERIALIZED (
        SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS entry FROM parts QUALIFY e < {entries}
    ), {steps}, {nearest(rounds)}, coded AS (
        SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id
    ), final AS (
        SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
    )
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
    FROM coded JOIN whole USING (vec_id), final
    """


@query("op12_vector_codes", _codes_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return lloyd.compress(spark.read.parquet(f"{folder}/embeddings.parquet")).report()


def _audit_sql() -> str:
    """The flags of every document, then every order by joins."""
    letters = "ABCDE"
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(letters))
    fails = "CASE substr(filter_order, {0}, 1) " + " ".join(f"WHEN '{c}' THEN {c}" for c in letters) + " END"
    earlier = " OR ".join(f"({n} < step AND {fails.format(n)})" for n in range(1, 6))
    failing = " + ".join(f"{c}::INT" for c in letters)
    return f"""
    WITH base AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
        FROM documents
    ), known AS (
        SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
    ), flagged AS (
        SELECT part, len(words) < 200 AS A, 2 * len(list_distinct(words)) < len(words) AS B,
               100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) AS C,
               regexp_matches(body, '[#$%&*|]') AS D,
               coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) AS E,
               coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
        FROM base LEFT JOIN known USING (doc_id)
    ), placed AS (
        SELECT part, filter_order, step, good, toxic, {fails.format("step")} AS fails, {earlier} AS before, {failing} AS failed
        FROM flagged, (VALUES {orders}) o(filter_order), range(1, 6) s(step)
    ), summed AS (
        SELECT part, filter_order, step::INTEGER AS step, count(*) FILTER (WHERE NOT fails AND NOT before) AS kept, count(*) FILTER (WHERE fails AND NOT before) AS removed,
               count(*) FILTER (WHERE fails AND before) AS redundant, count(*) FILTER (WHERE fails AND failed = 1) AS unique_fails,
               count(*) FILTER (WHERE fails AND NOT before AND good) AS good_lost, count(*) FILTER (WHERE fails AND NOT before AND toxic) AS toxic_lost
        FROM placed GROUP BY ALL
    )
    SELECT *, sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1))::BIGINT AS shapley FROM summed
    """


@query("op13_filter_audit", _audit_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "source", "text")
    return audit.audit_documents(docs, spark.read.parquet(f"{folder}/labels.parquet"))


@query(
    "op4_edited_text",
    """
    WITH bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
    beside AS (SELECT *, coalesce(lead(body) OVER (ORDER BY doc_id), first_value(body) OVER (ORDER BY doc_id)) AS next FROM bodies)
    SELECT doc_id, length(body)::BIGINT AS n_chars, sha256(left(body, length(body) - length(body) // 2) || left(next, length(body) // 2)) AS edited_sha256
    FROM beside
    """,
)
def op4_edited(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of op4 that SQL can state."""
    return op4(spark, folder).select("doc_id", "n_chars", "edited_sha256")


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _base_sql() -> str:
    """Spans of the base patterns: each match is marked, and the lengths between the marks are summed."""
    kinds = [("assign", _ASSIGN, f"length(regexp_extract(hit, '{_ASSIGN}', 2)) >= 6"), ("access", "AKIA[A-Z0-9]+", "length(hit) >= 20"), ("hex", "[0-9a-f]+", "length(hit) >= 24")]
    marked = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS nr, '{kind}' AS kind, string_split(regexp_replace(coalesce(text, ''), '{pattern}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS cut FROM documents"
        for i, (kind, pattern, _) in enumerate(kinds)
    )
    holds = " OR ".join(f"(kind = '{kind}' AND {kept})" for kind, _, kept in kinds)
    return f"""
    WITH marked AS ({marked}),
    cut AS (SELECT doc_id, nr, kind, unnest(cut) AS piece, unnest(range(1, len(cut) + 1)) AS place FROM marked),
    placed AS (
        SELECT *, split_part(piece, chr(2), 1) AS hit,
               coalesce(sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY doc_id, nr ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
        FROM cut
    ), kept AS (SELECT * FROM placed WHERE place > 1 AND ({holds})),
    summed AS (
        SELECT doc_id, count(*) FILTER (WHERE nr = 0) AS n_assign, count(*) FILTER (WHERE nr = 1) AS n_access, count(*) FILTER (WHERE nr = 2) AS n_hex,
               string_agg(kind || ':' || start || ':' || (start + length(hit)), ',' ORDER BY start, nr) AS spans
        FROM kept GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256
    FROM documents LEFT JOIN summed USING (doc_id)
    """


@query("op8_base_spans", _base_sql())
def op8_base(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of op8 that SQL can state."""
    return op8(spark, folder).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
