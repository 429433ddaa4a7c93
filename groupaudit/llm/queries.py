"""Registered queries of the operators; ``SQL`` has those that DuckDB can express."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groupaudit.llm import (
    backoff_lm,
    best_fit,
    decontaminate,
    elias_fano,
    exact_topk,
    histogram_pack,
    language,
    periodic_runs,
    simhash,
    surrogates,
    token_counts,
    url_templates,
    vector_codes,
)
from groupaudit.llm.common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query(
    "op1_exact_top_k",
    """
    WITH v AS (
        SELECT vec_id, max(embedding) AS embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
    i AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM v),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda j: q.e[j] * c.e[j])) AS BIGINT) AS score
        FROM i q JOIN i c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
    """,
)
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 50 == 0)


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return elias_fano.token_file_index(spark, docs, path=public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.best_fit_pack(table(spark, sf_dir, "documents"), path=public_tokenizers.path("word_bpe_49k.json"))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, path=public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.language_id(docs).select("doc_id", "held_out", "lang_pred", "score")


@query("op3_simhash_components")
def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents")).drop("group")


@query("op7_benchmark_decontamination")
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_pii_surrogates")
def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.pseudonymise(docs, key="audit-2026")


RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


@query("op5_url_templates")
def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_templates.template_verdicts(table(spark, sf_dir, "pages"), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


@query(
    "op6_backoff_scores",
    r"""
    WITH t AS (
        SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\r\f\x0B]+'), lambda w: w <> '') AS w
        FROM documents),
    g AS (
        SELECT doc_id, w[i] AS h, CASE WHEN i > 1 THEN w[i - 1] END AS before
        FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
    one AS (SELECT h, count(*) AS n FROM g GROUP BY h),
    two AS (SELECT before, h, count(*) AS n FROM g WHERE before IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
    seen AS (
        SELECT two.before, two.h, CAST(round(ln(two.n / one.n) * 1000000) AS BIGINT) AS s
        FROM two JOIN one ON two.before = one.h),
    lone AS (
        SELECT h, CAST(round(ln(n / CAST((SELECT count(*) FROM g) AS DOUBLE)) * 1000000) AS BIGINT)
                  + CAST(round(ln(0.4) * 1000000) AS BIGINT) AS s FROM one),
    e AS (
        SELECT g.doc_id, 1 AS k, coalesce(seen.s, lone.s) AS s
        FROM g LEFT JOIN seen ON g.before = seen.before AND g.h = seen.h JOIN lone ON g.h = lone.h
        UNION ALL SELECT doc_id, 0, 0 FROM t)
    SELECT doc_id, CAST(sum(k) AS BIGINT) AS n_words, CAST(sum(s) AS BIGINT) AS log_score FROM e GROUP BY doc_id
    """,
)
def op6_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.backoff_scores(table(spark, sf_dir, "documents"))


@query("op11_shortest_pack_first")
def op11_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return histogram_pack.histogram_pack(docs, path=public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


def planted_repeats(doc_id: Column, text: Column) -> Column:
    """Text whose end, in every tenth document by checksum, repeats its own words periodically."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    h = F.crc32(doc_id.cast("string"))

    def repeated(w: Column, g: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
        rest = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), rest), " ")

    # one-element arrays bind the words and the number once
    new = F.transform(F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g"))), lambda s: F.when(F.size(s["w"]) > 0, repeated(s["w"], s["g"])))
    return F.when(h % 10 == 0, F.coalesce(new[0], text)).otherwise(text)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.periodic_runs(docs, text=planted_repeats(F.col("doc_id"), F.col("text")))
    longer = lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), longer)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _code_rounds(rounds: int) -> str:
    """Assignment and means of every round, as tables a0, c1, a1, ... over parts p and first entries c0."""
    distance = "CAST(coalesce(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), 0) AS BIGINT)"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
    a{r} AS (
        SELECT rid, part, min({{'d': d, 'e': e}}) AS best
        FROM (SELECT rid, part, e, {distance} AS d FROM p JOIN c{r} USING (part)) GROUP BY rid, part)""")
        if r < rounds:
            steps.append(f"""
    m{r} AS (
        SELECT part, e, list(m ORDER BY i) AS c FROM (
            SELECT part, e, i, CAST(floor(sum(y) / count(*)) AS BIGINT) AS m FROM (
                SELECT part, best.e AS e, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS i FROM a{r} JOIN p USING (rid, part))
            GROUP BY part, e, i)
        GROUP BY part, e),
    c{r + 1} AS (SELECT part, e, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (part, e))""")
    return ",".join(steps)


@query(
    "op13_vector_codes",
    f"""
    WITH v AS (
        SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
               list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (
        SELECT rid, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] AS x
        FROM (SELECT rid, v, unnest(range(0, 8)) AS part FROM v)),
    c0 AS (SELECT part, rid - 1 AS e, x AS c FROM p WHERE rid <= 16),
    {_code_rounds(6)},
    n AS (
        SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
        FROM a6 GROUP BY rid),
    s AS (
        SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, e, i)) AS codebooks_sha256
        FROM (SELECT part, e, unnest(c) AS y, unnest(range(0, len(c))) AS i FROM c6))
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM v JOIN n USING (rid) CROSS JOIN s
    """,
)
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = 8
    coded, books = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"), parts=parts)
    cuts = vector_codes.part_slices(books.shape[1], parts)
    listed = ",".join(str(x) for c in cuts for entry in books[:, c].tolist() for x in entry)
    sha = hashlib.sha256(listed.encode()).hexdigest()
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
