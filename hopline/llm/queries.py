"""The registered queries of the operators, one per operator, over the whole of their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopline.llm import ann, bpe, chat, clustering, credentials, divergence, mixing, pieces, ppm, simhash, syncmers, toxicity, urlrules
from hopline.llm.common import hex64, table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


#: verdict, host, path
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
#: A conversation whose texts look like control strings.
ODD_TEXT = "\\### Assistant: </turn> ok"


def op1_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.digests(credentials.scan(table(spark, sf_dir, "documents")))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TEXT).alias("text"))
    return chat.digests(chat.format_chats(rows.unionByName(odd)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.predict(table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urlrules.judge(table(spark, sf_dir, "pages"), rules)


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_edited(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=3, top=200)


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"), clusters=40, rounds=5, dims=64, scale=256, salt="2:")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_credentials, op2_chat, op3_toxicity, op4_mixing, op5_neighbours, op6_simhash, op7_language, op8_urls,
        op9_syncmers, op10_bpe, op11_pieces, op12_divergence, op13_clusters)}


def chat_sql() -> str:
    """The digests from the rows themselves; formatted_chars adds up the template's parts."""
    escaped = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"
    turn, text, following, end = (len(x) for x in (chat.TURN, chat.TEXT, chat.NEXT, chat.END))
    return f"""
    WITH r AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, t.n, t.r, '{ODD_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) t(n, r)
    ), o AS (
        SELECT *, row_number() OVER w AS n, lag(role) OVER w AS previous FROM r
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
    ), x AS (
        SELECT *, length({escaped.format("text")}) + CASE WHEN previous IS NULL OR previous <> role
            THEN {turn} + length({escaped.format("role")}) + {text} + {end} ELSE {following} END AS chars FROM o
    )
    SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM x GROUP BY conv_id"""


def urls_sql() -> str:
    """Every rule tried on every page, the longest first."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rules = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in rules)
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in rules)
    return f"""
    WITH u AS (
        SELECT page_id,
            translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{letters}', '{letters.lower()}') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
        FROM pages
    ), f AS (SELECT *, CASE {fits} END AS rule FROM u)
    SELECT page_id, host, path, rule, coalesce(CASE rule {verdicts} END, 'allow') AS verdict FROM f"""


def divergence_sql() -> str:
    """Every kept term in every pair of groups, absent ones too."""
    return r"""
    WITH d AS (
        SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents
    ), w AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
    c AS MATERIALIZED (SELECT lang, source, term, count(*) AS c, count(DISTINCT doc) AS docs FROM w GROUP BY ALL),
    k AS MATERIALIZED (SELECT lang, term, CAST(sum(c) AS HUGEINT) AS c FROM c GROUP BY ALL HAVING sum(docs) >= 3),
    v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(c) AS n FROM k GROUP BY ALL),
    g AS MATERIALIZED (SELECT lang, source, coalesce(sum(c.c) FILTER (WHERE k.term IS NOT NULL), 0) AS n
        FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN k USING (lang, term) GROUP BY ALL),
    p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
            1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + v.v) AS p, 1 + (1000000000::HUGEINT * (k.c + 1)) // (v.n + v.v) AS q
        FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
        WHERE x.term IS NULL OR y.term IS NOT NULL GROUP BY ALL),
    vals AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs
        UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE c > 0 AND p > q),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM vals)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200"""


def clusters_sql(clusters: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> str:
    """Every vector against every centroid, round by round; a row a component for the means."""
    ctes = [f"""k AS MATERIALIZED (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale}.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {dims} AND list_count(embedding) = {dims}
            AND NOT list_contains(list_transform(embedding, lambda x: isfinite(x)), false)
    ), c0 AS MATERIALIZED (
        SELECT CAST(row_number() OVER (ORDER BY sha256('{salt}' || vec_id), v) - 1 AS INTEGER) AS cluster, v FROM k
        ORDER BY cluster LIMIT {clusters}
    )"""]
    for r in range(rounds + 1):
        ctes.append(f"""d{r} AS MATERIALIZED (
        SELECT vec_id, v, min((distance, cluster)) AS best FROM (
            SELECT k.vec_id, k.v, c.cluster,
                list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
            FROM k CROSS JOIN c{r} c) GROUP BY vec_id, v
    ), a{r} AS MATERIALIZED (SELECT vec_id, v, best[2] AS cluster, best[1] AS distance FROM d{r})""")
        if r < rounds:
            ctes.append(f"""m{r} AS (
        SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {dims + 1})) AS i) GROUP BY ALL
    ), c{r + 1} AS MATERIALIZED (
        SELECT c{r}.cluster, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
            SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM m{r} GROUP BY cluster) m USING (cluster)
    )""")
    return f"""WITH {", ".join(ctes)}
    SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator; the tests hold the others against brute force."""
    return {"op2_chat": chat_sql(), "op8_urls": urls_sql(), "op12_divergence": divergence_sql(), "op13_clusters": clusters_sql()}
