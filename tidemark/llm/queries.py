"""One query for each operator, over its whole table with production parameters, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format, conversation_repair, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, packing, periodic_runs, secret_scan, substring_dedup, token_counts, url_filter

TOKENIZER, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; it is installed at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary(TOKENIZER))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), vocabulary(PIECES))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.first_lines(read(spark, sf_dir, "documents"))


def dated_list(hosts: DataFrame) -> DataFrame:
    """A list by rule, as the tables have none: entries for hosts, domains and first path segments, dated by their letters."""
    mark = "(ascii(substring(p, 3, 1)) * 131 + ascii(substring(p, 5, 1)) * 17 + length(p) * 7)"
    host = hosts.select("host").where("host <> ''").distinct().withColumnRenamed("host", "p")
    domain = host.selectExpr("concat(split_part(p, '.', -2), '.', split_part(p, '.', -1)) AS p").where("p not like '.%'").distinct()
    path = hosts.selectExpr("concat(host, '/', split_part(path, '/', 2)) AS p").where("p not like '/%' and p not like '%/'").distinct()
    p = host.where(f"{mark} % 3 < 2").unionByName(domain.where(f"{mark} % 7 = 1")).unionByName(path.where(f"{mark} % 5 = 0"))
    turns = [("add", 5, 400, 0), ("remove", 11, 500, 30), ("add", 3, 730, 200)]
    days = ", ".join(f"struct('{a}' AS action, date_add(date'2024-01-01', CAST({mark} * {k} % {m} + {b} AS int)) AS day)" for a, k, m, b in turns)
    return p.selectExpr("p AS pattern", f"inline(array({days}))")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as captures over two years, judged by a dated list made from their own hosts."""
    pages = read(spark, sf_dir, "pages").selectExpr("page_id", "url", "date_add(date'2024-01-01', CAST(page_id * 7919 % 730 AS int)) AS fetched_on")
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    return url_filter.judge(pages, dated_list(hosts))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` in which about every tenth text repeats a stretch of its words up to its end, by a checksum of doc_id. A null doc_id has none."""
    word = F.lit(r"[^\x20\x09-\x0D]+")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.withColumns({"_h": h, "_w": F.when(h % 10 == 0, F.regexp_extract_all("text", word, F.lit(0)))}).withColumn("_n", F.nullif(F.size("_w"), F.lit(0)))
    rows = rows.withColumn("_a", F.expr("_h div 10 % _n")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _h div 10 % 8)"))
    begin, unit = F.slice("_w", F.lit(1), F.col("_a").cast("int")), F.slice("_w", (F.col("_a") + 1).cast("int"), F.col("_p").cast("int"))
    times = F.expr("CAST((_n - _a + _p - 1) div _p AS int)")
    tail = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), (F.col("_n") - F.col("_a")).cast("int"))
    said = F.when(F.coalesce(F.col("_n") > 0, F.lit(False)), F.array_join(F.concat(begin, tail), " ")).otherwise(F.col("text"))
    return rows.withColumn("text", said).drop("_h", "_w", "_n", "_a", "_p")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of each document, and digests of all its runs and of what is left without the repeats."""
    found = periodic_runs.periodic_runs(with_planted_runs(read(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("q"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.n")).alias("length"), F.col("best.q").alias("period"),
        F.expr("-best.n * 1000 div best.q").alias("exponent_milli"), digest(told).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the turns and of the texts under the loss, read back from the windows of each conversation; one more conversation holds the marks themselves."""
    marks = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = chat_format.read_back(chat_format.format_conversations(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    said = back.select("conv_id", "first_turn", "n_turns", turns.alias("t"), F.array_join("targets", "").alias("x"), F.length("formatted").cast("long").alias("chars"))
    whole = said.groupBy("conv_id").agg(F.sum("n_turns").cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("first_turn", "t", "x"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    joined = lambda c: F.array_join(F.transform("w", lambda w: w[c]), "")
    told = whole.select("conv_id", "n_turns", joined("t").alias("t"), joined("x").alias("x"), "formatted_chars")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return told.select("conv_id", "n_turns", digest("t").alias("turns_sha256"), F.length("x").cast("long").alias("loss_chars"), digest("x").alias("loss_sha256"), "formatted_chars")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by a checksum of conversation and turn: rows left out, emptied, cut, repeated, or of another role. Nulls are one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    times = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    rows = rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("_copy"))
    return rows.drop("_copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least cost, audit and the repaired text's digest of each damaged conversation."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.Repaired(damaged(rows))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = rows.select(F.col("conv_id").alias("conv")).distinct().unionByName(found.report(), allowMissingColumns=True).unionByName(found.digests(), allowMissingColumns=True)
    told = parts.groupBy(F.col("conv").alias("conv_id")).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.max("repaired_sha256").alias("d"))
    return told.select("conv_id", *counts, "audit", F.coalesce("d", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_counts": op4_token_counts,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontamination": op9_decontamination,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_chat_format": op12_chat_format,
    "op13_conversation_repair": op13_conversation_repair,
}

_ASSIGN, _ACCESS, _HEX = secret_scan.ASSIGN.replace("'", "''"), "AKIA[A-Z0-9]+", "[0-9a-f]{24,}"

# formatted_chars follows from where windows begin, which SQL can't fold; tests/llm compares it with a loop. So there is no SQL for op12.
ORACLE_SQL: dict[str, str] = {
    "op7_url_filter": r"""
        WITH u AS (
            SELECT page_id, DATE '2024-01-01' + CAST(page_id * 7919 % 730 AS INT) AS day,
                lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 1)) AS host,
                regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 2) AS path FROM pages),
        p AS (SELECT p, ascii(substring(p, 3, 1)) * 131 + ascii(substring(p, 5, 1)) * 17 + length(p) * 7 AS m, kind FROM (
            SELECT DISTINCT host AS p, 1 AS kind FROM u WHERE host <> ''
            UNION ALL SELECT DISTINCT split_part(host, '.', -2) || '.' || split_part(host, '.', -1), 2 FROM u WHERE host LIKE '%.%'
            UNION ALL SELECT DISTINCT host || '/' || split_part(path, '/', 2), 3 FROM u WHERE host <> '' AND split_part(path, '/', 2) <> '')),
        e AS (SELECT p, unnest([1, 0, 1]) AS on_, unnest([m * 5 % 400, m * 11 % 500 + 30, m * 3 % 730 + 200]) AS n FROM p
            WHERE kind = 1 AND m % 3 < 2 OR kind = 2 AND m % 7 = 1 OR kind = 3 AND m % 5 = 0),
        d AS (SELECT p, DATE '2024-01-01' + CAST(n AS INT) AS day, min(on_) AS on_ FROM e GROUP BY ALL),
        -- the last entry up to the day of the capture says whether the pattern is on the list
        a AS (SELECT page_id, p, arg_max(on_, d.day) AS on_, u.day AS day FROM u JOIN d ON d.day <= u.day
            AND (u.host = p OR u.host LIKE '%.' || p OR (u.host || regexp_replace(u.path, '/+$', '') || '/') LIKE p || '/%') GROUP BY page_id, p, u.day),
        -- listed since: the first entry that adds it after the last one that removes it
        b AS (SELECT a.page_id, a.p, (SELECT min(x.day) FROM d x WHERE x.p = a.p AND x.on_ = 1 AND x.day <= a.day AND x.day > coalesce(
            (SELECT max(y.day) FROM d y WHERE y.p = a.p AND y.on_ = 0 AND y.day <= a.day), DATE '1900-01-01')) AS since FROM a WHERE on_ = 1),
        c AS (SELECT page_id, count(*) AS n, first(p ORDER BY length(p) DESC, p) AS pattern, first(since ORDER BY length(p) DESC, p) AS since FROM b GROUP BY page_id)
        SELECT u.page_id, host, c.page_id IS NOT NULL AS blocked, pattern, since, coalesce(n, 0) AS n_patterns FROM u LEFT JOIN c USING (page_id)""",
    "op3_secret_scan": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        f AS (
            SELECT doc_id, 1 AS k, 'assign' AS kind, 6 AS least, string_split_regex(t, '{_ASSIGN}') AS s, regexp_extract_all(t, '{_ASSIGN}') AS h, regexp_extract_all(t, '{_ASSIGN}', 2) AS v FROM d
            UNION ALL SELECT doc_id, 2, 'access', 20, string_split_regex(t, '{_ACCESS}'), regexp_extract_all(t, '{_ACCESS}'), regexp_extract_all(t, '{_ACCESS}') FROM d
            UNION ALL SELECT doc_id, 3, 'hex', 24, string_split_regex(t, '{_HEX}'), regexp_extract_all(t, '{_HEX}'), regexp_extract_all(t, '{_HEX}') FROM d
            UNION ALL SELECT doc_id, 4, 'ident', 20, string_split_regex(t, 'A(?:SIA|ROA|IDA)[A-Z0-9]+'), regexp_extract_all(t, 'A(?:SIA|ROA|IDA)[A-Z0-9]+'), regexp_extract_all(t, 'A(?:SIA|ROA|IDA)[A-Z0-9]+') FROM d
            UNION ALL SELECT doc_id, 5, 'secret', 40, string_split_regex(t, '[A-Za-z0-9/+]{{40,}}'), regexp_extract_all(t, '[A-Za-z0-9/+]{{40,}}'), regexp_extract_all(t, '[A-Za-z0-9/+]{{40,}}') FROM d
            UNION ALL SELECT doc_id, 6, 'endpoint', 11, string_split_regex(t, 'https?://[A-Za-z0-9.-]+(?::[0-9]+)?'), regexp_extract_all(t, 'https?://[A-Za-z0-9.-]+(?::[0-9]+)?'), regexp_extract_all(t, 'https?://[A-Za-z0-9.-]+(?::[0-9]+)?') FROM d),
        g AS (SELECT doc_id, k, kind, least, unnest(range(1, len(h) + 1)) AS i, unnest(list_transform(s[:len(h)], lambda x: length(x))) AS b, unnest(list_transform(h, lambda x: length(x))) AS n, unnest(list_transform(v, lambda x: length(x))) AS v FROM f),
        x AS (SELECT doc_id, k, kind, CAST(sum(b + n) OVER w - n AS BIGINT) AS s, CAST(sum(b + n) OVER w AS BIGINT) AS e, v, least FROM g WINDOW w AS (PARTITION BY doc_id, k ORDER BY i)),
        y AS (SELECT * FROM x WHERE CASE WHEN k = 5 THEN v = 40 ELSE v >= least END),
        z AS (SELECT * FROM y WHERE k <= 3 OR (
            NOT EXISTS (SELECT 1 FROM y o WHERE o.doc_id = y.doc_id AND o.k <= 3 AND o.s < y.e AND y.s < o.e)
            AND (k = 5 OR EXISTS (SELECT 1 FROM y o WHERE o.doc_id = y.doc_id AND (o.k, o.s) <> (y.k, y.s) AND o.k IN (1, 3, 5) AND greatest(o.s, y.s) - least(o.e, y.e) <= 400))
            AND (k = 4 OR EXISTS (SELECT 1 FROM y o WHERE o.doc_id = y.doc_id AND (o.k, o.s) <> (y.k, y.s) AND o.k IN (2, 4) AND greatest(o.s, y.s) - least(o.e, y.e) <= 400)))),
        r AS (SELECT doc_id, count(*) FILTER (k = 1) AS a, count(*) FILTER (k = 2) AS c, count(*) FILTER (k = 3) AS h, count(*) FILTER (k > 3) AS n,
            string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k <= 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM z GROUP BY doc_id)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0) AS n_linked
        FROM d LEFT JOIN r USING (doc_id)""",
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
}
