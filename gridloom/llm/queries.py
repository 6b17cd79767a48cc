"""The thin queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontamination, importance, language_id, mixing, near_dedup, pii, quality_classifier, quality_rules, sharding, token_counts, topk, toxicity
from gridloom.llm.tables import read


def fold(id_col: str, folds: int) -> Column:
    """The CRC-32 of the id as text, modulo the number of folds."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(fold("doc_id", 5) != 0))
    found = language_id.identify(docs, model, spans=False)
    return found.select(F.col("id").alias("doc_id"), (fold("id", 5) == 0).alias("held_out"), "lang_pred", "score", "n_spans")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(read(spark, sf_dir, "documents"))
    return plan.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(read(spark, sf_dir, "documents"), shingle=4).withColumnRenamed("id", "doc_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(F.col("id").alias("doc_id"), *names)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    known = read(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)
    found = toxicity.score(docs, toxicity.train(docs, known))
    return found.select(F.col("id").alias("doc_id"), (fold("id", 3) == 1).alias("held_out"), "score", "predicted")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    base, every = [[d.kind for d in pii.DETECTORS if d.base or x] for x in (False, True)]
    return found.select(
        F.col("id").alias("doc_id"), *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(pii.listed(*base), 256).alias("base_sha256"), pii.listed(*every).alias("spans"), pii.scored(*every).alias("scores"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    known = read(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2)
    found = quality_classifier.score(docs, quality_classifier.train(docs, known))
    return found.select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "score", "predicted")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumnRenamed("id", "doc_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_near_dedup": op3_near_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_counts": op6_token_counts,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_resampling": op11_resampling,
    "op12_exact_top_k": op12_exact_top_k,
}

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat('mix-1|', coalesce(doc_id::VARCHAR, ''), '|', md5(coalesce(text, '')))), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS coin
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight::DOUBLE, source NULLS LAST) AS k FROM r),
c AS (SELECT *, (SELECT sum(source_size) FROM r) - 3 * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM o),
f AS (SELECT *, weight * rest > 3 * source_size * w AS capped FROM c),
z AS (SELECT (SELECT sum(source_size) FROM r) - 3 * coalesce(sum(source_size) FILTER (WHERE capped), 0) AS rest,
             coalesce(sum(weight) FILTER (WHERE NOT capped), 0) AS w FROM f),
t AS (SELECT f.source, f.source_size,
             CASE WHEN capped THEN 3.0::DOUBLE * source_size::DOUBLE
                  ELSE least(weight::DOUBLE * z.rest::DOUBLE / greatest(z.w, 1)::DOUBLE, 3.0::DOUBLE * source_size::DOUBLE) END AS target
      FROM f, z),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM t),
m AS (SELECT d.doc_id, d.size, p.source_size, p.target, floor(p.rate)::BIGINT + (d.coin < p.rate - floor(p.rate))::BIGINT AS copies
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM m
"""

SPACED = r"[^\x20\x09-\x0D]+"
_KEEP = " AND ".join(
    f"({f'n_words < {r.min_words} OR ' if r.min_words else ''}("
    + " AND ".join(x for x in (f"{r.measure} >= {float(r.low)}::DOUBLE * {r.over}" if r.low is not None else "", f"{r.measure} <= {float(r.high)}::DOUBLE * {r.over}" if r.high is not None else "") if x)
    + "))"
    for r in quality_rules.RULES
)
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
l AS (SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{SPACED}') GROUP BY row),
g AS (SELECT row, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
h AS (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
r AS (SELECT row, count(DISTINCT p) AS n_repeat_words FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM h) GROUP BY row),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
             len(list_filter(w, lambda x: lower(x) IN ({', '.join(f"'{x}'" for x in quality_rules.STOP_WORDS)}))) AS n_stop,
             length(regexp_replace(text, '\\P{{Lu}}', '', 'g')) AS n_upper
      FROM d LEFT JOIN l USING (row) LEFT JOIN r USING (row)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_KEEP} AS kept FROM b
"""

LETTERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = f"translate(coalesce(text, ''), '{decontamination.UPPER}', '{decontamination.LOWER}')"
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '{LETTERED}') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{LETTERED}') AS w FROM benchmark) WHERE len(w) > 0),
b AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
s AS (SELECT DISTINCT n FROM b),
g AS (SELECT row, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, s)),
h AS (SELECT DISTINCT row, n, k, item FROM g JOIN b USING (n, g)),
c AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(k, k + n)) AS p FROM h) GROUP BY row),
t AS (SELECT row, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN t USING (row)
"""

#: As the detectors' patterns, with a captured character for what they look behind at; (kind, before, match, after).
_PII = (
    ("email", "", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", ""),
    ("ip", "", "[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)", ""),
    ("card", "", "[0-9](?:[ -]?[0-9])+", ""),
    ("phone", "", "[+][0-9][ ().0-9-]+[0-9]", ""),
    ("iban", "^|[^A-Za-z0-9]", "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", ""),
    ("ssn", "^|[^0-9-]", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[^0-9-]|$"),
    ("secret", "^|[^A-Za-z0-9_-]", "[A-Za-z0-9_-]{20,}", ""),
)
_LENGTHS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in pii.IBAN_LENGTHS.items()) + "}"
_FOUND = " UNION ALL ".join(
    f"SELECT row, text, '{kind}' AS kind, {k} AS ord, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', 1) AS a, regexp_extract_all(text, '{p}', 2) AS v, regexp_extract_all(text, '{p}', 3) AS z, string_split_regex(text, '{p}') AS g FROM d WHERE regexp_matches(text, '{p}')"
    for k, (kind, p) in enumerate((kind, f"({before})({match})({after})") for kind, before, match, after in _PII)
)
#: (kind, score, what a context word adds, context words).
_SCORES = " ".join(
    f"WHEN '{kind}' THEN {score} + CASE WHEN regexp_matches(near, '{words}') THEN {more} ELSE 0 END"
    for kind, score, more, words in (
        ("email", 0.9, 0.1, "mail|contact|write"), ("ip", 0.8, 0.1, "address|host|server|login"), ("card", 0.8, 0.1, "card|visa|credit|pay"),
        ("phone", 0.7, 0.1, "phone|tel|call|mobil"), ("iban", 0.9, 0.4, "iban|account|bank|konto"), ("ssn", 0.4, 0.4, "ssn|social|security"), ("secret", 0.4, 0.4, "token|secret|key|passw"),
    )
)
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({_FOUND}),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
s AS (SELECT row, kind, ord, v[i] AS v, lower(right(g[i] || a[i], 48) || ' ' || left(z[i] || g[i + 1], 48)) AS near, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + length(a[i]))::BIGINT AS start FROM e),
t AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS digits, element_at({_LENGTHS}, v[1:2])[1] AS n FROM s),
u AS (SELECT *, CASE WHEN kind <> 'iban' THEN length(v)
                     WHEN length(replace(v[1:n], ' ', '')) = n AND NOT regexp_matches(v[n + 1:n + 1], '[A-Z0-9]') THEN n
                     WHEN length(replace(v[1:n + (n - 1) // 4], ' ', '')) = n AND NOT regexp_matches(v[n + (n - 1) // 4 + 1:n + (n - 1) // 4 + 1], '[A-Z0-9]') THEN n + (n - 1) // 4 END AS size FROM t),
w AS (SELECT *, replace(v[1:size], ' ', '') AS c FROM u WHERE size IS NOT NULL),
x AS (SELECT *, round(100 * least(1, CASE kind {_SCORES} END))::INT AS score FROM w WHERE CASE kind
        WHEN 'email' THEN true
        WHEN 'ip' THEN list_max(list_transform(string_split(v, '.'), lambda x: x::DOUBLE)) <= 255
        WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, length(digits)), lambda k: digits[length(digits) - k]::INT * (1 + k % 2) - CASE WHEN digits[length(digits) - k]::INT * (1 + k % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0
        WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
        WHEN 'iban' THEN list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(c[5:] || c[1:4], ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN x ELSE (ascii(x) - 55)::VARCHAR END), ''), ''), lambda x: x::INT), lambda a, b: (a * 10 + b) % 97) = 1
        WHEN 'ssn' THEN NOT regexp_matches(v, '^(?:000|666|9)|-00-|-0000$') AND regexp_matches(near, 'ssn|social|security')
        ELSE length(v) <= 128 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(near, 'token|secret|key|passw') END),
r AS (SELECT row, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
             string_agg(concat(kind, ':', start, ':', start + size), ',' ORDER BY ord, start) FILTER (WHERE ord < 4) AS base, string_agg(concat(kind, ':', start, ':', start + size), ',' ORDER BY ord, start) AS spans,
             string_agg(score::VARCHAR, ',' ORDER BY ord, start) AS scores FROM x GROUP BY row)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN r USING (row)
"""

#: The CRC-32 of a feature's bytes, with the table made by its rule: eight shifts of each byte under the reversed polynomial.
OP11_SQL = f"""
WITH x AS MATERIALIZED (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crc FROM (SELECT unnest(range(256)) AS b)),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, 0 AS mark, list_filter(regexp_extract_all({_LOWER}, '{LETTERED}'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT -row_number() OVER () AS row, NULL::BIGINT AS doc_id, 1 AS mark, regexp_extract_all({_LOWER}, '{LETTERED}') AS w FROM benchmark),
e AS (SELECT row, mark, w, unnest(range(1, len(w) + 1)) AS i FROM (FROM d UNION ALL FROM b)),
f AS MATERIALIZED (SELECT row, mark, array_to_string(w[i:i + n - 1], ' ') AS f FROM e, (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w)),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
k AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, v: xor(c >> 8, crc[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, x),
g AS MATERIALIZED (SELECT row, mark, bucket FROM f JOIN k USING (f)),
c AS (SELECT bucket, count(*) FILTER (WHERE mark = 0) AS s, count(*) FILTER (WHERE mark = 1) AS t FROM g GROUP BY bucket),
z AS (SELECT coalesce(sum(s), 0)::BIGINT AS s_all, coalesce(sum(t), 0)::BIGINT AS t_all FROM c),
v AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM c, z),
w AS (SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM g JOIN v USING (bucket) WHERE mark = 0 GROUP BY row),
n AS (SELECT row, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             ('0x' || substr(sha256(concat('42:', coalesce(doc_id::VARCHAR, ''))), 1, 8))::BIGINT::DOUBLE AS h FROM d LEFT JOIN w USING (row)),
m AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM n),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS many FROM m WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * many // 100 THEN rank END AS rank FROM m LEFT JOIN r USING (row)
"""

OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, c.row AS other, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
      FROM v q JOIN v c ON q.row <> c.row AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST, other)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""

ORACLE: dict[str, str] = {
    "op2_mixing": OP2_SQL,
    "op4_quality_rules": OP4_SQL,
    "op8_decontamination": OP8_SQL,
    "op10_pii": OP10_SQL,
    "op11_resampling": OP11_SQL,
    "op12_exact_top_k": OP12_SQL,
}
