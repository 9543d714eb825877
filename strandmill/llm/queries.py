"""The registered query of each operator, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import decontaminate, dialogue, licenses, mixing, near_dups, quality, sharding, spelling, threshold, tokens, toxicity, url_lists, vptree
from strandmill.llm.tables import cut, table

ENTROPY, REPEATS, SHARDS = 0.9, 2.0, 16


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and wordings of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.license_scan(docs)
    base = F.filter("_found", lambda x: x["base"])
    names = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["start"])
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("_found")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("_found", lambda x: x["share"])), F.lit(0.0)), 6).alias("score"))


def op2_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The emissions of the temperature mixture of all documents' sources."""
    return mixing.mixture(table(spark, sf_dir, "documents"), ENTROPY, REPEATS)


def fetched(pages: DataFrame) -> DataFrame:
    """page_id, url and day of each capture: the table has no fetch time, so a digest of the id deals one."""
    digit = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 4), 16, 10).cast("int")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), digit % 366).alias("day"))


def list_changes(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the table: the digest of a host deals its entries and their days."""
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host")).dropna().distinct()
    parents = hosts.select(F.substring_index("host", ".", -2).alias("host")).distinct()
    named = cut(hosts.select("host", F.lit(False).alias("parent")).unionByName(parents.select("host", F.lit(True).alias("parent"))).withColumn("h", F.md5("host")))
    hexa = lambda a, n: F.conv(F.substring("h", a, n), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    n, d1, d2 = hexa(1, 1), hexa(2, 3) % 200, hexa(2, 3) % 200 + 1 + hexa(5, 2) % 90
    change = lambda test, pattern, action, when: named.where(test).select(pattern.alias("pattern"), F.lit(action).alias("action"), day(when).alias("day"))
    host = F.col("host")
    out = change(n < 8, host, "block", d1).unionByName(change(n < 5, host, "remove", d2)).unionByName(change(n < 2, host, "block", d2 + 30))
    return out.unionByName(change((n > 3) & ~F.col("parent"), F.concat(host, F.lit("/en")), "allow", d1 + 15)).unionByName(
        change((n > 7) & F.col("parent"), host, "block", d1))


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries of its fetch day."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_lists.judge_captures(fetched(pages), list_changes(pages))
    return out.select("page_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("_verdict").alias("verdict"), F.col("_pattern").alias("pattern"),
                      F.date_format("_valid_from", "yyyy-MM-dd").alias("valid_from"), F.date_format("_valid_to", "yyyy-MM-dd").alias("valid_to"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 0.75 between sets of 5-word shingles."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"), F.col("_toxic").cast("int").alias("predicted"))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector; factor 1 makes the search exact."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vptree.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, factor=1.0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    import public_tokenizers

    out = tokens.token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.filter(F.transform("_spans", lambda s: s["item"]), lambda i: i.isNotNull())))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.col("_contaminated").alias("contaminated"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    out = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def text_size() -> tuple:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return F.octet_length(text).cast("long") + 1, F.crc32(text)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    size, crc = text_size()
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), crc.alias("text_crc32")))
    out = sharding.shuffle_to_shards(docs, [F.col(c) for c in docs.columns], SHARDS, docs.count())
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


def op11_exact_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer scores of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return threshold.top_scores(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10, scale=1024.0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation."""
    return dialogue.repair_conversations(dialogue.damaged(table(spark, sf_dir, "conversations")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms that the words of all documents vary."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_license_scan, op2_source_mixture, op3_url_lists, op4_near_duplicates, op5_toxicity, op6_nearest_vectors, op7_token_counts,
    op8_decontamination, op9_quality, op10_sharding, op11_exact_top_scores, op12_conversation_repair, op13_spelling_variants)}

#: Lower case of A-Z alone, and the words between all other ASCII characters.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _license_sql() -> str:
    rows = []
    for base, group in ((True, licenses.BASE), (False, licenses.WORDINGS)):
        for t in group:
            rows += [f"('{t.label}', {str(base).lower()}, {t.share}, {len(t.words)}, {k}, '{w}', {int(k in t.key_at)})" for k, w in enumerate(t.words)]
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
t(label, base, least, n, pos, word, key) AS (VALUES {', '.join(rows)}),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS ix FROM d),
hit AS (SELECT * FROM w WHERE word IN (SELECT word FROM t)),
place AS (
  SELECT r, label, base, ix - pos AS start, count(*) / any_value(n)::DOUBLE AS share
  FROM hit JOIN t USING (word) WHERE ix >= pos GROUP BY r, label, base, ix - pos
  HAVING count(*) / any_value(n)::DOUBLE >= any_value(least)
    AND sum(key) = (SELECT sum(key) FROM t k WHERE k.label = t.label AND k.base = t.base)),
found AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    list_sort(list_distinct(list(label) FILTER (base))) AS bl, list_sort(list_distinct(list(label))) AS al, max(share) AS score
  FROM place GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(al, ','), '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM d LEFT JOIN found USING (r)"""


_MIX_SQL = rf"""WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::BIGINT + 1 AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::DOUBLE AS total FROM d GROUP BY source),
a AS (SELECT sum(total) AS al, max(total) AS most, min(total) AS least, count(*) AS n FROM s),
grid AS (
  SELECT k, ln(sum(pow(total / al, k / {mixing.STEPS}.0))) - k / {mixing.STEPS}.0 * sum(pow(total / al, k / {mixing.STEPS}.0) * ln(total / al)) / sum(pow(total / al, k / {mixing.STEPS}.0)) AS h,
    any_value(ln(n)) AS top, any_value(pow(most / least, 1 - k / {mixing.STEPS}.0)) AS repeats
  FROM s, a, generate_series(0, {mixing.STEPS}) AS g(k) GROUP BY k),
e AS (SELECT CASE WHEN any_value(top) = 0 THEN 1.0 ELSE greatest(max(k) FILTER (h >= {ENTROPY} * top), min(k) FILTER (repeats <= {REPEATS})) / {mixing.STEPS}.0 END AS alpha FROM grid),
p AS (
  SELECT source, total, alpha, pow(total, alpha) / sum(pow(total, alpha)) OVER () AS weight, pow(most / total, 1 - alpha) AS passes FROM s, a, e),
x AS (
  SELECT d.*, p.*, unnest(generate_series(0, floor(passes)::BIGINT)) AS epoch FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
o AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY md5(epoch || ':' || coalesce(doc_id::VARCHAR, '') || ':' || n_tokens)
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)
SELECT doc_id, source, epoch::BIGINT AS epoch, n_tokens, round(weight, 6) AS weight, alpha, (epoch * total + before)::BIGINT AS start_token
FROM o WHERE epoch < floor(passes) OR before < floor((passes - floor(passes)) * total)"""

_URL_SQL = """WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + (('0x' || md5(page_id::VARCHAR)[1:4])::INT % 366) AS day,
    nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host,
    split_part(split_part(split_part(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/', 1), '?', 1), '#', 1) AS seg FROM pages),
hosts AS (
  SELECT host, false AS parent FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)
  UNION ALL SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.'), true FROM p WHERE host IS NOT NULL),
h AS (
  SELECT host, parent, ('0x' || md5(host)[1:1])::INT AS n, ('0x' || md5(host)[2:4])::INT % 200 AS d1,
    ('0x' || md5(host)[2:4])::INT % 200 + 1 + ('0x' || md5(host)[5:6])::INT % 90 AS d2 FROM hosts),
c AS (
  SELECT host AS pattern, 0 AS rank, d1 AS d FROM h WHERE n < 8
  UNION ALL SELECT host, 2, d2 FROM h WHERE n < 5
  UNION ALL SELECT host, 0, d2 + 30 FROM h WHERE n < 2
  UNION ALL SELECT host || '/en', 1, d1 + 15 FROM h WHERE n > 3 AND NOT parent
  UNION ALL SELECT host, 0, d1 FROM h WHERE n > 7 AND parent),
daily AS (SELECT pattern, DATE '2024-01-01' + d AS a, min(rank) AS rank FROM c GROUP BY pattern, d),
iv AS (SELECT pattern, rank, a, lead(a) OVER (PARTITION BY pattern ORDER BY a) AS b FROM daily),
m AS (
  SELECT page_id, url, day, pattern, rank, a, b, row_number() OVER (PARTITION BY page_id, url ORDER BY length(pattern) DESC, pattern DESC) AS k
  FROM p JOIN iv ON (host = pattern OR host LIKE '%.' || pattern OR host || '/' || seg = pattern) AND a <= day AND (b IS NULL OR day < b) AND rank < 2)
SELECT p.page_id, strftime(p.day, '%Y-%m-%d') AS day, CASE rank WHEN 0 THEN 'block' WHEN 1 THEN 'allow' ELSE 'none' END AS verdict, pattern,
  strftime(a, '%Y-%m-%d') AS valid_from, strftime(b, '%Y-%m-%d') AS valid_to
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.url = p.url AND k = 1"""

_NEAREST_SQL = """WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20"""

_BENCH_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least({decontaminate.WINDOW}, len(words)) AS n, array_to_string(words[i: i + least({decontaminate.WINDOW}, len(words)) - 1], ' ') AS win
  FROM b, generate_series(1, (SELECT max(len(words)) FROM b)) AS g(i)
  WHERE len(words) > 0 AND i <= len(words) - least({decontaminate.WINDOW}, len(words)) + 1),
dw AS (
  SELECT r, n, i, array_to_string(words[i: i + n - 1], ' ') AS win
  FROM (SELECT r, words, unnest(generate_series(1, len(words))) AS i FROM d), (SELECT DISTINCT n FROM bw) WHERE i + n - 1 <= len(words)),
hit AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, win)),
w AS (SELECT r, count(DISTINCT ix) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS ix FROM hit) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
FROM d LEFT JOIN w USING (r) LEFT JOIN k USING (r)"""

_TOP_SQL = """WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.e) = 0 THEN 0 ELSE list_inner_product(q.e, c.e) END::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10"""

#: One row: what each byte adds to a crc32 (polynomial in reversed bits).
_CRC_TABLE = """SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"""


def _crc(text: str) -> str:
    """crc32 of the UTF-8 of a text below U+0800, with a column ``t`` of the table at hand."""
    code = "unicode(ch)"
    utf8 = f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN {code} < 128 THEN [{code}] ELSE [192 + ({code} >> 6), 128 + ({code} & 63)] END))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {utf8}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _edit(to: int, source: str, initial: str) -> str:
    """The entry that keeps or reroles the row after the entry ``source``."""
    keep = f"WHEN left(role, 1) = '{initial}' THEN {{'c': {source}.c + late, 'a': {source}.a || 'K', 't': {source}.t || chr(10) || role || ':' || text}}"
    rerole = "" if initial == "s" else f"ELSE {{'c': {source}.c + 1 + late, 'a': {source}.a || 'R', 't': {source}.t || chr(10) || '{dialogue.ROLES.get(to)}:' || text}}"
    return f"CASE WHEN gone OR {source} IS NULL THEN NULL {keep} {rerole} END"


def _repair_sql() -> str:
    drop = lambda s: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + 2, 'a': {s}.a || 'D', 't': {s}.t}} END"
    insert = lambda s, role: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + 5, 'a': {s}.a || 'I', 't': {s}.t || chr(10) || '{role}:'}} END"
    entry = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE tab AS ({_CRC_TABLE}),
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations, tab),
live AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE f WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit)),
k AS (SELECT *, md5(length(role) || ':' || role || text) AS key, rtrim(text, {blanks}) AS trimmed FROM live),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS i FROM k),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two FROM o),
r AS (
  SELECT *, trimmed = '' OR again AS gone, CASE WHEN trimmed <> '' AND NOT again AND right(trimmed, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS late FROM n),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (trimmed = '') AS blank,
    count(*) FILTER (again AND trimmed <> '') AS duplicate, count(*) FILTER (late > 0) AS truncated,
    count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM r GROUP BY conv_id),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, {entry} AS s1, {{'c': 5::BIGINT, 'a': 'I', 't': chr(10) || 'user:'}} AS s2,
    {{'c': 10::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3 FROM counts
  UNION ALL
  SELECT conv_id, i, n0, n1, m2, {least('n3', insert('m2', 'assistant'))} FROM (
    SELECT *, {least('n2', insert('n0', 'user'), insert('n1', 'user'), insert('n3', 'user'))} AS m2 FROM (
      SELECT dp.conv_id, r.i, {drop('s0')} AS n0, {least(drop('s1'), _edit(1, 's0', 's'))} AS n1,
        {least(drop('s2'), _edit(2, 's0', 'u'), _edit(2, 's1', 'u'), _edit(2, 's3', 'u'))} AS n2, {least(drop('s3'), _edit(3, 's2', 'a'))} AS n3
      FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1))),
best AS (
  SELECT dp.conv_id, {least('s0', 's3')} AS e FROM dp JOIN counts ON dp.conv_id IS NOT DISTINCT FROM counts.conv_id AND dp.i = counts.rows)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(substr(e.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id"""


_SPELLING_SQL = f"""WITH RECURSIVE tab AS ({_CRC_TABLE}),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
per_doc AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM per_doc, tab),
noised AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM noised WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM cut a JOIN w ON w.word = a.rest
  UNION SELECT w.word, a.word, a.n FROM cut a JOIN w ON w.word = a.rest),
best AS (SELECT word, count(*) AS n_near, list_min(list({{'m': -m, 'o': other}})) AS b FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 10 * w.n THEN b.o END AS form, CASE WHEN -b.m >= 10 * w.n THEN -b.m END AS form_n
  FROM w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at, form AS beyond FROM formed
  UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN formed f ON f.word = walk.beyond)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk ON walk.word = f.word AND walk.beyond IS NULL"""

SQL: dict[str, str] = {
    "op1_license_scan": _license_sql(), "op2_source_mixture": _MIX_SQL, "op3_url_lists": _URL_SQL, "op6_nearest_vectors": _NEAREST_SQL,
    "op8_decontamination": _BENCH_SQL, "op11_exact_top_scores": _TOP_SQL, "op12_conversation_repair": _repair_sql(),
    "op13_spelling_variants": _SPELLING_SQL}
