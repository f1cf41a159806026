"""The corpus operators on the given tables, with production parameters, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, audit, decontam, identifiers, langid, linededup, minhash, mixing, quality, sharding, substrings, warczip, wavelet
from .common import WORD, keep, table

#: SQL pieces that the twins share.  DuckDB's character class needs no escapes of its own.
SQL_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_NUMBER = "('0x' || substr(md5({0}), 1, {1}))::BIGINT"
_KEY = "CASE WHEN {0} IS NULL THEN 'n' ELSE 's' || {0}::VARCHAR END"

QUERIES: dict = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            TWINS[name] = sql
        return fn

    return register


def n_words(text) -> F.Column:
    """Number of words of a text, 0 for null: white space ends words, so they are counted at their ends."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, {_KEY.format('source')} AS k, len({SQL_WORDS.format('text')})::BIGINT AS size,
                  {_NUMBER.format(_KEY.format('doc_id'), 8)} % 4096 AS bucket FROM documents),
s AS (SELECT source, k, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY 1, 2),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::BIGINT AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS remaining, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS weights
      FROM w WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT remaining, weights FROM l WHERE cap * weights >= remaining * w ORDER BY cap / w, weights DESC LIMIT 1),
t AS (SELECT source, k, source_size, least(cap::DOUBLE, coalesce((w * f.remaining)::DOUBLE / f.weights::DOUBLE, cap::DOUBLE)) AS target
      FROM w LEFT JOIN f ON true),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216) ELSE 0 END::BIGINT AS rate,
             {_NUMBER.format("'mix|' || k", 6)} AS u FROM t),
p AS (SELECT doc_id, size, source_size, target, rate, u, row_number() OVER (PARTITION BY d.k ORDER BY size, bucket, doc_id NULLS FIRST) AS i
      FROM d JOIN r ON d.k = r.k)
SELECT doc_id, size, source_size, target, (((u + i * rate) // 16777216 - (u + (i - 1) * rate) // 16777216) * size)::BIGINT AS taken FROM p
"""


@query("op1_mix_sources", MIX_SQL)
def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("words"))
    mixed = mixing.mix_sources(keep(docs, "sizes"), F.col("words"), F.lit(0))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


LINES_SQL = """
WITH l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(ls[i], '[^\\x20\\x09-\\x0D]')),
d AS (SELECT line, length(line) AS n, min((doc_id, pos)) AS first FROM l GROUP BY 1),
c AS (SELECT line, n, first, m, (m - 1) // 2 AS h FROM (SELECT *, unnest([n, n + 1]) AS m FROM d WHERE n >= 20)),
x AS (SELECT a.line AS u, b.line AS v, a.first AS fu, b.first AS fv FROM c a JOIN c b ON a.m = b.m AND a.line[1:a.h] = b.line[1:b.h] AND a.first < b.first
      UNION SELECT a.line, b.line, a.first, b.first FROM c a JOIN c b ON a.m = b.m AND right(a.line, a.m - 1 - a.h) = right(b.line, b.m - 1 - b.h) AND a.first < b.first),
g AS (SELECT DISTINCT v AS line FROM x WHERE levenshtein(u, v) <= 1),
r AS (SELECT l.doc_id, l.pos FROM l JOIN d ON l.line = d.line LEFT JOIN g ON g.line = l.line WHERE g.line IS NOT NULL OR (l.doc_id, l.pos) > d.first),
a AS (SELECT doc_id, count(*) AS c, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS p FROM r GROUP BY 1)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(a.c, 0)::BIGINT AS n_removed,
       coalesce(a.p, '') AS removed_lines
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
"""


@query("op3_line_dedup", LINES_SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS last FROM p),
b AS (SELECT *, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (g * 5 + 1)::INT, 5))::BIGINT >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to FROM b
"""


@query("op2_warc_zip", WARC_SQL)
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warczip.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SUBSTRING_SQL = f"""
WITH w AS (SELECT doc_id, {SQL_WORDS.format('text')} AS w FROM documents),
x AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM w WHERE len(w) >= 13),
h AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + 12], ' ')) AS f FROM x),
r AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(generate_series(i, i + 12)) AS j FROM h WHERE f < doc_id) GROUP BY 1),
k AS (SELECT w.doc_id, w, coalesce(gone, []) AS gone FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(w, lambda v, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM k
"""


@query("op4_repeated_passages", SUBSTRING_SQL)
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.repeated_passages(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0), lambda n, s: n + s["end"] - s["first"]).cast("long")
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op5_decontaminate")
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_shard")
def shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    done = sharding.shard(docs, F.col("doc_id"), F.struct("text_crc32", "size").cast("string"))
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {SQL_WORDS.format('text')} AS w FROM d),
x AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM x),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY 1),
c AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, string_split(text, chr(10)) AS all_lines,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= 3 * n_words AND 2 * n_dup_lines <= len(all_lines) AS kept
FROM f
"""


@query("op7_quality_rules", QUALITY_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.cascade(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return done.select("doc_id", *quality.COUNTS, failed.alias("base_failed"), "kept")


NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT m.a AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, m.a = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.a
"""


@query("op9_near_duplicates", NEAR_SQL)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, per_cent=85)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_token_index")
def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_index(table(spark, sf_dir, "documents"), F.xxhash64("text"), default_tokenizer())


@query("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    done = langid.predict(docs.select("doc_id", "text"), net)
    return done.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op11_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the plain matches; ``spans`` and ``n_hidden`` have the disguised ones too."""
    done = identifiers.identifiers(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    n = [count(k) for k in identifiers.KINDS]
    hidden = (F.size("spans") - F.size(base)).cast("long").alias("n_hidden")
    return done.select("doc_id", *n, F.sha2(identifiers.digest(base), 256).alias("base_sha256"), identifiers.digest(F.col("spans")).alias("spans"), hidden)


AUDIT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {SQL_WORDS.format('text')} AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic,
             (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS f
      FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
x AS (SELECT unnest(range(5)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda i: substr('ABCDE', i::INT + 1, 1)), '') AS filter_order, step, 1 << o[step]::INT AS bit,
             coalesce(list_sum(list_transform(o[1:step - 1], lambda i: 1 << i::INT)), 0)::INT AS before FROM o, (SELECT unnest(generate_series(1, 5))::INT AS step)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (f & (before | bit) = 0) AS kept, sum(n) FILTER (f & before = 0 AND f & bit <> 0) AS removed,
             sum(n) FILTER (f & before <> 0 AND f & bit <> 0) AS redundant, sum(n) FILTER (f = bit) AS unique_fails,
             sum(good) FILTER (f & before = 0 AND f & bit <> 0) AS good_lost, sum(toxic) FILTER (f & before = 0 AND f & bit <> 0) AS toxic_lost
      FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r
"""


@query("op12_filter_audit", AUDIT_SQL)
def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align(table(spark, sf_dir, "documents"), default_tokenizer(), str(public_tokenizers.path("piece_bpe_32k.model")))
