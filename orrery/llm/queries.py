"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .change_applier import apply_changes
from .decontaminate import find_contamination, n_hit
from .divergence import audit_sources
from .html_extract import extract_pages
from .jaccard_join import similarity_groups
from .language_id import identify_documents, identify_pages
from .line_dedup import dedup_lines
from .lm_score import score_documents
from .mixing import mix_sources, taken_words
from .quality import apply_rules, fit_quality
from .sentence_pieces import decode_texts, encode_texts
from .storage import shared_folder
from .substring_dedup import dedup_substrings
from .token_files import token_digests, write_tokens


def tokenizer_path(name: str) -> str:
    """Of a public tokenizer that every machine has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_groups(table(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs, fit_quality(docs, table(spark, sf_dir, "labels"))).drop("text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return token_digests(spark, path)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return out.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op7_near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches beside the exact ones of op7_benchmark_decontamination, whose SQL names its columns."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10).select("doc_id", "n_near", "near")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By words, pairs and triples, all of them."""
    return score_documents(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "detected_lang", "confidence", "text_lang", F.col("accepted").alias("kept"))


def op8_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table beside the documents of op8_language_id: here markup, address suffix and host are evidence too."""

    def save(df: DataFrame) -> DataFrame:
        path = shared_folder(spark, "page-texts")
        df.drop("html").write.parquet(path)
        return spark.read.parquet(path)

    out = identify_pages(extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")), F.col("text"), save)
    return out.select("page_id", "detected_lang", "confidence", "text_lang", F.col("accepted").alias("kept"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    encoded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    out = decode_texts(encoded, path)
    return out.select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.xxhash64("tokens").alias("ids_xxhash64"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))).alias("round_trip"),
    )


def op11_change_applier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_changes(table(spark, sf_dir, "client_changes"), batches=12, start_day=19723, days=160, patience=3)


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=(3, 2), most=2)
    return mix.select("doc_id", "size", "source_size", "target", taken_words().alias("taken"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"), least=30, top=50)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_files": op5_token_files,
    "op6_html_extraction": op6_html_extraction,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op7_near_matches": op7_near_matches,
    "op8_language_id": op8_language_id,
    "op8_page_language": op8_page_language,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_change_applier": op11_change_applier,
    "op12_source_mixing": op12_source_mixing,
    "op13_source_divergence": op13_source_divergence,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
dup AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM dup),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP2_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sh AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (
    SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
e AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x AS a, x AS b FROM e UNION SELECT r.a, e.y FROM reach r JOIN e ON e.x = r.b),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.m, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""

OP4_SQL = r"""
WITH l AS (SELECT doc_id, unnest(s) AS line, unnest(range(1, len(s) + 1)) AS i
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_LOW = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_LOW} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_LOW} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS k, least(10, len(w)) AS n
       FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""

# Every quotient is ranked, and words before a position are counted without spans. Blocks of 64 words, shards of 262144, seed 'mix'.
OP12_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len({_WORDS}), 0)::BIGINT AS size, md5('mix|' || doc_id) AS h FROM documents),
s AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, source) AS i
      FROM (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM d GROUP BY source)),
t AS (SELECT sum(source_size)::BIGINT AS total FROM s),
p AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS held,
             sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS free FROM s),
c AS (SELECT i AS first_free, 3 * total::DOUBLE / 2 - held AS rest, free AS others FROM p, t WHERE NOT (2 * source_size * free < (3 * total::DOUBLE / 2 - held) * w) ORDER BY i LIMIT 1),
src AS (SELECT source, source_size, CASE WHEN i < first_free THEN (2 * source_size)::DOUBLE ELSE rest * w / others::DOUBLE END AS target,
               greatest(1, (source_size + 262143) // 262144) AS shards FROM s, c),
x AS (SELECT d.*, source_size, target, ('0x' || substr(h, 9, 8))::BIGINT % shards AS shard FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
cell AS (SELECT source, shard, sum(size)::BIGINT AS words, (sum(size)::BIGINT + 63) // 64 AS n FROM x GROUP BY ALL),
room AS (SELECT source, 2 * sum(n)::BIGINT AS room FROM cell GROUP BY source),
q1 AS (SELECT source, unnest(range(room)) AS k FROM room),
w1 AS (SELECT source, count(*) AS seats FROM
        (SELECT q1.source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, q1.source NULLS FIRST, k) AS r FROM q1 JOIN src ON q1.source IS NOT DISTINCT FROM src.source), t
       WHERE r <= (6 * total + 128) // 256 GROUP BY source),
q2 AS (SELECT source, shard, words, unnest(range(2 * n)) AS k FROM cell),
w2 AS (SELECT r.source, shard, count(*) AS quota FROM
        (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY words / (2 * k + 1) DESC, shard, k) AS r FROM q2) r JOIN w1 ON r.source IS NOT DISTINCT FROM w1.source
       WHERE r <= seats GROUP BY ALL),
e AS (SELECT cell.source, cell.shard, n, coalesce(quota, 0) // greatest(n, 1) AS passes, coalesce(quota, 0) % greatest(n, 1) AS m,
             ('0x' || substr(md5('mix|' || coalesce(cell.source, '') || '|' || cell.shard), 1, 8))::BIGINT % greatest(n, 1) AS u
      FROM cell LEFT JOIN w2 ON cell.source IS NOT DISTINCT FROM w2.source AND cell.shard = w2.shard),
l AS (SELECT x.*, n, passes, m, u, (sum(size) OVER (PARTITION BY x.source, x.shard ORDER BY h, doc_id))::BIGINT AS b
      FROM x JOIN e ON x.source IS NOT DISTINCT FROM e.source AND x.shard = e.shard),
f AS (SELECT *, b - size AS a FROM l)
SELECT doc_id, size, source_size, target,
       (passes * size + CASE WHEN n = 0 THEN 0 ELSE
          64 * ((((b // 64) * m + u) // n) - (((a // 64) * m + u) // n))
          + (b % 64) * (((b // 64 + 1) * m + u) // n - ((b // 64) * m + u) // n) - (a % 64) * (((a // 64 + 1) * m + u) // n - ((a // 64) * m + u) // n) END)::BIGINT AS taken
FROM f
"""

# Every group has every term of its language here.
OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
           FROM documents),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL),
ln AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL),
ls AS (SELECT lang, sum(n) AS total FROM n GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS c,
             1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v.v) AS p,
             1 + (1000000000::HUGEINT * (ln.n + 5)) // (ls.total + 5 * v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN ln USING (lang, term) JOIN ls USING (lang)
      LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source AS g, y.source AS h, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
           ON f.lang = a.lang AND f.g = a.source AND f.h = b.source),
every AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every
QUALIFY part = 'pair' OR rank <= 50
"""

ORACLE_SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op2_ngram_jaccard_join": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op12_source_mixing": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
