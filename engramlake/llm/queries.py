"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm.decontaminate import contaminated
from engramlake.llm.exact_dedup import exact_copies
from engramlake.llm.html_extract import extract_main_text
from engramlake.llm.license_scan import BASE, LEAST_SHARE, RARE, STEP, TEMPLATES, phrase_postings, scan_licenses
from engramlake.llm.lm_scoring import score_texts
from engramlake.llm.ngram_join import similar_classes
from engramlake.llm.packing import pack_sequences
from engramlake.llm.quality import score_documents
from engramlake.llm.source_audit import source_divergence
from engramlake.llm.store import keep
from engramlake.llm.token_align import align_tokens
from engramlake.llm.token_output import pieces_of, write_matrices
from engramlake.llm.url_filters import judge_pages
from engramlake.llm.warc import assemble, read_records, write_archives
from engramlake.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"))


QUERIES["op1_ngram_jaccard_join"] = op1_ngram_jaccard_join


def op2_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "id-matrices")
    write_matrices(table(spark, sf_dir, "documents"), folder)
    return pieces_of(spark.read.parquet(folder))


QUERIES["op2_token_id_output"] = op2_token_id_output


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op3_decontamination"] = op3_decontamination
ORACLE["op3_decontamination"] = """WITH words AS (
 SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
 UNION ALL
 SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') FROM benchmark),
shingles AS (
 SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
 FROM words WHERE id IS NOT NULL),
sizes AS (SELECT id AS item_id, count(*) AS item_shingles FROM shingles WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles
FROM shingles d JOIN shingles i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' JOIN sizes ON sizes.item_id = i.id
GROUP BY d.id, i.id HAVING 100 * count(*) >= 80 * any_value(item_shingles)"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_sequences(table(spark, sf_dir, "documents"), lasting=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES["op4_packing"] = op4_packing


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"))


QUERIES["op5_exact_dedup"] = op5_exact_dedup
ORACLE["op5_exact_dedup"] = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
 doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"))


QUERIES["op6_url_filters"] = op6_url_filters


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), folder)
    captures = keep(assemble(keep(read_records(spark, folder, with_payload=False), "records")), "captures")
    page = F.col("metadata_fields.pageId").cast("long")
    rows = captures.select(
        page.alias("page_id"), F.col("capture_id"), F.col("response.refers_to").alias("refers_id"), "payload_bytes", "payload_digest",
        F.col("response.record_type").alias("record_type"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    full = captures.filter("response.refers_to is null").select(F.col("capture_id").alias("refers_id"), page.alias("refers_to"))
    revisits = rows.filter("refers_id is not null").join(full, "refers_id", "left")
    first = rows.filter("refers_id is null").withColumn("refers_to", F.lit(None).cast("long"))
    return revisits.unionByName(first).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op9_warc"] = op9_warc
ORACLE["op9_warc"] = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
 CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM g"""


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op7_quality_classifier"] = op7_quality_classifier


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


QUERIES["op10_html_extraction"] = op10_html_extraction


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES["op8_lm_scoring"] = op8_lm_scoring


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES["op11_source_audit"] = op11_source_audit
ORACLE["op11_source_audit"] = """WITH d AS MATERIALIZED (
 SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
 FROM documents),
c AS MATERIALIZED (SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n, count(*) AS df FROM (
 SELECT k, lang, source, term, count(*) AS n FROM (SELECT k, lang, source, unnest(w) AS term FROM d) GROUP BY ALL) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY lang, term HAVING sum(df) >= 10),
langs AS MATERIALIZED (SELECT l.lang, count(term) AS v, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept ON l.lang = kept.lang GROUP BY l.lang),
groups AS MATERIALIZED (SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (kept.term IS NOT NULL), 0) AS n
 FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c USING (lang, source) LEFT JOIN kept ON kept.lang = g.lang AND kept.term = c.term GROUP BY g.lang, g.source),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.n + 2 * l.v) AS HUGEINT) AS p,
  CAST(1 + 1000000000 * (k.n + 2) // (l.n + 2 * l.v) AS HUGEINT) AS q
 FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
  WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 10"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))


QUERIES["op13_token_alignment"] = op13_token_alignment


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES["op12_license_scan"] = op12_license_scan


def _license_sql() -> str:
    """The scan in SQL, over the same templates."""
    def values(rows):
        return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)

    templates = values((k, label, text, len(phrases)) for k, (label, text, phrases) in enumerate(TEMPLATES))
    keys = values((t, phrase, place) for t, phrase, place in phrase_postings())
    return f"""WITH templates(template, label, notice, needed) AS (VALUES {templates}),
keys(template, phrase, place) AS (VALUES {keys}),
base(phrase, label) AS (VALUES {values(BASE)}),
vocabulary AS (SELECT template, unnest(string_split(notice, ' ')) AS word, generate_subscripts(string_split(notice, ' '), 1) - 1 AS place FROM templates),
d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
seen AS MATERIALIZED (SELECT k, word, p FROM (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d)
 WHERE word IN (SELECT word FROM vocabulary UNION ALL SELECT unnest(string_split(phrase, ' ')) FROM base)),
df AS (SELECT v.word, count(DISTINCT k) AS df FROM (SELECT DISTINCT word FROM vocabulary) v LEFT JOIN seen USING (word) GROUP BY v.word),
ranked AS (SELECT template, word, df, row_number() OVER (PARTITION BY template ORDER BY df, word) AS r FROM (SELECT DISTINCT template, word FROM vocabulary) JOIN df USING (word)),
index AS MATERIALIZED (SELECT v.template, v.word, v.place, CAST(1 + round(1000 * ln(((SELECT count(*) FROM d) + 1) / (df + 1))) AS INTEGER) AS x
 FROM vocabulary v JOIN ranked r ON v.template = r.template AND v.word = r.word AND r <= {RARE}),
phrases AS (SELECT phrase, unnest(string_split(phrase, ' ')) AS word, generate_subscripts(string_split(phrase, ' '), 1) - 1 AS step, len(string_split(phrase, ' ')) AS words
 FROM (SELECT phrase FROM keys UNION SELECT phrase FROM base)),
places AS MATERIALIZED (SELECT k, phrase, p - step AS p FROM seen JOIN phrases USING (word) GROUP BY ALL HAVING count(*) = any_value(words)),
met AS (SELECT DISTINCT k, template, unnest([CAST(floor((p - place) / {STEP}.0) AS BIGINT) - 1, CAST(floor((p - place) / {STEP}.0) AS BIGINT)]) AS band, place AS at, x, 0 AS key FROM seen JOIN index USING (word)
 UNION SELECT DISTINCT k, template, unnest([CAST(floor((p - place) / {STEP}.0) AS BIGINT) - 1, CAST(floor((p - place) / {STEP}.0) AS BIGINT)]), place, 0, 1 FROM places JOIN keys USING (phrase)),
bands AS (SELECT k, template, sum(x) AS x, sum(key) AS found FROM met GROUP BY k, template, band),
judged AS (SELECT k, label, x / (SELECT sum(x) FROM index WHERE index.template = b.template) AS share, found / needed AS verified FROM bands b JOIN templates t ON t.template = b.template),
best AS (SELECT k, max(share * verified) AS best, list(DISTINCT label) FILTER (verified = 1 AND share >= {LEAST_SHARE}) AS labels FROM judged GROUP BY k),
own AS (SELECT k, count(*) AS n, min(p) AS first, max(p) AS last, list(DISTINCT label) AS labels FROM places JOIN base USING (phrase) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(first AS BIGINT) AS first_word, CAST(last AS BIGINT) AS last_word,
 coalesce(array_to_string(list_sort(own.labels), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own.labels, []), coalesce(best.labels, [])))), ','), '') AS labels,
 round(CASE WHEN n > 0 THEN 1.0 ELSE CAST(coalesce(best, 0) AS DOUBLE) END, 6) AS score
FROM d LEFT JOIN own USING (k) LEFT JOIN best USING (k)"""


ORACLE["op12_license_scan"] = _license_sql()
