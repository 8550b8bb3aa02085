"""The registered query of each operator, over its whole table with production parameters, and its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_work_dir
from . import decontaminate, divergence, embeddings, lattice, line_dedup, pieces, quality, repeats, simhash, token_files, url_filters, vector_codes, warc
from .common import LOWER, UPPER, configure, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(configure(spark), sf_dir)
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _lower(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{LOWER}')"


@query(f"""WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents), keyed AS (
    SELECT *, {_lower(f"trim(line, {SPACE})")} AS key FROM lines), repeated AS (
    SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3), marked AS (
    SELECT doc_id, pos, line, last_doc IS NOT NULL AND doc_id <> last_doc AS gone FROM keyed LEFT JOIN repeated USING (key))
    SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""")
def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = line_dedup.LineIndex.empty(spark).insert(docs)
    return index.deduplicate(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op2_subword_lattice(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality.fold(folds=7) == 2
    scored = lattice.score(docs, ~held_out, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.withColumn("held_out", held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op3_spaced_seeds(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op4_cross_polytope(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query()
def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.judged(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (quality.fold() == 0).alias("held_out"), "score", "predicted")


@query()
def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op7_repeats(spark, sf_dir):
    left = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op8_token_files(spark, sf_dir):
    path = new_work_dir(spark, "token-files")
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    read = token_files.read_tokens(spark, path, manifest)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query()
def op9_pieces(spark, sf_dir):
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


_HOST = _lower("regexp_extract(rest, '^[^/?#]*')")
_LITERALS = "regexp_matches(host || path, '{}')"


@query(f"""WITH parts AS (
    SELECT page_id, coalesce({_HOST}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM (
        SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) END AS rest FROM pages)), fitted AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
        WHEN regexp_matches(host || path, '/advert(/|\\z)|(^|\\.)adserver\\.|/wp-login\\.php\\z|(^|[.-])casino[.-]|(?i:\\.(zip|exe))\\z') THEN 'block'
        ELSE 'allow' END AS verdict FROM fitted""")
def op10_url_filters(spark, sf_dir):
    judged = url_filters.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


@query(f"""WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents), found AS (
    SELECT doc, lang, source, {_lower("unnest(regexp_extract_all(text, '" + _LETTERS + "'))")} AS term FROM docs), terms AS (
    SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT doc) >= 3), sums AS (
    SELECT lang, count(*)::HUGEINT AS kept, sum(n)::HUGEINT AS total FROM terms GROUP BY lang), counts AS (
    SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN terms USING (lang, term) GROUP BY ALL), groups AS (
    SELECT lang, source, coalesce(max(kept), 0) AS kept, coalesce(sum(n), 0)::HUGEINT AS total
    FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN sums USING (lang) LEFT JOIN counts USING (lang, source) GROUP BY ALL), shares AS (
    SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.kept) AS p,
        1 + 1000000000::HUGEINT * (t.n + 1) // (s.total + s.kept) AS q
    FROM groups g JOIN terms t USING (lang) JOIN sums s USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term), apart AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL), items AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q)
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM items QUALIFY part = 'pair' OR rank <= 200""")
def op11_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))


def _code_sql(rounds: int) -> str:
    """The rounds of vector codes, one after the other: each a nearest entry per part, then the floors of the means."""
    near = """near{i} AS (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
        SELECT p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS d FROM parts p JOIN book{i} b USING (part, pos) GROUP BY ALL) GROUP BY ALL)"""
    means = """mean{i} AS (SELECT part, entry, pos, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
        FROM parts JOIN near{i} USING (vec_id, part) GROUP BY ALL), book{k} AS (
        SELECT part, entry, pos, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN mean{i} m USING (part, entry, pos))"""
    steps = [near.format(i=i) + ", " + means.format(i=i, k=i + 1) for i in range(rounds)] + [near.format(i=rounds)]
    return f"""WITH kept AS (
        SELECT vec_id, label, embedding FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), flat AS (
        SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS place, len(embedding) // 8 AS width FROM kept), parts AS (
        SELECT vec_id, place // width AS part, place % width AS pos, CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM flat), firsts AS (
        SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 16), book0 AS (
        SELECT part, entry, pos, x FROM parts JOIN firsts USING (vec_id)), {", ".join(steps)}, coded AS (
        SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id), digest AS (
        SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM coded JOIN kept USING (vec_id), digest"""


@query(_code_sql(vector_codes.ROUNDS))
def op12_vector_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    codes, books = vector_codes.compress(rows, ["vec_id", "label"])
    return vector_codes.with_label_error(codes, "label").select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


@query("""WITH bodies AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS size FROM pages), marked AS (
    SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS last FROM bodies)
    SELECT page_id, size::BIGINT AS payload_bytes, sha1(body) AS payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN last <> page_id THEN last END AS refers_to FROM marked""")
def op13_warc(spark, sf_dir):
    path = new_work_dir(spark, "archives")
    files = warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, files, payloads=False)

    def page(name):
        return F.regexp_extract(name, r"^urn:page:(-?\d+)$", 1).try_cast("long")

    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
