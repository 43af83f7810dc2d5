"""One query per operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelwatch.llm import bpe, fingerprint, groupjoin, license, lm_score, mix, neardup, phrases, quality, spelling, token_count, toxicity, warc
from modelwatch.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    r"""
    WITH sized AS (
        SELECT row_number() OVER () AS r, doc_id, source,
            coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
        FROM documents
    ), sizes AS (
        SELECT source, sum(size)::BIGINT AS source_size,
            [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
        FROM sized GROUP BY source
    ), levelled AS (
        SELECT *, 2.0::DOUBLE * source_size / weight AS ratio,
            (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER w1, 0)) / sum(weight) OVER w2 AS here
        FROM sizes
        WINDOW w1 AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            w2 AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    ), level AS (SELECT min(ratio) AS first, min_by(here, ratio) AS here FROM levelled WHERE ratio > here),
    targets AS (
        SELECT source, source_size, CASE WHEN ratio >= level.first THEN level.here * weight ELSE 2.0::DOUBLE * source_size END AS target
        FROM levelled, level
    ), laid AS (
        SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY md5('42|' || coalesce(doc_id::VARCHAR, 'null')), doc_id, size, r) - size)::BIGINT AS start
        FROM sized WHERE size > 0
    ), pieces AS (
        SELECT r, source, piece * 2048 AS word, least(2048, size - piece * 2048) AS words, start + piece * 2048 AS begin_
        FROM (SELECT *, unnest(range(0, (size - 1) // 2048 + 1)) AS piece FROM laid)
    ), blocks AS (
        SELECT source, begin_ // 2048 AS block, sum(words) AS words, min(begin_) AS begins FROM pieces GROUP BY ALL
    ), placed AS (
        SELECT *, sum(words) OVER (
            PARTITION BY source ORDER BY md5('42|block|' || coalesce(source, 'null') || '|' || block::VARCHAR), block
        ) - words AS before FROM blocks
    ), drawn AS (
        SELECT p.source, block, begins, round(target)::BIGINT // source_size AS passes,
            greatest(0, least(words, round(target)::BIGINT % source_size - before)) AS part
        FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
    ), taken AS (
        SELECT r, sum(passes * words + greatest(0, least(words, part - (begin_ - begins)))) AS taken
        FROM pieces p JOIN drawn d ON p.source IS NOT DISTINCT FROM d.source AND p.begin_ // 2048 = d.block GROUP BY r
    )
    SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN taken USING (r)
    """
)
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_documents(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH texts AS (
        SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
    ), words AS (
        SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM texts
    ), windows AS (
        SELECT r, i, array_to_string(w[i:i + 7], ' ') AS t FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) > 7)
    ), again AS (
        SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM windows) WHERE n > 1
    ), repeats AS (
        SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM again) GROUP BY r
    ), counted AS (
        SELECT r, doc_id, source, len(w)::BIGINT AS n_words,
            list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars,
            len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
            len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
            coalesce(n, 0)::BIGINT AS n_repeat_words
        FROM words LEFT JOIN repeats USING (r)
    ), ruled AS (
        SELECT *, coalesce(chars, 0) AS word_chars, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
            (10 * n_symbols > n_words)::INT AS a, (2 * n_dup_lines > n_lines)::INT AS b,
            (n_words > 0 AND (coalesce(chars, 0) < 2 * n_words OR coalesce(chars, 0) > 15 * n_words))::INT AS c
        FROM counted
    ), hosts AS (
        SELECT source AS host, count(*) AS n, unnest(['a', 'b', 'c']) AS rule, unnest([sum(a), sum(b), sum(c)]) AS failed FROM ruled GROUP BY source
    ), prior AS (
        SELECT rule, sum(failed)::DOUBLE / sum(n) AS m, count(*)::DOUBLE / sum(n) AS few, sum(failed::DOUBLE * failed / n) / sum(n) AS square FROM hosts GROUP BY rule
    ), strong AS (
        SELECT rule, m, CASE WHEN square - m * m - m * (1 - m) * few > 0
            THEN least(greatest(m * (1 - m) / (square - m * m - m * (1 - m) * few) - 1, 1), 1e6) ELSE 1e6 END AS s FROM prior
    ), known AS (
        SELECT host, max(CASE WHEN rule = 'a' THEN (failed + m * s) / (n + s) END) AS ra,
            max(CASE WHEN rule = 'b' THEN (failed + m * s) / (n + s) END) AS rb,
            max(CASE WHEN rule = 'c' THEN (failed + m * s) / (n + s) END) AS rc
        FROM hosts JOIN strong USING (rule) GROUP BY host
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT (base_failed OR a + b + c >= 2 OR (a = 1 AND ra >= 0.01) OR (b = 1 AND rb >= 0.01) OR (c = 1 AND rc >= 0.01)) AS kept
    FROM ruled JOIN known ON source IS NOT DISTINCT FROM host
    """
)
def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_quality(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH payloads AS (
        SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, ''))::BIGINT AS bytes FROM pages
    ), leads AS (SELECT digest, max(page_id) AS lead FROM payloads WHERE bytes >= 1000 GROUP BY digest)
    SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
        CASE WHEN lead IS NULL OR lead = page_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN lead <> page_id THEN lead END AS refers_to, true AS verified
    FROM payloads LEFT JOIN leads USING (digest)
    """
)
def op5_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


@query()
def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op8_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), shingles AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
    ), sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM shingles GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
    ), links AS (
        SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
    ), reached AS (
        SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
    ), least AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id)
    SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(other, w.doc_id)) AS component_id,
        w.doc_id <= coalesce(other, w.doc_id) AS kept
    FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
    """
)
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    r"""
    WITH words AS (
        SELECT rowid AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
        FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
    ), places AS (
        SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, unnest(list_concat([NULL], w[:-2])) AS before,
            unnest(list_concat([NULL, NULL], w[:-3])[:len(w)]) AS first
        FROM words WHERE len(w) > 0
    ), one AS (SELECT word, count(*) AS c FROM places GROUP BY word),
    two AS (SELECT before, word, count(*) AS c FROM places WHERE before IS NOT NULL GROUP BY before, word),
    three AS (SELECT first, before, word, count(*) AS c FROM places WHERE first IS NOT NULL GROUP BY first, before, word),
    total AS (SELECT count(*) AS n FROM places),
    scored AS (
        SELECT p.r,
            CASE WHEN p.first IS NOT NULL THEN (h.c >= 2)::INT WHEN p.before IS NOT NULL THEN (t.c >= 2)::INT ELSE 0 END AS seen,
            CASE WHEN h.c >= 2 THEN log10(h.c::DOUBLE / f.c)
                 WHEN t.c >= 2 THEN log10(t.c::DOUBLE / b.c) + CASE WHEN p.first IS NOT NULL THEN log10(0.4) ELSE 0 END
                 ELSE log10(a.c::DOUBLE / total.n) + log10(0.4) * ((p.before IS NOT NULL)::INT + (p.first IS NOT NULL)::INT) END AS s
        FROM places p JOIN one a ON a.word = p.word LEFT JOIN one b ON b.word = p.before
        LEFT JOIN two t ON t.before = p.before AND t.word = p.word LEFT JOIN two f ON f.before = p.first AND f.word = p.before
        LEFT JOIN three h ON h.first = p.first AND h.before = p.before AND h.word = p.word CROSS JOIN total
    ), summed AS (SELECT r, sum(seen) AS n_seen, sum(s) AS s FROM scored GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_seen, 0)::BIGINT AS n_seen, round(coalesce(s, 0.0), 4) AS score
    FROM words LEFT JOIN summed USING (r)
    """
)
def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score_documents(table(spark, sf_dir, "documents"))
    return scored.withColumn("score", F.round("score", 4))


@query()
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_documents(table(spark, sf_dir, "documents"))


def _crc_entries() -> list[int]:
    """The remainders of all bytes by the reflected CRC-32 polynomial."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


@query(
    r"""
    WITH RECURSIVE runs AS (
        SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
        FROM documents
    ), per_document AS (SELECT id, run, count(*) AS c, hex(encode(id || ':' || run)) AS code FROM runs GROUP BY id, run
    ), coded AS (
        SELECT run, c, xor(4294967295::BIGINT, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(range(1, length(code) // 2 + 1), lambda i: ('0x' || code[2 * i - 1:2 * i])::BIGINT)),
            lambda a, b: xor(a >> 8, entries[(xor(a, b) & 255) + 1]))) AS h
        FROM per_document, (SELECT ENTRIES::BIGINT[] AS entries)
    ), words AS (
        SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(c)::BIGINT AS n
        FROM coded GROUP BY 1 HAVING sum(c) >= 3 AND length(word) >= 5
    ), shorter AS (
        SELECT DISTINCT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
    ), near AS (
        SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN shorter b ON a.word = b.rest
        UNION SELECT b.word, b.n, a.word, a.n FROM words a JOIN shorter b ON a.word = b.rest
    ), ranked AS (
        SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near
    ), formed AS (
        SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
            CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
        FROM words w LEFT JOIN ranked r ON w.word = r.word AND place = 1
    ), steps AS (
        SELECT word, word AS root FROM formed WHERE form IS NULL
        UNION ALL SELECT f.word, s.root FROM steps s JOIN formed f ON f.form = s.word
    )
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN steps USING (word)
    """.replace("ENTRIES", str(_crc_entries()))
)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    grams AS (
        SELECT lang, k, g, count(*)::BIGINT AS f
        FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM words, range(1, 4) t(k))
        GROUP BY ALL
    ), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
    longer AS (
        SELECT lang, g, max(f) AS most FROM (
            SELECT lang, g[:2] AS g, f FROM grams WHERE k = 3 AND f >= 10 UNION ALL SELECT lang, g[2:], f FROM grams WHERE k = 3 AND f >= 10
        ) GROUP BY lang, g
    ), candidates AS (
        SELECT c.lang, c.k, c.g, c.f FROM grams c LEFT JOIN longer x ON c.lang = x.lang AND c.k = 2 AND c.g = x.g
        WHERE c.k > 1 AND c.f >= 10 AND NOT coalesce(100 * most >= 50 * c.f, false)
    ), cuts AS (
        SELECT c.lang, c.g, c.f AS a, cut, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
        FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
        JOIN grams x ON x.lang = c.lang AND x.g = c.g[:cut] JOIN grams y ON y.lang = c.lang AND y.g = c.g[cut + 1:]
    ), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
    ranked AS (
        SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM lowest
    )
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """
)
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), shingles AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
    ), sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM shingles GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
    ), links AS (
        SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
    ), reached AS (
        SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
    ), least AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id),
    partners AS (SELECT a AS doc_id, count(*)::BIGINT AS n_links FROM links GROUP BY a)
    SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(other, w.doc_id)) AS component_id, coalesce(n_links, 0) AS n_links
    FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id) LEFT JOIN partners USING (doc_id)
    """
)
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groupjoin.jaccard_join(table(spark, sf_dir, "documents"))
