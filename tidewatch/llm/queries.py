"""The registered queries of the training-data operators and their DuckDB forms."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontamination, hard_negatives, importance, jaccard_join, language_id, line_dedup, mixing
from tidewatch.llm import quality_classifier, quality_rules, sharding, token_blocks, token_counts, warc
from tidewatch.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score_documents(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict_languages(docs, language_id.fit(docs))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op10_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_row_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.row_shards(table(spark, sf_dir, "documents"))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_language_id": op8_language_id,
    "op9_source_mix": op9_source_mix,
    "op10_token_blocks": op10_token_blocks,
    "op11_row_shards": op11_row_shards,
    "op12_importance_resample": op12_importance_resample,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op3_quality_rules": r"""
        WITH bits AS (SELECT [list_reduce(list_concat([CAST(b AS BIGINT)], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                              FOR b IN range(256)] AS t),
        d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        tok AS (SELECT doc_id, i, w[i] AS word, w[i + 1] AS next FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
        vocab AS (SELECT DISTINCT word FROM tok),
        crc AS (SELECT word, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
                                  [CAST('0x' || substr(hex(encode(word)), 2 * k + 1, 2) AS BIGINT) FOR k IN range(octet_length(encode(word)))]),
                                 lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h FROM vocab, bits),
        gram AS (SELECT doc_id, a.h % 32768 AS bucket FROM tok JOIN crc a ON tok.word = a.word
                 UNION ALL
                 SELECT doc_id, 32768 + (a.h * 40503 + b.h) % 32768 FROM tok JOIN crc a ON tok.word = a.word JOIN crc b ON tok.next = b.word),
        good AS (SELECT DISTINCT doc_id, 1 AS trusted FROM labels WHERE quality = 1),
        cnt AS (SELECT bucket, count(*) AS raw, coalesce(sum(trusted), 0) AS target FROM gram LEFT JOIN good USING (doc_id) GROUP BY 1),
        tot AS (SELECT sum(raw) AS raw_all, sum(target) AS target_all FROM cnt),
        weight AS (SELECT bucket, CASE WHEN target_all = 0 THEN 0
                     ELSE CAST(round(1e6 * (ln(target + 1) - ln(raw + 1) + ln((raw_all + 65536) / (target_all + 65536)))) AS BIGINT) END AS micro FROM cnt, tot),
        score AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_grams, CAST(sum(micro) AS BIGINT) AS score_micro FROM gram JOIN weight USING (bucket) GROUP BY 1),
        line AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM line GROUP BY 1),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY 1),
        base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
                        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                        coalesce(n_grams, 0) AS n_grams, coalesce(score_micro, 0) AS score_micro
                 FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN score USING (doc_id))
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND score_micro >= -200000 * n_grams AS kept
        FROM base""",
    "op4_warc": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first_page FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN f.first_page <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first_page <> d.page_id THEN f.first_page END AS refers_to
        FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100""",
    "op5_line_dedup": r"""
        WITH l AS (SELECT doc_id, i - 1 AS line, s[i] AS x, len(regexp_extract_all(s[i], '[^\x20\x09-\x0D]+')) AS n
                   FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
        w AS (SELECT doc_id, line, x, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos,
                     sum(n) OVER (PARTITION BY doc_id ORDER BY line) AS upto, n FROM l WHERE n > 0),
        win AS (SELECT a.doc_id, a.pos AS first, min(b.pos) AS last FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.n >= 50 GROUP BY 1, 2),
        content AS (SELECT win.doc_id, first, last, string_agg(x, chr(10) ORDER BY pos) AS g FROM win JOIN w ON w.doc_id = win.doc_id AND w.pos BETWEEN first AND last GROUP BY 1, 2, 3),
        seen AS (SELECT *, first_value(doc_id) OVER o AS o_doc, first_value(first) OVER o AS o_first FROM content WINDOW o AS (PARTITION BY g ORDER BY doc_id, first)),
        seed AS (SELECT DISTINCT doc_id, first, o_doc, first - o_first AS shift FROM seen WHERE NOT (doc_id = o_doc AND first = o_first)),
        match AS (SELECT DISTINCT doc_id, o_doc, shift FROM seed),
        equal AS (SELECT m.doc_id, m.o_doc, m.shift, a.pos, a.pos - row_number() OVER (PARTITION BY m.doc_id, m.o_doc, m.shift ORDER BY a.pos) AS island
                  FROM match m JOIN w a ON a.doc_id = m.doc_id JOIN w b ON b.doc_id = m.o_doc AND b.pos = a.pos - m.shift AND b.x = a.x),
        run AS (SELECT doc_id, o_doc, shift, min(pos) AS low, max(pos) AS high FROM equal GROUP BY doc_id, o_doc, shift, island),
        held AS (SELECT DISTINCT run.* FROM run JOIN seed USING (doc_id, o_doc, shift) WHERE seed.first BETWEEN low AND high),
        gone AS (SELECT DISTINCT w.doc_id, w.line FROM held JOIN w ON w.doc_id = held.doc_id AND w.pos BETWEEN low AND high)
        SELECT l.doc_id, count(*) AS n_lines, count(gone.line) AS n_deleted, coalesce(string_agg(CAST(gone.line AS VARCHAR), ',' ORDER BY gone.line), '') AS deleted_lines,
               md5(coalesce(string_agg(x, chr(10) ORDER BY l.line) FILTER (gone.line IS NULL), '')) AS kept_md5
        FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.line = l.line GROUP BY 1""",
    "op6_decontamination": r"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
                FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        occ AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
                FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
        hits AS (SELECT DISTINCT occ.doc_id, occ.i, occ.n, win.item_id FROM occ JOIN win USING (n, g)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
        found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
        SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op7_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS gram
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM common JOIN size sa ON sa.doc_id = a JOIN size sb ON sb.doc_id = b WHERE 10 * c >= 8 * (sa.n + sb.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
        least_id AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY 1),
        links AS (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_grams, class_id, coalesce(n_links, 0) AS n_links
        FROM least_id LEFT JOIN size USING (doc_id) LEFT JOIN links USING (doc_id)""",
    "op11_row_shards": r"""
        WITH bits AS (SELECT [list_reduce(list_concat([CAST(b AS BIGINT)], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                              FOR b IN range(256)] AS t),
        d AS (SELECT doc_id, source, encode(coalesce(text, '')) AS b FROM documents),
        c AS (SELECT doc_id, source, CAST(octet_length(b) + 8 AS BIGINT) AS size,
                     xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST('0x' || substr(hex(b), 2 * k + 1, 2) AS BIGINT) FOR k IN range(octet_length(b))]),
                                     lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
              FROM d, bits),
        keyed AS (SELECT *, CAST('0x' || substr(md5('=11|' || coalesce('=' || doc_id, '-') || '|' || coalesce('=' || source, '-') || '|=' || size || '|=' || text_crc32), 1, 15) AS BIGINT) AS key,
                         CAST('0x' || substr(md5('=11|' || coalesce('=' || source, '-')), 1, 15) AS BIGINT) AS phase FROM c),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST) - 1 AS rank, count(*) OVER (PARTITION BY source) AS source_rows FROM keyed),
        placed AS (SELECT *, row_number() OVER (ORDER BY (rank + CAST(phase AS DOUBLE) / 1152921504606846976.0::DOUBLE) / source_rows, phase, source NULLS FIRST, rank) - 1 AS place,
                          count(*) OVER () AS n FROM ranked)
        SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 24 // n AS INTEGER) AS shard,
               place - ((place * 24 // n) * n + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM placed""",
    "op12_importance_resample": r"""
        WITH bits AS (SELECT [list_reduce(list_concat([CAST(b AS BIGINT)], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                              FOR b IN range(256)] AS t),
        dw AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
               FROM documents),
        bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
        vocab AS (SELECT word FROM dw UNION SELECT word FROM bw),
        crc AS (SELECT word, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
                                  [CAST('0x' || substr(hex(encode(word)), 2 * k + 1, 2) AS BIGINT) FOR k IN range(octet_length(encode(word)))]),
                                 lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM vocab, bits),
        raw AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (word) GROUP BY 1),
        aim AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (word) GROUP BY 1),
        whole AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM bw) AS t_all),
        gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS g
                 FROM raw LEFT JOIN aim USING (bucket), whole),
        weighed AS (SELECT doc_id, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY 1),
        scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                          coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
                   FROM documents LEFT JOIN weighed USING (doc_id)),
        placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)""",
    "op13_hard_negatives": r"""
        WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                          list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
        pair AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.w, b.w) AS BIGINT) AS score
                 FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        pos AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pair WHERE same
                QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT pos.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
               other_id AS negative_id, positive_score, score AS negative_score
        FROM pos JOIN pair ON pair.anchor_id = pos.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, other_id) <= 10""",
}
