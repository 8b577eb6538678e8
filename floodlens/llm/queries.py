"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.llm import (
    boosted_quality,
    bpe,
    hmm_lm,
    line_dedup,
    near_dup,
    packing,
    quality_rules,
    quotations,
    spelling,
    substring_dedup,
    token_alignment,
    toxic_spans,
    topk_search,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors for every twentieth vector."""
    return topk_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the learned decision list on every document."""
    return quality_rules.judge(_table(spark, sf_dir, "documents"),
                               _table(spark, sf_dir, "labels"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into pieces and packed into sequences of 4096 tokens."""
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"),
                                       _vocabulary("word_bpe_49k.json")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that every document loses to passages of documents with smaller ids."""
    kept = substring_dedup.dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed",
                       F.coalesce(F.sha2("kept_text", 256), "digest").alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every document loses to runs of three lines or ten words seen earlier."""
    docs = _table(spark, sf_dir, "documents")
    return line_dedup.dedup(docs).select(
        "doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"),
        F.md5("kept_text").alias("kept_md5"))


def _crc_is(divisor: int, remainder: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % divisor == remainder


def op7_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document; every seventh id by CRC is held out of the training."""
    return hmm_lm.score(_table(spark, sf_dir, "documents"), _crc_is(7, 2))


def op8_chat_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations found again from what the messages of `conversations` quote."""
    messages = quotations.quoting_messages(_table(spark, sf_dir, "conversations"))
    return quotations.conversations(messages).select(
        "msg_id", "sent", "parent_id", "thread_id", "depth", "n_quoted",
        F.md5("own_text").alias("own_md5"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; every fifth id by CRC is held out of the fit."""
    return boosted_quality.score(_table(spark, sf_dir, "documents"),
                                 _table(spark, sf_dir, "labels"), _crc_is(5, 0))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with the form and the root it goes back to."""
    return spelling.group(_table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with the number of spans it comes from and where the first
    begins; every third id by CRC is held out of the fit."""
    return toxic_spans.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"),
                             _crc_is(3, 1)).select(
        "doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"),
        F.get(F.col("spans.start"), F.lit(0)).alias("first_start"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two vocabularies that cover the same bytes, for every document."""
    return token_alignment.align(_table(spark, sf_dir, "documents"),
                                 _vocabulary("byte_bpe_50k.json"),
                                 _vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query for query in (
        op1_topk_search, op2_quality_rules, op3_near_dup, op4_packing, op5_substring_dedup, op6_line_dedup,
        op7_hmm_lm, op8_chat_quotations, op9_quality_classifier,
        op10_bpe, op11_spelling_variants, op12_toxicity, op13_token_alignment,
    )
}

#: DuckDB statements for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op11_spelling_variants": """
        WITH RECURSIVE runs AS (
            SELECT doc_id, run, count(*) AS times, hex(concat(doc_id, ':', run)) AS h
            FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text,
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
                FROM documents)
            WHERE length(run) >= 7 GROUP BY ALL),
        sums AS (  -- CRC-32 bit by bit: after each byte eight shifts, marked by -1
            SELECT run, times, xor(4294967295, list_reduce([4294967295] || [
                CASE WHEN i % 9 = 0 THEN CAST('0x' || substr(h, 2 * (i // 9) + 1, 2) AS BIGINT)
                ELSE -1 END FOR i IN range(9 * length(h) // 2)],
                lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
                    ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) AS crc
            FROM runs),
        words AS (
            SELECT CASE WHEN crc % 31 > 0 THEN run ELSE concat(
                substr(run, 1, crc % length(run)), substr(run, crc % length(run) + 2)) END AS word,
                CAST(sum(times) AS BIGINT) AS n
            FROM sums GROUP BY 1 HAVING length(word) >= 7 AND sum(times) >= 2),
        holes AS (
            SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS less
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
        shorter AS (SELECT DISTINCT h.word AS a, h.n AS a_n, w.word AS b, w.n AS b_n
            FROM holes h JOIN words w ON w.word = h.less),
        near AS (
            SELECT a, b, b_n FROM shorter UNION ALL SELECT b, a, a_n FROM shorter UNION ALL
            SELECT x.word, y.word, y.n FROM holes x JOIN holes y
            ON x.less = y.less AND x.i = y.i AND x.word <> y.word),
        best AS (
            SELECT a AS word, count(*) AS n_near, max(b_n) AS most,
                arg_min(b, (-b_n, b)) AS form FROM near GROUP BY a),
        found AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near,
                CASE WHEN most >= 10 * n THEN form END AS form,
                CASE WHEN most >= 10 * n THEN most END AS form_n
            FROM words LEFT JOIN best USING (word)),
        ways AS (
            SELECT word, form AS root FROM found WHERE form IS NOT NULL
            UNION ALL SELECT w.word, f.form FROM ways w JOIN found f ON f.word = w.root
            WHERE f.form IS NOT NULL),
        lasts AS (
            SELECT w.word, w.root FROM ways w JOIN found f ON f.word = w.root
            WHERE f.form IS NULL)
        SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n
        FROM found LEFT JOIN lasts USING (word)""",
    "op8_chat_quotations": """
        WITH RECURSIVE turns AS (
            SELECT DISTINCT conv_id, turn, text, concat_ws('-', conv_id, turn,
                substr(md5(concat_ws('|', role, text)), 1, 16)) AS msg_id
            FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        firsts AS (SELECT conv_id, turn, arg_min(text, msg_id) AS quoted FROM turns GROUP BY ALL),
        messages AS (
            SELECT msg_id, t.conv_id * 4294967296 + t.turn AS sent, concat(
                '> > ' || replace(b.quoted, chr(10), chr(10) || '> > ') || chr(10),
                '> ' || replace(a.quoted, chr(10), chr(10) || '> ') || chr(10),
                CASE WHEN a.quoted IS NOT NULL THEN chr(10) END, text) AS text
            FROM turns t
            LEFT JOIN firsts a ON a.conv_id = t.conv_id AND a.turn = t.turn - 1
            LEFT JOIN firsts b ON b.conv_id = t.conv_id AND b.turn = t.turn - 2),
        raw AS (
            SELECT msg_id, sent, unnest(string_split(text, chr(10))) AS raw,
                generate_subscripts(string_split(text, chr(10)), 1) AS n FROM messages),
        lines AS (
            SELECT msg_id, sent, n, len(regexp_replace(
                regexp_extract(raw, '^((?:[ \\t]*>)+)', 1), '[^>]', '', 'g')) AS level,
                regexp_replace(raw, '^((?:[ \\t]*>)+)[ \\t]?', '') AS line FROM raw),
        contents AS (
            SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\r]+', ' ', 'g'), ' ') AS content
            FROM lines),
        begun AS (
            SELECT *, CASE WHEN lag(level) OVER w = level AND lag(content) OVER w <> ''
                THEN 0 ELSE 1 END AS begins
            FROM contents WINDOW w AS (PARTITION BY msg_id ORDER BY n)),
        numbered AS (
            SELECT *, sum(begins) OVER (PARTITION BY msg_id ORDER BY n) AS passage FROM begun),
        passages AS (
            SELECT msg_id, sent, passage, level, md5(string_agg(content, chr(10) ORDER BY n)) AS key
            FROM numbered WHERE content <> '' GROUP BY ALL),
        written AS (
            SELECT key, min((sent, msg_id)) AS writer FROM passages WHERE level = 0 GROUP BY key),
        found AS (
            SELECT p.msg_id, w.writer[2] AS parent_id FROM passages p JOIN written w USING (key)
            WHERE p.level > 0 AND w.writer < (p.sent, p.msg_id)
            QUALIFY row_number() OVER (PARTITION BY p.msg_id ORDER BY level, passage) = 1),
        linked AS (
            SELECT m.msg_id, sent, parent_id FROM messages m LEFT JOIN found USING (msg_id)),
        threads AS (
            SELECT msg_id, msg_id AS thread_id, 0 AS depth FROM linked WHERE parent_id IS NULL
            UNION ALL
            SELECT l.msg_id, t.thread_id, t.depth + 1
            FROM linked l JOIN threads t ON l.parent_id = t.msg_id),
        texts AS (
            SELECT msg_id, count(*) FILTER (WHERE level > 0) AS n_quoted, md5(regexp_replace(
                coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE level = 0), ''),
                '^\\s+|\\s+$', '', 'g')) AS own_md5
            FROM lines GROUP BY msg_id)
        SELECT msg_id, sent, parent_id, thread_id, depth, n_quoted, own_md5
        FROM linked JOIN threads USING (msg_id) JOIN texts USING (msg_id)""",
    "op3_near_dup": """
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1) + 1)))
                AS i FROM words)),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
            FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
            WHERE 100 * c >= 80 * (x.n + y.n - c)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION SELECT r.doc_id, b.b FROM reached r JOIN ways b ON b.a = r.other)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id,
            min(other) = doc_id AS kept
        FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n""",
    "op5_substring_dedup": """
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        windows AS (
            SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)),
        firsts AS (SELECT k, min(doc_id) AS first_id FROM windows GROUP BY k),
        gone AS (
            SELECT DISTINCT doc_id, i + d AS i
            FROM windows JOIN firsts USING (k), (SELECT unnest(range(50)) AS d)
            WHERE doc_id > first_id),
        places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
        kept AS (
            SELECT doc_id, count(g.i) AS n_removed,
                string_agg(word, ' ' ORDER BY p.i) FILTER (WHERE g.i IS NULL) AS text
            FROM places p LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
            sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM words LEFT JOIN kept USING (doc_id)""",
    "op6_line_dedup": """
        WITH raw AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                generate_subscripts(string_split(text, chr(10)), 1) AS n
            FROM documents),
        lines AS (
            SELECT doc_id, n, trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13))) AS line,
                row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i
            FROM raw WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
        around AS (
            SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM lines),
        neighbours AS (
            SELECT doc_id, i, line, words, lead(line) OVER w AS next, lead(line, 2) OVER w AS next2,
                lead(words) OVER w AS words1, lag(line) OVER w AS prev, lag(line, 2) OVER w AS prev2,
                lag(words) OVER w AS words_1, count(*) OVER d AS n_lines, sum(words) OVER d AS total
            FROM around WINDOW w AS (PARTITION BY doc_id ORDER BY i), d AS (PARTITION BY doc_id)),
        windows AS (
            SELECT doc_id, i, 1 AS size, line AS k FROM neighbours WHERE words >= 10
            UNION SELECT doc_id, i, 2, concat_ws(chr(10), line, next) FROM neighbours
            WHERE words < 10 AND words + words1 >= 10
            UNION SELECT doc_id, i - 1, 2, concat_ws(chr(10), prev, line) FROM neighbours
            WHERE words < 10 AND words + words_1 >= 10
            UNION SELECT doc_id, i, 3, concat_ws(chr(10), line, next, next2) FROM neighbours
            WHERE words + words1 < 10 AND next2 IS NOT NULL
            UNION SELECT doc_id, i - 2, 3, concat_ws(chr(10), prev2, prev, line) FROM neighbours
            WHERE words + words_1 < 10 AND prev2 IS NOT NULL
            UNION SELECT doc_id, i, n_lines, concat(chr(0), line, chr(10), next) FROM neighbours
            WHERE i = 0 AND n_lines < 3 AND total < 10),
        later AS (
            SELECT doc_id, i, size FROM windows
            QUALIFY row_number() OVER (PARTITION BY md5(k) ORDER BY doc_id, i) > 1),
        gone AS (SELECT DISTINCT doc_id, i + unnest(range(size)) AS i FROM later),
        counts AS (
            SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
                string_agg(CAST(g.i AS VARCHAR), ',' ORDER BY g.i) AS removed
            FROM lines l LEFT JOIN gone g USING (doc_id, i) GROUP BY l.doc_id),
        kept AS (
            SELECT r.doc_id, md5(coalesce(string_agg(r.line, chr(10) ORDER BY r.n)
                FILTER (WHERE g.i IS NULL), '')) AS kept_md5
            FROM raw r LEFT JOIN lines l USING (doc_id, n) LEFT JOIN gone g ON
                g.doc_id = l.doc_id AND g.i = l.i
            WHERE r.doc_id IN (SELECT doc_id FROM gone) GROUP BY r.doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
            coalesce(removed, '') AS removed, kept_md5
        FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op1_topk_search": """
        WITH v AS (
            SELECT vec_id,
                [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
            FROM embeddings
            WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT)
                    AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 20""",
}
