"""The registered queries of this subpackage, and the SQL that checks those which SQL can express."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm import bpe, conversations, decontaminate, langid, mixing, neardup, pieces, pii, repeats, search, spelling, toxicity
from pagesift.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(of: str, n: int):
    return F.pmod(F.crc32(F.col(of).cast("string").cast("binary")), F.lit(n))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(fold("doc_id", 5) != 0))
    held = docs.withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))
    return toxicity.with_scores(held, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = docs.withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    return langid.identify(held, docs.where(fold("doc_id", 4) != 2), vocabulary("piece_bpe_32k.model"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_out(table(spark, sf_dir, "documents"), 35, keep_text=False).drop("kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", mixing.quality().alias("weight"))
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), with_ids=False).drop("ids", "nbest_ids")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact_top_k(table(spark, sf_dir, "embeddings"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.approximate_top_k(table(spark, sf_dir, "embeddings"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.summary(conversations.repaired(conversations.damaged(table(spark, sf_dir, "conversations"))))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_toxicity, op3_language, op4_substring_dedup, op5_mixing, op6_pieces, op7_token_counts, op8_near_duplicates, op9_exact_top_k,
        op10_nearest, op11_conversation_repair, op12_spelling_variants, op13_decontamination
    )
}

ORACLE_SQL = {
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d),
        g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p WHERE i + 34 <= len(w)),
        r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
        s AS (SELECT doc_id, list(i) AS starts FROM g SEMI JOIN r USING (h) GROUP BY doc_id),
        k AS (SELECT d.doc_id, len(w) AS n_words, w, list_distinct(flatten(list_transform(coalesce(starts, []), lambda x: range(x, x + 35)))) AS gone
              FROM d LEFT JOIN s USING (doc_id)),
        o AS (SELECT doc_id, n_words, len(gone) AS n_removed,
                     coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' '), '') AS kept FROM k)
        SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM o""",
    "op9_exact_top_k": """
        WITH v AS (SELECT vec_id, embedding FROM embeddings),
        d AS (SELECT q.vec_id AS query_id, c.vec_id,
                     list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: CASE WHEN (q.embedding[i] > 0) <> (c.embedding[i] > 0) THEN 1 ELSE 0 END))::BIGINT AS distance
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, rank, vec_id, distance
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM d) WHERE rank <= 10""",
    "op11_conversation_repair": r"""
        WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS tab),
        i AS (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)) AS bytes FROM conversations),
        h AS (SELECT i.*, xor(4294967295, list_reduce(bytes, lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT)) % 20 AS h FROM i, t),
        m AS (SELECT rid, conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                     CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(CASE WHEN h = 0 THEN [] WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h),
        f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, rid, copy) AS k,
                     row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid, copy) > 1 AS again, rtrim(text, E' \t\n\x0b\x0c\r') AS kept FROM m),
        r AS (SELECT conv_id, turn, k, role, text, CASE WHEN kept = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
                     CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS initial FROM f),
        -- ways of a row from state b ('' start, s, u, a) over inserts to state e: what it costs, its edits and the roles of what it leaves (K: the row's own)
        ins AS (SELECT * FROM (VALUES ('', '', 0, '', ''), ('', 'u', 3, 'I', 'u'), ('', 'a', 6, 'II', 'ua'), ('s', 's', 0, '', ''), ('s', 'u', 3, 'I', 'u'), ('s', 'a', 6, 'II', 'ua'),
                                      ('u', 'u', 0, '', ''), ('u', 'a', 3, 'I', 'a'), ('a', 'a', 0, '', ''), ('a', 'u', 3, 'I', 'u')) x(b, v, price, edits, roles)),
        fits AS (SELECT * FROM (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')) x(v, e)),
        acts AS (SELECT v, e, e AS initial, 'K' AS edit, 0 AS price, 'K' AS made FROM fits
                 UNION ALL SELECT v, e, i, 'R', 3, e FROM fits, (VALUES ('s'), ('u'), ('a'), ('-')) y(i) WHERE e <> 's'
                 UNION ALL SELECT v, v, i, 'D', 4, '' FROM (VALUES (''), ('s'), ('u'), ('a')) z(v), (VALUES ('s'), ('u'), ('a'), ('-')) y(i)),
        ways AS (SELECT b, e, initial, edit, ins.price + acts.price AS price, edits || edit AS edits, roles || made AS roles FROM ins JOIN acts USING (v)),
        c AS (SELECT DISTINCT conv_id FROM conversations),
        p AS (SELECT conv_id, 0::BIGINT AS k, '' AS state, 0::BIGINT AS cost, '' AS audit, '' AS roles FROM c
              UNION ALL
              SELECT conv_id, k, state, cost, audit, roles FROM (
                  SELECT p.conv_id, r.k, e AS state, cost + price + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 3 ELSE 0 END AS cost, audit || edits AS audit, p.roles || ways.roles AS roles,
                         row_number() OVER (PARTITION BY p.conv_id, e ORDER BY cost + price + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 3 ELSE 0 END, audit || edits) AS place
                  FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.k = p.k + 1 JOIN ways ON b = p.state AND ways.initial = r.initial
                  WHERE edit = 'D' OR fault IS NULL OR fault = 'truncated') WHERE place = 1),
        n AS (SELECT c.conv_id, count(r.k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                     count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM c LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
        g AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, lag(left(role, 1)) OVER w || left(role, 1) AS two FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY k))
              WHERE two NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
        o AS (SELECT n.*, cost + price AS cost, audit || edits AS audit, roles || more AS roles,
                     row_number() OVER (PARTITION BY n.conv_id ORDER BY cost + price, audit || edits) AS place
              FROM n JOIN p ON p.conv_id IS NOT DISTINCT FROM n.conv_id AND p.k = n.n
              JOIN (VALUES ('', 0, '', ''), ('a', 0, '', ''), ('u', 3, 'I', 'a'), ('s', 6, 'II', 'ua')) z(state, price, edits, more) USING (state)),
        b AS (SELECT * FROM o WHERE place = 1),
        u AS (SELECT conv_id, audit, roles, unnest(range(1, len(audit) + 1)) AS j FROM b),
        x AS (SELECT conv_id, j, audit[j] AS edit, roles[len(replace(audit[1:j], 'D', ''))] AS made,
                     len(replace(audit[1:j], 'I', '')) AS k FROM u),
        l AS (SELECT x.conv_id, string_agg(CASE made WHEN 'K' THEN role WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS lines
              FROM x LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.k = x.k WHERE edit <> 'D' GROUP BY x.conv_id)
        SELECT b.conv_id, gaps, blank, duplicate, truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(lines, '')) AS repaired_sha256
        FROM b LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM b.conv_id""",
    "op12_spelling_variants": r"""
        WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS tab),
        d AS (SELECT row_number() OVER () AS rid, coalesce(doc_id::VARCHAR, '') || ':' AS pre,
                     regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+') AS w FROM documents),
        e AS (SELECT rid, pre, unnest(w) AS run FROM d),
        r AS (SELECT pre, run, count(*) AS m FROM e GROUP BY pre, run),
        b AS (SELECT pre, run, m, flatten(list_transform(string_split(pre || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END)) AS bytes FROM r),
        h AS (SELECT pre, run, m, xor(4294967295, list_reduce(bytes, lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT)) AS h FROM b, t),
        f AS (SELECT m, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word FROM h),
        v AS (SELECT word, sum(m)::BIGINT AS n FROM f WHERE len(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
        g AS (SELECT word, n, unnest(range(len(word))) AS i FROM v),
        k AS (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS z FROM g),
        p AS (SELECT x.word AS x, y.word AS y, y.n AS m FROM k x JOIN k y ON x.a = y.a AND x.z = y.z AND x.word <> y.word
              UNION SELECT k.word, v.word, v.n FROM k JOIN v ON v.word = a || z UNION SELECT v.word, k.word, k.n FROM k JOIN v ON v.word = a || z),
        o AS (SELECT x, count(*) AS n_near, max(m) AS top FROM p GROUP BY x),
        c AS (SELECT o.x, n_near, top, min(y) AS y FROM o JOIN p ON o.x = p.x AND m = top GROUP BY o.x, n_near, top),
        w AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN y END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n FROM v LEFT JOIN c ON x = word),
        q AS (WITH RECURSIVE s(word, here, step) AS (SELECT word, word, 0 FROM w UNION ALL SELECT s.word, w.form, step + 1 FROM s JOIN w ON w.word = s.here WHERE w.form IS NOT NULL)
              SELECT word, arg_max(here, step) AS root FROM s GROUP BY word)
        SELECT word, form, root, n, n_near, form_n FROM w JOIN q USING (word)""",
    "op13_decontamination": r"""
        WITH l AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
        d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, l),
        b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, l),
        g AS (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
        k AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS gram FROM g),
        s AS (SELECT DISTINCT m FROM k),
        p AS (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, s WHERE len(w) >= m),
        h AS (SELECT rid, i, p.m, item FROM p JOIN k ON k.m = p.m AND k.gram = array_to_string(w[i:i + p.m - 1], ' ')),
        c AS (SELECT rid, len(list_distinct(flatten(list(range(i, i + m))))) AS n_hit FROM h GROUP BY rid),
        u AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (rid) LEFT JOIN u USING (rid)""",
}
