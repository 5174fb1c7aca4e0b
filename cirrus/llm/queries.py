"""The queries of the operators, as fixed by their contracts, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, codec, collocations, langid, minhash, mixing, packing, sharding, substring, topk, toxicity, vectors, warc, whitening


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(langid.remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = langid.train(docs, langid.remainder(F.col("doc_id"), 3) != 1)
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op2_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = codec.encode(docs, path).drop("text")
    return codec.decode(ids, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.token_pieces(docs, vocabulary("byte_bpe_50k.json")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = base.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels, langid.remainder(F.col("doc_id"), 4) != 2)
    held = F.coalesce(langid.remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    rows = docs.withColumn("held_out", held)
    return toxicity.predict(rows, model).select("doc_id", "held_out", "score", "predicted")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumn("text_crc32", F.crc32(text.cast("binary")))
    rows = sharding.shard(docs, F.octet_length(text) + 16, F.col("text"), 40, keep=["doc_id", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_min_max_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, size=2).select("doc_id", "n_shingles", "component_id", "kept")


def op8_itq_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "embeddings")
    return vectors.near_duplicates(rows).select("vec_id", "n_links", "component_id", "kept")


def op9_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "embeddings")
    return topk.search(rows, F.col("vec_id") % 100 == 0, vector=topk.whole(F.col("embedding")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(spark, base.table(spark, sf_dir, "pages"))
    return warc.read_bundles(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("text", "lang")
    return collocations.mine(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = mixing.mix(docs, mixing.word_count(F.col("text")), F.col("source"), F.col("doc_id"), F.col("text"), keep=["doc_id"])
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "embeddings")
    return whitening.whiten(rows).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_repeated_phrases": op2_repeated_phrases,
    "op3_bpe": op3_bpe,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_min_max_hash": op7_min_max_hash,
    "op8_itq_vectors": op8_itq_vectors,
    "op9_max_score": op9_max_score,
    "op10_warc": op10_warc,
    "op11_collocations": op11_collocations,
    "op12_source_mix": op12_source_mix,
    "op13_whitening": op13_whitening,
}

SQL = {
    "op2_repeated_phrases": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        u AS (SELECT doc_id, len(w) AS n, generate_subscripts(w, 1) AS i, w FROM d WHERE len(w) >= 35),
        win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM u WHERE i + 34 <= n),
        hit AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
        words AS (SELECT doc_id, w, generate_subscripts(w, 1) AS i FROM d),
        near AS (SELECT x.doc_id, x.i, x.w, h.i AS last FROM words x ASOF LEFT JOIN hit h ON x.doc_id = h.doc_id AND x.i >= h.i),
        kept AS (SELECT doc_id, CAST(count_if(last IS NOT NULL AND i - last < 35) AS BIGINT) AS n_removed, coalesce(string_agg(w[i], ' ' ORDER BY i) FILTER (WHERE last IS NULL OR i - last >= 35), '') AS t FROM near GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
        FROM d LEFT JOIN kept k USING (doc_id)""",
    "op7_min_max_hash": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS sh FROM d),
        e AS (SELECT doc_id, unnest(sh) AS x FROM s),
        i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT u, v FROM i JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v WHERE 100 * c >= 80 * (len(a.sh) + len(b.sh) - c)),
        r(node, seen) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.u, r.seen FROM r JOIN l ON l.v = r.node),
        m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
        SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m ON m.node = s.doc_id""",
    "op8_itq_vectors": """
        WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        ok AS (SELECT * FROM e WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
              WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) >= 0.93),
        r(node, seen) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.u, r.seen FROM r JOIN l ON l.v = r.node),
        m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
        n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
        SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
        FROM e JOIN m ON m.node = e.vec_id LEFT JOIN n ON n.u = e.vec_id""",
    "op9_max_score": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
              FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
        b AS (SELECT *, list_aggregate(list_transform(range(40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 1 + 4 * (instr('0123456789abcdef', substr(hex, CAST(i + 1 AS INT), 1)) - 1), 4)), 'string_agg', '') AS bits FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda k: CAST(substr(bits, CAST(5 * i + k + 1 AS INT), 1) AS INT) * CAST(pow(2, 4 - k) AS INT))) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM b""",
    "op11_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, doc, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        u AS (SELECT lang, w, generate_subscripts(w, 1) AS i FROM w),
        f AS (SELECT lang, 1 AS k, w[i] AS phrase, '' AS head, '' AS tail, '' AS first, '' AS last, count(*) AS c FROM u GROUP BY ALL
              UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1], w[i], w[i + 1], w[i], w[i + 1], count(*) FROM u WHERE i < len(w) GROUP BY ALL HAVING count(*) >= 10
              UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], w[i] || ' ' || w[i + 1], w[i + 1] || ' ' || w[i + 2], w[i], w[i + 2], count(*) FROM u WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10),
        n AS (SELECT lang, sum(c) AS n FROM f WHERE k = 1 GROUP BY lang),
        cuts AS (SELECT x.lang, x.k, x.phrase, x.c AS a, 1 AS cut, l.c AS l, r.c AS r FROM f x JOIN f l ON l.lang = x.lang AND l.phrase = x.first AND l.k = 1 JOIN f r ON r.lang = x.lang AND r.phrase = x.tail AND r.k = x.k - 1 WHERE x.k > 1
                 UNION ALL SELECT x.lang, x.k, x.phrase, x.c, 2, l.c, r.c FROM f x JOIN f l ON l.lang = x.lang AND l.phrase = x.head AND l.k = 2 JOIN f r ON r.lang = x.lang AND r.phrase = x.last AND r.k = 1 WHERE x.k = 3),
        scored AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
        least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, cut) = 1),
        longer AS (SELECT lang, phrase, max(c) AS c FROM (SELECT lang, head AS phrase, c FROM f WHERE k = 3 UNION ALL SELECT lang, tail, c FROM f WHERE k = 3) GROUP BY ALL),
        kept AS (SELECT x.* FROM least x LEFT JOIN longer g ON x.k = 2 AND g.lang = x.lang AND g.phrase = x.phrase WHERE g.c IS NULL OR 100 * g.c < 50 * x.a),
        ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op12_source_mix": r"""
        WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                 md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM d GROUP BY source),
        o AS (SELECT *, sum(2 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used,
                 sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total FROM s),
        free AS (SELECT *, CAST(150 * total AS DOUBLE) / 100 - CAST(coalesce(used, 0) AS DOUBLE) AS num, rest AS den FROM o),
        lev AS (SELECT num, den FROM free WHERE w * num / den < 2.0 * source_size ORDER BY source_size / w, source NULLS LAST LIMIT 1),
        t AS (SELECT source, source_size, coalesce(least(w * (SELECT num FROM lev) / (SELECT den FROM lev), CAST(2 * source_size AS DOUBLE)), CAST(2 * source_size AS DOUBLE)) AS target FROM s),
        e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS copies FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (SELECT *, CAST(floor(copies) AS BIGINT) AS certain, greatest(copies - floor(copies), CAST(1e-9 AS DOUBLE)) AS p, (CAST('0x' || substr(h, 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u FROM e),
        k AS (SELECT *, least(CAST(floor((u * (1 - p)) / (u * (1 - p) + (1 - u) * p) * CAST(1125899906842624 AS DOUBLE)) AS BIGINT), 1125899906842623) AS k1, CAST('0x' || substr(h, 14, 15) AS BIGINT) AS k2 FROM c),
        want AS (SELECT source, CAST(floor(target - sum(size * certain)) AS BIGINT) AS words FROM k GROUP BY source, target),
        q AS (SELECT k.source, doc_id, size, source_size, target, certain, row_number() OVER (PARTITION BY k.source ORDER BY k1, k2) AS i FROM k),
        run(source, i, left_, extra) AS (
            SELECT source, CAST(0 AS BIGINT), words, CAST(0 AS BIGINT) FROM want
            UNION ALL SELECT q.source, q.i, CASE WHEN q.certain < 2 AND q.size <= run.left_ THEN run.left_ - q.size ELSE run.left_ END, CASE WHEN q.certain < 2 AND q.size <= run.left_ THEN 1 ELSE 0 END
            FROM run JOIN q ON q.source IS NOT DISTINCT FROM run.source AND q.i = run.i + 1)
        SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * (q.certain + run.extra) AS BIGINT) AS taken
        FROM q JOIN run ON q.source IS NOT DISTINCT FROM run.source AND q.i = run.i""",
}
