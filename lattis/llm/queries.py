"""The ``op<N>_<name>`` queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattis.llm import bin_completion, chat_format, decontaminate, embedding_hnsw, exact_dedup, language_bloom, license_scan, quality_gbt, simhash_bk, spelling, token_counts, warc, weighted_lloyd


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = _tokenizer("byte_bpe_50k.tiktoken")
    return token_counts.count_document_tokens(spark, _read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN).select("doc_id", "n_tokens")


def op2_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(spark, _read(spark, sf_dir, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(chat_format.check_row(spark))))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(_read(spark, sf_dir, "documents"))


def op5_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbt.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_language_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_bloom.identify_documents(_read(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_embedding_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_hnsw.near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def op9_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack_documents(_read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op10_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_duplicate_documents(_read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_read(spark, sf_dir, "documents"))


def _spelling_sql() -> str:
    """crc32 from its table, all pairs of words by edit distance (each letter as one byte), forms by recursion."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    accented = "".join(map(chr, range(0xC0, 0x100)))
    spare = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c not in "'\\")[: len(accented)]
    return f"""
        WITH RECURSIVE crc AS (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
        ),
        found AS (
            SELECT doc_id, translate(run, '{upper}', '{upper.lower()}') AS run, count(*) AS k
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
        ),
        hexed AS (SELECT run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM found),
        hashed AS (
            SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
                lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) AS h
            FROM hexed, crc
        ),
        results AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
        words AS MATERIALIZED (
            SELECT word, CAST(sum(k) AS BIGINT) AS n, translate(word, '{accented}', '{spare}') AS coded, length(word) AS len
            FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
        ),
        near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM words a JOIN words b ON b.len IN (a.len - 1, a.len, a.len + 1) AND levenshtein(a.coded, b.coded) = 1),
        best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS form, max(m) AS form_n FROM near GROUP BY word),
        forms AS MATERIALIZED (SELECT word, form, form_n FROM best WHERE form_n >= 5 * n),
        path AS (SELECT word, word AS root FROM words UNION ALL SELECT p.word, f.form FROM path p JOIN forms f ON f.word = p.root),
        roots AS (SELECT word, root FROM path WHERE root NOT IN (SELECT word FROM forms))
        SELECT w.word, f.form, r.root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
        FROM words w JOIN roots r USING (word) LEFT JOIN forms f USING (word) LEFT JOIN best b USING (word)
    """


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"), keep="largest")


def op13_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_lloyd.cluster_vectors(_read(spark, sf_dir, "embeddings"))


def _lloyd_sql(k: int = 8, rounds: int = 10) -> str:
    """Rounds of Lloyd's algorithm, one after the other; ``//`` is brought from truncation to floor."""
    assign = "SELECT vec_id, q, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, v.q, m.c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - m.q[i]) * (v.q[i] - m.q[i]))) AS d FROM kept v, m{r} m) GROUP BY vec_id, q"
    parts = []
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED ({assign.format(r=r)})")
        if r < rounds:
            floors = f"SELECT c, list(((s - ((s % n) + n) % n) // n) ORDER BY j) AS q FROM (SELECT c, j, sum(q[j])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(j) GROUP BY c, j) GROUP BY c"
            parts.append(f"m{r + 1} AS MATERIALIZED (SELECT m.c, coalesce(f.q, m.q) AS q FROM m{r} m LEFT JOIN ({floors}) f USING (c))")
    return f"""
        WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        kept AS MATERIALIZED (
            SELECT vec_id, list_transform(v, lambda x: CAST(floor(1024 * x) AS BIGINT)) AS q FROM e
            WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, q FROM kept ORDER BY c LIMIT {k}),
        {", ".join(parts)}
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
               CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(m.q, ',')) AS centroid_sha256
        FROM a{rounds} JOIN m{rounds} m USING (c)
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_separator_scan": op1_separator_scan,
    "op2_warc_normaliser": op2_warc_normaliser,
    "op3_chat_format": op3_chat_format,
    "op4_license_scan": op4_license_scan,
    "op5_quality_gbt": op5_quality_gbt,
    "op6_language_bloom": op6_language_bloom,
    "op7_decontaminate": op7_decontaminate,
    "op8_embedding_hnsw": op8_embedding_hnsw,
    "op9_bin_completion": op9_bin_completion,
    "op10_simhash_bk": op10_simhash_bk,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_weighted_lloyd": op13_weighted_lloyd,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_normaliser": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, sha1(payload) AS payload_digest, CAST(octet_length(payload) AS BIGINT) AS payload_bytes FROM p),
        h AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS holder FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = holder OR holder IS NULL OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> holder THEN holder END AS refers_to
        FROM h
    """,
    "op3_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ),
        e AS (
            SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e')) AS coded FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('### ') + length(role) + length(': ') + coded + length('</turn>') + 1) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op8_embedding_hnsw": """
        WITH RECURSIVE e AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        ),
        ok AS (
            SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
            AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(v, lambda x: x <> 0)) > 0
        ),
        link AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98
        ),
        reach AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
        c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
        n AS (SELECT x AS vec_id, count(*) AS n_links FROM link GROUP BY x)
        SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
    """,
    "op11_spelling_variants": _spelling_sql(),
    "op12_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op13_weighted_lloyd": _lloyd_sql(),
}
