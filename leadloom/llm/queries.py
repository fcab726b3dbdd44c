"""The registered queries of the training-data operators, whole tables in, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.llm import align, decontam, idfiles, lines, lm, minhash, mixing, packing, periodic, quality, secrets, vectors, warc
from leadloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf, "documents"))


def op3_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return lm.score_documents(table(spark, sf, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf, "embeddings"))


def op5_warc_normaliser(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op7_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"))


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return idfiles.encode_documents(table(spark, sf, "documents"))


def op10_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = lines.drop_repeated_lines(table(spark, sf, "documents").select("doc_id", "text"), min_documents=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return align.link_statistics(table(spark, sf, "documents"))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic.run_digest(periodic.find_runs(periodic.with_planted_runs(table(spark, sf, "documents"))))


def op13_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).drop("source")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_quality_classifier, op2_secret_scan, op3_lm_score, op4_embedding_dedup, op5_warc_normaliser, op6_decontamination,
    op7_minhash_dedup, op8_packing, op9_token_files, op10_line_dedup, op11_tokenizer_alignment, op12_periodic_runs, op13_source_mixing)}


# --- SQL -----------------------------------------------------------------------

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans_sql(rule: secrets.Rule, rank: int) -> str:
    """doc_id, start, rank, kind and end of a rule's matches: the texts between matches and the matches alternate."""
    pattern = _quoted(rule.pattern)
    return (
        f"SELECT d, m.start AS s, {rank} AS r, '{rule.kind}' AS k, m.start + m.size AS e FROM (SELECT d, unnest(list_transform(range(1, len(f) + 1),"
        " lambda i: {'start': list_sum(g[1:i]) + coalesce(list_sum(f[1:i - 1]), 0), 'size': f[i], 'checked': c[i]})) AS m FROM (SELECT doc_id AS d,"
        f" list_transform(regexp_extract_all(t, {pattern}), lambda x: length(x)) AS f, list_transform(regexp_split_to_array(t, {pattern}), lambda x: length(x)) AS g,"
        f" list_transform(regexp_extract_all(t, {pattern}, {rule.group}), lambda x: length(x)) AS c FROM texts)) WHERE m.checked >= {rule.least}"
    )


# the contract's own wording of the rules whose expressions include the least length
_WORDED = {"access": secrets.Rule("access", "AKIA[A-Z0-9]+", 0, 18), "hex": secrets.Rule("hex", "[0-9a-f]+", 0, 16)}
_KINDS = [r.kind for r in secrets.BASE]
_BASE = "k IN (" + ", ".join(map(_quoted, _KINDS)) + ")"
_WRITE = "string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, r)"
_SECRETS = (
    "WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS (" + " UNION ALL ".join(_spans_sql(_WORDED.get(r.kind, r), i) for i, r in enumerate(secrets.RULES))
    + ") SELECT doc_id, " + ", ".join(f"count(*) FILTER (k = '{k}')::BIGINT AS n_{k}" for k in _KINDS)
    + f", sha256(coalesce({_WRITE} FILTER ({_BASE}), '')) AS base_sha256, coalesce({_WRITE} FILTER (k IS NOT NULL), '') AS spans"
    " FROM texts LEFT JOIN found ON d = doc_id GROUP BY doc_id"
)

_DIGEST = (
    "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + "
    + " + ".join(f"{16 >> j} * substr(bits, 5 * i + {j + 1}, 1)::INTEGER" for j in range(5)) + ", 1)), '')"
)
_WARC = (
    "WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits FROM pages),"
    f" q AS (SELECT page_id, payload_bytes, {_DIGEST} AS payload_digest FROM p),"
    " r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM q)"
    " SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,"
    " CASE WHEN page_id <> least THEN least END AS refers_to FROM r"
)

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINES = (
    "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i"
    f" FROM documents), k AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),"
    " gone AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)"
    " SELECT doc_id, count(*)::BIGINT AS n_lines, count(g.key)::BIGINT AS n_dropped,"
    " sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g.key IS NULL), '')) AS kept_sha256"
    " FROM k LEFT JOIN gone g ON g.key = k.key GROUP BY doc_id"
)

_VECTORS = (
    "WITH RECURSIVE u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL"
    " AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),"
    " e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)"
    " WHERE list_cosine_similarity(a.v, b.v) >= 0.93),"
    " r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),"
    " c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)"
    " SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept"
    " FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"
)

# crc32 of the decimal id, bit by bit: the next byte is mixed in before every eighth step
_CRC_STEP = "xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr(s, k // 8 + 1, 1)) ELSE 0 END)"
_RUNS = (
    "WITH ids AS (SELECT doc_id, text, doc_id::VARCHAR AS s FROM documents),"
    f" d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_quoted(mixing.WORD)}) AS w,"
    f" xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(s))), lambda c, k: xor({_CRC_STEP} >> 1, ({_CRC_STEP} & 1) * 3988292384)), 4294967295) AS h FROM ids),"
    " e AS (SELECT doc_id, w, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, h % 10 = 0 AND len(w) > 0 AS planted, 3 + (h // 10) % 8 AS times FROM d),"
    " f AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // times) + 1] END) ELSE w END AS w FROM e),"
    " x AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM f),"
    " g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram"
    " FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),"
    " p AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.i > a.i),"
    " t AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p),"
    " m AS (SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS n FROM t GROUP BY doc_id, q, island),"
    " r AS (SELECT doc_id, s, n, min(q) AS q FROM m WHERE n >= greatest(6, 4 * q) GROUP BY doc_id, s, n),"
    " b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n::DOUBLE / q DESC, s, q) = 1),"
    " l AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256 FROM r GROUP BY doc_id),"
    " gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM r),"
    " k AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256 FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)"
    " SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.n::BIGINT AS length, b.q::BIGINT AS period,"
    " (1000 * b.n // b.q)::BIGINT AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256"
    " FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)"
)

_MIX = (
    f"WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_quoted(mixing.WORD)}))::BIGINT AS size,"
    " md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key FROM documents),"
    " s AS (SELECT source, sum(size)::BIGINT AS words, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),"
    " c AS (SELECT sum(words) OVER o AS words, sum(weight) OVER o AS weight FROM s WINDOW o AS (ORDER BY words / weight, source ROWS UNBOUNDED PRECEDING)"
    " UNION ALL SELECT 0, 0), a AS (SELECT sum(words) AS words, sum(weight) AS weight FROM s),"
    " l AS (SELECT max((1.5 * a.words::DOUBLE - 2 * c.words::DOUBLE) / (a.weight - c.weight)::DOUBLE) AS level FROM c, a WHERE c.weight < a.weight),"
    " t AS (SELECT source, words, least(2.0 * words::DOUBLE, weight::DOUBLE * level) AS target FROM s, l),"
    " p AS (SELECT doc_id, size, words, target, floor(target)::BIGINT AS budget, (floor(target)::BIGINT // greatest(words, 1)) AS times,"
    " sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)"
    " SELECT doc_id, size, words AS source_size, target, (size * times + greatest(0, least(size, budget - times * words - before)))::BIGINT AS taken FROM p"
)

SQL: dict[str, str] = {
    "op2_secret_scan": _SECRETS, "op4_embedding_dedup": _VECTORS, "op5_warc_normaliser": _WARC, "op10_line_dedup": _LINES,
    "op12_periodic_runs": _RUNS, "op13_source_mixing": _MIX}
