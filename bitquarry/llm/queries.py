"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_tree, cpsjoin, licenses, line_dedup, mixing, pieces, pii, token_files, topk, toxicity
from .common import table

#: Tokenizer files are parameters of the operators; these are the queries' own.
PIECES_FILE = public_tokenizers.path("piece_bpe_32k.model")
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op1_pii_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context words of the whole window, where ``op1_pii`` ends it at neighbouring matches."""
    return pii.digest(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), whole_context=True))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnsRenamed({"start": "start_char", "end": "end_char"})


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.duplicates(table(spark, sf_dir, "documents"), kind="sentence", min_words=6)
    return found.withColumnsRenamed({"start": "start_char", "end": "end_char"})


def op4_line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and paragraphs of any length beside the sentences of ``op4_line_dedup``."""
    found = line_dedup.duplicates(table(spark, sf_dir, "documents"), kind="all", min_words=6)
    return found.withColumnsRenamed({"start": "start_char", "end": "end_char"})


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "severity", "grade", "toxic")


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.with_links(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.token_table(table(spark, sf_dir, "documents"), BPE_FILE, end_id=2)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_cpsjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpsjoin.classes(table(spark, sf_dir, "documents"), n=4, percent=80)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan(table(spark, sf_dir, "documents"), mixing.Target(repeats=2.0))
    return found.select("doc_id", "source", "n_tokens", "copies", "mix_key")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding gives the text back."""
    found = pieces.encode_checked(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES_FILE)
    return found.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "restored")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op1_pii_whole": op1_pii_whole,
    "op2_topk": op2_topk,
    "op3_licenses": op3_licenses,
    "op4_line_dedup": op4_line_dedup,
    "op4_line_dedup_whole": op4_line_dedup_whole,
    "op5_toxicity": op5_toxicity,
    "op6_cover_tree": op6_cover_tree,
    "op7_token_files": op7_token_files,
    "op8_cpsjoin": op8_cpsjoin,
    "op9_mixing": op9_mixing,
    "op10_pieces": op10_pieces,
}


def _pii_kind(kind: str, pattern: str, valid: str, context: str | None = None, whole: bool = False) -> str:
    """CTEs: ``<kind>_s`` has per row the kind's valid spans as strings kind:start:end.

    Context is what stands between neighbouring matches, or ``whole`` in the text.
    """
    before, after = ("right(left(t, CAST(e - length(x) AS BIGINT)), 40)", "substr(t, CAST(e AS BIGINT) + 1, 40)") if whole else ("right(g[i], 40)", "left(g[i + 1], 40)")
    near = f"AND (regexp_matches({before}, '{context}') OR regexp_matches({after}, '{context}'))" if context else ""
    return f"""
{kind}_m AS (SELECT r, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM docs),
{kind}_x AS (SELECT r, t, m[i] AS x, g, i, list_sum(list_transform(range(1, i + 1), lambda k: length(g[k]) + length(m[k]))) AS e
             FROM (SELECT r, t, m, g, unnest(range(1, len(m) + 1)) AS i FROM {kind}_m)),
{kind}_s AS (SELECT r, list(concat('{kind}:', CAST(e - length(x) AS BIGINT), ':', CAST(e AS BIGINT)) ORDER BY i) AS s
             FROM {kind}_x WHERE {valid} {near} GROUP BY r)"""


_SQL_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_SQL_LUHN = (
    f"list_sum(list_transform(range(1, length({_SQL_DIGITS}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(substr({_SQL_DIGITS}, length({_SQL_DIGITS}) - j + 1, 1) AS INT) "
    f"ELSE CAST(substr('0246813579', CAST(substr({_SQL_DIGITS}, length({_SQL_DIGITS}) - j + 1, 1) AS INT) + 1, 1) AS INT) END)) % 10 = 0"
)
_SQL_PLAIN = "replace(x, ' ', '')"
_SQL_MOD97 = (
    f"CAST(list_aggregate(list_transform(string_split(concat(substr({_SQL_PLAIN}, 5), substr({_SQL_PLAIN}, 1, 4)), ''), "
    "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), 'string_agg', '') AS HUGEINT) % 97 = 1"
)
def _pii_sql(whole: bool) -> str:
    kinds = [
        _pii_kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _pii_kind("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(x, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0"),
        _pii_kind("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_SQL_DIGITS}) BETWEEN 16 AND 19 AND {_SQL_LUHN}"),
        _pii_kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_SQL_DIGITS}) BETWEEN 8 AND 15"),
        _pii_kind("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", f"length({_SQL_PLAIN}) BETWEEN 15 AND 34 AND {_SQL_MOD97}"),
        _pii_kind(
            "ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT (regexp_matches(x, '^(000|666|9)') OR x LIKE '___-00-____' OR x LIKE '%-0000')", "(?i)ssn|social|security|taxpayer", whole
        ),
    ]
    return "WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)," + ",".join(kinds) + _PII_END


_PII_END = """
SELECT doc_id, CAST(coalesce(len(email_s.s), 0) AS BIGINT) AS n_email, CAST(coalesce(len(ip_s.s), 0) AS BIGINT) AS n_ip,
       CAST(coalesce(len(card_s.s), 0) AS BIGINT) AS n_card, CAST(coalesce(len(phone_s.s), 0) AS BIGINT) AS n_phone,
       sha256(array_to_string(list_concat(email_s.s, ip_s.s, card_s.s, phone_s.s), ',')) AS base_sha256,
       array_to_string(list_concat(email_s.s, ip_s.s, card_s.s, phone_s.s, iban_s.s, ssn_s.s), ',') AS spans
FROM docs LEFT JOIN email_s USING (r) LEFT JOIN ip_s USING (r) LEFT JOIN card_s USING (r) LEFT JOIN phone_s USING (r)
     LEFT JOIN iban_s USING (r) LEFT JOIN ssn_s USING (r)"""

ORACLE: dict[str, str] = {
    "op1_pii": _pii_sql(whole=False),
    "op1_pii_whole": _pii_sql(whole=True),
    "op2_topk": """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i])) AS BIGINT) AS score
      FROM x AS q JOIN x ON x.vec_id <> q.vec_id AND len(x.v) = len(q.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op6_cover_tree": """
WITH RECURSIVE u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a),
reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r),
c AS (SELECT id AS vec_id, min(r) AS c FROM reach GROUP BY id)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.c AS component_id, c.c = vec_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op8_cpsjoin": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common
      FROM x AS a JOIN x AS b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (n + m - common)),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r),
c AS (SELECT id AS doc_id, min(r) AS c FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.c AS component_id, c.c = doc_id AS kept FROM s JOIN c USING (doc_id)""",
    "op4_line_dedup": r"""
WITH t AS (SELECT doc_id, string_split(replace(regexp_replace(coalesce(text, ''), '([.!?])( )', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)), chr(1)) AS u FROM documents),
p AS (SELECT doc_id, i - 1 AS unit, u[i] AS x, CAST(coalesce(list_sum(list_transform(u[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS pos
      FROM (SELECT doc_id, u, unnest(range(1, len(u) + 1)) AS i FROM t)),
n AS (SELECT doc_id, unit, pos + length(x) - length(regexp_replace(x, '^\s+', '')) AS start, pos + length(regexp_replace(x, '\s+$', '')) AS "end",
             array_to_string(list_filter(regexp_split_to_array(lower(x), '\s+'), lambda w: w <> ''), ' ') AS k FROM p),
f AS (SELECT *, first_value(doc_id) OVER w AS first_doc_id, first_value(unit) OVER w AS first_unit FROM n WHERE len(string_split(k, ' ')) >= 6
      WINDOW w AS (PARTITION BY k ORDER BY doc_id, unit))
SELECT doc_id, unit, start AS start_char, "end" AS end_char, first_doc_id, first_unit FROM f WHERE (doc_id, unit) <> (first_doc_id, first_unit)""",
    "op4_line_dedup_whole": r"""
WITH d AS (SELECT doc_id, text AS t FROM documents WHERE text <> ''),
c AS (SELECT doc_id, t, 'line' AS kind, replace(t, chr(10), chr(10) || chr(1)) AS u FROM d
      UNION ALL SELECT doc_id, t, 'paragraph', regexp_replace(t, '\n([ \t\r\f\x0B]*\n)+', '\0' || chr(1), 'g') FROM d
      UNION ALL SELECT doc_id, t, 'sentence', replace(regexp_replace(t, '([.!?])( )', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)) FROM d),
p AS (SELECT doc_id, t, kind, u[i] AS x, CAST(coalesce(list_sum(list_transform(u[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS pos
      FROM (SELECT doc_id, t, kind, u, unnest(range(1, len(u) + 1)) AS i FROM (SELECT doc_id, t, kind, string_split(u, chr(1)) AS u FROM c)) WHERE u[i] <> ''),
s AS (SELECT doc_id, any_value(t) AS t, pos + length(x) - length(regexp_replace(x, '^\s+', '')) AS start,
             greatest(pos + length(x) - length(regexp_replace(x, '^\s+', '')), pos + length(regexp_replace(x, '\s+$', ''))) AS "end", bool_and(kind = 'sentence') AS sentence
      FROM p GROUP BY doc_id, 3, 4),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC) - 1 AS unit, start, "end", sentence,
             list_filter(regexp_split_to_array(lower(substr(t, CAST(start + 1 AS BIGINT), CAST("end" - start AS BIGINT))), '\s+'), lambda w: w <> '') AS w FROM s),
f AS (SELECT *, first_value(doc_id) OVER o AS first_doc_id, first_value(unit) OVER o AS first_unit FROM n WHERE len(w) >= CASE WHEN sentence THEN 6 ELSE 1 END
      WINDOW o AS (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, unit))
SELECT doc_id, unit, start AS start_char, "end" AS end_char, first_doc_id, first_unit FROM f WHERE (doc_id, unit) <> (first_doc_id, first_unit)""",
}
