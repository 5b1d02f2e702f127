"""Queries of the operators for training data, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

import secrets

from pyspark.sql import functions as F

from scansio.llm import abuse, lookalike, packing, personal, spans, terms, tokens
from scansio.session import load

VERSES = "(SELECT DISTINCT ON (verse_id) * FROM verses WHERE verse_id IS NOT NULL ORDER BY verse_id)"
_TERMS = f"(SELECT verse_id, unnest(coalesce(text_words, string_split(text_norm, ' '))) AS term FROM {VERSES})"


def _frequencies(source: str) -> str:
    return f"""SELECT term, occurrences, records, CASE WHEN records < {terms.RARE_BELOW} THEN 'rare'
            WHEN records > {terms.COMMON_ABOVE} * (SELECT count(*) FROM {VERSES}) THEN 'common' ELSE 'kept' END AS mark
        FROM (SELECT term, count(*)::BIGINT AS occurrences, count(DISTINCT verse_id) AS records FROM {source} WHERE term <> '' GROUP BY term)"""


def p5_found(spark, sf_dir):
    return terms.verse_word_frequencies(load(spark, sf_dir, "verses")).where("mark <> 'kept'").select("term", "mark")


_GRAMS = " UNION ALL ".join(
    f"SELECT '{f}' AS field, verse_id, p, {n} AS n, substr(t, p + 1, {n}) AS gram FROM (SELECT verse_id, {f} AS t, unnest(range(length({f}) - {n} + 1)) AS p FROM {VERSES} WHERE length({f}) >= {n})"
    for f, n in spans.FIELDS.items()
)
_SPANS = f"""WITH g AS ({_GRAMS}),
    m AS (SELECT field, gram FROM g GROUP BY ALL HAVING count(DISTINCT verse_id) > 1),
    c AS (SELECT field, verse_id, p, p + n AS e FROM g SEMI JOIN m USING (field, gram)),
    i AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY field, verse_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= p THEN 0 ELSE 1 END AS new FROM c),
    r AS (SELECT *, sum(new) OVER (PARTITION BY field, verse_id ORDER BY p) AS run FROM i)
    SELECT field, verse_id, min(p)::INT AS span_start, (max(e) - min(p))::INT AS span_len FROM r GROUP BY field, verse_id, run"""
_TOTALS = "SELECT field, verse_id, coalesce(shared, 0)::BIGINT AS shared_chars, n_chars FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, verse_id, length({f})::INT AS n_chars FROM {VERSES} WHERE {f} IS NOT NULL" for f in spans.FIELDS
) + f") LEFT JOIN (SELECT field, verse_id, sum(span_len) AS shared FROM ({_SPANS}) GROUP BY ALL) USING (field, verse_id)"


def p4_found(spark, sf_dir):
    pairs = lookalike.same_reading_pairs(load(spark, sf_dir, "verses"), "verse_id", "text_norm", "text_uthmani")
    return pairs.withColumnsRenamed({"a": "verse_id_a", "b": "verse_id_b"})


def _secret(spark) -> bytes:
    """The key of surrogates that the session names, or one that nobody knows and that is gone after the query."""
    named = spark.conf.get("spark.scansio.surrogates.key", "")
    return named.encode() or secrets.token_bytes(32)


def _items(spark, sf_dir):
    return personal.entities(load(spark, sf_dir, "reports"), "report_id", "notes", "user_agent", secret=_secret(spark))


def p2_found(spark, sf_dir):
    """Items that have got a surrogate."""
    return _items(spark, sf_dir).where("surrogate IS NOT NULL").select("report_id", "field", "kind", "start_pos")


def p2_redacted(spark, sf_dir):
    return personal.redacted(load(spark, sf_dir, "reports"), "report_id", "notes", "user_agent", secret=_secret(spark))


def p2_texts(spark, sf_dir):
    """How many texts of either field came out, and how many of them null."""
    return p2_redacted(spark, sf_dir).groupBy("field").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("placeholders").isNull()).alias("missing"))


def p4_values(spark, sf_dir):
    """How many values of either field came out, and how many of them null or empty."""
    values = lookalike.canonical(load(spark, sf_dir, "verses"), "verse_id", "text_norm", "text_uthmani")
    return values.groupBy("field").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.coalesce("stored", F.lit("")) == "").alias("blank"))


def p8_scores(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return abuse.scored(docs, abuse.fit(docs, load(spark, sf_dir, "doc_reviews")), "source")


QUERIES = {
    "p8_scores": p8_scores,
    "p8_rates": lambda s, d: abuse.rates(p8_scores(s, d)),
    "p8_found": lambda s, d: p8_scores(s, d).where("flagged").select("doc_id"),
    "p8_documents": lambda s, d: abuse.rates(p8_scores(s, d)).select("source", "documents"),
    "p2_redacted": p2_redacted,
    "p2_distinct": lambda s, d: personal.distinctness(_items(s, d)),
    "p2_texts": p2_texts,
    "p2_found": p2_found,
    "p1_found": lambda s, d: spans.shared_spans(load(s, d, "verses"), "verse_id", spans.FIELDS),
    "p1_shared": lambda s, d: spans.shared_totals(load(s, d, "verses"), "verse_id", spans.FIELDS),
    "p4_canonical": lambda s, d: lookalike.canonical(load(s, d, "verses"), "verse_id", "text_norm", "text_uthmani"),
    "p4_found": p4_found,
    "p4_values": p4_values,
    "p4_classes": lambda s, d: lookalike.reading_classes(load(s, d, "verses"), "verse_id", "text_norm", "text_uthmani"),
    "p5_terms": lambda s, d: terms.verse_word_frequencies(load(s, d, "verses")),
    "p5_values": lambda s, d: terms.verse_value_frequencies(load(s, d, "verses")),
    "p5_found": p5_found,
    "p6_ids": lambda s, d: tokens.encode_corpus(load(s, d, "documents")),
    "p7_packing": lambda s, d: packing.pack_documents(load(s, d, "documents")),
}

def _counted(table: str, key: str, count: str, test: str, *fields: str) -> str:
    one = f"(SELECT DISTINCT ON ({key}) * FROM {table} WHERE {key} IS NOT NULL ORDER BY {key})"
    return " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS {count}, count(*) FILTER ({test.format(f)} IS NOT FALSE) AS {'missing' if count == 'texts' else 'blank'} FROM {one}" for f in fields)


SQL = {
    "p2_texts": _counted("reports", "report_id", "texts", "{} IS NULL", "notes", "user_agent"),
    "p4_values": _counted("verses", "verse_id", "records", "coalesce({}, '') = ''", "text_norm", "text_uthmani"),
    "p8_documents": "SELECT source, count(*) AS documents FROM documents GROUP BY source",
    "p1_found": _SPANS,
    "p1_shared": _TOTALS,
    "p5_terms": _frequencies(_TERMS),
    "p5_values": _frequencies(f"(SELECT verse_id, text_norm AS term FROM {VERSES})"),
    "p5_found": f"SELECT term, mark FROM ({_frequencies(_TERMS)}) WHERE mark <> 'kept'",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
