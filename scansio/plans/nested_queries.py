"""Queries over nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from scansio.operators import nested
from scansio.session import load

PAGES = "(SELECT DISTINCT ON (page_id) page_id, edition, page, lines FROM mushaf_pages WHERE page_id IS NOT NULL ORDER BY page_id)"
LINES = f"(SELECT page_id, unnest(range(len(lines)))::INT AS outer_pos, unnest(lines) AS l FROM {PAGES})"
WORDS = f"(SELECT page_id, outer_pos, unnest(range(len(l.words)))::INT AS inner_pos, unnest(l.words) AS w FROM {LINES} WHERE l IS NOT NULL)"
EVENTS = """(SELECT diag_id, unnest(range(len(events)))::INT AS outer_pos, unnest(events) AS e
    FROM (SELECT DISTINCT ON (diag_id) diag_id, events FROM diagnostics WHERE diag_id IS NOT NULL ORDER BY diag_id))"""


def _opened(source: str, n: int) -> str:
    for _ in range(n):
        source = f"""(SELECT * REPLACE (CASE WHEN json_type(v) = 'OBJECT' AND json_exists(v, '$.payload') THEN json_extract(v, '$.payload') ELSE v END AS v) FROM
            (SELECT * REPLACE (CASE WHEN json_type(v) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(v, '$')) THEN json_extract_string(v, '$')::JSON END ELSE v END AS v) FROM {source}))"""
    return source


READ = _opened(f"(SELECT diag_id, outer_pos, e, CASE WHEN json_valid(e.data) AND trim(e.data) <> '' THEN e.data::JSON END AS v FROM {EVENTS})", 3)


def _children(array: str) -> str:
    at = f"json_extract(v, '$.{array}')"
    cells = f"(SELECT diag_id, outer_pos, unnest(range(json_array_length({at})::BIGINT))::INT AS inner_pos, unnest(json_extract({at}, '$[*]')) AS c FROM {READ} WHERE json_type({at}) = 'ARRAY')"
    part = lambda name, i: (
        f"coalesce(try_cast(coalesce(json_extract_string(c, '$.{name}'), json_extract_string(c, '$.{name.capitalize()}')) AS INT), "
        f"try_cast(json_extract_string(c, '$.ref.{name}') AS INT), try_cast(split_part(json_extract_string(c, '$.ref'), ':', {i}) AS INT))"
    )
    return f"""(SELECT diag_id, outer_pos, inner_pos, c, {part("surah", 1)} AS surah, {part("ayah", 2)} AS ayah FROM {cells} WHERE json_type(c) = 'OBJECT')"""


REF = "CASE WHEN surah IS NULL OR ayah IS NULL THEN '' ELSE surah || ':' || ayah END"

QUERIES = {
    "p3_pages": lambda s, d: nested.pages_table(load(s, d, "mushaf_pages")),
    "p3_lines": lambda s, d: nested.lines_table(load(s, d, "mushaf_pages")),
    "p3_words": lambda s, d: nested.words_table(load(s, d, "mushaf_pages")),
    "p3_events": lambda s, d: nested.events_table(load(s, d, "diagnostics")),
    "p3_event_fields": lambda s, d: nested.event_fields_table(load(s, d, "diagnostics")),
    "p3_event_indices": lambda s, d: nested.indices_table(load(s, d, "diagnostics")),
    "p3_event_roots": lambda s, d: nested.event_store(load(s, d, "diagnostics")).roots,
    "p3_event_bridge": lambda s, d: nested.event_store(load(s, d, "diagnostics")).bridge,
    "p3_layout_roots": lambda s, d: nested.layout_store(load(s, d, "mushaf_pages")).roots,
    "p3_layout_bridge": lambda s, d: nested.layout_store(load(s, d, "mushaf_pages")).bridge,
    "p3_candidates": lambda s, d: nested.children_table(load(s, d, "diagnostics"), "candidate").drop("others"),
    "p3_surrounding": lambda s, d: nested.children_table(load(s, d, "diagnostics"), "surrounding").drop("others"),
    "p3_objects": lambda s, d: nested.layout_store(load(s, d, "mushaf_pages")).objects.groupBy("kind").agg(F.count(F.lit(1)).alias("objects"), F.sum("occurrences").alias("occurrences")),
    "p3_store": lambda s, d: nested.event_store(load(s, d, "diagnostics")).objects,
    "p3_found": lambda s, d: nested.all_occurrences(load(s, d, "mushaf_pages"), load(s, d, "diagnostics")).select("child", "root_id", "outer_pos", "inner_pos", "verse_ref"),
}

SQL = {
    "p3_pages": f"SELECT page_id, edition, page, len(lines)::INT AS n_lines FROM {PAGES}",
    "p3_lines": f"SELECT page_id, outer_pos, l.line, l.line_type, l.text, l.surah, l.verse_range, l.qpc_v1, len(l.words)::INT AS n_words FROM {LINES} WHERE l IS NOT NULL",
    "p3_words": f"SELECT page_id, outer_pos, inner_pos, w.location, w.word, w.qpc_v1 FROM {WORDS} WHERE w IS NOT NULL",
    "p3_events": f"""SELECT diag_id, outer_pos, e.ts_ms AS ts_ms, lower(e.event_type) AS event_type, v IS NOT NULL AS is_read,
        CASE WHEN json_type(json_extract(v, '$.candidates')) = 'ARRAY' THEN json_array_length(json_extract(v, '$.candidates'))::INT END AS n_candidates,
        CASE WHEN json_type(json_extract(v, '$.surrounding_verses')) = 'ARRAY' THEN json_array_length(json_extract(v, '$.surrounding_verses'))::INT END AS n_surrounding_verses
        FROM {READ} WHERE e IS NOT NULL""",
    "p3_candidates": f"SELECT diag_id, outer_pos, inner_pos, surah, ayah, json_extract_string(c, '$.score')::DOUBLE AS score, json_extract_string(c, '$.surah_name') AS surah_name, {REF} AS verse_ref FROM {_children('candidates')}",
    "p3_surrounding": f"SELECT diag_id, outer_pos, inner_pos, surah, ayah, json_extract_string(c, '$.text') AS text, json_extract_string(c, '$.is_current')::BOOLEAN AS is_current, {REF} AS verse_ref FROM {_children('surrounding_verses')}",
    "p3_objects": f"""SELECT 'line' AS kind, count(DISTINCT l) AS objects, count(*) AS occurrences FROM {LINES} WHERE l IS NOT NULL
        UNION ALL SELECT 'word', count(DISTINCT w), count(*) FROM {WORDS} WHERE w IS NOT NULL""",
    "p3_found": f"""SELECT 'word' AS child, page_id AS root_id, outer_pos, inner_pos, coalesce(w.location, '') AS verse_ref FROM {WORDS} WHERE w IS NOT NULL
        UNION ALL SELECT 'candidate', diag_id, outer_pos, inner_pos, {REF} FROM {_children('candidates')}
        UNION ALL SELECT 'surrounding', diag_id, outer_pos, inner_pos, {REF} FROM {_children('surrounding_verses')}""",
}
