"""Queries of problem 3: typed venues mapped to the reference list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import venues as V
from ledgerloom.runtime import materialize, table

_RECORDS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, id AS row_id, venue FROM {{{t}}} WHERE id IS NOT NULL" for t in V.TABLES)
#: White space that makes a value blank, as a class for either dialect.
_BLANK = r"[\\s\\u00a0\\u2000-\\u200b\\u3000]"


def _typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One row per record that has a venue that isn't an entry letter for letter, and the list."""
    names = table(spark, sf_dir, "venues")
    rows = spark.sql(
        f"""
        WITH r AS (SELECT table_name, row_id, max(venue) AS value FROM ({_RECORDS}) WHERE regexp_replace(venue, '{_BLANK}', '') <> '' GROUP BY table_name, row_id)
        SELECT r.* FROM r LEFT ANTI JOIN {{names}} n ON r.value = n.venue_name
        """,
        names=names,
        **{t: table(spark, sf_dir, t).select("id", "venue") for t in V.TABLES},
    )
    return rows, names


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _typed(spark, sf_dir)
    rows = materialize(rows, "venue-rows")
    values = materialize(spark.sql("SELECT DISTINCT value FROM {rows}", rows=rows), "venue-values")
    mapped = V.map_values(spark, values, names)
    return spark.sql("SELECT r.table_name, r.row_id, m.venue_id FROM {rows} r JOIN {mapped} m ON r.value = m.value", rows=rows, mapped=mapped)


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that name no entry, with the number of records they stand on."""
    rows, names = _typed(spark, sf_dir)
    rows = materialize(rows, "venue-rows")
    values = materialize(spark.sql("SELECT DISTINCT value FROM {rows}", rows=rows), "venue-values")
    return spark.sql("SELECT r.value, count(*) AS n FROM {rows} r JOIN {mapped} m ON r.value = m.value WHERE m.venue_id = 0 GROUP BY r.value", rows=rows, mapped=V.map_values(spark, values, names))


def _oracle(last: str) -> str:
    """The same mapping in DuckDB, by comparing every value with every string of the list."""
    words = lambda c, keep: f"list_filter(string_split({c}, ' '), lambda x: x <> '' AND {'' if keep else 'NOT '}list_contains([{', '.join(repr(w) for w in V.TYPE_WORDS)}], x))"
    bones = lambda ws: f"array_to_string(list_transform({ws}, lambda x: left(x, 1) || translate(substring(x, 2, greatest(length(x) - 2, 0)), 'aeiou', '') || CASE WHEN length(x) > 1 THEN right(x, 1) ELSE '' END), '')"
    canonical = lambda c: V.canonical(c, "\\1")
    places = f"string_split(trim({canonical("concat_ws(' ', area, city)")}), ' ')"
    rows = " UNION ALL ".join(f"SELECT '{t}' AS table_name, id AS row_id, venue FROM {t} WHERE id IS NOT NULL" for t in V.TABLES)
    return rf"""
    WITH r AS (SELECT table_name, row_id, max(venue) AS value FROM ({rows}) WHERE regexp_replace(venue, '[\s\x{{a0}}\x{{2000}}-\x{{200b}}\x{{3000}}]', '', 'g') <> '' GROUP BY 1, 2),
    m AS (SELECT * FROM r WHERE value NOT IN (SELECT venue_name FROM venues WHERE venue_name IS NOT NULL)),
    w AS (SELECT venue_id, {canonical("venue_name")} AS c, lower(regexp_replace(short_name, '[^A-Za-z0-9]', '', 'g')) AS short, {places} AS places FROM venues),
    p AS (SELECT venue_id, short, places, array_to_string({words("c", False)}, '') AS base, {bones(words("c", False))} AS bones, array_to_string({words("c", True)}, '') AS kind, array_to_string(list_transform({words("c", True)}, lambda x: left(x, 1)), '') AS initials FROM w),
    a0 AS (SELECT venue_id, base || kind AS s, bones || ' ' || kind AS bones, places, 2 AS most FROM p
           UNION ALL SELECT venue_id, base, NULL, places, 1 FROM p WHERE kind <> '' AND base <> '' AND base IN (SELECT base FROM p GROUP BY base HAVING count(*) = 1)
           UNION ALL SELECT venue_id, short, NULL, places, 0 FROM p WHERE short <> ''
           UNION ALL SELECT venue_id, base || initials, NULL, places, 2 FROM p WHERE length(initials) > 1 AND base <> ''),
    a AS (SELECT *, CASE WHEN length(s) < 6 THEN 0 WHEN length(s) < 9 THEN least(most, 1) ELSE most END AS k FROM a0 WHERE s <> ''),
    g AS (SELECT (SELECT list(DISTINCT x) FROM (SELECT unnest({places}) AS x FROM venues)) AS places, (SELECT list(DISTINCT x) FROM (SELECT unnest(string_split({canonical("venue_name")}, ' ')) AS x FROM venues)) AS used),
    t0 AS (SELECT value, string_split({canonical("value")}, ' ') AS ws FROM (SELECT DISTINCT value FROM m)),
    t1 AS (SELECT value, list_filter(ws, lambda x: list_contains(g.places, x)) AS places, array_to_string(list_filter(ws, lambda x: NOT list_contains(g.places, x) OR list_contains(g.used, x)), ' ') AS ws FROM t0, g),
    t2 AS (SELECT value, places, {words("ws", False)} AS base, {words("ws", True)} AS kind FROM t1),
    t AS (SELECT value, places, array_to_string(base, '') || array_to_string(kind, '') AS s,
                 CASE WHEN len(list_filter(base, lambda x: length(x) > 2 AND substring(x, 2, length(x) - 2) = translate(substring(x, 2, length(x) - 2), 'aeiou', ''))) > 0 THEN {bones("base")} || ' ' || array_to_string(kind, '') END AS bones FROM t2),
    d AS (SELECT t.value, a.venue_id, min(levenshtein(t.s, a.s)) AS distance, max(CASE WHEN list_has_any(t.places, a.places) THEN 1 ELSE 0 END) AS here FROM t JOIN a ON abs(length(t.s) - length(a.s)) <= a.k AND levenshtein(t.s, a.s) <= a.k GROUP BY 1, 2),
    top AS (SELECT value, CASE WHEN count(*) = 1 THEN min(venue_id) ELSE 0 END AS venue_id FROM (SELECT *, rank() OVER (PARTITION BY value ORDER BY distance, here DESC) AS pos FROM d) WHERE pos = 1 GROUP BY value),
    b AS (SELECT bones, min(venue_id) AS venue_id FROM a WHERE bones IS NOT NULL GROUP BY bones HAVING count(DISTINCT venue_id) = 1),
    mapped AS (SELECT t.value, coalesce(top.venue_id, b.venue_id, 0) AS venue_id FROM t LEFT JOIN top ON t.value = top.value LEFT JOIN b ON t.bones = b.bones)
    {last}"""


QUERIES = {"p3_found": p3_found, "p3_unmatched": p3_unmatched}
SQL = {
    "p3_found": _oracle("SELECT m.table_name, m.row_id, mapped.venue_id FROM m JOIN mapped ON m.value = mapped.value"),
    "p3_unmatched": _oracle("SELECT m.value, count(*) AS n FROM m JOIN mapped ON m.value = mapped.value WHERE mapped.venue_id = 0 GROUP BY m.value"),
}
