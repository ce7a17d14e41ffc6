"""Mapping free-typed values to a reference list, in SQL only.

A value and every list entry are brought to one canonical string: lower case, without accents, without words that only
say where inside or how (halls, gates, "near", "tbc"), without the list's own areas and cities, spelled-out venue types,
types moved behind the name, no spaces. The list gives further strings for an entry: its short name, its name without
the type where no other entry has it, and its name with the type's initials.

Then a partition-based pigeonhole join: each list string is cut into k+1 segments; k edits leave at least one segment
intact, so an equality join of the segments with the typed string's substrings, at the positions that k edits can reach,
finds every pair within k edits. The built-in levenshtein verifies them. Values found nowhere come from an anti-join,
and get a last equality join on consonants, for words typed without vowels; the rest is reported with id 0.

Edge cases: null and blank values are not mapped and give no row; the nearest entry wins; of equally near entries the
one whose area or city stands in the value; if that leaves a tie, the value is ambiguous and gets 0; an empty list maps
every value to 0; repeated values are mapped once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.runtime import materialize, scratch

# --- fixed values: words and their canonical forms -------------------------------------------------------------------
ACCENTS = ("áàâäãåāéèêëēíìîïīóòôöõōúùûüūçñýÿ", "aaaaaaaeeeeeiiiiioooooouuuuucnyy")
PLACES_INSIDE = "car park|loading bay|gf unit|gf|unit|hall|gate|zone|level|ballroom|floor|room|stand|stage|block|bay|entrance|door|wing|plot"
PADDING = "tbc|tba|tbd|near|inside|behind|opposite|entrance|delivery to|event at|install at|setup at"
STOP = "the|el|al|of|at|and|in|on|de|du|la|le"
TYPES = {
    "school": "sch|schl|skool|scool|shcool",
    "mall": "mal|maal|shopping  mall|shopping  mal|shopping  centre|shopping  center",
    "tower": "twr|towers|towr|tours",
    "resort": "rst|resort  spa|rst  spa|resorts|rsrt",
    "village": "vill|vlg|villg|vllg",
    "marina": "mrna|marina  walk|mrna  walk|marna",
    "waterfront": "wfront|water  front|wtrfront|waterfrnt",
    "park": "pk|prk|parc",
    "creek": "crk|crik",
    "souk": "suq|souq|suk|souks",
    "gardens": "gdns|garden|gdn|gardn",
    "nursery": "nurs|nursary|nurserie|nsry",
    "club": "clb|klub",
    "beach": "bch|beech",
    "centre": "center|ctr|cntr|cntre|cent",
    "community": "comm|commun|cmty|comunity",
    "convention": "conv|convn|convent",
    "exhibition": "exh|exhib|exhibn|exhbn|expo",
    "international": "int|intl|internat|intern",
    "heritage": "hert|herit|hrtg",
    "quarter": "qtr|qrtr|quarters",
    "sports": "sport|spt|spts",
    "hotel": "htl",
    "museum": "mus|musm",
    "stadium": "stad|stdm",
    "theatre": "theater|thtr",
    "university": "univ|uni",
    "hospital": "hosp",
    "airport": "arpt",
}
TYPE_WORDS = sorted({*TYPES, "hall", "walk", "city", "golf", "arena", "plaza", "palace", "college", "terminal", "cinema"})
# ----------------------------------------------------------------------------------------------------------------------
TABLES = ("quotations", "invoices", "jobs")


def canonical(value: str, group: str = "$1") -> str:
    """SQL for the words of a value, single-spaced; the same text runs in Spark and, with group '\\1', in DuckDB."""
    tail = ", 'g'" if group != "$1" else ""

    def sub(s: str, pattern: str, by: str) -> str:
        return f"regexp_replace({s}, '{pattern}', '{by}'{tail})"

    apart = sub(sub(value, "(of|at)([A-Z])", f" {group} {group.replace('1', '2')}"), "([A-Z])", f" {group}")
    camel = f"CASE WHEN regexp_like({value}, '^([A-Z][a-z]+)([A-Z][a-z]+)+$') THEN {apart} ELSE {value} END"
    if group != "$1":
        camel = camel.replace("regexp_like", "regexp_matches")
    s = f"translate(lower({camel}), '{ACCENTS[0]}', '{ACCENTS[1]}')"
    s = sub(s, "[.`]|’|''", "")
    s = sub(s, "w/front", "waterfront")
    s = sub(s, "[^a-z0-9]+", " ")
    s = f"concat(' ', trim({s}), ' ')"
    for _ in range(2):
        s = sub(s, f" ({PLACES_INSIDE}) ([0-9]+|[a-z])( |$)", " ")
    for _ in range(2):
        s = sub(s, f" ({PADDING}) ", " ")
    s = f"replace({s}, ' ', '  ')"
    s = sub(s, f" ({STOP}) ", " ")
    s = sub(s, " creekwalk ", " creek  walk ")
    s = f"replace({sub(s, ' +', ' ')}, ' ', '  ')"
    for word, others in TYPES.items():
        s = sub(s, f" ({others}) ", f" {word} ")
    return f"trim({sub(s, ' +', ' ')})"


def segments(k: int, length: str) -> list[tuple[int, str, str]]:
    """Number, start and length, in SQL, of the k+1 segments of a string of the given length; the last ones are longer."""
    n = k + 1
    base, cut = f"floor({length} / {n})", f"({n} - {length} % {n})"
    return [(i, f"CAST({i} * {base} + greatest(0, {i} - {cut}) + 1 AS INT)", f"CAST({base} + CASE WHEN {i} >= {cut} THEN 1 ELSE 0 END AS INT)") for i in range(n)]


def _words(s: str, keep_types: bool) -> str:
    listed = "array(" + ", ".join(f"'{w}'" for w in TYPE_WORDS) + ")"
    return f"filter(split({s}, ' '), w -> w <> '' AND {'' if keep_types else 'NOT '}array_contains({listed}, w))"


def _bones(words: str) -> str:
    """SQL: the words without the vowels inside them, as in "Plgst" for "Plegost"."""
    return f"array_join(transform({words}, w -> concat(left(w, 1), translate(substring(w, 2, greatest(length(w) - 2, 0)), 'aeiou', ''), CASE WHEN length(w) > 1 THEN right(w, 1) ELSE '' END)), '')"


def aliases(spark: SparkSession, venues: DataFrame) -> DataFrame:
    """The list's strings: venue_id, s, its number of edits k, its consonants (for full names) and its places."""
    listed = spark.sql(
        f"""
        WITH w AS (SELECT venue_id, {canonical("venue_name")} AS c, lower(regexp_replace(short_name, '[^A-Za-z0-9]', '')) AS short,
                          array_distinct(split(trim({canonical("concat_ws(' ', area, city)")}), ' ')) AS places FROM {{venues}} WHERE venue_id IS NOT NULL AND venue_name IS NOT NULL),
        p AS (SELECT venue_id, short, places, array_join({_words("c", False)}, '') AS base, {_bones(_words("c", False))} AS bones, array_join({_words("c", True)}, '') AS kind,
                     array_join(transform({_words("c", True)}, t -> left(t, 1)), '') AS initials FROM w),
        u AS (SELECT base, count(*) AS n FROM p GROUP BY base)
        SELECT venue_id, concat(base, kind) AS s, bones || ' ' || kind AS bones, places, 2 AS most FROM p
        UNION ALL SELECT venue_id, p.base, NULL, places, 1 FROM p JOIN u ON p.base = u.base AND u.n = 1 WHERE kind <> '' AND p.base <> ''
        UNION ALL SELECT venue_id, short, NULL, places, 0 FROM p WHERE short <> ''
        UNION ALL SELECT venue_id, concat(base, initials), NULL, places, 2 FROM p WHERE length(initials) > 1 AND base <> ''
        """,
        venues=venues,
    )
    return spark.sql("SELECT venue_id, s, bones, places, CAST(CASE WHEN length(s) < 6 THEN 0 WHEN length(s) < 9 THEN least(most, 1) ELSE most END AS INT) AS k FROM {listed} WHERE s <> ''", listed=listed)


def typed_forms(spark: SparkSession, values: DataFrame, venues: DataFrame) -> DataFrame:
    """Per distinct typed value: its string without the list's places, its consonants where a word lacks vowels, its places."""
    return spark.sql(
        f"""
        WITH place AS (SELECT DISTINCT explode(split(trim({canonical("concat_ws(' ', area, city)")}), ' ')) AS word FROM {{venues}}),
        used AS (SELECT DISTINCT explode(split({canonical("venue_name")}, ' ')) AS word FROM {{venues}}),
        known AS (SELECT p.word, u.word IS NOT NULL AS both FROM place p LEFT JOIN used u ON p.word = u.word),
        each AS (SELECT value, posexplode(split({canonical("value")}, ' ')) AS (at, word) FROM {{values}}),
        told AS (SELECT e.value, struct(e.at, e.word, k.word IS NOT NULL AS place, coalesce(k.both, true) AS kept) AS w FROM each e LEFT JOIN known k ON e.word = k.word),
        whole AS (SELECT value, array_sort(collect_list(w)) AS ws FROM told GROUP BY value),
        r AS (SELECT value, transform(filter(ws, x -> x.place), x -> x.word) AS places, transform(filter(ws, x -> x.kept), x -> x.word) AS w FROM whole),
        p AS (SELECT value, places, {_words("array_join(w, ' ')", False)} AS base, {_words("array_join(w, ' ')", True)} AS kind FROM r)
        SELECT value, places, concat(array_join(base, ''), array_join(kind, '')) AS s,
               CASE WHEN exists(base, w -> length(w) > 2 AND substring(w, 2, length(w) - 2) = translate(substring(w, 2, length(w) - 2), 'aeiou', '')) THEN {_bones("base")} || ' ' || array_join(kind, '') END AS bones
        FROM p
        """,
        values=values,
        venues=venues,
    )


def pigeonhole_pairs(spark: SparkSession, typed: DataFrame, listed: DataFrame, most: int = 2) -> DataFrame:
    """(value, venue_id, distance, places, listed_places) for all pairs of strings within the list string's own k edits.

    For k = 0 this is plain equality; for each k from 1 to most, one equality join on (length, segment number, text)."""
    parts = ["SELECT t.value, a.venue_id, 0 AS distance, t.places, a.places AS listed_places FROM {typed} t JOIN {listed} a ON t.s = a.s"]
    for k in range(1, most + 1):
        cut = ", ".join(f"struct({i} AS i, substring(s, {at}, {n}) AS part)" for i, at, n in segments(k, "length(s)"))
        probes = []
        for i, at, n in segments(k, "l"):
            low, high = f"greatest(1, {at} - {i}, {at} + (length(s) - l) - {k - i})", f"least({at} + {i}, {at} + (length(s) - l) + {k - i}, length(s) - {n} + 1)"
            probes.append(f"CASE WHEN {low} <= {high} THEN transform(sequence({low}, {high}), p -> struct(l AS l, {i} AS i, substring(s, p, {n}) AS part)) ELSE array() END")
        parts.append(
            f"""
            SELECT DISTINCT t.value, a.venue_id, levenshtein(t.s, a.s, {k}) AS distance, t.places, a.places AS listed_places
            FROM (SELECT value, s, places, explode(array_distinct(flatten(transform(sequence(greatest({k + 1}, length(s) - {k}), length(s) + {k}), l -> concat({", ".join(probes)}))))) AS q FROM {{typed}} WHERE length(s) > {k}) t
            JOIN (SELECT venue_id, s, places, length(s) AS l, explode(array({cut})) AS q FROM {{listed}} WHERE k = {k} AND length(s) > {k}) a
              ON t.q.l = a.l AND t.q.i = a.q.i AND t.q.part = a.q.part
            WHERE levenshtein(t.s, a.s, {k}) > 0
            """
        )
    return spark.sql(" UNION ALL ".join(parts), typed=typed, listed=listed)


def best(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """value, venue_id: the nearest entry, by place among equals, 0 where entries still tie."""
    return spark.sql(
        """
        WITH one AS (SELECT value, venue_id, min(distance) AS distance, max(CASE WHEN arrays_overlap(places, listed_places) THEN 1 ELSE 0 END) AS here FROM {pairs} GROUP BY value, venue_id),
        ranked AS (SELECT value, struct(distance, -here AS there) AS rank, venue_id FROM one),
        top AS (SELECT value, min(struct(rank, venue_id)) AS a, max_by(venue_id, struct(-rank.distance AS d, -rank.there AS h, venue_id)) AS z FROM ranked GROUP BY value)
        SELECT value, CASE WHEN a.venue_id = z THEN z ELSE 0L END AS venue_id FROM top
        """,
        pairs=pairs,
    )


def map_values(spark: SparkSession, values: DataFrame, venues: DataFrame) -> DataFrame:
    """value, venue_id for the distinct non-blank strings of values(value); 0 reports a value with no entry."""
    with scratch(spark) as keep:
        typed = materialize(typed_forms(spark, values, venues), "venue-typed")
        listed = materialize(aliases(spark, venues), "venue-listed")
        found = materialize(best(spark, pigeonhole_pairs(spark, typed, listed)), "venue-found")
        left = spark.sql("SELECT t.value, t.bones FROM {typed} t LEFT ANTI JOIN {found} f ON t.value = f.value", typed=typed, found=found)
        mapped = spark.sql(
            """
            WITH bones AS (SELECT bones, min(venue_id) AS venue_id FROM {listed} WHERE bones IS NOT NULL GROUP BY bones HAVING count(DISTINCT venue_id) = 1)
            SELECT value, venue_id FROM {found}
            UNION ALL SELECT l.value, coalesce(b.venue_id, 0L) FROM {left} l LEFT JOIN bones b ON l.bones = b.bones
            """,
            found=found,
            left=left,
            listed=listed,
        )
        return keep(mapped, "venue-mapped")
