"""The same queries as DuckDB SQL over the test tables."""

from __future__ import annotations

from starscan.schema import COUNT_COLUMNS, HISTOGRAM_COLUMNS, RESULT_COLUMNS

# --- fixed values, written out so that a wrong one in the code under test shows ---
HOME = "Star 7"
RADIUS = 8.0
CLAIMABLE_RULE = "claimable = controlling_faction leer UND faction_count = 0; Permit-/Architekt-/externe Anspruchsstatus werden dabei nicht berücksichtigt"
MESSAGE_CAP = 1900
NO_HITS = "Keine Treffer."
TABLE_HEAD = "System                   Dist  WW  ELW  HMCW  Icy R-Icy  GG  Rng\n----------------------------------------------------------------"
CSV_HEADINGS = {
    "Referenzsystem": "reference_system",
    "System": "name",
    "Distanz (ly)": "distance_ly",
    "WW": "water_world_count",
    "ELW": "earthlike_world_count",
    "HMCW": "hmcw_count",
    "Icy": "icy_world_count",
    "Rocky-Icy": "rocky_icy_world_count",
    "Gas Giants": "gas_giant_count",
    "Rings": "ringed_body_count",
    "Bodies gesamt": "total_bodies",
    "Planeten": "total_planets",
    "Sterne": "total_stars",
    "Population": "population",
    "Faction Count": "faction_count",
    "Controlling Faction": "controlling_faction",
    "Claimable": "claimable",
    "Claimable-Regel": "claimable_rule",
    "Body Types": "body_type_counts",
    "Body Subtypes": "body_subtype_counts",
    "Ring Types": "ring_type_counts",
    "EDSM": "edsm_url",
    "Inara": "inara_url",
    "EDGIS": "edgis_url",
}
# --- end of fixed values ---

HITS = ", ".join(
    ["name", "distance_ly", *COUNT_COLUMNS, "population", "faction_count", "controlling_faction",
     "claimable"]
)


def histogram_text(label: str, source: str = "bodies") -> str:
    """key -> canonical JSON text of one histogram."""
    return f"""
      SELECT k, '{{' || string_agg('"' || {label} || '": ' || n, ', ' ORDER BY {label}) || '}}' AS txt
      FROM (SELECT k, {label}, count(*) AS n FROM {source} WHERE {label} IS NOT NULL
            GROUP BY k, {label})
      GROUP BY k"""


BODIES = """
  bodies AS (
    SELECT l_orderkey AS k,
      CASE l_returnflag WHEN 'N' THEN 'Planet' WHEN 'R' THEN 'Star' ELSE 'Unknown' END AS type,
      CASE WHEN l_returnflag <> 'R' THEN
        CASE p_type WHEN 'ECONOMY' THEN 'Water world' WHEN 'SMALL' THEN 'Earth-like world'
          WHEN 'MEDIUM' THEN 'High metal content world' WHEN 'PROMO' THEN 'icy body'
          WHEN 'LARGE' THEN 'Rocky ice body' WHEN 'STANDARD' THEN 'Gas giant' END END AS subtype,
      CASE WHEN l_linestatus = 'O' THEN
        CASE WHEN p_size % 2 = 0 THEN 'Icy' ELSE 'Metallic' END END AS ring
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""

ROLLUP = """
    SELECT k, count(*)::INT AS total_bodies,
      (count(*) FILTER (type = 'Planet'))::INT AS total_planets,
      (count(*) FILTER (type = 'Star'))::INT AS total_stars,
      (count(*) FILTER (ring IS NOT NULL))::INT AS ringed_body_count,
      (count(*) FILTER (subtype = 'Water world'))::INT AS water_world_count,
      (count(*) FILTER (subtype = 'Earth-like world'))::INT AS earthlike_world_count,
      count(*) FILTER (lower(subtype) IN ('high metal content world', 'high metal content body'))
        AS hmcw, count(*) FILTER (lower(subtype) IN ('icy body', 'icy world')) AS icy,
      count(*) FILTER (lower(subtype) IN ('rocky ice body', 'rocky ice world')) AS rocky,
      count(*) FILTER (lower(subtype) IN ('gas giant', 'water giant', 'helium rich gas giant'))
        AS giants
    FROM bodies GROUP BY k"""

STARS = """
  stars AS (
    SELECT 'addr:' || o_orderkey AS system_key, o_orderkey AS k, 'Star ' || o_orderkey AS name,
      ((o_orderkey * 37) % 401 - 200)::DOUBLE / 8 AS x,
      ((o_orderkey * 53 + o_custkey) % 401 - 200)::DOUBLE / 8 AS y,
      ((o_orderkey * 91) % 401 - 200)::DOUBLE / 8 AS z,
      floor(o_totalprice)::BIGINT AS population,
      CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'P' THEN '' ELSE o_orderpriority END
        AS controlling_faction,
      CASE WHEN o_orderstatus = 'O' OR o_custkey % 3 = 0 THEN 1 ELSE 0 END AS faction_count
    FROM orders)"""


def escaped(text: str) -> str:
    return f"replace(url_encode({text}), '%20', '+')"


SYSTEMS = f"""{BODIES}, rolled AS ({ROLLUP}), type_txt AS ({histogram_text("type")}),
  subtype_txt AS ({histogram_text("subtype")}), ring_txt AS ({histogram_text("ring")}), {STARS},
  systems AS (
    SELECT system_key, s.k, name, x, y, z, population, controlling_faction, faction_count,
      {", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNT_COLUMNS)},
      coalesce(type_txt.txt, '{{}}') AS body_type_counts,
      coalesce(subtype_txt.txt, '{{}}') AS body_subtype_counts,
      coalesce(ring_txt.txt, '{{}}') AS ring_type_counts,
      coalesce(controlling_faction, '') = '' AND coalesce(faction_count, 0) = 0 AS claimable,
      '{CLAIMABLE_RULE}' AS claimable_rule,
      'https://www.edsm.net/en/search/systems/index/name/' || {escaped("name")} AS edsm_url,
      'https://inara.cz/elite/search/?search=' || {escaped("name")} AS inara_url,
      'https://edgis.elitedangereuse.fr/static/sysmap.html?system=' || {escaped("name")}
        AS edgis_url,
      coalesce(hmcw, 0)::INT AS hmcw_count, coalesce(icy, 0)::INT AS icy_world_count,
      coalesce(rocky, 0)::INT AS rocky_icy_world_count,
      (CASE WHEN coalesce(giants, 0) > 0 THEN giants ELSE greatest(0, coalesce(total_planets, 0)
        - coalesce(water_world_count, 0) - coalesce(earthlike_world_count, 0)
        - coalesce(hmcw, 0) - coalesce(icy, 0) - coalesce(rocky, 0)) END)::INT AS gas_giant_count
    FROM stars s LEFT JOIN rolled r ON s.k = r.k LEFT JOIN type_txt ON s.k = type_txt.k
      LEFT JOIN subtype_txt ON s.k = subtype_txt.k LEFT JOIN ring_txt ON s.k = ring_txt.k)"""

FILTERS = {
    "any": "true",
    "ww": "water_world_count > 0",
    "elw": "earthlike_world_count > 0",
    "ww_or_elw": "(water_world_count > 0 OR earthlike_world_count > 0)",
    "ww_and_elw": "(water_world_count > 0 AND earthlike_world_count > 0)",
}
SUPPLIERS = (
    "refs AS (SELECT s_suppkey AS ref_ord, 'STAR ' || s_suppkey AS reference_system FROM supplier)"
)
REFS = "refs(ref_ord, reference_system) AS (VALUES (1, 'Star 7'), (2, 'star 42'), (3, 'Star 1000'))"


def ranked(
    refs: str, radius: float, body_filter: str, limit: int, claimable_only: bool = False
) -> str:
    """CTE ``hits``: every reference's own radius, order and limit."""
    return f"""{SYSTEMS}, {refs},
  located AS (SELECT ref_ord, reference_system, x AS rx, y AS ry, z AS rz
              FROM refs JOIN stars ON lower(name) = lower(reference_system)),
  near AS (SELECT s.*, ref_ord, reference_system,
             sqrt(pow(x - rx, 2) + pow(y - ry, 2) + pow(z - rz, 2)) AS exact
           FROM systems s, located
           WHERE lower(name) <> lower(reference_system) AND {FILTERS[body_filter]}
             AND ({str(not claimable_only).lower()} OR claimable)),
  hits AS (
    SELECT *, row_number() OVER (PARTITION BY ref_ord
      ORDER BY distance_ly, total_bodies DESC, name, system_key)::INT AS rank
    FROM (SELECT *, round(exact, 2) AS distance_ly FROM near WHERE exact <= {radius})
    QUALIFY rank <= {limit})"""


def crowd(sql: str) -> str:
    """The same with every second star pulled towards the origin."""
    for axis in "xyz":
        sql = sql.replace(
            f"::DOUBLE / 8 AS {axis}", f"::DOUBLE / 8 / CASE WHEN o_orderkey % 2 = 0 THEN 32 ELSE 1 END AS {axis}"
        )
    return sql


def home(body_filter: str, limit: int = 200, claimable_only: bool = False) -> str:
    refs = f"refs(ref_ord, reference_system) AS (VALUES (1, '{HOME}'))"
    return f"""WITH {ranked(refs, RADIUS, body_filter, limit, claimable_only)}
    SELECT {HITS} FROM hits"""


def histogram_rows(label: str) -> str:
    return f"""WITH {BODIES} SELECT k AS system_address, {label}, count(*) AS n FROM bodies
    WHERE {label} IS NOT NULL GROUP BY ALL"""


RECORDS = """
  base AS (
    SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p,
      floor(o_totalprice)::BIGINT + {later} AS people, (o_orderkey * 37) % 401 - 200 AS px,
      (o_orderkey * 53) % 401 - 200 AS py, (o_orderkey * 91) % 401 - 200 AS pz
    FROM orders),
  typed AS (
    SELECT k, c, CASE k % 11 WHEN 0 THEN 'Sys ' || k WHEN 1 THEN k::VARCHAR WHEN 2 THEN 'Alt ' || k
        WHEN 3 THEN NULL ELSE 'Star ' || k END AS name,
      CASE WHEN k % 7 IN (1, 2, 6) THEN k WHEN k % 7 IN (4, 5) THEN k * 1000 END AS system_address,
      (CASE k % 5 WHEN 1 THEN NULL WHEN 2 THEN 7 ELSE px END)::DOUBLE AS x,
      CASE k % 5 WHEN 0 THEN abs(py)::DOUBLE + 0.5 WHEN 3 THEN NULL ELSE py::DOUBLE END AS y,
      CASE k % 5 WHEN 3 THEN abs(pz)::DOUBLE + 0.25 WHEN 4 THEN abs(pz)::DOUBLE + 0.125
        ELSE pz::DOUBLE END AS z,
      CASE WHEN k % 4 > 0 THEN people END AS population,
      CASE WHEN k % 13 = 0 THEN NULL WHEN s IN ('O', 'P') OR c % 2 = 0 THEN p END
        AS controlling_faction,
      CASE WHEN k = k % 3 THEN 1 ELSE 2 END AS plain_members, p
    FROM base),
  fields AS (
    SELECT *, CASE WHEN system_address IS NOT NULL THEN 'addr:' || system_address
        WHEN x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL
          THEN 'coords:' || lower(name) || '|' || printf('%.8f|%.8f|%.8f', x, y, z)
        ELSE 'name:' || lower(name) END AS system_key,
      CASE c % 6 WHEN 1 THEN 3 WHEN 3 THEN 2 WHEN 5 THEN plain_members ELSE 0 END
        + CASE WHEN controlling_faction IS NULL OR c % 6 = 3 THEN 0 ELSE 1 END AS faction_count
    FROM typed WHERE name IS NOT NULL),
  record_bodies AS (
    SELECT k, (k + i) % 5 AS t FROM (SELECT k, unnest(range(1, c % 6 + 1)) AS i FROM fields)),
  bodies AS (
    SELECT k, CASE t WHEN 2 THEN 'Star' WHEN 3 THEN 'Unknown' ELSE 'Planet' END AS type,
      CASE t WHEN 1 THEN 'Water world' WHEN 3 THEN 'Earth-like world'
        WHEN 4 THEN 'Icy body é' END AS subtype,
      CASE WHEN t <> 2 THEN 'some' END AS ring, t
    FROM record_bodies WHERE t <> 0),
  rings AS (
    SELECT k, unnest(CASE t WHEN 1 THEN ['Icy'] WHEN 3 THEN ['Metallic', 'Unknown'] ELSE [] END)
      AS ring FROM bodies)"""

RECORD_FIELDS = """system_key, system_address, name, x, y, z, population, controlling_faction,
      faction_count::INT AS faction_count"""
RECORD_COUNTS = ", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNT_COLUMNS)


def records(later: int = 0) -> str:
    return f"WITH {RECORDS.replace('{later}', str(later))}, rolled AS ({ROLLUP})"


def imported(later: int) -> str:
    return f"""{records(later)} SELECT {RECORD_FIELDS}, {RECORD_COUNTS}
    FROM fields LEFT JOIN rolled USING (k)
    QUALIFY row_number() OVER (PARTITION BY system_key ORDER BY k DESC) = 1"""


def scanned(rows_per_file: int) -> str:
    """Named records with their file and their place among all records of the file."""
    return f"""{records()}, places AS (
      SELECT k, k // {rows_per_file} AS file_no,
        row_number() OVER (PARTITION BY k // {rows_per_file} ORDER BY k) AS place FROM typed)
    SELECT file_no, place, true AS tagged, {RECORD_FIELDS}, {RECORD_COUNTS}
    FROM fields JOIN places USING (k) LEFT JOIN rolled USING (k)"""


CELLS = {
    "distance_ly": "distance_ly::VARCHAR",
    "claimable": "CASE WHEN claimable THEN 'yes' ELSE 'no' END",
}


def cell(source: str) -> str:
    return f"coalesce({CELLS.get(source, source + '::VARCHAR')}, '')"


def csv_cell(source: str) -> str:
    value = cell(source)
    return f"""CASE WHEN regexp_matches({value}, '[;"\\r\\n]')
      THEN '"' || replace({value}, '"', '""') || '"' ELSE {value} END"""


REPORT = ranked(REFS, RADIUS, "ww_or_elw", 40)
CSV_HEADER = ";".join(CSV_HEADINGS)

TABLE_LINE = """rpad(name[1:22], 22, ' ') || ' ' || printf('%6.1f', distance_ly) || ' '
    || printf('%3d %4d %5d %4d %5d %3d %4d', water_world_count, earthlike_world_count, hmcw_count,
        icy_world_count, rocky_icy_world_count, gas_giant_count, ringed_body_count)"""


def packed(radius: float, limit: int) -> str:
    """Rows are packed one after the other by a recursive walk over each reference's ranks."""
    return f"""WITH RECURSIVE {ranked(REFS, radius, "ww_or_elw", limit)},
  lines AS (
    SELECT ref_ord, rank, {TABLE_LINE} AS line,
      '- **' || name || '** | [Inara](' || inara_url || ') | [EDGIS](' || edgis_url || ')' AS link
    FROM hits),
  frames AS (
    SELECT ref_ord, reference_system, '## ' || reference_system AS title,
      'Radius: **{radius:.1f} ly** | Filter: **ww_or_elw** | Claimable only: **no** | Limit: '
        || '**{limit}** | Treffer: **' || (SELECT count(*) FROM lines l WHERE l.ref_ord = r.ref_ord)
        || '**' AS info
    FROM refs r),
  walk(ref_ord, rank, part, used) AS (
    SELECT ref_ord, 0, 0, 1000000 FROM frames
    UNION ALL
    SELECT w.ref_ord, l.rank,
      CASE WHEN used + 2 + length(line) + length(link) > {MESSAGE_CAP} THEN part + 1 ELSE part END,
      (CASE WHEN used + 2 + length(line) + length(link) > {MESSAGE_CAP}
        THEN length(title || chr(10) || info || chr(10) || '```text' || chr(10) || $head$
             || chr(10) || line || chr(10) || '```' || chr(10) || link)
        ELSE used + 2 + length(line) + length(link) END)::INT
    FROM walk w JOIN lines l ON l.ref_ord = w.ref_ord AND l.rank = w.rank + 1
      JOIN frames f ON f.ref_ord = w.ref_ord),
  parts AS (
    SELECT w.ref_ord, part, string_agg(line, chr(10) ORDER BY w.rank) AS body,
      string_agg(link, chr(10) ORDER BY w.rank) AS links,
      count(*) OVER (PARTITION BY w.ref_ord) AS part_count
    FROM walk w JOIN lines l ON l.ref_ord = w.ref_ord AND l.rank = w.rank
    GROUP BY w.ref_ord, part)
  SELECT f.ref_ord, reference_system, coalesce(part, 1)::INT AS part_no,
    coalesce(part_count, 1)::INT AS part_count,
    CASE WHEN part IS NULL THEN title || chr(10) || info || chr(10) || chr(10) || '{NO_HITS}'
    ELSE title || CASE WHEN part_count > 1
        THEN chr(10) || 'Teil ' || part || '/' || part_count ELSE '' END
      || chr(10) || info || chr(10) || '```text' || chr(10) || $head$ || chr(10) || body || chr(10)
      || '```' || chr(10) || links END AS content
  FROM frames f LEFT JOIN parts p ON f.ref_ord = p.ref_ord""".replace(
        "$head$", " || chr(10) || ".join(f"'{line}'" for line in TABLE_HEAD.split("\n"))
    )


ORACLES: dict[str, str] = {
    "radius_topk": home("any"),
    "radius_any": home("any", limit=1000),
    **{f"radius_{name}": home(name) for name in ("ww", "elw", "ww_or_elw", "ww_and_elw")},
    "claimable_only": home("any", claimable_only=True),
    "query_systems": f"""WITH {ranked(
        f"refs(ref_ord, reference_system) AS (VALUES (1, '{HOME.upper()}'))",
        RADIUS, "ww_or_elw", 200)}
    SELECT ref_ord, rank, {", ".join(RESULT_COLUMNS)} FROM hits""",
    "query_catalog": f"""WITH {ranked(
        f"refs(ref_ord, reference_system) AS (VALUES (1, '{HOME.upper()}'))",
        RADIUS, "ww_or_elw", 200)}
    SELECT ref_ord, rank, {", ".join(RESULT_COLUMNS)} FROM hits""",
    "missing_references": f"""WITH {STARS}, asked AS (
      SELECT 'sTAR ' || (c_custkey * 13) AS reference_system FROM customer)
    SELECT reference_system FROM asked
    WHERE lower(reference_system) NOT IN (SELECT lower(name) FROM stars)""",
    "run_log_sources": " UNION ALL ".join(
        f"""SELECT {load}::BIGINT AS load, o_orderkey // {4000 * load} AS file_no, count(*) AS records
    FROM orders GROUP BY ALL""" for load in (1, 2)),
    "typed_tables": f"""WITH {SYSTEMS} SELECT system_key, name, x, y, z, population,
      {", ".join(COUNT_COLUMNS)} FROM systems""",
    "table_statistics": f"WITH {SYSTEMS} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", min({c})::INT AS least, max({c})::INT AS largest,
      (count(*) - count({c}))::INT AS nulls, 254 AS bins, count({c}) / 254.0::DOUBLE AS rows_per_bin
    FROM systems""" for c in COUNT_COLUMNS),
    "query_systems_without_links": f"""WITH {ranked(
        f"refs(ref_ord, reference_system) AS (VALUES (1, '{HOME}'))", RADIUS, "ww_or_elw", 50)}
    SELECT name, '' AS edsm_url, 'https://inara.cz/elite/starsystem/?search=' || {escaped("name")}
      AS inara_url, edgis_url FROM hits""",
    "reference_lookup": f"""WITH {STARS}, asked AS (
      SELECT 'sTAR ' || (c_custkey * 7) AS reference_system FROM customer)
    SELECT reference_system, x AS rx, y AS ry, z AS rz
    FROM asked LEFT JOIN stars ON lower(name) = lower(reference_system)""",
    "multi_ref_topk": f"""WITH {ranked(REFS, RADIUS, "any", 60)}
    SELECT ref_ord, reference_system, rank, {HITS} FROM hits""",
    "multi_ref_union": f"""WITH {ranked(REFS, RADIUS, "ww_or_elw", 40, True)}
    SELECT ref_ord, rank, {", ".join(RESULT_COLUMNS)} FROM hits ORDER BY ref_ord, rank""",
    "multi_ref_grid": f"""WITH {ranked(SUPPLIERS, 4.0, "ww_or_elw", 5)}
    SELECT reference_system, rank, name, distance_ly, total_bodies FROM hits""",
    "radius_crowded": crowd(f"""WITH {STARS}, {SUPPLIERS},
    located AS (SELECT reference_system, x AS rx, y AS ry, z AS rz
                FROM refs JOIN stars ON lower(name) = lower(reference_system)),
    pairs AS (SELECT reference_system, system_key,
                sqrt(pow(x - rx, 2) + pow(y - ry, 2) + pow(z - rz, 2)) AS exact FROM stars, located)
    SELECT reference_system, system_key, round(exact, 2) AS distance_ly FROM pairs WHERE exact <= 0.2"""),
    "nearest_crowded": crowd(f"""WITH {ranked(SUPPLIERS, 4.0, "ww_or_elw", 200)}
    SELECT reference_system, rank, name, distance_ly, total_bodies FROM hits"""),
    "vector_radius": """WITH points AS (
      SELECT vec_id, label, thirds[1] / 50 AS x, thirds[2] / 50 AS y, thirds[3] / 50 AS z
      FROM (SELECT vec_id, label, [list_sum([floor(embedding[i]::DOUBLE * 1000)
        FOR i IN range(n, len(embedding) + 1, 3)])::DOUBLE FOR n IN [1, 2, 3]] AS thirds
        FROM embeddings)),
    refs AS (SELECT * FROM points
             QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)
    SELECT r.label AS ref_label, p.vec_id, round(
      sqrt(pow(p.x - r.x, 2) + pow(p.y - r.y, 2) + pow(p.z - r.z, 2)), 2) AS distance
    FROM points p, refs r
    WHERE p.vec_id <> r.vec_id
      AND sqrt(pow(p.x - r.x, 2) + pow(p.y - r.y, 2) + pow(p.z - r.z, 2)) <= 10.0""",
    "body_totals": f"""WITH {BODIES}, rolled AS ({ROLLUP})
    SELECT k AS system_address, {", ".join(COUNT_COLUMNS)} FROM rolled""",
    "type_hist": histogram_rows("type"),
    "subtype_hist": histogram_rows("subtype"),
    "ring_hist": histogram_rows("ring"),
    "canonical_json": f"WITH {SYSTEMS} SELECT name, {', '.join(HISTOGRAM_COLUMNS)} FROM systems",
    "derived_counts": f"""WITH {SYSTEMS} SELECT name, hmcw_count, icy_world_count,
      rocky_icy_world_count, gas_giant_count FROM systems""",
    "alias_sum": """SELECT event_id,
      CASE WHEN event_type = 'error' THEN 0 ELSE json_extract(props, '$.k')::INT END AS k_sum,
      CASE WHEN event_type = 'error' THEN 0 ELSE json_array_length(json_keys(props))::INT END
        AS key_count FROM events""",
    "record_fields": f"{records()} SELECT k AS record_no, {RECORD_FIELDS} FROM fields",
    "record_rollup": f"""{records()}, type_txt AS ({histogram_text("type")}),
      subtype_txt AS ({histogram_text("subtype")}), ring_txt AS ({histogram_text("ring", "rings")})
    SELECT fields.k AS record_no, {RECORD_COUNTS},
      coalesce(type_txt.txt, '{{}}') AS body_type_counts,
      coalesce(subtype_txt.txt, '{{}}') AS body_subtype_counts,
      coalesce(ring_txt.txt, '{{}}') AS ring_type_counts
    FROM fields LEFT JOIN rolled ON fields.k = rolled.k LEFT JOIN type_txt ON fields.k = type_txt.k
      LEFT JOIN subtype_txt ON fields.k = subtype_txt.k
      LEFT JOIN ring_txt ON fields.k = ring_txt.k""",
    "dump_scan": scanned(50_000),
    "dump_scan_any_layout": scanned(50_000),
    "dump_scan_gzip": scanned(50_000),
    "dump_first_records": f"""{records()}, places AS (
      SELECT k, row_number() OVER (ORDER BY (k // 4000)::VARCHAR, k) AS place FROM typed)
    SELECT {RECORD_FIELDS}, {RECORD_COUNTS}
    FROM fields JOIN places USING (k) LEFT JOIN rolled USING (k) WHERE place <= 5555""",
    "import_full": imported(1),
    "import_patch": imported(1),
    "import_statistics": f"""{records()}, counts AS (
      SELECT (SELECT 2 * count(*) FROM orders) AS seen, 2 * count(*) AS named,
        count(DISTINCT system_key) AS keys FROM fields)
    SELECT 'schema_version' AS key, '4' AS value
    UNION ALL SELECT 'last_import_mode', 'full'
    UNION ALL SELECT 'last_import_systems_seen', named::VARCHAR FROM counts
    UNION ALL SELECT 'last_import_systems_written', keys::VARCHAR FROM counts
    UNION ALL SELECT 'converted_seen', seen::VARCHAR FROM counts
    UNION ALL SELECT 'converted_written', named::VARCHAR FROM counts""",
    "staged_roundtrip": f"""WITH {SYSTEMS} SELECT k AS seq, name, x, y, z,
      {", ".join(COUNT_COLUMNS)}, {", ".join(HISTOGRAM_COLUMNS)}, 'orders' AS source_tag
    FROM systems""",
    "keep_latest": """SELECT user_id, event_id, event_type, value, props FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    "load_counts": """SELECT count(*) AS row_count, count(DISTINCT user_id) AS distinct_keys
    FROM events""",
    "patch_upsert": """
    SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation,
      CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer
    UNION ALL
    SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
    WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)""",
    "run_log_latest": """SELECT event_type || '/' || user_id AS key, props AS value FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, props DESC) = 1""",
    "links": f"""SELECT conv_id, turn, '{{bad' AS edsm_url,
      'https://example.org/' || {escaped("text")} || '?q=' || text AS inara_url,
      'https://edgis.elitedangereuse.fr/static/sysmap.html?system=' || {escaped("text")}
        AS edgis_url, '{{' || {escaped("text")} || '}}' AS braced
    FROM conversations""",
    "report_rows": f"""WITH {REPORT} SELECT {", ".join(
        f'{cell(source)} AS "{head}"' for head, source in CSV_HEADINGS.items())} FROM hits""",
    "csv_report": f"""WITH {REPORT} SELECT '{CSV_HEADER}' AS value UNION ALL
    SELECT {" || ';' || ".join(csv_cell(source) for source in CSV_HEADINGS.values())} FROM hits""",
    "json_report": f"WITH {REPORT} SELECT {', '.join(RESULT_COLUMNS)} FROM hits",
    "table_lines": f"""WITH {SYSTEMS} SELECT name, {TABLE_LINE} AS line
    FROM (SELECT *, population / 100.0::DOUBLE AS distance_ly FROM systems)""",
    "pack_messages": packed(RADIUS, 40),
    "pack_messages_long": packed(100.0, 1_000_000),
    "empty_message": packed(0.05, 200),
}
