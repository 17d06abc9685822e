"""Search results as report rows, CSV lines and size-capped messages."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starscan.functions.counts import NO_COUNTS, canonical_json, derived_counts
from starscan.functions.links import link_columns
from starscan.functions.text import literal, number_text, one_decimal, pad_left, pad_right
from starscan.schema import HISTOGRAM_COLUMNS, RESULT_COLUMNS
from starscan.session import scratch_path

# --- fixed values: report texts, headings and widths ---
CLAIMABLE_RULE = (
    "claimable = controlling_faction leer UND faction_count = 0; "
    "Permit-/Architekt-/externe Anspruchsstatus werden dabei nicht berücksichtigt"
)
NO_HITS = "Keine Treffer."
MESSAGE_CAP = 1900
NAME_WIDTH = 22
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
TABLE_COLUMNS = [  # heading, width, count column
    ("WW", 3, "water_world_count"),
    ("ELW", 4, "earthlike_world_count"),
    ("HMCW", 5, "hmcw_count"),
    ("Icy", 4, "icy_world_count"),
    ("R-Icy", 5, "rocky_icy_world_count"),
    ("GG", 3, "gas_giant_count"),
    ("Rng", 4, "ringed_body_count"),
]
TABLE_HEADER = " ".join(
    [f"{'System':<{NAME_WIDTH}}", f"{'Dist':>6}", *(f"{h:>{w}}" for h, w, _ in TABLE_COLUMNS)]
)
# --- end of fixed values ---

# Rows of a reference that are packed as one array.
BLOCK_ROWS = 4096

MESSAGE_COLUMNS = ["ref_ord", "reference_system", "part_no", "part_count", "content"]
TABLE_HEAD = TABLE_HEADER + "\n" + "-" * len(TABLE_HEADER)


def complete_results(
    hits: DataFrame,
    *,
    include_links: bool = True,
    templates: Mapping[str, str] | None = None,
) -> DataFrame:
    """The report columns of search hits: derived counts, rule text and links added."""
    maps = [f"coalesce({name}, {NO_COUNTS}) AS {name}" for name in HISTOGRAM_COLUMNS]
    added = (
        derived_counts(*HISTOGRAM_COLUMNS[:2], "water_world_count", "earthlike_world_count")
        | link_columns("name", templates, include_links)
        | {"claimable_rule": literal(CLAIMABLE_RULE)}
    )
    plain = [name for name in hits.columns if name not in HISTOGRAM_COLUMNS]
    return hits.selectExpr(*plain, *maps).selectExpr(
        "ref_ord",
        "rank",
        *[f"{added[name]} AS {name}" if name in added else name for name in RESULT_COLUMNS],
    )


def report_rows(results: DataFrame) -> DataFrame:
    """The 24 report columns as text, under their headings."""
    return results.selectExpr(*[f"{_cell(c)} AS `{head}`" for head, c in CSV_HEADINGS.items()])


def _cell(column: str) -> str:
    if column == "claimable":
        return "CASE WHEN claimable THEN 'yes' ELSE 'no' END"
    if column == "claimable_rule":
        return f"coalesce(claimable_rule, {literal(CLAIMABLE_RULE)})"
    if column in HISTOGRAM_COLUMNS:
        return canonical_json(f"coalesce({column}, {NO_COUNTS})")
    text = number_text(column) if column == "distance_ly" else f"CAST({column} AS string)"
    return f"coalesce({text}, '')"


def csv_line() -> str:
    """The report columns as one line; a field is quoted when it holds a separator, a quote or
    a line break."""
    cells = [_cell(column) for column in CSV_HEADINGS.values()]
    fields = f"array({', '.join(cells)})"
    quoted = """CASE WHEN f RLIKE '[;"\\\\r\\\\n]' THEN concat('"', replace(f, '"', '""'), '"') ELSE f END"""
    return f"array_join(transform({fields}, f -> {quoted}), ';')"


def table_line() -> str:
    """One fixed-width line: the name is cut, numbers widen when they do not fit."""
    name = pad_right(f"coalesce(substring(name, 1, {NAME_WIDTH}), '')", NAME_WIDTH)
    dist = pad_left(one_decimal("coalesce(distance_ly, 0D)"), 6)
    counts = [
        pad_left(f"CAST(coalesce({column}, 0) AS string)", width)
        for _, width, column in TABLE_COLUMNS
    ]
    return f"concat_ws(' ', {', '.join([name, dist, *counts])})"


LINK_LINE = (
    "concat('- **', name, '** | [Inara](', inara_url, ') | [EDGIS](', edgis_url, ')')"
)


def messages(
    results: DataFrame,
    references: DataFrame,
    *,
    radius: float,
    body_filter: str,
    claimable_only: bool,
    limit: int,
    cap: int = MESSAGE_CAP,
) -> DataFrame:
    """Messages per reference (``ref_ord``, ``reference_system``, ``part_no``, ``part_count``,
    ``content``).

    ``results`` come from a search limited to ``limit`` rows per reference, numbered from 1 in
    ``rank``. Up to ``BLOCK_ROWS`` of them are packed as one array; a higher limit packs blocks
    (``_long_messages``). ``references`` (``ref_ord``, ``reference_system``) lists every reference
    asked for: those without hits get one message that says so.
    """
    info = (
        f"Radius: **{radius:.1f} ly** | Filter: **{body_filter}** | Claimable only: "
        f"**{'yes' if claimable_only else 'no'}** | Limit: **{limit}** | Treffer: **"
    )
    lines = results.selectExpr(
        "ref_ord", f"struct(rank, {table_line()} AS line, {LINK_LINE} AS link) AS _row"
    )

    def framed(hits: DataFrame) -> DataFrame:
        """Per reference what its messages begin with; ``hits`` has ``_hits`` per ``ref_ord``."""
        titled = references.join(hits, "ref_ord", "left").withColumns(
            {
                "_title": F.expr("concat('## ', reference_system)"),
                "_info": F.expr(f"concat({literal(info)}, coalesce(_hits, 0), '**')"),
            }
        )
        return titled.withColumn("_frame", F.expr(FRAME_LENGTH))

    block_rows = max(BLOCK_ROWS, cap // len(TABLE_HEADER))
    if limit > block_rows:
        return _long_messages(lines, framed, block_rows, cap)
    gathered = lines.groupBy("ref_ord").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    parts = framed(gathered.withColumn("_hits", F.expr("array_size(_rows)"))).withColumn(
        "_starts", F.expr(part_starts("coalesce(_rows, array())", "_frame", cap))
    )
    # each part leaves with its own rows only
    own_rows = """transform(_starts, (start, p) ->
      slice(_rows, start, coalesce(get(_starts, p + 1), size(_rows) + 1) - start))"""
    with_hits = parts.where("_hits > 0").selectExpr(
        *FRAME,
        "size(_starts) AS part_count",
        f"posexplode({own_rows}) AS (_part, _slice)",
    )
    return _contents(with_hits.withColumn("part_no", F.col("_part") + 1)).unionByName(
        _without_hits(parts)
    )


FRAME = ["ref_ord", "reference_system", "_title", "_info"]
TABLE_OPEN, TABLE_CLOSE = f"\n```text\n{TABLE_HEAD}\n", "\n```\n"
FRAME_LENGTH = f"length(_title) + length(_info) + {len(TABLE_OPEN + TABLE_CLOSE) + 1}"
# A row's share of a message, but for one line break that the first row of a message has not.
ROW_LENGTH = "length({row}.line) + 1 + length({row}.link)"


def _contents(parts: DataFrame) -> DataFrame:
    """Messages of parts that hold their own rows in ``_slice``."""
    return parts.selectExpr(
        *MESSAGE_COLUMNS[:-1],
        f"""concat(_title,
          CASE WHEN part_count > 1 THEN concat('\nTeil ', part_no, '/', part_count) ELSE '' END,
          '\n', _info, {literal(TABLE_OPEN)}, array_join(_slice.line, '\n'),
          {literal(TABLE_CLOSE)}, array_join(_slice.link, '\n')) AS content""",
    )


def _without_hits(framed: DataFrame) -> DataFrame:
    return framed.where("coalesce(_hits, 0) = 0").selectExpr(
        "ref_ord",
        "reference_system",
        "1 AS part_no",
        "1 AS part_count",
        f"concat(_title, '\n', _info, '\n\n', {literal(NO_HITS)}) AS content",
    )


def _long_messages(
    lines: DataFrame, framed: Callable[[DataFrame], DataFrame], block_rows: int, cap: int
) -> DataFrame:
    """``messages`` for references of any number of rows; none becomes one array.

    A reference is cut into blocks of ranks. Where a message starts depends on all before it, but
    within a block only on where its first message starts, and there are few rows that can be: those
    that may still belong to the message before. So each block is packed once for each of them,
    which says where the next block is entered. Doubling these steps finds the real entries in
    logarithmically many rounds, and the messages of all blocks follow at once.
    """
    spark = lines.sparkSession

    def written(rows: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    rows = written(
        lines.selectExpr(
            "ref_ord",
            "_row.rank AS rank",
            "_row",
            f"{ROW_LENGTH.format(row='_row')} AS own",
            f"int((_row.rank - 1) div {block_rows}) AS block",
        ),
        "lines",
    )
    frames = written(framed(rows.groupBy("ref_ord").agg(F.count("*").alias("_hits"))), "frames")
    in_block = Window.partitionBy("ref_ord", "block").orderBy("rank")
    numbered = (
        rows.select("ref_ord", "block", "rank", "own")
        .join(frames.selectExpr("ref_ord", f"{cap} - _frame AS room"), "ref_ord")
        .withColumn("before", F.sum(F.col("own") + 1).over(in_block) - F.col("own") - 1)
        # a message from an earlier block may reach up to here
        .withColumn("is_entry", F.expr("before = 0 OR before <= room"))
    )
    halo = numbered.where("is_entry AND block > 0").withColumn("block", F.col("block") - 1)
    blocks = written(
        numbered.withColumn("is_next", F.lit(False))
        .unionByName(halo.withColumn("is_next", F.lit(True)))
        .groupBy("ref_ord", "block")
        .agg(
            F.first("room").alias("room"),
            # the rows of a block and some of the next one
            F.sort_array(F.collect_list(F.struct("rank", "own", "is_next", "is_entry"))).alias("_rows"),
        ),
        "blocks",
    )
    entries = blocks.selectExpr(
        "*",
        """explode(transform(filter(_rows, r -> r.is_entry AND NOT r.is_next
          AND (block > 0 OR r.rank = 1)), r -> r.rank)) AS entry""",
    )
    jumps = written(entries.selectExpr("ref_ord", "block", "entry", f"{_walk('exit')} AS exit"), "jumps")
    most = frames.agg(F.max("_hits")).first()[0] or 0
    reached = jumps.where("block = 0").select("ref_ord", "block", "entry")
    step, leaps = 1, jumps.where("exit IS NOT NULL")
    while step * block_rows < most:
        ahead = leaps.selectExpr("ref_ord", "block", "entry", f"block + {step} AS to", "exit")
        further = reached.join(ahead, ["ref_ord", "block", "entry"]).selectExpr(
            "ref_ord", "to AS block", "exit AS entry"
        )
        reached = written(reached.unionByName(further), "reached")
        onward = leaps.selectExpr("ref_ord", "block AS to", "entry AS exit", "exit AS end")
        leaps = written(
            ahead.join(onward, ["ref_ord", "to", "exit"]).selectExpr(
                "ref_ord", "block", "entry", "end AS exit"
            ),
            "leaps",
        )
        step *= 2
    started = written(
        blocks.join(reached, ["ref_ord", "block"])
        .join(jumps, ["ref_ord", "block", "entry"])
        .selectExpr("ref_ord", "block", "exit", f"{_walk('starts')} AS starts"),
        "starts",
    )
    earlier = Window.partitionBy("ref_ord").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = started.select("ref_ord", "block", F.size("starts").alias("n"))
    # one row for each block
    offsets = counted.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    totals = counted.groupBy("ref_ord").agg(F.sum("n").cast("int").alias("part_count"))
    parts = (
        started.join(offsets.drop("n"), ["ref_ord", "block"])
        .join(frames, "ref_ord")
        .selectExpr(
            *FRAME,
            "earlier",
            "posexplode(transform(starts, (s, i) -> struct(s AS first,"
            " coalesce(get(starts, i + 1), exit, _hits + 1) - 1 AS last))) AS (place, span)",
        )
        .join(totals, "ref_ord")
        .selectExpr(*FRAME, "part_count", "int(earlier + place + 1) AS part_no", "span")
    )
    members = parts.selectExpr("ref_ord", "part_no", "explode(sequence(span.first, span.last)) AS rank")
    gathered = (
        members.join(rows.select("ref_ord", "rank", "_row"), ["ref_ord", "rank"])
        .groupBy("ref_ord", "part_no")
        # the rows of one message
        .agg(F.sort_array(F.collect_list("_row")).alias("_slice"))
    )
    with_hits = parts.drop("span").join(gathered, ["ref_ord", "part_no"])
    return _contents(with_hits).unionByName(_without_hits(frames))


def _walk(wanted: str) -> str:
    """Packs ``_rows`` from rank ``entry`` on: the ``starts`` of messages within the block, or the
    ``exit``, the first start behind it (null if the rows end)."""
    new = "(s.used < 0 OR s.used + 1 + row.own > room)"
    grown = {
        "starts": "CASE WHEN {new} AND NOT row.is_next THEN array_append(s.found, row.rank) ELSE s.found END",
        "exit": "CASE WHEN s.found IS NULL AND {new} AND row.is_next THEN row.rank ELSE s.found END",
    }[wanted].format(new=new)
    nothing = {"starts": "CAST(array() AS array<int>)", "exit": "CAST(null AS int)"}[wanted]
    return f"""aggregate(filter(_rows, r -> r.rank >= entry),
      named_struct('found', {nothing}, 'used', -1),
      (s, row) -> named_struct('found', {grown},
        'used', CASE WHEN {new} THEN row.own ELSE s.used + 1 + row.own END),
      s -> s.found)"""


def part_starts(rows: str, frame_length: str, cap: int) -> str:
    """1-based positions at which a new message starts.

    A row goes into the current message unless that would exceed the cap; a row too long for
    any message stands alone. The length of a message is its frame plus, per row, table line
    and link line with their line breaks (one less break for the first link).
    """
    own = ROW_LENGTH.format(row="row")
    new = f"(s.seen = 0 OR s.used + 1 + {own} > {cap})"
    return f"""aggregate({rows},
      named_struct('starts', CAST(array() AS array<int>), 'used', 0, 'seen', 0),
      (s, row) -> named_struct(
        'starts', CASE WHEN {new} THEN array_append(s.starts, s.seen + 1) ELSE s.starts END,
        'used', CASE WHEN {new} THEN {frame_length} + {own} ELSE s.used + 1 + {own} END,
        'seen', s.seen + 1),
      s -> s.starts)"""
