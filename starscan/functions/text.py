"""Text formatting that has to match an exact layout."""

from __future__ import annotations


def literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def pad_left(text: str, width: int) -> str:
    """Right-align; longer text is kept whole (``lpad`` alone would cut it)."""
    return f"lpad({text}, greatest({width}, length({text})), ' ')"


def pad_right(text: str, width: int) -> str:
    return f"rpad({text}, greatest({width}, length({text})), ' ')"


def one_decimal(value: str) -> str:
    """A non-negative double with one decimal, rounded on its exact binary value, ties to even.

    ``format_string('%.1f')`` rounds the shortest decimal form half up: 0.25 gives 0.3 there
    and 0.2 here. A product with 10 or 20 is not exact, so it is kept as the rounded sum of two
    exact products (8v + 2v, 16v + 4v) and the part that rounding lost. Each transform names
    the values the next one uses.
    """
    sums = f"""transform(array({value}),
      v -> struct(v, v * 8D + v * 2D AS ten, v * 16D + v * 4D AS twenty))"""
    # the product may have been rounded up to the next whole number: step back then
    tenths = f"""transform({sums}, s -> struct(
      s.twenty, {_lost("s.twenty", "s.v * 16D", "s.v * 4D")} AS twenty_lost,
      floor(s.ten) - CASE WHEN (s.ten - floor(s.ten)) + {_lost("s.ten", "s.v * 8D", "s.v * 2D")} < 0
        THEN 1 ELSE 0 END AS n))"""
    excess = f"""transform({tenths},
      s -> struct(s.n, (s.twenty - (s.n * 2 + 1)) + s.twenty_lost AS over))"""
    rounded = f"""transform({excess}, s -> s.n + CASE
      WHEN s.over > 0 OR (s.over = 0 AND s.n % 2 = 1) THEN 1 ELSE 0 END)"""
    return f"get(transform({rounded}, n -> concat(n div 10, '.', n % 10)), 0)"


def _lost(total: str, a: str, b: str) -> str:
    """What rounding lost when ``a + b`` gave ``total``."""
    b_kept = f"({total} - {a})"
    return f"(({a} - ({total} - {b_kept})) + ({b} - {b_kept}))"


def number_text(value: str) -> str:
    """A double as its shortest decimal text, without an exponent from 1e7 up to 1e16."""
    wide = f"regexp_replace(CAST(CAST({value} AS decimal(38,3)) AS string), '0{{1,2}}$', '')"
    return f"""CASE WHEN abs({value}) >= 1e7 AND abs({value}) < 1e16 THEN {wide}
      ELSE CAST({value} AS string) END"""


def query_escape(text: str) -> str:
    """URL query encoding: letters, digits and ``_.-~`` stay, a space becomes ``+``."""
    return f"replace(replace(url_encode({text}), '%7E', '~'), '*', '%2A')"
