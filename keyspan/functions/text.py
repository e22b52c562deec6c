"""Text helpers: vertical ``key: value`` dumps, sectioned status text,
version strings and log-file coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# whitespace as the reference's strip sees it (space, \t, \n, \v, \f, \r)
WS_CLASS = "[ \\t\\n\\x0B\\f\\r]"
# a "*** 1. row ***" separator line (one digit, as the reference matches it)
ROW_SEPARATOR_LINE = r"(?m)^\*+ \d\. row \*+$"
# log file number: the trailing digits of the name.  Wider than the
# reference's pattern, which only allows letters, dots and zeros before the
# number and so rejects names with a hyphen (documented divergence).
LOGFILE_PATTERN = r"(\d+)$"


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def _line_pair(line: Column) -> Column:
    """``split(':')`` with the reference's rules: every colon splits, trailing
    empty pieces vanish, the key is piece 1 and the value piece 2 (later
    pieces dropped); no value -> no pair."""
    parts = F.split(line, ":")
    has_val = F.exists(F.slice(parts, 2, 1 << 30), lambda p: p != "")
    return F.when(has_val, F.struct(F.lower(strip_ws(F.element_at(parts, 1))).alias("key"),
                                    strip_ws(F.element_at(parts, 2)).alias("value")))


def client_output(text: Column) -> Column:
    """The text, failing at run time where one of its lines begins with
    ``ERROR``: then it is a client's message and no result."""
    return F.when(text.rlike("(?m)^ERROR"), F.raise_error(F.regexp_replace(text, r"\n$", "")).cast("string")).otherwise(text)


def parse_vertical(text: Column, errors: str = "ignore") -> Column:
    """Vertical result text -> ``map<string,string>`` (later duplicates win; an
    empty map for NULL).  ``errors="raise"`` fails on an error message
    (:func:`client_output`), ``"ignore"`` reads it like any other text."""
    if errors not in ("raise", "ignore"):
        raise ValueError(f"errors must be raise or ignore, got {errors!r}")
    text = F.coalesce(client_output(text) if errors == "raise" else text, F.lit(""))
    lines = F.split(text, "\n")
    pairs = F.filter(F.transform(lines, _line_pair), lambda x: x.isNotNull())
    return _last_wins_map(pairs)


def _last_wins_map(pairs: Column) -> Column:
    """Entries to a map, the last one of a key winning: pairs are sorted by
    key and position once and the last of each run is kept (``transform`` over
    a one-element array binds the sorted pairs, so they are computed once)."""
    placed = F.sort_array(F.transform(pairs, lambda e, i: F.struct(
        e["key"].alias("key"), i.alias("i"), e["value"].alias("value"))))

    def kept(s: Column) -> Column:
        last = F.filter(s, lambda e, i: ~F.coalesce(F.get(s, i + 1)["key"] == e["key"], F.lit(False)))
        return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))

    return F.get(F.transform(F.array(placed), kept), F.lit(0))


def parse_vertical_rows(text: Column, errors: str = "ignore") -> Column:
    """Many-row vertical output: split at the ``*** n. row ***`` lines, one
    map per row.  ``errors`` as in :func:`parse_vertical`."""
    rows = F.split(client_output(text) if errors == "raise" else text, ROW_SEPARATOR_LINE)
    rows = F.filter(rows, lambda r: F.length(strip_ws(r)) > 0)
    return F.transform(rows, lambda r: parse_vertical(r))


def status_sections(text: Column) -> Column:
    """Sectioned status text (a dashed line, an upper-case title, a dashed
    line, then the body) -> ``map<title, array<line>>``.  A section ends at the
    next header, so what follows the last one is no section; of sections with
    one title the last wins."""
    pat = r"-+\n([\p{Lu} \p{Punct}]+)\n-+\n"
    titles = F.regexp_extract_all(text, F.lit(pat), 1)
    bodies = F.slice(F.split(text, pat), 2, 1 << 30)
    lines = F.transform(bodies, lambda b: F.filter(F.split(F.regexp_replace(b, r"\n+$", ""), "\n"), lambda x: x != ""))
    pairs = F.zip_with(titles, lines, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return _last_wins_map(F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(0))))


def hit_rate(line: Column) -> Column:
    """``Buffer pool hit rate x / y`` -> round(100 * x / y, 2)."""
    words = F.split(strip_ws(line), r"\s+")
    return F.round(F.try_divide(F.element_at(words, 5).cast("double") * 100,
                                F.element_at(words, 7).cast("double")), 2)


def version_tuple(v: Column, precision: int = 3) -> Column:
    """``5.5.27-rel28.1-log`` -> ``[5, 5, 27]`` (first ``precision`` parts,
    non-numeric tails read as their leading digits)."""
    parts = F.split(v, r"\.", 3)
    nums = F.transform(parts, lambda p: F.coalesce(
        F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.lit(0)))
    return F.slice(nums, 1, precision)


def version_cmp(a: Column, b: Column, precision: int = 2) -> Column:
    """-1 / 0 / 1 comparing the first ``precision`` version numbers."""
    if precision < 1 or precision > 3:
        raise ValueError(f"precision must be 1, 2 or 3, got {precision}")
    ta, tb = version_tuple(a, precision), version_tuple(b, precision)
    return F.when(ta < tb, -1).when(ta > tb, 1).otherwise(0)


def logfile_number(name: Column) -> Column:
    return F.regexp_extract(name, LOGFILE_PATTERN, 1).try_cast("long")


def position_ahead(file_a: Column, pos_a: Column, file_b: Column, pos_b: Column) -> Column:
    """True when coordinate a is past b: same file -> position, else the log
    file number."""
    return (F.when((file_a == file_b) & (pos_a == pos_b), F.lit(False))
            .when(file_a == file_b, pos_a > pos_b)
            .otherwise(logfile_number(file_a) > logfile_number(file_b)))
