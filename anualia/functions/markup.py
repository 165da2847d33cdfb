"""Reading HTML tables and lists with Spark's own string functions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from anualia.functions.template import apply, quote
from anualia.functions.text import MISSING, STRIP

_IGNORED = r"(?is)<(?:!--.*?-->|(script|style)\b.*?</\1\s*>)"
# The places between the parts of a page that each begin with a table's start or end tag.
_TABLE_TAG = r"(?i)(?=</?table\b)"
_HEAD = r"(?is)<thead\b.*?</thead\s*>"
_TAG = r"<[^>]*>"
_COLSPAN = r"(?is)^<[^>]*?\bcolspan\s*=\s*[^0-9>]?([0-9]+)"
_ROWSPAN = r"(?is)^<[^>]*?\browspan\s*=\s*[^0-9>]?([0-9]+)"


def _span(tag: str) -> str:
    """An element up to its end tag, the next element of its kind, or the end.

    Possessive, so each character is looked at once and nothing is backtracked.
    """
    return rf"(?i)<(?:{tag})\b[^>]*+>[^<]*+(?:<(?!/?(?:{tag})\b)[^<]*+)*+"


def visible(html: Column) -> Column:
    """Markup without comments, scripts and style sheets."""
    return F.regexp_replace(html, _IGNORED, "")


# Entity names and their characters, position by position.
_NAMES = ",".join(name2codepoint)
_CHARS = "".join(chr(v) for v in name2codepoint.values())
_NUMBER = """try_cast(CASE
    WHEN lower(left(e, 2)) = '#x' THEN conv(substring(e, 3, 8), 16, 10)
    WHEN left(e, 1) = '#' THEN substring(e, 2, 10) END AS INT)"""
# Character behind an entity name or number; an unknown one stays as written.
_ENTITY = f"""coalesce(
    CASE WHEN left(e, 1) <> '#' THEN substring({quote(_CHARS)}, nullif(find_in_set(e, '{_NAMES}'), 0), 1)
        WHEN {_NUMBER} BETWEEN 1 AND 55295 OR {_NUMBER} BETWEEN 57344 AND 1114111
        THEN decode(unhex(lpad(hex({_NUMBER}), 8, '0')), 'UTF-32') END,
    concat('&', e, ';'))"""
# Text without an ampersand is left alone; ``&amp;`` comes last so nothing is read twice.
_UNESCAPE = f"""transform(array({{x}}), t -> CASE WHEN contains(t, '&') THEN replace(
    aggregate(
        array_remove(array_distinct(regexp_extract_all(t, r'&(#?[A-Za-z0-9]+);', 1)), 'amp'),
        t, (done, e) -> replace(done, concat('&', e, ';'), {_ENTITY})),
    '&amp;', '&') ELSE t END)[0]"""
# Trim, and turn line breaks and runs of white space into one blank.
_SQUEEZE = "regexp_replace(" + STRIP + ", r'(?U)[\\r\\n]+|\\s{2,}', ' ')"
# Text of an element: tags dropped, entities replaced, space squeezed.
_TEXT = _SQUEEZE.replace("{x}", _UNESCAPE.replace("{x}", "regexp_replace({x}, r'<[^>]*>', '')"))
_CELL = f"transform(array({_TEXT}), v -> {MISSING.replace('{x}', 'v')})[0]"


def unescape(x: str | Column) -> Column:
    """Replace entities by their characters."""
    return apply(_UNESCAPE, x)


def element_text(x: str | Column) -> Column:
    """Text of an element."""
    return apply(_TEXT, x)


def cell_text(x: str | Column) -> Column:
    """Text of a cell, null if the cell holds no value."""
    return apply(_CELL, x)


# Depth of tables after each part. The outermost tables are the runs of parts between two places of depth 0;
# of parts inside a table of a table only the text is kept. An end tag without a start counts for nothing, and a
# table that is never closed reaches to the end of the page.
_OUTER = rf"""aggregate(
    split({{x}}, {quote(_TABLE_TAG)}),
    named_struct('depth', 0, 'open', array(''), 'done', cast(array() AS array<string>)),
    (acc, part) -> transform(array(CASE
        WHEN part RLIKE r'(?i)^<table\b' THEN acc.depth + 1
        WHEN part RLIKE r'(?i)^</table\b' THEN greatest(acc.depth - 1, 0)
        ELSE acc.depth END), depth -> CASE
        WHEN depth = 0 AND acc.depth = 0 THEN acc
        WHEN depth = 0 THEN named_struct('depth', 0, 'open', array(''), 'done', array_append(acc.done, array_join(acc.open, '')))
        WHEN acc.depth = 0 THEN named_struct('depth', depth, 'open', array(regexp_replace(part, r'^<[^>]*>', '')), 'done', acc.done)
        WHEN depth = 1 THEN named_struct('depth', depth, 'open', array_append(acc.open, regexp_replace(part, r'^<[^>]*>', '')), 'done', acc.done)
        ELSE named_struct('depth', depth, 'open', array_append(acc.open, regexp_replace(part, r'<[^>]*>', '')), 'done', acc.done)
        END)[0],
    acc -> IF(acc.depth > 0, array_append(acc.done, array_join(acc.open, '')), acc.done))"""


def tables(html: Column) -> Column:
    """Inner markup of the outermost tables that hold any text, in order; a table inside a cell is text of that cell."""
    return F.filter(apply(_OUTER, html), lambda t: t.rlike(r"(?:^|>)\s*[^<\s]"))


def elements(markup: Column, tag: str) -> Column:
    """All elements with this tag, each with its start tag."""
    return F.regexp_extract_all(markup, F.lit(_span(tag)), F.lit(0))


def table_rows(table: Column) -> Column:
    """Rows of a table body: a head section or leading header rows do not count."""
    below_head = elements(F.regexp_replace(table, _HEAD, ""), "tr")
    body = apply(
        """transform(array(array_position(transform({x}, r -> r RLIKE r'(?i)<td\\b'), true)),
        at -> CASE WHEN at <= 1 THEN {x} ELSE slice({x}, cast(at AS INT), size({x})) END)[0]""",
        elements(table, "tr"),
    )
    return F.when(table.rlike(r"(?i)<thead\b"), below_head).otherwise(body)


def row_cells(row: Column) -> Column:
    """Cells of a row; one that spans columns is repeated."""
    cells = elements(row, "td|th")
    spread = apply(
        f"flatten(transform({{x}}, c -> array_repeat(c, coalesce(cast(nullif(regexp_extract(c, {quote(_COLSPAN)}, 1), '') AS INT), 1))))",
        cells,
    )
    return F.when(row.rlike(r"(?i)\bcolspan\b"), spread).otherwise(cells)


def _number(pattern: str) -> str:
    return f"greatest(coalesce(cast(nullif(left(regexp_extract(c, {quote(pattern)}, 1), 4), '') AS INT), 1), 1)"


_ENTRY = "struct<cell: string, left: int, col: int>"
# Cells that a row begins, one entry for each column they take: markup without attributes, how many further rows
# they reach into, and whether the entry is the cell's first one.
_BEGUN = rf"""flatten(transform(regexp_extract_all(row, {quote(_span("td|th"))}, 0), c -> IF(c RLIKE r'(?i)^<[^>]*span',
    transform(
        sequence(1, {_number(_COLSPAN)}),
        n -> named_struct('cell', regexp_replace(c, r'^<[^>]*>', '<td>'), 'left', {_number(_ROWSPAN)} - 1, 'first', n = 1)),
    array(named_struct('cell', regexp_replace(c, r'^<[^>]*>', '<td>'), 'left', 0, 'first', true)))))"""
# From left to right: a cell from above goes to its column, or next where the row has gone past that column or has
# no cells left, but never between the columns of one cell; else the row's own next cell.
# A row that no cell from above reaches into has its own cells in its own columns.
_PLACED = f"""IF(size(carry) = 0, transform(begun, (b, i) -> named_struct('cell', b.cell, 'left', b.left, 'col', i)), aggregate(
    sequence(1, greatest(size(carry) + size(begun), 1)),
    named_struct('own', 1, 'above', 1, 'row', cast(array() AS array<{_ENTRY}>)),
    (r, i) -> CASE
        WHEN r.above <= size(carry) AND (r.own > size(begun) OR begun[r.own - 1].first AND carry[r.above - 1].col < i)
        THEN named_struct('own', r.own, 'above', r.above + 1, 'row', array_append(r.row, named_struct(
            'cell', carry[r.above - 1].cell, 'left', carry[r.above - 1].left - 1, 'col', carry[r.above - 1].col)))
        WHEN r.own <= size(begun)
        THEN named_struct('own', r.own + 1, 'above', r.above, 'row', array_append(r.row, named_struct(
            'cell', begun[r.own - 1].cell, 'left', begun[r.own - 1].left, 'col', i - 1)))
        ELSE r END,
    r -> r.row))"""
_GRID = f"""aggregate({{x}},
    named_struct('carry', cast(array() AS array<{_ENTRY}>), 'rows', cast(array() AS array<string>)),
    (acc, row) -> transform(transform(array(named_struct('begun', {_BEGUN}, 'carry', acc.carry)), s -> {_PLACED.replace("begun", "s.begun").replace("carry", "s.carry")}),
        placed -> named_struct(
            'carry', filter(placed, e -> e.left > 0),
            'rows', array_append(acc.rows, concat('<tr>', array_join(transform(placed, e -> e.cell), '')))))[0],
    acc -> concat(acc.rows, transform(
        filter(sequence(0, coalesce(array_max(transform(acc.carry, e -> e.left)), 0)), k -> k > 0),
        k -> concat('<tr>', array_join(transform(filter(acc.carry, e -> e.left >= k), e -> e.cell), '')))))"""


def filled_rows(rows: Column) -> Column:
    """Rows in which every cell that spans rows or columns stands in each of its places.

    A cell that reaches below the last row makes rows of its own there.
    """
    spanned = F.exists(rows, lambda r: r.rlike(r"(?i)\browspan\b"))
    return F.when(spanned, apply(_GRID, rows)).otherwise(rows)


def running_text(table: Column) -> Column:
    """All cell texts of a table in order, joined by blanks."""
    apart = F.regexp_replace(table, r"(?i)<t[dh]\b[^>]*>", " ")
    return element_text(apart)
