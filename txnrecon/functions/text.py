"""String scalars.

Whitespace follows Unicode where the rule says "trim", and letter case is folded
for ASCII only unless a function says otherwise: ``lower`` in Spark also folds
accented letters, which would merge names the rules keep apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Any whitespace except the newline, and a blank line seen from the newline before it.
HSPACE = r"[\s\h&&[^\n]]"
BLANK_LINE = rf"\n(?:{HSPACE}*(?=\n)|{HSPACE}+\z)"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Columns are expressions: one that is used five times is computed five times, and a
    filter pushed below a projection copies it again. A lambda variable is not copied.
    """
    return F.get(F.transform(F.array(value), body), 0)


def once(**fields: Column) -> Column:
    """Select-list generator that yields ``fields`` as columns, one row per input row.

    A filter on them stays above the generator, so they are computed once per row; pushed
    below a plain projection it would compute them again.
    """
    return F.inline(F.array(F.struct(*[value.alias(name) for name, value in fields.items()])))


def ascii_lower(col: Column | str) -> Column:
    return F.translate(_c(col), UPPER, LOWER)


def ascii_upper(col: Column | str) -> Column:
    return F.translate(_c(col), LOWER, UPPER)


def utrim(col: Column | str) -> Column:
    """Trim Unicode whitespace on both ends (Spark's ``trim`` removes U+0020 only)."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+\z", "")


def unless_empty(value: Column) -> Column:
    """``value``, evaluated once, or null where it is the empty text."""
    return let(value, lambda v: F.when(v != "", v))


def nonblank(col: Column | str) -> Column:
    """Trimmed text, or null when nothing is left."""
    return unless_empty(utrim(col))


def extract(col: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``; null instead of the empty text when it does not match."""
    return unless_empty(F.regexp_extract(_c(col), pattern, group))


def contains_any(col: Column, needles: Iterable[str]) -> Column:
    """Whether the text holds any of a short fixed list of substrings."""
    test = F.lit(False)
    for needle in needles:
        test = test | F.contains(col, F.lit(needle))
    return test


def lines(col: Column | str) -> Column:
    """Lines of a text without their line ends."""
    return F.split(_c(col), r"\r?\n")


def first_where(array: Column, test) -> Column:
    """First array element that passes ``test``, else null."""
    return F.get(F.filter(array, test), 0)


def collapse_whitespace(col: Column | str) -> Column:
    return utrim(F.regexp_replace(_c(col), r"(?U)\s+", " "))


def canon_merchant(col: Column | str) -> Column:
    """Whitespace runs to one space, ASCII lower case."""
    return ascii_lower(collapse_whitespace(col))


def tokens(col: Column | str) -> Column:
    """Alphanumeric tokens (Unicode) of at least two bytes, lower-cased."""
    parts = F.split(_c(col), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.transform(F.filter(parts, lambda t: F.octet_length(t) >= 2), F.lower)


def token_containment(a: Column, b: Column) -> Column:
    """Share of the shorter token list found in the other; duplicates count, ties take the left."""

    def share(small: Column, big: Column) -> Column:
        hits = F.size(F.filter(small, lambda t: F.array_contains(big, t)))
        return F.when(F.size(small) == 0, 0.0).otherwise(hits.cast("double") / F.greatest(F.size(small), F.lit(1)))

    return let(
        F.struct(a.alias("a"), b.alias("b")),
        lambda p: F.when(F.size(p["a"]) <= F.size(p["b"]), share(p["a"], p["b"])).otherwise(share(p["b"], p["a"])),
    )


def strip_thousands_commas(col: Column | str) -> Column:
    return F.replace(_c(col), F.lit(","), F.lit(""))


def from_header(name: Column, address: Column) -> Column:
    """``Name <addr>`` when a display name is present, else ``<addr>``; null without an address."""
    bare = F.concat(F.lit("<"), address, F.lit(">"))
    return F.when(
        F.length(address) > 0,
        F.when(nonblank(name).isNotNull(), F.concat(nonblank(name), F.lit(" "), bare)).otherwise(bare),
    )


def comma_list(col: Column | str) -> Column:
    """``a, b,,c`` -> [a, b, c]."""
    return F.filter(F.transform(F.split(_c(col), ","), utrim), lambda t: t != "")


def join_cells(cells: Column) -> Column:
    """Texts of row cells, trimmed and joined by single spaces."""
    return F.array_join(F.transform(cells, lambda c: utrim(c["text"])), " ")


# --- Windows-1252 ------------------------------------------------------------

# The code points of bytes 0x80..0x9F; unassigned bytes give U+FFFD.
WINDOWS_1252_HIGH = (
    "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž�"
    "�‘’“”•–—˜™š›œ�žŸ"
)


def decode_windows_1252(col: Column | str) -> Column:
    """Bytes to text: Latin-1 first, then the block where Windows-1252 differs."""
    latin = "".join(chr(code) for code in range(0x80, 0xA0))
    return F.translate(F.decode(_c(col), "ISO-8859-1"), latin, WINDOWS_1252_HIGH)


# --- mail bodies -------------------------------------------------------------


_HTML_DROP = (
    r"(?is)<head\b[^>]*>.*?</head\s*>|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    r"|<!--.*?-->|<![a-z][^>]*>"
)


def html_to_text(col: Column | str) -> Column:
    """Readable text of an HTML body: scripts, styles, comments and the head go, block
    ends become newlines, other tags go, the common entities are decoded."""
    text = F.regexp_replace(_c(col), _HTML_DROP, "")
    text = F.regexp_replace(text, r"[ \t\r\n]+", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(?:p|div|li|ul|ol|tr|h[1-6]|article|table|nav)\s*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.replace(text, F.lit("&amp;"), F.lit("&"))
    text = F.regexp_replace(text, r" *\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+\z", "")


# Markers of the parts of a forwarded receipt that carry no data.
NOISE_FOOTER = "Help & Contact"
NOISE_IMAGE = "[image:"
NOISE_URLS = ("<http://", "<https://")


def trim_noise(col: Column | str) -> Column:
    """Cut the footer, tracking links and image captions; an unclosed block drops the
    rest. A body without any marker is returned as it is."""
    body = _c(col)
    has_noise = contains_any(body, (*NOISE_URLS, NOISE_IMAGE, NOISE_FOOTER))
    core = F.substring_index(body, NOISE_FOOTER, 1)
    bare = F.regexp_replace(core, r"<https?://[^>]*(?:>|\z)|\[image:[^\]]*(?:\]|\z)", "")
    return F.when(has_noise, F.regexp_replace(bare, r"\n{3,}", "\n\n")).otherwise(body)


def label_value(body: Column, label: str) -> Column:
    """Text of the line after a line that is exactly ``label``; blank counts as absent."""
    pattern = rf"(?i)(?:^|\n){HSPACE}*{label}{HSPACE}*\n([^\n]*)"
    return nonblank(F.regexp_extract(body, pattern, 1))


def block_after_label(body: Column, label: str) -> Column:
    """Lines after a label line, up to the first blank line; null without the label."""
    tail = rf"(?is)(?:^|\n){HSPACE}*{label}{HSPACE}*(\n.*)\z"
    return F.get(F.split(extract(body, tail), BLANK_LINE, 2), 0)
