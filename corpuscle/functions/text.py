"""Text functions as columns: words, units, pretokens, byte symbols.

The patterns are written so that Java's and RE2's engines read them alike, with
Unicode white space and the few newer letters of Indic scripts spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode text handling knows it, for use inside brackets.
SPACE = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Letters and marks that older regex tables lack.
NEWER = r"\x{c3c}\x{c5d}\x{cdd}\x{cf3}"
LETTER = rf"\p{{L}}\p{{M}}{NEWER}"
#: A faithful unit: a run of letters, marks and numbers, or one other visible character.
UNIT = rf"[{LETTER}\p{{N}}]+|[^{SPACE}{LETTER}\p{{N}}]"
#: Runs of one class; a single white-space character leads the run after it.
_WORD, _OTHER = rf"[{LETTER}\p{{Cf}}]+", rf"[^{SPACE}{LETTER}\p{{Cf}}\p{{N}}]+"
PRETOKEN = rf"[{SPACE}](?:{_WORD}|\p{{N}}+|{_OTHER})|[{SPACE}]+|{_WORD}|\p{{N}}+|{_OTHER}"
#: Words of n-grams.
GRAM_WORD = rf"[{LETTER}\p{{N}}]+"
#: Line ends that ``splitlines`` knows.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def word_count(c: Column | str) -> Column:
    """Runs between white space; 0 for null."""
    return F.regexp_count(_text(c), F.lit(rf"[^{SPACE}]+")).cast("long")


def unit_count(c: Column | str) -> Column:
    """Faithful units; 0 for null."""
    return F.regexp_count(_text(c), F.lit(UNIT)).cast("long")


def unit_count_joined(c: Column | str) -> Column:
    """Faithful units with joiners (format characters) kept inside words."""
    return F.regexp_count(_text(c), F.lit(rf"[{LETTER}\p{{N}}\p{{Cf}}]+|[^{SPACE}{LETTER}\p{{N}}\p{{Cf}}]")).cast("long")


def visible(c: Column | str) -> Column:
    """The text without white space."""
    return F.regexp_replace(_text(c), rf"[{SPACE}]", "")


def strip(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_text(c), rf"^[{SPACE}]+", ""), rf"[{SPACE}]+$", "")


def rstrip(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), rf"[{SPACE}]+$", "")


def lines(c: Column | str) -> Column:
    return F.split(_text(c), LINE_END, -1)


def is_blank(c: Column | str) -> Column:
    return F.length(visible(c)) == 0


def pretokens(c: Column | str, whitespace: str = "space") -> Column:
    """Pretokens in order.  ``whitespace='space'`` writes a leading white-space character as a space; ``'keep'`` leaves it, which is lossless."""
    found = F.regexp_extract_all(_text(c), F.lit(PRETOKEN), 0)
    if whitespace == "keep":
        return found
    return F.transform(found, lambda t: F.regexp_replace(t, rf"^[{SPACE}](?=[^{SPACE}])", " "))


def metaspace(c: Column | str) -> Column:
    """Pieces that start with ``▁`` in place of each space."""
    return F.regexp_extract_all(F.translate(_text(c), " ", "▁"), F.lit("▁[^▁]*|[^▁]+"), 0)


def metaspace_text(c: Column) -> Column:
    return F.translate(F.array_join(c, ""), "▁", " ")


def symbols(c: Column) -> Column:
    """Bytes of a string as ``<74><68>``."""
    return F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "<$1>")


def symbol_list(c: Column) -> Column:
    """``<74><6865>`` as an array of hex strings; empty for the empty string."""
    return F.when(F.length(c) > 2, F.split(F.substring(c, F.lit(2), F.length(c) - 2), "><")).otherwise(F.array().cast("array<string>"))


def hex_text(c: Column) -> Column:
    """Hex bytes as text; bytes that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(F.unhex(c).cast("string"))


def tokens_text(c: Column) -> Column:
    """An array of hex tokens as text, joined before decoding."""
    return hex_text(F.array_join(c, ""))


def byte_alphabet() -> list[tuple[int, str]]:
    """Byte and its printable character: printable Latin-1 bytes stand for themselves, the others follow from U+0100 in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = (b for b in range(256) if b not in own)
    return sorted([(b, chr(b)) for b in own] + [(b, chr(256 + i)) for i, b in enumerate(others)])


def byte_display(c: Column) -> Column:
    """A hex token in the printable alphabet."""
    table = F.create_map(*[F.lit(x) for b, ch in byte_alphabet() for x in (f"{b:02X}", ch)])
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(".."), 0), lambda h: table[h]), "")


def html_escape(c: Column | str) -> Column:
    return F.replace(F.replace(F.replace(_text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def quote(c: Column | str) -> Column:
    """Percent-encoding with no safe characters beside the unreserved ones."""
    return F.replace(F.replace(F.replace(F.url_encode(_text(c)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once a row, however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` words joined by spaces; empty for fewer words."""

    def runs(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(words, runs)


def gram_words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(GRAM_WORD), 0)


def hash60(c: Column) -> Column:
    """60 bits of MD5 as a number, the same in any engine."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("long")
