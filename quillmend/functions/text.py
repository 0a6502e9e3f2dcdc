"""Text functions as Column expressions (all stay inside the JVM)."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column, functions as F

from quillmend.functions import patterns

# White space stripped by the plain trim (ASCII) and by the Unicode trim.
ASCII_SPACE = " \t\n\r\0\x0b"
UNICODE_SPACE = (
    "\t\n\x0b\f\r \x85\xa0         "
    "       　"
)

# Suffixes of the entity names that mark an accented or joined letter.
ACCENT_SUFFIXES = ("acute", "cedil", "circ", "grave", "lig", "orn", "ring", "slash", "th",
                   "tilde", "uml", "caron")

# Longest sanitised name kept.
NAME_LENGTH = 180


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(ASCII_SPACE))


def trim_unicode(c: Column) -> Column:
    return F.btrim(c, F.lit(UNICODE_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def is_blank(c: Column) -> Column:
    """Null, empty or the text "0" (the loose notion of empty used for uris and languages)."""
    return c.isNull() | c.isin("", "0")


def has_text(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def has_visible_text(c: Column) -> Column:
    """Some character that is no white space."""
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def is_http_url(c: Column) -> Column:
    return F.coalesce(c.startswith("http://") | c.startswith("https://"), F.lit(False))


def basename(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, r"/+\z", ""), r"([^/]*)\z", 1)


def filename(c: Column) -> Column:
    """Last path part without its last extension."""
    return F.regexp_replace(basename(c), r"\.[^.]*\z", "")


def strip_extension(c: Column) -> Column:
    """Whole path without the last extension of its last part (a bare final dot stays)."""
    return F.regexp_replace(c, r"\.[^./]+\z", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", "")


def repair_unicode(c: Column) -> Column:
    """Undo UTF-8 that was read as Latin-1 (``cafÃ©`` becomes ``café``)."""
    decoded = F.encode(c, "ISO-8859-1").cast("string")
    damaged = c.rlike(r"[\x{80}-\x{FF}]") & ~c.rlike(r"[^\x{00}-\x{FF}]")
    return F.when(damaged & F.is_valid_utf8(decoded), decoded).otherwise(c)


def main_media_type(c: Column) -> Column:
    return F.split_part(c, F.lit("/"), F.lit(1))


# White space of the natural order.
NATURAL_SPACE = r"[ \t\n\x0B\f\r]"


def natural_key(c: Column) -> Column:
    r"""Sort key for natural order without case (of ASCII letters).

    Runs of digits compare as numbers of any length: the key has the digits of the run's length,
    counted, then the length, then the run. A run that begins with zero is a fraction: it comes
    before all others and compares digit by digit (``a01 < a02 < a1``). Zeros in front of a number
    that begins the text do not count. White space does not count either, unless it follows a
    number (one blank) or ends the text.
    """
    letters = "abcdefghijklmnopqrstuvwxyz"
    folded = F.translate(F.regexp_replace(c, r"^0+(?=[0-9])", ""), letters, letters.upper())
    runs = F.regexp_extract_all(
        folded, F.lit(rf"([0-9]+|{NATURAL_SPACE}+|(?:(?!{NATURAL_SPACE})[^0-9])+)"), F.lit(1))

    def comparable(run: Column, i: Column) -> Column:
        size = F.length(run).cast("string")
        after_number = F.coalesce(F.get(runs, i - 1).rlike("^[0-9]"), F.lit(False))
        last = i == F.size(runs) - 1
        blank = F.concat(
            F.when(after_number, F.substring(run, 1, 1)).otherwise(F.lit("")),
            F.when(last & (~after_number | (F.length(run) > 1)), F.lit("\x00")).otherwise(F.lit("")))
        return (F.when(run.rlike("^0"), F.concat(run, F.lit("\x01")))
                .when(run.rlike("^[1-9]"), F.concat(F.length(size).cast("string"), size, run))
                .when(run.rlike(f"^{NATURAL_SPACE}"), blank).otherwise(run))

    return F.array_join(F.transform(runs, comparable), "")


def split_parts(c: Column, separator: str, limit: int | None) -> Column:
    """Split into an array. A positive limit keeps the rest in the last part, a negative one
    keeps it in the first; +1 and -1 leave the text whole."""
    literal = patterns.quote(separator)
    if limit is None:
        return F.split(c, literal, -1)
    if abs(limit) == 1:
        return F.array(c)
    if limit > 1:
        return F.split(c, literal, limit)
    tail = abs(limit) - 1
    parts = F.split(c, literal, -1)
    head = F.size(parts) - tail
    return F.when(head <= 1, parts).otherwise(
        F.concat(F.array(F.array_join(F.slice(parts, F.lit(1), head), separator)),
                 F.slice(parts, head + 1, F.lit(tail))))


def entity_form(text: str) -> str:
    """A parameter with every character that has a named entity written as that entity
    (quotes excepted)."""
    def entity(char: str) -> str:
        if char in "\"'":
            return char
        name = html.entities.codepoint2name.get(ord(char)) or _html5_name(char)
        return f"&{name};" if name else char

    return "".join(entity(char) for char in text)


def _html5_name(char: str) -> str | None:
    names = [name[:-1] for name, value in html.entities.html5.items()
             if value == char and name.endswith(";")]
    return min(names, key=lambda name: (len(name), name.lower(), name)) if names else None


def sanitize_name(c: Column) -> Column:
    """A safe single file or folder name."""
    outer = " /\\?<>:*%|\"'`&;\xa0"
    name = F.btrim(strip_tags(c), F.lit(outer))
    name = F.translate(name, "({)}", "[[]]")
    name = F.regexp_replace(name, r"[\p{Cntrl}/\\?<>:*%|\"'`&;#+^$\s]", " ")
    return F.right(F.regexp_replace(name, r"\s+", " "), F.lit(NAME_LENGTH))


def _accent_rules() -> tuple[str, str, list[tuple[str, str]]]:
    """Accented letters, their base letters, and joined letters, derived from entity names."""
    marked, plain, joined = [], [], []
    for codepoint, name in html.entities.codepoint2name.items():
        if any(name[1:] == suffix for suffix in ACCENT_SUFFIXES):
            marked.append(chr(codepoint))
            plain.append(name[0])
        elif len(name) == 5 and name.endswith("lig"):
            joined.append((chr(codepoint), name[:2]))
    return "".join(marked), "".join(plain), joined


def ascii_name(c: Column) -> Column:
    """A name without accents; any other character outside the safe set becomes ``_``."""
    marked, plain, joined = _accent_rules()
    name = F.translate(c, marked, plain)
    for letter, pair in joined:
        name = F.replace(name, F.lit(letter), F.lit(pair))
    name = F.regexp_replace(name, r"[^A-Za-z0-9\[\]_\-.#~@+:]", "_")
    return F.right(F.regexp_replace(name, r"_+", "_"), F.lit(NAME_LENGTH))


def geonames_id(c: Column) -> Column:
    """Place number in a place uri, null when the uri is of another site."""
    found = F.regexp_extract(c, r"^https?://(?:www\.)?(?:sws\.)?geonames\.org/(\d+)", 1)
    return blank_to_null(found)


def authority_key(uri: Column, datatype: str) -> Column:
    """Canonical join key of an authority uri, null when the site does not belong to the type."""
    uri = trim(uri)
    if datatype == "valuesuggest:geonames:geonames":
        return geonames_id(uri)
    if datatype.startswith("valuesuggest:idref"):
        return blank_to_null(F.regexp_extract(uri, r"^https?://(?:www\.)?idref\.fr/(\w+)", 1))
    return blank_to_null(uri)


def rewrite(c: Column, mode: str, from_: str = "", to: str = "") -> Column:
    """Text after one replacement mode: raw, raw_i, html, unicode, regex, basename, filename
    or remove."""
    if mode == "basename":
        return basename(c)
    if mode == "filename":
        return filename(c)
    if mode == "unicode":
        return repair_unicode(c)
    if mode == "remove":
        return F.when(c.isNotNull(), F.lit(""))
    if mode == "regex":
        java = patterns.checked_pattern(from_)
        return F.regexp_replace(c, java, patterns.java_replacement(to, patterns.group_count(java)))
    if mode not in ("raw", "raw_i", "html"):
        raise ValueError(f"unknown replacement mode: {mode!r}")
    if from_ == "":
        return c
    if mode == "raw_i":
        return F.regexp_replace(c, "(?i)" + patterns.quote(from_), patterns.quote_replacement(to))
    replaced = F.replace(c, F.lit(from_), F.lit(to))
    if mode == "html" and entity_form(from_) != from_:
        replaced = F.replace(replaced, F.lit(entity_form(from_)), F.lit(to))
    return replaced
