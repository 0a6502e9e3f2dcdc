"""Regular-expression and replacement parameters, turned into the Java dialect Spark uses.

Everything here works on *parameters* (one short string per call, on the driver).
No data row ever passes through this module.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

# Closing delimiter for each bracket-style opening delimiter.
PAIRED_DELIMITERS = {"(": ")", "[": "]", "{": "}", "<": ">"}

# Named character classes and their Java spelling.
POSIX_CLASSES = {
    "alnum": r"\p{Alnum}",
    "alpha": r"\p{Alpha}",
    "ascii": r"\p{ASCII}",
    "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}",
    "digit": r"\p{Digit}",
    "graph": r"\p{Graph}",
    "lower": r"\p{Lower}",
    "print": r"\p{Print}",
    "punct": r"\p{Punct}",
    "space": r"\s",
    "upper": r"\p{Upper}",
    "word": r"\w",
    "xdigit": r"\p{XDigit}",
}

# Constructs with no Java counterpart, rejected when a plan is built.
UNSUPPORTED = (
    (r"\(\?(?:R|[+-]?\d+|&\w+|P>\w+)\)", "recursion"),
    (r"\(\?\(", "conditional group"),
    (r"\(\?\|", "branch reset"),
    (r"\(\*[A-Z]", "backtracking verb"),
)

_TOKEN = re.compile(
    r"(?P<quoted>\\Q.*?(?:\\E|\Z))"
    r"|(?P<groupref>\\g\{?(?P<ref>-?\d+)\}?)"
    r"|(?P<escape>\\.)"
    r"|(?P<posix>\[:(?P<neg>\^?)(?P<cls>[a-z]+):\])"
    r"|(?P<named>\(\?(?:P?<|')(?P<name>[A-Za-z_]\w*)(?:>|'))"
    r"|(?P<backref>\(\?P=(?P<back>\w+)\))"
    r"|(?P<char>.)",
    re.S,
)


def quote(text: str) -> str:
    """`text` as a literal Java pattern (an embedded end-of-quote marker is split out)."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def quote_replacement(text: str) -> str:
    """`text` as a literal replacement (no group references)."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def split_delimiters(pattern: str) -> tuple[str, str]:
    """Split ``/body/flags`` into body and flags."""
    stripped = pattern.lstrip()
    if not stripped or stripped[0].isalnum() or stripped[0] == "\\":
        raise ValueError(f"regular expression needs delimiters: {pattern!r}")
    closing = PAIRED_DELIMITERS.get(stripped[0], stripped[0])
    end = stripped.rfind(closing)
    if end <= 0:
        raise ValueError(f"regular expression has no closing delimiter: {pattern!r}")
    return stripped[1:end], stripped[end + 1:].strip()


def _java_name(name: str) -> str:
    # Java group names are letters and digits only.
    return name.replace("_", "U95")


def _java_flags(flags: str, pattern: str) -> tuple[str, bool, bool]:
    # Line feeds are the only line ends in the source dialect, hence the "d" (unix lines).
    java = "d"
    for flag in flags:
        if flag in "imsx":
            java += flag
        elif flag == "u":
            java += "U"
        elif flag not in "ADSX":
            raise ValueError(f"regular expression flag {flag!r} is not supported: {pattern!r}")
    return "".join(sorted(set(java))), "A" in flags, "D" in flags


def java_pattern(pattern: str) -> str:
    """Translate a delimited pattern with flags into a Java pattern with inline flags."""
    body, flags = split_delimiters(pattern)
    java, anchored, dollar_end = _java_flags(flags, pattern)
    for construct, label in UNSUPPORTED:
        if re.search(construct, body):
            raise ValueError(f"regular expression uses a {label}: {pattern!r}")
    out, in_class, class_start = [], False, -1
    for token in _TOKEN.finditer(body):
        kind, text = token.lastgroup, token.group(0)
        if token.group("quoted") or (token.group("escape") and text not in (r"\K", r"\C", r"\N")):
            out.append(text)
        elif token.group("escape"):
            raise ValueError(f"regular expression uses {text}: {pattern!r}")
        elif token.group("groupref") and not in_class:
            if token.group("ref").startswith("-"):
                raise ValueError(f"regular expression uses a relative reference: {pattern!r}")
            out.append("\\" + token.group("ref"))
        elif token.group("posix") and in_class:
            java_class = POSIX_CLASSES.get(token.group("cls"))
            if java_class is None:
                raise ValueError(f"unknown character class {text}: {pattern!r}")
            out.append(f"[^{java_class}]" if token.group("neg") else java_class)
        elif token.group("named") and not in_class:
            out.append(f"(?<{_java_name(token.group('name'))}>")
        elif token.group("backref") and not in_class:
            out.append(f"\\k<{_java_name(token.group('back'))}>")
        elif len(text) > 1:
            # A token that only has a meaning in the other context: keep it character by character.
            out.append(text if not in_class else text.replace("[", "\\[").replace("&&", "&\\&"))
        elif in_class:
            first = token.start() == class_start or (
                token.start() == class_start + 1 and body[class_start] == "^")
            if text == "]" and not first:
                in_class = False
                out.append(text)
            elif text in "[]" or (text == "&" and body[token.start() - 1] == "&"):
                out.append("\\" + text)
            else:
                out.append(text)
        elif text == "[":
            in_class, class_start = True, token.end()
            out.append(text)
        elif text == "$" and dollar_end and "m" not in flags:
            out.append("\\z")
        else:
            out.append(text)
    prefix = f"(?{java})" + ("\\G" if anchored else "")
    return prefix + "".join(out)


def group_count(java: str) -> int:
    """Number of capturing groups of a translated pattern."""
    bare = re.sub(r"\\Q.*?(?:\\E|\Z)|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "", java, flags=re.S)
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", bare))


def java_replacement(replacement: str, groups: int) -> str:
    r"""Translate ``\1``, ``$1`` and ``${1}`` references; a missing group gives nothing."""
    def swap(found: re.Match) -> str:
        digits = found.group(1) or found.group(2) or found.group(3)
        if digits is None:
            return quote_replacement("\\" if found.group(0) == "\\\\" else found.group(0))
        if int(digits) > groups:
            return ""
        following = replacement[found.end():found.end() + 1]
        # A digit right after the reference must not be read as part of it: the caller's
        # next literal digit is escaped.
        return f"${int(digits)}" + ("\x00" if following.isdigit() else "")

    text = re.sub(r"\\\\|\\(\d{1,2})|\$(\d{1,2})|\$\{(\d{1,2})\}|[\\$]", swap, replacement)
    return re.sub("\x00(\\d)", r"\\\1", text)


def checked_pattern(pattern: str) -> str:
    """Translate and compile once, so a broken pattern fails while the plan is built."""
    java = java_pattern(pattern)
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark.sql("SELECT '' RLIKE :p AS ok", args={"p": java}).collect()
        except Exception as error:
            raise ValueError(f"invalid regular expression: {pattern!r}") from error
    return java


def unescape_separator(separator: str) -> str:
    r"""Read ``\n``, ``\r``, ``\t`` and ``\\`` in a separator."""
    # Escapes understood in a separator.
    escapes = {"\\n": "\n", "\\r": "\r", "\\t": "\t", "\\\\": "\\"}
    return re.sub(r"\\[nrt\\]", lambda found: escapes[found.group(0)], separator)


def split_list(items) -> list[str]:
    """Flatten entries on ``=``, trim, drop blanks and repeats (order kept)."""
    flat = (part.strip() for item in (items or []) for part in str(item).split("="))
    return list(dict.fromkeys(part for part in flat if part and part != "0"))
