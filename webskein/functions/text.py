"""Text expressions: token folding, normalisation, estimates, sentence and slice splitting, content hashes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that Python's str.split() takes as blanks.
BLANKS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
QUERY_TOKEN = r"(?U)\w+(?:(?:[.+#-]+\w+)|(?:\+\+)|#)*"


def _fold_map() -> tuple[str, str]:
    """Letters with exactly one mark, and their bases. A letter whose base has a mark itself is left alone."""
    pairs = []
    for c in map(chr, range(0x80, 0x3000)):
        d = unicodedata.decomposition(c).split()
        if len(d) == 2 and "<" not in d[0]:
            base, mark = (chr(int(x, 16)) for x in d)
            if unicodedata.combining(mark) and base.isascii() and base.isalpha():
                pairs.append((c.lower(), base.lower()))
    pairs = sorted({p for p in pairs if len(p[0]) == 1})
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


FOLD_FROM, FOLD_TO = _fold_map()


def folded(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, FOLD_FROM, FOLD_TO))


def tokens(text: Column) -> Column:
    """Index tokens in order: lower case, one diacritic taken off, runs of letters, numbers and private-use characters."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def collapsed(text: Column) -> Column:
    """All runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS + "+", " "))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.floor((F.length(text) + 3) / 4).cast("long")


def utf8_size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def sentences(text: Column) -> Column:
    """Split after full stop, exclamation or question mark before white space; blank ones go."""
    return F.filter(F.split(text, rf"(?<=[.!?]){BLANKS}+"), lambda s: F.trim(s) != "")


def slices(text: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` characters."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text), F.lit(size)), lambda i: F.substr(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def overlap_suffix(text: Column, size: int) -> Column:
    """The last ``size`` characters, from after their first blank on where the text is longer."""
    tail = F.right(text, F.lit(size))
    blank = F.instr(tail, " ")
    cut = F.when((blank > 0) & (blank < F.length(tail)), F.substr(tail, blank + 1)).otherwise(tail)
    return F.when(F.length(text) <= size, text).otherwise(F.regexp_replace(cut, r"^\s+|\s+$", ""))


def evidence(text: Column) -> Column:
    """For comparing quotations: lower case, single blanks, none before closing punctuation."""
    return F.regexp_replace(F.lower(collapsed(text)), r"\s+([.,;:!?])", "$1")


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts with NUL between; a null part is an empty one, so that positions never shift."""
    joined = []
    for p in parts:
        joined += [F.coalesce(p.cast("string"), F.lit("")), F.lit("\0")]
    return F.sha2(F.concat(*joined[:-1]).cast("binary"), 256)


def query_tokens(query: Column) -> Column:
    """Literal tokens of a query, each spelling once whatever its case, first spelling kept."""
    found = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(QUERY_TOKEN), F.lit(0))
    return F.filter(found, lambda t, i: F.array_position(F.transform(found, F.lower), F.lower(t)) == i + 1)


def longest_run(text: Column, char: str) -> Column:
    """Length of the longest run of a character, for sizing fences."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"[{char}]+"), F.lit(0)), F.length)), F.lit(0))


def code_lines(text: Column) -> Column:
    """Unified line ends, no trailing blanks, no blank lines at either end."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(lines, r"^\n+", ""), r"\n+$", "")


def table_cell(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))
