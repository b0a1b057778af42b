"""Text functions as Column expressions: folding, tokens, slugs, titles, globs.

Everything here stays in the JVM. The same rules in plain Python serve the document parser.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words.
STOPWORDS = (
    "a an the and or but if then else of to in on at by for with from as is are was were be been being it its this that these those "
    "i you he she they we not no nor so than too very can will just do does did done have has had having my our your their his her "
    "them us me mine what which who whom when where why how all any both each few more most other some such only own same s t don now"
).split()
# Letters that do not decompose to ASCII letters, or fold to two. × and ÷ fold to nothing.
SPECIAL_FOLDS = {
    "ß": "ss", "Æ": "ae", "æ": "ae", "Œ": "oe", "œ": "oe", "Ĳ": "ij", "ĳ": "ij", "Þ": "th", "þ": "th", "Ŋ": "n", "ŋ": "n", "ŉ": "n",
    "Ð": "d", "ð": "d", "Đ": "d", "đ": "d", "Ø": "o", "ø": "o", "Ħ": "h", "ħ": "h", "ı": "i", "ĸ": "k", "Ŀ": "l", "ŀ": "l", "Ł": "l",
    "ł": "l", "Ŧ": "t", "ŧ": "t", "×": "", "÷": "",
}
TOKEN_MIN, TOKEN_MAX, TOKENS_PER_DOC = 2, 128, 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fold_char(c: str) -> str:
    if c in SPECIAL_FOLDS:
        return SPECIAL_FOLDS[c]
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()


LATIN_FOLD = {chr(c): _fold_char(chr(c)) for c in range(0xC0, 0x180)}
_ONE = {c: f for c, f in LATIN_FOLD.items() if len(f) == 1}
TWO = {c: f for c, f in LATIN_FOLD.items() if len(f) == 2}
FOLD_FROM, FOLD_TO = UPPER + "".join(_ONE), LOWER + "".join(_ONE.values())


def fold_text(text: str) -> str:
    """Latin letters to lower-case ASCII; every other character stays."""
    return "".join(LATIN_FOLD.get(c, c.lower() if "A" <= c <= "Z" else c) for c in text)


def fold(text: Column, gone: str = "") -> Column:
    """``fold_text`` on a column; ``gone`` stands for letters that fold to nothing.

    ASCII texts (as many bytes as characters) only need ``lower``; the digraphs' replacements, a pass
    each, are made only where one occurs.
    """
    plain = F.translate(text, FOLD_FROM, FOLD_TO)
    full = plain
    for c, f in TWO.items():
        full = F.replace(full, F.lit(c), F.lit(f))
    for c in "×÷":
        full = F.replace(full, F.lit(c), F.lit(gone))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).when(text.rlike(f"[{''.join(TWO)}×÷]"), full).otherwise(plain)


def tokens(text: Column) -> Column:
    """Folded words of 2 to 128 bytes that are no stop words, in order, repeats kept."""
    runs = F.split(fold(text, " "), "[^a-z0-9]+")
    return F.filter(runs, lambda t: F.length(t).between(TOKEN_MIN, TOKEN_MAX) & ~t.isin(*STOPWORDS))


def tokenize(text: str) -> list[str]:
    found = re.findall("[a-z0-9]+", fold_text(text.replace("×", " ").replace("÷", " ")))
    return [t for t in found if TOKEN_MIN <= len(t) <= TOKEN_MAX and t not in _STOP]


_STOP = frozenset(STOPWORDS)


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def slug(text: str) -> str:
    return re.sub("[^a-z0-9]+", "-", fold_text(text)).strip("-")


def title_from_path(path: Column) -> Column:
    """The last segment without its extension (a leading dot begins none), - and _ as blanks."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.translate(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "-_", "  ")


def path_title(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    stem = name[: name.rfind(".")] if name.rfind(".") > 0 else name
    return stem.replace("-", " ").replace("_", " ")


def glob_regex(pattern: str) -> str:
    """``*`` and ``?`` of a glob as an anchored regular expression."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def glob_match(text: Column, pattern: str) -> Column:
    return text.rlike("(?s)" + glob_regex(pattern))


def url_decode_strict(text: str) -> str | None:
    """``%xx`` only; ``+`` stays; None for a broken escape."""
    if re.search("%(?![0-9A-Fa-f]{2})", text):
        return None
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode()).decode("utf-8", "replace")


def query_parameters(query: str) -> dict[str, str]:
    """Of a repeated parameter the first holds; parameters with broken escapes are left out."""
    out: dict[str, str] = {}
    for part in query.split("&"):
        key, _, value = part.partition("=")
        k, v = url_decode_strict(key), url_decode_strict(value)
        if key and k is not None and v is not None:
            out.setdefault(k, v)
    return out
