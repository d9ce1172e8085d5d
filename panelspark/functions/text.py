"""Text normalisation and parsing as column expressions.

Spark has no Unicode decomposition builtin.  Folding is a ``translate`` whose table is derived from
the Unicode data when first used: every code point of every script whose folded form differs.  Code
points that fold to several are looked up in an array, and Hangul syllables are taken apart by
arithmetic, both only in texts that have some.  ASCII texts, told by their number of bytes, only
change case.  ``normalize_exact`` is the same in one Arrow UDF.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

_SPACES = r"[\s\p{Z}\x1c-\x1f\x85]+"
# No code point from here on changes under folding or is a combining mark.
_LAST = 0x30000
COMBINING_MARKS = "".join(c for c in map(chr, range(0x0300, _LAST)) if unicodedata.combining(c))
# Code points of a plane without characters; they stand in for letters that fold to several.
_STAND_IN = 0x40000
# Texts of a batch that the exact function holds as Python strings at once.
_TEXTS = 64
# Hangul syllables: first one, their number, and the jamo of the three places (none as third).
_SYLLABLE, _SYLLABLES = 0xAC00, 11172
_JAMO = ([chr(0x1100 + i) for i in range(19)], [chr(0x1161 + i) for i in range(21)],
         ["", *(chr(0x11A8 + i) for i in range(27))])


def _strip_marks(text: str, form: str) -> str:
    return "".join(c for c in unicodedata.normalize(form, text) if not unicodedata.combining(c))


@lru_cache
def _folding(form: str, full_casefold: bool) -> tuple[str, str, list[str]]:
    """(from, to) for one ``translate`` and what each stand-in expands to, in order.

    Letters are mapped to their folded base letter; combining marks have no counterpart in
    ``to``, so ``translate`` drops them.
    """
    source, target, expansions, empty = [], [], {}, []
    for char in map(chr, range(_LAST)):
        code = ord(char)
        if 0xD800 <= code < 0xE000 or _SYLLABLE <= code < _SYLLABLE + _SYLLABLES or unicodedata.combining(char):
            continue
        folded = _strip_marks(char, form)
        folded = folded.casefold() if full_casefold else folded.lower()
        # Folding may bring marks and forms of its own (casefolded letters with marks).
        if folded == char:
            continue
        if not folded:
            empty.append(char)
            continue
        if len(folded) > 1:
            folded = chr(_STAND_IN + expansions.setdefault(folded, len(expansions)))
        source.append(char)
        target.append(folded)
    return "".join(source) + COMBINING_MARKS + "".join(empty), "".join(target), list(expansions)


def _fold(column: Column, form: str, full_casefold: bool) -> Column:
    source, target, expansions = _folding(form, full_casefold)
    rare = (f"[{chr(_STAND_IN)}-{chr(_STAND_IN + len(expansions) - 1)}"
            f"{chr(_SYLLABLE)}-{chr(_SYLLABLE + _SYLLABLES - 1)}]")
    listed = lambda values: F.array(*[F.lit(v) for v in values])

    def expand(char: Column) -> Column:
        code = F.ascii(char)
        place = code - _SYLLABLE
        jamo = [F.element_at(listed(values), (F.floor(place / step) % len(values) + 1).cast("int"))
                for values, step in zip(_JAMO, (588, 28, 1), strict=True)]
        return (F.when(code.between(_STAND_IN, _STAND_IN + len(expansions) - 1),
                       F.element_at(listed(expansions), (code - _STAND_IN + 1).cast("int")))
                .when(code.between(_SYLLABLE, _SYLLABLE + _SYLLABLES - 1), F.concat(*jamo)).otherwise(char))

    # Bound, so that a text is translated once for the test and the result.
    other = bind(F.translate(column, source, target), lambda folded: F.when(
        folded.rlike(rare), F.array_join(F.transform(F.split(folded, ""), expand), "")).otherwise(folded))
    return F.when(F.length(column) == F.octet_length(column), F.lower(column)).otherwise(other)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once.

    A filter inlines every expression it refers to, so a costly one named twice would run twice.
    """
    return F.transform(F.array(value), use)[0]


def squeeze(column: Column) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(column, _SPACES, " "))


def fold(column: Column) -> Column:
    """Case-folded without accents (compatibility decomposition), all scripts."""
    return _fold(column, "NFKD", True)


def normalize_name(column: Column) -> Column:
    """Accent- and case-blind name with single blanks."""
    return squeeze(fold(column))


def normalize_slug(column: Column) -> Column:
    """Only ``a-z0-9`` words separated by single blanks."""
    return F.trim(F.regexp_replace(fold(column), "[^a-z0-9]+", " "), F.lit(" "))


def normalize_search(column: Column) -> Column:
    """Search form: accents dropped, commas and blanks merged, lower case."""
    return F.trim(F.regexp_replace(_fold(column, "NFD", False), r"[,\s\p{Z}]+", " "))


@F.arrow_udf(T.StringType())
def normalize_exact(values: pa.Array) -> pa.Array:
    """As ``normalize_name`` for any script: full NFKD and Unicode case folding.

    A few texts at a time become Python strings, so a task holds a batch of texts and of results, no more.
    """
    import re
    import unicodedata

    import pyarrow as pa

    marks = re.compile(f"[{COMBINING_MARKS}]+")

    def one(text):
        if text is None:
            return None
        if not text.isascii():
            text = marks.sub("", unicodedata.normalize("NFKD", text))
        return " ".join(text.casefold().split())

    pieces = [pa.array([one(t) for t in values.slice(at, _TEXTS).to_pylist()], pa.string()) for at in range(0, len(values), _TEXTS)]
    return pa.concat_arrays(pieces) if pieces else pa.array([], pa.string())


def mentions_unit(text: Column, name: Column, state: Column) -> Column:
    """Whether free text names the unit in one of four accepted phrasings (substring test)."""
    both = F.struct(normalize_slug(text).alias("text"), normalize_slug(name).alias("name"))

    def found(pair):
        result = pair["text"].contains(F.concat(pair["name"], F.lit(" "), F.lower(state)))
        for link in ("de", "do", "da"):
            result = result | pair["text"].contains(F.concat(F.lit(f"municipio {link} "), pair["name"]))
        return result

    return bind(both, found)


def contains_all(column: Column, terms) -> Column:
    result = F.lit(True)
    for term in terms:
        result = result & column.contains(term)
    return result


def is_inactive_status(column: Column) -> Column:
    """Cancelled or annulled, accent- and case-blind."""
    folded = _fold(column, "NFD", False)
    return folded.contains("cancel") | folded.contains("anulad")


def split_label(label: Column) -> tuple[Column, Column]:
    """``"Name - UF"`` into its two parts; anything else is an error."""
    shape = r"^(.*) - ([A-Z]{2})$"
    checked = F.when(label.rlike(shape), label).otherwise(
        F.raise_error(F.concat(F.lit("unexpected unit label: "), F.coalesce(label, F.lit("null")))))
    return F.regexp_extract(checked, shape, 1), F.regexp_extract(checked, shape, 2)


# Fixed value: shape of a release file name (years, version, year, month, day).
RELEASE_NAME = (r"(?i)BD_Atlas_(\d{4})_(\d{4})_(v\d+(?:\.\d+)*)_"
                r"(\d{4})[._-](\d{2})[._-](\d{2})_Consolidado")


def parse_release_name(name: Column, pattern: str = RELEASE_NAME) -> Column:
    """Struct of first year, latest year, version and official date out of a file name."""
    def part(i):
        return F.regexp_extract(name, pattern, i)

    return F.when(name.rlike(pattern), F.struct(
        part(1).cast("int").alias("first_year"),
        part(2).cast("int").alias("latest_year"),
        F.lower(part(3)).alias("version"),
        F.make_date(part(4).cast("int"), part(5).cast("int"), part(6).cast("int"))
        .alias("official_date"),
    )).otherwise(F.raise_error(
        F.concat(F.lit("release name not recognised: "), F.coalesce(name, F.lit("null")))))


# Month names in Portuguese, without accents.
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto",
          "setembro", "outubro", "novembro", "dezembro")


def parse_long_date(text: Column) -> Column:
    """``12 de agosto de 2026`` anywhere in the text as a date; null where there is none."""
    shape = r"(?i)(\d{1,2})\s+de\s+([A-Za-zÀ-ÿ]+)\s+de\s+(\d{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]),
                             fold(F.regexp_extract(text, shape, 2))).cast("int")
    checked = F.when(month > 0, month).otherwise(F.raise_error(
        F.concat(F.lit("month not recognised in: "), text)))
    return F.when(text.rlike(shape), F.make_date(
        F.regexp_extract(text, shape, 3).cast("int"), checked,
        F.regexp_extract(text, shape, 1).cast("int")))


def parse_version(text: Column) -> Column:
    """The ``v1.2`` token, lower case; an error where there is none."""
    found = F.regexp_extract(text, r"(?i)\b(v\d+(?:\.\d+)*)\b", 1)
    return F.when(found != "", F.lower(found)).otherwise(
        F.raise_error(F.concat(F.lit("version not recognised: "), F.coalesce(text, F.lit("null")))))


def clean_workbook_text(column: Column) -> Column:
    """Undo the two control-character escapes a workbook export leaves in text cells."""
    no_returns = F.replace(column.cast("string"), F.lit("_x000D_"), F.lit(""))
    return F.replace(no_returns, F.lit("_x0002_"), F.lit("\u0002"))


def blank_to_null(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def full_match(column: Column, pattern: str) -> Column:
    """Whole-value regex match (``$`` alone would accept a trailing newline)."""
    return column.rlike(rf"\A(?:{pattern})\z")
