"""Text and path expressions, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.model import LANGUAGES, Filter, InvalidFilter, valid_path

SPACE = r"\p{IsWhite_Space}"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; also cut where a word in camel case goes on."""
    cut = F.regexp_replace(text, r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1\n$2")
    cut = F.regexp_replace(cut, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1\n$2")
    return F.filter(F.transform(F.split(cut, r"[^\p{L}\p{Nd}]+"), F.lower), lambda x: x != "")


def token_set(text: Column) -> Column:
    """Distinct tokens in the order they first stand."""
    return F.array_distinct(tokens(text))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def trimmed(text: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def line_count(text: Column) -> Column:
    """Lines of a text; a line end at the text's end doesn't begin another."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 1).otherwise(ends + F.when(text.endswith("\n"), 0).otherwise(1))


def reference_ok(path: Column, start: Column, end: Column) -> Column:
    """A clean relative path and a range of lines."""
    clean = ~path.rlike(r"^/|\\|//|/\z|(^|/)\.{1,2}(/|\z)") & (path != "")
    return clean & (start > 0) & (end >= start)


def scan_path_ok(path: Column) -> Column:
    """Also valid UTF-8, and without control or format characters."""
    return reference_ok(path, F.lit(1), F.lit(1)) & F.is_valid_utf8(path) & ~path.rlike(r"[\p{Cc}\p{Cf}]")


def language_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))
    by = {".js": "javascript", ".jsx": "javascript", ".py": "python", ".ts": "typescript", ".tsx": "typescript"}
    return F.coalesce(*(F.when(extension == e, name) for e, name in by.items()), F.lit("unknown"))


def checked(wanted: Filter, languages: Sequence[str] | None = LANGUAGES) -> Filter:
    """The filter, if it is valid. languages: the ones that may be asked for; None: any."""
    for prefix in wanted.path_prefixes:
        if not valid_path(prefix.removesuffix("/")):
            raise InvalidFilter("invalid path prefix")
    if languages is not None and any(x not in languages for x in wanted.languages):
        raise InvalidFilter("unsupported language")
    return wanted


def matches(wanted: Filter, path: Column = None, language: Column = None) -> Column:
    """Whether a chunk passes the filter; both parts reach the scan as pushed predicates."""
    path = F.col("path") if path is None else path
    language = F.col("language") if language is None else language
    admitted = F.lit(True)
    if wanted.path_prefixes:
        under = F.lit(False)
        for prefix in (p.removesuffix("/") for p in wanted.path_prefixes):
            under = under | (path == prefix) | path.startswith(prefix + "/")
        admitted = admitted & under
    if wanted.languages:
        admitted = admitted & language.isin(list(wanted.languages))
    return admitted
