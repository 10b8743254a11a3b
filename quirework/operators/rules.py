"""Ordered rules that put one label on a row: container, intake, error, origin, freshness, licence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S

CEILING_BYTES = 60 * 1024 * 1024

# Leading bytes in hex -> container; the first match wins.
SIGNATURES = [
    ("25504446", "application/pdf"),
    ("504B0304", "zip"),
    ("D0CF11E0", "ole"),
    ("FFD8FF", "image/jpeg"),
    ("89504E47", "image/png"),
    ("47494638", "image/gif"),
]
RIFF, WEBP = "52494646", "57454250"
BRACE = "7B"

# Container and extension -> what a person calls it.
ZIP_NAMES = {"docx": "a Word document", "xlsx": "a Excel workbook", "pptx": "a PowerPoint deck",
             "odt": "an OpenDocument file", "ods": "an OpenDocument file", "epub": "an EPUB book"}
OLE_NAMES = {"doc": "an older Word document", "xls": "an older Excel workbook"}

# Fragment of an error message -> kind, in the order they are tried.
MESSAGE_KINDS = [
    ("is encrypted", "locked"),
    ("No PDF header found", "not-pdf"),
    ("Failed to parse PDF document", "damaged"),
    ("Expected instance of PDFDict", "damaged"),
    ("Unbalanced parenthesis", "damaged"),
    ("Expected object number", "damaged"),
    ("stalled", "damaged"),
]

# Licence families that must not ship, and licence names that may.
FORBIDDEN_LICENCE = r"(?i)(^|[^A-Za-z])(A?GPL|SSPL|CC-BY-NC|BUSL|EUPL)"
ALLOWED_LICENCES = ["MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "Unlicense", "CC0-1.0",
                    "OFL-1.1", "BlueOak-1.0.0", "Python-2.0", "MIT-0"]


def whole_word(pattern: str) -> str:
    """The pattern between ASCII word edges. Java's own \\b also counts accented letters as word characters."""
    return f"(?<![0-9A-Za-z_])(?:{pattern})(?![0-9A-Za-z_])"


def first_match(pairs: list[tuple[Column, object]], otherwise=None) -> Column:
    """The value of the first condition that holds."""
    start = F.when(pairs[0][0], S.col(pairs[0][1]) if isinstance(pairs[0][1], Column) else F.lit(pairs[0][1]))
    chain = reduce(lambda acc, p: acc.when(p[0], p[1] if isinstance(p[1], Column) else F.lit(p[1])), pairs[1:], start)
    return chain if otherwise is None else chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def sniff(head: str | Column) -> Column:
    h = F.hex(F.substring(S.col(head), 1, 16))
    rules = [(h.startswith(sig), kind) for sig, kind in SIGNATURES]
    rules.append((h.startswith(RIFF) & (F.substring(h, 17, 8) == WEBP), "image/webp"))
    rules.append((h.startswith(BRACE), "text"))
    return first_match(rules)


def extension(name: str | Column) -> Column:
    return F.lower(F.regexp_extract(S.col(name), r"\.([A-Za-z0-9]+)$", 1))


def container_name(sniffed: Column, name: str | Column) -> Column:
    ext = extension(name)
    zips = first_match([(ext == e, n) for e, n in ZIP_NAMES.items()], "a ZIP archive")
    oles = first_match([(ext == e, n) for e, n in OLE_NAMES.items()], "an old Microsoft Office file")
    image = F.concat(F.lit("a "), F.upper(F.substring(sniffed, 7, 20)), F.lit(" image"))
    plain = F.when(ext != "", F.concat(F.lit("a ."), ext, F.lit(" file"))).otherwise("not a PDF")
    return first_match([(sniffed == "zip", zips), (sniffed == "ole", oles), (sniffed.startswith("image/"), image)], plain)


def intake(size: str | Column, head: str | Column, ceiling: int = CEILING_BYTES) -> Column:
    """Why a file is turned away, NULL when it is taken. The cheapest test comes first."""
    kind = sniff(head)
    return first_match([(S.col(size) == 0, "empty"), (S.col(size) > ceiling, "too-big"),
                        (~F.coalesce(kind == "application/pdf", F.lit(False)), "not-pdf")])


def classify_error(name: Column, code: Column, message: Column) -> Column:
    rules = [
        ((name == "PasswordException") & (code == 2), "wrong-password"),
        (name == "PasswordException", "locked"),
        (name == "InvalidPDFException", "damaged"),
        (name.isin("RangeError", "QuotaExceededError"), "out-of-memory"),
    ]
    rules += [(F.contains(F.coalesce(message, F.lit("")), F.lit(fragment)), kind) for fragment, kind in MESSAGE_KINDS]
    return first_match(rules, "unknown")


def url_parts(url: str | Column) -> Column:
    """Scheme, host and path of a URL; the query is dropped. NULL fields when it does not parse."""
    u = S.col(url)
    return F.struct(F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))).alias("scheme"),
                    F.lower(F.try_parse_url(u, F.lit("HOST"))).alias("host"),
                    F.try_parse_url(u, F.lit("PATH")).alias("path"),
                    F.try_parse_url(u, F.lit("AUTHORITY")).alias("authority"))


def is_third_party(url: str | Column, own_origin: str) -> Column:
    """A URL of another origin. Never for data:, blob:, about:, relative or unreadable ones."""
    p = url_parts(url)
    origin = F.concat(p["scheme"], F.lit("://"), F.lower(p["authority"]))
    return F.coalesce(~p["scheme"].isin("data", "blob", "about") & (origin != own_origin), F.lit(False))


def is_fresh(at: str | Column, now: Column, max_age: str, skew: str | None = None) -> Column:
    """Not older than ``max_age`` before ``now``, nor further ahead of it than ``skew``."""
    ok = S.col(at) >= now - F.expr(f"INTERVAL {max_age}")
    return ok if skew is None else ok & (S.col(at) <= now + F.expr(f"INTERVAL {skew}"))


def licence_verdict(licence: str | Column) -> Column:
    """Forbidden family anywhere, else allowed when some term is on the list, else unclear."""
    plain = F.regexp_replace(S.col(licence), r"[()]", "")
    terms = F.split(plain, r"(?i)\s+(?:OR|AND)\s+")
    return first_match([(plain.rlike(FORBIDDEN_LICENCE), "forbidden"),
                        (F.exists(terms, lambda t: F.trim(t).isin(ALLOWED_LICENCES)), "allowed")], "unclear")


def licence_text(one: Column, one_type: Column, many: Column) -> Column:
    """One licence field as text: a string, an object's type, or an array joined with OR."""
    return F.coalesce(one, one_type, F.when(F.size(many) >= 0, F.array_join(many, " OR ")), F.lit("UNKNOWN"))
