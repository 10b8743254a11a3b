"""Scalar functions, all plain Column expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KB = 1024
MB = 1024 * 1024
GB = 1024 * 1024 * 1024

# The paper sizes that get a name, in points, portrait.
PAPER = [("A4", 595, 842), ("Letter", 612, 792), ("Legal", 612, 1008), ("A3", 842, 1191), ("A5", 420, 595)]
PAPER_SLACK = 3


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once per row and then only read.

    A projected expression is copied by the optimiser into every later filter and projection that uses it;
    a costly one (a JSON parse, a long rule chain) would then run many times per row. A one-element
    generator keeps it in its own step, still inside generated code.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def div(a: Column, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def js_round(x: Column) -> Column:
    """Half goes up, also for negatives: floor(x + 0.5)."""
    return F.floor(x + F.lit(0.5))


def decimal_text(n: Column, unit: int, digits: int) -> Column:
    """n / unit with a fixed number of decimals, by integer arithmetic so no engine can round it apart."""
    n = n.cast("long")
    if digits == 0:
        return div(n + F.lit(unit // 2), unit).cast("string")
    scale = 10 ** digits
    q = div(n * F.lit(scale) + F.lit(unit // 2), unit)
    return F.concat(div(q, scale).cast("string"), F.lit("."),
                    F.lpad((q % F.lit(scale)).cast("string"), digits, "0"))


def format_bytes(n: str | Column, precise: bool = False) -> Column:
    n = col(n).cast("long")
    kb1, kb0 = decimal_text(n, KB, 1), decimal_text(n, KB, 0)
    mb2, mb1 = decimal_text(n, MB, 2), decimal_text(n, MB, 1)
    kb = kb1 if precise else F.when(n < 10 * KB, kb1).otherwise(kb0)
    mb = mb2 if precise else F.when(n < 10 * MB, mb2).otherwise(mb1)
    return (F.when(n.isNull() | (n < 0), F.lit("—"))
            .when(n < KB, F.concat(n.cast("string"), F.lit(" bytes")))
            .when(n < MB, F.concat(kb, F.lit(" KB")))
            .when(n < GB, F.concat(mb, F.lit(" MB")))
            .otherwise(F.concat(decimal_text(n, GB, 2), F.lit(" GB"))))


def readout_bytes(n: str | Column) -> Column:
    """The egress readout's wording: one decimal throughout, no GB step."""
    n = col(n).cast("long")
    return (F.when(n < KB, F.concat(n.cast("string"), F.lit(" bytes")))
            .when(n < MB, F.concat(decimal_text(n, KB, 1), F.lit(" KB")))
            .otherwise(F.concat(decimal_text(n, MB, 1), F.lit(" MB"))))


def error_bytes(n: str | Column) -> Column:
    """The error card's wording: one decimal, two for GB."""
    n = col(n).cast("long")
    return F.when(n < GB, readout_bytes(n)).otherwise(F.concat(decimal_text(n, GB, 2), F.lit(" GB")))


def size_against(n: str | Column, limit: int) -> Column:
    shown = error_bytes(n)
    return F.when(shown == error_bytes(F.lit(limit)), F.concat(F.lit("fractionally over "), shown)).otherwise(shown)


def plural(n: str | Column, one: str, many: str | None = None) -> Column:
    n = col(n).cast("long")
    return F.concat(F.format_number(n, 0), F.lit(" "),
                    F.when(n == 1, F.lit(one)).otherwise(F.lit(many or one + "s")))


def pick(n: str | Column, one: str, many: str) -> Column:
    return F.when(col(n) == 1, F.lit(one)).otherwise(F.lit(many))


def percent(fraction: str | Column, digits: int = 0) -> Column:
    scaled = F.floor(col(fraction) * F.lit(float(10 ** (digits + 2))) + F.lit(0.5)).cast("long")
    return F.concat(decimal_text(scaled, 10 ** digits, digits), F.lit("%"))


def seconds(ms: str | Column) -> Column:
    return F.concat(decimal_text(col(ms).cast("long"), 1000, 1), F.lit("s"))


def suffix_name(name: str | Column, suffix: str, ext: str = ".pdf") -> Column:
    return F.concat(F.regexp_replace(col(name), r"\.[^.]+$", ""), F.lit(suffix + ext))


def js_trim(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def safe_name(name: str | Column, most: int | None = None) -> Column:
    """A name a file system takes. ``most`` cuts it to so many characters; names handed out by number
    (``runs.allocate_names``) are numbered first."""
    c = F.regexp_replace(col(name), r'[\\/:*?"<>|]', "-")
    c = F.regexp_replace(c, r"[\x00-\x1f]", "")
    c = F.regexp_replace(c, r"^\.+", "")
    c = js_trim(c) if most is None else F.substring(js_trim(c), 1, most)
    return F.when(c == "", F.lit("file")).otherwise(c)


def page_size_name(width: str | Column, height: str | Column) -> Column:
    w, h = F.least(col(width), col(height)), F.greatest(col(width), col(height))
    out = None
    for name, pw, ph in PAPER:
        near = (F.abs(w - pw) < PAPER_SLACK) & (F.abs(h - ph) < PAPER_SLACK)
        out = F.when(near, F.lit(name)) if out is None else out.when(near, F.lit(name))
    return out.otherwise(F.concat(points_to_mm(w).cast("string"), F.lit("×"), points_to_mm(h).cast("string"), F.lit(" mm")))


def points_to_mm(pt: str | Column) -> Column:
    return js_round(col(pt) / F.lit(72.0) * F.lit(25.4)).cast("long")


def turn(angle: str | Column) -> Column:
    """Any angle as 0..359."""
    return F.pmod(col(angle).cast("long"), F.lit(360).cast("long"))


def page_shape(width: str | Column, height: str | Column, rotation: str | Column) -> Column:
    """Width and height as seen after rotation, and whether that is landscape."""
    r = turn(rotation)
    swapped = r.isin(90, 270)
    w = F.when(swapped, col(height)).otherwise(col(width))
    h = F.when(swapped, col(width)).otherwise(col(height))
    return F.struct(w.alias("width_pt"), h.alias("height_pt"), r.alias("rotation"), (w > h).alias("landscape"))


def map_point(u: Column, v: Column, width: Column, height: Column, rotation: Column) -> Column:
    """A point of the rotated view, back in page space."""
    r = turn(rotation)
    x = F.when(r == 90, v).when(r == 180, width - u).when(r == 270, width - v).otherwise(u)
    y = F.when(r == 90, u).when(r == 180, v).when(r == 270, height - u).otherwise(height - v)
    return F.struct(x.alias("x"), y.alias("y"))


def text_direction(rotation: str | Column) -> Column:
    r = turn(rotation)
    return (F.when(r == 90, F.lit("0 1 -1 0")).when(r == 180, F.lit("-1 0 0 -1"))
            .when(r == 270, F.lit("0 -1 1 0")).otherwise(F.lit("1 0 0 1")))


def text_stretch(box_width: Column, natural: Column) -> Column:
    return F.when(natural > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), box_width / natural * 100.0))).otherwise(F.lit(100.0))


FIT_MARGIN = 24.0


def fit_to_page(w: Column, h: Column, page_w: float, page_h: float) -> Column:
    scale = F.least((F.lit(page_w) - 2 * FIT_MARGIN) / w, (F.lit(page_h) - 2 * FIT_MARGIN) / h, F.lit(1.0))
    return F.struct(scale.alias("scale"), ((F.lit(page_w) - w * scale) / 2).alias("x"),
                    ((F.lit(page_h) - h * scale) / 2).alias("y"))


def drawn_dpi(width_px: Column, width_pt: Column) -> Column:
    """Resolution as drawn; NULL (never 0) when the image is not measurably placed."""
    return F.when(width_pt > 0.01, width_px / width_pt * 72.0)


def parse_target(amount: str | Column, unit: str | Column) -> Column:
    """What a person typed as a size, in bytes; the first comma counts as a point; NULL when not usable."""
    n = F.regexp_replace(js_trim(amount), r"^([^,]*),", "$1.")
    n = F.when(n.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), n).try_cast("double")
    factor = F.when(col(unit) == "KB", F.lit(float(KB))).when(col(unit) == "MB", F.lit(float(MB)))
    return F.when(n > 0, F.floor(n * factor).cast("long"))


def base64url(data: Column) -> Column:
    return F.rtrim(F.translate(F.base64(data), "+/=\r\n", "-_"), F.lit("="))


def from_base64url(text: str | Column) -> Column:
    t = F.translate(col(text), "-_", "+/")
    pad = F.pmod(F.lit(4) - F.length(t) % 4, F.lit(4))
    return F.unbase64(F.concat(t, F.repeat(F.lit("="), pad)))


def email_key(email: str | Column) -> Column:
    """Trimmed and lower-cased; blank becomes NULL."""
    return F.nullif(F.lower(F.trim(col(email))), F.lit(""))


def text_or_null(c: str | Column) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(F.trim(col(c)), F.lit(""))


TRANSACTION_REFERENCE = r"^txn_[a-z0-9]{26}$"


def is_transaction_reference(c: str | Column) -> Column:
    return col(c).rlike(TRANSACTION_REFERENCE)


def run_label(prefix: str, at: str | Column) -> Column:
    """A run's name by when it happened, to the second."""
    return F.concat(F.lit(prefix + "-"), F.date_format(col(at), "yyyy-MM-dd-HH-mm-ss"), F.lit(".zip"))


def slug(c: str | Column) -> Column:
    """Heading text as an anchor: punctuation goes, each space becomes one dash."""
    kept = F.regexp_replace(F.lower(col(c)), r"[^\w\s-]", "")
    return F.regexp_replace(js_trim(kept), r"\s", "-")


def content_sha(c: str | Column) -> Column:
    """Hash that does not change with line-end style, first 16 hex digits."""
    return F.substring(F.sha2(F.regexp_replace(col(c), "\r\n", "\n"), 256), 1, 16)
