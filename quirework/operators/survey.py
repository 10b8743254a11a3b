"""Survey submissions: request guards, field rules in order, one row per person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import first_match

LIMITS = {"email": 254, "profession": 200, "spends_too_long": 1200, "cadence": 200}
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"


def guard(method: Column, origin: Column, own_origin: Column, content_type: Column) -> Column:
    """Why a request is refused before its body is read; NULL when it goes on."""
    return first_match([
        (method != "POST", "method-not-allowed"),
        ((F.coalesce(origin, F.lit("")) != "") & (origin != own_origin), "cross-origin"),
        (~F.contains(F.coalesce(content_type, F.lit("")), F.lit("application/json")), "bad-content-type")])


def verdict() -> Column:
    """recorded, or the first rule that fails. A filled honeypot is answered as fine and not recorded."""
    def field(name: str):
        return F.trim(F.coalesce(name, F.lit("")))

    def too_long(name: str):
        return F.length(field(name)) > LIMITS[name]
    return first_match([
        (field("company") != "", "ok-not-recorded"),
        (~field("email").rlike(EMAIL) | too_long("email"), "bad-email"),
        ((field("profession") == "") | too_long("profession"), "bad-profession"),
        (too_long("spends_too_long"), "bad-spends-too-long"),
        (too_long("cadence"), "bad-cadence")], "recorded")


def cleaned(submissions: DataFrame) -> DataFrame:
    """Accepted rows as stored: lower-cased address, NULL (not blank) for what was left out."""
    d = submissions.where(verdict() == "recorded")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return d.select("event_id", F.lower(F.trim("email")).alias("email"), F.trim("profession").alias("profession"),
                    blank("spends_too_long").alias("spends_too_long"), blank("cadence").alias("cadence"), "at")


def latest_answers(rows: DataFrame) -> DataFrame:
    """Last submission per address replaces all columns, later NULLs included."""
    last = F.max_by(F.struct("profession", "spends_too_long", "cadence", "at"), F.struct("at", "event_id"))
    return rows.groupBy("email").agg(last.alias("_l")).select("email", "_l.*")


def people_per_profession(people: DataFrame) -> DataFrame:
    return people.groupBy("profession").agg(F.count("*").alias("people"))
