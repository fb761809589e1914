"""Sentences as the run log counts them: abbreviations, initials and list numbers don't end one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosemill.functions.text import let, stripped

# fixed values: abbreviations after which a full stop ends no sentence
ABBREVIATIONS = (
    "mr mrs ms dr prof rev hon st jr sr mt vs etc est approx dept univ inc ltd co corp fig no nos vol pp ed eds al cf ca min max "
    "jan feb mar apr jun jul aug sep sept oct nov dec mon tue tues wed thu thur thurs fri sat sun"
).split()
#: Those that end a sentence where a capital follows.
FINAL = ("a.m", "p.m", "etc")
_CUT = "\x01"
_PIECE = r"(?s)(?:(?!\x01).)+"


def log_sentences(text: Column) -> Column:
    """Cut after .!? and an optional closing quote or bracket, before white space and a capital,
    digit or opening quote, unless the full stop belongs to the word before it."""
    marked = F.regexp_replace(stripped(text), r"([.!?]+[\"'’”)\]]?)\s+(?=[\"'‘“(\[]?[A-Z0-9])", f"$1{_CUT}")
    pieces = F.regexp_extract_all(marked, F.lit(_PIECE), F.lit(0))

    def ends(piece: Column, after: Column) -> Column:
        mark = F.regexp_extract(piece, r"[.!?]+[\"'’”)\]]?$", 0)
        token = F.regexp_extract(F.regexp_replace(piece, r"[.!?]+[\"'’”)\]]?$", ""), r"[A-Za-z0-9'’.]+$", 0)
        bare = F.lower(F.regexp_replace(token, r"\.+$", ""))
        final = bare.isin(*FINAL) & after.rlike("^[A-Z]")
        return (
            F.when(mark.rlike("[!?]") | (token == ""), True).when(token.rlike(r"^(?:[A-Za-z]\.)+[A-Za-z]$"), final)
            .when(token.rlike(r"^[A-Za-z]$") | token.rlike(r"^\d+$"), False).when(~bare.isin(*ABBREVIATIONS), True).otherwise(final)
        )

    def joined(p: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
        at = F.sequence(F.lit(0), F.size(p) - 1)

        def step(s: Column, i: Column) -> Column:
            grown = F.when(s["open"] == "", F.get(p, i)).otherwise(F.concat(s["open"], F.lit(" "), F.get(p, i)))
            close = (i == F.size(p) - 1) | ends(grown, F.coalesce(F.get(p, i + 1), F.lit("")))
            return let(grown, lambda g: F.struct(F.when(close, F.concat(s["done"], F.array(g))).otherwise(s["done"]).alias("done"), F.when(close, F.lit("")).otherwise(g).alias("open")))

        return F.when(F.size(p) > 0, F.aggregate(at, start, step, lambda s: s["done"])).otherwise(F.array().cast("array<string>"))

    return let(pieces, joined)
