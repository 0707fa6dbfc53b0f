"""Reading verdicts, risks and confidences out of model responses (STR-13..17, FLT-18, AGG-19)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cograph.functions import constants as C
from cograph.functions.text import strip

SORTS = ("MALWARE", "BENIGN")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def _named(text: Column) -> Column:
    """The verdict a text names; the positive one first."""
    return F.when(text.contains(SORTS[0]), SORTS[0]).when(text.contains(SORTS[1]), SORTS[1])


def marked_verdict(text: Column) -> Column:
    """Behind a "Prediction:" mark, or on one of the two lines below if nothing stands there."""
    lines = F.transform(lines_of(text), lambda x: strip(F.regexp_replace(strip(x), r"^\*+|\*+$", "")))

    def read(line: Column, i: Column) -> Column:
        here = F.when(line.contains(":"), strip(F.regexp_replace(line, r"^[^:]*:", ""))).otherwise("")
        below = F.get(F.filter(F.slice(lines, i + 2, 2), lambda x: x != ""), F.lit(0))
        mark = F.upper(line).startswith("FINAL PREDICTION") | F.upper(line).startswith("PREDICTION")
        return F.when(mark, _named(F.upper(F.when(here != "", here).otherwise(F.coalesce(below, F.lit(""))))))

    return _first(F.transform(lines, read))


def loose_verdict(text: Column) -> Column:
    def read(line: Column) -> Column:
        upper, bare = F.upper(line), F.regexp_replace(F.upper(strip(line)), r"^[* ]+", "")
        told = upper.rlike("PREDICTION|FINAL|VERDICT")
        out = F.lit(None).cast("string")
        for sort in reversed(SORTS):
            out = F.when(bare.startswith(sort), sort).otherwise(out)
        for sort in reversed(SORTS):
            out = F.when(told & upper.contains(sort), sort).otherwise(out)
        return out

    return _first(F.transform(lines_of(text), read))


def said_verdict(text: Column) -> Column:
    upper, out = F.upper(text), F.lit(None).cast("string")
    for sort in SORTS:  # the negative one is looked for first
        said = upper.rlike("(" + "|".join(f"{s} {sort}" for s in C.SAYINGS) + ")")
        out = F.when(said, sort).otherwise(out)
    return out


def signal_count(text: Column) -> Column:
    upper = F.upper(F.coalesce(text, F.lit("")))
    return sum((upper.contains(s).cast("int") for s in C.SIGNALS), F.lit(0))


def final_verdict(text: Column) -> Column:
    """Mark, loose line, phrase, then at least two signal words; else the negative verdict."""
    counted = F.when(signal_count(text) >= 2, SORTS[0]).otherwise(SORTS[1])
    return F.coalesce(marked_verdict(text), loose_verdict(text), said_verdict(text), counted)


def log_verdict(text: Column) -> Column:
    """The two rules for analysis logs."""

    def says(line: Column) -> Column:
        upper = F.upper(strip(line))
        return (upper.contains("MALWARE") & upper.rlike("PREDICTION|FINAL")) | F.regexp_replace(upper, r"^[* ]+", "").startswith("MALWARE")

    return F.when(F.exists(lines_of(text), says), SORTS[0]).otherwise(SORTS[1])


def confidence(text: Column, verdict: Column) -> Column:
    found = _first(F.transform(lines_of(text), lambda x: F.when(F.upper(strip(x)).startswith("CONFIDENCE:"), F.upper(strip(F.regexp_replace(strip(x), r"^[^:]*:", ""))))))
    return F.coalesce(found, F.when(verdict == SORTS[0], "MEDIUM").otherwise("UNKNOWN"))


def risk(text: Column, tier: int = 1) -> Column:
    """The level on the first risk line; the first tier calls critical high."""
    mark = "RISK_ASSESSMENT:" if tier == 1 else "RISK_LEVEL:"
    line = F.get(F.filter(F.transform(lines_of(text), F.upper), lambda x: x.contains(mark) | x.contains("RISK:")), F.lit(0))
    top = F.when(line.rlike("HIGH|CRITICAL"), "HIGH") if tier == 1 else F.when(line.contains("CRITICAL"), "CRITICAL").when(line.contains("HIGH"), "HIGH")
    return F.coalesce(top.when(line.contains("MEDIUM"), "MEDIUM").when(line.contains("LOW"), "LOW"), F.lit("UNKNOWN"))


def sanity(text: Column, api: Column) -> Column:
    """"OK", or why a first-tier answer is not accepted."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = low.contains(F.lower(F.substring_index(api, ".", -1))) | low.contains(F.lower(api))
    return (
        F.when(F.length(strip(low)) < 100, "too short").when(~named, "API not mentioned").when(~low.rlike("risk|behavior|behaviour|data_flow"), "no risk or behaviour").otherwise("OK")
    )


def consistency(text: Column) -> Column:
    """struct(consistent, reason) of a verification answer."""
    bad = F.upper(F.coalesce(text, F.lit(""))).contains("INCONSISTENT")
    why = _first(F.transform(lines_of(text), lambda x: F.when(F.upper(strip(x)).startswith("REASON:"), strip(F.regexp_replace(strip(x), r"^[^:]*:", "")))))
    return F.struct((~bad).alias("consistent"), F.when(bad, F.coalesce(why, F.lit("Consistency check failed"))).otherwise("OK").alias("reason"))
