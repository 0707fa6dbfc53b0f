"""Scalar expressions over keys, labels, names and texts (PRJ-*, FLT predicates, STR-*)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cograph.functions import constants as C


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def either(words: Iterable[str]) -> str:
    """A pattern that finds any of `words` literally, in both Java's and RE2's dialect."""
    return "(" + "|".join(re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", w) for w in words) + ")"


def normal_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def verdict(label: Column, positive: str = "MALWARE", negative: str = "BENIGN") -> Column:
    """Positive for exactly 1, negative for everything else, null and NaN included."""
    return F.when(label == 1.0, positive).otherwise(negative)


def verdict_or_null(label: Column, positive: str = "MALWARE", negative: str = "BENIGN") -> Column:
    return F.when(label == 1.0, positive).when(label == 0.0, negative)


def verdict_with_family(label: Column, family: Column) -> Column:
    return F.when(label == 1.0, F.concat(F.lit("MALWARE (family: "), F.coalesce(F.trim(family), F.lit("nan")), F.lit(")"))).otherwise("BENIGN")


def normal_family(c: Column) -> Column:
    name = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(name.isin("", "nan", "benign"), "unknown").otherwise(name)


def api_type(api: Column, transfer: Iterable[str] = C.TRANSFER_APIS) -> Column:
    return F.when(api.isin(*transfer), "transfer").otherwise("access")


def category(api: Column, categories: dict[str, Iterable[str]] = C.API_CATEGORIES) -> Column:
    out = F.lit("other")
    for name, members in reversed(list(categories.items())):
        out = F.when(F.lower(api).isin(*members), name).otherwise(out)
    return out


def query_priority(api: Column, first: Iterable[str] = C.FIRST_PRIORITY, second: Iterable[str] = C.SECOND_PRIORITY) -> Column:
    low = F.lower(api)
    return F.when(low.rlike(either(first)), 0).when(low.rlike(either(second)), 1).otherwise(2)


def high_risk(api: Column, names: Iterable[str] = C.HIGH_RISK_APIS) -> Column:
    return api.rlike(either(names))


def outside_framework(function: Column, api: Column, prefixes: Iterable[str] = C.FRAMEWORK_PREFIXES, always: Iterable[str] = C.ALWAYS_SENSITIVE) -> Column:
    """Kept by the framework filter: not in a framework package, or calling something always looked at."""
    return ~function.rlike("^" + either(prefixes)) | F.lower(api).rlike(either(always))


def class_of(function: Column) -> Column:
    """What stands before the last dot; the whole name if there is none."""
    return F.regexp_replace(function, r"\.[^.]*$", "")


def simple_name(function: Column) -> Column:
    return F.substring_index(function, ".", -1)


def cut(c: Column, n: int, marker: str = C.TRUNCATED) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(marker))).otherwise(c)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 3).cast("long")


def tokenizer_count(c: Column, path: str) -> Column:
    """Tokens by a tokenizer file that the workers can read; null has none. Arrow batches, the tokenizer loaded once a worker."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        for texts in batches:
            yield pd.Series([len(x.ids) for x in model.encode_batch([t or "" for t in texts], add_special_tokens=False)])

    return count(c)


def log_norm(x: Column, scale: float) -> Column:
    return F.least(F.lit(1.0), F.log1p(x.cast("double")) / F.log1p(F.lit(float(scale))))


def elide(name: Column, most: int = 42, head: int = 20, tail: int = 19) -> Column:
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, head), F.lit("..."), F.right(name, F.lit(tail)))).otherwise(name)


def accuracy_band(percent: Column) -> Column:
    return F.when(percent >= 80, "green").when(percent >= 50, "yellow").otherwise("red")


def error_band(percent: Column) -> Column:
    return F.when(percent <= 5, "green").when(percent <= 20, "yellow").otherwise("red")


def percentage(rate: Column, digits: int = 2) -> Column:
    return F.concat(F.format_number(rate * 100, digits), F.lit("%"))


def bar(share: Column, width: int = 20) -> Column:
    return F.rpad(F.repeat(F.lit("#"), F.round(F.least(F.lit(1.0), share) * width).cast("int")), width, ".")


def numbered(items: Column, label: str, separator: str = "\n\n") -> Column:
    """Items of an array as one text, counted from 1."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit(label), (i + 1).cast("string"), F.lit(": "), x)), separator)


def is_seed(callee_class: Column, callee: Column) -> Column:
    """Whether a call of `callee` on `callee_class` starts a slice."""
    gated = [(C.CONTEXT_NAMES, C.CONTEXT_FRAGMENTS), (C.LOADER_NAMES, C.LOADER_FRAGMENTS), (C.SOCKET_NAMES, C.SOCKET_FRAGMENTS)]
    out = callee.isin(*C.SEED_NAMES)
    for names, fragments in gated:
        out = out | (callee.isin(*names) & callee_class.rlike(either(fragments)))
    return F.coalesce(out, F.lit(False))


def freshness(content: Column, markers: Iterable[str] = C.FRESH_MARKERS, current: int = C.SLICER_VERSION) -> Column:
    """struct(fresh, reason) of a slice file's text."""
    first = strip(F.split(content, "\n")[0])
    version = F.regexp_extract(first, r"SLICER_VERSION:\s*(\d+)", 1).try_cast("int")
    apis = F.transform(F.filter(F.split(content, "\n"), lambda x: x.startswith("SUSPICIOUS_API:")), lambda x: strip(F.regexp_replace(x, r"^[^:]*:", "")))
    marked = F.filter(apis, lambda x: x.isin(*markers))
    row = lambda fresh, reason: F.struct(F.lit(fresh).alias("fresh"), reason.alias("reason"))
    headed = first.startswith(C.VERSION_MARK)
    return (
        F.when(headed & version.isNull(), row(False, F.lit("malformed version header")))
        .when(headed & (version >= current), row(True, F.concat(F.lit("version "), version.cast("string"))))
        .when(headed, row(False, F.concat(F.lit("version "), version.cast("string"), F.lit(f" < {current}"))))
        .when(F.size(marked) > 0, row(True, F.concat(F.lit("marker "), F.get(marked, F.lit(0)))))
        .otherwise(row(False, F.lit("no header, no marker")))
    )


DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """The version 5 UUID of a name, from its SHA-1, without a Python function."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
