"""URL filters: fixed host and path rules, and association rules over URL tokens mined by FP-growth.

The fixed rules judge what they fit, the longest first. For the other URLs, FP-growth mines combinations of URL tokens
(scheme, all host suffixes, the words of the host, all path segments, all parameter names, a mark for fragments) from the URLs that carry a label; a rule "tokens imply label" is kept if it has enough support and
confidence and no rule with part of its tokens is as sure. Rules are found for a URL through an inverted index by
their rarest token. The surest rule decides; URLs that no rule fits are allowed.

Labels are an input of `filter_urls` (url, label). The query has no table of them: `labels` is about documents, and the
fixed rules' own verdicts would teach nothing but themselves. So it takes weak labels from a lexicon: a page is
labelled `block` if a word of its host is one of UNWANTED, else `allow`. Pages that a fixed rule fits do not train.

A URL counts whole, in mining and in matching: no token of a row is left out that could be in a rule. Each frequent
token's conditional base (what stands before it in the rows, commoner tokens first, equal ones counted together) is
gathered by Spark and grown in one task. Patterns that cannot end in a kept rule are not grown: those with fewer than SUPPORT
(and LEAST) rows of a label, those that no row disagrees with, and those with a token that takes no disagreeing row
away; of tokens that always stand together one stands for all. The rules are the same as from all itemsets. How many patterns
are left depends on the data: many frequent tokens in one row that come and go freely take long.

Defined cases: a null URL, or one without "://", has an empty host and path, no tokens and the default verdict;
repeated rows stay; an empty table gives no rows; without labelled URLs there are no mined rules; labels other than
allow and block are passed over.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cograph.llm.common import ascii_lower, mapped, remove, table, written

SUPPORT, LEAST, CONFIDENCE, DEFAULT = 0.004, 5, 0.9, "allow"
VERDICTS, BROADCAST_ROWS = ("allow", "block"), 100_000

#: The lexicon of the query's weak labels: words of hosts that training data should not come from.
UNWANTED = (
    "ad", "ads", "adult", "bet", "bets", "betting", "casino", "escort", "escorts", "gambling", "jackpot", "lottery",
    "malware", "nude", "phishing", "pill", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx",
)


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed by the contract.
BASE = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, value, rules=BASE) -> Column:
    """value(rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def host_words(host: Column) -> Column:
    return F.filter(F.split(host, r"[^a-z]+"), lambda x: x != "")


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL; numbers in path segments are all 0."""
    none = F.array().cast("array<string>")
    labels = F.reverse(F.split(host, r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.lit("h:"), F.array_join(F.reverse(F.slice(labels, 1, n)), ".")))
    words = F.transform(host_words(host), lambda x: F.concat(F.lit("w:"), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), F.regexp_replace(x, "[0-9]+", "0")))
    names = F.transform(F.regexp_extract_all(F.split(url, "#")[0], F.lit(r"[?&]([^=&]+)="), F.lit(1)), lambda x: F.concat(F.lit("a:"), x))
    scheme = F.array(F.concat(F.lit("s:"), F.split(url, "://")[0]))
    marks = F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(none)
    found = F.array_distinct(F.concat(scheme, suffixes, words, segments, names, marks))
    return F.when(F.contains(url, F.lit("://")), found).otherwise(none)


class MinedRule(NamedTuple):
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float


def transactions(labelled: DataFrame, least: int) -> tuple[DataFrame, list[str]]:
    """(items, allow, block) of the rows (tokens, label): their frequent tokens, all of them, as places in the list
    that is returned too, and how many rows of each label have exactly these. The commonest item is 0.

    An item stands in `least` rows of one label or more; else it is in no rule. Tokens in the same rows (by number and
    by two sums over the rows' hashes) are one item, named by the smallest.
    """
    spark = labelled.sparkSession
    rows = labelled.select("tokens", "label", F.xxhash64("tokens", "label", F.monotonically_increasing_id()).alias("row"))
    rows, path = written(rows, "url-rows")
    each = rows.select("row", "label", F.explode("tokens").alias("token"))
    fold = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(1 << 40)))
    counts = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "block").alias("b"), fold(1).alias("x"), fold(2).alias("y"))
    one = counts.filter(F.greatest(F.col("b"), F.col("n") - F.col("b")) >= least).groupBy("n", "b", "x", "y").agg(F.min("token").alias("token"))
    # At most 2 * (tokens a row) / support items.
    names = [r.token for r in one.orderBy(F.desc("n"), "token").collect()]
    places = spark.createDataFrame(list(enumerate(names)), "item int, token string")
    found = each.join(F.broadcast(places) if len(names) <= BROADCAST_ROWS else places, "token").groupBy("row", "label").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found, _ = written(found.groupBy("items").agg(*(F.count_if(F.col("label") == v).alias(v) for v in VERDICTS)), "url-items")
    remove(spark, path)
    return found, names


def _grown(item: int, flat: np.ndarray, edges: np.ndarray, weights: np.ndarray, least: int, confidence: float):
    """(items, verdict, agreeing rows, rows) of the rules whose rarest item is `item`, from its conditional base.

    Row i of the base has the commoner items flat[edges[i] : edges[i + 1]], ascending, and weights[i] rows of each
    label. Patterns grow by ever commoner items, smaller items first, so what a pattern is less one item comes before.
    A pattern is left, with all that would grow from it, where no longer rule can be better than its parts: too few
    rows agree, none disagrees any more, or one item takes no disagreeing row away.
    """
    total = weights.sum(axis=0).tolist()
    grows, sure = [], [0.0, 0.0]
    for v in (0, 1):
        grows.append(total[v] >= least and total[1 - v] > 0)
        if total[v] >= least and (rate := total[v] / sum(total)) >= confidence:
            sure[v] = rate
            yield (item,), v, total[v], sum(total)
    known = {(item,): (grows, total, sure)}

    def children(items, rows):
        size = edges[rows + 1] - edges[rows]
        row = np.repeat(rows, size)
        at = np.arange(len(row)) + np.repeat(edges[rows] - (np.cumsum(size) - size), size)
        below = flat[at] < items[-1]
        token, row = flat[at[below]], row[below]
        order = np.argsort(token, kind="stable")
        token, row = token[order], row[order]
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else token
        agree = np.add.reduceat(weights[row], begin, axis=0) if len(token) else weights[:0]
        stop = np.append(begin[1:], len(token))
        for k in np.flatnonzero(agree.max(axis=1, initial=0) >= least).tolist():
            mine = (*items, int(token[begin[k]]))
            parts = [known.get(mine[:i] + mine[i + 1 :]) for i in range(1, len(mine))]
            if None in parts:
                continue
            n, grows, sure, rules = agree[k].tolist(), [False, False], [1.0, 1.0], []
            for v in (0, 1):
                if n[v] >= least and all(p[0][v] and n[1 - v] < p[1][1 - v] for p in parts):
                    rate, before = n[v] / sum(n), max(p[2][v] for p in parts)
                    grows[v], sure[v] = n[1 - v] > 0, max(before, rate if rate >= confidence else 0.0)
                    if rate >= confidence and rate > before:
                        rules.append((mine, v, n[v], sum(n)))
            if any(grows):
                known[mine] = grows, n, sure
            yield rules, mine, row[begin[k] : stop[k]] if any(grows) else None

    open_ = [children((item,), np.arange(len(weights)))] if any(grows) else []
    while open_:
        found = next(open_[-1], None)
        if found is None:
            open_.pop()
            continue
        yield from found[0]
        if found[2] is not None:
            open_.append(children(*found[1:]))


def _grower(least: int, confidence: float):
    def run(base: pa.Table) -> pa.Table:
        lists = base.column("before").combine_chunks()
        flat, edges = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        weights = np.stack([base.column(v).to_numpy() for v in VERDICTS], axis=1)
        found = list(_grown(base.column("item")[0].as_py(), flat, edges, weights, least, confidence))
        return pa.table([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64()))], names=["items", "verdict", "agree", "n"])

    return run


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> list[MinedRule]:
    """Pruned rules from rows (tokens, label): each frequent item's conditional base is a task's work."""
    labelled = labelled.filter(F.col("label").isin(*VERDICTS) & (F.size("tokens") > 0))
    n = labelled.count()
    if n < least:
        return []
    least = max(least, math.ceil(support * n))
    rows, names = transactions(labelled, least)
    each = rows.select(F.posexplode("items").alias("place", "item"), "items", *VERDICTS)
    bases = each.groupBy("item", F.slice("items", F.lit(1), F.col("place")).alias("before")).agg(*(F.sum(v).alias(v) for v in VERDICTS))
    found = bases.groupBy("item").applyInArrow(_grower(least, confidence), "items array<int>, verdict int, agree long, n long").collect()
    return pruned([MinedRule(tuple(sorted(names[i] for i in r["items"])), VERDICTS[r["verdict"]], r["agree"] / r["n"], r["agree"] / n) for r in found])


def pruned(rules: list[MinedRule]) -> list[MinedRule]:
    """Without rules that say what one with part of their tokens says as surely: shorter ones first, through the index."""
    index, kept = RuleIndex(rules, filled=False), []
    for rule in sorted(rules, key=lambda r: (len(r.tokens), r.tokens, r.verdict)):
        if not any(r.verdict == rule.verdict and r.confidence >= rule.confidence for r in index.within(rule.tokens)):
            index.add(rule)
            kept.append(rule)
    return kept


class RuleIndex:
    """An inverted index: each rule stands under the token that the fewest rules hold."""

    def __init__(self, rules: list[MinedRule], filled: bool = True):
        self.counts: dict[str, int] = {}
        for r in rules:
            for t in r.tokens:
                self.counts[t] = self.counts.get(t, 0) + 1
        self.under: dict[str, list[MinedRule]] = {}
        for r in rules if filled else ():
            self.add(r)

    def add(self, rule: MinedRule) -> None:
        self.under.setdefault(min(rule.tokens, key=lambda t: (self.counts[t], t)), []).append(rule)

    def within(self, tokens) -> list[MinedRule]:
        """The rules whose tokens are all among `tokens`."""
        have = set(tokens)
        return [r for t in have for r in self.under.get(t, ()) if have.issuperset(r.tokens)]

    def best(self, tokens: list[str]) -> MinedRule | None:
        return min(self.within(tokens), key=lambda r: (-r.confidence, -r.support, r.tokens, r.verdict), default=None)


def _matcher(rules: list[MinedRule]):
    def run(batches):
        index = RuleIndex(rules)
        for batch in batches:
            hits = [index.best(tokens or ()) for tokens in batch.column("tokens").to_pylist()]
            found = [pa.array([h.verdict if h else DEFAULT for h in hits], pa.string()), pa.array([" ".join(h.tokens) if h else None for h in hits], pa.string()), pa.array([h.confidence if h else None for h in hits], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)] + found, names=[*batch.schema.names[:-1], "mined", "mined_rule", "confidence"])

    return run


def lexicon_labels(urls: DataFrame, words=UNWANTED) -> DataFrame:
    """url and its weak label, for each of `urls` (url) that has a host."""
    bad = F.arrays_overlap(host_words(host_of(F.col("url"))), F.array(*map(F.lit, words)))
    return urls.filter(F.contains("url", F.lit("://"))).select("url", F.when(bad, "block").otherwise("allow").alias("label"))


def filter_urls(pages: DataFrame, labelled: DataFrame, rules=BASE, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule and confidence for each row of `pages` (page_id, url).

    labelled: url and label (allow or block), from which rules are mined; those that a fixed rule fits are passed over.
    """
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    parted = lambda df, *columns: df.select(*columns, host_of(url).alias("host"), path_of(url).alias("path"))
    known = parted(labelled.select("url", "label"), "url", "label").filter(fitting(host, path, lambda r: r.name, rules).isNull())
    mined = mine(known.select(tokens_of(url, host, path).alias("tokens"), "label"), support, confidence)
    seen = parted(pages.select("page_id", "url"), "page_id", "url").select("page_id", "host", "path", fitting(host, path, lambda r: r.name, rules).alias("rule"), fitting(host, path, lambda r: r.verdict, rules).alias("ruled"), tokens_of(url, host, path).alias("tokens"))
    judged = seen.transform(mapped(_matcher(mined), "page_id long, host string, path string, rule string, ruled string, mined string, mined_rule string, confidence double"))
    own = F.col("ruled").isNull()
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", "mined").alias("verdict"), F.when(own, F.col("mined_rule")).alias("mined_rule"), F.when(own, F.col("confidence")).alias("confidence"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, lexicon_labels(pages))
