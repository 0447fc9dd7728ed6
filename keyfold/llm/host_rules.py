"""Quality rules by host.

Every text gets the counts of a handful of rules. The share of texts that fail is gathered by host and shrunk towards
the rate of all hosts with a beta prior fitted to them, so that a host with few texts isn't judged by those alone. A
host is blocked when its shrunk rate is over a limit; its verdict goes back to its documents.

Only DataFrame functions run here. Texts are never shuffled: rules are columns of a scan, hosts are sums with partial
aggregation (a host with a third of all rows is a single row from each task), and verdicts come back by a join with
the table of hosts, broadcast only up to a checked number of rows.

Defined results: a null text has no words, so it fails; a null source is a host of its own; a text of one very long
line or word is a row like others; repeated rows are judged, and counted for their host, each; an empty table gives an
empty result. Names of further columns can't clash, as only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import SPACE_CLASS, WORD_CLASS, join_small, let, materialise

WINDOW = 8


@dataclass(frozen=True)
class HostLimits:
    """min_words and max_repeat_percent: the base rules. max_symbols and max_dup_lines: further rules, as shares of
    the words and of the lines. max_rate: the shrunk share of failures from which a host is blocked. least_weight and
    most_weight: bounds of the prior's weight in documents."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbols: float = 0.5
    max_dup_lines: float = 0.5
    max_rate: float = 0.5
    least_weight: float = 2.0
    most_weight: float = 1000.0


def _covered(words: Column, n: Column) -> Column:
    """Words in windows that occur more than once, compared as full strings."""
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("s"), i.alias("i")))

    def starts(sorted_windows: Column) -> Column:
        same = lambda a, b: sorted_windows[a]["s"] == sorted_windows[b]["s"]
        last = F.size(sorted_windows) - 1
        repeated = F.filter(
            F.sequence(F.lit(0), last),
            lambda k: F.when(k > 0, same(k - 1, k)).otherwise(F.lit(False)) | F.when(k < last, same(k, k + 1)).otherwise(F.lit(False)),
        )
        return F.array_sort(F.transform(repeated, lambda k: sorted_windows[k]["i"]))

    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    add = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"))
    return let(F.array_sort(windows), lambda w: F.aggregate(starts(w), zero, add, lambda acc: acc["n"]))


def _repeat_words(words: Column, n: Column) -> Column:
    """Hashes of windows tell most texts apart from those with a repeated window; only the latter compare strings."""
    hashed = lambda h: F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(h[i + k] for k in range(WINDOW))))
    suspect = let(let(F.transform(words, lambda w: F.xxhash64(w)), hashed), lambda x: F.size(F.array_distinct(x)) < F.size(x))
    return F.when(n <= WINDOW, F.lit(0)).when(suspect, _covered(words, n)).otherwise(F.lit(0))


def rule_counts(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words, all long."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS))

    def counts(words: Column) -> Column:
        n = F.size(words)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(words, n).cast("long").alias("n_repeat_words"),
        )

    return let(F.array_remove(F.split(text, SPACE_CLASS + "+"), ""), counts)


def host_of(source: Column) -> Column:
    """The host of an address, else the source's name itself."""
    host = F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    return F.when(host != "", F.lower(host)).otherwise(source)


def with_rules(docs: DataFrame, limits: HostLimits, text: str = "text", source: str = "source") -> DataFrame:
    """docs with _host, the counts as struct _rules, _base_failed and _failed (of any rule)."""
    r = lambda name: F.col("_rules")[name]
    base = (r("n_words") < limits.min_words) | (100 * r("n_repeat_words") > limits.max_repeat_percent * r("n_words"))
    further = (r("n_symbols") > limits.max_symbols * r("n_words")) | (r("lines")["dup"] > limits.max_dup_lines * r("lines")["n"])
    return docs.withColumn("_rules", rule_counts(F.col(text))).withColumns({"_host": host_of(F.col(source)), "_base_failed": base, "_failed": base | further})


def host_verdicts(judged: DataFrame, limits: HostLimits) -> DataFrame:
    """From rows with _host and _failed: a materialised row per host with n_docs, n_failed, rate and blocked."""
    hosts = materialise(judged.groupBy("_host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("_failed").cast("long")).alias("n_failed")), "hosts")
    share = F.col("n_failed") / F.col("n_docs")
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("bad"), F.var_samp(share).alias("var"), F.avg(1 / F.col("n_docs")).alias("inv")).first()
    a, b = beta_prior(total["n"], total["bad"], total["var"], total["inv"], limits)
    rate = (F.col("n_failed") + a) / (F.col("n_docs") + a + b)
    return hosts.withColumn("rate", rate).withColumn("blocked", F.col("rate") > limits.max_rate)


def beta_prior(n: int | None, bad: int | None, var: float | None, inv: float | None, limits: HostLimits) -> tuple[float, float]:
    """Alpha and beta by the method of moments: what the hosts' rates spread beyond the spread of counting alone."""
    if not n:
        return limits.least_weight / 2, limits.least_weight / 2
    mean = (bad + 0.5) / (n + 1.0)
    noise = mean * (1 - mean)
    between = (var or 0.0) - noise * inv
    weight = limits.most_weight if between <= 0 else min(limits.most_weight, max(limits.least_weight, noise / between - 1))
    return mean * weight, (1 - mean) * weight


def host_quality(docs: DataFrame, limits: HostLimits = HostLimits(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of docs: the id, the counts, base_failed, host, host_rate and kept."""
    rows = with_rules(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source")), limits)
    judged = materialise(rows.select("doc_id", "_host", "_rules", "_base_failed", "_failed"), "rules")
    verdicts = host_verdicts(judged, limits).select(F.struct("_host").alias("_key"), "rate", "blocked")
    out = join_small(judged.withColumn("_key", F.struct("_host")), verdicts, ["_key"])
    r = lambda name: F.col("_rules")[name].alias(name)
    return out.select(
        "doc_id", r("n_words"), r("word_chars"), r("n_symbols"), F.col("_rules")["lines"]["dup"].alias("n_dup_lines"), r("n_repeat_words"),
        F.col("_base_failed").alias("base_failed"), (~F.col("_base_failed") & ~F.col("blocked")).alias("kept"),
        F.col("_host").alias("host"), F.col("rate").alias("host_rate"),
    )


def keep_good(docs: DataFrame, limits: HostLimits = HostLimits()) -> DataFrame:
    """The rows of docs whose text passes the base rules and whose host isn't blocked, with their own columns only.

    Rules are computed once: rows that pass the base rules are written with their host, those that don't without
    their columns, as they only count for their host.
    """
    columns = docs.columns
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), F.col("text").alias("text"), F.col("source").alias("source"))
    rows = with_rules(plain, limits).select(F.when(~F.col("_base_failed"), F.col("_row")).alias("_row"), "_host", "_base_failed", "_failed")
    judged = materialise(rows, "judged")
    blocked = materialise(host_verdicts(judged, limits).filter("blocked").select(F.struct("_host").alias("_key")), "blocked")
    good = judged.filter("not _base_failed").withColumn("_key", F.struct("_host")).select("_row", "_key")
    return join_small(good, blocked, ["_key"], "left_anti").select("_row.*")
