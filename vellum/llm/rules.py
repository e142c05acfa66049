"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule says which rows it rejects. On a sample, the operator times every rule and counts what it rejects, then
orders the rules by rejection per cost. The cascade is one CASE expression in that order: a row that an early rule
rejects never evaluates a later one. The verdict is a conjunction, so the order moves time, never results.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import WORD


def words(text: Column) -> Column:
    """Words in order. White space becomes spaces first: splitting at one character needs no regular expression."""
    t = F.coalesce(text, F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(t, " ", -1), "")


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(words(text), "")).cast("long")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[#*$%&|<>]")).cast("long")


def word_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = word_lines(text)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def with_repeat_words(df: DataFrame, words_column: str, out: str, window: int = 5) -> DataFrame:
    """Adds the number of words that lie in windows of so many words found twice or more in the array of words.

    Words become 64-bit hashes and windows hashes of those; a text whose window hashes are all different (most texts)
    ends there. Otherwise the hashes are sorted with their places, equal neighbours give the places of repeated
    windows, and each covers what the next does not. All of it is linear or a sort in the length of the text.
    """
    kept = df.columns
    df = df.withColumn("_w", F.transform(words_column, lambda w: F.xxhash64(w)))
    at = lambda i: F.get(F.col("_w"), i)
    hashes = F.transform("_w", lambda w, i: F.xxhash64(w, *[at(i + j) for j in range(1, window)]))
    df = df.withColumn("_h", F.when(F.size("_w") > window, hashes))
    df = df.withColumn("_h", F.slice("_h", F.lit(1), F.size("_h") - (window - 1)))
    df = df.withColumn("_n", F.size(F.array_distinct("_h")))
    placed = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_s", F.when(F.col("_n") < F.size("_h"), F.sort_array(placed)))
    hash_at = lambda i: F.get(F.col("_s"), i)["h"]
    twice = F.filter("_s", lambda x, i: hash_at(i - 1).eqNullSafe(x["h"]) | hash_at(i + 1).eqNullSafe(x["h"]))
    df = df.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    own = F.transform("_p", lambda x, k: F.least(F.lit(window), F.coalesce(F.get(F.col("_p"), k + 1) - x, F.lit(window))))
    covered = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias(out))


@dataclass(frozen=True)
class Rule:
    """name; rejects: a condition on the columns of the documents and those that `features` adds."""

    name: str
    rejects: Column


def default_rules(text: str = "text", **known: str) -> list[Rule]:
    """Bounds that only junk passes: symbols, word shapes, repeated lines, shouting, text without letters.

    known: names of columns that hold n_words, word_chars, n_symbols, n_dup_lines or n_lines already; a rule computes
    what is not known from the text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    of = lambda name, f: F.col(known[name]) if name in known else f(F.col(text))
    n = of("n_words", n_words)
    chars = of("word_chars", word_chars)
    upper, lower = F.regexp_count(t, F.lit("[A-Z]")), F.regexp_count(t, F.lit("[a-z]"))
    return [
        Rule("symbols", of("n_symbols", n_symbols) * 10 > n),
        Rule("word_length", (chars < 2 * n) | (chars > 20 * n)),
        Rule("dup_lines", of("n_dup_lines", n_dup_lines) * 10 > of("n_lines", lambda c: F.size(word_lines(c))) * 3),
        Rule("shouting", upper > lower),
        Rule("no_letters", ~t.rlike(r"\p{L}")),
    ]


def measured(df: DataFrame, rules: list[Rule], rows: int = 500, prepare: Callable[[DataFrame], DataFrame] | None = None) -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected) of each rule over a random sample of about `rows` rows: the estimate behind the order.

    prepare adds what the rules read, to the sampled rows alone, so each rule is timed as the cascade runs it. The sample
    decides the order alone; rows is a documented bound on the cost of the estimate.
    """
    share = min(1.0, rows / max(df.count(), 1))
    few = df.sample(fraction=share, seed=11)
    few = (few if prepare is None else prepare(few)).cache()
    total = max(few.count(), 1)
    out = []
    for rule in rules:
        began = time.perf_counter()
        hit = few.agg(F.sum(F.coalesce(rule.rejects, F.lit(False)).cast("long"))).first()[0] or 0
        out.append((rule.name, time.perf_counter() - began, hit / total))
    few.unpersist()
    return out


def order(estimates: list[tuple[str, float, float]]) -> list[str]:
    """Most rejection per cost first; ties by name."""
    return [name for name, cost, share in sorted(estimates, key=lambda e: (-e[2] / max(e[1], 1e-6), e[0]))]


def cascade(df: DataFrame, rules: list[Rule], names: list[str], reject_if: Column | None = None) -> DataFrame:
    """df with rejected_by string (the first rule, in the order of names, that rejects; else null) and kept boolean.

    reject_if: a condition that is known already and comes first, as rule `base`. A rule whose condition is null
    does not reject.
    """
    by = {r.name: r.rejects for r in rules}
    branches = [(reject_if, "base")] * (reject_if is not None) + [(by[name], name) for name in names]
    verdict = F.when(branches[0][0], F.lit(branches[0][1]))
    for condition, name in branches[1:]:
        verdict = verdict.when(condition, F.lit(name))
    return df.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())


KNOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines")


def with_counts(docs: DataFrame) -> DataFrame:
    """docs(text) with the columns KNOWN and _words, the words in order."""
    df = docs.withColumn("_words", words(F.col("text"))).withColumn("_lines", word_lines(F.col("text")))
    counts = {
        "n_words": F.size("_words"), "word_chars": F.length(F.array_join("_words", "")), "n_symbols": n_symbols(F.col("text")),
        "n_lines": F.size("_lines"), "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
    }
    return df.withColumns({k: c.cast("long") for k, c in counts.items()}).drop("_lines")


def quality(docs: DataFrame, sample_rows: int = 500) -> DataFrame:
    """Base counts and the verdict for each row of docs(doc_id, text); extra columns are left out.

    Null text counts as empty and has no words; base fails below 10 words, or where over a fifth of the words lie in
    repeated windows. Equal rows get equal results. An empty table gives an empty result. Rules are measured as they run:
    over counts that are there already.
    """
    docs = docs.select("doc_id", "text")
    rules = default_rules(**{k: k for k in KNOWN})
    names = order(measured(docs, rules, sample_rows, lambda few: with_counts(few).drop("_words")))
    df = with_repeat_words(with_counts(docs), "_words", "n_repeat_words").drop("_words")
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    df = cascade(df, rules, names, reject_if=F.col("base_failed"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
