import re

from helpers import awkward, frame
from pyspark.sql import functions as F

from vellum.llm import rules


def counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_base_counts_and_verdicts(spark):
    rows = awkward() + [(200, "a\nb c\na\n\n \nb c\nb c", "en", "a"), (201, "p q r s t u p q r s t v w x y z a b c d e f g h", "en", "a"), (202, "SHOUT " * 3 + "LOUD AND CLEAR THE WHOLE DAY LONG HERE", "en", "a")]
    got = rules.quality(frame(spark, rows)).collect()
    expected = sorted((str(r[0]), *counts(r[1])) for r in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == expected
    by = {r.doc_id: r for r in got}
    assert all(r.kept == (r.rejected_by is None) and not (r.kept and r.base_failed) for r in got)
    assert by[1].kept and by[10].kept and by[13].kept and not by[16].kept and not by[202].kept and by[202].rejected_by == "shouting"


def test_order_moves_no_verdict(spark):
    docs = frame(spark).select("doc_id", "text")
    own = rules.default_rules()
    names = [r.name for r in own]
    a, b = (rules.cascade(docs, own, x).orderBy("doc_id", "text").collect() for x in (names, names[::-1]))
    assert [r.kept for r in a] == [r.kept for r in b]


def test_order_is_rejection_per_cost():
    assert rules.order([("slow", 10.0, 0.5), ("none", 0.1, 0.0), ("fast", 1.0, 0.4)]) == ["fast", "slow", "none"]


def test_plan_has_no_python(spark):
    plan = rules.quality(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_empty_table_and_null_conditions(spark):
    assert rules.quality(frame(spark, [])).count() == 0
    docs = frame(spark).select("doc_id", "text")
    assert rules.cascade(docs, [rules.Rule("null", F.lit(None).cast("boolean"))], ["null"]).where("not kept").count() == 0


def test_rules_are_measured_over_counts_of_the_sample(spark):
    docs = frame(spark).select("doc_id", "text")
    ready = rules.default_rules(**{k: k for k in rules.KNOWN})
    n = docs.count()
    got = {name: (seconds, share) for name, seconds, share in rules.measured(docs, ready, 10 * n, rules.with_counts)}
    from_text = {name: share for name, _, share in rules.measured(docs, rules.default_rules(), 10 * n)}
    assert {k: v[1] for k, v in got.items()} == from_text and all(s > 0 for s, _ in got.values())
