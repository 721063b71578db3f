"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a boolean column over a few metrics of the text. A sample tells what each rule costs and how often it
rejects; the rules then run in the order of rejections per cost, and a document leaves at its first failing rule
(``CASE WHEN`` evaluates no branch behind it, so the metrics of later rules are never made for it). The order decides only
the cost and the reported rule, never whether a document is kept.

What a rule costs is the work of its metrics on the mean text of the sample, by the characters, words and lines that each
metric goes through (WORK); metrics that a caller has anyway cost nothing. How often it rejects is counted on what the
rules before it leave. The sample is chosen by a hash of the rows and nothing is timed, so runs agree on the order.

Nulls and ties: null text counts as no words and no lines; rules that reject as much for their cost keep their order; rows
that repeat are judged each; empty tables stay empty; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, fresh

#: Java regular expression of the white space between words.
BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 5
#: About so many rows are looked at.
SAMPLE_ROWS = 1000
METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Nanoseconds, about, for each character, word and line that a metric goes through. Only their proportions matter.
WORK = {
    "n_words": (0, 0, 0), "word_chars": (1, 10, 0), "n_symbols": (10, 0, 0), "n_lines": (0, 0, 0), "n_dup_lines": (0, 0, 100),
    "n_repeat_words": (0, 1000, 0), "n_letter_words": (0, 150, 0), "n_different": (0, 80, 0), "n_cut_lines": (0, 0, 120),
}


def words_of(text: Column) -> Column:
    """The words of a text, [] for null and for white space alone."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BREAK))


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")


def symbols_in(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SYMBOLS, "")).cast("long")


def repeated_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def windows_of(words: Column) -> Column:
    """One hash for each window of five words; ``words`` must be a column, not an expression."""
    at = lambda i, k: F.get(words, i + F.lit(k))
    return F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, and only where the whole is evaluated."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(windows: Column) -> Column:
    """Words that lie in a window found twice or more; ``windows`` must be a column or a variable.

    Windows are sorted with their positions, so equal ones are neighbours; nothing is compared with all others.
    """
    n = F.size(windows)
    pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))
    found = let(pairs, lambda p: F.flatten(F.zip_with(F.slice(p, 1, n - 1), F.slice(p, 2, n - 1), same)))
    covered = F.array_distinct(F.flatten(F.transform(F.array_distinct(found), lambda p: F.sequence(p, p + (WINDOW - 1)))))
    return F.when(F.size(F.array_distinct(windows)) == n, F.lit(0)).otherwise(F.size(covered)).cast("long")


@dataclass(frozen=True)
class Rule:
    """``fails`` makes the predicate from the metrics in ``needs``, which are what the rule costs."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[..., Column]


RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 10),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda n, r: r * 100 > n * 20),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: s * 10 > n * 3),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < n * 2) | (c > n * 16)),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, d: d * 100 > n * 30),
    Rule("few_letters", ("n_words", "n_letter_words"), lambda n, x: x * 100 < n * 60),
    Rule("few_different", ("n_words", "n_different"), lambda n, d: (n >= 30) & (d < 10)),
    Rule("cut_lines", ("n_lines", "n_cut_lines"), lambda n, c: c * 100 > n * 30),
)
#: The rules that the base asks for; the others are this operator's own.
BASE = ("few_words", "repeated_words")


def rejects(rule: Rule, named: dict[str, Column]) -> Column:
    return rule.fails(*[named[n] for n in rule.needs])


def with_arrays(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with arrays of words and lines, and the metrics as expressions over them.

    ``inline`` over an array of one struct changes no row. It keeps Catalyst from moving a filter on a metric below
    the words, where each window would split the text anew.
    """
    words, lines = fresh(docs, "_words"), fresh(docs, "_lines")
    text = F.col(f"`{text_col}`")
    df = docs.select("*", F.inline(F.array(F.struct(words_of(text).alias(words), lines_of(text).alias(lines)))))
    return df, {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": symbols_in(text),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": repeated_lines(F.col(lines)),
        "n_repeat_words": let(windows_of(F.col(words)), repeated_words),
        "n_letter_words": F.size(F.filter(F.col(words), lambda w: w.rlike(r"\p{L}"))).cast("long"),
        "n_different": F.size(F.array_distinct(words)).cast("long"),
        "n_cut_lines": F.size(F.filter(F.col(lines), lambda x: F.rtrim(x, F.lit(WS)).rlike(r"(\.\.\.|…)$"))).cast("long"),
    }


def with_metrics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with arrays and METRICS as columns, and all metrics: these by name, the others as expressions still."""
    df, named = with_arrays(docs, text_col)
    kept = [c for c in df.columns if c.lower() not in METRICS]
    made = df.select(*[F.col(f"`{c}`") for c in kept], *[named[n].alias(n) for n in METRICS])
    return made, named | {n: F.col(n) for n in METRICS}


def metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the METRICS as columns, which replace columns of the same names."""
    df, _ = with_metrics(docs, text_col)
    return df.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in METRICS], *METRICS)


def cascade_order(rules: Sequence[Rule], costs: Sequence[float], rejected: Mapping[tuple[bool, ...], int]) -> list[Rule]:
    """Always the rule next that rejects most rows for its cost of those that are left.

    ``rejected`` has how many rows of the sample have each combination of failed rules.
    """
    left, order = list(range(len(rules))), []
    rows = dict(rejected)
    while left:
        best = max(left, key=lambda i: (sum(n for fails, n in rows.items() if fails[i]) / max(costs[i], 1e-4), -i))
        order.append(rules[best])
        left.remove(best)
        rows = {fails: n for fails, n in rows.items() if not fails[best]}
    return order


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, free: Sequence[str] = ()) -> list[Rule]:
    """Order ``rules`` by rejections for their cost on about ``sample_rows`` rows; metrics in ``free`` are there anyway."""
    total = docs.count()  # from the files' footers
    if not total:
        return list(rules)
    chosen = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]), F.lit(1 << 30)) < int(min(1.0, sample_rows / total) * (1 << 30))
    arrays, named = with_arrays(docs.where(chosen).select(F.col(f"`{text_col}`").alias("text")))
    fails = F.array(*[F.coalesce(rejects(rule, named), F.lit(False)) for rule in rules])
    sizes = [F.sum(x.cast("long")) for x in (F.length("text"), named["n_words"], named["n_lines"])]
    found = arrays.groupBy(fails.alias("fails")).agg(F.count("*").alias("n"), F.array(*sizes).alias("sizes")).collect()  # at most 2^rules rows
    rows = max(1, sum(r["n"] for r in found))
    mean = [sum(r["sizes"][k] or 0 for r in found) / rows for k in range(3)]
    costs = [sum(w * m for n in rule.needs if n not in free for w, m in zip(WORK[n], mean, strict=True)) for rule in rules]
    return cascade_order(rules, costs, {tuple(r["fails"]): r["n"] for r in found})


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", verdict_col: str = "rejected_by", keep_metrics: bool = False) -> DataFrame:
    """``docs`` with the first rule that each row fails, null if it is to be kept.

    With METRICS kept, their columns are made for every row, replacing columns of the same names, and rules read those;
    the metrics of other rules are made only for rows that come to them.
    """
    order = plan_cascade(docs, rules, text_col, free=METRICS if keep_metrics else ())
    df, named = (with_metrics if keep_metrics else with_arrays)(docs, text_col)
    verdict = F.lit(None).cast("string")
    for rule in reversed(order):
        verdict = F.when(rejects(rule, named), rule.name).otherwise(verdict)
    out = df.withColumn(verdict_col, verdict)
    return out.drop(*[c for c in out.columns if c not in docs.columns and c != verdict_col and not (keep_metrics and c in METRICS)])


def filter_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns of ``docs``."""
    verdict = fresh(docs, "_rejected_by")
    return cascade(docs, text_col=text_col, verdict_col=verdict).where(F.col(verdict).isNull()).drop(verdict)
