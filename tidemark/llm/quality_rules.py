"""Quality rules as a short-circuit cascade of built-in expressions.

Each rule rejects on a predicate over features of the text. A rule's cost (seconds for its features and predicate) and
its selectivity are estimated on a bounded sample; the cascade then runs rules by rejection per cost, and a rule's
features are computed only for rows that no earlier rule rejected. The verdict doesn't depend on the order.

Words are maximal runs of characters other than U+0020 and U+0009..U+000D. Everything is a Spark SQL expression.

Edge cases: a null text is empty, has no words and fails the word-count rule; a text of any length is read whole, in
its own row; rows are judged one by one, so repeated rows get equal verdicts; an empty table gives an empty result;
other columns pass through ``kept`` untouched.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = "\\\\x20\\\\x09-\\\\x0D"
#: The sample that costs and selectivities are estimated on has about this many rows.
SAMPLE_ROWS = 1000


def let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value, which is computed once however often the name occurs. The optimizer may
    move or copy the whole, but never takes the parts apart."""
    return f"transform(array({value}), {name} -> {body})[0]"


WORDS = f"array_remove(split({{t}}, '[{WS}]+'), '')"
_LINES = f"filter(split({{t}}, '\\n'), x -> x rlike '[^{WS}]')"
_GRAMS = "transform(sequence(1, size({w}) - 4), i -> xxhash64(slice({w}, i, 5)))"
_PLACES = (
    "sort_array(transform(filter(s, (e, i) -> (i > 0 AND get(s, i - 1).g = e.g) OR (i < size(s) - 1 AND get(s, i + 1).g = e.g)), e -> e.i))"
)
_COVERED = "aggregate(p, struct(0L AS n, -5 AS at), (a, x) -> struct(a.n + least(5, x - a.at) AS n, x AS at), a -> a.n)"
_SORTED = "sort_array(transform(g, (h, i) -> struct(h AS g, i AS i)))"
#: Features by name: SQL over the text {t} and its words {w}.
FEATURES: dict[str, str] = {
    "n_words": "cast(size({w}) as bigint)",
    "word_chars": "cast(length(array_join({w}, '')) as bigint)",
    "n_symbols": "cast(regexp_count({t}, '[#*$%&|<>]') as bigint)",
    "n_bangs": "cast(regexp_count({t}, '!!') as bigint)",
    "n_lines": f"cast(size({_LINES}) as bigint)",
    "n_dup_lines": f"cast({let(_LINES, 'l', 'size(l) - size(array_distinct(l))')} as bigint)",
    "n_repeat_words": "CASE WHEN size({w}) > 5 THEN "
    + let(_GRAMS, "g", "CASE WHEN size(array_distinct(g)) < size(g) THEN " + let(_SORTED, "s", let(_PLACES, "p", _COVERED)) + " ELSE 0L END")
    + " ELSE 0L END",
}


@dataclass(frozen=True)
class Rule:
    """Rejects the rows where ``rejects`` holds, a predicate over features in braces."""

    name: str
    rejects: str

    def over(self, text: str, words: str) -> str:
        return self.rejects.format(**{f: e.format(t=text, w=words) for f, e in FEATURES.items()})

    def over_columns(self, columns: tuple[str, ...], text: str, words: str) -> str:
        """The same, with some features taken from finished columns."""
        return self.rejects.format(**{f: f if f in columns else e.format(t=text, w=words) for f, e in FEATURES.items()})


#: These two decide base_failed.
BASE_RULES = (
    Rule("few_words", "{n_words} < 10"),
    Rule("repeated_words", "100 * {n_repeat_words} > 20 * {n_words}"),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", "100 * {n_symbols} > 30 * {n_words}"),
    Rule("bangs", "100 * {n_bangs} > 30 * {n_words}"),
    Rule("word_length", "{word_chars} < 2 * {n_words} OR {word_chars} > 15 * {n_words}"),
    Rule("repeated_lines", "100 * {n_dup_lines} > 50 * {n_lines}"),
)


def body(text: str) -> str:
    return f"coalesce(`{text}`, '')"


def estimated_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Rules by rejection per cost, highest first, as timed on a sample drawn by a hash of the text."""
    total = docs.count()
    if not total:
        return rules
    share = min(1.0, 4 * rows / total)
    drawn = docs.select(F.col(text)).where(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < int(share * 1_000_000)).limit(rows)
    sample = drawn.persist()
    try:
        n = max(1, sample.count())
        scored = []
        for i, rule in enumerate(rules):
            asked = sample.agg(F.count_if(rejected_by((rule,), text).isNotNull()))
            asked.collect()  # compiles
            began = time.perf_counter()
            rejected = asked.collect()[0][0]
            cost = max(1e-6, (time.perf_counter() - began) / n)
            scored.append((-(rejected / n) / cost, i, rule))
    finally:
        sample.unpersist()
    return tuple(rule for *_, rule in sorted(scored, key=lambda x: x[:2]))


def rejected_by(order: tuple[Rule, ...], text: str = "text") -> Column:
    """Name of the first rule in order that rejects a row, or null. A rule's features are computed only where no earlier
    rule rejected the row."""
    t = body(text)
    cases = " ".join(f"WHEN {rule.over(t, 'w')} THEN '{rule.name}'" for rule in order)
    return F.expr(let(WORDS.format(t=t), "w", f"CASE {cases} END"))


def kept(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects."""
    return docs.where(rejected_by(estimated_order(docs, rules)).isNull())


#: The features that ``judged`` returns.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdict of every document, for reports. The reported features are wanted for every row; others are
    computed only for rows that the cascade brings to a rule that needs them."""
    order = estimated_order(docs, rules)
    t = body("text")
    full = docs.select("doc_id", "text", F.expr(WORDS.format(t=t)).alias("_words"))
    full = full.select("doc_id", "text", "_words", *(F.expr(FEATURES[f].format(t=t, w="_words")).alias(f) for f in REPORTED))
    base = F.expr(" OR ".join(f"({r.over_columns(REPORTED, t, '_words')})" for r in BASE_RULES))
    cases = " ".join(f"WHEN {rule.over_columns(REPORTED, t, '_words')} THEN false" for rule in order)
    return full.select("doc_id", *REPORTED, base.alias("base_failed"), F.expr(f"CASE {cases} ELSE true END").alias("kept"))
