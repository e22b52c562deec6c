"""Quality rules learned as a decision list.

Statistics of every text are computed with Spark's own functions and stored
once.  Sequential covering then learns from all labelled rows: a rule grows by
the threshold condition with the best information gain, is pruned on rows held
back from growing, and is accepted if it is precise there; the rows it covers
are set aside and the next rule begins.  Every step is one aggregation over
the labelled statistics (feature bins -> counts of both labels), so the driver
sees (features x bins) counts and never rows.  The list is emitted as one
ordered ``CASE WHEN`` expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import WHITE_CHARS, stored, words

MAX_RULES, MAX_CONDITIONS = 12, 4
BINS = 24                      # candidate thresholds of a feature
PRECISION = 0.95               # of a rule on the rows held back
LEAST_COVER = 3                # rejected rows that a rule must cover there
HELD_BACK = 3                  # one labelled row in so many prunes instead of grows
LEAST_WORDS, MOST_REPEATED = 10, 20   # the base rule: words, and per cent of repeated words

#: name -> per mille ratios and counts that conditions may test
FEATURES = {
    "symbol_rate": "1000 * n_symbols div greatest(n_words, 1)",
    "repeat_rate": "1000 * n_repeat_words div greatest(n_words, 1)",
    "dup_line_rate": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "distinct_rate": "1000 * n_distinct div greatest(n_words, 1)",
    "upper_rate": "1000 * n_upper div greatest(word_chars, 1)",
    "digit_rate": "1000 * n_digits div greatest(word_chars, 1)",
    "exclaim_rate": "1000 * n_exclaim div greatest(n_words, 1)",
    "word_length": "100 * word_chars div greatest(n_words, 1)",
    "line_length": "n_words div greatest(n_lines, 1)",
    "words": "n_words",
}


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` bound to a lambda variable, so that it is
    evaluated once however often the body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def _repeated_words(w: Column) -> Column:
    """Words that lie in a five-word window found twice or more, the first one
    included.  Windows are compared by 64-bit hashes of their words' hashes;
    only texts with a repeated hash sort them."""
    n = F.size(w)

    def covered(h: Column) -> Column:
        last = F.size(h) - 1

        def marks(s: Column) -> Column:
            same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
            hit = F.filter(F.sequence(F.lit(0), last), lambda j: same(j, j - 1) | same(j, j + 1))
            starts = F.sort_array(F.transform(hit, lambda j: F.get(s, j)["i"]))
            zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
            return F.aggregate(starts, zero, lambda a, x: F.struct(
                (a["total"] + x + 5 - F.greatest(x, a["end"])).alias("total"), (x + 5).alias("end")))["total"]

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(ordered, marks)).otherwise(0)

    def windows(hw: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 5),
                           lambda i: F.xxhash64(*[F.get(hw, i + k) for k in range(5)]))

    return F.when(n > 5, _let(F.transform(w, lambda x: F.xxhash64(x)),
                              lambda hw: _let(windows(hw), covered))).otherwise(0)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of every text, one row per input row.  Null texts
    have no words, lines or characters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count_of = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE_CHARS, "")) > 0)
    of_words = _let(words(F.col(text_col)), lambda w: F.struct(
        F.size(w).alias("n_words"), _repeated_words(w).alias("n_repeat_words"),
        F.size(F.array_distinct(w)).alias("n_distinct")))
    of_lines = _let(lines, lambda x: F.struct(
        F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    counts = {"word_chars": F.length(F.translate(text, WHITE_CHARS, "")), "n_symbols": count_of("#*$%&|<>"),
              "n_upper": count_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_digits": count_of("0123456789"),
              "n_exclaim": count_of("!")}
    s = docs.select(F.col(id_col).alias("doc_id"), of_words.alias("w"), of_lines.alias("l"),
                    *[c.alias(k) for k, c in counts.items()])
    return s.select("doc_id", *[F.col(c).cast("long").alias(c.split(".")[-1]) for c in (
        "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "w.n_distinct", "l.n_lines",
        "n_upper", "n_digits", "n_exclaim")])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _condition(feature: str, at_least: bool, t: int) -> Column:
    value = F.expr(FEATURES[feature])
    return value >= t if at_least else value < t


def _all(rule: list[tuple[str, bool, int]]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & _condition(*c)
    return out


def _bin(feature: str, cuts: list[int]) -> Column:
    """How many of the cuts a row's value reaches."""
    value = F.expr(FEATURES[feature])
    return F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda t: value >= t))


def _bin_counts(rows: DataFrame, names: list[str]) -> list:
    """(feature, bin) -> good and bad rows; one aggregation."""
    return (rows.select("bad", F.posexplode("bins").alias("f", "b")).groupBy("f", "b")
            .agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect())


def _best(counts: list, names: list[str], cuts: dict[str, list[int]], rule: list) -> tuple | None:
    """The condition with the highest gain, or None if none gains."""
    per = {}
    for r in counts:
        per.setdefault(names[r["f"]], {})[r["b"]] = (r["bad"], r["n"] - r["bad"])
    if not per:
        return None
    first = next(iter(per.values()))
    bad_all, good_all = (sum(x[i] for x in first.values()) for i in (0, 1))
    if not bad_all or not good_all:
        return None
    now = math.log2(bad_all / (bad_all + good_all))
    best, gain = None, 1e-9
    for name in names:
        below = [0, 0]
        for b, t in enumerate(cuts[name]):
            got = per.get(name, {}).get(b, (0, 0))      # bin b: values below cut b, not below the one before
            below = [below[0] + got[0], below[1] + got[1]]
            for at_least, (p, n) in ((False, below), (True, (bad_all - below[0], good_all - below[1]))):
                if p and (g := p * (math.log2(p / (p + n)) - now)) > gain and (name, at_least, t) not in rule:
                    best, gain = (name, at_least, t), g
    return best


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list:
    """The decision list, rules of (feature, at_least, threshold) conditions
    that reject a document, learned from all labelled rows.  Labels are 1 for
    good; a document with several labels counts by their mean (0.5 and more:
    good), null labels and ids are left out.  Without rows of both labels the
    list is empty and nothing is rejected."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("label_id")).agg(F.avg(label_col).alias("q")))
    rows = stats.join(known, stats["doc_id"] == known["label_id"]).where(~base_failed())
    names = list(FEATURES)
    at = [i / (BINS + 1) for i in range(1, BINS + 1)]
    # thresholds from both labels: what separates the rarer one may lie beyond the common one's quantiles
    quantiles = (rows.groupBy((F.col("q") < 0.5).alias("bad"))
                 .agg(*[F.percentile_approx(F.expr(FEATURES[f]), at, 1000).alias(f) for f in names]).collect())
    if len(quantiles) < 2:
        return []
    cuts = {f: sorted({v for r in quantiles for v in (r[f] or [])}) for f in names}
    bins = F.array(*[_bin(f, cuts[f]) for f in names])
    seen = stored(rows.select((F.col("q") < 0.5).cast("long").alias("bad"), bins.alias("bins"),
                              (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_BACK)) == 0).alias("held"),
                              *[c for c in stats.columns if c != "doc_id"]), "rules-labelled")
    found: list[list[tuple[str, bool, int]]] = []
    while len(found) < MAX_RULES:
        left = seen.where(~_any(found))
        grow, rule = left.where("not held"), []
        while len(rule) < MAX_CONDITIONS and (c := _best(_bin_counts(grow.where(_all(rule)), names), names, cuts, rule)):
            rule.append(c)
        if not rule:
            break
        prefix = [_all(rule[:k]) for k in range(1, len(rule) + 1)]
        held = left.where("held").agg(*[x for k, c in enumerate(prefix) for x in (
            F.sum(F.when(c, F.col("bad"))).alias(f"p{k}"), F.sum(F.when(c, 1 - F.col("bad"))).alias(f"n{k}"))]).first()
        value = lambda k: ((held[f"p{k}"] or 0), (held[f"n{k}"] or 0))
        score = lambda k: (value(k)[0] - value(k)[1]) / max(1, sum(value(k)))
        k = max(range(len(rule)), key=lambda k: (score(k), -k))
        p, n = value(k)
        if p < LEAST_COVER or p < PRECISION * (p + n):
            break
        found.append(rule[:k + 1])
    return found


def _any(rules: list) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | _all(r)
    return out


def verdict(rules: list) -> Column:
    """The number of the first rule that holds (from 1), null if none does."""
    out = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(rules, 1))):
        out = F.when(_all(r), i).otherwise(out)
    return out


def filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the statistics, base_failed, rule (the
    learned rule that rejects it, null if none) and kept.

    Null and empty texts have no words and fail the base rule.  Rows with a
    null id are judged like any other and never labelled; repeated rows are
    judged alike.  An empty table, or one without labels, gets the base rule
    alone.  Other columns are not read.
    """
    stats = stored(statistics(docs, id_col, text_col), "rules-statistics")
    rules = learn(stats, labels)
    return (stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))
