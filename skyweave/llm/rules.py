"""Quality rules: a decision list of threshold conjunctions, learned by sequential covering, as Spark conditions."""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

#: What a rule may test, each a number for any document.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share")


def _repeat_words(words: Column, width: int = 5) -> Column:
    """Words that lie in a window of `width` words found twice or more in the array."""

    def covered(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(starts, j + 1), x + width) - x)), F.lit(0), lambda a, x: a + x)

    def repeated(hashes: Column) -> Column:
        order = F.array_sort(F.zip_with(hashes, F.sequence(F.lit(0), F.size(hashes) - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return let(order, lambda s: let(F.sort_array(F.transform(twice(s), lambda x: x["i"])), covered))

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) < width, F.lit(0)).otherwise(
            let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h))))

    return of(words)


def text_stats(text: Column) -> Column:
    """A struct of a text's statistics; a null text counts as empty.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct (all long). One pass: the
    words are split once, and only texts in which some window repeats sort their windows.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    of_words = let(words_of(text), lambda w: F.struct(
        F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), F.size(F.array_distinct(w)).alias("d"), _repeat_words(w).alias("r")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return let(F.struct(of_words.alias("w"), of_lines.alias("l")), lambda s: F.struct(
        s["w"]["n"].cast("long").alias("n_words"), s["w"]["c"].cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (s["l"]["n"] - s["l"]["d"]).cast("long").alias("n_dup_lines"), s["w"]["r"].cast("long").alias("n_repeat_words"),
        s["l"]["n"].cast("long").alias("n_lines"), s["w"]["d"].cast("long").alias("n_distinct")))


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id and its text's statistics. A clashing column of docs is not read."""
    return docs.select("doc_id", text_stats(F.col("text")).alias("_s")).select("doc_id", "_s.*")


def feature(name: str) -> Column:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"), "mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "distinct_share": share("n_distinct", "n_words"),
    }[name]


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    at: float

    def holds(self, row: dict) -> bool:
        return row[self.name] >= self.at if self.above else row[self.name] < self.at

    def column(self) -> Column:
        return feature(self.name) >= F.lit(self.at) if self.above else feature(self.name) < F.lit(self.at)

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.at:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules tried in order; the first whose conditions all hold rejects, and a document that none rejects is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def kept(self) -> Column:
        verdict = None
        for rule in self.rules:
            held = rule[0].column()
            for c in rule[1:]:
                held = held & c.column()
            verdict = F.when(held, False) if verdict is None else verdict.when(held, False)
        return F.lit(True) if verdict is None else verdict.otherwise(True)

    def keeps(self, row: dict) -> bool:
        return not any(all(c.holds(row) for c in rule) for rule in self.rules)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, rule)) for rule in self.rules) or "keep all"


def learn_rules(rows: Sequence[tuple[dict, bool, bool]], *, bins: int = 32, least_precision: float = 0.9, least_covered: int = 3, most_conditions: int = 4) -> DecisionList:
    """Sequential covering over (features, is_bad, is_for_pruning) rows.

    Grow: the condition of the greatest FOIL gain is added until no good row is covered or none gains. Prune:
    final conditions go while (p - n) / (p + n) over the pruning rows does not fall. A rule stays if, over all
    rows not yet covered, at least `least_covered` and a share `least_precision` of those it covers are bad, in the pruning rows too;
    then the rows it covers leave, and the next is grown. Thresholds: midpoints between neighbouring values, at `bins` quantiles and at the ends of each class.
    """
    cuts = {}
    for f in FEATURES:
        values = sorted({r[0][f] for r in rows})
        step = max(1, len(values) // bins)
        cuts[f] = [(values[i - 1] + values[i]) / 2 for i in range(step, len(values), step)]
        for bad in (False, True):  # so are the midpoints between the ends of each class and the next value of the other
            own = sorted(r[0][f] for r in rows if r[1] == bad)
            ends = (bisect.bisect_left(values, own[0]), bisect.bisect_right(values, own[-1])) if own else ()
            cuts[f] += [(values[i - 1] + values[i]) / 2 for i in ends if 0 < i < len(values)]
        cuts[f] = sorted(set(cuts[f]))
    left, rules = list(rows), []
    while any(bad for _, bad, _ in left):
        grow, prune = [r for r in left if not r[2]], [r for r in left if r[2]]
        rule, covered = [], grow
        while len(rule) < most_conditions and any(not bad for _, bad, _ in covered):
            p0 = sum(bad for _, bad, _ in covered)
            n0 = len(covered) - p0
            best = (1e-9, None)
            for f in FEATURES:
                ordered, at, p_below, n_below = sorted((x[f], bad) for x, bad, _ in covered), 0, 0, 0
                for cut in cuts[f]:
                    while at < len(ordered) and ordered[at][0] < cut:
                        p_below, n_below, at = p_below + ordered[at][1], n_below + (not ordered[at][1]), at + 1
                    for above, p, n in ((False, p_below, n_below), (True, p0 - p_below, n0 - n_below)):
                        if p and (p, n) != (p0, n0):
                            gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0]:
                                best = (gain, Condition(f, above, cut))
            if best[1] is None:
                break
            rule.append(best[1])
            covered = [r for r in covered if best[1].holds(r[0])]

        def worth(conditions: list[Condition]) -> float:
            hit = [bad for x, bad, _ in prune if all(c.holds(x) for c in conditions)]
            return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        hit = [r for r in left if rule and all(c.holds(r[0]) for c in rule)]
        if len(hit) < least_covered or sum(r[1] for r in hit) < least_precision * len(hit) or (prune and worth(rule) < 2 * least_precision - 1):
            break
        rules.append(tuple(rule))
        left = [r for r in left if not all(c.holds(r[0]) for c in rule)]
    return DecisionList(tuple(rules))


def fit_quality(docs: DataFrame, labels: DataFrame, *, most_rows: int = 20_000) -> DecisionList:
    """Learn a decision list for quality 0 from a bounded sample of labelled documents.

    most_rows bounds the sample (the smallest hashes of doc_id), which alone goes to the driver, as numbers. A
    document labelled both ways counts as bad; null labels and labels without a document count for nothing;
    no labelled document gives the list that keeps all.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    stats = with_stats(docs.join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(drawn), "doc_id")
    rows = stats.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).select(*[feature(f).alias(f) for f in FEATURES], (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(3)) == 0).alias("prune")).collect()
    return learn_rules([({f: r[f] for f in FEATURES}, r["bad"], r["prune"]) for r in rows])


def judge(docs: DataFrame, learned: DecisionList) -> DataFrame:
    """doc_id, the statistics, base_failed, kept. A document that fails the base rules is not kept, whatever the list says.

    A null or empty text has no words and fails; repeated rows are judged each; an empty table gives an empty
    result.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return with_stats(docs).withColumn("base_failed", failed).withColumn("kept", ~failed & learned.kept())
