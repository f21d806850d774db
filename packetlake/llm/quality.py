"""Quality rules whose cut-offs are certified on labelled documents.

Each rule has a score per thousand and rejects a document above a cut-off. For
each stratum and cut-off the false rejections among the documents labelled good
are counted. A cut-off is safe when the exact binomial probability of so few
false rejections, if the true rate were the allowed one, is small. Cut-offs are
tried from the most lenient one down and the first that is not safe ends the
row (fixed-sequence testing, which needs no correction within a row); over the
rules and strata the error is divided by their number (Bonferroni). The allowed
rate is divided by the number of rules, so that it holds for all rules
together. No cut-off is ever fitted: all labelled documents are holdouts.

All of it is DataFrame functions. Measures are taken within a row; only counts
per stratum and cut-off are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlake.llm.common import BLANK_CLASS, WORD_CLASS, whole_text
from packetlake.session import store_stage

# Rejected documents among the good ones, over all rules of a stratum.
FALSE_REJECTIONS = 0.03
# Probability that any certified cut-off exceeds its rate.
ERROR = 0.05
# Cut-offs per thousand, the most lenient first.
CUTOFFS = (900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100, 75, 50, 25)
# Score of each rule per thousand: count over total.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "shouts": ("n_shouts", "n_words"),
}
# Steps of the joint test: each lowers one rule's cut-off, so a document that
# one step rejects is rejected by all later ones. Marks first, which prose has
# least of, then the others in turn.
_MARKS = ("symbols", "shouts")
STEPS = (
    *((rule, cutoff) for rule in _MARKS for cutoff in CUTOFFS),
    *((rule, cutoff) for cutoff in CUTOFFS for rule in ("capitals", "repeats", "dup_lines")),
)
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_capitals", "n_shouts",
)
WINDOW = 3
NO_STRATUM = "none"


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")


def measure(docs: DataFrame, into: str = "__measures") -> DataFrame:
    """``docs`` with one more column, the struct ``into`` of MEASURES. A null
    text has no words. The steps keep arrays in columns of their own, as a
    lambda would compute an expression again for each element."""
    text = whole_text()
    steps = docs.withColumns({
        "__words": F.regexp_extract_all(text, F.lit(WORD_CLASS + "+"), F.lit(0)),
        "__lines": F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD_CLASS)),
    })
    n_words = F.size("__words")
    words = F.col("__words")
    steps = steps.withColumn(
        "__windows",
        F.when(
            n_words >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), n_words - WINDOW),
                lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(WINDOW))),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )
    # Only texts in which a window comes back go on.
    repeated = F.size(F.array_distinct("__windows")) < F.size("__windows")
    steps = steps.withColumn(
        "__sorted",
        F.when(
            repeated,
            F.sort_array(F.transform(
                "__windows", lambda window, i: F.struct(window.alias("window"), i.alias("at"))
            )),
        ),
    )
    ordered = F.col("__sorted")

    def twin(entry: Column, j: Column) -> Column:
        same = [F.get(ordered, j + d)["window"] == entry["window"] for d in (-1, 1)]
        found = F.coalesce(same[0], F.lit(False)) | F.coalesce(same[1], F.lit(False))
        return F.when(found, entry["at"])

    steps = steps.withColumn(
        "__starts", F.sort_array(F.filter(F.transform("__sorted", twin), F.isnotnull))
    )
    starts = F.col("__starts")
    covered = F.aggregate(
        F.transform(
            starts,
            lambda at, j: F.coalesce(
                F.least(F.get(starts, j + 1) - at, F.lit(WINDOW)), F.lit(WINDOW)
            ),
        ),
        F.lit(0), lambda total, part: total + part,
    )
    measures = F.struct(
        n_words.cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(text, BLANK_CLASS, "")).cast("bigint").alias("word_chars"),
        _count(text, "[#*$%&|<>]").alias("n_symbols"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        _count(text, "[A-Z]").alias("n_capitals"),
        _count(text, "!").alias("n_shouts"),
    )
    # A filter on the result must not be moved below, where it would hold the
    # steps as one nested expression; the explode of one element stops that.
    return steps.withColumn(into, F.explode(F.array(measures))).select(*docs.columns, into)


def base_failed(m: Column) -> Column:
    """The fixed rules: fewer than 50 words, or most of them repeated."""
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def score(m: Column, rule: str) -> Column:
    part, total = RULES[rule]
    whole = F.when(m[total] > 0, m[total])
    return F.coalesce(F.floor(1000 * m[part] / whole), F.lit(0)).cast("bigint")


def binomial_cdf(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k), X binomial: terms added in logarithms, so that no count is too
    large. Work grows with k, which the caller keeps below n * rate."""
    step = math.log(rate) - math.log(1 - rate)

    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i) + F.lit(step)
        top = F.greatest(term, state["total"])
        low = F.least(term, state["total"])
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(low - top))).alias("total"))

    first = n.cast("double") * F.lit(math.log(1 - rate))
    counted = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.aggregate(
        counted, F.struct(first.alias("term"), first.alias("total")), add,
        lambda state: F.exp(state["total"]),
    )


def stratum_of(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(NO_STRATUM))


def holdouts(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """The good documents that pass the fixed rules. ``measured`` has doc_id,
    stratum and the measures; a document is good if all its labels say so. Labels without
    an id or a verdict do not count, a document that is repeated counts once
    for each row."""
    good = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id").agg(F.min("quality").alias("good"))
        .where("good = 1").select("doc_id")
    )
    return measured.where(~base_failed(F.col("m"))).join(good, "doc_id", "left_semi")


def false_rejections(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, rule, cutoff, n, k): good documents that pass the fixed rules,
    and those of them above each cut-off."""
    holdout = holdouts(measured, labels)
    scored = holdout.select(
        "stratum", F.explode(F.array(*(
            F.struct(F.lit(rule).alias("rule"), score(F.col("m"), rule).alias("score"))
            for rule in RULES
        ))).alias("s"),
    ).groupBy("stratum", "s.rule").agg(
        F.count("*").alias("n"),
        *(F.count_if(F.col("s.score") > cutoff).alias(f"k{cutoff}") for cutoff in CUTOFFS),
    )
    return scored.select(
        "stratum", "rule", "n",
        F.explode(F.array(*(
            F.struct(F.lit(cutoff).alias("cutoff"), F.col(f"k{cutoff}").alias("k"))
            for cutoff in CUTOFFS
        ))).alias("c"),
    ).select("stratum", "rule", "n", "c.cutoff", "c.k")


def safe_cutoffs(
    counts: DataFrame, false_rejections: float = FALSE_REJECTIONS, error: float = ERROR
) -> DataFrame:
    """(stratum, cutoffs map<rule, cutoff>): the strictest certified cut-off of
    each rule. A stratum or rule without one is left out, so it rejects
    nothing."""
    rate = false_rejections / len(RULES)
    strata = max(1, counts.select("stratum").distinct().count())
    tested = counts.withColumn(
        "p",
        F.when(
            F.col("k") < F.col("n") * rate, binomial_cdf(F.col("k"), F.col("n"), rate)
        ).otherwise(F.lit(1.0)),
    ).withColumn("safe", F.col("p") <= error / (len(RULES) * strata))
    return (
        tested.groupBy("stratum", "rule")
        .agg(
            # The most lenient cut-off that fails ends the row.
            F.max(F.when(~F.col("safe"), F.col("cutoff"))).alias("unsafe"),
            F.collect_list(F.when(F.col("safe"), F.col("cutoff"))).alias("passed"),
        )
        .withColumn("cutoff", F.array_min(F.filter(
            "passed", lambda c: F.col("unsafe").isNull() | (c > F.col("unsafe"))
        )))
        .where("cutoff IS NOT NULL")
        .groupBy("stratum")
        .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    )


def certified(
    measured: DataFrame, labels: DataFrame,
    false_rejections_allowed: float = FALSE_REJECTIONS, error: float = ERROR,
) -> DataFrame:
    """Counts and cut-offs, both stored: a few rows each, read several times."""
    counts = store_stage(false_rejections(measured, labels), "false-rejections")
    return store_stage(safe_cutoffs(counts, false_rejections_allowed, error), "cutoffs")


def joint_rejections(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, step, rule, cutoff, n, k): good documents that pass the fixed
    rules, and those of them that any rule rejects after each step."""
    scored = holdouts(measured, labels).select(
        "stratum", *(score(F.col("m"), rule).alias(rule) for rule in RULES)
    ).select("stratum", F.array_min(F.array(*(
        F.when(F.col(rule) > cutoff, F.lit(j)) for j, (rule, cutoff) in enumerate(STEPS)
    ))).alias("first"))
    counted = scored.groupBy("stratum").agg(
        F.count("*").alias("n"),
        *(F.count_if(F.col("first") <= j).alias(f"k{j}") for j in range(len(STEPS))),
    )
    return counted.select("stratum", "n", F.explode(F.array(*(
        F.struct(
            F.lit(j).alias("step"), F.lit(rule).alias("rule"), F.lit(cutoff).alias("cutoff"),
            F.col(f"k{j}").alias("k"),
        ) for j, (rule, cutoff) in enumerate(STEPS)
    ))).alias("s")).select("stratum", "s.step", "s.rule", "s.cutoff", "n", "s.k")


def joint_cutoffs(
    counts: DataFrame, rate: float = FALSE_REJECTIONS, error: float = ERROR
) -> DataFrame:
    """(stratum, cutoffs map<rule, cutoff>) after the last step before the first
    one that is not safe. The loss is that of all rules together, so the rate is
    not divided, and the error only by the strata."""
    strata = max(1, counts.select("stratum").distinct().count())
    tested = counts.withColumn(
        "p",
        F.when(
            F.col("k") < F.col("n") * rate, binomial_cdf(F.col("k"), F.col("n"), rate)
        ).otherwise(F.lit(1.0)),
    )
    unsafe = F.min(F.when(F.col("p") > error / strata, F.col("step"))).over(
        Window.partitionBy("stratum")
    )
    return (
        tested.withColumn("unsafe", unsafe)
        .where("unsafe IS NULL OR step < unsafe")
        .groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
        .groupBy("stratum")
        .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    )


def rejected_by(m: Column, cutoffs: Column) -> Column:
    """Names of the rules that reject, in the order of RULES."""
    return F.filter(
        F.array(*(F.when(score(m, rule) > F.element_at(cutoffs, rule), F.lit(rule)) for rule in RULES)),
        F.isnotnull,
    )


def narrow(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, m) of each document."""
    picked = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), stratum_of(docs).alias("stratum"),
        F.col("text").cast("string").alias("text"),
    )
    return measure(picked, "m").drop("text")


def judge(
    docs: DataFrame, labels: DataFrame,
    false_rejections_allowed: float = FALSE_REJECTIONS, error: float = ERROR,
) -> DataFrame:
    """(doc_id, MEASURES, base_failed, kept, stratum, rejected_by) of every
    document. Null texts have no words and fail the fixed rules; a null lang is
    a stratum of its own; repeated rows are judged alike; without labels only
    the fixed rules reject; texts of any length are measured whole; an empty
    table gives no rows; other columns are not looked at."""
    measured = store_stage(narrow(docs), "measures")
    cutoffs = certified(measured, labels, false_rejections_allowed, error)
    m = F.col("m")
    names = F.coalesce(rejected_by(m, F.col("cutoffs")), F.array().cast("array<string>"))
    return measured.join(cutoffs, "stratum", "left").select(
        "doc_id", *(m[name].alias(name) for name in MEASURES),
        base_failed(m).alias("base_failed"),
        (~base_failed(m) & (F.size(names) == 0)).alias("kept"),
        "stratum", F.concat_ws(",", names).alias("rejected_by"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the fixed rules and the jointly certified cut-offs
    keep, with all their columns. Null texts fail the fixed rules; repeated rows
    are judged alike; an empty table gives no rows. Whole texts, however long,
    stay where they are: they are measured once for the labelled documents, and
    again while they are filtered."""
    labelled = docs.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    counts = store_stage(
        joint_rejections(store_stage(narrow(labelled), "measures"), labels), "joint-rejections"
    )
    cutoffs = store_stage(joint_cutoffs(counts), "cutoffs")
    m = F.col("__measures")
    judged = measure(docs).withColumn("__stratum", stratum_of(docs)).join(
        cutoffs.select(F.col("stratum").alias("__stratum"), F.col("cutoffs").alias("__cutoffs")),
        "__stratum", "left",
    )
    rejected = F.coalesce(F.size(rejected_by(m, F.col("__cutoffs"))), F.lit(0))
    return judged.where(~base_failed(m) & (rejected <= 0)).select(docs.columns)
