"""Language identification by fusing Bayesian evidence.

For each language and for no language at all: the likelihood of the text under
a byte-trigram model, the declared language (markup or metadata), and a prior of
the host, smoothed towards its address suffix, which is smoothed towards all
rows. The models are counted over all rows that declare a language; the priors
are counts of what the text alone says, by grouped aggregation, without the row
itself. What reaches the driver is the trigram table, whose size is fixed.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlake.session import store_stage

UNDETERMINED = "und"
# Declared values that name no language.
NO_LANGUAGE = ("und", "zxx", "mul", "mis")
# Languages with a model: the most declared ones, and the rows that each needs.
# The bound keeps the trigram table below 128 * BUCKETS; rows that declare a
# rarer language are taken at their word.
MOST_LANGUAGES = 128
LEAST_DECLARED = 1
BUCKETS = 1 << 15
# Each byte is part of three trigrams, so their likelihoods count a third.
SHARE = 1 / 3
# Count of a trigram that a language has not shown.
SMOOTHING = 0.01
# Rows that a prior counts like, towards the next level.
STRENGTH = 20.0
# Probability that a declared language is right.
DECLARED_TRUST = 0.9
# A row below this posterior has no language.
LEAST_POSTERIOR = 0.5
# Trigrams looked up at a time.
BLOCK = 1 << 20


def trigrams(text: str) -> np.ndarray:
    """Hash buckets of the lower-cased text's byte trigrams, blanks around it
    included; none for a blank text."""
    text = text.strip()
    if not text:
        return np.zeros(0, np.int64)
    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    joined = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    return ((joined * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def named_language(declared: Column) -> Column:
    """The declared language in lower case without its region, else null."""
    name = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.when((name != "") & ~name.isin(*NO_LANGUAGE), name)


def declared_languages(
    rows: DataFrame, most: int = MOST_LANGUAGES, least: int = LEAST_DECLARED
) -> tuple[str, ...]:
    """The languages that the most rows with a text declare, sorted by name."""
    named = rows.where(F.col("text").rlike(r"\S")).groupBy(
        named_language(F.col("declared")).alias("language")
    )
    counted = named.agg(F.count("*").alias("n")).where(f"language IS NOT NULL AND n >= {least}")
    top = counted.orderBy(F.desc("n"), "language").limit(most).collect()
    return tuple(sorted(row["language"] for row in top))


def trigram_counts(rows: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(language, bucket, n) over all rows that declare one of the languages.
    Each task adds up a table of fixed size before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        for batch in batches:
            for text, declared in zip(batch.column(0), batch.column(1), strict=True):
                found = trigrams(text.as_py() or "")
                totals[declared.as_py()] += np.bincount(found, minlength=BUCKETS)
        for k, language in enumerate(languages):
            if language not in totals:
                continue
            used = np.flatnonzero(totals[language])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)),
                 pa.array(totals[language][used])],
                ["language", "bucket", "n"],
            )

    named = rows.select("text", named_language(F.col("declared")).alias("declared"))
    counted = named.where(F.col("declared").isin(*languages)).mapInArrow(
        run, "language int, bucket int, n bigint"
    )
    return counted.groupBy("language", "bucket").agg(F.sum("n").alias("n"))


def log_likelihoods(counts: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Logarithms by bucket and class; the last class, for no language, gives
    each bucket the same probability. A language that no row declares is less
    likely than that throughout. At most languages * BUCKETS counts are
    collected."""
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    found = counts.toPandas()
    table[found["bucket"], found["language"]] += found["n"]
    table = np.log(table / table.sum(axis=0))
    table[:, ~np.isin(np.arange(len(languages)), found["language"])] -= 1.0
    return np.hstack([table, np.full((BUCKETS, 1), -math.log(BUCKETS))])


def key_columns(rows: DataFrame) -> list[str]:
    """The columns that name a row of evidence."""
    return [name for name in rows.columns if name not in ("text", "host", "declared")]


def score_texts(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """(keys, host, declared, n_trigrams, evidence array<double>)."""
    names = [*key_columns(rows), "host", "declared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, scores = [], []
            for text in batch.column("text"):
                found = trigrams(text.as_py() or "")
                total = np.zeros(table.shape[1])
                for at in range(0, len(found), BLOCK):
                    total += table[found[at:at + BLOCK]].sum(axis=0)
                sizes.append(len(found))
                scores.append(total * SHARE)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in names),
                 pa.array(sizes, pa.int64()), pa.array(scores, pa.list_(pa.float64()))],
                [*names, "n_trigrams", "evidence"],
            )

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{name} {kinds[name]}" for name in names)
    return rows.select(*names, "text").mapInArrow(
        run, f"{schema}, n_trigrams bigint, evidence array<double>"
    )


def suffix_of(host: Column) -> Column:
    """The last label of the address, empty where there is only one."""
    return F.lower(F.regexp_extract(F.coalesce(host, F.lit("")), r"\.([A-Za-z]+)\.?$", 1))


def evidence_rows(docs: DataFrame) -> DataFrame:
    """Documents as evidence: the source is the host, ``lang`` is declared."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("declared"),
    )


# What of a page is not its text.
MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript|template)\b[^>]*+>.*?(?:</\1\s*>|\z)|<[^>]*+>"


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as evidence: host of the address, language of the html element."""
    return pages.select(
        F.col("page_id").cast("bigint").alias("doc_id"),
        F.regexp_replace("html", MARKUP, " ").alias("text"),
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://([^/:?#]+)", 1)).alias("host"),
        F.nullif(
            F.lower(F.regexp_extract(
                F.coalesce("html", F.lit("")), r"""(?i)<html[^>]*?\slang\s*=\s*["']?([a-z]+)""", 1
            )), F.lit(""),
        ).alias("declared"),
    )


def all_rows(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents and pages as evidence in one table; each has its own id, the
    other one is null."""
    no_id = F.lit(None).cast("bigint")
    return evidence_rows(docs).withColumn("page_id", no_id).unionByName(
        page_rows(pages).withColumn("page_id", F.col("doc_id")).withColumn("doc_id", no_id)
    )


def _shares(counts: list[Column], prior: list[Column]) -> list[Column]:
    """Counts smoothed towards a prior."""
    total = sum(counts[1:], counts[0])
    return [(n + STRENGTH * p) / (total + STRENGTH) for n, p in zip(counts, prior, strict=True)]


def identify(rows: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, language, posterior, text_language, declared, kept) for every row
    of ``rows`` (keys, text, host, declared); all other columns are keys.

    ``languages`` are those with a model, by default the declared ones. A row
    that declares another language has that one. ``kept`` is false where no
    language reaches LEAST_POSTERIOR or "no language" wins; ``language`` is then
    ``und``. A null or blank text has no language. A declared value that names
    no language, or null, is no evidence; a null host is the empty one. Texts of
    any length are read whole. Null ids and repeated rows stay; ties go to the
    language listed first; an empty table gives no rows.
    """
    languages = declared_languages(rows) if languages is None else languages
    classes = (*languages, UNDETERMINED)
    table = log_likelihoods(trigram_counts(rows, languages), languages)
    scored = store_stage(
        score_texts(rows, table)
        .withColumn("host", F.coalesce("host", F.lit("")))
        .withColumn("best", (F.array_position("evidence", F.array_max("evidence")) - 1).cast("int"))
        .withColumn("best", F.when(F.col("n_trigrams") > 0, F.col("best")).otherwise(len(languages))),
        "scored",
    )
    names = [f"n{k}" for k in range(len(classes))]
    hosts = scored.groupBy("host").agg(
        *(F.count_if(F.col("best") == k).alias(n) for k, n in enumerate(names))
    ).withColumn("suffix", suffix_of(F.col("host")))
    hosts = store_stage(hosts, "hosts")
    suffixes = hosts.groupBy("suffix").agg(*(F.sum(n).alias(f"s{n}") for n in names))
    overall = hosts.agg(*(F.sum(n) for n in names)).first()
    whole = sum(n or 0 for n in overall)
    everywhere = [
        F.lit(((n or 0) + 1.0) / (whole + len(classes))) for n in overall
    ]
    priors = hosts.join(suffixes, "suffix").select("host", "suffix", *names, *(f"s{n}" for n in names))
    joined = scored.join(priors, "host")

    def others(prefix: str) -> list[Column]:
        return [
            F.col(f"{prefix}{n}") - (F.col("best") == k).cast("int") for k, n in enumerate(names)
        ]

    prior = _shares(others(""), _shares(others("s"), everywhere))
    named = named_language(F.col("declared"))
    known = F.coalesce(named.isin(*languages), F.lit(False))
    points = []
    for k, name in enumerate(classes):
        trust = (1 - DECLARED_TRUST) / max(1, len(languages))
        declared = F.when(
            known, F.when(named == name, DECLARED_TRUST).otherwise(trust)
        ).otherwise(1.0)
        points.append(F.get("evidence", F.lit(k)) + F.log(prior[k]) + F.log(declared))
    keys = key_columns(rows)
    fused = joined.select(
        *keys, "declared", "n_trigrams", "best", F.array(*points).alias("points")
    ).withColumn("top", F.array_max("points")).withColumn(
        "at", F.array_position("points", F.col("top")).cast("int")
    ).withColumn(
        "posterior",
        1 / F.aggregate("points", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))),
    )
    labels = F.array(*map(F.lit, classes))
    rare = named.isNotNull() & ~known
    likely = (F.col("at") <= len(languages)) & (F.col("posterior") >= LEAST_POSTERIOR)
    kept = (F.col("n_trigrams") > 0) & (rare | likely)
    language = F.when(rare, named).otherwise(F.element_at(labels, F.col("at")))
    return fused.select(
        *keys, F.when(kept, language).otherwise(UNDETERMINED).alias("language"),
        "posterior", F.element_at(labels, F.col("best") + 1).alias("text_language"), "declared",
        kept.alias("kept"),
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents with a language, all columns as they are. Rows that share
    an id stay together: an id is rejected if all its rows are. Rows without an
    id are kept, as no verdict can name them. Null and very long texts as in
    ``identify``; an empty table gives no rows."""
    found = identify(evidence_rows(docs))
    rejected = (
        found.groupBy("doc_id").agg(F.max("kept").alias("any")).where("NOT any").select("doc_id")
    )
    return docs.join(rejected, "doc_id", "left_anti")
