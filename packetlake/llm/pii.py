"""Personal data by patterns, checksums and context words.

Patterns propose spans. Validators confirm them: Luhn for cards, mod-97 for
account numbers, ranges and digit counts for the rest. Words nearby raise the
score of what is left; a span counts from ``THRESHOLD`` on. The proposals marked
``base`` are always kept once their validator agrees.

All of it is DataFrame functions. A text is cut at the matches of a pattern, so
the lengths of the parts and of the matches give the positions. Only matches
are shuffled, to add up those lengths within a document; masking needs no
shuffle at all.

The patterns give the leftmost non-overlapping matches in linear time: runs of
characters are possessive and start where the run starts (or where the last
match ended), since a later start could not match either.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlake.llm.common import whole_text
from packetlake.session import store_stage

THRESHOLD = 0.5
# Characters before and after a match in which context words count.
CONTEXT_BEFORE = 48
CONTEXT_AFTER = 24
CONTEXT_SCORE = 0.3


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled, less nine above nine."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    parts = F.transform(
        values,
        lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)),
    )
    return F.aggregate(parts, F.lit(0), lambda total, d: total + d) % 10 == 0


def mod97(match: Column) -> Column:
    """The account number with its first four characters at the end and letters
    as 10 to 35 leaves 1 when divided by 97."""
    packed = F.upper(F.regexp_replace(match, " ", ""))
    moved = F.concat(F.substring(packed, 5, 40), F.substring(packed, 1, 4))

    def add(rest: Column, letter: Column) -> Column:
        number = F.when(letter.rlike("[0-9]"), letter.cast("int")).otherwise(F.ascii(letter) - 55)
        return (rest * F.when(number > 9, 100).otherwise(10) + number) % 97

    return (F.length(packed) >= 15) & (
        F.aggregate(F.split(moved, ""), F.lit(0), add) == 1
    )


def octets(match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def card_number(match: Column) -> Column:
    return F.length(digits_of(match)).between(16, 19) & luhn(digits_of(match))


def phone_number(match: Column) -> Column:
    return F.length(digits_of(match)).between(8, 15)


@dataclass(frozen=True)
class Proposal:
    kind: str
    pattern: str
    valid: Callable[[Column], Column]
    base: bool = False
    score: float = THRESHOLD
    context: str = "$^"
    # A character without which there is no match.
    needs: str = "[0-9]"


_LOCAL = "[A-Za-z0-9._%+-]"
PROPOSALS = (
    Proposal(
        "email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda match: F.lit(True), base=True, needs="@",
    ),
    Proposal(
        "ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", octets, base=True,
        needs=r"[0-9]\.[0-9]",
    ),
    Proposal("card", "[0-9](?:[ -]?[0-9])++", card_number, base=True, needs="[0-9][ -]?[0-9]"),
    Proposal("phone", r"\+[0-9][ ().0-9-]+[0-9]", phone_number, base=True, needs=r"\+[0-9]"),
    # Cards and phones that a neighbour's digits hide from the patterns above.
    Proposal(
        "card", r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
        card_number, needs="[0-9]{4}", context="card|visa|credit|debit|payment",
    ),
    Proposal(
        "phone", r"\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
        phone_number, needs=r"\+[0-9]", context="phone|tel|call|fax|mobile",
    ),
    Proposal(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        mod97, needs="[A-Z]{2}[0-9]{2}",
    ),
    Proposal(
        "ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        lambda match: F.lit(True), score=0.3, context="ssn|social security", needs="[0-9]-[0-9]",
    ),
    Proposal(
        "secret", r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{24,}(?![A-Za-z0-9])",
        lambda match: F.lit(True), score=0.3,
        context="token|secret|password|passwd|api.?key|access.?key", needs="[A-Za-z0-9]{24}",
    ),
)
KINDS = tuple(dict.fromkeys(proposal.kind for proposal in PROPOSALS))
BASE_KINDS = tuple(proposal.kind for proposal in PROPOSALS if proposal.base)


def _matches(text: Column, proposal: Proposal) -> Column:
    return F.when(
        text.rlike(proposal.needs), F.regexp_extract_all(text, F.lit(proposal.pattern), F.lit(0))
    )


def _parts(text: Column, proposal: Proposal) -> Column:
    return F.split(text, proposal.pattern, -1)


def _confirmed(proposal: Proposal, match: Column, before: Column, after: Column) -> Column:
    valid = proposal.valid(match)
    if proposal.base:
        return valid
    near = F.lower(F.concat_ws(" ", before, after)).rlike(proposal.context)
    points = F.lit(proposal.score) + F.when(near, CONTEXT_SCORE).otherwise(0.0)
    return valid & (points >= THRESHOLD)


def find_spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, spans) for every row of ``docs``: an array of (rank, start,
    end, base, kind), start and end in code points, end exclusive, ordered by
    kind as in KINDS, then start. Of two proposals of one kind that overlap the
    base one stays. ``row`` tells repeated rows apart. A null text has no spans;
    null ids stay; other columns are not looked at. Texts of any length are
    searched whole; an empty table gives no rows.
    """
    text = F.col("text")
    picked = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"),
    )
    for k, proposal in enumerate(PROPOSALS):
        picked = picked.withColumn(f"m{k}", _matches(text, proposal))

    def cut(part: Column, i: Column) -> Column:
        return F.struct(
            F.length(part).alias("length"), F.right(part, F.lit(CONTEXT_BEFORE)).alias("before"),
            F.left(part, F.lit(CONTEXT_AFTER)).alias("after"),
        )

    found = store_stage(picked.select(
        "row", "doc_id",
        *(
            F.when(
                F.size(f"m{k}") > 0,
                F.arrays_zip(
                    F.col(f"m{k}").alias("match"),
                    F.transform(_parts(text, proposal), cut).alias("part"),
                ),
            ).alias(f"p{k}")
            for k, proposal in enumerate(PROPOSALS)
        ),
    ), "proposals")
    entries = found.select(
        "row", "doc_id",
        F.explode(F.filter(F.array(*(
            F.struct(F.lit(k).alias("proposal"), F.col(f"p{k}").alias("entries"))
            for k in range(len(PROPOSALS))
        )), lambda x: x["entries"].isNotNull())).alias("p"),
    ).select(
        "row", "doc_id", "p.proposal", F.posexplode("p.entries").alias("at", "e"),
    ).select(
        "row", "doc_id", "proposal", "at",
        # arrays_zip names its fields by position.
        F.col("e")["match"].alias("match"), F.col("e")["part"].alias("part"),
    )
    order = "PARTITION BY row, proposal ORDER BY at"
    placed = entries.select(
        "*",
        F.expr(
            f"CAST(sum(part.length + coalesce(length(match), 0)) OVER ({order}) AS BIGINT)"
        ).alias("stop"),
        F.expr(f"lead(part.after) OVER ({order})").alias("after"),
    ).where("match IS NOT NULL")
    confirmed = F.lit(False)
    kind, base = F.lit(None).cast("string"), F.lit(False)
    for k, proposal in enumerate(PROPOSALS):
        own = F.col("proposal") == k
        confirmed = F.when(
            own, _confirmed(proposal, F.col("match"), F.col("part.before"), F.col("after"))
        ).otherwise(confirmed)
        kind = F.when(own, F.lit(proposal.kind)).otherwise(kind)
        base = F.when(own, F.lit(proposal.base)).otherwise(base)
    spans = placed.where(confirmed).select(
        "row", "doc_id", kind.alias("kind"), base.alias("base"),
        (F.col("stop") - F.length("match")).alias("start"), F.col("stop").alias("end"),
    )
    # Base spans of one kind do not overlap: the nearest ones tell all.
    by_start = "PARTITION BY row, kind ORDER BY start, NOT base"
    alone = spans.select(
        "*",
        F.expr(
            f"max(CASE WHEN base THEN end END) OVER ({by_start} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        ).alias("base_end"),
        F.expr(
            f"lead(CASE WHEN base THEN start END) IGNORE NULLS OVER ({by_start})"
        ).alias("base_start"),
    ).where("base OR (coalesce(base_end, 0) <= start AND coalesce(base_start, end) >= end)")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    gathered = alone.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sort_array(F.collect_list(
            F.struct(rank.alias("rank"), "start", "end", "base", "kind")
        )).alias("spans"),
    )
    # Rows without a proposal, or with none confirmed, have no spans.
    rest = found.select("row", "doc_id").join(gathered.select("row"), "row", "left_anti")
    return gathered.unionByName(rest, allowMissingColumns=True)


def span_digests(spans: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) from
    ``find_spans``."""
    def joined(found: Column) -> Column:
        return F.array_join(
            F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    spans = spans.withColumn("base", F.filter("spans", lambda s: s["base"]))

    def count(kind: str) -> Column:
        return F.size(F.filter(F.coalesce("base", F.array()), lambda s: s["kind"] == kind))

    return spans.select(
        "doc_id",
        *(count(kind).cast("bigint").alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(F.coalesce(joined(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(joined(F.col("spans")), F.lit("")).alias("spans"),
    )


# What is masked: proposals that may hold others first, base proposals before
# the added ones of their kind, so that no part of a confirmed one is left.
MASK_ORDER = (0, 8, 6, 1, 2, 4, 3, 7, 5)


def mask(text: Column, proposal: Proposal) -> Column:
    """The text with confirmed matches replaced by their kind in brackets."""
    label = F.lit(f"[{proposal.kind.upper()}]")
    parts = _parts(text, proposal)
    pairs = F.zip_with(
        F.arrays_zip(
            parts.alias("part"), F.concat(F.array(F.lit("")), parts).alias("unused"),
            F.slice(parts, 2, 1 << 30).alias("next"),
        ),
        F.regexp_extract_all(text, F.lit(proposal.pattern), F.lit(0)),
        lambda p, match: F.concat(
            F.coalesce(p["part"], F.lit("")),
            F.when(
                _confirmed(
                    proposal, match, F.right(p["part"], F.lit(CONTEXT_BEFORE)),
                    F.left(p["next"], F.lit(CONTEXT_AFTER)),
                ), label,
            ).otherwise(F.coalesce(match, F.lit(""))),
        ),
    )
    return F.when(text.rlike(proposal.needs), F.array_join(pairs, "")).otherwise(text)


def mask_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with confirmed personal data in ``text`` replaced by its kind in
    brackets, all other columns as they are, whatever their names. Null texts
    stay null and empty ones empty; texts of any length are masked whole; of
    overlapping spans the one masked first wins; repeated rows are masked alike;
    an empty table gives no rows."""
    for k in MASK_ORDER:
        docs = docs.withColumn("text", mask(F.col("text"), PROPOSALS[k]))
    return docs
