"""Components of documents whose word shingles are alike, by MinHash and exact
verification.

Documents of the same words are one class. Each class has a signature of minima
over permutations of its shingles, cut into bands; classes that share a band
meet. At similarity 0.8 a pair misses all bands with probability
(1 - 0.8 ** BAND_ROWS) ** BANDS, 2.7e-5. Every link is verified by the exact
Jaccard similarity of the two shingle sets; sizes that differ by more than the
similarity allows are no candidates.

Components need few of the links. Each band has a centre, the member whose bands
are the fullest: of many edits of one text it is the one closest to the text.
First each class is tried with the fullest of its centres, then with its others
where these are in different components. Bands that still hold several
components are searched by prefixes: two sets of similarity 0.8 share one of the
rarest fifth of their shingles, in any fixed order. So no pair that could join
two components is left out, and a large group of near copies costs about one
pair for each copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake.llm.common import connected_components
from packetlake.llm.simhash import SEED
from packetlake.session import drop_stages, store_stage

SHINGLE_WORDS = 5
# Least Jaccard similarity of a link, as a fraction.
SIMILAR, OF = 4, 5
BANDS = 20
BAND_ROWS = 4
# Pairs of one class that are verified by one task.
PAIRS_TOGETHER = 256
# Shingles permuted at a time.
BLOCK = 1 << 10

_draw = np.random.default_rng(SEED)
_MASKS = _draw.integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), np.uint64)
_FACTORS = _draw.integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> bytes:
    """The lower-cased words with one blank between them."""
    return b" ".join((text or "").encode("utf-8").lower().split())


def shingles(joined: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted digests of the different shingles; fewer words are one shingle."""
    tokens = joined.split(b" ")
    ends = np.cumsum([len(token) + 1 for token in tokens])
    starts = [0, *ends[:-words].tolist()] if len(tokens) > words else [0]
    stops = (ends[words - 1:] - 1).tolist() if len(tokens) >= words else [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts)
    ))


def band_keys(found: np.ndarray) -> list[int]:
    """A signed key for each band of the signature."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK):
        mixed = (found[None, at:at + BLOCK] ^ _MASKS) * _FACTORS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, same binary, size, bands array<bigint>) of each whole text;
    ``same`` is equal for texts of the same words, ``size`` counts the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [words_of(text.as_py()) for text in batch.column(1)]
            sets = [shingles(text, words) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(xxhash.xxh3_128_digest, texts), pa.binary()),
                 pa.array(map(len, sets), pa.int64()), pa.array(map(band_keys, sets), pa.list_(pa.int64()))],
                ["doc_id", "same", "size", "bands"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, same binary, size bigint, bands array<bigint>"
    )


def _common(one: np.ndarray, other: np.ndarray) -> int:
    """Values that two sorted sets share."""
    at = np.searchsorted(one, other)
    return int((one[np.minimum(at, len(one) - 1)] == other).sum())


def verified(pairs: DataFrame, texts: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """The pairs (a, b) whose shingle sets are at least SIMILAR / OF alike;
    ``texts`` is (node, text). The pairs of one ``a`` are dealt to several tasks,
    each of which gets its text."""
    parts = pairs.groupBy("a").agg(F.count("*").alias("n")).select(
        "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / PAIRS_TOGETHER))).alias("part"),
        F.floor(F.col("n") / PAIRS_TOGETHER).alias("last"),
    )
    dealt = pairs.join(parts.where("part = 0").select("a", "last"), "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("last") + 1).alias("part")
    )
    left = parts.select("a", "part").join(
        texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"
    )
    right = dealt.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(right, ["a", "part"]).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, own = None, None
        for batch in batches:
            links = []
            for a, b, text_a, text_b in zip(*batch.to_pydict().values(), strict=True):
                if a != node:
                    node, own = a, shingles(words_of(text_a), words)
                other = shingles(words_of(text_b), words)
                common = _common(own, other)
                if OF * common >= SIMILAR * (len(own) + len(other) - common):
                    links.append((a, b))
            columns = list(zip(*links, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def prefixes(texts: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(node, shingle, at): of each text as many of its rarest shingles among
    ``texts`` as it takes for alike sets to share one, with their places from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(*batch.to_pydict().values(), strict=True):
                found = shingles(words_of(text), words).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), node)), pa.array(found)], ["node", "shingle"]
                )

    found = texts.select("node", "text").mapInArrow(run, "node bigint, shingle bigint")
    counts = found.groupBy("shingle").agg(F.count("*").alias("n"))
    # A shingle of one text cannot be shared, but takes a place in its prefix.
    ranked = found.join(counts, "shingle").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("order")
    )
    size = F.size("order")
    length = size - F.ceil(F.lit(SIMILAR) * size / OF) + 1
    return ranked.select(
        "node", F.posexplode(F.slice("order", F.lit(1), length.cast("int"))).alias("at", "x")
    ).where("x.n > 1").select("node", F.col("x.shingle").alias("shingle"), (F.col("at") + 1).alias("at"))


def _alike_sizes(one: str, other: str):
    return (OF * F.least(one, other)) >= (SIMILAR * F.greatest(one, other))


def prefix_pairs(index: DataFrame) -> DataFrame:
    """(a, b), a < b, of different components whose prefixes share a shingle
    from which on enough can be common; ``index`` is (node, shingle, at, size,
    component).

    All that two sets share stands at or after the first shared place in both.
    So that place leaves at most 1 + least(size - at) common shingles; alike sets
    have SIMILAR / (SIMILAR + OF) of the two sizes' sum. Edits of one text that
    are too far from it to be alike to each other fail here, however many.
    """
    # Shingles whose texts are all in one component join nothing.
    across = index.groupBy("shingle").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low < high").select("shingle")
    # A place that is too late even beside a set of the least alike size.
    useful = (SIMILAR + OF) * (F.col("size") - F.col("at") + 1) >= SIMILAR * (
        F.col("size") + F.ceil(F.lit(SIMILAR) * F.col("size") / OF)
    )
    shared = index.where(useful).join(across, "shingle", "left_semi")
    one, other = (
        shared.select(
            "shingle", F.col("node").alias(end), F.col("component").alias(f"c{end}"),
            F.col("size").alias(f"n{end}"), (F.col("size") - F.col("at") + 1).alias(f"left_{end}"),
        ) for end in "ab"
    )
    enough = (SIMILAR + OF) * F.least("left_a", "left_b") >= SIMILAR * (F.col("na") + F.col("nb"))
    return (
        one.join(other, "shingle").where("a < b AND ca <> cb")
        .where(_alike_sizes("na", "nb")).where(enough).select("a", "b").distinct()
    )


def _placed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with their component over the links so far."""
    found = connected_components(edges)
    placed = store_stage(
        nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed"
    )
    drop_stages(found)
    return placed


def near_copies(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, component_id) for every document: the smallest doc_id reachable
    over links of similarity 0.8 or more; null where every document of a
    component has a null id. Wordless documents, null texts among them, are
    alike. Repeated rows and equal texts are one class, whatever their number;
    texts of any length are read whole. Other columns are not looked at, whatever
    their names. An empty table gives no rows."""
    marked = store_stage(sketches(docs, words), "sketches")
    classes = store_stage(
        marked.groupBy("same").agg(
            F.min("doc_id").alias("first_id"), F.first("size").alias("size"), F.first("bands").alias("bands")
        ).withColumn("node", F.monotonically_increasing_id()), "classes",
    )
    bands = classes.select("node", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    bands = store_stage(bands.join(shared, "key"), "bands")
    fullness = bands.groupBy("node").agg(F.sum("n").alias("score"))
    nodes = store_stage(
        classes.select("node", "same", "first_id", "size").join(fullness, "node"), "meeting-classes"
    )
    texts = store_stage(_texts_of(docs, nodes), "texts")

    members = bands.join(nodes.select("node", "score", "size"), "node").select("key", "node", "score", "size")
    centres = members.groupBy("key").agg(
        F.max(F.struct("score", "node", "size")).alias("centre")
    )
    stars = store_stage(
        members.join(centres, "key").where("node <> centre.node")
        .where(_alike_sizes("size", "centre.size"))
        .groupBy(F.col("centre.node").alias("a"), F.col("node").alias("b"))
        .agg(F.first("centre.score").alias("score")), "stars",
    )
    best = stars.groupBy("b").agg(F.max(F.struct("score", "a")).alias("best")).select(
        F.col("best.a").alias("a"), "b"
    )
    best = store_stage(best, "best")
    first = store_stage(verified(best, texts, words), "links")
    placed = _placed(nodes.select("node"), first)

    others = _across(stars.select("a", "b").join(best, ["a", "b"], "left_anti"), placed)
    second = store_stage(verified(others, texts, words), "links")
    drop_stages(placed)
    placed = _placed(nodes.select("node"), first.unionByName(second))

    inside = bands.select("key", "node").join(placed, "node")
    mixed = inside.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low < high").select("key")
    open_nodes = store_stage(
        inside.join(mixed, "key", "left_semi").select("node", "component").distinct()
        .join(nodes.select("node", "size"), "node"), "open-classes",
    )
    index = store_stage(
        prefixes(texts.join(open_nodes.select("node"), "node", "left_semi"), words).join(open_nodes, "node"),
        "prefixes",
    )
    rest = store_stage(prefix_pairs(index), "pairs")
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    third = store_stage(verified(rest.join(tried, ["a", "b"], "left_anti"), texts, words), "links")

    edges = first.unionByName(second).unionByName(third)
    joined = connected_components(edges)
    labelled = store_stage(
        classes.select("same", "first_id", "node").join(joined, "node", "left")
        .withColumn("component", F.coalesce("component", "node")), "labelled",
    )
    drop_stages(
        joined, first, second, third, placed, bands, nodes, texts, stars, best, open_nodes, index, rest, classes
    )
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(least, "component").select("same", "component_id")
    return marked.select("doc_id", "same").join(named, "same").select("doc_id", "component_id")


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text): one text of each class, found by an id of the class."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).join(
        nodes.where("first_id IS NOT NULL").select(F.col("first_id").alias("id")).distinct(), "id", "left_semi"
    ).select("text")
    nameless = docs.where("doc_id IS NULL").select(F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array((xxhash.xxh3_128_digest(words_of(t)) for t in texts), pa.binary()), batch.column(0)],
                ["same", "text"],
            )

    marked = named.unionByName(nameless).mapInArrow(run, "same binary, text string")
    return marked.join(nodes.select("node", "same"), "same").dropDuplicates(["node"]).select("node", "text")


def _across(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    return (
        pairs.join(placed.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a")
        .join(placed.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
        .where("ca <> cb").select("a", "b")
    )
