import random
import re

import pytest
from brute import WORD, documents, measures

from packetlake.llm import similar


def shingle_set(text):
    words = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard_components(texts):
    """Smallest id reachable over pairs of similarity 0.8 or more, by all pairs."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: find(k) for k in ids}


def edits(draw, words, shares, n):
    """Texts with a share of the words of ``words`` replaced in a few places."""
    for _ in range(n):
        out = list(words)
        for _ in range(int(draw.choice(shares) * len(words))):
            out[draw.randrange(len(out))] = f"x{draw.randrange(10**6)}"
        yield " ".join(out)


def test_given_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(docs).collect()}
    assert got == jaccard_components(texts)


@pytest.mark.parametrize("shares", [[0.01, 0.015, 0.02], [0.02, 0.025, 0.04], [0.005, 0.06]])
def test_groups_of_edits_without_their_original(spark, shares):
    draw = random.Random(len(shares) + int(1000 * shares[0]))
    rows, at = [], 0
    for size in (150, 40):
        base = [f"w{draw.randrange(3000)}" for _ in range(300)]
        for text in edits(draw, base, shares, size):
            rows.append((at, text, "en", "s", 1))
            at += 1
    # A passage that many unlike texts share.
    passage = [f"p{i}" for i in range(60)]
    for _ in range(60):
        own = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([10, 30, 200]))]
        rows.append((at, " ".join(own + passage), "en", "s", 1))
        at += 1
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(documents(spark, rows)).collect()}
    want = jaccard_components({row[0]: row[1] for row in rows})
    assert len(set(want.values())) > 1
    assert got == want


def test_prefixes_of_alike_sets_meet(spark):
    draw = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    texts = dict(enumerate(edits(draw, base, [0.005, 0.01, 0.03], 60)))
    # Texts of other lengths, and far edits, that are alike to none.
    texts |= {100 + k: " ".join(base[:n]) for k, n in enumerate((85, 82, 80, 40))}
    texts |= {200 + k: t for k, t in enumerate(edits(draw, base, [0.04], 60))}
    sets = {k: shingle_set(t) for k, t in texts.items()}
    df = spark.createDataFrame([(k, t, len(sets[k]), k) for k, t in texts.items()], "node bigint, text string, size int, component bigint")
    index = similar.prefixes(df).join(df.select("node", "size", "component"), "node")
    met = {tuple(r) for r in similar.prefix_pairs(index).collect()}
    alike = {
        (a, b) for a in sets for b in sets
        if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    }
    assert alike and alike <= met
    assert len(met) < len(sets) * (len(sets) - 1) / 4


def test_pipeline_against_all_pairs(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    # 200 documents certify no cut-off, and all that pass are prose.
    passed = {
        k: t for k, t in texts.items()
        if not (measures(t)[0] < 50 or 100 * measures(t)[4] > 50 * measures(t)[0])
    }
    want = set(jaccard_components(passed).values())
    got = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == want
