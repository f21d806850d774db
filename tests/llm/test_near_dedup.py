"""The pipeline's near_dedup goes by SimHash fingerprints and by similarity."""

import corpus_pipeline
from brute import documents
from packetlake.llm import simhash, similar


def test_documents_of_one_fingerprint_are_near_copies(spark):
    # A frequent shingle decides the fingerprint; the sets of shingles differ.
    alike = [" ".join(["a"] * 300 + [f"{name}{k}" for k in range(30)]) for name in "xy"]
    words = [f"w{k}" for k in range(300)]
    texts = [*alike, " ".join(words), " ".join([*words[:280], *["edited"] * 20]), "something else"]
    docs = documents(spark, [(k + 1, text, "en", "s", 0) for k, text in enumerate(texts)])
    by_sets = {r["doc_id"]: r["component_id"] for r in similar.near_copies(docs).collect()}
    by_print = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert by_sets[2] == 2 and by_print[2] == 1 and by_sets[4] == 3
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5]


def test_components_of_both_kinds_join(spark):
    docs = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 4, None)], "doc_id bigint")
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (4, 4), (None, 1)], "doc_id bigint, component_id bigint")
    other = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 4), (None, None)], "doc_id bigint, component_id bigint")
    found = corpus_pipeline.merged_components(docs, one, other).collect()
    assert sorted(map(tuple, found), key=str) == [(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (None, None)]
