import base64
import hashlib
import json
import random
import textwrap
import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from brute import DOCS, base_spans, components, documents, fingerprint, measures
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packetlake.llm import bpe, html, language, licenses, packing, pii, quality, sharding, simhash, similar, topk
from packetlake.llm.common import connected_components

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


def rows_of(df):
    return [tuple(row) for row in df.collect()]


def fuzz_texts():
    draw = random.Random(3)
    letters = [*"abZ é'\n\t_-#1²½٣中😀", "  ", "'ll", "\x1c", "\x85", " ", "́", "<|endoftext|>"]
    return ["".join(draw.choices(letters, k=draw.randint(0, 30))) for _ in range(500)]


# --- 1 -----------------------------------------------------------------------


def test_encoding_equals_both_libraries():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    judge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    by_ranks = bpe.ByteBpe(bpe.read_ranks(RANKS), PATTERN)
    by_file = bpe.ByteBpe.from_tokenizer_file(JSON, PATTERN)
    for text in [*fuzz_texts(), *(row[1] or "" for row in DOCS)]:
        ids = by_ranks.encode(text).tolist()
        assert ids == judge.encode_ordinary(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert ids == by_file.encode(text).tolist()
        assert by_ranks.decode(np.array(ids, np.int64)) == text.encode()


def test_offsets_cover_split_characters():
    coder = bpe.ByteBpe(bpe.read_ranks(RANKS), PATTERN)
    for text in fuzz_texts():
        ids = coder.encode(text)
        first, end = coder.offsets(ids)
        for token, a, b in zip(ids, first, end, strict=True):
            data = coder.decode(np.array([token]))
            assert data in text[a:b].encode() and b > a
        assert not len(ids) or (first[0] == 0 and end[-1] == len(text))


def test_round_trip_of_awkward_rows(spark):
    out = rows_of(bpe.round_trip(documents(spark), RANKS, PATTERN).select("doc_id", "decoded_sha256", "exact"))
    assert Counter(out) == Counter(
        (row[0], hashlib.sha256((row[1] or "").encode()).hexdigest(), True) for row in DOCS
    )
    encoded = bpe.encode_texts(documents(spark), RANKS, PATTERN)
    decoded = {(r[0], bytes(r[1])) for r in bpe.decode_ids(encoded, RANKS, PATTERN).collect()}
    assert decoded == {(row[0], (row[1] or "").encode()) for row in DOCS}
    assert rows_of(bpe.round_trip(documents(spark, []), RANKS, PATTERN)) == []


# --- 2 -----------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    # A fifth of the rows hides its label and its host.
    hidden = F.col("doc_id") % 5 == 0
    blind = docs.withColumn("truth", F.col("lang")).withColumn("lang", F.when(~hidden, F.col("lang")))
    found = language.identify(language.evidence_rows(blind.drop("truth")))
    joined = found.join(blind.where(hidden).select("doc_id", "truth"), "doc_id")
    right, n = joined.agg(F.avg((F.col("language") == F.col("truth")).cast("int")), F.count("*")).first()
    assert n >= 190 and right > 0.98


def test_language_evidence(spark):
    en, de = "the house and the dog with the man " * 9, "das haus und der hund mit dem mann " * 9
    rows = [(k, en, "en", "a.com", 0) for k in range(30)] + [(100 + k, de, "de", "b.de", 0) for k in range(30)]
    rows += [(200, "in", None, "b.de", 0), (201, "in", None, "a.com", 0), (202, None, "en", None, 0),
             (203, "中文" * 50, None, "b.de", 0), (None, de, "fr", "b.de", 0), (204, de, None, "b.de", 0)]
    docs = documents(spark, rows)
    found = {r["doc_id"]: r for r in language.identify(language.evidence_rows(docs)).collect()}
    assert found[200]["language"] == "de" and found[201]["language"] == "en"
    assert not found[202]["kept"] and not found[203]["kept"] and found[203]["language"] == "und"
    assert found[None]["language"] == "de" and found[204]["posterior"] > 0.99
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2
    assert rows_of(language.identify(language.evidence_rows(documents(spark, [])))) == []


def test_pages_as_evidence(spark):
    page = spark.createDataFrame(
        [(1, "https://m.x.example.fr/p?q", '<!DOCTYPE html><html class="a" lang="fr-FR"><p>la</p></html>'),
         (2, None, None)], "page_id bigint, url string, html string",
    )
    assert rows_of(language.page_rows(page).select("host", "declared")) == [("m.x.example.fr", "fr"), ("", None)]
    assert [r[0] for r in page.select(language.suffix_of(F.lit("a.b.DE"))).collect()] == ["de", "de"]


def test_markup_suffix_and_host_disagree(spark):
    # The probe "in" is as frequent in both.
    texts = {"en": "the house in the dog with the man " * 9, "de": "das haus in der hund mit dem mann " * 9}

    def page(k, host, lang, text):
        mark = f' lang="{lang}"' if lang else ""
        return (k, f"https://{host}/p?q", f"<html{mark}><script>the dog and the man</script><p>{text}</p></html>")

    rows = [page(k, f"w{k}.de", "de", texts["de"]) for k in range(100)]
    rows += [page(100 + k, f"w{k}.com", "en", texts["en"]) for k in range(100)]
    rows += [page(200 + k, "own.de", "en", texts["en"]) for k in range(40)]
    rows += [
        page(300, "new.de", None, "in"), page(301, "new.com", None, "in"),  # the suffix alone
        page(302, "own.de", None, "in"),  # the host against its suffix
        page(303, "other.com", "de", "in"),  # markup against the suffix
        page(304, "w1.de", "de", texts["en"]),  # text against markup, host and suffix
        (305, None, None), (None, "https://own.de/", f"<html lang=de>{texts['de']}"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    docs = documents(spark, [(300, texts["de"], "de", "s", 0)])
    out = language.identify(language.all_rows(docs, pages), ("de", "en")).collect()
    assert len(out) == len(rows) + 1
    got = {r["page_id"]: r for r in out if r["doc_id"] is None}
    assert [got[k]["language"] for k in (300, 301, 302, 304, None)] == ["de", "en", "en", "en", "de"]
    assert got[303]["declared"] == "de" and got[303]["posterior"] < got[301]["posterior"]
    assert not got[305]["kept"] and got[305]["language"] == "und"
    assert [r["language"] for r in out if r["doc_id"] == 300] == ["de"]


def test_every_declared_language_is_kept(spark):
    ru, zh = "дом и собака с человеком в лесу ", "房子和狗与人在森林里走路"
    rows = [(k, ru * 5 + str(k), "ru-RU", "s", 0) for k in range(30)]
    rows += [(100 + k, zh * 8 + str(k), "ZH", "s", 0) for k in range(30)]
    rows += [(200 + k, "the house and the dog with the man " * 5, "en", "s", 0) for k in range(30)]
    rows += [(300, ru * 6, None, "s", 0), (301, zh * 6, "", "s", 0), (302, "ไทย" * 30, "th", "s", 0),
             (303, "ไทย" * 30, "und", "s", 0), (304, " ", "ja", "s", 0)]
    docs = documents(spark, rows)
    evidence = language.evidence_rows(docs)
    assert language.declared_languages(evidence) == ("en", "ru", "th", "zh")
    for languages in (None, language.declared_languages(evidence, 3), ("en", "ru", "zh")):
        got = {r["doc_id"]: r["language"] for r in language.identify(evidence, languages).collect()}
        assert [got[k] for k in (0, 100, 200, 300, 301, 302, 304)] == ["ru", "zh", "en", "ru", "zh", "th", "und"]
    assert got[303] == "und"
    assert language.declared_languages(evidence, least=2) == ("en", "ru", "zh")
    kept = {r["doc_id"] for r in language.keep_identified(docs).collect()}
    assert kept >= {k for k, *_ in rows if k < 303} and 304 not in kept
    # No declared language at all: all texts are taken at their word.
    assert [r["kept"] for r in language.identify(evidence.where("doc_id = 302"), ()).collect()] == [True]


def test_the_query_reads_pages_and_documents(spark):
    from packetlake.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    out = QUERIES["op2_language_id"](spark, folder)
    found = out.where("doc_id IS NULL").join(
        spark.read.parquet(f"{folder}/pages.parquet").select("page_id", F.regexp_extract("html", 'lang="(..)', 1).alias("truth")),
        "page_id",
    )
    assert found.count() == 50 and out.where("page_id IS NULL").count() == 200
    assert found.where("language = truth").count() >= 48


# --- 3 -----------------------------------------------------------------------


def test_pieces_of_awkward_rows(spark):
    docs = documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    pieces = packing.piece_digests(packing.pack_documents(docs, JSON, PATTERN)).collect()
    library = Tokenizer.from_file(JSON)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    texts = {row[0]: row[1] or "" for row in DOCS if row[0] is not None}
    assert by_doc.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 2048 or at & (at - 1) == 0
    assert rows_of(packing.pack_documents(documents(spark, []), JSON, PATTERN)) == []


def test_level_is_the_one_of_the_smallest_sum_of_squares():
    draw = random.Random(1)
    for _ in range(300):
        packer = packing.SumOfSquaresPacker(16)
        packer.counts[1:16] = [draw.choice([0, 0, 1, 2, 5]) for _ in range(15)]
        size = draw.randint(1, 16)

        def after(level):
            counts = packer.counts.copy()
            counts[level] -= level > 0
            counts[level + size] += level + size < 16
            return sum(int(n) ** 2 for n in counts[1:16])

        levels = [h for h in range(16 - size + 1) if h == 0 or packer.counts[h]]
        assert packer.level_for(size) == min(levels, key=lambda h: (after(h), -h))


def test_open_windows_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "OPEN_WINDOWS", 8)
    packer, done = packing.SumOfSquaresPacker(64), []
    for k in range(500):
        done += packer.add(packing.Piece(k, 0, np.full(40, k, np.uint32), 40))
        assert packer.n_open <= 8
    done += packer.finish()
    assert sum(w.level for w in done) == 500 * 40
    assert Counter(int(x) for w in done for p in w.pieces for x in p.ids) == {k: 40 for k in range(500)}


# --- 4 -----------------------------------------------------------------------


def test_measures_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (9, None)], "doc_id bigint, quality int")
    out = quality.judge(documents(spark), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    want = []
    for row in DOCS:
        m = measures(row[1])
        want.append((row[0], *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert Counter(rows_of(out)) == Counter(want)
    assert rows_of(quality.judge(documents(spark, []), labels)) == []


def test_binomial_bound_is_exact(spark):
    cases = [(k, n) for n in (1, 20, 400) for k in range(0, min(n, 9))]
    df = spark.createDataFrame(cases, "k bigint, n bigint")
    got = df.select("k", "n", quality.binomial_cdf(F.col("k"), F.col("n"), 0.03)).collect()
    for k, n, p in got:
        exact = sum(comb(n, i) * 0.03**i * 0.97 ** (n - i) for i in range(k + 1))
        assert p == pytest.approx(exact, rel=1e-9)


def test_cutoffs_keep_good_documents(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    noisy = " ".join(f"w{i}$$$$" for i in range(60))
    rows = [(k, prose, "en", "s", 0) for k in range(2000)] + [(5000 + k, noisy, "en", "s", 0) for k in range(50)]
    rows += [(9000, noisy, "de", "s", 0), (9001, noisy, None, "s", 0)]
    labels = spark.createDataFrame([(k, 1) for k in range(2000)], "doc_id bigint, quality int")
    docs = documents(spark, rows)
    judged = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert all(judged[k]["kept"] for k in range(2000))
    assert not any(judged[5000 + k]["kept"] for k in range(50)) and judged[5000]["rejected_by"] == "symbols"
    # No labels, no certificate, no rejection.
    assert judged[9000]["kept"] and judged[9001]["kept"]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 2002


def test_a_few_hundred_labels_certify_jointly(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    noisy = " ".join(f"w{i}$" for i in range(60))
    rows = [(k, prose, lang, "s", 0) for lang, at, n in (("de", 0, 300), ("es", 1000, 150), ("fr", 2000, 50))
            for k in range(at, at + n)]
    rows += [(9000 + k, noisy, lang, "s", 0) for k, lang in enumerate(("de", "es", "fr"))]
    labels = spark.createDataFrame([(k, int(k < 9000)) for k, *_ in rows], "doc_id bigint, quality int")
    kept = {r["doc_id"] for r in quality.keep_good(documents(spark, rows), labels).collect()}
    assert kept == {k for k, *_ in rows} - {9000, 9001}
    # The loss of all rules together ends the sequence.
    steps = [("en", j, rule, cutoff, 1000, 0 if j < 30 else 25) for j, (rule, cutoff) in enumerate(quality.STEPS)]
    counts = spark.createDataFrame(steps, "stratum string, step int, rule string, cutoff int, n bigint, k bigint")
    assert quality.joint_cutoffs(counts).first()["cutoffs"] == {
        "symbols": 25, "shouts": 25, "capitals": 900, "repeats": 900,
    }


def test_a_failed_cutoff_ends_the_sequence(spark):
    rows = [("en", "symbols", 100_000, c, 90_000 if c == 300 else 0) for c in quality.CUTOFFS]
    counts = spark.createDataFrame(rows, "stratum string, rule string, n bigint, cutoff int, k bigint")
    assert quality.safe_cutoffs(counts).first()["cutoffs"] == {"symbols": 400}


# --- 5 -----------------------------------------------------------------------

PAGE = """<html><head><title>t</title></head><body class="page no-sidebar"><header><h2>Site</h2></header>
<nav><a href=/>Home</a></nav><div class="cookie-notice"><div>We use</div> cookies</div><main><article>
<h1>A &amp; B</h1><p>First   line<br>goes on</p><aside>side</aside><div class="ad-slot"><p>Buy</p></div>
<script>var x = "<p>no</p>";</script><form><p>Name <input></p></form><ul><li>one<li>two &eacute;</ul>
<blockquote>quoted</blockquote></article><section id="comments"><article class="comment"><p>nice post, I like
 this very much indeed, thank you for writing it all down here</p></article></section></main>
<footer>&copy; x</footer></body></html>"""


def test_main_text_of_an_article():
    assert html.main_text(PAGE) == "A & B\n\nFirst line goes on\n\none\n\ntwo é\n\nquoted"


def test_surge_and_dive_without_a_declared_article():
    body = "<p>" + "Sentence of the text. " * 10 + "</p>"
    links = "".join(f"<div><a href=x>Link {i}</a></div>" for i in range(9))
    text = html.main_text(f"<div>{links}</div><h1>Title</h1>{body}{body}<div>{links}</div>")
    assert text.split("\n\n")[0] == "Title" and "Link" not in text and text.count("Sentence") == 20
    assert html.text_spans([0, 10, 200, 0, 0, 0, 5, 0]) == [(1, 3)]


def test_short_tails_lists_and_link_paragraphs():
    body = "Sentence of the text. " * 9
    links = "".join(f"<div><a href=x>Link {i}</a></div>" for i in range(6))
    parts = ["Title", "By A. Writer", body, "<a href=x>a paragraph that is one link</a>", body, "one", "two", "three",
             "four", "Heading", "Thntst ndonre the."]
    page = links + "".join(f"<p>{part}</p>" for part in parts) + links + "<div>Imprint</div>"
    clean = [*parts[:3], "a paragraph that is one link", *parts[4:]]
    assert html.main_text(page).split("\n\n") == [part.strip() for part in clean]
    # A declared article that holds the lead only.
    lead = f"{links}<article><p>The lead.</p></article>{links}<div><p>{body}</p><p>{body}</p><p>Short.</p></div>{links}"
    assert html.main_text(lead).split("\n\n") == ["The lead.", body.strip(), body.strip(), "Short."]
    # Two stretches with links between them.
    two = f"<p>{body}</p>{links}<p>Next</p><p>{body}</p>"
    assert html.main_text(two).split("\n\n") == [body.strip(), "Next", body.strip()]


def test_article_sections_with_furniture_words_stay():
    page = ('<article><h2 id="related-work">Related work</h2><section id="search-and-rescue"><p>Rescue</p></section>'
            '<p id="social-history">History</p><p class="comment-on-results">Results</p><p>Before <svg/>mid '
            '<math/>after</p><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be<svg viewBox="0 0" /></p>'
            '<svg><text>no</text></svg><p>End</p><div class="share-buttons">Share</div><div class="ad">Buy</div>'
            '<div id="comment-7">nice</div><div role="search">Find</div></article>')
    assert html.main_text(page).split("\n\n") == [
        "Related work", "Rescue", "History", "Results", "Before mid after", "Let x=1 be", "End",
    ]


def test_awkward_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p"), (4, "u", "plain " * 40), (4, "u", "plain " * 40),
            (5, "u", "<article>" + "<p>x" * 20000), (6, "u", "<!-- open"), (7, "u", '<a href="' * 50)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    out = rows_of(html.extract_text(df))
    assert len(out) == len(rows) and all(n == len(t) for _, _, t, n in out)
    texts = dict((r[0], r[2]) for r in out)
    assert texts[1] == texts[2] == "" and texts[4] == ("plain " * 40).strip() and texts[5].count("x") == 20000


def test_all_pages_of_the_small_table(spark):
    import html as references
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract_text(pages).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*?)</article>", page["html"], re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h\d|div|ul|li)\b[^>]*>", article.replace("<br>", " "))
        clean = [re.sub(r"\s+", " ", references.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in blocks]
        assert got[page["page_id"]] == "\n\n".join(filter(None, clean))


# --- 6 -----------------------------------------------------------------------


def test_fingerprints_and_components(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    awkward = documents(spark).where("doc_id IS NOT NULL").select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    rows = sorted(rows_of(docs.union(awkward)), key=lambda r: r[0])
    prints = [fingerprint(text) for _, text in rows]
    roots = components(prints)
    want = Counter((rows[i][0], prints[i], rows[roots[i]][0]) for i in range(len(rows)))
    got = rows_of(simhash.near_duplicates(docs.union(awkward)))
    assert Counter((d, f % 2**64, c) for d, f, c in got) == want


def test_links_lose_no_pair(spark):
    draw = random.Random(5)
    values = set()
    for _ in range(150):
        centre = draw.getrandbits(64)
        for _ in range(4):
            flipped = centre
            for bit in draw.sample(range(64), draw.randint(0, 6)):
                flipped ^= 1 << bit
            values.add(flipped - (1 << 64) * (flipped >> 63))
    df = spark.createDataFrame([(v,) for v in values], "fingerprint bigint")
    want = {
        (a, b) for a in values for b in values
        if a < b and ((a ^ b) % 2**64).bit_count() <= 4
    }
    assert set(rows_of(simhash.links(df))) == want and len(want) > 200


def test_components_of_chains_and_nulls(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = dict(rows_of(connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter([1, 2, 5, None, 8, 9, 10])
    assert simhash.keep_one(documents(spark, []), simhash.near_duplicates(documents(spark, []))).count() == 0


def jaccard(one, other):
    one, other = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (one.split(), other.split()))
    return len(one & other) / len(one | other)


def test_edited_copies_are_near_copies(spark):
    draw = random.Random(8)
    rows, links, near = [], [], 0
    for k in range(150):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(60, 400))]
        copy = list(words)
        for at in draw.sample(range(len(words)), max(1, len(words) // draw.randint(30, 90))):
            copy[at] = "edited"
        one, other = " ".join(words), " ".join(copy)
        rows += [(2 * k, one, "en", "s", 0), (2 * k + 1, other, "en", "s", 0)]
        links.append(jaccard(one, other) >= 0.8)
        near += 0.8 <= jaccard(one, other) < 0.95
    docs = documents(spark, rows)
    got = dict(rows_of(similar.near_copies(docs)))
    assert [got[2 * k + 1] == 2 * k for k in range(150)] == links
    assert all(got[2 * k] == 2 * k for k in range(150)) and near > 40 and not all(links)
    import corpus_pipeline

    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 300 - sum(links)


def test_near_copies_of_awkward_rows_and_chains(spark):
    got = Counter(rows_of(similar.near_copies(documents(spark))))
    assert got == Counter([
        (1, 1), (6, 1), (6, 1), (2, 2), (3, 2), (4, 2), (5, 5), (None, None), (8, 8), (9, 9), (10, 10),
    ])
    assert rows_of(similar.near_copies(documents(spark, []))) == []
    # A chain whose ends are not alike is one component, a null id in it too.
    base = [f"w{i}" for i in range(400)]
    rows = [(k or None, " ".join(base[12 * k:12 * k + 300]), "en", "s", 0) for k in range(8)]
    assert set(rows_of(similar.near_copies(documents(spark, rows)))) == {(k or None, 1) for k in range(8)}


# --- 7 -----------------------------------------------------------------------


def test_spans_of_awkward_rows(spark):
    out = pii.span_digests(pii.find_spans(documents(spark))).collect()
    assert len(out) == len(DOCS)
    texts = {row[0]: row[1] for row in DOCS}
    for row in out:
        base = base_spans(texts[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(row["spans"].split(",")) | set()
        assert [row[f"n_{k}"] for k in pii.BASE_KINDS] == [
            sum(s.startswith(k + ":") for s in base) for k in pii.BASE_KINDS
        ]
    kinds = Counter(s.split(":")[0] for row in out if row["doc_id"] == 9 for s in row["spans"].split(","))
    assert kinds["iban"] == 1 and kinds["secret"] == 1 and kinds["card"] == 2 and kinds["phone"] == 2
    assert rows_of(pii.find_spans(documents(spark, []))) == []


def test_masking_leaves_nothing(spark):
    docs = documents(spark)
    masked = pii.mask_documents(docs)
    assert masked.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert got[2] is None and got[3] == "" and got[1] == DOCS[0][1] and got[8] == DOCS[8][1]
    assert base_spans(got[9]) == [] and "9233a8" not in got[9] and "WEST" not in got[9]
    assert "[EMAIL]" in got[9] and "[PHONE]" in got[9] and "300.1.1.1" in got[9]


def test_masking_leaves_no_digit_of_a_base_phone(spark):
    texts = ["tel +49 (30) 1234 5678 90 now", "ssn +1 123-45-6789 now", "call +1 (017) 555-7713 or +1 (136) 555-7479."]
    docs = documents(spark, [(k, text, "en", "s", 0) for k, text in enumerate(texts)])
    got = {r["doc_id"]: r["text"] for r in pii.mask_documents(docs).collect()}
    assert got == {0: "tel [PHONE] now", 1: "ssn [PHONE] now", 2: "call [PHONE] or [PHONE]."}


def test_checksums(spark):
    df = spark.createDataFrame([("GB82 WEST 1234 5698 7654 32",), ("GB82 WEST 1234 5698 7654 33",)], "t string")
    assert [r[0] for r in df.select(pii.mod97(F.col("t"))).collect()] == [True, False]
    cards = spark.createDataFrame([("4539578763621486",), ("4539578763621487",)], "t string")
    assert [r[0] for r in cards.select(pii.luhn(F.col("t"))).collect()] == [True, False]


# --- 8 -----------------------------------------------------------------------


def best_products(rows):
    kept = [
        (i, v, np.floor(64 * np.array(e, np.float64)).astype(np.int64)) for i, (v, e) in enumerate(rows)
        if e is not None and all(x is not None and np.isfinite(x) for x in e)
    ]
    out = Counter()
    for i, q, a in kept:
        if q is None or q % 20:
            continue
        scored = sorted(
            (-int(sum(x * y for x, y in zip(a, b, strict=False))), v is None, v or 0)
            for j, v, b in kept if j != i
        )
        out.update((q, r + 1, None if null else v, -s) for r, (s, null, v) in enumerate(scored[:20]))
    return out


@pytest.mark.parametrize("spread", [0.0, 2.5])
def test_top_products_equal_brute_force(spark, spread):
    draw = np.random.default_rng(1)
    sizes = np.exp(spread * draw.standard_normal(300))
    vectors = (draw.standard_normal((300, 8)) * sizes[:, None]).round(2).astype(np.float32)
    rows = [(int(k), v.tolist()) for k, v in enumerate(vectors)]
    rows += [(20, rows[20][1]), (20, rows[20][1]), (400, None), (401, [1.0, None]), (420, [float("nan")] * 8),
             (440, [0.0] * 8), (None, rows[5][1]), (460, []), (480, [1.5, -2.0]), (461, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x"))
    assert Counter(rows_of(topk.top_products(df))) == best_products(rows)


def test_top_products_of_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, 0.5]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert Counter(rows_of(topk.top_products(df))) == best_products(rows)
    assert rows_of(topk.top_products(df.where("vec_id < 0"))) == []


def test_top_products_over_rounds_of_blocks(spark):
    assert [sum(last - first + 1 for _, first, last, _ in r) for r in topk.rounds_of([(3, 5, 9.0), (1, 6, 2.0)])] == [
        1, 1, 2, 4, 3
    ]
    draw = np.random.default_rng(4)
    vectors = draw.integers(-3, 4, (900, 5)).astype(np.float32) * draw.choice([0.25, 1.0, 8.0], (900, 1))
    rows = [(int(k) % 850, v.tolist()) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert Counter(rows_of(topk.top_products(df, block_rows=16))) == best_products(rows)


def test_blocks_meet_queries_without_a_broadcast(spark, capsys):
    # A small stored size says little about the memory of arrays of numbers.
    v = "transform(sequence(1, 8), x -> id % x) AS v"
    queries = spark.range(40).selectExpr("id AS row", "id AS vec_id", v, "4D AS norm", "CAST(NULL AS DOUBLE) AS bound")
    blocks = spark.range(40).selectExpr("id AS row", "id AS vec_id", v).groupBy(
        F.expr("INT(row % 1 + 3) AS level"), F.expr("INT(row % 2) AS block")
    ).agg(F.collect_list(F.struct("row", "vec_id", "v")).alias("candidates"))
    found = topk._round(queries, blocks, [(3, 0, 1, 9.0)], 2, 5)
    assert found.count() == 400
    found.explain()
    assert "Broadcast" not in capsys.readouterr().out


@pytest.mark.parametrize("step", [1, 16])
def test_coordinates_prune_only_what_no_query_needs(step, monkeypatch):
    # Half the queries have a large coordinate, which leaves few candidates.
    monkeypatch.setattr(topk, "PROBE_STEP", step)
    draw = np.random.default_rng(6)
    vectors = draw.integers(-20, 21, (400, 12))
    vectors[:60:2, 0] += 300
    vectors[60::20, 0] += 300

    def block(part, start, **more):
        values = pa.ListArray.from_arrays(np.arange(0, part.size + 1, 12, dtype=np.int32), pa.array(part.ravel()))
        ids = pa.array(np.arange(start, start + len(part)))
        columns = {"row": ids, "vec_id": ids, "v": values, **more}
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    asked, stored = vectors[:60], vectors[60:]
    products = asked @ stored.T
    bounds = np.sort(products, axis=1)[:, -5]
    pruned = []
    survivors = topk._survivors
    monkeypatch.setattr(topk, "_survivors", lambda *a: pruned.append(1) or survivors(*a))
    found = topk._score_block(block(asked, 0, bound=pa.array(bounds.astype(float))), block(stored, 60), 5).to_pylist()
    expected = [
        (i, 60 + int(j), int(products[i, j])) for i in range(60)
        for j in sorted(range(len(stored)), key=lambda j: (-products[i, j], j))[:5]
    ]
    assert sorted((r["query_row"], r["vec_id"], r["score"]) for r in found) == sorted(expected)
    assert 0 < len(pruned) < 60


def test_products_beyond_64_bits_end_there(spark):
    rows = [(0, [1e18, 1.0]), (1, [1e18, 2.0]), (2, [-1e18, 0.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = sorted(rows_of(topk.top_products(df)))
    most = (1 << 63) - 1
    assert [(r[2], r[3]) for r in found] == [(1, most), (3, most), (2, -most - 1)]


# --- 9 -----------------------------------------------------------------------


def test_license_texts_and_notices(spark):
    mit = dict(licenses.KNOWN_TEXTS[::-1])["MIT"]
    variant = "Copyright (c) 2020 Jane\n\n" + mit.upper().replace("LICENSE", "Licence").replace(" ", "  ")
    rows = [(1, variant), (2, "text\n* Released under the MIT licence!\nmore\nlicensed under CC BY-NC 4.0"),
            (3, None), (4, ""), (None, mit + " and more"), (5, "SPDX-License-Identifier:  Apache-2.0"), (5, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("license", F.lit(1))
    out = licenses.scan_licenses(docs, licenses.known_digests(spark)).drop("digest")
    assert Counter(rows_of(out)) == Counter([
        (1, "MIT", 0, ""), (2, None, 2, "CC-BY-NC-4.0,MIT"), (3, None, 0, ""), (4, None, 0, ""),
        (None, None, 0, ""), (5, "Apache-2.0", 1, "Apache-2.0"), (5, None, 0, ""),
    ])
    assert rows_of(licenses.scan_licenses(docs.limit(0), licenses.known_digests(spark))) == []


def test_licenses_however_they_are_wrapped(spark):
    texts = [(name, text) for name, text in licenses.KNOWN_TEXTS if len(text) > 300]
    head = ["", "Copyright (c) 2019-2021 Jane Doe\n\n", "Copyright © Acme\nAll rights\nreserved.\n",
            "(c) 2020 Jane\n", "Copyright <YEAR> <HOLDER>\n", "Copyright The Acme Authors\n"]
    rows = [
        (10 * k + j, head[j] + textwrap.fill(text, width, break_long_words=False), name)
        for k, (name, text) in enumerate(texts) for j, width in enumerate((40, 60, 72, 80, 33, 20))
    ]
    docs = spark.createDataFrame([row[:2] for row in rows], "doc_id bigint, text string")
    found = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(docs, licenses.known_digests(spark)).collect()}
    assert len(texts) > 3
    assert found == {row[0]: row[2] for row in rows}


# --- 10 ----------------------------------------------------------------------


def test_best_fit_is_the_tightest():
    draw = random.Random(2)
    for _ in range(50):
        sizes = sorted((draw.randint(1, 60) for _ in range(80)), reverse=True)
        rooms, want = [], []
        for size in sizes:
            fits = [(room, k) for k, room in enumerate(rooms) if room >= size]
            if not fits:
                rooms.append(100)
            k = min(fits)[1] if fits else len(rooms) - 1
            rooms[k] -= size
            want.append(k)
        got = sharding.best_fit(sizes, 100)
        assert len(set(got)) == len(set(want))
        fill = Counter()
        for size, number in zip(sizes, got, strict=True):
            fill[number] += size
        assert max(fill.values()) <= 100
        assert sorted(fill.values()) == sorted(100 - room for room in rooms)


def test_shards_of_awkward_rows(spark):
    got = sharding.assign_shards(documents(spark), 4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (row[0], len((row[1] or "").encode()) + 16, zlib.crc32((row[1] or "").encode())) for row in DOCS
    )
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= {0, 1, 2, 3}
    homes = defaultdict(set)
    for r in got:
        homes[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())
    assert rows_of(sharding.assign_shards(documents(spark, []))) == []


def test_shards_are_even(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sizes = [r[1] for r in sharding.assign_shards(docs).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 40 and max(sizes) <= 1.02 * min(sizes)


def test_a_group_above_an_even_share_has_its_own_shard():
    assert sharding.fit_shards([900, 40, 30, 30, 20, 20, 20], 3) == [0, 1, 2, 2, 2, 1, 1] or (
        Counter(sharding.fit_shards([900, 40, 30, 30, 20, 20, 20], 3))[0] == 1
    )


# --- pipeline ----------------------------------------------------------------


def test_pipeline_stages_keep_the_columns_and_mask_everything(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, folder)
        assert step.columns == docs.columns
    assert not any(base_spans(r["text"]) for r in step.collect())


def test_stages_take_awkward_documents(spark, tmp_path):
    import corpus_pipeline

    for rows in (DOCS, []):
        folder = tmp_path / str(len(rows))
        docs = documents(spark, rows)
        spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(
            str(folder / "labels.parquet")
        )
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(folder)).columns == docs.columns
            stage(spark, docs, str(folder)).count()
        corpus_pipeline.STAGES[-1][1](spark, docs, str(folder)).count()


def test_vocabulary_is_read_from_the_given_path():
    with open(JSON, encoding="utf-8") as file:
        assert len(json.load(file)["model"]["vocab"]) == len(bpe.read_ranks(RANKS))
