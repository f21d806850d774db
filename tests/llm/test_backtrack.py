import hashlib
import random

import public_tokenizers
import pyarrow.parquet as pq
from brute import DOCS, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packetlake.llm import backtrack

PATH = public_tokenizers.path("word_bpe_49k.json")


def random_texts():
    draw = random.Random(4)
    odd = [*"abZ é'\n\t_-#1²½٣中😀ΣİſŉǅK", "  ", "'ll", "'S", "\x1c", "\x85", " ", "́",
           "<|endoftext|>", "<|startoftext|>", "</w>", "가", "ﷺ"]
    for k in range(2000):
        yield "".join(draw.choices(odd if k % 2 else "aaabbceinthorsl", k=draw.randint(0, 40)))


def judge():
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    return library


def test_words_equal_the_library():
    coder, library = backtrack.WordBpe(PATH), judge()
    texts = [*random_texts(), *(row[1] or "" for row in DOCS)]
    texts += [f"a{chr(c)}B{chr(c)}" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text).tolist() == ids
        assert coder.decode(coder.encode(text)).decode() == library.decode(ids, skip_special_tokens=False)


def test_compatible_pairs_are_what_merging_both_leaves():
    coder, library = backtrack.WordBpe(PATH), judge()
    draw = random.Random(1)
    texts = {i: library.id_to_token(i) for i in range(512, 49_406)}
    inner = [i for i, t in texts.items() if t.isascii() and t.isalpha()]
    last = [i for i, t in texts.items() if t.endswith("</w>") and t[:-4].isascii() and t[:-4].isalpha()]
    for _ in range(3000):
        a, b = draw.choice(inner), draw.choice(last)
        merged = library.encode(texts[a] + texts[b][:-4], add_special_tokens=False).ids
        assert coder.compatible(a, b) == (merged == [a, b])


def test_query_rows_equal_the_library(spark):
    library = judge()
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    rows = [(*row[:2], "en", "s", 1) for row in DOCS]
    rows += [(k, t, "en", "s", 1) for k, t in zip(table["doc_id"], table["text"], strict=True)]
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((
            doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest(),
        ))
    docs = documents(spark, rows)

    def key(row):
        return (row[0] is not None, row[0] or 0, row[2])

    got = [tuple(r) for r in backtrack.round_trip(docs, PATH).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    texts = backtrack.decode_ids(backtrack.encode_texts(docs, PATH), PATH)
    again = texts.select(F.sha2("text", 256)).collect()
    assert sorted(r[0] for r in again) == sorted(row[3] for row in want)
    assert backtrack.round_trip(docs.limit(0), PATH).count() == 0
