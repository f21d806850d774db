"""Plain Python versions of the operators, and rows with awkward values."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash

WORD = r"[^\x20\x09-\x0D]+"
LONG = "lorem ipsum " * 20_000
DOCS = [
    (1, "The quick brown fox. " * 30, "en", "a.example.de", 7),
    (2, None, "en", None, None),
    (3, "", None, "", 0),
    (4, " \t\n", "xx", "a.example.de", 3),
    (5, LONG, "de", "b", 1),
    (6, "The quick brown fox. " * 30, "en", "a.example.de", 7),
    (6, "The quick brown fox. " * 30, "en", "a.example.de", 7),
    (None, "ein Text ohne Nummer", "de", "b", 1),
    (8, "a\na\nb\n\n\na # $ | <x>é\U0001f600 don't 12 \x1c\x85 ", "fr", "c", 9),
    (9, "mail x.y@example.org and a@b.c_z@q.r +1 (017) 555-7713 or +1 (136) 555-7479 190.1.2.3 "
        "card 4539578763621486 300.1.1.1 4539-5787-6362-1486, GB82 WEST 1234 5698 7654 32 "
        'token = "9233a8ecf7c5b09fe5949719b6b82bc439e93aa1"', "en", "c", 9),
    (10, "x" * 3000 + "@" * 50 + "1" * 3000 + "." * 20, "es", "c", 9),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns whose names the operators use themselves.
CLASHING = ("fingerprint", "row", "m", "ids", "digest", "kept", "n_words", "spans", "shard", "component_id")


def documents(spark, rows=DOCS):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING:
        df = df.withColumn(name, df["doc_id"].cast("string"))
    return df


def measures(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(repeated),
    )


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    text = text or ""

    def digits(m):
        return re.sub("[^0-9]", "", m)

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, pattern, valid in kinds for m in re.finditer(pattern, text) if valid(m[0])
    ]


def fingerprint(text):
    words = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(
        1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)
    )


def components(fingerprints):
    """Smallest position reachable over at most 4 differing bits."""
    values = np.array(fingerprints, np.uint64)
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, value in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values ^ value) <= 4):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(values))]
