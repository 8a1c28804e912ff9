import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F
from test_ops import ODD, empty_docs, odd_docs

from lurewatch.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def by_hand(docs, target, percent=10, least=20, seed=2024):
    """(doc_id, n_features, weight, score, rank) of every row, in order; docs: (doc_id, text)."""
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    feats = [[bucket(w) for w in WORD.findall(lower(t))] for _, t in docs]
    s, t = Counter(b for f in feats for b in f), Counter(bucket(w) for x in target for w in WORD.findall(lower(x)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    rows = []
    for (i, _), f in zip(docs, feats, strict=True):
        w = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(tuple, rows), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_resampling_brute_force(spark):
    docs = [(i, " ".join(f"Wörd{(i * k) % 97} the{k % (1 + i % 7)}" for k in range(i % 60))) for i in range(400)]
    target = ["the0 the1 wörd3 wörd5 " * 5, None, ""]
    df, other = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    for percent, least in ((10, 20), (100, 0), (0, 20), (50, 1)):
        got = rows_of(resampling.resample(df, other, percent, least))
        assert got == by_hand(docs, [t or "" for t in target], percent, least)


def test_ties_repeated_ids_and_null_ids(spark):
    docs = [(7, "a b c d " * 6)] * 40 + [(None, "a b c d " * 6)] * 40 + [(i, "x " * 30) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows_of(resampling.resample(df, df, 70))
    want = by_hand(docs, [t for _, t in docs], 70)
    assert got == want and sorted(r[4] for r in got if r[4]) == list(range(1, 85))


def test_odd_and_empty_tables(spark):
    got = resampling.resample(odd_docs(spark).selectExpr("*", "1 AS score", "2 AS rank", "3 AS _range", "4 AS bucket"), empty_docs(spark))
    assert rows_of(got) == by_hand([(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (None, "a b c d e f")], [])
    assert resampling.resample(empty_docs(spark), odd_docs(spark)).collect() == []


def test_words_are_ascii_letters_digits_and_all_beyond(spark):
    text = "\x00Ab-cd_9é\x7f日本。Ü z  [x]^`{y}~"
    n = spark.createDataFrame([(text,)], "text string").select(resampling.buckets(F.col("text")).alias("b")).first()["b"]
    assert n == [zlib.crc32(w.encode()) % 10_000 for w in WORD.findall(lower(text))] and len(n) == 6
