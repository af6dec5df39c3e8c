"""Cross-tokenizer alignment, token counts and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recjobs.functions.storage import new_folder
from recjobs.llm import alignment, importance, token_counts as counts
from recjobs.llm.queries import tokenizer_path

A, B, WORDS = (tokenizer_path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, content string, n_tokens int, pairs string, block int, rank int"
ODD = [
    None, "", " ", "\n", "  \n\t x", "one", "one", "it's we'll  two   words ", "tab\there\r\nand there", "é ü ñ 日本語 🙂 naïve café", "a   b　 c   d\u0085 e",
    "x<|endoftext|>y </s> <s> <unk> <0x41>", "a ▁ mark", "\x00 nul \x01", "x" * 3000, "日本語" * 500, "a b a b a b " * 60, "1234567890 12-34, 5.6!?", "Ünïcödé İstanbul ß ﬁ", "\n\n\n a\n\n b \n",
]


def texts(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgéñ日", k=rng.randint(1, 9))) for _ in range(200)]
    return ODD + [rng.choice([" ", "\n", ", ", "  "]).join(rng.choices(vocabulary, k=rng.randint(1, 80))) for _ in range(n)] + [" ".join(rng.choices(vocabulary, k=5_000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts(), 1))
    rows += [rows[30], (None, "no id here"), (3, "a second text of an id")]
    return spark.createDataFrame([(i, t, "en", "c", 1, "p", 1, 1) for i, t in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- alignment


def plain_alignment(rows):
    """Each row's expected columns, by plain loops over bytes."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    per_row = []
    for text in rows:
        ids = [[], []]
        joined = b""
        if text:
            joined = (" " + text).encode()
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            x_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
            y_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(x_bytes) == joined == b"".join(y_bytes):
                ids = [x, y]
        spans = []
        for tokens, pieces in zip(ids, ([] if not ids[0] else x_bytes, [] if not ids[1] else y_bytes)):
            ends = np.cumsum([len(p) for p in pieces]).tolist()
            spans.append(list(zip(tokens, [0, *ends[:-1]], ends)))
        shared = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = [[[], []] for _ in shared]
        for k, side in enumerate(spans):
            for i, _, e in side:
                groups[bisect_left(shared, e)][k].append(i)
        links, near = [], 0
        for i, s, e in spans[0]:
            while near < len(spans[1]) and spans[1][near][2] <= s:
                near += 1
            k = near
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        told = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        per_row.append((len(ids[0]), len(ids[1]), len(groups), links, told))
    held = Counter(p for _, _, _, links, _ in per_row for p in set(links))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [(na, nb, g, len(ls), sum(held[p] == most[p[0]] for p in ls), sum(held[p] for p in ls), hashlib.sha256(t.encode()).hexdigest() if t else "") for na, nb, g, ls, t in per_row], [t for *_, t in per_row]


@pytest.mark.parametrize("block, part", [(alignment.BLOCK_BYTES, alignment.SLICE_BYTES), (1500, 200)])
def test_alignment_matches_plain_loops(spark, docs, monkeypatch, block, part):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, told = plain_alignment([t for _, t in rows])
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "SLICE_BYTES", part)
    got = alignment.align_tokenizers(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(i, *w) for (i, _), w in zip(rows, want)], key=key)
    groups = alignment.aligned_groups(docs, A, B).collect()
    assert sorted((str(r["doc_id"]), r["groups"]) for r in groups) == sorted((str(i), t) for (i, _), t in zip(rows, told))


def test_alignment_of_empty_tables(docs, empty):
    assert alignment.align_tokenizers(empty, A, B).collect() == []
    silent = alignment.align_tokenizers(docs.filter("text is null or text = ''"), A, B).collect()
    assert silent and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in silent)


def test_stretches_encode_as_whole_texts():
    rng = random.Random(9)
    alphabet = ["a", "B", "7", " ", " ", "\n", "\t", "'s", "'", "é", "日", " ", "\u0085", " ", "　", " ", " ", "。", "-", "🙂", "\x1c", "\x00", "<|endoftext|>"]
    held = ["".join(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(4000)]
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    data = "".join(held).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in held)])
    ids, n = alignment.ByteLevelEncoder(A).encode(np.frombuffer(data, np.uint8), offsets)
    want = [e.ids for e in library.encode_batch(held, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_union_find_against_a_plain_one():
    rng = random.Random(2)
    for _ in range(30):
        n = rng.randint(1, 60)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 60))]
        label = list(range(n))
        for _ in range(n):
            for u, v in edges:
                label[u] = label[v] = min(label[u], label[v])
        u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        assert alignment.union_find(n, u, v).tolist() == label


# --- token counts


@pytest.mark.parametrize("path", [A, B, WORDS])
def test_counts_match_the_library(spark, docs, path):
    cache = new_folder(spark, "cache")
    rows = docs.collect()
    if path == B:
        library = sentencepiece.SentencePieceProcessor(model_file=B)
        want = [len(library.encode(r["text"] or "")) for r in rows]
    else:
        want = [len(Tokenizer.from_file(path).encode(r["text"] or "", add_special_tokens=False).ids) for r in rows]
    expected = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), n, n > 50) for r, n in zip(rows, want))
    for known in (False, True):  # the second run takes all from the cache
        got = counts.token_counts(docs, path, cache, limit=50).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == expected
        assert {r["cached"] for r in got} == {known}


def test_only_misses_are_encoded_and_appended(spark, docs):
    cache, version = new_folder(spark, "cache"), counts.tokenizer_digest(B)
    first = docs.filter("doc_id % 2 = 0")
    counts.token_counts(first, B, cache).count()
    contents = lambda d: d.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("content")).distinct().count()
    assert spark.read.parquet(cache).count() == contents(first)
    # counts that are stored are believed: a changed one shows that its text isn't encoded again
    held = spark.read.parquet(cache)
    other = new_folder(spark, "cache")
    held.withColumn("n_tokens", F.lit(1_000_000).cast("long")).write.partitionBy("tokenizer").parquet(other)
    got = counts.token_counts(docs, B, other)
    rows = got.collect()
    assert {r["doc_id"] for r in rows if r["n_tokens"] == 1_000_000} >= {r["doc_id"] for r in first.collect()}
    assert spark.read.parquet(other).count() == contents(docs)
    # another tokenizer's counts are no hits
    assert not any(r["cached"] for r in counts.token_counts(docs, A, other).collect())
    assert counts.stored_counts(spark, other, version).count() == contents(docs)


def test_counts_of_an_empty_table(spark, empty):
    cache = new_folder(spark, "cache")
    assert counts.token_counts(empty, B, cache).collect() == []
    assert counts.stored_counts(spark, cache, counts.tokenizer_digest(B)).count() == 0


# --- importance resampling


def plain_importance(rows, target, n, buckets, share, least, seed):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    def features(t):
        w = split(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        if i is None:
            h = int(hashlib.sha256(f"{seed}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(split(text)) >= least])
    asked = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(asked[: share * len(asked) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("n, buckets, size", [(2, 10_000, 1 << 22), (2, 50, 300), (3, 997, 2000), (1, 10, 1 << 22)])
def test_importance_matches_plain_loops(spark, docs, monkeypatch, n, buckets, size):
    monkeypatch.setattr(importance, "SLICE_BYTES", size)
    target = [None, "", *texts(8, 4)[20:]]
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = importance.importance_resampling(docs, aim, n=n, buckets=buckets, share=40)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_importance(rows, target, n, buckets, 40, 20, 7), key=key)


def test_importance_of_empty_tables(spark, docs, empty):
    assert importance.importance_resampling(empty, docs).collect() == []
    got = importance.importance_resampling(docs, empty).collect()
    assert len(got) == docs.count() and {r["weight"] for r in got if not r["n_features"]} == {0}


def test_suffix_array_against_sorting():
    rng = random.Random(4)
    for depth in (1, 2, 3, 5):
        ids = np.array([rng.randrange(4) for _ in range(200)])
        order = importance.suffix_array(ids, depth)
        told = [ids[i : i + depth].tolist() for i in order]
        assert sorted(order.tolist()) == list(range(200)) and told == sorted(told)
        shared = importance.common_prefixes(ids, order, depth)
        for k in range(1, 200):
            same = 0
            while same < min(len(told[k]), len(told[k - 1])) and told[k][same] == told[k - 1][same] > 0:
                same += 1
            assert shared[k] == same
