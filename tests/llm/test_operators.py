"""Edge cases and brute-force comparisons of each operator."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from recjobs.llm import decontaminate, language, line_dedup, ngram_join, pieces, quality, sharding, token_planes, toxicity, warc
from recjobs.llm import components
from recjobs.llm.components import connected_components
from recjobs.llm.queries import tokenizer_path
from recjobs.llm.textvec import Texts, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, n int, label int, hashes string, vslot int, size int, line string"
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choices("abcdefghij", k=RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def edited(text, every, seed):
    rng, words = random.Random(seed), text.split()
    for i in range(rng.randrange(every), len(words), every):
        words[i] = "x" + words[i]
    return " ".join(words)


def edge_texts():
    base = prose(300, 1)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "two words"), (7, base), (8, base), (9, base.upper()),
        (10, edited(base, 60, 2)), (11, edited(base, 12, 3)), (12, prose(300, 4)), (13, "!!! ??? 123"), (14, "é ü ñ 日本語 🙂"),
        (15, prose(40_000, 6)), (16, "\n".join(prose(12, k) for k in range(20))), (17, "\n".join(prose(12, k) for k in range(5, 30))),
        (18, "a b a b a b a b " * 40), (19, "x" * 5000), (20, "\n\n\n"),
    ]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "k", 1, 1, "h", 1, 1, "l") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = edge_texts()
    return table(spark, [*rows, (12, dict(rows)[12])]).cache()  # one row repeats


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- text vectors


def test_words_and_hashes_match_python():
    texts = [t for _, t in edge_texts()]
    v = Texts(pa.array(texts, pa.string()))
    starts, ends, first = v.words()
    seen = {}
    for t, a, b in zip(texts, first[:-1], first[1:]):
        words = WORD.findall(t or "")
        assert [bytes(v.bytes[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b])] == words
        for w, h in zip(words, v.hashes(starts[a:b], ends[a:b]).tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# ---------------------------------------------------------------- 1


def brute_components(rows, k, t):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and both * t.denominator >= t.numerator * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("k", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_join_matches_brute_force(spark, docs, k, t):
    rows = edge_texts() + [(100 + i, edited(prose(60 + i, 50 + i % 4), 8 + i % 40, i)) for i in range(60)]
    got = ngram_join.ngram_jaccard_join(table(spark, rows), k, t).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, k, t)
    assert len(got) == len(rows)


def test_join_of_clusters_of_many_chunks(spark, monkeypatch):
    """Chains and stars over many small chunks: rounds and the pass across chunks lose no link."""
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 8)
    base, rows = prose(200, 9), []
    rows += [(i, edited(base, 90, i)) for i in range(60)]
    words = base.split()
    for i in range(60):  # each differs from the next by one word
        words = [*words[:i], f"y{i}", *words[i + 1 :]]
        rows.append((100 + i, " ".join(words)))
    got = ngram_join.ngram_jaccard_join(table(spark, rows), 3, 0.9).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 3, Fraction(9, 10))


def test_join_of_keys_of_many_sets(spark, monkeypatch):
    """A passage that many share files them under one key; what else they share decides."""
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 8)
    monkeypatch.setattr(ngram_join, "PAIR_TIMES", 1)
    passage, rows = prose(60, 3), []
    rows += [(i, f"{passage} {prose(25, 100 + i)}") for i in range(60)]
    rows += [(100 + i, f"{passage} {prose(25, 100 + i // 3)} {'z' * (i % 3)}") for i in range(30)]
    rows += [(200 + i, f"{passage} q{i}") for i in range(40)]
    got = ngram_join.ngram_jaccard_join(table(spark, rows), 5, 0.8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 5, Fraction(4, 5))


def joined_columns(plan):
    """The output of each join in a physical plan."""
    own = [plan.output().mkString(",")] if "Join" in plan.nodeName() else []
    return own + [x for i in range(plan.children().size()) for x in joined_columns(plan.children().apply(i))]


@pytest.mark.parametrize("filter_bits", [26, 6])
def test_join_moves_no_texts(spark, monkeypatch, filter_bits):
    """Shingles of few sets travel, never all texts, not even with keys of many sets; and a filter that is
    too small for the ids, so that it holds nearly all, changes no result."""
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 8)
    monkeypatch.setattr(ngram_join, "FILTER_BITS", filter_bits, raising=False)
    joins = []

    def kept(df, name="stage", write=ngram_join.materialize):
        joins.extend(joined_columns(df._jdf.queryExecution().sparkPlan()))
        return write(df, name)

    monkeypatch.setattr(ngram_join, "materialize", kept)
    passage, rows = prose(60, 3), [(500 + i, prose(30, 500 + i)) for i in range(60)]
    rows += [(i, f"{passage} {prose(25, 100 + i // 3)} {'z' * (i % 3)}") for i in range(60)]
    got = ngram_join.ngram_jaccard_join(table(spark, rows), 5, 0.8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 5, Fraction(4, 5))
    assert joins and not [x for x in joins if "text#" in x]


def test_join_of_repeated_ids(spark):
    """Rows of one id are one document; rows without an id are linked with nothing."""
    a, b, c = prose(40, 1), prose(40, 2), prose(40, 3)
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (8, c), (None, c), (None, None), (9, None)]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.ngram_jaccard_join(table(spark, rows), 5, 0.8).collect())
    assert got == sorted([(3, 3), (5, 3), (5, 3), (7, 3), (8, 8), (8, 8), (0, 0), (0, 0), (9, 9)])


def test_join_at_a_low_threshold(spark):
    rows = [(1, prose(20, 1)), (2, " ".join(prose(20, 1).split()[:12])), (3, prose(30, 2))]
    got = ngram_join.ngram_jaccard_join(table(spark, rows), 3, 0.5).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 3, Fraction(1, 2))


def test_join_of_edge_tables(spark, docs, empty):
    assert ngram_join.ngram_jaccard_join(empty, 3, 0.9).count() == 0
    got = ngram_join.ngram_jaccard_join(docs, 3, 0.9).collect()
    assert len(got) == docs.count()


def test_similar_sets_share_a_part():
    parts = ngram_join.Parts(Fraction(9, 10))
    rng = np.random.default_rng(3)
    for n in [9, 10, 13, 17, 30, 57, 100, 333, 1000]:
        for trial in range(20):
            u = rng.integers(0, 1 << 63, n).astype(np.uint64)
            gone = int(rng.integers(0, n // 19 + 1))
            v = np.concatenate([u[gone:], rng.integers(0, 1 << 63, gone).astype(np.uint64)])
            both = n - gone
            heavy = rng.random() * (trial % 3 == 0)
            is_heavy = lambda x: (x >> np.uint64(20)) % np.uint64(100) < np.uint64(int(100 * heavy))
            if both * 10 >= 9 * (2 * n - both):
                a, b = parts.keys(u, is_heavy(u)), parts.keys(v, is_heavy(v))
                assert set(a.tolist()) & set(b.tolist()) or set(u.tolist()) == set(v.tolist())


@pytest.mark.parametrize("task_edges", [200_000, 4])
def test_components(spark, monkeypatch, task_edges):
    """In one task, and by rounds over tasks that contract a few edges at a time."""
    monkeypatch.setattr(components, "TASK_EDGES", task_edges)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 100), (7, 7), (200, 201), (201, 202), (300, 299), (1, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {50: 50, 100: 50, 200: 200, 201: 200, 202: 200, 299: 299, 300: 299}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 2


INSULTS = ["idiot", "moron", "stupid", "pathetic"]


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rng, rows, labels = random.Random(1), [], []
    for i in range(400):
        words = prose(60, 1000 + i).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    forms = ["1d10t m0r0n $tupid p@th3tic", "i d i o t m o r o n  s-t-u-p-i-d", "p.a.t.h.e.t.i.c i-d-i-o-t m_o_r_o_n", "moooooron idiooooot stuuuupid", "IDIOT!! MORON### (stupid)", "harmless words only"]
    hidden = [f"{prose(20, 2 * k)} {x} {prose(20, 2 * k + 1)}" for k, x in enumerate(forms)]
    rows += [(1000 + i, t) for i, t in enumerate(hidden)] + [(2000, None), (2001, "")]
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_decoder_against_all_readings():
    """Viterbi finds the least cost of all readings of a lattice."""
    rng = np.random.default_rng(2)
    channel = toxicity.Channel(rng.integers(0, 50, 27**3))
    for token in ["b00k", "a$$4", "sh1t", "hee11o", "k.i.l", "x!!y", "|3e", "aaa"]:
        groups = channel.lattice(token)
        costs = {}
        for reading in itertools.product(*groups):
            cost, a, b = sum(1.5 for x, g in zip(reading, groups) if not x and g != [""]), 26, 26
            for ch in "".join(reading):
                cost, a, b = cost + channel.cost[a][b][ord(ch) - 97], b, ord(ch) - 97
            costs["".join(reading)] = min(cost + channel.cost[a][b][26], costs.get("".join(reading), float("inf")))
        assert costs[channel.restore(token)] == pytest.approx(min(costs.values()))


def test_long_words_are_bounded(spark):
    """A run of letters among very many is looked up by stretches of few lengths."""
    channel = toxicity.Channel(np.ones(27**3, np.int64))
    text = "x" + "abcde" * 60_000 + "zzz"
    parts = [h for _, h in toxicity._word_hashes(Texts(pa.array([text]), lower=True), channel)]
    assert max(map(len, parts)) <= len(text)


def test_decoder():
    counts = np.zeros((27, 27, 27), np.int64)
    for w in INSULTS + ["ladder", "book", "cool"]:
        path = [26, 26, *(ord(c) - 97 for c in w), 26]
        for a, b, c in zip(path, path[1:], path[2:]):
            counts[a, b, c] += 5
    channel = toxicity.Channel(counts)
    for token, word in {"1d10t": "idiot", "m0r0n": "moron", "$tup1d": "stupid", "i.d.i.o.t": "idiot", "moooron": "moron", "b00k": "book", "p@th3t!c": "pathetic", "": "", "1": "i"}.items():
        assert channel.restore(token) == word or token == "1"


def test_toxicity_of_disguised_words(toxic_docs):
    got = {r.doc_id: r for r in toxicity.score_toxicity(*toxic_docs).collect()}
    assert all((got[i].score >= 0.5) == (i % 4 == 0) for i in range(400))
    assert [got[1000 + i].predicted for i in range(6)] == [1, 1, 1, 1, 1, 0]
    assert got[2000].score == got[2001].score < 0.5


def test_toxicity_edge_tables(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(empty, none).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, none).collect())
    odd = spark.createDataFrame([(7, 1), (8, None), (None, 1), (9, 5), (12, 0), (12, 0)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, odd).collect()
    assert len(got) == docs.count()


# ---------------------------------------------------------------- 3


def test_patience_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert line_dedup.patience([1, 2, 3, 9, 4], [1, 2, 3, 8, 4]) == [(0, 0), (1, 1), (2, 2), (4, 4)]


def test_line_dedup(spark, docs, empty):
    assert line_dedup.line_dedup(empty).count() == 0
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    texts = dict(edge_texts())
    assert got[1].text is None and got[1].n_lines == 0 and got[2].text == "" and got[20].text == "\n\n\n"
    assert got[7].text == texts[7] and got[8].text == "" and got[8].n_deleted == 1
    assert got[16].text == texts[16] and got[17].deleted == list(range(15)) and got[17].text == "\n".join(texts[17].split("\n")[15:])
    assert got[12].text == texts[12] and len(line_dedup.line_dedup(docs).collect()) == docs.count()


def test_line_dedup_of_a_block_whose_lines_were_first_held_elsewhere(spark):
    x, y, z = "alpha beta gamma delta", "epsilon zeta eta theta", "iota kappa lambda mu nu"
    rows = [(1, x), (2, y), (3, z), (10, f"head of ten\n{x}\n{y}\n{z}"), (11, f"head of eleven\n{x}\n{y}\n{z}\nend")]
    got = {r.doc_id: r.deleted for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert got == {1: [], 2: [], 3: [], 10: [], 11: [1, 2, 3]}


def test_line_dedup_of_repeated_ids(spark):
    """Rows of one id are aligned each for itself, and never with each other."""
    block = "\n".join(f"a line of the common block {i}" for i in range(4))
    rows = [(1, block), (5, f"own first\n{block}"), (5, f"own second line\nanother own line\n{block}"), (5, f"own first\n{block}"), (None, block)]
    got = sorted((r.doc_id or 0, r.text, r.deleted) for r in line_dedup.line_dedup(table(spark, rows)).collect())
    assert got == sorted([(1, block, []), (5, "own first", [1, 2, 3, 4]), (5, "own second line\nanother own line", [2, 3, 4, 5]), (5, "own first", [1, 2, 3, 4]), (0, block, [])])


def lines_in_common_blocks(later, earlier):
    """Positions of the later text in runs of lines, of 40 characters or more, that the earlier one has."""
    out = set()
    for i in range(len(later)):
        for j in range(len(earlier)):
            if later[i] == earlier[j] and not (i and j and later[i - 1] == earlier[j - 1]):
                k = 0
                while i + k < len(later) and j + k < len(earlier) and later[i + k] == earlier[j + k]:
                    k += 1
                if sum(map(len, later[i : i + k])) >= 40:
                    out |= set(range(i, i + k))
    return out


@pytest.mark.parametrize("order", ["kept", "shuffled"])
@pytest.mark.parametrize("rare", [line_dedup.RARE, 1, 3])
def test_line_dedup_against_all_pairs(spark, monkeypatch, order, rare):
    """Keys and first holders find each common block of every pair of documents, moved ones among them."""
    monkeypatch.setattr(line_dedup, "RARE", rare)
    rng = random.Random(5)
    blocks = [[f"block {b} line {i} " + "x" * rng.randint(0, 25) for i in range(rng.randint(1, 6))] for b in range(25)]
    rows, n = [], 0
    for i in range(70):
        lines = []
        taken = rng.sample(range(25), rng.randint(0, 5))
        for b in sorted(taken) if order == "kept" else taken + taken[:1]:
            lines += [f"own {i} {n} " + "y" * rng.randint(0, 30), *blocks[b][rng.randint(0, 1) :]]
            n += 1
        rows.append((i, "\n".join([*lines, f"end {i}"])))
    want: dict[int, set[int]] = {i: set() for i, _ in rows}
    aligned: dict[int, set[int]] = {i: set() for i, _ in rows}
    split = {i: t.split("\n") for i, t in rows}
    for a, b in itertools.combinations(range(70), 2):
        aligned[b] |= set(line_dedup.common_blocks(split[b], split[a], [len(x) for x in split[b]]))
        want[b] |= lines_in_common_blocks(split[b], split[a])
    got = {r.doc_id: set(r.deleted) for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert sum(map(len, want.values())) > 100
    assert all(aligned[i] <= want[i] for i in want) and got == want


def test_line_dedup_of_moved_blocks(spark):
    a, r = [f"a line of block a {k}" for k in range(3)], ["a single line that stands elsewhere, of its own"]
    rows = [(1, a + r), (2, [*r, "x"]), (3, r + a), (4, [a[2], a[1], a[0]]), (5, ["new", *r, *r, "end"])]
    got = {d.doc_id: d.deleted for d in line_dedup.line_dedup(table(spark, [(i, "\n".join(x)) for i, x in rows])).collect()}
    assert got == {1: [], 2: [0], 3: [0, 1, 2, 3], 4: [], 5: [1, 2]}


def test_line_dedup_of_lines_in_many_documents(spark):
    passage, short = prose(60, 1), "x" * 30
    rows = [(k, f"{prose(9, 100 + k)}\n{passage}") for k in range(60)] + [(k, f"{prose(9, 100 + k)}\n{short}") for k in range(60, 120)]
    got = {r.doc_id: r.deleted for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert got == {k: [1] if 0 < k < 60 else [] for k in range(120)}


# ---------------------------------------------------------------- 4


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u v", ""), (5, "http://c", "é" * 400_000), (6, "http://d", "a\r\n\r\nb"), (7, "http://e", "<p>x</p>"), (6, "http://d", "a\r\n\r\nb")]
    pages = spark.createDataFrame([(*r, 0, "z") for r in rows], "page_id long, url string, html string, payload int, first string")
    got = warc.warc_round_trip(pages).collect()
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min(j for j, _, h in rows if (h or "") == (html or ""))
        want.append((i, len(data), warc.digest(data), "response" if first == i else "revisit", None if first == i else first))
    assert sorted(map(tuple, got)) == sorted(want)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_of_repeated_ids(spark):
    """A record for each row: an id is no key."""
    rows = [(1, "u", "A"), (2, "u", "B"), (5, "u", "A"), (5, "u", "B"), (5, "u", "C")]
    got = warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_digest, r.refers_to or 0) for r in got) == sorted([(1, warc.digest(b"A"), 0), (2, warc.digest(b"B"), 0), (5, warc.digest(b"A"), 1), (5, warc.digest(b"B"), 2), (5, warc.digest(b"C"), 0)])


def test_warc_damage_is_found():
    import io

    good = warc.record(1, "u", b"hello" * 1000, warc.digest(b"hello" * 1000), None)
    read = lambda data: [warc.read_record(m) for m in warc.members(io.BytesIO(data))]
    assert len(read(good * 3)) == 3
    with pytest.raises(warc.WarcError):
        read(good[:-20])
    with pytest.raises(warc.WarcError):
        read(warc.record(1, "u", b"hello", warc.digest(b"other"), None))


# ---------------------------------------------------------------- 5


def test_smith_waterman_matches_the_recurrence():
    rng = random.Random(4)
    for _ in range(50):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 9))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        got, _ = decontaminate.smith_waterman(np.array([a]), np.array([b]))
        assert got[0] == max(map(max, h))


def test_decontamination(spark, docs, empty, monkeypatch):
    items = [(i, prose(40, 7000 + i)) for i in range(30)] + [(90, None), (91, ""), (92, "two words")]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    rows = [(i, f"{prose(50, i)} {items[i][1]} {prose(50, 99 + i)}") for i in range(10)]
    rows += [(10 + i, f"{prose(50, i)} {edited(items[10 + i][1], 6, i)} {prose(50, 99 + i)}") for i in range(10)]
    rows += [(20 + i, prose(200, 500 + i)) for i in range(10)] + [(60, None), (61, "")]
    found = decontaminate.find_contamination(table(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(20)}
    assert all(r.score == 1 for r in found if r.doc_id < 10) and all(0.5 <= r.score < 1 for r in found if r.doc_id >= 10)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)  # many blocks of items: the same
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(table(spark, rows), bench).collect()} == {(i, i) for i in range(20)}
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).count() == 0


def test_decontamination_of_short_items(spark):
    docs_ = table(spark, [(1, "here are two words in a row"), (2, "two other words"), (3, "alone"), (4, None), (5, "")])
    items = spark.createDataFrame([(1, "Two words"), (2, "alone"), (3, ""), (4, None), (5, "in a row")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_contamination(docs_, items).collect()}
    assert got == {(1, 1): 1.0, (3, 2): 1.0, (1, 5): 1.0}


@pytest.mark.parametrize("rare", [0, 2, 1000])
def test_decontamination_against_aligning_all_pairs(spark, monkeypatch, rare):
    """Of all pairs that align well enough, those that share a seed are found, each with its score,
    whether its seeds are rare or frequent."""
    monkeypatch.setattr(decontaminate, "ALIGN_CELLS", 500)
    monkeypatch.setattr(decontaminate, "HITS", 7)
    monkeypatch.setattr(decontaminate, "RARE", rare)
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for i in range(20)]
    rows = []
    for d in range(60):
        words = rng.choices(vocabulary, k=60)
        own = items[rng.randrange(20)][1].split()
        own = [rng.choice(vocabulary) if rng.random() < 0.15 else w for w in own]
        at = rng.randrange(60)
        rows.append((d, " ".join(words[:at] + own + words[at:])))
    want = {}
    for i, item in items:
        x = item.split()
        for d, text in rows:
            y = text.split()
            best, row = 0, [0] * (len(y) + 1)
            for a in x:
                new = [0]
                for j, b in enumerate(y):
                    new.append(max(0, row[j] + (2 if a == b else -1), row[j + 1] - 1, new[j] - 1))
                row, best = new, max(best, *new)
            k = min(3, len(x))
            seeded = {tuple(x[a : a + k]) for a in range(len(x) - k + 1)} & {tuple(y[a : a + k]) for a in range(len(y) - k + 1)}
            if seeded and best >= 0.5 * 2 * len(x):
                want[d, i] = best / (2 * len(x))
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 20
    assert got == pytest.approx(want)


def test_seeds_are_counted_over_all_documents(spark, monkeypatch):
    """Each document counts once for a seed, however often it holds it, and whatever partition it is in."""
    items = spark.createDataFrame([(1, "a b c d"), (2, "b c d e"), (3, "x y"), (4, "z")], "item_id long, text string")
    texts = ["a b c a b c", "A B C", "b c d", "b c d e b c d", "q b c d", "x y", "x", "z z z", None, ""]
    files = decontaminate.materialize(items, "items").inputFiles()
    block = decontaminate.Block.read(files)
    seed = {" ".join(w): int(block.seeds[n].unique[k].view(np.int64)) for n in range(3) for k in range(len(block.seeds[n].unique)) for w in [items_words(block, n, k)]}
    rows = table(spark, list(enumerate(texts))).select("doc_id", "text").repartition(4)
    for rare, want in ((0, {"a b c", "b c d", "c d e", "x y", "z"}), (1, {"a b c", "b c d"}), (2, {"b c d"}), (3, set())):
        got = {r.seed for r in decontaminate.frequent_seeds(rows, files, rare).collect()}
        assert got == {seed[w] for w in want}


def items_words(block, n, k):
    """The words of a seed, from the items as they are written above."""
    seeds = block.seeds[n]
    words = [["a", "b", "c", "d"], ["b", "c", "d", "e"], ["x", "y"], ["z"]][seeds.item[seeds.start[k]]]
    at = seeds.at[seeds.start[k]]
    return words[at : at + seeds.length]


def test_the_bound_on_words_never_drops_an_alignment():
    rng = np.random.default_rng(5)
    items, windows_ = rng.integers(2, 12, (3000, 9)).astype(np.uint64), rng.integers(2, 30, (3000, 26)).astype(np.uint64)
    length = rng.integers(3, 10, 3000)
    items[np.arange(9) >= length[:, None]] = 0
    score, _ = decontaminate.smith_waterman(items, windows_)
    may = decontaminate.may_align(items, length, windows_, 0.5)
    reached = score / (2 * length) >= 0.5
    assert (may | ~reached).all() and reached.sum() > 100 and (~may).sum() > 100


def test_decontamination_of_an_edited_copy_among_many(spark):
    words = [f"word{k}" for k in range(14)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = [(i, f"{prose(20, i)} {' '.join(words)}") for i in range(30)] + [(30, f"{prose(20, 30)} {' '.join(words[7:])}")]
    assert {r.doc_id for r in decontaminate.find_contamination(table(spark, rows), bench).collect()} == set(range(31))


# ---------------------------------------------------------------- 6


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {p for v in places.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, empty):
    assert quality.quality_cascade(empty).count() == 0
    got = quality.quality_cascade(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        want = brute_counts(dict(edge_texts())[r.doc_id])
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    kept = {r.doc_id for r in got if r.kept}
    assert {7, 12, 15, 16} <= kept and not kept & {1, 2, 3, 9, 13, 18, 19}


def test_order_does_not_change_the_verdict(docs, monkeypatch):
    want = {r.doc_id: r.kept for r in quality.quality_cascade(docs).collect()}
    for names in ([*quality.RULES], [*quality.RULES][::-1]):
        monkeypatch.setattr(quality, "rule_order", lambda *_, names=names: [(x, 0, 0) for x in names])
        assert {r.doc_id: r.kept for r in quality.quality_cascade(docs).collect()} == want


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("bits", [8, 1])
def test_planes_round_trip(spark, docs, bits, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_planes, "BLOCK_IDS", 1000)
    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = sorted(map(tuple, token_planes.token_planes(docs, path, 1, bits).collect()))
    start, want = 0, []
    for i, t in sorted([*edge_texts(), (12, dict(edge_texts())[12])], key=lambda r: r[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)


def test_planes_of_an_empty_table(empty):
    assert token_planes.token_planes(empty, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_chunks_encode_as_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    texts = ["", " ", "a  b", "it's <|endoftext|> x", "é́ ́a", "tab\t\tq\r\nz", "\x1c a\x1cb", "ÀÉ ΑΣ", "日本 語\n🙂", "don't 'S o'LL", "ﬁ Ａ", "a\x85b c", "A,b.c;d", "x'", "'s", "it's-a 'S,'s,'t", "a1b22c3", "e\u0301x e,\u0301", "=\u0338a a=\u0338", "<|ENDOFTEXT|>", "a<|b", "q\x00w", "I'LL-we'd", "¿a? ¡b!", "x\u00a0y", "İI ẞ", "the The THE the"]
    ids, counts = token_planes.ChunkEncoder(path).encode(pa.array([*texts, None]))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([*texts, ""], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    plain = [t for t in texts if "<|" not in t]  # cut finer
    ids, counts = token_planes.ChunkEncoder(path).encode(pa.array(plain))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [w for t, w in zip(texts, want) if "<|" not in t]


# ---------------------------------------------------------------- 8


def test_pieces_match_the_library(docs, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    encoder = pieces.PieceEncoder(path)
    texts = [t or "" for _, t in edge_texts()] + ["  two", "x\n y", "a\n\nb", " lead", "tab\tq", "trail ", "a▁b", "<s> </s>", "\n a", "a   ", "a\x00b", "▁"]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    normal, _ = encoder.normalize(pa.array(texts))
    ids, counts = encoder.encode(normal)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == library.encode(texts, add_eos=True)
    rows = {r.doc_id: r for r in pieces.piece_digests(docs, path).collect()}
    for i, t in edge_texts():
        ids = library.encode(t or "", add_eos=True)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (rows[i].n_tokens, rows[i].span_bytes) == (len(ids), len((t or "").encode()))
    assert pieces.piece_digests(empty, path).count() == 0 and pieces.encode_pieces(empty, path).count() == 0


def test_spans_join_to_the_text(docs):
    texts = dict(edge_texts())
    for r in pieces.encode_pieces(docs, tokenizer_path("piece_bpe_32k.model")).collect():
        data = (texts[r.doc_id] or "").encode()
        assert b"".join(data[a:b] for a, b in zip(r.starts, r.ends)) == data
        assert len(r.ids) == len(r.starts)


def test_character_map_against_the_library(tmp_path):
    """Longest-prefix normalisation with the library's own compiled map."""
    spm = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    try:
        library = spm.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
        blob = pb.NormalizerSpec.FromString(pb.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec.SerializeToString()).precompiled_charsmap
    except (AttributeError, TypeError, RuntimeError) as e:
        pytest.skip(f"the library has no ready map: {e}")
    ours = pieces.Normalizer(blob, trim=False)
    for text in ["ﬁne ①② ＡＢＣ", "ｶﾞ é é 한", "plain text", "tab\there", "㌔ ½"]:
        data, source = ours.normalize(text)
        assert data.decode() == library.normalize(text)
        assert len(source) == len(data) + 1 and source[-1] == len(text.encode())

    # a model with this map and with blanks trimmed: ids and spans go through our normalisation
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        proto = pb.ModelProto.FromString(f.read())
    proto.normalizer_spec.precompiled_charsmap, proto.normalizer_spec.remove_extra_whitespaces = blob, True
    path = tmp_path / "mapped.model"
    path.write_bytes(proto.SerializeToString())
    mapped, encoder = spm.SentencePieceProcessor(model_file=str(path)), pieces.PieceEncoder(str(path))
    texts = [t or "" for _, t in edge_texts()] + ["  ﬁne ①②  ＡＢＣ ", "ｶﾞ é é 한", "a\tb\n\nc", " ", "㌔ ½", "x ▁ y", "\u3000", "the  end\u00a0 "]
    normal, sources = encoder.normalize(pa.array(texts))
    ids, counts = encoder.encode(normal)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == mapped.encode(texts, add_eos=True)
    starts, ends = encoder.spans(normal, sources, ids, counts)
    for t, a, b in zip(texts, np.split(starts, np.cumsum(counts)[:-1]), np.split(ends, np.cumsum(counts)[:-1])):
        assert (a <= b).all() and (a[1:] >= b[:-1]).all() and b[-1] <= len(t.encode())
    assert ends[np.cumsum(counts) - 2][texts.index("ｶﾞ é é 한")] == len("ｶﾞ é é 한".encode())


# ---------------------------------------------------------------- 9


def test_shards(spark, docs, empty):
    assert sharding.shard_by_slots(empty).count() == 0
    rows = [(i, prose(1 + i % 50, i)) for i in range(3000)] + [(5, "again"), (None, "no id"), (9999, None)]
    got = sharding.shard_by_slots(table(spark, rows), 7, slots=512).collect()
    assert len(got) == len(rows)
    loads, places = {}, {}
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r["size"]
        places.setdefault(r.shard, []).append(r.slot)
    assert set(loads) == set(range(7)) and max(loads.values()) < 1.02 * min(loads.values())
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r["size"], r.text_crc32) for r in got) == want


def test_shards_of_very_many_rows_alike(spark):
    """Rows without id and text, and rows that repeat, are dealt over all shards."""
    alike = spark.range(6000).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS STRING) AS text")
    again = spark.range(3000).selectExpr("7L AS doc_id", "'the same text' AS text")
    few = spark.range(500).selectExpr("id AS doc_id", "'text ' || id AS text")
    got = sharding.shard_by_slots(alike.unionByName(again).unionByName(few), 8).collect()
    loads, places = {}, {}
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r["size"]
        places.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 9500 and set(loads) == set(range(8)) and max(loads.values()) < 1.05 * min(loads.values())
    assert all(sorted(v) == list(range(len(v))) for v in places.values())


@pytest.mark.parametrize("old, new", [(3, 3), (3, 5), (5, 3)])
def test_map_equals_a_plain_greedy_one(spark, old, new):
    rng = random.Random(old + new)
    size = {s: rng.choice([0, 5, rng.randint(1, 400)]) for s in range(64)}
    sizes = spark.createDataFrame([(s, b, 1) for s, b in size.items()], "vslot long, bytes long, n_rows long")
    got = {r.vslot: r.shard for r in sharding.rebalanced(sharding.first_map(spark, old, 64), sizes, new).collect()}
    mean, want, load, moving = sum(size.values()) / new, {}, [0] * new, []
    for shard in range(old):
        filled = 0
        for s in sorted((s for s in size if s % old == shard), key=lambda s: (-size[s], s)):
            filled += size[s]
            if filled <= mean and shard < new:
                want[s] = shard
                load[shard] += size[s]
            else:
                moving.append(s)
    for s in sorted(moving, key=lambda s: (-size[s], s)):
        want[s] = load.index(min(load))
        load[want[s]] += size[s]
    assert got == want


def test_growing_moves_slots_into_the_new_shard_only(spark):
    sizes = spark.range(256).selectExpr("id AS vslot", "100 + id % 7 AS bytes", "1L AS n_rows")
    before = sharding.rebalanced(sharding.first_map(spark, 4, 256), sizes, 4)
    after = sharding.rebalanced(before, sizes, 5)
    a, b = ({r.vslot: r.shard for r in x.collect()} for x in (before, after))
    moved = [s for s in a if a[s] != b[s]]
    assert len(a) == len(b) == 256 and 40 < len(moved) < 70
    assert sum(b[s] == 4 for s in moved) > 0.9 * len(moved)


# ---------------------------------------------------------------- 10


def test_languages(spark, docs, empty):
    sets = {"en": ["the", "and", "with", "thing"], "de": ["der", "und", "mit", "nicht"], "fr": ["le", "et", "avec", "être"], "es": ["el", "y", "con", "está"]}
    rows = [(i, " ".join(random.Random(i).choices(sets[lang], k=30)), lang) for i, lang in enumerate(sorted(sets) * 30)]
    made = spark.createDataFrame([*rows, (500, None, "en"), (501, "123 !?", "fr"), (502, "", None), (503, "the thing and", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify_language(made).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert [got[i].lang_pred for i in (500, 501, 502, 503)] == ["und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify_language(empty).count() == 0
    assert {r.lang_pred for r in language.identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert len(language.identify_language(docs).collect()) == docs.count()


def test_machine_against_newton_steps():
    """The loss is within 1% of the optimum, which Newton steps on the rows inside the margin find."""
    rng = np.random.default_rng(3)
    for seed in range(5):
        x = rng.normal(size=(120, 12)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sign = np.where(x @ rng.normal(size=12) + rng.normal(size=120) * 0.2 > 0.3 * seed - 0.6, 1, -1).astype(np.float32)
        weight = np.where(sign > 0, 0.5 / (sign > 0).sum(), 0.5 / (sign < 0).sum())

        def loss(w):
            return float(0.5 * 1e-4 * w @ w + (weight * np.maximum(0, 1 - sign * (x @ w)) ** 2).sum())

        best = np.zeros(12)
        for _ in range(100):
            inside = 1 - sign * (x @ best) > 0
            a = x[inside].astype(float)
            system = 1e-4 * np.eye(12) + 2 * a.T @ (a * weight[inside][:, None])
            step = np.linalg.solve(system, 2 * a.T @ (weight[inside] * sign[inside])) - best
            rate = 1.0
            while loss(best + rate * step) > loss(best) and rate > 1e-9:
                rate /= 2
            best = best + rate * step
        got = language.fit_svm(x, sign)
        assert loss(best) <= loss(got) + 1e-9 and loss(got) <= 1.01 * loss(best)


def test_softmax_against_newton_steps():
    """On classes that overlap, the loss is within 1% of the optimum."""
    rng = np.random.default_rng(4)
    y = np.repeat([0, 1, 2], [30, 60, 90])
    x = (rng.normal(size=(180, 5)) + 0.7 * np.eye(5)[y]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    weight = 1 / np.bincount(y)[y] / 3

    def parts(w):
        z = x @ w.reshape(5, 3)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return float(-(weight * np.log(p[np.arange(180), y])).sum() + 0.5e-5 * (w**2).sum()), p

    w = np.zeros(15)
    for _ in range(30):
        _, p = parts(w)
        gradient = (x.T @ ((p - np.eye(3)[y]) * weight[:, None])).ravel() + 1e-5 * w
        curve = np.einsum("n,ni,nj,nab->iajb", weight, x, x, p[:, :, None] * np.eye(3) - p[:, :, None] * p[:, None, :]).reshape(15, 15)
        w = w - np.linalg.solve(curve + 1e-5 * np.eye(15), gradient)
    best, got = parts(w)[0], parts(language.fit_softmax(x, y, 3).astype(float).ravel())[0]
    assert best <= got + 1e-7 and got <= 1.01 * best
