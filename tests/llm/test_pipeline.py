"""Each stage of the pipeline against a plain version of it, on a small table."""

import itertools
import random
from fractions import Fraction

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from test_operators import WORD, brute_components, edited, lines_in_common_blocks, prose

import corpus_pipeline as pipeline
from recjobs.llm.queries import tokenizer_path

ITEM = " ".join(prose(25, 900).split())
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "deleted", "row"]


def sample():
    base = prose(80, 700)
    block = "\n".join(prose(9, 710 + k) for k in range(4))
    return [
        (1, None), (2, ""), (3, "12 34 !!"), (4, base), (5, edited(base, 70, 1)), (6, base.upper()), (7, f"{prose(30, 1)}\n{block}"), (8, f"{prose(30, 2)}\n{block}\n{prose(30, 3)}"),
        (9, block), (10, f"{prose(20, 4)} {ITEM} {prose(20, 5)}"), (11, f"{prose(20, 6)} {edited(ITEM, 9, 3)} {prose(20, 7)}"), (12, prose(40, 8)), (12, prose(40, 9)), (13, prose(50, 10)), (13, prose(50, 10)),
        (14, "é ü 日本 🙂 word"), (15, "x"),
    ]


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows = sample()
    n = len(rows)
    table = {"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows], "lang": pa.array([["en", "de", None][k % 3] for k in range(n)], pa.string()), "source": ["s"] * n, "n_chars": pa.array([len(t or "") for _, t in rows], pa.int64()), "deleted": pa.array([1] * n, pa.int32()), "row": ["r"] * n}
    pq.write_table(pa.table(table), folder / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": [ITEM]}), folder / "benchmark.parquet")
    return str(folder)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def stage(spark, sf_dir, name, rows):
    table = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "r") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, deleted int, row string")
    got = dict(pipeline.STAGES)[name](spark, table, sf_dir)
    if name != "sentencepiece":
        assert got.columns == COLUMNS
    return got


def plain_lines(rows):
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, t))
            continue
        lines = t.split("\n")
        gone = set()
        for j, other in rows:
            if other is not None and j < i:
                gone |= lines_in_common_blocks([x.strip(" ") for x in lines], [x.strip(" ") for x in other.split("\n")])
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or WORD.search(left):
            out.append((i, left))
    return sorted(out, key=str)


def plain_groups(rows):
    """Rows of one id are one document."""
    numbered = list(enumerate(rows))
    found = brute_components([(n, t) for n, (_, t) in numbered], 5, Fraction(4, 5))
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, _) in numbered:
        a, b = root(i), root(rows[found[n][1]][0])
        parent[max(a, b)] = min(a, b)
    return sorted(((i, t) for i, t in rows if root(i) == i), key=str)


def plain_clean(rows):
    def score(text):
        x, y, best = ITEM.lower().split(), (text or "").lower().split(), 0
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for j, b in enumerate(y):
                new.append(max(0, row[j] + (2 if a == b else -1), row[j + 1] - 1, new[j] - 1))
            row, best = new, max(best, *new)
        return best / (2 * len(x))

    return sorted(((i, t) for i, t in rows if score(t) < 0.5), key=str)


PLAIN = {
    "language_id": lambda rows: sorted(((i, t) for i, t in rows if t and any(c.isalpha() for c in t)), key=str),
    "line_dedup": plain_lines,
    "near_duplicates": plain_groups,
    "decontamination": plain_clean,
}


@pytest.mark.parametrize("name", list(PLAIN))
def test_stage_against_a_plain_version(spark, sf_dir, name):
    rows = sample()
    want = PLAIN[name](rows)
    assert rows_of(stage(spark, sf_dir, name, rows)) == want
    assert len(want) < len(rows) or name == "line_dedup" and want != sorted(rows, key=str)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stage_of_an_empty_table(spark, sf_dir, name):
    assert stage(spark, sf_dir, name, []).count() == 0


def test_pieces_of_all_kept(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows = sample()
    got = sorted((r.doc_id, r.ids) for r in stage(spark, sf_dir, "sentencepiece", rows).collect())
    assert got == sorted((i, library.encode(t or "", add_eos=True)) for i, t in rows)


def test_run_is_its_stages_in_turn(spark, sf_dir):
    rows = sample()
    for name in PLAIN:
        rows = PLAIN[name](rows)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = sorted((r.doc_id, r.ids) for r in pipeline.run(spark, sf_dir).collect())
    assert got == sorted((i, library.encode(t or "", add_eos=True)) for i, t in rows)
    kept = {i for i, _ in rows}
    assert {4, 7, 8, 12, 13, 14, 15} <= kept and not kept & {1, 2, 3, 5, 6, 9, 10, 11}


@pytest.mark.parametrize("order", [sorted, list])
def test_a_random_corpus_of_lines(spark, sf_dir, order):
    rng = random.Random(1)
    lines = [prose(rng.randint(2, 9), 3000 + k) for k in range(40)]
    rows = [(i, "\n".join(lines[k] for k in order(rng.sample(range(40), rng.randint(1, 8))))) for i in range(40)]
    assert rows_of(stage(spark, sf_dir, "line_dedup", rows)) == plain_lines(rows)
    assert len(set(itertools.chain.from_iterable(t.split("\n") for _, t in rows))) <= 40


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_stages_pass_small_batches(spark, sf_dir, name):
    """Long texts don't go to workers ten thousand at a time."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dict(pipeline.STAGES)[name](spark, docs, sf_dir)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    texts = spark.range(0, 300, 1, 1).selectExpr("repeat(cast(id as string), 30000) AS text")
    assert max(r.size for r in texts.mapInArrow(sizes, "size long").collect()) < 5 << 20
    spark.conf.set(limit, "1024b")
    dict(pipeline.STAGES)[name](spark, docs, sf_dir)
    assert spark.conf.get(limit) == "1024b"
    spark.conf.unset(limit)
