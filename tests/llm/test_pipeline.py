"""Each stage's decisions take effect, on documents made for it and on the given ones."""

import pytest

import corpus_pipeline as cp
from tests.conftest import TESTDATA
from tests.llm.cases import as_set, seeded, words

NAMES = tuple(f"word{i}" for i in range(3000))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean prose with planted copies, junk, benchmark passages and repeated passages."""
    folder = tmp_path_factory.mktemp("tables")
    rng = seeded(13)

    def prose(n=10):
        return "\n".join(words(rng, 14, NAMES).capitalize() + "." for _ in range(n))

    texts = {i: prose() for i in range(40)}
    junk = {100 + i: "\n".join(words(rng, 14, NAMES).upper().replace(" ", "!! ") for _ in range(8)) for i in range(20)}
    copies = {200: texts[0], 201: texts[1]}
    item = words(rng, 40, NAMES)
    hit = {300: texts[2][:200] + " " + item + " " + prose(1)}
    passage = words(rng, 60, NAMES)
    repeats = {400: prose(5) + "\n" + passage + "\n" + prose(5), 401: prose(6) + "\n" + passage + "\n" + prose(4)}
    odd = {500: None, 501: ""}
    every = {**texts, **junk, **copies, **hit, **repeats, **odd}
    rows = [(k, t, "en", "made", None if t is None else len(t)) for k, t in every.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet")
    labels = [(k, 1) for k in list(texts)[::2]] + [(k, 0) for k in list(junk)[::2]]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), every, passage


def test_stages_on_planted_documents(spark, tables, tmp_path):
    folder, every, passage = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.dtypes, []
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, folder)
        if i < 4:
            assert out.dtypes == columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append({r[0]: r for r in docs.collect()})
    clean = set(range(40)) - {0, 1, 2}
    quality, near, cut, free, tokens = kept
    assert set(quality) == set(range(40)) | {200, 201, 300, 400, 401}
    assert set(near) == set(quality) - {200, 201}
    assert set(cut) == set(near)
    assert all(cut[k].text == every[k] and cut[k].n_chars == len(every[k]) for k in clean | {0, 1})
    for k in (400, 401):
        assert passage not in cut[k].text and len(every[k]) - len(cut[k].text) >= len(passage)
        assert cut[k].n_chars == len(cut[k].text)
    assert set(free) == set(cut) - {300}
    assert set(tokens) == set(free)
    assert all(t.round_trip and t.n_tokens == len(t.ids) and len(t.ends) == len(t.ids) for t in tokens.values())


def edited(rng, text, n):
    parts = text.split()
    for _ in range(n):
        parts[rng.randrange(len(parts))] = "edited"
    return " ".join(parts)


def test_edited_copies_are_dropped(spark):
    """Edits that leave a five-word similarity of 0.8 and more, and ones that do not."""
    rng = seeded(14)
    base = [words(rng, n, NAMES) for n in (20, 60, 200, 400, 400, 2000)]
    rows, want, alike = [], set(), lambda a, b: len(a & b) >= 0.8 * len(a | b)
    sets = lambda t: {tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)}
    for k, text in enumerate(base):
        rows.append((100 * k, text))
        rows += [(100 * k + i, edited(rng, text, max(1, i * len(text.split()) // 400))) for i in range(1, 21)]
    # One large group with a line in common, and texts that share nothing but that line.
    line = words(rng, 12, NAMES)
    rows += [(1000 + i, edited(rng, base[3], 2) + " " + line) for i in range(60)]
    rows += [(2000 + i, words(rng, 80, NAMES) + " " + line) for i in range(60)]
    shingles = {k: sets(t) for k, t in rows}
    root = {k: k for k in shingles}
    for k in sorted(shingles):
        for j in sorted(shingles):
            if j < k and root[j] != root[k] and alike(shingles[j], shingles[k]):
                low, high = sorted((root[j], root[k]))
                root = {x: low if r == high else r for x, r in root.items()}
    want = set(root.values())
    assert 60 < len(want) < len(rows) - 80
    out = cp.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert {r.doc_id for r in out.collect()} == want


def test_rows_that_repeat_an_id_or_have_none(spark):
    schema = "doc_id long, text string, n_chars long"
    rows = [(1, "a b c d", 7), (1, "a b c d", 7), (2, "a b c d", 7), (3, "other words here", 16), (None, "x", 1), (None, "x", 1)]
    out = cp.near_copies(spark, spark.createDataFrame(rows, schema), "")
    # The last round's verdict asks that rows without an id take part like any other.
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, None]


def test_different_texts_with_one_id_are_chosen_by_row(spark):
    a, b, c = "one two three four five six", "some quite other text stands here", "a third text is in this row"
    rows = [(3, a), (5, a), (5, b), (7, b), (7, c), (7, c), (8, c)]
    out = cp.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert sorted(map(tuple, out.collect())) == [(3, a), (5, b), (7, c)]


def test_a_contaminated_row_takes_no_other_row_along(spark, tables):
    folder, every, _ = tables
    rows = [(k, t) for k in (None, 1) for t in (every[300], every[3], every[4])] + [(2, every[300]), (3, every[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = cp.benchmark_free(spark, docs, folder)
    assert got.columns == docs.columns
    assert as_set(got.collect()) == as_set(r for r in rows if r[1] != every[300])


@pytest.mark.parametrize("stage", range(5))
def test_no_documents(spark, tables, stage):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0)
    assert cp.STAGES[stage][1](spark, docs, tables[0]).isEmpty()


def test_tokens_take_one_python_worker_a_task(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    found = cp.tokens(spark, docs, tables[0])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert found.where("round_trip").count() == docs.count()


def test_run_over_the_given_tables(spark):
    folder = f"{TESTDATA}/sf0.001"
    rows = cp.run(spark, folder).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    assert 0.5 * len(ids) < len(rows) < len(ids) and {r.doc_id for r in rows} < ids
    assert all(r.round_trip for r in rows)
