"""The pipeline's stages against plain restatements, and its registration."""

from brute import groups, pii

import __spark_entry__ as e
import corpus_pipeline
from vendorlake.llm import langid
from vendorlake.llm.decontaminate import exact_shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {"pipeline", *(f"{q.split('_')[0]}_" for q in e.queries())}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "tokens"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34 !", "en", "s", 7), (9003, "write to ab.c@d.org the and of", "en", "s", 30)], docs.schema)
    docs = docs.unionByName(extra)
    held = {r["doc_id"]: r["text"] for r in docs.collect()}

    one = corpus_pipeline.language_id(spark, docs, sf)
    assert one.columns == COLUMNS
    kept = {r["doc_id"]: r["text"] for r in one.collect()}
    assert set(held) - set(kept) == {9001, 9002} and all(held[i] == t for i, t in kept.items())

    two = corpus_pipeline.near_duplicates(spark, one, sf)
    assert two.columns == COLUMNS
    want = {i for i, (_, c) in groups(list(kept.items()), 5, 80, 100).items() if i == c}
    assert {r["doc_id"] for r in two.collect()} == want

    three = corpus_pipeline.decontamination(spark, two, sf)
    items = [exact_shingles(r["text"], 5) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {i for i in want if not any(q and 100 * len(q & exact_shingles(kept[i], 5)) >= 80 * len(q) for q in items)}
    assert three.columns == COLUMNS and {r["doc_id"] for r in three.collect()} == want

    four = corpus_pipeline.personal_data(spark, three, sf)
    rows = four.collect()
    assert four.columns == COLUMNS and {r["doc_id"] for r in rows} == want
    for r in rows:
        assert not any(pii(r["text"])[:4]) and r["n_chars"] == len(r["text"])
        if not any(pii(kept[r["doc_id"]])[:4]):
            assert r["text"] == kept[r["doc_id"]]

    five = corpus_pipeline.tokens(spark, four, sf).collect()
    assert {r["doc_id"] for r in five} == want and all(r["round_trip"] and r["n_tokens"] * 4 == len(r["ids"]) for r in five)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_stages_of_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    text = "the and of a sentence that is not in any other document here at all"
    odd = spark.createDataFrame([(None, text, None, None, None), (9100, text + " twice", "en", "s", 1), (9100, text + " twice", "en", "s", 1), (9101, None, None, "s", None), (9102, "", "en", None, 0)], docs.schema)
    docs = docs.unionByName(odd).selectExpr("*", "'x' as score", "1 as id", "'y' as key")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.where("false"), sf)
        assert none.count() == 0, name
        found = stage(spark, docs, sf)
        ids = [r["doc_id"] for r in found.collect()]
        # Among near duplicates one of the repeated rows stays, and the row without an id, which is like them, goes; elsewhere all stay.
        near = name == "near_duplicates"
        assert ids.count(9100) == (1 if near else 2) and ids.count(None) == (0 if near else 1), name
        assert (9101 in ids) == (9102 in ids) == (name != "language_id"), name
        assert found.columns == COLUMNS or name == "tokens", name


def test_rows_are_decided_by_their_text_whatever_their_ids(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    words = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [
        (None, f"{words(1)} {item} {words(2)}"), (None, words(3)), (None, words(3)), (None, words(3) + " more"), (7, f"{item} {words(4)}"), (7, words(5)), (8, words(6) + " end"), (9, words(6)), (9, words(7)),
        (3, words(7)), (5, words(8)), (5, words(8)), (None, words(8) + " x"), (11, None), (11, None), (12, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clean = corpus_pipeline.decontamination(spark, docs, sf)
    held = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert held(clean) == sorted([x for x in rows if item not in (x[1] or "")], key=str)
    single = held(corpus_pipeline.near_duplicates(spark, clean, sf))
    # One of each group, the smallest id first and a null one last; alike rows once; texts without a word stay alone.
    assert [x for x in single if x[0] is not None] == sorted([(7, words(5)), (8, words(6) + " end"), (3, words(7)), (5, words(8)), (11, None), (12, "")], key=str)
    assert [i for i, t in single if t and t.startswith("w3x0 ")] == [None]


def test_the_language_model_is_not_fitted_in_the_driver(spark, monkeypatch):
    """The driver has no memory for the sample and its features."""

    def refuse(*a, **b):
        raise AssertionError("fitted in the driver")

    monkeypatch.setattr(langid, "fit_crf", refuse)
    docs = spark.createDataFrame([(i, t, x, "s", 20) for i in range(0, 40, 2) for t, x in [(("the cat and the dog", "en"), ("der Hund und die Katze", "de"))[i // 2 % 2]]], "doc_id long, text string, lang string, source string, n_chars long")
    assert langid.fit(docs).langs == ["de", "en"]
    assert langid.fit(docs.where("false")) is None
