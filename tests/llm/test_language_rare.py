"""Languages with few labelled rows, with none, and copies among the labelled rows."""

from pyspark.sql import functions as F

from dockmill.llm import language

FEW = [(1, "ο άνθρωπος και το σπίτι στον κήπο", "el"), (2, "ქართული ენა და დამწერლობა ძველია", "ka"), (3, "ქართული სახლი და ბაღი", "ka")]
MANY = [(10 + k, f"the house and the garden of this man by the river {w}", "en") for k, w in enumerate("oak elm ash fir yew box bay fig".split())]
SCHEMA = "doc_id long, text string, lang string, source string"


def test_every_labelled_language_is_kept(spark):
    rows = [(*r, "x.org") for r in FEW + MANY]
    docs = spark.createDataFrame([*rows, (99, " ", "en", "x.org")], SCHEMA)
    model = language.fit(docs)
    assert model.languages == ["el", "en", "ka"]
    none = F.lit(None).cast("string")
    found = language.identify(docs, model, text=F.col("text"), declared=none, host=F.col("source"), address=none)
    assert {r.doc_id: r["__language"] for r in found.collect()} == {r[0]: r[2] for r in rows} | {99: "und"}
    assert language.keep_known_language(docs).count() == len(rows)


def test_more_languages_than_64(spark):
    codes = [a + b for a in "abcdefghi" for b in "klmnopqrs"]
    docs = spark.createDataFrame([(k, f"{c}{c} {c}x{c} {c}y{c} {c}", c, "x.org") for k, c in enumerate(codes)], SCHEMA)
    assert language.fit(docs).languages == codes


def test_rows_without_labels_are_kept(spark):
    docs = spark.createDataFrame([(k, t, None, "x.org") for k, (_, t, _) in enumerate(FEW)] + [(9, "  ", None, "x.org"), (10, "12 34", None, "x.org")], SCHEMA)
    assert sorted(r.doc_id for r in language.keep_known_language(docs).collect()) == [0, 1, 2]


def test_declared_language_without_model_keeps_its_class(spark):
    model = language.TextModel({"en": [t for _, t, _ in MANY]})
    docs = spark.createDataFrame([(1, FEW[0][1], "el", "x.org"), (2, "the house by the river and the garden", "el", "x.org"), (3, " ", "el", "x.org")], SCHEMA)
    found = language.identify(docs, model, text=F.col("text"), declared=F.col("lang"), host=F.col("source"), address=F.lit(None).cast("string"))
    assert {r.doc_id: (r["__language"], r["__confidence"] >= 0.5) for r in found.collect()} == {1: ("el", True), 2: ("en", True), 3: ("und", True)}


def test_copies_count_once(spark):
    texts = [(k, f"text number {w} of the sample", "en", "x") for k, w in enumerate("one two three four".split())]
    docs = spark.createDataFrame(texts + [(9, texts[0][1], "en", "x")] * 50, SCHEMA)
    want = language.TextModel({"en": [t for _, t, *_ in texts]})
    assert abs(language.fit(docs).table - want.table).max() < 1e-6
