"""Sentences with a package's own names masked."""

from pkgloom.operators import text

LOREM = """

hi 123 4

        Lorem ipsum dolor sit amet, consectetur elit. Ut enim ad minim veniam, quis nostrud. Duis aute irure dolor; ok! no? Excepteur sint occaecat.

hello
foo
bar"""


def test_names_digits_and_short_fragments(spark):
    rows = [(1, LOREM, ["foo", "IPSUM", "sit Amet", "bore", None]), (2, None, ["x"]), (3, "C++ is c++. Fine", ["c++"]), (4, "a. b. c\nd.", None), (5, "labore bore BORE", ["bore"])]
    df = spark.createDataFrame(rows, "doc_id int, text string, own array<string>").withColumn("place", text.F.lit("clash"))
    got = {}
    for r in text.folded_sentences(df, variables="own").orderBy("doc_id", "place").collect():
        assert r.place == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append((r.sentence, r.original))
    assert got[1] == [
        ("hi _ _", "hi 123 4"), ("lorem _ dolor _, consectetur elit", "Lorem ipsum dolor sit amet, consectetur elit"), ("ut enim ad minim veniam, quis nostrud", "Ut enim ad minim veniam, quis nostrud"),
        ("duis aute irure dolor", "Duis aute irure dolor"), ("ok no excepteur sint occaecat.", "ok no Excepteur sint occaecat."), ("hello", "hello"), ("_", "foo"), ("bar", "bar"),
    ]
    assert 2 not in got and got[4] == [("a b c", "a b c"), ("d.", "d.")] and got[5] == [("labore _ _", "labore bore BORE")]
    assert got[3] == [("c++ is c++ fine", "C++ is c++ Fine")]  # no word ends behind a plus sign
    assert text.folded_sentences(df.limit(0), variables="own").count() == 0
    assert text.folded_sentences(df.where("doc_id = 5")).first().sentence == "labore bore bore"


def test_sentences_leave_in_small_batches(spark, monkeypatch):
    """400 texts of 20 sentences in one batch: no batch that leaves holds more than its share of letters."""
    rows = [(i, "\n".join(f"Sentence number {n} of this text is long enough" for n in range(20)), ["text", None]) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id int, text string, own array<string>")
    want = sorted(map(tuple, text.folded_sentences(d, variables="own").collect()))
    monkeypatch.setattr(text, "PIECE", 10_000)
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, run, schema: list(run(self.toArrow().to_batches())))
    got = text.folded_sentences(d, variables="own")
    assert len(got) > 60 and max(b.num_rows for b in got) < 120
    assert sorted(tuple(x.values()) for b in got for x in b.to_pylist()) == want and len(want) == 8000
