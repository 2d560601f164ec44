from pyspark.sql import functions as F

from sparkwell.plans import records as R


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_response_forms(spark):
    t = F.col("t")
    cases = {
        'x ```json\n{"answer": "a"}\n``` {"answer": "b"}': "a",
        'so {"answer": "b"} ok': "b",
        "no braces ": "no braces",
        '{"answer": ': '{"answer":',
        '{"other": 1}': "",
        "": "",
    }
    for text, want in cases.items():
        assert one(spark, R.parsed_answer(t), t=text) == want
    assert one(spark, R.parsed_facts(t), t='{"supporting_facts": [["a/b/T.txt", "s"], ["odd"], ["U", "v"]]}') == [["T", "s"], ["U", "v"]]
    assert one(spark, R.parsed_facts(t), t="bad") == []


def test_sentence_index_and_blank_lines(spark):
    lines = ["Other.", "", "The cat sat. More."]
    assert one(spark, R.sentence_index(F.col("l"), F.col("s")), l=lines, s="The cat sat.") == 2
    assert one(spark, R.sentence_index(F.col("l"), F.col("s"), strict=False), l=lines, s="The cat sat.") == 1
    assert one(spark, R.sentence_index(F.col("l"), F.col("s")), l=lines, s="Dogs.") == -1


def test_labels_and_marks(spark):
    t = F.col("t")
    for raw, want in {None: "unknown", " Follow-Up ": "Follow-up", "na": "N/A", "Clarification": "Clarification", "Else": "else"}.items():
        assert one(spark, R.multi_turn_label(t), t=raw) == want
    assert one(spark, R.query_text(t), t="|user|: hi there\n\n |agent|: so\r\n plain \u2028x") == "hi there\nso\nplain\nx"


def test_alignment_and_views_of_nothing(spark):
    none = F.array().cast("array<string>")
    assert one(spark, R.alignment(F.col("t"), none, none, none, none), t="x") == 0.0
    assert one(spark, R.overlap(F.col("n"), F.col("t")), n=["AB", "zz"], t="xaby") == 0.5
    docs = spark.createDataFrame([(1, None, None), (2, "T", "One. Two.")], "i long, title string, t string")
    got = [(r.doc_id, r.view, r.row_index) for r in R.table_views(docs, "i", F.col("title"), F.col("t")).orderBy("doc_id", "row_index").collect()]
    assert got == [(1, "table_summary", None), (2, "table_summary", None), (2, "table_row", 0), (2, "table_row", 1)]


def test_years_and_fallback(spark):
    y = F.col("y")
    for text, years, want in [("in 1999", ["2001"], False), ("in 1999 and 2001", ["2001"], True), ("no year", ["2001"], True), ("in 1999", [], True)]:
        assert one(spark, R.free_of_conflict(F.col("t"), y), t=text, y=years) is want
    hits = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 3, False), (2, 4, None)], "query_id int, id int, ok boolean")
    assert sorted(r.id for r in R.or_all(hits, F.col("ok")).collect()) == [1, 3, 4]
    assert one(spark, R.shortened(F.col("t"), 10), t="  abc   defghijkl ") == "abc def..."


def test_passages_are_whole(spark, data):
    from sparkwell import catalogue as c

    want = {r.page_id: f"passage: {r.url}: {r.html}" if r.url else f"passage: {r.html}" for r in c.read(spark, data, "pages").collect()}
    assert {r.page_id: r.passage for r in c.QUERIES["passage_serialise"](spark, data).collect()} == want
