"""Routing, preferences, picks and spelling."""

from pyspark.sql import functions as F

from recallgrid.operators import routing


def test_preferences(spark):
    said = [("I prefer dark roast coffee. I want to sleep, I prefer dark roast coffee!",), (None,), ("I prefer it",)]
    got = [r[0] for r in spark.createDataFrame(said, "t string").select(routing.preference_phrases(F.col("t"))).collect()]
    assert got == [["dark roast coffee", "sleep"], [], []]
    turns = spark.createDataFrame([(1, 0, "user", "I usually cook at home"), (1, 1, "assistant", "I usually lie here"), (2, 0, "user", "no")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in routing.preference_documents(turns).collect()] == [(1, "User has mentioned: cook at home")]


def test_rooms_and_two_stages(spark):
    rooms = spark.createDataFrame([("a", "parser design"), ("b", "garden plan"), ("c", "parser garden")], "room string, summary string")
    names = lambda df: sorted(r[0] for r in df.collect())
    assert names(routing.best_rooms(rooms, ["parser"], 2)) == ["a", "c"] and names(routing.best_rooms(rooms, ["nothing"], 1)) == ["a", "b", "c"]
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "vec_id string, v array<double>")
    docs = rooms.select(F.col("room").alias("vec_id"), F.col("summary").alias("document"))
    got = routing.two_stage(vectors, docs, docs.withColumnRenamed("document", "summary"), [1.0, 0.0], ["garden"], 1)
    assert [r.vec_id for r in got.collect()] == ["b"]


def test_promote(spark):
    ranking = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, rank int")
    order = lambda df: [r.id for r in df.orderBy("rank").collect()]
    assert order(routing.promote(ranking, "c", "id")) == ["c", "a", "b"] and order(routing.promote(ranking, "c", "id", pool=2)) == ["a", "b", "c"]


def test_spelling_has_guards(spark):
    fix = lambda w: {"teh": "the", "helo": "hello", "thsi": "this", "coherently": "it"}.get(w, w)
    text = "> helo thsi, Helo x9helo coherently teh\nhelo there"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(routing.corrected_transcript(F.col("t"), fix, ["nobody"]).alias("c")).collect()
    assert row[0].c == "> hello this, Helo x9helo coherently teh\nhelo there" and row[1].c is None
    assert spark.range(1).select(routing.entity_metadata(F.lit("Max met Alice. Alice met Max. Bob"))).first()[0] == "Alice;Max"


def test_questions_about_answers(spark):
    assert routing.about_answers("Remind me what YOU SAID about tea") and not routing.about_answers("What tea do I like?")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id int, v array<double>")
    whole = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id int, v array<double>")
    corpus = asked.select("vec_id", (10 - F.col("vec_id")).alias("position"))
    order = [r.vec_id for r in routing.two_pass(asked, whole, [1.0, 0.0], corpus, pool=3).orderBy("rank").collect()]
    assert order == [2, 1, 0, 4, 3]  # the three nearest by user turns, nearest by whole text first; the others by position
    assert [r.vec_id for r in routing.two_pass(asked.limit(0), whole, [1.0, 0.0], corpus).orderBy("rank").collect()] == [4, 3, 2, 1, 0]


def test_halls_move_hits_and_hide_none(spark):
    rows = [("a", "x", [1.0, 1.0]), ("b", "x", [0.0, 1.0]), ("c", "y", [0.0, 1.0]), ("d", None, [0.0, 1.0]), ("e", "z", [0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id string, hall string, v array<double>")
    found = lambda halls: {r.vec_id: round(r.distance, 6) for r in routing.hall_navigation(v, [1.0, 0.0], halls, pool=1).collect()}
    assert found(["x", "y"]) == {"a": round((1 - 0.5**0.5) * 0.75 * 0.85, 6), "b": 0.75, "c": 0.9, "d": 1.0, "e": 1.0}
    assert found(["hall_general", "y"])["c"] == 0.9 and found([])["c"] == 1.0


def test_layers_and_dialogs(spark):
    hits = spark.createDataFrame([("s", 0.5), ("s", 0.7), ("t", 0.4)], "conv_id string, distance double")
    diary = spark.createDataFrame([("s", 0.6), ("u", 0.5)], "conv_id string, distance double")
    assert {r.conv_id: round(r.distance, 6) for r in routing.with_layer(hits, diary, "conv_id").collect()} == {"s": 0.48, "t": 0.4, "u": 0.4}
    from recallgrid.operators import fusion

    row = spark.createDataFrame([("Ann said: the kiln is hot",)], "t string")
    near = lambda *a: round(row.select(fusion.dialog_distance(F.lit(1.0), F.col("t"), *a)).first()[0], 6)
    assert near(["ann", "kiln"], ["Ann"]) == 0.4 and near(["ann", "lathe"], ["Ann"]) == 0.8 and near(["ann"], ["Ann"], ["is hot"]) == 0.32
