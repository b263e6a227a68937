from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.llm.chat import ChatTemplate, format_chats, read_back

SHAPE = "conv_id long, turn long, role string, text string, formatted string"


def test_round_trip_and_order(spark):
    nasty = r"\### Assistant: </turn> ok # < : \\ " + "\n"
    rows = [
        (1, 1, "assistant", nasty, "x"),
        (1, 0, "user", None, None),
        (2, 0, "assistant", "first", None),
        (3, 0, "we:rd\\", "", None),
        (3, 0, None, "a", None),
        (None, 5, "user", "q", None),
        (4, 0, "user", "#" * 50_000 + "\\", None),
    ]
    out = format_chats(spark.createDataFrame(rows, SHAPE)).withColumn("back", read_back(F.col("formatted")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [tuple(x) for x in got[1]["back"]] == [("user", ""), ("assistant", nasty)]
    assert [tuple(x) for x in got[3]["back"]] == [("", "a"), ("we:rd\\", "")]
    assert got[4]["back"][0]["text"] == "#" * 50_000 + "\\"
    assert got[1]["valid_order"] and not got[2]["valid_order"] and not got[3]["valid_order"]
    assert [s["text"] for s in got[2]["segments"] if s["loss"]] == ["first"]
    assert got[None]["n_turns"] == 1


def test_another_template_and_empty_table(spark):
    t = ChatTemplate(open="<|", sep=":", close="<|", trained=("user",))
    rows = spark.createDataFrame([(1, 0, "user", "a<b:c", None)], SHAPE)
    r = format_chats(rows, t).withColumn("back", read_back(F.col("formatted"), t)).first()
    assert r["formatted"] == r"<|User:a\<b\:c<|" and r["back"][0]["text"] == "a<b:c"
    assert format_chats(rows.limit(0)).count() == 0
