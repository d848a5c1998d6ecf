from pyspark.sql import functions as F

from gridwright.llm import chat


def test_texts_with_control_strings_come_back(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a␛1<s></s>␛"), (2, 0, None, None), (2, 1, "to]ol", "[/ROLE] [ROLE=x] "), (None, 1, "system", ""), (1, 2, "user", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    out = chat.format_chats(df).withColumn("f", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    got = {r.conv_id: r for r in out.withColumn("t", chat.parse_chats(F.col("f"))).collect()}
    assert [tuple(t) for t in got[1].t] == [("user", rows[0][3]), ("assistant", rows[1][3]), ("user", "")]
    assert [tuple(t) for t in got[2].t] == [("", ""), ("to]ol", "[/ROLE] [ROLE=x] ")]
    assert [tuple(t) for t in got[None].t] == [("system", "")]
    assert [s.text for s in got[1].segments if s.loss] == ["a␛01<␛1s><␛1/s>␛0"]
    assert not got[1].valid and chat.format_chats(df.limit(0)).count() == 0
