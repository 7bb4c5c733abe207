"""Sentences are found with one reading of each line's text."""

from pyspark.sql import functions as F

from textloom.operators import segment
from textloom.operators.ordered import LineOrder


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_learned_lines_are_cut_once(spark):
    lines = spark.createDataFrame([(1, 0, "Mr. A. Oh came. He left.")], "doc_id long, pos int, text string")
    out = segment.segment_lines_learned(lines, spark.createDataFrame([("mr", 0.5)], "type string, score double"), ["doc_id", "pos"])
    assert [r["text"] for r in out.orderBy("sent").collect()] == ["Mr. A. Oh came.", "He left.[PAR]"]
    assert optimized(out).count("[。！？]") == 2  # two readers of one exchange


def test_abbreviation_rules_read_distinct_words(spark):
    df = spark.createDataFrame([("(etc. etc. etc a...   1.",)], "text string")
    out = segment.abbreviation_scores(df)
    assert [(r["type"], r["with_period"], r["n"]) for r in out.orderBy("type").collect()] == [("a..", 1, 1), ("etc", 2, 3)]
    words = optimized(out.select("type", "n"))
    assert words.index("^[\\p{L}.\\-]+$") < words.rindex("Aggregate")


def test_corpus_in_two_scans(spark):
    order = LineOrder(("k",), "i", (), ())
    texts = ["A b. C", "", "d. ", " E f!", "。。", "。。。", "。  ", "x. 1", "J.", "K. L", " ", "”", "Z."]
    for seed in range(6):
        picked = [texts[(seed * 5 + i * (seed + 1) + i * i) % len(texts)] for i in range(40)]
        df = spark.createDataFrame([(0, i, t) for i, t in enumerate(picked)], "k int, i int, text string")
        out = segment.segment_corpus(df, order)
        got = [r["text"] for r in out.orderBy("sentence_no").collect()]
        assert got == in_sequence(spark, picked)
    assert "Union" in optimized(out)  # sentences inside a line pass by the grouping


def in_sequence(spark, texts: list[str]) -> list[str]:
    """The rule read line by line."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    t = F.col("text")
    bare = segment.tx.strip(t)
    rows = df.select(
        "i", (bare == "").alias("blank"), F.split(segment._mark(t, ()), "\x01").alias("parts"),
        segment._mark(F.concat(bare, F.lit(" A")), ()).endswith("\x01 A").alias("ends"),
        t.rlike(rf"^\s*{segment._START}").alias("starts"),
        "text",
    ).orderBy("i").collect()
    found, gap, last = [], 0, None
    for r in rows:
        if r["blank"]:
            gap += 1
            continue
        for k, part in enumerate(r["parts"]):
            if k or last is None or (last and r["starts"]):
                found.append(part)
            else:
                found[-1] += "\n" * (gap + 1) + part
        gap, last = 0, r["ends"]
    flat = spark.createDataFrame([(i, x) for i, x in enumerate(found)], "i int, x string")
    return [r["x"] for r in flat.select("i", F.concat(segment.tx.strip(F.col("x")), F.lit("[PAR]")).alias("x")).orderBy("i").collect()]
