"""Words are looked up and joined where they are, without a row for each."""

import random

from pyspark.sql import functions as F

from textloom.operators import detok, encode


def test_arrays_are_looked_up_as_rows_are(spark):
    vocab = spark.createDataFrame([("a", 7), ("b", 8), ("é", 9)], "token string, id int")
    rows = [(1, ["a", "x", "b"]), (1, ["b", "b"]), (2, []), (None, ["é"]), (3, None), (4, ["a", None]), (None, ["a"])]
    lists = spark.createDataFrame(rows, "doc_id long, word array<string>")
    want = encode.encode_by_lookup(lists.select("doc_id", F.posexplode("word").alias("pos", "word")), vocab, ["doc_id"])
    got = encode.encode_by_lookup(lists, vocab, ["doc_id"])
    assert got.schema["ids"].dataType == want.schema["ids"].dataType
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_keys_that_are_never_null(spark):
    vocab = spark.createDataFrame([("a", 7), ("b", 8)], "token string, id int")
    lists = spark.range(12).select("id", F.lit(1).alias("n"), F.array(F.lit("a"), F.lit("x")).alias("word"))
    lists = lists.unionByName(lists.where("id % 5 = 0")).coalesce(1)
    got = {r.id: r.ids for r in encode.encode_by_lookup(lists, vocab, ["id", "n"]).collect()}
    assert got == {i: [7, 7, 0, 0] if i % 5 == 0 else [7, 0] for i in range(12)}


def windowed(tokens):
    """The reading by ``spacing``."""
    pieces = F.array_sort(F.collect_list(F.struct("pos", F.concat("gap", "token").alias("s"))))
    text = F.array_join(F.transform(pieces, lambda p: p["s"]), "")
    return detok.spacing(tokens).groupBy("doc_id").agg(F.trim(F.regexp_replace(text, " {2,}", " ")).alias("text"))


def test_one_pass_gives_what_the_windows_give(spark):
    rng = random.Random(4)
    kinds = ["a", "Us", "s", "'", "'s", '"', "„", "“", "”", "`", "''", "``", "(", ")", "¿", "$", "€(", ",", ".", "?", "%", "12", "3", "l'",
             "don'", "-", "–", "li", "Mailen", "mail", "漢", "字a", "a漢", "…", "é", "'é", "K", "x  y", "b\n", "'\n", "𠀀", "1 "]
    langs = ["en", "cs", "fr", "it", "ga", "ko", "zh", None]
    rows = [(i, langs[i % 8], rng.choices(kinds, k=rng.randrange(0, 60))) for i in range(240)]
    rows += [(300, "en", ["'", "a", "'"]), (300, "en", ["'", "a", "'"]), (None, "fr", ["l'", "é"])]
    lists = spark.createDataFrame(rows, "doc_id long, lang string, token array<string>")
    exploded = lists.select("doc_id", "lang", F.posexplode("token").alias("pos", "token"))
    want = sorted(map(str, windowed(exploded).collect()))
    got = detok.detokenize(lists)
    assert sorted(map(str, got.collect())) == want
    assert sorted(map(str, detok.detokenize(exploded).collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
