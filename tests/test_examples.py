import random

from pyspark.sql import functions as F

import spec
from textloom.functions import arrays as ar
from textloom.operators import evalsets, examples, metrics


def _segments(spark, n=200):
    rng = random.Random(5)
    rows = [(i, [rng.randint(0, 300) for _ in range(rng.choice([0, 1, 10, 30, 60]))]) for i in range(n)]
    return spark.createDataFrame(rows, "seg_id long, ids array<int>")


def test_examples_are_framed_and_padded(spark):
    out = examples.build_examples(_segments(spark), 32).collect()
    for r in out:
        kept = r.ids[:30]
        assert r.input_ids == [1, *kept, 2, *[3] * (30 - len(kept))]
        assert r.is_pad == [False] * (len(kept) + 2) + [True] * (30 - len(kept))


def test_span_masks(spark):
    rows = examples.build_examples(_segments(spark, 400), 32, short_p=0.3)
    run = lambda epoch, parts: {
        r.seg_id: (r.input_ids, r.inputs, r.labels)
        for r in examples.mask_spans(rows.repartition(parts), 300, seed=1, epoch=epoch).collect()
    }
    one = run(0, 1)
    assert one == run(0, 7) and one != run(1, 1)
    masked = total = hidden = 0
    for ids, inputs, labels in one.values():
        assert len(inputs) == len(labels) == 32 and labels[-1] == -100
        for x, y, lab in zip(ids, inputs, labels):
            assert lab in (-100, x) and (lab != -100 or y == x)
            assert x >= 6 or lab == -100
            assert y == x or y == 4 or 5 <= y < 300
        n = sum(x >= 6 for x in ids)
        if sum(x >= 6 for x in ids[:-1]):
            assert sum(lab != -100 for lab in labels) >= 1
        total += n
        masked += sum(lab != -100 for lab in labels)
        hidden += sum(y == 4 and lab != -100 for y, lab in zip(inputs, labels))
    assert 0.13 < masked / total < 0.25 and 0.7 < hidden / masked < 0.9


def test_batches(spark):
    rows = spark.range(203).select(F.col("id").alias("seg_id"), examples.shard_of(F.col("id"), 3).alias("shard"))
    out = examples.epoch_batches(rows, 8, seed=1, epoch=2, n_shards=3)
    got = out.collect()
    assert {(r.shard, r.batch): 0 for r in got}.keys() == {(s, b) for s in range(3) for b in range(8)}
    assert len({(r.shard, r.batch, r.slot) for r in got}) == len(got) == 3 * 8 * 8
    again = {r.seg_id: (r.batch, r.slot) for r in examples.epoch_batches(rows.repartition(5), 8, 1, 2, 3).collect()}
    assert again == {r.seg_id: (r.batch, r.slot) for r in got}
    other = {r.seg_id: (r.batch, r.slot) for r in examples.epoch_batches(rows, 8, 1, 3, 3).collect()}
    assert other != again
    assert examples.steps_per_epoch(rows, 8).first().steps == 8
    left = examples.resume_window(out.withColumn("epoch", F.lit(1)), 8, done_steps=10, max_steps=14)
    assert {r.step for r in left.collect()} == {10, 11, 12, 13}


def test_fair_lengths_match_one_by_one_cutting(spark):
    rng = random.Random(9)
    cases = [([rng.randint(0, 9) for _ in range(rng.randint(1, 4))], rng.randint(-1, 25)) for _ in range(400)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<int>, b int")
    got = [list(r.o) for r in df.select("i", ar.fair_lengths(F.col("a"), F.col("b")).alias("o")).orderBy("i").collect()]
    assert got == [spec.shorten(a, b) for a, b in cases]


def test_pairs(spark):
    df = spark.createDataFrame([([7, 8], [9]), ([7] * 4, [8] * 4)], "a array<int>, b array<int>")
    ids, real = evalsets.encode_pair(F.col("a"), F.col("b"), 5)
    assert [(list(r[0]), list(r[1])) for r in df.select(ids, real).collect()] == [([7, 8, 9, 0, 0], [1, 1, 1, 0, 0]), ([7, 7, 7, 7, 8], [1] * 5)]
    ids, real = evalsets.encode_framed_pair(F.col("a"), F.col("b"), 8)
    assert [list(r[0]) for r in df.select(ids, real).collect()] == [[1, 7, 8, 2, 9, 2, 3, 3], [1, 7, 7, 7, 2, 8, 8, 2]]
    assert evalsets.longest_pair(df, "a", "b").first().max_length == 8


def test_sentence_sets(spark):
    df = spark.createDataFrame(
        [(0, 0, [[7, 8], [9]], [[False, True], [True]]), (1, 0, [[5], [6], [7]], [[True], [True], [False]])],
        "id int, batch int, sentences array<array<int>>, span_masks array<array<boolean>>",
    )
    a, b = evalsets.collate_sentences(df, max_length=7).orderBy("id").collect()
    assert a.input_ids == [1, 7, 8, 2, 9, 2, 3] and a.segment_ids == [0, 0, 0, 0, 1, 1, 0]
    assert a.span_mask == [True, False, True, True, True, True, True] and a.is_pad == [False] * 6 + [True]
    assert b.input_ids == [1, 5, 2, 6, 2, 7, 2] and b.segment_ids == [0, 0, 0, 1, 1, 0, 0]
    cut = evalsets.collate_sentences(df.drop("span_masks").where("id = 0"), max_length=5).first()
    assert cut.input_ids == [1, 7, 2, 9, 2]


def test_probing(spark):
    span = lambda s, e: {"s": s, "e": e}
    rows = [
        (1, [5, 6, 7], {"pos": [{"label": [1, 1], "span_1": span(0, 1), "span_2": None}], "coref": [{"label": [0], "span_1": span(0, 0), "span_2": span(2, 2)}]}),
        (2, [], {"pos": []}), (3, [5] * 127, {"pos": []}), (4, [9], {"pos": []}),
    ]
    from textloom.sources.tables import PROBE_SCHEMA

    df = spark.createDataFrame(rows, PROBE_SCHEMA)
    spans = evalsets.labelled_spans(df, {"pos": 3, "coref": 2})
    got = {r.task: r for r in spans.collect()}
    assert got["pos"].labels == [0, 2, 0] and got["pos"].span_mask_1 == [False, False, True] and got["pos"].span_mask_2 is None
    assert got["coref"].labels == [1, 0] and got["coref"].span_mask_2 == [True, True, False]
    kept = df.where(F.size("subwords").between(1, 126)).withColumn("batch", F.lit(0))
    inputs, shifted = evalsets.collate_probes(kept, spans)
    assert {r.sent_id: (r.sentence_index, r.input_ids) for r in inputs.collect()} == {1: (0, [1, 5, 6, 7, 2]), 4: (1, [1, 9, 2, 3, 3])}
    assert {r.task: r.span_mask_1 for r in shifted.collect()}["pos"] == [True, False, False, True, True]


def test_masked_copies(spark):
    df = spark.createDataFrame([(1, "good", [7, 8]), (1, "bad", [9])], "pair_id int, side string, token_ids array<int>")
    out = evalsets.mask_each_position(evalsets.with_pair_width(df, ["pair_id"]), ["pair_id", "side"])
    got = {(r.side, r.pos): (r.input_ids, r.is_pad, r.target) for r in out.collect()}
    assert got[("good", 1)] == ([1, 7, 4, 2], [False] * 4, 8)
    assert got[("bad", 0)] == ([1, 4, 2, 3], [False, False, False, True], 9)


def test_metrics(spark):
    hist = spark.createDataFrame([("a", e, float(e)) for e in range(1, 6)], "run string, epoch int, value double")
    r = metrics.late_history(hist, ["run"], "epoch").first()
    assert (r["max"], r["min"], r["mean"], r["std"], r.n) == (5.0, 3.0, 4.0, 1.0, 3)
    ties = spark.createDataFrame([("g", "s", 1, "good", -1.0), ("g", "s", 1, "bad", -1.0), ("g", "s", 2, "good", -1.0), ("g", "s", 2, "bad", -2.0)],
                                 "grp string, subgrp string, pair_id int, side string, log_p double")
    assert {r.accuracy for r in metrics.minimal_pair_accuracy(ties).collect()} == {50.0}
    spans = spark.createDataFrame([("pos", "dev", [1, 0, 1], [1, 1, 0])], "task string, split string, predicted array<int>, labels array<int>")
    assert metrics.probing_f1(spans).first().f1 == 0.5
    batches = spark.createDataFrame([(0, 1, 1), (0, 0, 1), (1, 1, -1), (2, 1, 1)], "batch int, pred int, label int")
    r = metrics.batch_accuracy(batches).first()
    assert (r.batch_mean, r.micro) == ((0.5 + 0 + 1) / 3, 2 / 3)
    secs = spark.createDataFrame([(0.5,), (59.6,), (3661.0,), (90000.0,)], "s double")
    assert [r[0] for r in secs.select(metrics.elapsed(F.col("s"))).collect()] == ["0:00:00", "0:01:00", "1:01:01", "1 day, 1:00:00"]
    runs = spark.createDataFrame([("WaW_te_xs_M-BPE_16384_IOV", "IOV", 0.7, 0.5), ("WaW_te_xs_M-BPE_16384", "x", 0.8, 0.4)],
                                 "Name string, Notes string, val_accuracy double, val_loss double")
    r = metrics.leaderboard(runs).first()
    assert (r.task, r.lang, r.tokenizer, r.val_accuracy, r.runs) == ("WaW", "te", "M-BPE", 0.8, 2)
    xy = spark.createDataFrame([(1.5, 1), (2.5, 3), (2.5, 2), (9.0, 9)], "x double, y int")
    assert abs(metrics.spearman(xy, "x", "y", scale=4.0).first().spearman - 0.9486832980505138) < 1e-12
    test = spark.createDataFrame([(0, "w")], "row_id int, word string")
    scores = spark.createDataFrame([(0, [0.1, 0.9])], "row_id int, logits array<double>")
    assert evalsets.attach_predictions(test, scores).first().predicted == 1
    tops = spark.createDataFrame([(0, [0.0, 2.0, 1.0])], "id int, logits array<double>")
    v = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id int, token string")
    assert [r.token for r in metrics.top_tokens_per_position(tops.withColumnRenamed("id", "at"), v, ["at"], 2).orderBy("rank").collect()] == ["b", "c"]


def test_framed_pairs_name_their_texts_once(spark):
    """The ids of a text are made once for each output, however many lengths are tried."""
    rows = spark.createDataFrame([("a b c", "d e f g"), ("a", None), ("", "b")], "a string, b string")
    ids = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"\w+"), 0), F.length)
    out = rows.select(*(c.alias(n) for c, n in zip(evalsets.encode_framed_pair(ids("a"), ids("b"), 8), ("ids", "real"), strict=True)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 4
    assert [list(r.ids) if r.ids else None for r in out.collect()] == [[1, 1, 1, 2, 1, 1, 1, 2], None, [1, 2, 1, 2, 3, 3, 3, 3]]
