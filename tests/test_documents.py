import gzip
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import spec
from textloom.operators import detok, markup
from textloom.plans import corpora
from textloom.sources import tables, text_lines
from textloom.streaming.lines import clean_stream

WRITTEN = """<wtext><div level="1" n="1" type="chapter"><head><s>The Start</s></head><p><s>One two.</s><s>Three .</s>
<quote><p><s>quoted text</s></p></quote><s>After.</s></p>
<div level="2" n="3" type="section"><p type="caption:x"><s>Cap one</s></p><sp><speaker><s>Ann</s></speaker><p><s>Hello there</s></p>
<stage><s>exits</s></stage><note><s>no</s></note></sp></div>
<div level="2" n="4" type="part"><list><head><s>Items</s></head><label><s>a)</s></label><item><s>first</s></item><item><s>second</s></item></list>
<stage><s>skip</s></stage><lg><l><s>verse</s></l></lg></div></div></wtext>"""
SPOKEN = """<stext><div n="2" type="talk"><u who="A"><s>Hi you</s><pause/><s>there</s></u><u who="B"><s>!!</s></u><u who="A"><s>bye</s></u></div></stext>"""


def test_written_blocks(spark):
    df = spark.createDataFrame([(1, WRITTEN), (2, "<a><b>")], "doc_id long, xml string")
    els = markup.elements(df)
    got = [r.text for r in markup.written_blocks(els).orderBy("pos", "sub").collect()]
    assert got == [
        "## The Start", "One two.\nThree.", "> quoted text", "After.", "### Cap one", "Ann: 'Hello there'", "Ann: exits", "",
        "### Part 1.4", "Items: ", "- a) first", "- second", "verse", "", "", "",
    ]
    assert [r.doc_id for r in markup.unparsed(df).collect()] == [2]
    assert markup.unknown_tags(els).count() == 0


def test_spoken_blocks(spark):
    df = spark.createDataFrame([(1, SPOKEN)], "doc_id long, xml string")
    got = [r.text for r in markup.spoken_blocks(markup.elements(df), ["Ida", "Max"]).orderBy("pos", "sub").collect()]
    name = got[1].split(":")[0]
    assert name in ("Ida", "Max")
    assert got == ["## Talk 2", f"{name}: 'Hi you\nthere'", f"{name}: 'bye'", "", ""]


def test_detokenize_matches_sequential_reading(spark):
    rng = random.Random(4)
    bag = ["the", "Jones", "dogs", "s", "'", "'", '"', '"', "'s", "'ll", "(", ")", ",", ".", "$", "5", "!", "“", "a'", "l'", "eau", "``"]
    rows = [(i, rng.choice(["en", "en", "fr"]), [rng.choice(bag) for _ in range(rng.randint(1, 14))]) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id int, lang string, tokens array<string>")
    got = {r.doc_id: r.text for r in detok.detokenize_lists(df, unescape=False).collect()}
    assert got == {i: spec.detokenize(t, lang) for i, lang, t in rows}


def test_detokenize_cases(spark):
    rows = [
        (0, "en", ["well", "@-@", "known", "&amp;quot;", "(", "x", ")", "&lt;"]), (1, "cs", ["3", ",", "14", "„", "a", "“"]),
        (2, "cs", ["bude'", "-", "li", "x"]), (3, "zh", ["你", "好", "ok"]), (4, "it", ["dell'", "anno"]),
    ]
    df = spark.createDataFrame(rows, "doc_id int, lang string, tokens array<string>")
    got = {r.doc_id: r.text for r in detok.detokenize_lists(df).collect()}
    assert got == {0: "well-known &quot; (x) <", 1: "3,14 „a“", 2: "bude'-li x", 3: "你好 ok", 4: "dell'anno"}


def test_text_files(spark, tmp_path):
    folder = tmp_path / "corpus_dev"
    folder.mkdir()
    lines = [f"line {i}" for i in range(3000)]
    (folder / "cbt.dev").write_text("\n".join(lines) + "\n")
    with gzip.open(folder / "qed.train.gz", "wt") as f:
        f.write("a\nb\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = text_lines.read_corpora(spark, str(folder))
        got = [(r.line_no, r.text) for r in df.where("corpus = 'cbt' and split = 'dev'").orderBy("line_no").collect()]
        assert got == list(enumerate(lines))
        assert [r.text for r in df.where("corpus = 'qed'").orderBy("line_no").collect()] == ["a", "b"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    out = str(tmp_path / "out")
    text_lines.write_lines(df.where("corpus = 'cbt'"), ["line_no"], out, files=3)
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split("\n")[:-1] == lines
    assert text_lines.corpus_paths("d", "10M", ["cbt"]) == ["d/corpus_10M/cbt.train"]


@pytest.mark.parametrize("files", [4, 64])
def test_sink_reads_back(spark, tmp_path, files):
    lines = [f"line {i}" for i in range(2000)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, text string").repartition(5)
    for corpus in ("cbt", "qed"):
        text_lines.write_lines(df, ["line_no"], str(tmp_path / "clean_10M" / f"{corpus}.train"), files=files)
    got = text_lines.read_corpora(spark, [str(tmp_path / "clean_10M" / f"{c}.train") for c in ("cbt", "qed")])
    rows = [tuple(r) for r in got.orderBy("corpus", "line_no").collect()]
    assert rows == [("10M", c, i, t) for c in ("cbt", "qed") for i, t in enumerate(lines)]
    with pytest.raises(Exception, match="not a corpus path"):
        text_lines.write_lines(df, ["line_no"], str(tmp_path / "plain"))
        text_lines.read_corpora(spark, str(tmp_path / "plain")).collect()


def test_odd_documents(spark):
    deep = "<wtext>" + "<div>" * 1500 + "<p><s>low</s></p>" + "</div>" * 1500 + "</wtext>"
    df = spark.createDataFrame([(1, "<wtext><p><s>a\x01b</s></p></wtext>"), (2, deep), (3, "<wtext><p>")], "doc_id long, xml string")
    els = markup.elements(df)
    got = dict(map(tuple, els.groupBy("doc_id").count().collect()))
    assert got == {1: 3, 2: 1503}
    assert els.where("tag = 's'").orderBy("doc_id").select("text").first()[0] == "a b"
    assert [r.doc_id for r in markup.unparsed(df).collect()] == [3]


def test_tables(spark, tmp_path):
    tsv = tmp_path / "p.tsv"
    tsv.write_text("word_a\tword_b\tlabel\na\tb\t1\nc\t\t0\nd\te\t\nf\tg\t0.0\n")
    assert [(r.word_a, r.label) for r in tables.read_pairs(spark, str(tsv), "WaW").orderBy("word_a").collect()] == [("a", 1), ("f", 0)]
    assert tables.read_pairs(spark, str(tsv), "WaW", keep_nulls=True).count() == 4
    rows = spark.createDataFrame([(s, r) for s in ("IOV", "OOV") for r in ("train", "dev", "test")], "subset string, role string")
    got = {(r.part, r.subset, r.role) for r in tables.select_roles(rows, "IOV_train_OOV_train_IOV_test").collect()}
    assert got == {("train", "IOV", "train"), ("dev", "OOV", "train"), ("test", "IOV", "test")}
    log = str(tmp_path / "log")
    for step in (1, 2):
        tables.append_metrics(spark.createDataFrame([("r", step, 0, "loss", 0.5)], "run_id string, step long, epoch int, metric string, value double")
                              .withColumn("ts", F.lit("2024-01-01").cast("timestamp")), log)
    assert tables.read_metrics(spark, log).count() == 2
    csv = tmp_path / "runs.csv"
    csv.write_text('"Name","val_accuracy","Notes"\n"x","0.5","Don\'t know"\n')
    assert tables.read_run_summary(spark, str(csv)).first().val_accuracy == 0.5
    freqs = spark.createDataFrame([("a", 2), ("b", 9)], "token string, freq long")
    tables.write_frequencies(freqs, str(tmp_path / "f"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "f").glob("part-*"))) == "b: 9\na: 2\n"
    vocab = spark.createDataFrame([("a", 7, 0.0, "word")], tables.VOCAB_SCHEMA)
    tables.write_vocab(vocab, str(tmp_path / "v"))
    assert tables.read_vocab(spark, str(tmp_path / "v")).collect() == vocab.collect()


def test_cleaning_runs_on_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("He said.Then\n“q”\n")
    stream = spark.readStream.text(str(src)).withColumnRenamed("value", "text")
    q = clean_stream(stream).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert {r.text for r in spark.table("cleaned").collect()} == {"He said. Then", '"q"'}


def test_all_plans_exist():
    assert len(corpora.CORPUS_PLANS) == 10


def test_elements_are_held_for_few_documents_at_a_time(spark, monkeypatch):
    """A batch of many documents leaves its task in parts."""
    sizes = []

    def counted(self, run, schema):
        one = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "xml": ["<wtext><p><s>a b</s></p></wtext>", None] * 500})
        sizes.extend(b.num_rows for b in run(iter([one])))
        return plain(self, run, schema)

    docs = spark.createDataFrame([(1, '<wtext n="2"><p><s>a</s></p></wtext>'), (2, "<wtext>"), (3, None)], "doc_id long, xml string")
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    rows = markup.elements(docs).orderBy("idx").collect()
    assert [(r.doc_id, r.tag, r.parent, r.last, r.attrs, r.text) for r in rows] == [
        (1, "wtext", None, 2, {"n": "2"}, None), (1, "p", 0, 2, {}, "a"), (1, "s", 1, 2, {}, "a")]
    assert sum(sizes) == 1500 and max(sizes) < 300
    assert [r.doc_id for r in markup.unparsed(docs).orderBy("doc_id").collect()] == [2, 3]
