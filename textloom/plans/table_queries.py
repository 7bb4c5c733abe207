"""The engine's operators run over the given tables, one callable per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import arrays as ar
from textloom.functions import text as tx
from textloom.functions import words as wd
from textloom.functions.hashing import digest
from textloom.operators import detok, encode, evalsets, examples, markup, metrics, segment, unigram, vocab
from textloom.operators import lines as ln
from textloom.operators.ordered import DOCUMENT_LINES, LineOrder
from textloom.plans import corpora
from textloom.session import cut_lineage, spread

_PAGE_LINES = LineOrder(("page_id",), "pos", (), ())
_ONE_DOC = LineOrder(("doc_id",), "pos", (), ())


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "conversations") else df


def _big(c: str):
    return F.col(c).cast("bigint").alias(c)


def _joined(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


#: What is put before and after a line so that every cleaning rule meets text that it changes. Fixed values; the SQL spells
#: them out again.
SALTS = (
    ("- ", ""), ('He said " yes , sir " and left . ', ""), ("I do n't say it 's you , they 've . ", ""),
    ("-LRB- see -RRB- `` so '' ", " -LSB-x-RSB-"), ("( a ) and( b ). 5 % of $ 5 , 10:30 ;x ", " …"), ("so ﬁrst oﬃce ĳ ", ""),
    ("ＡＢＣ１２ ", ""), ("cafÃ© donâ€™t ", ""), ("a\x07b ", ""), ("“curly” ‘single’ ", ""), ("nbsp\u00a0here\u2003em  ", ""),
    ("e\u0301a ", ""), ("", " x :"), ("[TAB] ", ""), ("   ", "\t"), ("&lt;b&gt; 1 -> 2 ", " &amp;"),
)
_UNSALTED = 16  # further line classes that stay as they are


def salted(t, doc_id, pos):
    """Every other line with a salt, chosen by document and line; one class becomes a lone mark; blank lines stay blank."""
    k = F.pmod(doc_id * 31 + pos * 7, F.lit(len(SALTS) + 1 + _UNSALTED))
    out = t
    for i, (before, after) in enumerate(SALTS):
        out = F.when(k == i, F.concat(F.lit(before), t, F.lit(after))).otherwise(out)
    return F.when(t == "", t).when(k == len(SALTS), F.lit(".")).otherwise(out)


def corpus_lines(spark: SparkSession, sf: str, salt: bool = True) -> DataFrame:
    """Documents as lines per (lang, source), salted; one blank after each, two after every third."""
    gap = F.array_repeat(F.lit(""), F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1))
    lines = F.concat(F.split("text", "\n"), gap)
    rows = _table(spark, sf, "documents").select("lang", "source", "doc_id", F.posexplode(lines).alias("pos", "text"))
    return rows.withColumn("text", salted(F.col("text"), F.col("doc_id"), F.col("pos"))) if salt else rows


def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Pages cut before every tag."""
    cut = F.split(F.replace("html", F.lit("<"), F.lit("\x01<")), "\x01")
    return _table(spark, sf, "pages").select("page_id", F.posexplode(cut).alias("pos", "text"))


def _lines_out(df: DataFrame) -> DataFrame:
    return df.select("lang", "source", "doc_id", _big("pos"), "text")


def doc_lines_dedup(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    docs = docs.withColumn("text", tx.collapse_blanks(F.col("text")))
    return ln.drop_repeats(docs, _ONE_DOC).select("doc_id", _big("pos"), "text")


def lines_spoken(spark, sf):
    df = corpus_lines(spark, sf).withColumn("text", tx.strip(F.col("text"))).where(tx.not_lone_punctuation(F.col("text")))
    t = F.col("text")
    df = df.withColumn("text", F.when(t == "", "").otherwise(tx.quote(tx.capitalise_first(t))))
    return _lines_out(ln.drop_repeats_keep_blanks(df, DOCUMENT_LINES))


def lines_child_speech(spark, sf):
    return _lines_out(corpora.child_speech(corpus_lines(spark, sf), DOCUMENT_LINES))


def lines_spoken_dialogue(spark, sf):
    return _lines_out(corpora.spoken_dialogue(corpus_lines(spark, sf), DOCUMENT_LINES))


def lines_treebank(spark, sf):
    return _lines_out(corpora.treebank_stories(corpus_lines(spark, sf), DOCUMENT_LINES))


def lines_story_gaps(spark, sf):
    df = corpus_lines(spark, sf)
    indented = F.when(F.col("pos") % 4 == 1, F.concat(F.lit("    "), "text")).otherwise(F.col("text"))
    return _lines_out(corpora.indented_stories(df.withColumn("text", indented), DOCUMENT_LINES))


def paragraphs_reflow(spark, sf):
    return _lines_out(corpora.wrapped_books(corpus_lines(spark, sf), DOCUMENT_LINES))


def lines_subtitle(spark, sf):
    return _lines_out(corpora.subtitles(corpus_lines(spark, sf), DOCUMENT_LINES))


def _marked_page_lines(spark: SparkSession, sf: str, arms) -> DataFrame:
    """Page lines, some of which (by page and line) are changed by ``arms``; empty lines stay empty."""
    out = F.col("text")
    for k, changed in enumerate(arms):
        out = F.when((F.col("page_id") * 7 + F.col("pos") * 3) % 23 == k, changed).otherwise(out)
    return page_lines(spark, sf).withColumn("text", F.when(F.col("text") == "", "").otherwise(out))


def _captions(rows):
    return corpora.talk_captions(rows, _PAGE_LINES).select("page_id", _big("pos"), "text")


def lines_captions(spark, sf):
    return _captions(page_lines(spark, sf))


def lines_captions_marked(spark, sf):
    """Captions of pages with escaped tags, arrows, bare labels and dashes."""
    t = F.col("text")
    arms = (F.concat(F.lit("&lt;i&gt; "), t), F.concat(t, F.lit(" -> x")), F.lit("12 :"), F.concat(F.lit("- "), t), F.lit("Ab :"))
    return _captions(_marked_page_lines(spark, sf, arms))


STUB_WORDS = (" the ", " la ", " der ")


def stub_filter(spark, sf):
    return _lines_out(corpora.simple_encyclopedia(corpus_lines(spark, sf), DOCUMENT_LINES, stub_phrases=STUB_WORDS))


def lines_phone(spark, sf):
    return _lines_out(corpora.phone_dialogue(corpus_lines(spark, sf), DOCUMENT_LINES))


def stub_filter_phrases(spark, sf):
    """Boilerplate entries by the default phrases, which stand in some of the lines."""
    out = F.col("text")
    for k, phrase in enumerate(tx.STUB_PHRASES):
        out = F.when((F.col("doc_id") * 5 + F.col("pos") * 3) % 29 == k, f"Ab {phrase} Cd.").otherwise(out)
    rows = corpus_lines(spark, sf).withColumn("text", F.when(F.col("text") == "", "").otherwise(out))
    return _lines_out(corpora.simple_encyclopedia(rows, DOCUMENT_LINES))


def wiki_markup(spark, sf):
    return _wiki(page_lines(spark, sf))


def wiki_markup_furnished(spark, sf):
    """Encyclopedia lines of pages with category and file lines."""
    t = F.col("text")
    arms = (F.concat(F.lit("[[Category:"), "pos", F.lit("]]")), F.lit("[[File:a.png|x]]"), F.concat(F.lit("[[Aa|Bb]] [[Cc]] [12] "), t))
    return _wiki(_marked_page_lines(spark, sf, arms))


def _wiki(rows):
    t = F.regexp_replace("text", r"^<h1>(.*)\z", "= = = $1 = = =")
    t = F.regexp_replace(t, r"^<a href=\"([^\"]*)\">(.*)\z", "[[$1|$2]] [1]")
    out = corpora.encyclopedia(rows.withColumn("text", t), _PAGE_LINES)
    return out.select("page_id", _big("pos"), _big("sub"), "text")


def corpus_union(spark, sf):
    """Documents of each language as one corpus, concatenated in a fixed order; other languages and null come last."""
    names = ["de", "en", "es", "fr"]
    lines = corpus_lines(spark, sf, salt=False)
    parts = [lines.where(F.col("lang") == n) for n in names]
    parts.append(lines.where(~F.coalesce(F.col("lang").isin(names), F.lit(False))))
    out = corpora.union_corpora(parts, [*names, "other"], DOCUMENT_LINES)
    return out.groupBy("corpus_rank", "lang", "source").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"),
        F.max("doc_id").alias("last_doc"),
    ).select(_big("corpus_rank"), "lang", "source", "lines", "chars", "last_doc")


def clean_full(spark, sf):
    from textloom.functions.repair import clean

    return clean(corpus_lines(spark, sf).where("text <> ''")).select("doc_id", _big("pos"), "text")


def sentences(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return segment.segment_lines(docs).select("doc_id", _big("pos"), _big("sent"), "text")


def sentences_across_lines(spark, sf):
    return segment.segment_corpus(corpus_lines(spark, sf, salt=False), DOCUMENT_LINES)


def abbreviation_stats(spark, sf):
    out = segment.abbreviation_scores(_table(spark, sf, "documents"))
    return out.select("type", "with_period", "n", F.round("score", 6).alias("score"))


def sentences_learned(spark, sf):
    """Sentences of all lines; cuts after abbreviations learned from the same documents are taken back."""
    docs = _table(spark, sf, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    scores = segment.abbreviation_scores(docs).withColumn("score", F.round("score", 6))
    out = segment.segment_lines_learned(lines, scores, ["doc_id", "pos"])
    return out.select("doc_id", _big("pos"), _big("sent"), "text")


def speaker_turns(spark, sf):
    """Conversations as ``Speaker: 'text'`` blocks; wordless turns go."""
    return _speaker_turns(_table(spark, sf, "conversations"))


def speaker_turns_wordless(spark, sf):
    """The same with turns that hold no word."""
    text = F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, " ?! ... ").otherwise(F.col("text"))
    return _speaker_turns(_table(spark, sf, "conversations").withColumn("text", text))


def _speaker_turns(turns):
    t = tx.collapse_blanks(F.col("text"))
    rows = turns.withColumn("text", t).where(tx.has_alphanumeric(F.col("text")))
    name = F.concat(tx.capitalise_first(F.col("role")), F.lit(" "), F.substring(digest(F.col("conv_id"), F.col("role")), 1, 4))
    return rows.select("conv_id", "turn", F.concat(name, F.lit(": '"), "text", F.lit("'")).alias("text"))


def detokenized(spark, sf):
    toks = _table(spark, sf, "documents").select("doc_id", "lang", wd.whitespace_words(F.col("text")).alias("token"))
    return detok.detokenize(toks, "doc_id").select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars"))


def _turns_as_xml(spark, sf, root: str, turn) -> DataFrame:
    """Each conversation as one document, ``turn`` being the markup of a turn; a conversation is small."""
    xml = F.col("text")
    for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        xml = F.replace(xml, F.lit(char), F.lit(code))
    lines = F.array_join(F.transform(F.split(xml, "\n"), lambda s: F.concat(F.lit("<s>"), s, F.lit("</s>"))), "")
    rows = _table(spark, sf, "conversations").withColumn("lines", lines).withColumn("xml", turn)
    turns = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "xml"))), lambda t: t["xml"]), "")
    return rows.groupBy(F.col("conv_id").alias("doc_id")).agg(turns.alias("turns")).select(
        "doc_id",
        F.concat(F.lit(f'<{root}><div level="1" type="talk" n="'), F.col("doc_id").cast("string"), F.lit('">'), "turns",
                 F.lit(f"</div></{root}>")).alias("xml"),
    )


def _numbered_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks by their place in the document; a document is small."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "sub"))
    return blocks.select("doc_id", place.cast("bigint").alias("block"), "text")


SPEAKER_NAMES = ("Ada", "Ben", "Cleo", "Dan", "Eve")


def spoken_documents(spark, sf):
    turn = F.concat(F.lit('<u who="'), F.col("role"), F.lit('"><pause/>'), F.col("lines"), F.lit("</u>"))
    els = markup.elements(_turns_as_xml(spark, sf, "stext", turn))
    blocks = markup.spoken_blocks(els, SPEAKER_NAMES)
    return _numbered_blocks(blocks)


def written_documents(spark, sf):
    turn = F.concat(
        F.lit("<sp><speaker><s>"), F.col("role"), F.lit("</s></speaker><p>"), F.col("lines"), F.lit("</p></sp><pb/>")
    )
    els = markup.elements(_turns_as_xml(spark, sf, "wtext", turn))
    blocks = markup.written_blocks(els)
    return _numbered_blocks(blocks)


# --- vocabularies ------------------------------------------------------------------------


def _word_counts(spark, sf):
    return vocab.word_counts(_table(spark, sf, "documents"))


def word_counts(spark, sf):
    return _word_counts(spark, sf)


def word_counts_without_marks(spark, sf):
    """Word counts of documents whose lines start with layout marks, which are no words."""
    marked = F.concat(F.lit(tx.TAB_MARK), F.replace("text", F.lit("\n"), F.lit("\n" + tx.TAB_MARK)))
    return vocab.word_counts(_table(spark, sf, "documents").select(marked.alias("text")))


def _cut(word):
    """A word's first four characters and what follows."""
    return F.filter(F.array(F.substring(word, 1, 4), F.substring(word, 5, 1 << 30)), lambda x: x != "")


def morph_word_counts(spark, sf):
    """Counts after words of more than six characters are replaced by their two parts, read from a table."""
    counts = _word_counts(spark, sf)
    morphs = counts.where(F.length("word") > 6).select("word", _cut(F.col("word")).alias("morphs"))
    return vocab.segment_words(counts, morphs)


def sample_report(spark, sf):
    """Benchmark texts next to their tokens, words being cut after four characters."""
    out = encode.sample_report(_table(spark, sf, "benchmark"), wd.whitespace_words, lambda ws: F.flatten(F.transform(ws, _cut)))
    return out.select("item_id", "text", "tokens")


def byte_level_counts(spark, sf):
    return vocab.word_counts(_table(spark, sf, "documents"), words=wd.byte_level_words)


def vocab_wordlevel(spark, sf):
    return vocab.wordlevel_vocab(_word_counts(spark, sf), 5000).where("kind <> 'special'").select(
        "token", _big("id"), F.col("score").cast("bigint").alias("freq")
    )


def encode_wordlevel(spark, sf):
    docs = _table(spark, sf, "documents")
    v = vocab.wordlevel_vocab(vocab.word_counts(docs), 5000)
    out = encode.encode_by_lookup(docs.select("doc_id", wd.whitespace_words(F.col("text")).alias("word")), v, ["doc_id"])
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n"), _joined(F.col("ids")).alias("ids"))


def _trained_bpe(spark, sf):
    counts = cut_lineage(_word_counts(spark, sf))
    return counts, *vocab.train_bpe(counts, vocab_size=BPE_SIZE)


BPE_SIZE = 2**14


def bpe_merges(spark, sf):
    """Merges up to the vocabulary size, learned from all words."""
    _, _, merges = _trained_bpe(spark, sf)
    return merges.select(_big("rank"), "left", "right")


def bpe_token_frequencies(spark, sf):
    """Subword frequencies from word counts and the encodings of distinct words."""
    counts, v, merges = _trained_bpe(spark, sf)
    return vocab.token_frequencies(encode.split_counts(counts, encode.bpe_splitter(v, merges)))


def subword_decoded(spark, sf):
    """Texts after encoding into ids of byte-level merges learned from the same documents, and decoding."""
    v, merges = vocab.train_bpe(byte_level_counts(spark, sf), BPE_SIZE)
    tokens = encode.bpe_splitter(v, merges)(wd.byte_level_words(F.col("text")))
    ids = encode.tokens_to_ids(_table(spark, sf, "documents").select("doc_id", tokens.alias("tokens")), v, ["doc_id"])
    back = encode.ids_to_tokens(ids, v, ["doc_id"]).select("doc_id", encode.join_tokens(F.col("tokens"), byte_level=True).alias("text"))
    return back.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars"))


def wordpiece_tokens(spark, sf):
    """Byte-level words with single digits, a WordPiece vocabulary, and its subword frequencies."""
    counts = cut_lineage(byte_level_counts(spark, sf))
    return vocab.token_frequencies(encode.split_counts(counts, encode.wordpiece_splitter(vocab.train_wordpiece(counts))))


def unigram_pieces(spark, sf):
    out = unigram.train_unigram(_word_counts(spark, sf), vocab_size=2**14)
    return out.select("token", _big("id"), F.round("score", 6).alias("score"))


def token_freq_top100(spark, sf):
    toks = _word_counts(spark, sf).select(F.array("word").alias("tokens"), "freq")
    return vocab.top_tokens(vocab.token_frequencies(toks), 100)


def f95(spark, sf):
    toks = _word_counts(spark, sf).select(F.array("word").alias("tokens"), "freq")
    return vocab.frequency_at_95(vocab.token_frequencies(toks))


def vocab_coverage(spark, sf):
    """Benchmark words inside and outside the vocabulary of the documents, per item."""
    known = vocab.wordlevel_vocab(_word_counts(spark, sf), 5000).select(F.col("token").alias("word"), F.lit(1).alias("known"))
    toks = _table(spark, sf, "benchmark").select("item_id", F.explode(wd.whitespace_words(F.col("text"))).alias("word"))
    return toks.join(known, "word", "left").groupBy("item_id").agg(
        F.count("known").alias("inside"), (F.count(F.lit(1)) - F.count("known")).alias("outside")
    )


# --- training examples -------------------------------------------------------------------


def _stand_in_ids(t):
    """An id per word from its length and position, so that SQL can compute the same."""
    return F.transform(wd.whitespace_words(t), lambda w, i: ((F.length(w) * 131 + i * 17) % 4993 + 7).cast("int"))


def _segments(spark, sf):
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("seg_id"), _stand_in_ids(F.col("text")).alias("ids"))


def shard_steps(spark, sf):
    rows = corpus_lines(spark, sf, salt=False).select(examples.shard_of(F.col("doc_id") + F.col("pos"), 8).alias("shard"))
    out = examples.steps_per_epoch(rows, 16)
    return out.select("steps", "shards", examples.token_budget(F.col("steps"), F.col("shards"), 16, 128).alias("token_budget"))


def train_examples(spark, sf):
    out = examples.build_examples(_segments(spark, sf), 64)
    return out.select(
        "seg_id", _joined(F.col("input_ids")).alias("input_ids"),
        F.array_join(F.transform("is_pad", lambda p: F.when(p, "1").otherwise("0")), "").alias("is_pad"),
    )


def sentence_examples(spark, sf):
    """Examples of whole documents, one for each sentence, in ids of the full word vocabulary."""
    v = vocab.wordlevel_vocab(_word_counts(spark, sf))
    keys = ["doc_id", "pos", "sent"]
    words = wd.whitespace_words(F.replace("text", F.lit(segment.PARAGRAPH_MARK), F.lit(""))).alias("word")
    ids = encode.encode_by_lookup(sentences_learned(spark, sf).select(*keys, words), v, keys)
    out = examples.build_examples(ids, 64)
    return out.select(*keys, _joined(F.col("input_ids")).alias("input_ids"), F.size(F.filter("is_pad", lambda p: p)).cast("bigint").alias("n_pad"))


def short_examples(spark, sf):
    out = examples.build_examples(_segments(spark, sf), 64, short_p=0.5, seed=3, epoch=1)
    return out.select("seg_id", F.size(F.filter("is_pad", lambda p: ~p)).cast("bigint").alias("n_real"))


def span_mask(spark, sf):
    rows = examples.build_examples(_segments(spark, sf), 64)
    out = examples.mask_spans(rows, 5000, seed=5, epoch=2)
    return out.select("seg_id", _joined(F.col("inputs")).alias("inputs"), _joined(F.col("labels")).alias("labels"))


def epoch_batches(spark, sf):
    rows = _table(spark, sf, "documents").select(
        F.col("doc_id").alias("seg_id"), examples.shard_of(F.col("doc_id"), 4).alias("shard")
    )
    out = examples.epoch_batches(rows, 16, seed=42, epoch=3, n_shards=4)
    return out.select("seg_id", _big("shard"), "batch", _big("slot"))


# --- evaluation sets ---------------------------------------------------------------------


def _turn_pairs(spark, sf):
    """Neighbouring turns of a conversation; a conversation is small."""
    c = _table(spark, sf, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("text_a"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_b"))
    return a.join(b, ["conv_id", "turn"])


def pair_encode(spark, sf):
    rows = _turn_pairs(spark, sf)
    ids, real = evalsets.encode_pair(_stand_in_ids(F.col("text_a")), _stand_in_ids(F.col("text_b")), 32)
    label = evalsets.fill_labels(F.when(F.col("conv_id") % 5 != 0, F.col("turn") % 2))
    return rows.select("conv_id", "turn", _joined(ids).alias("input_ids"), _joined(real).alias("is_real"), label.cast("bigint").alias("label"))


def longest_pair(spark, sf):
    rows = _turn_pairs(spark, sf).select(_stand_in_ids(F.col("text_a")).alias("a"), _stand_in_ids(F.col("text_b")).alias("b"))
    return evalsets.longest_pair(rows, "a", "b", 3).select(_big("max_length"))


def truncate_pairs(spark, sf):
    rows = _turn_pairs(spark, sf).select(
        "conv_id", "turn", F.array(_stand_in_ids(F.col("text_a")), _stand_in_ids(F.col("text_b"))).alias("s")
    )
    rows = rows.withColumn("s", evalsets.truncate_sentences(F.col("s"), 48))
    return rows.select(
        "conv_id", "turn", F.size(F.col("s")[0]).cast("bigint").alias("n_a"), F.size(F.col("s")[1]).cast("bigint").alias("n_b"),
        _joined(evalsets.join_sentences(F.col("s"))).alias("input_ids"),
        _joined(evalsets.sentence_parity(F.col("s"))).alias("segment_ids"),
    )


def _collated(spark, sf, max_length):
    rows = _turn_pairs(spark, sf).select(
        F.col("conv_id").alias("batch"), "turn", F.array(_stand_in_ids(F.col("text_a")), _stand_in_ids(F.col("text_b"))).alias("sentences")
    )
    out = evalsets.collate_sentences(rows, max_length=max_length)
    return out.select(
        "batch", "turn", _big("length"), _big("width"), F.md5(_joined(F.col("input_ids"))).alias("input_md5"),
        F.size(F.filter("is_pad", lambda p: p)).cast("bigint").alias("n_pad"),
    )


def collated_sentences(spark, sf):
    """Turn pairs in batches of one conversation, padded to the longest pair of the batch."""
    return _collated(spark, sf, 512)


def collated_late_cuts(spark, sf):
    """The same with a length that many pairs exceed, so that their first text is cut."""
    return _collated(spark, sf, 128)


def span_masks(spark, sf):
    """A span in the middle of each short line, as a mask and a multi-hot label."""
    rows = corpus_lines(spark, sf, salt=False).where("text <> ''").select("doc_id", _big("pos"), _stand_in_ids(F.col("text")).alias("ids"))
    rows = rows.where(tx.subword_count_between(F.col("ids"), 1, 126))
    n = F.size("ids")
    mask = ar.span_mask(n, F.floor(n / 4), F.floor(n / 2))
    hot = ar.multi_hot(F.transform("ids", lambda x: x % 8), 8)
    return rows.select(
        "doc_id", "pos", F.array_join(F.transform(mask, lambda m: F.when(m, "1").otherwise("0")), "").alias("span_mask"),
        _joined(hot).alias("labels"),
    )


PROBE_CLASSES = {"ner": 8, "coref": 2}


def _probes(spark, sf):
    """Turns as sentences with spans of three tasks, made from their lengths; batches are conversations."""
    n = F.size("subwords")
    span = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    one = lambda label, a, b: F.struct(F.array(label.cast("int")).alias("label"), a.alias("span_1"), b.alias("span_2"))
    zero, quarter, half = F.lit(0), F.floor(n / 4), F.floor(n / 2)
    tasks = F.create_map(
        F.lit("ner"), F.array(one(n % 8, span(zero, quarter), span(zero, zero))),
        F.lit("coref"), F.array(one(n % 2, span(zero, zero), span(half, n - 1)), one((n + 1) % 2, span(half, half), span(zero, quarter))),
        F.lit("ud"), F.array(one(zero, span(quarter, half), span(half, half))),
    )
    rows = _table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("sent_id"), F.col("conv_id").alias("batch"), _stand_in_ids(F.col("text")).alias("subwords")
    )
    rows = rows.where(tx.subword_count_between(F.col("subwords"), 1, 126)).withColumn("tasks", tasks)
    return evalsets.collate_probes(rows, evalsets.labelled_spans(rows, PROBE_CLASSES))


def probing_inputs(spark, sf):
    """Padded sentences of probing batches."""
    inputs, _ = _probes(spark, sf)
    return inputs.select(
        "sent_id", "batch", _big("sentence_index"), _big("width"), F.md5(_joined(F.col("input_ids"))).alias("input_md5"),
        F.size(F.filter("is_pad", lambda p: p)).cast("bigint").alias("n_pad"),
    )


def probing_spans(spark, sf):
    """Labels and masks of the spans of probing batches, padded as their sentences are."""
    _, spans = _probes(spark, sf)
    mask = lambda c: F.array_join(F.transform(c, lambda m: F.when(m, "1").otherwise("0")), "").alias(c)
    return spans.select(
        "sent_id", "task", _big("span_no"), _big("sentence_index"), _joined(F.col("labels")).alias("labels"),
        mask("span_mask_1"), mask("span_mask_2"),
    )


def pseudo_likelihood_rows(spark, sf):
    rows = _table(spark, sf, "benchmark").select("item_id", _stand_in_ids(F.col("text")).alias("token_ids"))
    rows = rows.withColumn("width", F.size("token_ids"))
    out = evalsets.mask_each_position(rows, ["item_id"])
    return out.select("item_id", _big("pos"), _big("target"), F.md5(_joined(F.col("input_ids"))).alias("input_md5"))


# --- metrics -----------------------------------------------------------------------------


def _predictions(spark, sf):
    """Labels next to a simple length rule."""
    docs = _table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    rows = _table(spark, sf, "labels").join(docs, "doc_id")
    return rows.withColumns({
        "pred": (F.col("n_chars") > 300).cast("int"),
        "label": F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("quality")),
        "batch": F.floor(F.col("doc_id") / 64),
    })


def label_balance(spark, sf):
    out = evalsets.label_balance(_table(spark, sf, "labels"), "quality")
    return out.select("positives", "n", F.round("percent", 6).alias("percent"))


def confusion(spark, sf):
    return metrics.confusion(_predictions(spark, sf)).select(_big("label"), _big("pred"), "n")


def accuracy_batch_mean(spark, sf):
    out = metrics.batch_accuracy(_predictions(spark, sf))
    return out.select(F.round("batch_mean", 9).alias("batch_mean"), F.round("micro", 9).alias("micro"), "batches")


def mcc(spark, sf):
    rows = _predictions(spark, sf).where(tx.labelled(F.col("label")))
    return metrics.matthews(rows, ["lang"]).select("lang", F.round("mcc", 9).alias("mcc"))


def f1(spark, sf):
    rows = _predictions(spark, sf).where(tx.labelled(F.col("label")))
    return metrics.f1_binary(rows, ["lang"]).select("lang", F.round("f1", 9).alias("f1"))


def f1_macro(spark, sf):
    rows = _predictions(spark, sf).select(
        (F.col("quality") + F.col("toxic")).alias("label"), (F.col("n_chars") % 3).alias("pred")
    )
    return metrics.f1_macro(rows, 3).select(F.round("f1_macro", 9).alias("f1_macro"))


def pearson_spearman(spark, sf):
    rows = _predictions(spark, sf).select("n_chars", F.col("quality").alias("y"))
    ranks = metrics.spearman(rows, "n_chars", "y")
    return metrics.pearson(rows, "n_chars", "y").select(
        F.round("pearson", 9).alias("pearson"), F.round(ranks.scalar(), 9).alias("spearman")
    )


def pairwise_choice(spark, sf):
    rows = _table(spark, sf, "conversations").select(
        "conv_id", "turn", F.length("text").alias("pred"), F.size(F.split("text", " ")).alias("label")
    )
    out = metrics.pairwise_choice(rows, "conv_id", "turn")
    return out.select(F.round("accuracy", 9).alias("accuracy"), "n")


def minimal_pairs_macro(spark, sf):
    """Each line against its reversed word lengths, as log scores of two sides."""
    lines = corpus_lines(spark, sf).where("text <> ''")
    pair = F.concat_ws("-", "doc_id", "pos")
    base = lines.select(F.col("lang").alias("grp"), F.col("source").alias("subgrp"), pair.alias("pair_id"), F.length("text").alias("n"), "pos")
    sides = F.array(
        F.struct(F.lit("good").alias("side"), (-(F.col("n") % 17)).cast("double").alias("log_p")),
        F.struct(F.lit("bad").alias("side"), (-((F.col("n") + F.col("pos")) % 13)).cast("double").alias("log_p")),
    )
    scores = base.select("grp", "subgrp", "pair_id", F.explode(sides).alias("s")).select("grp", "subgrp", "pair_id", "s.*")
    return metrics.minimal_pair_accuracy(scores).select("grp", "subgrp", F.round("accuracy", 6).alias("accuracy"))


def history_stats(spark, sf):
    """Event values per type and hour as a metric history."""
    log = _table(spark, sf, "events").groupBy(
        F.col("event_type").alias("run_id"), F.date_trunc("hour", "ts").alias("step")
    ).agg(F.avg("value").alias("value"))
    out = metrics.late_history(log, ["run_id"], "step")
    return out.select("run_id", *[F.round(c, 6).alias(c) for c in ("max", "min", "mean", "std")], "n")


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def epoch_table(spark, sf):
    log = _table(spark, sf, "events").select(
        F.lit("all").alias("run_id"), F.date_trunc("day", "ts").alias("epoch"), F.col("event_type").alias("metric"), "value"
    )
    out = metrics.epoch_table(log, list(EVENT_TYPES))
    return out.select("run_id", F.date_format("epoch", "yyyy-MM-dd").alias("epoch"), *EVENT_TYPES)


def run_leaderboard(spark, sf):
    """Events as training runs; the best one of each task, language and tokenizer, other names on their own."""
    kinds, marks = (F.array(*[F.lit(x) for x in xs]) for xs in (("WaW", "WaM", "WaD"), ("BPE", "M-WP")))
    made = F.concat_ws(
        "_", kinds[(F.col("user_id") % 3).cast("int")], F.col("event_type"), F.lit("small"), marks[(F.col("event_id") % 2).cast("int")],
        F.lit("16384"), F.when(F.col("event_id") % 3 == 0, F.lit("more")),
    )
    runs = _table(spark, sf, "events").select(
        F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("run "), "event_id")).otherwise(made).alias("Name"), F.col("props").alias("Notes"),
        (F.col("value") + F.col("event_id") / 1e9).alias("val_accuracy"), (F.lit(1.0) / (F.abs("value") + 1)).alias("val_loss"),
    )
    out = metrics.leaderboard(runs)
    return out.select("task", "lang", "tokenizer", "runs", "Name", "Notes", *[F.round(c, 6).alias(c) for c in ("val_accuracy", "val_loss")])


def run_durations(spark, sf):
    """Time from the first to the last event of each user and type."""
    seconds = (F.max("ts") - F.min("ts")).cast("interval second").cast("decimal(18,6)").cast("double")
    spans = _table(spark, sf, "events").groupBy("user_id", "event_type").agg(seconds.alias("seconds"))
    return spans.select("user_id", "event_type", metrics.elapsed(F.col("seconds")).alias("elapsed"))


def topk_softmax(spark, sf):
    v = _table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("logits"))
    best = v.select("vec_id", F.posexplode(ar.top_k(ar.softmax(F.col("logits")), 5)).alias("rank", "b"))
    return best.select("vec_id", _big("rank"), F.col("b.index").cast("bigint").alias("index"), F.round("b.score", 6).alias("probability"))


def collapse_classes(spark, sf):
    v = _table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("logits"))
    two = ar.first_classes_against_last(F.col("logits"), F.size("logits") - 1)
    mixed = ar.mixture(F.col("logits"), F.reverse("logits"))
    return v.select(
        "vec_id", F.round(two[0], 6).alias("p_first"), F.round(two[1], 6).alias("p_last"),
        F.round(mixed[0], 6).alias("mix_first"), ar.argmax(F.col("logits")).cast("bigint").alias("best"),
    )


def vector_stats(spark, sf):
    out = metrics.vector_statistics(_table(spark, sf, "embeddings"), "vec_id", "embedding")
    return out.select("vec_id", F.round("norm", 6).alias("norm"), F.round("std", 6).alias("std"))


def masked_token_scores(spark, sf):
    """Embeddings as scores, their label as target; unlabelled rows do not count."""
    rows = _table(spark, sf, "embeddings").select(
        F.col("embedding").cast("array<double>").alias("logits"),
        F.when(F.col("vec_id") % 9 == 0, -100).otherwise(F.col("label") % F.size("embedding")).alias("target"),
        (F.col("vec_id") % 4).alias("part"),
    )
    out = metrics.masked_token_scores(rows, ["part"])
    return out.select("part", *[F.round(c, 6).alias(c) for c in ("loss", "accuracy", "perplexity")], "n")


# --- further operators over the tables ----------------------------------------------------


def framed_pairs(spark, sf):
    rows = _turn_pairs(spark, sf)
    ids, real = evalsets.encode_framed_pair(_stand_in_ids(F.col("text_a")), _stand_in_ids(F.col("text_b")), 64)
    return rows.select("conv_id", "turn", _joined(ids).alias("input_ids"), _joined(real).alias("is_real"))


def lower_lines(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return docs.select("doc_id", _big("pos"), tx.lower_case(F.col("text")).alias("text"))


def accuracy_plain(spark, sf):
    rows = _predictions(spark, sf).where(tx.labelled(F.col("label")))
    return metrics.accuracy(rows, ["lang"]).select("lang", F.round("accuracy", 9).alias("accuracy"), "n")


def resume_batches(spark, sf):
    """What is left of three epochs of document batches after a stop in the first one."""
    rows = _table(spark, sf, "documents").select(
        (F.col("doc_id") % 3).cast("bigint").alias("epoch"), F.floor(F.col("doc_id") / 16).cast("bigint").alias("batch"), "doc_id"
    )
    out = examples.resume_window(rows, 40, 25, 110, 0.9)
    return out.groupBy("epoch", "batch", "step").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last_doc"))


def random_document(spark, sf):
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("seg_id"), "lang")
    return examples.random_example(docs, 11)


def ordered_batches(spark, sf):
    rows = _table(spark, sf, "documents").select("lang", "doc_id")
    return examples.ordered_batches(rows, LineOrder(("lang",), "doc_id", (), (12, 26, 44)), 16).select("lang", "doc_id", _big("batch"))


def attached_predictions(spark, sf):
    rows = _table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), "quality")
    scores = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("logits"))
    return evalsets.attach_predictions(rows, scores).select("row_id", _big("quality"), _big("predicted"))


def joined_span_masks(spark, sf):
    a, b = _stand_in_ids(F.col("text_a")), _stand_in_ids(F.col("text_b"))
    masks = F.array(*[F.transform(x, lambda v: v % 2 == 0) for x in (a, b)])
    joined = F.transform(evalsets.join_span_masks(masks), lambda m: F.when(m, "1").otherwise("0"))
    return _turn_pairs(spark, sf).select("conv_id", "turn", F.array_join(joined, "").alias("span_mask"))


def validation_rows(spark, sf):
    names = F.array(*[F.lit(n) for n in ("train", "validation", "validation_matched", "validation_mismatched", "validation_hans")])
    rows = _table(spark, sf, "documents").withColumn("split", F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")))
    found = [evalsets.validation_splits(rows, t).select(F.lit(t).alias("task"), "split", "doc_id") for t in ("mnli", "rte")]
    return found[0].unionByName(found[1])


def probing_f1(spark, sf):
    ids = _stand_in_ids(F.col("text"))
    rows = _table(spark, sf, "benchmark").select(
        (F.col("item_id") % 3).cast("string").alias("task"), F.lit("test").alias("split"),
        ar.multi_hot(F.transform(ids, lambda x: x % 32), 32).alias("labels"),
        ar.multi_hot(F.transform(ids, lambda x: (x + x % 5) % 32), 32).alias("predicted"),
    )
    return metrics.probing_f1(rows).select("task", "split", F.round("f1", 9).alias("f1"))


def decoded_wordlevel(spark, sf):
    """Words of each document after encoding and decoding."""
    docs = _table(spark, sf, "documents")
    v = vocab.wordlevel_vocab(vocab.word_counts(docs), 5000)
    toks = docs.select("doc_id", F.posexplode(wd.whitespace_words(F.col("text"))).alias("pos", "word"))
    ids = encode.encode_by_lookup(toks, v, ["doc_id"])
    words = encode.ids_to_tokens(ids, v, ["doc_id"])
    return words.select("doc_id", F.md5(encode.join_tokens(F.col("tokens"))).alias("text_md5"))


QUERIES = {
    fn.__name__: fn
    for fn in (
        doc_lines_dedup, lines_spoken, lines_child_speech, lines_spoken_dialogue, lines_treebank, lines_story_gaps,
        paragraphs_reflow, lines_subtitle, lines_captions, stub_filter, lines_phone, wiki_markup, corpus_union,
        clean_full, sentences, sentences_across_lines, abbreviation_stats, speaker_turns, spoken_documents, written_documents, detokenized,
        word_counts, byte_level_counts, vocab_wordlevel, encode_wordlevel, bpe_merges, bpe_token_frequencies,
        wordpiece_tokens, unigram_pieces, token_freq_top100, f95, vocab_coverage,
        shard_steps, train_examples, short_examples, span_mask, epoch_batches,
        pair_encode, longest_pair, truncate_pairs, collated_sentences, span_masks, pseudo_likelihood_rows,
        label_balance, confusion, accuracy_batch_mean, mcc, f1, f1_macro, pearson_spearman, pairwise_choice,
        minimal_pairs_macro, history_stats, epoch_table, topk_softmax, collapse_classes, vector_stats,
        masked_token_scores, framed_pairs, lower_lines, accuracy_plain, resume_batches, random_document, ordered_batches,
        attached_predictions, joined_span_masks, validation_rows, probing_f1, decoded_wordlevel,
        sentences_learned, sentence_examples, subword_decoded, collated_late_cuts, word_counts_without_marks,
        lines_captions_marked, stub_filter_phrases, wiki_markup_furnished, speaker_turns_wordless, morph_word_counts, sample_report,
        probing_inputs, probing_spans, run_leaderboard, run_durations,
    )
}
