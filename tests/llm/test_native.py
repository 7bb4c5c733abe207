"""URL rules and chat formatting: small cases and plain versions."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import chat_format as cf
from textloom.llm import url_filters as uf
from textloom.llm.queries import RULES


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    rest = rest.split("?")[0].split("#")[0]
    host, _, path = rest.partition("/")
    path = "/" + path if "/" in rest else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), r.host.count(".")), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


URLS = [
    None, "", "example.org/es/1", "://", "http://", "http://example.org", "HTTP://WWW.Example.ORG/es/x?q=/y#z",
    "https://a.example.org/en/12#top", "https://example.org/en/2", "https://notexample.org/es/", "http://x.com/de/9",
    "http://x.com/fr/", "http://x.net/fr/", "http://com/de/", "http://example.org?x://y/es/", "http://ÄB.example.org/es/",
    "http://" + "a." * 3000 + "com/de/", "http://x.com/de/" + "long" * 5000, "http://x.com/de/9", "ftp://u@x.com:80/de/",
    "http://x..com/de/1", "http://.com/de/1", "http://com./de/1",
]


def test_url_rules(spark):
    rows = [(i, u, "old", 1) for i, u in enumerate(URLS)]
    got = uf.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, extra int"), RULES).collect()
    assert len(got) == len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(URLS[r.page_id], RULES), URLS[r.page_id]
        assert r.extra == 1


def test_url_rules_many_and_none(spark):
    rules = [uf.Rule("block" if i % 3 else "allow", f"h{i}.example", f"/{i % 7}/") for i in range(400)]
    rules += [uf.Rule("allow", "h1.example", "/1/"), uf.Rule("block", "deep.h3.example", ""), uf.Rule("block", "X.Example", "/")]
    urls = [f"http://{p}h{i}.example/{(i + k) % 7}/x" for i in range(450) for k in (0, 1) for p in ("", "deep.")]
    urls.append("http://x.example/")
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for r in uf.judge_urls(df, rules).collect():
        lower = [uf.Rule(x.verdict, x.host.lower(), x.path) for x in rules]
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(urls[r.page_id], lower)
    assert {r.verdict for r in uf.judge_urls(df, []).collect()} == {"allow"}
    assert uf.judge_urls(df.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        uf.judge_urls(df, rules, max_bits=64)


def test_cascade_is_exact_and_alternates(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    listed = keys.where("key % 40 = 3")
    cascade = uf.build_cascade(listed, keys)
    assert len(cascade.levels) > 1
    got = {r.key for r in keys.where(cascade.lists(F.col("key"))).collect()}
    assert got == {r.key for r in listed.collect()}
    assert uf.build_cascade(listed.limit(0), keys).levels == ()


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a <|im_end|> <\\|x <\\\\|"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, 0, "sys\ntem\\n\\", "<|im_start|>"), (2, 0, None, "tie"), (2, 0, None, "tie"), (3, 1, "assistant", "€🙂" * 20000),
    (None, 0, "assistant", "nobody"), (4, None, "assistant", "no turn"), (4, 5, "assistant", "<|<|<|\n\n<|im_end|>\n"),
]


def turns_df(spark):
    rows = [(*r, "clash", 7) for r in ROWS]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, x int")


def test_chat_round_trip(spark):
    made = cf.format_turns(cf.turns_of_rows(turns_df(spark)))
    read = made.withColumns({
        "back": cf.parse_turns(F.col("formatted")), "loss": cf.masked_text(F.col("formatted"), F.col("loss_spans"))
    }).collect()
    assert len(read) == 5
    for r in read:
        own = sorted((x for x in ROWS if x[0] == r.conv_id), key=lambda x: [(v is not None, v) for v in x[1:]])
        want = [(x[2] or "", x[3] or "") for x in own]
        assert [(t.role, t.text) for t in r.back] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")
        assert r.formatted.count("<|im_start|>") == len(own) == r.formatted.count("<|im_end|>\n")
        for s in r.loss_spans:
            assert r.formatted[s.start - 1] == "\n" and r.formatted[s.start + s.length :].startswith("<|im_end|>\n")
    assert cf.format_turns(cf.turns_of_rows(turns_df(spark).limit(0))).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<|\\n\nas>", max_size=12), min_size=1, max_size=30))
def test_escapes_are_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for r in df.select(t, cf.unescape(cf.escape(t)), cf.unescape_role(cf.escape_role(t)), cf.escape(t), cf.escape_role(t)).collect():
        assert r[0] == r[1] == r[2]
        assert "<|" not in r[3] and "<|" not in r[4] and "\n" not in r[4]


def test_layouts_by_fingerprint(spark):
    records = [
        {"prompt": "p", "completion": "c"}, {"completion": "c", "prompt": "p"},
        {"instruction": "i", "input": "x", "output": "o"}, {"instruction": "i", "input": "", "output": "o"},
        {"instruction": "i", "output": "o"},
        {"messages": [{"role": "user", "content": "m"}, {"content": "n", "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}, {"from": "tool", "value": "t"}]},
        {"other": 1}, [1, 2],
    ]
    more = {
        11: {"id": 5, "source": {"name": "x"}, "prompt": "p", "completion": "c"}, 12: {"messages": []}, 13: {"id": 1, "conversations": [ ]},
        14: {"messages": [{"name": "n", "role": "user", "content": "m"}]}, 15: {"messages": ["a"]}, 16: {},
        17: {"prompt": "p", "instruction": "i", "output": "o", "messages": []},
    }
    texts = [(i, json.dumps(r)) for i, r in [*enumerate(records), *more.items()]]
    df = spark.createDataFrame(texts + [(9, None), (10, "not json")], "id int, js string")
    got = {r.id: (r.layout, r.turns and [(t.role, t.text) for t in r.turns]) for r in cf.turns_of_json(df, "js").collect()}
    pair = [("user", "p"), ("assistant", "c")]
    assert got[0] == got[1] == ("prompt", pair)
    assert got[2][1] == [("user", "i\n\nx"), ("assistant", "o")] and got[3][1] == got[4][1] == [("user", "i"), ("assistant", "o")]
    assert got[5] == ("messages", [("user", "m"), ("assistant", "n")])
    assert got[6][1] == [("user", "h"), ("assistant", "g"), ("tool", "t")]
    assert all(got[k] == (None, None) for k in (7, 8, 9, 10, 15, 16))
    assert got[11] == ("prompt", pair) and got[12] == ("no messages", []) and got[13] == ("no conversations", [])
    assert got[14] == ("messages", [("user", "m")]) and got[17][0] == "instruction without input"
    with pytest.raises(ValueError):
        cf.turns_of_rows(df)


def test_fingerprint_selects_the_mapping(spark, monkeypatch):
    paths = [["b", "a"], ["a", "b", "a"], ["messages[].role", "ü"], ["\U0001f600", "\uffee"], []]
    df = spark.createDataFrame([(p,) for p in paths], "p array<string>")
    assert [r[0] for r in df.select(cf.fingerprint(F.col("p"))).collect()] == [cf.schema_fingerprint(p) for p in paths]
    two = (cf.TURN_ROWS, cf.Layout("texts", ("conv_id", "text"), "array(named_struct('pos', 0L, 'role', 'user', 'text', text))"))
    rows = turns_df(spark)
    assert len(cf.turns_of_rows(rows.drop("role"), two).collect()) == len(ROWS)
    assert len(cf.turns_of_rows(rows, two).collect()) == 5
    # Without its fingerprint no mapping is found.
    monkeypatch.setattr(cf.Layout, "key", property(lambda x: 1))
    with pytest.raises(ValueError):
        cf.turns_of_rows(rows)
    js = spark.createDataFrame([('{"prompt": "p", "completion": "c"}',)], "js string")
    assert cf.turns_of_json(js, "js").first().layout is None


def test_digest_of_query_form(spark):
    text = "".join(f"{r}\n{t}\n" for r, t in [("user", "hi"), ("assistant", "x")])
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "x")], "conv_id long, turn long, role string, text string")
    back = cf.format_turns(cf.turns_of_rows(df)).select(cf.parse_turns(F.col("formatted")).alias("t")).first().t
    assert hashlib.sha256("".join(f"{t.role}\n{t.text}\n" for t in back).encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest()
