"""SQL over the same tables, one text per query; the expected results of the table queries."""

from __future__ import annotations

_CLITICS = "n't N'T 'll 'LL 're 'RE 've 'VE 'm 'M 's 'S 'd 'D".split()

PLAIN_LINES = """
corpus_lines AS (
  SELECT lang, source, doc_id, unnest(ls) AS text, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS pos
  FROM (SELECT lang, source, doc_id,
          string_split(text, chr(10)) || CASE WHEN doc_id % 3 = 0 THEN ['', ''] ELSE [''] END AS ls
        FROM documents))"""

# (before, after) of the salted line classes.
_SALTS = (
    ("- ", ""), ('He said " yes , sir " and left . ', ""), ("I do n't say it 's you , they 've . ", ""),
    ("-LRB- see -RRB- `` so '' ", " -LSB-x-RSB-"), ("( a ) and( b ). 5 % of $ 5 , 10:30 ;x ", " …"), ("so ﬁrst oﬃce ĳ ", ""),
    ("ＡＢＣ１２ ", ""), ("cafÃ© donâ€™t ", ""), ("a\x07b ", ""), ("“curly” ‘single’ ", ""), ("nbsp\u00a0here\u2003em  ", ""),
    ("e\u0301a ", ""), ("", " x :"), ("[TAB] ", ""), ("   ", "\t"), ("&lt;b&gt; 1 -> 2 ", " &amp;"),
)


def _salted():
    def lit(x):
        return "'" + x.replace("'", "''") + "'"

    arms = " ".join(f"WHEN {k} THEN {lit(a)} || text || {lit(b)}" for k, (a, b) in enumerate(_SALTS))
    return f"""CASE WHEN text = '' THEN '' ELSE CASE (doc_id * 31 + pos * 7) % {len(_SALTS) + 17} {arms}
      WHEN {len(_SALTS)} THEN '.' ELSE text END END"""


CORPUS_LINES = PLAIN_LINES.replace("corpus_lines AS", "unsalted_lines AS") + f""",
corpus_lines AS (SELECT lang, source, doc_id, pos, {_salted()} AS text FROM unsalted_lines)"""

PAGE_LINES = """
page_lines AS (
  SELECT page_id, unnest(ls) AS text, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS pos
  FROM (SELECT page_id, string_split(replace(html, '<', chr(1) || '<'), chr(1)) AS ls FROM pages))"""

DOC_LINES = """
doc_lines AS (
  SELECT doc_id, unnest(ls) AS text, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""

W = "OVER (PARTITION BY lang, source ORDER BY doc_id, pos)"
WP = "OVER (PARTITION BY page_id ORDER BY pos)"
OUT = "lang, source, doc_id, pos, text"
BLANK = r"[\s\p{Z}\x1c-\x1f\x{85}]"


def _n1(t):
    return rf"trim(regexp_replace({t}, '{BLANK}+', ' ', 'g'))"


def _strip(t):
    return rf"regexp_replace({t}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def _repair(t):
    """The entities, misread characters, ligatures and wide letters of the salts; straight quotes, no controls, composed."""
    for a, b in (("Ã©", "é"), ("â€™", "’"), ("ﬁ", "fi"), ("ﬃ", "ffi"), ("ĳ", "ij")):
        t = f"replace({t}, '{a}', '{b}')"
    t = f"translate({t}, 'ＡＢＣ１２', 'ABC12')"
    t = f"CASE WHEN contains({t}, '<') THEN {t} ELSE replace(replace(replace({t}, '&amp;', chr(1) || 'amp'), '&lt;', '<'), '&gt;', '>') END"
    t = f"replace({t}, chr(1) || 'amp', '&')"
    t = rf"regexp_replace({t}, '[ʼ‘-‛]', '''', 'g')"
    t = f"""regexp_replace({t}, '[“-‟]', '"', 'g')"""
    t = rf"regexp_replace({t}, '[\x00-\x08\x0b\x0e-\x1f\x7f]', '', 'g')"
    return _strip(f"nfc_normalize({t})")


def _quote(t):
    return f"'\"' || {t} || '\"'"


def _quote_unless(t):
    marked = f"""({t} LIKE '%:' OR {t} LIKE '"%' OR {t} LIKE '%"' OR ({t} LIKE '(%' AND {t} LIKE '%)')
      OR ({t} LIKE '[%' AND {t} LIKE '%]') OR ({t} LIKE '{{%' AND {t} LIKE '%}}'))"""
    return f"CASE WHEN {t} = '' THEN '' WHEN {marked} THEN {t} ELSE {_quote(t)} END"


def _cap(t):
    return f"upper({t}[1]) || {t}[2:]"


def _dash(t):
    return f"regexp_replace({t}, '^- ?', '')"


WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\s]+')"


def _words(t):
    return WORDS.format(t)


def _ids(t):
    return f"list_transform({_words(t)}, lambda w, i: (length(w) * 131 + (i - 1) * 17) % 4993 + 7)"


def _csv(xs):
    return f"array_to_string({xs}, ',')"


# --- the full cleaning chain, character by character from the right ----------------------

_OPENERS = "('‘', '(', '[', '{')"


def _space_punctuation(t):
    """Fold over (two characters before, one before, character) from the last but one to the first;
    the accumulated text starts with what follows the character."""
    t = rf"trim(regexp_replace({t}, '[ \t\x0b\f\r\p{{Z}}\x1c-\x1f\x{{85}}]+', ' ', 'g'))"
    c, p, pp, n = "e[3]", "e[2]", "e[1]", "acc[1]"

    def kind(classes):
        return lambda x: f"regexp_matches({x}, '^[{classes}]')"

    alnum, alpha, num, up = map(kind, (r"\p{L}\p{N}", r"\p{L}", r"\p{N}", r"\p{Lu}"))
    op = f"{n} IN {_OPENERS}"
    step = f"""CASE
      WHEN {c} = '.' AND ({up(n)} OR {op}) THEN {c} || ' ' || acc
      WHEN {c} IN ('?', '!', '…', '’') AND ({alnum(n)} OR {op}) THEN {c} || ' ' || acc
      WHEN e[4] = 'y' AND {c} = '.' AND {p} = '.' AND {pp} = '.' AND {n} <> ' ' THEN {c} || ' ' || acc
      WHEN {c} = ',' AND ({alpha(n)} OR {op}) THEN {c} || ' ' || acc
      WHEN {c} IN (';', ')', ']', '}}', '%') AND ({alnum(n)} OR {op}) THEN {c} || ' ' || acc
      WHEN {c} = ':' AND ({op} OR ({alnum(n)} AND (NOT {num(n)} OR NOT {num(p)}))) THEN {c} || ' ' || acc
      WHEN {c} IN ('(', '[', '{{') AND {n} = ' ' THEN {c} || acc[2:]
      WHEN {c} = ' ' AND {n} IN ('.', ';', ':', '?', '!', '…', ',', '’', ')', ']', '}}') THEN acc
      WHEN {c} = ' ' AND {p} IN ('$', '£', '€') AND {num(n)} THEN acc
      WHEN {c} = ' ' AND {num(p)} AND {n} = '%' THEN acc
      ELSE {c} || acc END"""
    # One element per character: up to two characters before it, itself, and whether three precede it.
    elems = (
        "list_transform(range(length(x) - 1, 0, -1), lambda i: "
        "CASE WHEN i > 2 THEN x[i - 2] ELSE chr(2) END || CASE WHEN i > 1 THEN x[i - 1] ELSE chr(2) END || x[i] "
        "|| CASE WHEN i > 3 THEN 'y' ELSE 'n' END)"
    )
    return t, f"CASE WHEN length(x) < 2 THEN x ELSE list_reduce(list_prepend(x[length(x)], {elems}), lambda acc, e: {step}) END"


def _clitics(t):
    for after in (' ', ',', '.'):
        for c in _CLITICS:
            s = (c + after).replace("'", "''")
            t = f"replace({t}, ' {s}', '{s}')"
    return t


def _clean_cte(source: str, keep: str) -> str:
    """CTEs c1..c5: column x of ``source`` cleaned, columns ``keep`` kept; result in c5.x."""
    flat, fold = _space_punctuation("x")
    fixed = """list_transform(s, lambda v, k: CASE WHEN k % 2 = 0
        THEN regexp_replace(regexp_replace(v, '^ ', ''), ' $', '')
        ELSE (CASE WHEN k > 1 AND regexp_matches(v, '^[\\p{L}\\p{N}]') THEN ' ' ELSE '' END) || v ||
             (CASE WHEN k < len(s) AND v <> '' AND NOT suffix(v, ' ') THEN ' ' ELSE '' END) END)"""
    rules = [
        (r"\r", ""), (r"\(", " ("), (r"\)", ") "), (r" +", " "), (r"\) ([.!:?;,])", r")\1"), (r"\( ", "("), (r" \)", ")"),
        (r"(\d) %", r"\1%"), (" :", ":"), (" ;", ";"), ("[„“”]", '"'), ("–", "-"), ("—", " - "), (" +", " "),
        ("[´‘‚’]", "''"), ("''''", '"'), ("…", "..."), ("[«»]", '"'), (r"\"([,.]+)", r'\1"'),
    ]
    n5 = "x"
    for a, b in rules:
        n5 = f"regexp_replace({n5}, '{a}', '{b}', 'g')"
    return f"""
    c1 AS (SELECT {keep}, {flat} AS x FROM {source}),
    c2 AS (SELECT {keep}, {_clitics(fold)} AS x FROM c1),
    c3 AS (SELECT {keep}, x, string_split(x, '"') AS s FROM c2),
    c4 AS (SELECT {keep}, CASE
        WHEN len(s) = 1 OR len(s) % 2 = 0 OR contains(x, '""') OR contains(x, '" "') THEN x
        WHEN d > 2 AND d > (len(s) - 1) * 2 / 3 THEN x ELSE array_to_string(f, '"') END AS x
      FROM (SELECT *, list_sum(list_transform(f, lambda v, k: abs(length(v) - length(s[k])))) AS d
            FROM (SELECT *, {fixed} AS f FROM c3))),
    c5 AS (SELECT {keep}, {_repair(_strip(n5))} AS x FROM c4)"""


# --- vocabulary pieces -------------------------------------------------------------------

WORD_COUNTS = f"""
wc AS (
  SELECT word, count(*) AS freq
  FROM (SELECT unnest({_words("t")}) AS word
        FROM (SELECT {_strip("replace(" + _strip("text") + ", '[TAB] ', '')")} AS t FROM documents) WHERE t <> '')
  GROUP BY word)"""

VOCAB = """
vocab AS (
  SELECT word, row_number() OVER (ORDER BY freq DESC, word) + 6 AS id, freq
  FROM wc WHERE freq >= 2 ORDER BY freq DESC, word LIMIT 4993)"""

TURN_PAIRS = """
tp AS (
  SELECT a.conv_id, a.turn, a.text AS text_a, b.text AS text_b
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""

PREDICTIONS = """
pr AS (
  SELECT l.doc_id, d.lang, d.n_chars, l.quality, l.toxic, CAST(d.n_chars > 300 AS INT) AS pred,
         CASE WHEN l.doc_id % 7 = 0 THEN -1 ELSE l.quality END AS label, l.doc_id // 64 AS batch
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _u(key, slot=0):
    return f"(('0x' || substr(md5({key}), {8 * slot + 1}, 8))::UBIGINT::DOUBLE / 4294967296.0)"


def _cells(cond_p, cond_y):
    return (
        f"CAST(count(*) FILTER ({cond_p} AND {cond_y}) AS DOUBLE) tp, CAST(count(*) FILTER ({cond_p} AND NOT {cond_y}) AS DOUBLE) fp, "
        f"CAST(count(*) FILTER (NOT {cond_p} AND {cond_y}) AS DOUBLE) fn, CAST(count(*) FILTER (NOT {cond_p} AND NOT {cond_y}) AS DOUBLE) tn"
    )


def _segments(length):
    return f"seg AS (SELECT doc_id AS seg_id, {_ids('text')}[1:{length - 2}] AS k FROM documents)"


def _framed(k, length):
    return f"[1] || {k} || [2] || list_transform(range({length - 2} - len({k})), lambda z: 3)"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["doc_lines_dedup"] = f"""WITH {DOC_LINES}, n AS (SELECT doc_id, pos, {_n1("text")} AS text FROM doc_lines)
      SELECT doc_id, pos, text FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM n)
      WHERE p IS DISTINCT FROM text"""
    q["lines_spoken"] = f"""WITH {CORPUS_LINES},
      s AS (SELECT lang, source, doc_id, pos, {_strip("text")} AS t FROM corpus_lines),
      o AS (SELECT lang, source, doc_id, pos, CASE WHEN t = '' THEN '' ELSE {_quote(_cap("t"))} END AS text
            FROM s WHERE t NOT IN ('.', '!', '?'))
      SELECT {OUT} FROM (SELECT *, lag(text) {W} AS p FROM o) WHERE text = '' OR p IS DISTINCT FROM text"""

    keep = "lang, source, doc_id, pos"
    q["lines_child_speech"] = f"""WITH {CORPUS_LINES},
      c0 AS (SELECT {keep}, {_cap("t")} AS x FROM (SELECT *, {_strip("text")} AS t FROM corpus_lines) WHERE t <> ''),
      {_clean_cte("c0", keep)}, o AS (SELECT {keep}, {_quote("x")} AS text FROM c5)
      SELECT {OUT} FROM (SELECT *, lag(text) {W} AS p FROM o) WHERE p IS DISTINCT FROM text"""
    q["lines_spoken_dialogue"] = f"""WITH {CORPUS_LINES},
      c0 AS (SELECT {keep}, {_cap("t")} AS x, t = '' AS b FROM (SELECT *, {_strip("text")} AS t FROM corpus_lines)
             WHERE t NOT IN ('.', '!', '?')),
      {_clean_cte("c0", keep + ", b")}, o AS (SELECT {keep}, CASE WHEN b THEN '' ELSE {_quote("x")} END AS text FROM c5)
      SELECT {OUT} FROM (SELECT *, lag(text) {W} AS p FROM o) WHERE text = '' OR p IS DISTINCT FROM text"""
    treebank = "t"
    for a, b in (("-LRB-", "("), ("-LCB-", "{"), ("-LSB-", "["), ("-RRB-", ")"), ("-RCB-", "}"), ("-RSB-", "]"),
                 ("`` ", '"'), ("``", '"'), (" ''''", '"'), ("''''", '"')):
        treebank = f"replace({treebank}, '{a}', '{b}')"
    q["lines_treebank"] = f"""WITH {CORPUS_LINES},
      c0 AS (SELECT {keep}, {treebank} AS x FROM (SELECT *, {_strip("text")} AS t FROM corpus_lines)),
      {_clean_cte("c0", keep)} SELECT {keep}, x AS text FROM c5"""
    q["clean_full"] = f"""WITH {CORPUS_LINES}, c0 AS (SELECT doc_id, pos, text AS x FROM corpus_lines WHERE text <> ''),
      {_clean_cte("c0", "doc_id, pos")} SELECT doc_id, pos, x AS text FROM c5"""
    q["lines_story_gaps"] = f"""WITH {CORPUS_LINES},
      r AS (SELECT {keep}, CASE WHEN pos % 4 = 1 THEN '    ' || text ELSE text END AS raw FROM corpus_lines),
      o AS (SELECT {keep}, CASE WHEN {_strip("raw")} = '' THEN '' ELSE
              {_repair("CASE WHEN raw LIKE '    %' THEN '[TAB] ' || " + _n1("raw") + " ELSE " + _n1("raw") + " END")} END AS text FROM r)
      SELECT {OUT} FROM (SELECT *, lag(text) {W} AS a, lag(text, 2) {W} AS b FROM o)
      WHERE text <> '' OR (a <> '' AND b <> '')"""
    q["paragraphs_reflow"] = f"""WITH {CORPUS_LINES},
      o AS (SELECT {keep}, {_repair(_n1("text"))} AS text FROM corpus_lines),
      m AS (SELECT *, sum(CASE WHEN text = '' THEN 1 ELSE 0 END) {W} - CASE WHEN text = '' THEN 1 ELSE 0 END AS island,
              lag(text) {W} AS a, lag(text, 2) {W} AS b, lag(text, 3) {W} AS c FROM o),
      p AS (SELECT lang, source, max(CASE WHEN text = '' THEN doc_id END) AS doc_id, max(CASE WHEN text = '' THEN pos END) AS pos,
              string_agg(CASE WHEN text <> '' THEN text END, ' ' ORDER BY doc_id, pos) AS text
            FROM m GROUP BY lang, source, island
            HAVING count(*) FILTER (text = '') > 0 AND count(*) FILTER (text <> '') > 0)
      SELECT {OUT} FROM p UNION ALL SELECT {OUT} FROM m WHERE text = '' AND a = '' AND b <> '' AND c <> ''"""
    q["lines_subtitle"] = f"""WITH {CORPUS_LINES},
      d AS (SELECT {keep}, {_dash(_repair(_n1("text")))} AS t FROM corpus_lines),
      o AS (SELECT {keep}, {_quote_unless("t")} AS text FROM d)
      SELECT {OUT} FROM (SELECT *, lag(text) {W} AS p FROM o) WHERE p IS DISTINCT FROM text"""
    rounds, kept, t = "t", "NOT (contains(t, '&lt') AND contains(t, '&gt'))", "t"
    for _ in range(3):
        t = f"replace(replace(replace({t}, '&gt;', '>'), '&lt;', '<'), '&amp;', '&')"
        kept += f" AND NOT (contains({t}, '&lt') AND contains({t}, '&gt'))"
    q["lines_captions"] = rf"""WITH {PAGE_LINES},
      d AS (SELECT page_id, pos, {_repair(_dash(_n1("text")))} AS t FROM page_lines),
      e AS (SELECT page_id, pos, {t} AS t FROM d WHERE t = '' OR ({kept})),
      f AS (SELECT * FROM e WHERE t = '' OR (NOT contains(t, '->') AND NOT (t LIKE '%:' AND NOT regexp_matches(t, '\p{{L}}')))),
      o AS (SELECT page_id, pos, {_quote_unless("t")} AS text FROM f)
      SELECT page_id, pos, text FROM (SELECT *, lag(text) {WP} AS p FROM o) WHERE p IS DISTINCT FROM text"""
    stub = "t <> '' AND length(t) < 128 AND (contains(t, ' the ') OR contains(t, ' la ') OR contains(t, ' der '))"
    twice = "replace(replace(replace(replace(replace(replace(t, '&gt;', '>'), '&lt;', '<'), '&amp;', '&'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&')"
    q["stub_filter"] = rf"""WITH {CORPUS_LINES},
      d AS (SELECT {keep}, {_repair("regexp_replace(" + _n1("text") + r", '\[\d+\]', '', 'g')")} AS t FROM corpus_lines),
      o AS (SELECT {keep}, {twice} AS text, {stub} AS stub FROM d),
      m AS (SELECT *, lag(text) {W} AS a, lag(stub) {W} AS astub, lead(stub) {W} AS nstub FROM o)
      SELECT {OUT} FROM m WHERE CASE WHEN text = '' THEN a IS NOT NULL AND a <> '' AND NOT astub
                                     ELSE NOT stub AND nstub IS NOT NULL AND NOT nstub END"""
    q["lines_phone"] = f"""WITH {CORPUS_LINES},
      d AS (SELECT {keep}, {_repair(_dash(_n1("text")))} AS t FROM corpus_lines),
      o AS (SELECT {keep}, CASE WHEN t = '' THEN '' ELSE {_quote("t")} END AS text FROM d)
      SELECT {OUT} FROM (SELECT *, last_value(CASE WHEN text <> '' THEN text END IGNORE NULLS)
          OVER (PARTITION BY lang, source ORDER BY doc_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM o)
      WHERE text = '' OR p IS DISTINCT FROM text"""
    q["wiki_markup"] = rf"""WITH {PAGE_LINES},
      r AS (SELECT page_id, pos, regexp_replace(regexp_replace(text, '^<h1>((?s:.*))$', '= = = \1 = = ='),
              '^<a href="([^"]*)">((?s:.*))$', '[[\1|\2]] [1]') AS t FROM page_lines),
      d AS (SELECT page_id, pos, {_repair("CASE WHEN contains(t, '<') THEN " + _n1("t") + " ELSE replace(" + _n1("t") + ", '&amp;', '&') END")} AS t FROM r),
      k AS (SELECT * FROM d WHERE t <> '' AND t NOT LIKE '[[Category:%' AND t NOT LIKE '[[File:%'),
      x AS (SELECT page_id, pos, unnest(ls) AS t, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS sub FROM
             (SELECT page_id, pos, CASE WHEN t LIKE '= = = %' AND pos > 0 THEN ['', t] ELSE [t] END AS ls FROM k))
      SELECT page_id, pos, sub, regexp_replace(regexp_replace(regexp_replace(t, '\[\d+\]', '', 'g'),
        '\[\[([^|\]]*)\|*[^\]]*\]\]', '\1', 'g'), '= = = ([^=]*) = = =', '\1', 'g') AS text FROM x"""
    q["corpus_union"] = f"""WITH {PLAIN_LINES} SELECT CASE lang WHEN 'de' THEN 0::BIGINT WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS corpus_rank,
      lang, source, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars, max(doc_id) AS last_doc
      FROM corpus_lines GROUP BY lang, source"""

    end, start = r"[.!?…।॥؟۔][\"''’”)\]]{0,3}", r"[\"''“‘(\[]?[\p{Lu}\p{Lo}\p{N}]"
    def mark(t):
        m = rf"regexp_replace({t}, '({end})(\s+)({start})', '\1' || chr(1) || '\2\3', 'g')"
        m = rf"regexp_replace({m}, '([。！？][’”」』）]{{0,3}})(\s*[^\s’”」』）])', '\1' || chr(1) || '\2', 'g')"
        return rf"regexp_replace({m}, '(^|[^\p{{L}}\p{{N}}])(\p{{Lu}}\.)' || chr(1), '\1\2', 'g')"

    q["sentences"] = f"""WITH {DOC_LINES}, s AS (SELECT doc_id, pos, string_split({mark(_strip("text"))}, chr(1)) AS p FROM doc_lines),
      u AS (SELECT doc_id, pos, len(p) AS n, unnest(p) AS t, generate_subscripts(p, 1) - 1 AS sent FROM s)
      SELECT doc_id, pos, CAST(sent AS BIGINT) AS sent,
        {_strip("t")} || CASE WHEN sent = n - 1 AND {_strip("t")} <> '' THEN '[PAR]' ELSE '' END AS text FROM u"""
    whole = f"string_agg(text, chr(10) ORDER BY doc_id, pos)"
    q["sentences_across_lines"] = f"""WITH {PLAIN_LINES},
      w AS (SELECT lang, source, {_strip(whole)} AS t FROM corpus_lines GROUP BY lang, source),
      p AS (SELECT lang, source, string_split({mark("t")}, chr(1)) AS p FROM w)
      SELECT lang, source, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS sentence_no, {_strip("x")} || '[PAR]' AS text
      FROM (SELECT lang, source, p, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM p)""".replace(
        "CAST(generate_subscripts(p, 1) - 1 AS BIGINT)", "CAST(i - 1 AS BIGINT)")
    q["abbreviation_stats"] = rf"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[^\s]+')) AS w FROM documents),
      c AS (SELECT regexp_replace(w, '^["''“‘(\[]+|["''’”)\],;:]+$', '', 'g') AS w FROM w),
      y AS (SELECT regexp_replace(w, '\.$', '') AS type, CAST(suffix(w, '.') AS BIGINT) AS d FROM c WHERE regexp_matches(w, '\p{{L}}')),
      g AS (SELECT type, CAST(sum(d) AS BIGINT) AS k, count(*) AS n FROM y WHERE regexp_matches(type, '^[\p{{L}}.\-]+$') GROUP BY type),
      a AS (SELECT sum(n)::DOUBLE AS words, sum(k)::DOUBLE AS dotted FROM g),
      l AS (SELECT type, k, n, dotted / words AS p, length(type) - length(replace(type, '.', '')) AS inner_n FROM g, a WHERE k > 0)
      SELECT type, k AS with_period, n, round(-2.0 * ((k * ln(p) + (n - k) * ln(1.0 - p)) - (k * ln(0.99) + (n - k) * ln(1.0 - 0.99)))
        * exp(-(length(type) - inner_n)) * (inner_n + 1) * pow(length(type) - inner_n, -(n - k)), 6) AS score FROM l"""
    learned = rf"""{DOC_LINES}, known AS (SELECT type FROM ({q["abbreviation_stats"]}) WHERE score >= 0.3),
      s AS (SELECT doc_id, pos, string_split({mark(_strip("text"))}, chr(1)) AS p FROM doc_lines),
      piece AS (SELECT doc_id, pos, len(p) AS n, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM s),
      word AS (SELECT *, lower(regexp_replace(regexp_extract(t, '([^\s]+)\.$', 1), '^["''“‘(\[]+', '')) AS w FROM piece),
      ends AS (SELECT doc_id, pos, i, t, CASE WHEN i < n AND w <> '' AND w IN (SELECT type FROM known) THEN 0 ELSE 1 END AS e FROM word),
      place AS (SELECT doc_id, pos, i, t, coalesce(sum(e) OVER (PARTITION BY doc_id, pos ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM ends),
      whole AS (SELECT doc_id, pos, sent, string_agg(t, '' ORDER BY i) AS t FROM place GROUP BY doc_id, pos, sent),
      learned AS (SELECT doc_id, pos, CAST(sent AS BIGINT) AS sent, {_strip("t")} ||
        CASE WHEN sent = max(sent) OVER (PARTITION BY doc_id, pos) AND {_strip("t")} <> '' THEN '[PAR]' ELSE '' END AS text FROM whole)"""
    q["sentences_learned"] = f"WITH {learned} SELECT doc_id, pos, sent, text FROM learned"
    q["sentence_examples"] = f"""WITH {learned}, {WORD_COUNTS}, {VOCAB.replace("4993", "50220")},
      ws AS (SELECT doc_id, pos, sent, {_words("replace(text, '[PAR]', '')")} AS ws FROM learned),
      t AS (SELECT doc_id, pos, sent, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM ws),
      seg AS (SELECT doc_id, pos, sent, list(CAST(coalesce(v.id, 0) AS BIGINT) ORDER BY i)[1:62] AS k
        FROM t LEFT JOIN vocab v ON v.word = t.word GROUP BY doc_id, pos, sent)
      SELECT doc_id, pos, sent, {_csv(_framed("k", 64))} AS input_ids, 62 - len(k) AS n_pad FROM seg"""
    whole = "CASE WHEN starts_with(text, ' ') THEN text ELSE ' ' || text END"
    q["subword_decoded"] = f"SELECT doc_id, md5({whole}) AS text_md5, length({whole}) AS chars FROM documents WHERE text <> ''"
    q["speaker_turns"] = rf"""WITH t AS (SELECT conv_id, turn, role, {_n1("text")} AS t FROM conversations)
      SELECT conv_id, turn, {_cap("role")} || ' ' || substr(md5(conv_id || ':' || role), 1, 4) || ': ''' || t || '''' AS text
      FROM t WHERE regexp_matches(t, '[\p{{L}}\p{{N}}]')"""

    who_key = "'' || conv_id || ':' || role"
    who = f"['Ada', 'Ben', 'Cleo', 'Dan', 'Eve'][1 + CAST(floor({_u(who_key)} * 5) AS BIGINT)]"
    ends = """SELECT conv_id AS doc_id, -1 AS place, '## Talk ' || conv_id AS text FROM conversations GROUP BY conv_id
      UNION ALL SELECT conv_id, unnest([1000000000, 1000000001]), '' FROM conversations GROUP BY conv_id"""
    sentence_lines = "array_to_string(list_filter(string_split(text, chr(10)), lambda v: v <> ''), chr(10))"
    turns = f"c0 AS (SELECT conv_id, turn, role, {sentence_lines} AS x FROM conversations), {_clean_cte('c0', 'conv_id, turn, role')}"
    ordered = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS block, text FROM b"
    q["spoken_documents"] = rf"""WITH {turns}, b AS (SELECT conv_id AS doc_id, turn AS place, {who} || ': ''' || x || '''' AS text FROM c5
        WHERE regexp_matches(x, '[\p{{L}}\p{{N}}]') UNION ALL {ends}) {ordered}"""
    q["written_documents"] = f"""WITH {turns}, b AS (SELECT conv_id AS doc_id, turn AS place, role || ': ''' || x || '''' AS text FROM c5
        WHERE x <> '' UNION ALL {ends}) {ordered}"""

    q["word_counts"] = f"WITH {WORD_COUNTS} SELECT word, freq FROM wc"
    marks = "(SELECT '[TAB] ' || replace(text, chr(10), chr(10) || '[TAB] ') AS text FROM documents)"
    q["word_counts_without_marks"] = f"WITH {WORD_COUNTS.replace('FROM documents)', f'FROM {marks})')} SELECT word, freq FROM wc"
    q["vocab_wordlevel"] = f"WITH {WORD_COUNTS}, {VOCAB} SELECT word AS token, id, freq FROM vocab"
    q["encode_wordlevel"] = f"""WITH {WORD_COUNTS}, {VOCAB},
      t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {_words("text")} AS ws FROM documents))
      SELECT doc_id, count(*) AS n, string_agg(CAST(coalesce(v.id, 0) AS VARCHAR), ',' ORDER BY i) AS ids
      FROM t LEFT JOIN vocab v ON v.word = t.word GROUP BY doc_id"""
    q["token_freq_top100"] = f"WITH {WORD_COUNTS} SELECT word AS token, CAST(freq AS BIGINT) AS freq FROM wc ORDER BY freq DESC, word LIMIT 100"
    q["f95"] = f"""WITH {WORD_COUNTS}, r AS (SELECT freq, row_number() OVER (ORDER BY freq DESC) - 1 AS rk, count(*) OVER () AS n FROM wc)
      SELECT freq AS f95, n AS vocab_size FROM r WHERE rk = n * 95 // 100"""
    q["vocab_coverage"] = f"""WITH {WORD_COUNTS}, {VOCAB}, t AS (SELECT item_id, unnest({_words("text")}) AS word FROM benchmark)
      SELECT item_id, count(v.word) AS inside, count(*) - count(v.word) AS outside
      FROM t LEFT JOIN vocab v ON v.word = t.word GROUP BY item_id"""

    q["shard_steps"] = f"""WITH {CORPUS_LINES}, s AS (SELECT (doc_id + pos) % 8 AS shard, count(*) AS n FROM corpus_lines GROUP BY 1)
      SELECT min(n // 16) AS steps, count(*) AS shards, CAST(min(n // 16) * count(*) * 16 * 128 AS BIGINT) AS token_budget FROM s"""
    q["train_examples"] = f"""WITH {_segments(64)} SELECT seg_id, {_csv(_framed("k", 64))} AS input_ids,
      repeat('0', len(k) + 2) || repeat('1', 62 - len(k)) AS is_pad FROM seg"""
    short = "'3:1:' || seg_id || ':short'"
    q["short_examples"] = f"""WITH {_segments(64)} SELECT seg_id, CAST(2 + least(len(k),
      CASE WHEN {_u(short)} > 0.5 THEN 62 ELSE 1 + CAST(floor({_u(short, 1)} * 61) AS BIGINT) END) AS BIGINT) AS n_real FROM seg"""
    key = "'5:2:' || seg_id"
    q["span_mask"] = f"""WITH RECURSIVE {_segments(64)},
      ex AS (SELECT seg_id, {_framed("k", 64)} AS ids FROM seg),
      n AS (SELECT seg_id, ids, len(list_filter(ids, lambda x: x >= 6)) AS n, {_u(key + " || ':count'")} AS u FROM ex),
      bin AS (SELECT seg_id, ids, n, u, 0 AS i, pow(0.85, n) AS pmf, pow(0.85, n) AS cdf, 0 AS k FROM n
        UNION ALL
        SELECT seg_id, ids, n, u, i + 1, pmf * (n - i) / (i + 1) * (0.15 / (1.0 - 0.15)),
          cdf + pmf * (n - i) / (i + 1) * (0.15 / (1.0 - 0.15)), CASE WHEN u >= cdf THEN i + 1 ELSE k END
        FROM bin WHERE i < n),
      want AS (SELECT seg_id, ids, least(n, greatest(1, k)) AS want,
        array_to_string(list_transform(ids, lambda x: CASE WHEN x >= 6 THEN '0' ELSE 'x' END), '') AS m FROM bin WHERE i = n),
      draw AS (SELECT seg_id, want, m, 0 AS done, 0 AS a FROM want
        UNION ALL
        SELECT seg_id, want, m2, length(replace(replace(m2, '0', ''), 'x', '')), a + 1 FROM (
          SELECT *, m[1:s] || translate(m[s + 1:e], '0mrk', repeat(act, 4)) || m[greatest(s, e) + 1:] AS m2 FROM (
            SELECT *, greatest(o, 0) AS s, greatest(least(63, o + l), greatest(o, 0)) AS e FROM (
              SELECT *, (1 - l) + CAST(floor(u1 * (64 + 2 * l - 1)) AS BIGINT) AS o FROM (
                SELECT *, CAST(greatest(1, ceil(ln(1.0 - u0) / ln(2.0 / 3.0))) AS BIGINT) % 10 AS l,
                  CASE WHEN u2 < 1.0 - 0.1 - 0.1 THEN 'm' WHEN u2 < 1.0 - 0.1 THEN 'r' ELSE 'k' END AS act FROM (
                  SELECT *, {_u(key + " || ':' || (a + 1)", 0)} AS u0, {_u(key + " || ':' || (a + 1)", 1)} AS u1,
                    {_u(key + " || ':' || (a + 1)", 2)} AS u2 FROM draw WHERE done < want AND a < 100))))) q),
      fin AS (SELECT d.seg_id, w.ids, d.m FROM (SELECT seg_id, max_by(m, a) AS m FROM draw GROUP BY seg_id) d JOIN want w ON w.seg_id = d.seg_id)
      SELECT seg_id,
        {_csv(f"list_transform(ids, lambda x, i: CASE m[i] WHEN 'm' THEN 4 WHEN 'r' THEN 5 + CAST(floor({_u(key + chr(32) + '|| ' + chr(39) + ':id' + chr(39) + ' || (i - 1)')} * (5000 - 5)) AS BIGINT) ELSE x END)")} AS inputs,
        {_csv("list_transform(ids, lambda x, i: CASE WHEN m[i] IN ('m', 'r', 'k') THEN x ELSE -100 END)")} AS labels FROM fin"""
    q["epoch_batches"] = """WITH r AS (SELECT doc_id AS seg_id, doc_id % 4 AS shard,
        row_number() OVER (PARTITION BY doc_id % 4 ORDER BY substr(md5((42 + doc_id % 4 + 12) || ':' || doc_id), 1, 15), doc_id) - 1 AS i,
        count(*) OVER (PARTITION BY doc_id % 4) AS n FROM documents)
      SELECT seg_id, shard, i // 16 AS batch, i % 16 AS slot FROM r WHERE i // 16 < n // 16"""

    q["pair_encode"] = f"""WITH {TURN_PAIRS}, p AS (SELECT conv_id, turn, ({_ids("text_a")} || {_ids("text_b")})[1:32] AS k FROM tp)
      SELECT conv_id, turn, {_csv("k || list_transform(range(32 - len(k)), lambda z: 0)")} AS input_ids,
        {_csv("list_transform(range(32), lambda z: CASE WHEN z < len(k) THEN 1 ELSE 0 END)")} AS is_real,
        CASE WHEN conv_id % 5 <> 0 THEN turn % 2 ELSE -1 END AS label FROM p"""
    q["longest_pair"] = f"WITH {TURN_PAIRS} SELECT CAST(max(len({_words('text_a')}) + len({_words('text_b')}) + 3) AS BIGINT) AS max_length FROM tp"
    q["truncate_pairs"] = f"""WITH {TURN_PAIRS}, p AS (SELECT conv_id, turn, {_ids("text_a")} AS a, {_ids("text_b")} AS b FROM tp),
      l AS (SELECT *, CASE WHEN len(a) + len(b) <= 45 THEN len(a)
              WHEN len(b) <= 22 THEN 45 - len(b) WHEN len(a) <= 22 THEN len(a)
              WHEN len(a) >= len(b) THEN 23 ELSE 22 END AS na FROM p),
      m AS (SELECT *, least(len(b), 45 - na) AS nb FROM l)
      SELECT conv_id, turn, na AS n_a, nb AS n_b, {_csv("[1] || a[1:na] || [2] || b[1:nb] || [2]")} AS input_ids,
        {_csv("list_transform(range(na + 2), lambda z: 0) || list_transform(range(nb + 1), lambda z: 1)")} AS segment_ids FROM m"""
    q["collated_sentences"] = f"""WITH {TURN_PAIRS}, p AS (SELECT conv_id AS batch, turn, {_ids("text_a")} AS a, {_ids("text_b")} AS b FROM tp),
      c AS (SELECT batch, turn, a[1:len(a) - greatest(0, least(len(a), len(a) + len(b) + 3 - 512))] AS a, b FROM p),
      l AS (SELECT *, len(a) + len(b) + 3 AS length, max(len(a) + len(b) + 3) OVER (PARTITION BY batch) AS width FROM c)
      SELECT batch, turn, length, width, md5({_csv("[1] || a || [2] || b || [2] || list_transform(range(width - length), lambda z: 3)")}) AS input_md5,
        width - length AS n_pad FROM l"""
    q["collated_late_cuts"] = q["collated_sentences"].replace("3 - 512", "3 - 128")
    q["span_masks"] = f"""WITH {PLAIN_LINES}, k AS (SELECT doc_id, pos, {_ids("text")} AS k FROM corpus_lines WHERE text <> '')
      SELECT doc_id, pos, array_to_string(list_transform(range(len(k)), lambda i: CASE WHEN i BETWEEN len(k) // 4 AND len(k) // 2 THEN '0' ELSE '1' END), '') AS span_mask,
        {_csv("list_transform(range(8), lambda v: len(list_filter(k, lambda x: x % 8 = v)))")} AS labels
      FROM k WHERE len(k) BETWEEN 1 AND 126"""
    q["pseudo_likelihood_rows"] = f"""WITH k AS (SELECT item_id, {_ids("text")} AS k FROM benchmark),
      u AS (SELECT item_id, k, unnest(k) AS target, generate_subscripts(k, 1) AS i FROM k)
      SELECT item_id, CAST(i - 1 AS BIGINT) AS pos, CAST(target AS BIGINT) AS target,
        md5({_csv("[1] || list_transform(k, lambda x, j: CASE WHEN j = i THEN 4 ELSE x END) || [2]")}) AS input_md5 FROM u"""

    q["label_balance"] = """SELECT count(*) FILTER (quality = 1) AS positives, count(*) AS n,
      round(count(*) FILTER (quality = 1) * 100.0::DOUBLE / count(*), 6) AS percent FROM labels"""
    q["confusion"] = f"""WITH {PREDICTIONS} SELECT CAST(label AS BIGINT) AS label, CAST(pred AS BIGINT) AS pred, count(*) AS n
      FROM pr WHERE label >= 0 GROUP BY label, pred"""
    q["accuracy_batch_mean"] = f"""WITH {PREDICTIONS},
      b AS (SELECT batch, count(*) FILTER (label >= 0 AND pred = label) AS h, count(*) FILTER (label >= 0) AS n FROM pr GROUP BY batch)
      SELECT round(avg(h / greatest(n, 1)), 9) AS batch_mean, round(sum(h) / greatest(sum(n), 1), 9) AS micro, count(*) AS batches FROM b"""
    q["mcc"] = f"""WITH {PREDICTIONS}, c AS (SELECT lang, {_cells("(pred = 1)", "(label = 1)")} FROM pr WHERE label >= 0 GROUP BY lang)
      SELECT lang, round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0
        THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0.0 END, 9) AS mcc FROM c"""
    q["f1"] = f"""WITH {PREDICTIONS}, c AS (SELECT lang, {_cells("(pred = 1)", "(label = 1)")} FROM pr WHERE label >= 0 GROUP BY lang)
      SELECT lang, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 9) AS f1 FROM c"""
    q["f1_macro"] = f"""WITH {PREDICTIONS}, r AS (SELECT quality + toxic AS y, n_chars % 3 AS p FROM pr),
      c AS (SELECT k, count(*) FILTER (y = k AND p = k) AS tp, count(*) FILTER ((y = k) <> (p = k)) AS bad FROM r, range(3) t(k) GROUP BY k)
      SELECT round(avg(CASE WHEN 2 * tp + bad > 0 THEN 2.0 * tp / (2 * tp + bad) ELSE 0.0 END), 9) AS f1_macro FROM c"""
    q["pearson_spearman"] = f"""WITH {PREDICTIONS}, r AS (SELECT n_chars::DOUBLE AS x, quality::DOUBLE AS y,
        rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rx,
        rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0 AS ry FROM pr)
      SELECT round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman FROM r"""
    q["pairwise_choice"] = """WITH r AS (SELECT conv_id, turn, length(text) AS p, len(string_split(text, ' ')) AS y FROM conversations),
      f AS (SELECT conv_id, min(turn) AS t, arg_min(p, turn) AS fp, arg_min(y, turn) AS fy FROM r GROUP BY conv_id)
      SELECT round(avg(CAST((fp > p) = (fy > y) AS INT)), 9) AS accuracy, count(*) AS n FROM r JOIN f ON r.conv_id = f.conv_id WHERE r.turn > f.t"""
    q["minimal_pairs_macro"] = f"""WITH {CORPUS_LINES},
      p AS (SELECT lang, source, CAST(-(length(text) % 17) > -((length(text) + pos) % 13) AS INT) AS ok FROM corpus_lines WHERE text <> ''),
      s AS (SELECT lang AS grp, source AS subgrp, avg(ok) * 100.0 AS a FROM p GROUP BY lang, source)
      SELECT grp, subgrp, round(avg(a), 6) AS accuracy FROM s GROUP BY GROUPING SETS ((grp, subgrp), (grp), ())"""
    q["history_stats"] = """WITH l AS (SELECT event_type AS run_id, date_trunc('hour', ts) AS step, avg(value) AS v FROM events GROUP BY 1, 2),
      m AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS a, count(*) OVER (PARTITION BY run_id) AS n FROM l)
      SELECT run_id, round(max(v), 6) AS max, round(min(v), 6) AS min, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*) AS n
      FROM m WHERE a <= ceil(n / 2) GROUP BY run_id"""
    q["epoch_table"] = """SELECT 'all' AS run_id, strftime(ts, '%Y-%m-%d') AS epoch, max(value) FILTER (event_type = 'click') AS click,
      max(value) FILTER (event_type = 'error') AS error, max(value) FILTER (event_type = 'purchase') AS purchase,
      max(value) FILTER (event_type = 'signup') AS signup, max(value) FILTER (event_type = 'view') AS view FROM events GROUP BY 2"""
    q["topk_softmax"] = """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
      p AS (SELECT vec_id, i, exp(x - max(x) OVER (PARTITION BY vec_id)) AS z FROM e),
      s AS (SELECT vec_id, i, z / sum(z) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, i) - 1 AS rk FROM p)
      SELECT vec_id, rk AS rank, CAST(i AS BIGINT) AS index, round(p, 6) AS probability FROM s WHERE rk < 5"""
    q["collapse_classes"] = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
      z AS (SELECT *, list_transform(x, lambda v: exp(v)) AS y FROM e), s AS (SELECT *, list_sum(y) AS t, y[len(y)] AS last FROM z)
      SELECT vec_id, round((t - last) / t, 6) AS p_first, round(last / t, 6) AS p_last, round((y[1] + last) / t / 2, 6) AS mix_first,
        CAST(list_position(x, list_max(x)) - 1 AS BIGINT) AS best FROM s"""
    q["vector_stats"] = """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm,
      round(list_stddev_samp(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS std FROM embeddings"""
    q["masked_token_scores"] = """WITH r AS (SELECT vec_id % 4 AS part, list_transform(embedding, lambda x: x::DOUBLE) AS e,
        label % len(embedding) + 1 AS t FROM embeddings WHERE vec_id % 9 <> 0),
      l AS (SELECT part, ln(list_sum(list_transform(e, lambda x: exp(x)))) - e[t] AS loss, list_position(e, list_max(e)) = t AS hit FROM r)
      SELECT part, round(avg(loss), 6) AS loss, round(avg(hit::INT), 6) AS accuracy, round(exp(avg(loss)), 6) AS perplexity, count(*) AS n
      FROM l GROUP BY part"""
    q["framed_pairs"] = f"""WITH {TURN_PAIRS}, p AS (SELECT conv_id, turn, {_ids("text_a")} AS a, {_ids("text_b")} AS b FROM tp),
      l AS (SELECT *, CASE WHEN len(a) + len(b) <= 61 THEN len(a)
              WHEN len(b) <= 30 THEN 61 - len(b) WHEN len(a) <= 30 THEN len(a)
              WHEN len(a) >= len(b) THEN 31 ELSE 30 END AS na FROM p),
      m AS (SELECT *, least(len(b), 61 - na) AS nb FROM l)
      SELECT conv_id, turn, {_csv("[1] || a[1:na] || [2] || b[1:nb] || [2] || list_transform(range(61 - na - nb), lambda z: 3)")} AS input_ids,
        {_csv("list_transform(range(3 + na + nb), lambda z: 1) || list_transform(range(61 - na - nb), lambda z: 0)")} AS is_real FROM m"""
    q["lower_lines"] = f"WITH {DOC_LINES} SELECT doc_id, pos, lower(text) AS text FROM doc_lines"
    q["accuracy_plain"] = f"""WITH {PREDICTIONS} SELECT lang, round(avg(CAST(pred = label AS INT)), 9) AS accuracy, count(*) AS n
      FROM pr WHERE label >= 0 GROUP BY lang"""
    q["resume_batches"] = """WITH b AS (SELECT doc_id, doc_id % 3 AS epoch, doc_id // 16 AS batch FROM documents)
      SELECT epoch, batch, epoch * 40 + batch AS step, count(*) AS n, max(doc_id) AS last_doc FROM b
      WHERE epoch * 40 + batch BETWEEN 25 AND 98 GROUP BY epoch, batch"""
    q["random_document"] = """SELECT doc_id AS seg_id, lang FROM documents ORDER BY md5('11:show:' || doc_id), doc_id LIMIT 1"""
    q["ordered_batches"] = """SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 16 AS batch FROM documents"""
    q["attached_predictions"] = """SELECT l.doc_id AS row_id, CAST(quality AS BIGINT) AS quality,
      CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS predicted FROM labels l LEFT JOIN embeddings e ON e.vec_id = l.doc_id"""
    even = "array_to_string(list_transform({}, lambda v: CASE WHEN v % 2 = 0 THEN '1' ELSE '0' END), '')"
    q["joined_span_masks"] = f"""WITH {TURN_PAIRS} SELECT conv_id, turn,
      '1' || {even.format(_ids("text_a"))} || '1' || {even.format(_ids("text_b"))} || '1' AS span_mask FROM tp"""
    q["validation_rows"] = """WITH s AS (SELECT doc_id, (['train', 'validation', 'validation_matched', 'validation_mismatched',
        'validation_hans'])[doc_id % 5 + 1] AS split FROM documents)
      SELECT 'mnli' AS task, split, doc_id FROM s WHERE split LIKE 'validation\\_%' ESCAPE '\\'
      UNION ALL SELECT 'rte', split, doc_id FROM s WHERE split = 'validation'"""
    q["probing_f1"] = f"""WITH k AS (SELECT item_id, {_ids("text")} AS k FROM benchmark),
      h AS (SELECT item_id % 3 AS task, unnest(range(32)) AS c, list_transform(k, lambda x: x % 32) AS y,
        list_transform(k, lambda x: (x + x % 5) % 32) AS p FROM k),
      t AS (SELECT task, list_contains(y, c) AS y, list_contains(p, c) AS p FROM h)
      SELECT CAST(task AS VARCHAR) AS task, 'test' AS split, round(2 * count(*) FILTER (y AND p) / (count(*) FILTER (y) + count(*) FILTER (p)), 9) AS f1
      FROM t GROUP BY task"""
    q["decoded_wordlevel"] = f"""WITH {WORD_COUNTS}, {VOCAB},
      t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {_words("text")} AS ws FROM documents))
      SELECT doc_id, md5(string_agg(coalesce(v.word, '[UNK]'), ' ' ORDER BY i)) AS text_md5
      FROM t LEFT JOIN vocab v ON v.word = t.word GROUP BY doc_id"""
    byte = "(CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174 THEN b WHEN b < 33 THEN 256 + b WHEN b = 173 THEN 323 ELSE 162 + b END)"
    shown = "list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::INT)"
    shown = f"array_to_string(list_transform({shown}, lambda b: chr({byte})), '')"
    split = r"''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
    q["byte_level_counts"] = rf"""WITH d AS (SELECT {_strip("replace(" + _strip("text") + ", '[TAB] ', '')")} AS t FROM documents),
      s AS (SELECT CASE WHEN t = '' OR regexp_matches(t, '^{BLANK}') THEN t ELSE ' ' || t END AS t FROM d),
      w AS (SELECT unnest(regexp_extract_all(t, '{split}')) AS w FROM s),
      c AS (SELECT hex(encode(w)) AS h, count(*) AS n FROM w GROUP BY w), b AS (SELECT {shown} AS x, n FROM c),
      p AS (SELECT unnest(regexp_extract_all(x, '\p{{N}}|[^\p{{N}}]+')) AS word, n FROM b)
      SELECT word, CAST(sum(n) AS BIGINT) AS freq FROM p GROUP BY word"""

    def page_arms(*arms):
        made = " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(arms))
        return PAGE_LINES.replace("page_lines AS", "plain_page_lines AS") + f""",
page_lines AS (SELECT page_id, pos, CASE WHEN text = '' THEN '' ELSE CASE (page_id * 7 + pos * 3) % 23 {made} ELSE text END END AS text
  FROM plain_page_lines)"""

    q["lines_captions_marked"] = q["lines_captions"].replace(
        PAGE_LINES, page_arms("'&lt;i&gt; ' || text", "text || ' -> x'", "'12 :'", "'- ' || text", "'Ab :'")
    )
    q["wiki_markup_furnished"] = q["wiki_markup"].replace(
        PAGE_LINES, page_arms("'[[Category:' || pos || ']]'", "'[[File:a.png|x]]'", "'[[Aa|Bb]] [[Cc]] [12] ' || text")
    )
    # The default phrases of boilerplate entries.
    phrases = (
        "is a commune. It is", "is a commune found", "is a city in",
        "is a village in", "is a municipality in", "is a town in",
    )
    arms = " ".join(f"WHEN {k} THEN 'Ab {p} Cd.'" for k, p in enumerate(phrases))
    q["stub_filter_phrases"] = q["stub_filter"].replace(
        CORPUS_LINES,
        CORPUS_LINES.replace("corpus_lines AS (SELECT lang", "salted_lines AS (SELECT lang") + f""",
corpus_lines AS (SELECT lang, source, doc_id, pos, CASE WHEN text = '' THEN '' ELSE CASE (doc_id * 5 + pos * 3) % 29 {arms} ELSE text END END AS text
  FROM salted_lines)""",
    ).replace(
        "(contains(t, ' the ') OR contains(t, ' la ') OR contains(t, ' der '))", "(" + " OR ".join(f"contains(t, '{p}')" for p in phrases) + ")"
    )
    q["speaker_turns_wordless"] = q["speaker_turns"].replace(
        "FROM conversations",
        "FROM (SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 9 = 0 THEN ' ?! ... ' ELSE text END AS text FROM conversations)",
    )
    q["morph_word_counts"] = f"""WITH {WORD_COUNTS},
      m AS (SELECT unnest(CASE WHEN length(word) > 6 THEN [word[:4], word[5:]] ELSE [word] END) AS word, freq FROM wc)
      SELECT word, CAST(sum(freq) AS BIGINT) AS freq FROM m GROUP BY word"""
    q["sample_report"] = f"""SELECT item_id, text, array_to_string(flatten(list_transform({_words("text")},
      lambda w: CASE WHEN length(w) > 4 THEN [w[:4], w[5:]] ELSE [w] END)), ' ') AS tokens FROM benchmark"""
    probes = f"""
      s AS (SELECT conv_id * 100000 + turn AS sent_id, conv_id AS batch, {_ids("text")} AS ids FROM conversations),
      k AS (SELECT *, CAST(len(ids) AS BIGINT) AS n FROM s WHERE len(ids) BETWEEN 1 AND 126),
      p AS (SELECT *, max(n) OVER (PARTITION BY batch) + 2 AS width,
              row_number() OVER (PARTITION BY batch ORDER BY sent_id) - 1 AS sentence_index FROM k)"""
    q["probing_inputs"] = f"""WITH {probes}
      SELECT sent_id, batch, sentence_index, width, width - n - 2 AS n_pad,
        md5({_csv("[1] || ids || [2] || list_transform(range(width - n - 2), lambda i: 3)")}) AS input_md5 FROM p"""

    def probe(task, no, classes, hot, first, second):
        labels = f"{_csv(f'list_transform(range({classes}), lambda c: CASE WHEN c = {hot} THEN 1 ELSE 0 END)')}" if classes else "NULL"

        def mask(span):
            if span is None:
                return "NULL"
            inside = f"lambda i: CASE WHEN i BETWEEN {span[0]} AND {span[1]} THEN '0' ELSE '1' END"
            return f"'1' || array_to_string(list_transform(range(n), {inside}), '') || repeat('1', width - n - 1)"

        return f"""SELECT sent_id, '{task}' AS task, CAST({no} AS BIGINT) AS span_no, sentence_index, {labels} AS labels,
          {mask(first)} AS span_mask_1, {mask(second)} AS span_mask_2 FROM p"""

    q["probing_spans"] = f"WITH {probes} " + " UNION ALL ".join([
        probe("ner", 0, 8, "n % 8", ("0", "n // 4"), None),
        probe("coref", 0, 2, "n % 2", ("0", "0"), ("n // 2", "n - 1")),
        probe("coref", 1, 2, "(n + 1) % 2", ("n // 2", "n // 2"), ("0", "n // 4")),
        probe("ud", 0, 0, "", ("n // 4", "n // 2"), ("n // 2", "n // 2")),
    ])
    q["run_leaderboard"] = r"""WITH r AS (
        SELECT CASE WHEN event_id % 13 = 0 THEN 'run ' || event_id ELSE concat_ws('_', ['WaW', 'WaM', 'WaD'][user_id % 3 + 1], event_type,
                 'small', ['BPE', 'M-WP'][event_id % 2 + 1], '16384', CASE WHEN event_id % 3 = 0 THEN 'more' END) END AS Name,
          props AS Notes, value + event_id / 1e9 AS val_accuracy, 1.0::DOUBLE / (abs(value) + 1) AS val_loss FROM events),
      n AS (SELECT *, regexp_extract(Name, '^(Wa[WMD])_', 1) AS task, regexp_extract(Name, '^Wa[WMD]_([a-z]+)_', 1) AS lang,
              regexp_extract(Name, '^Wa[WMD]_[a-z]+_small_([A-Z-]+)_', 1) AS tokenizer FROM r),
      o AS (SELECT *, row_number() OVER (PARTITION BY task, lang, tokenizer ORDER BY val_accuracy DESC) AS place,
              count(*) OVER (PARTITION BY task, lang, tokenizer) AS runs FROM n)
      SELECT task, lang, tokenizer, runs, Name, Notes, round(val_accuracy, 6) AS val_accuracy, round(val_loss, 6) AS val_loss
      FROM o WHERE place = 1"""
    q["run_durations"] = """WITH d AS (SELECT user_id, event_type,
        CAST(round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0) AS BIGINT) AS s FROM events GROUP BY ALL)
      SELECT user_id, event_type, CASE WHEN s < 86400 THEN '' WHEN s < 172800 THEN '1 day, ' ELSE (s // 86400) || ' days, ' END
        || printf('%d:%02d:%02d', s % 86400 // 3600, s % 3600 // 60, s % 60) AS elapsed FROM d"""
    return q
