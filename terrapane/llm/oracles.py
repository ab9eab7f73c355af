"""DuckDB SQL of the operators' queries, where SQL can express them."""

from __future__ import annotations

from terrapane.llm import chat, classifier, collocations, licenses, linededup, quality, secrets, spelling


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- 2 ---------------------------------------------------------------------------------------------------------------


def _classifier() -> str:
    c = classifier
    without = lambda pattern: f"length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))"
    bins = {
        "symbols": "symbols * 200 / chars",
        "bars": "bars * 200 / chars",
        "marks": "marks * 100 / chars",
        "capitals": "capitals * 20 / chars",
        "digits": "digits * 40 / chars",
        "word_length": "chars * 2 / n",
        "short_words": "short_words * 20 / n",
        "distinct": "dist * 20 / n",
        "runs": "runs * 20 / n",
        "lines": "dup * 20 / greatest(1, n_lines)",
        "length": "length(bin(n)) - 1",
    }
    cells = ", ".join(f"CAST(least({c.BINS}, floor({bins[f]})) AS BIGINT)" for f in c.FEATURES)
    names = ", ".join(f"'{f}'" for f in c.FEATURES)
    prior = lambda g: (
        f"(SELECT CASE WHEN n IS NULL OR k < 2 OR n <= k THEN 1.0 ELSE least(greatest(inn / greatest((between_ / (k - 1) - inn) / ((n - squares / n) / (k - 1)), inn / 1e4), 1.0), 1e4) END FROM "
        f"(SELECT *, greatest(within_ / (n - k), 1e-9) AS inn FROM (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k, sum(ss - s * s / n) AS within_, sum(n * pow(s / n - (SELECT mean FROM mu), 2)) AS between_, CAST(sum(n * n) AS DOUBLE) AS squares FROM {g})))"
    )
    logit = lambda p: f"ln(greatest(1e-6, least(1 - 1e-6, {p})) / (1 - greatest(1e-6, least(1 - 1e-6, {p}))))"
    return rf"""
WITH w AS (
  SELECT doc_id, source AS host, lang AS path, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), f AS (
  SELECT doc_id, host, path, len(words) AS n_words, greatest(1, len(words)) AS n, greatest(1, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))) AS chars, {without("[#*$%&<>]+")} AS symbols, {without("[|]+")} AS bars,
    {without("[!?]+")} AS marks, {without(r"\p{Lu}+")} AS capitals, {without("[0-9]+")} AS digits, len(list_filter(words, lambda x: length(x) <= 3)) AS short_words, len(list_distinct(words)) AS dist,
    len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS runs, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS dup FROM w
), b AS (SELECT doc_id, host, path, n_words, unnest([{names}]) AS feature, unnest([{cells}]) AS bin FROM f),
known AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
ev AS (SELECT feature, bin, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM b JOIN known USING (doc_id) GROUP BY ALL),
tot AS (SELECT sum(good) AS g, sum(bad) AS b FROM ev WHERE feature = '{c.FEATURES[0]}'),
o AS (
  SELECT doc_id, host, path, n_words, CASE WHEN max(tot.g) > 0 AND max(tot.b) > 0 THEN ln(max(tot.g) / CAST(max(tot.b) AS DOUBLE)) +
    sum(CASE WHEN ev.bin IS NULL THEN 0 ELSE ln((ev.good + {c.SMOOTHING}) / (tot.g + {c.BINS * c.SMOOTHING})) - ln((ev.bad + {c.SMOOTHING}) / (tot.b + {c.BINS * c.SMOOTHING})) END) ELSE 0.0 END AS odds
  FROM b LEFT JOIN ev USING (feature, bin), tot GROUP BY doc_id, host, path, n_words
), p AS (SELECT doc_id, host, path, n_words, 1 / (1 + exp(-greatest(-{c.MOST_ODDS}, least({c.MOST_ODDS}, odds)))) AS p FROM o),
paths AS (SELECT host, path, count(*) AS n, sum(p) AS s, sum(p * p) AS ss FROM p GROUP BY host, path),
hosts AS (SELECT host, CAST(sum(n) AS BIGINT) AS n, sum(s) AS s, sum(ss) AS ss FROM paths GROUP BY host),
mu AS (SELECT avg(p) AS mean FROM p),
k AS (SELECT {prior("hosts")} AS hk, {prior("paths")} AS pk),
h AS (SELECT p.*, mean, pk, paths.n AS path_n, paths.s AS path_s, (hosts.s - p + hk * mean) / (hosts.n - 1 + hk) AS p_host FROM p, mu, k, hosts, paths WHERE p.host IS NOT DISTINCT FROM hosts.host AND p.host IS NOT DISTINCT FROM paths.host AND p.path IS NOT DISTINCT FROM paths.path),
q AS (SELECT *, (path_s - p + pk * p_host) / (path_n - 1 + pk) AS p_path FROM h),
z AS (SELECT *, 1 / (1 + exp(-({logit("p")} + {logit("p_path")} - {logit("mean")}))) AS p_quality FROM q)
SELECT doc_id, round(p, 6) AS p_document, round(p_host, 6) AS p_host, round(p_path, 6) AS p_path, round(p_quality, 6) AS p_quality, p_quality >= {c.KEEP} AND n_words > 0 AS kept FROM z
"""


# --- 4 ---------------------------------------------------------------------------------------------------------------

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM pairs UNION SELECT r.doc_id, e.b FROM reach r JOIN pairs e ON r.other = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least(w.doc_id, (SELECT min(other) FROM reach WHERE reach.doc_id = w.doc_id)), w.doc_id) AS component_id FROM w LEFT JOIN n ON w.doc_id = n.doc_id
"""

# --- 5 ---------------------------------------------------------------------------------------------------------------


def _secrets() -> str:
    parts = []
    for i, r in enumerate(secrets.RULES):
        p = quoted(r.pattern.replace('\\"', '"'))
        parts.append(
            f"SELECT doc_id, unnest(list_filter(list_transform(range(1, len(hits) + 1), lambda i: {{'s': CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT), "
            f"'n': length(hits[i]), 'v': length(vals[i])}}), lambda x: x.v >= {r.min_value})) AS x, {i} AS place, '{r.kind}' AS kind "
            f"FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {r.value_group}) AS vals, string_split_regex(text, {p}) AS gaps FROM d WHERE regexp_matches(text, {p}))"
        )
    base = "'" + "', '".join(secrets.BASE) + "'"
    item = "concat(kind, ':', s, ':', e)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS (SELECT doc_id, place, kind, x.s AS s, x.s + x.n AS e FROM ({' UNION ALL '.join(parts)})), "
        f"g AS (SELECT doc_id, {counts}, coalesce(string_agg({item}, ',' ORDER BY s, place) FILTER (kind IN ({base})), '') AS base, string_agg({item}, ',' ORDER BY s, place) AS spans FROM f GROUP BY doc_id) "
        f"SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"
    )


# --- 6 ---------------------------------------------------------------------------------------------------------------


def _chat() -> str:
    control = r"([<\[])(\\*)" + chat._BODY
    escaped = rf"regexp_replace(text, {quoted(control)}, '\1\2\\\3', 'g')"
    both = quoted("</s>[INST] ok [/INST]")
    frame = len(chat.START) + 1 + len(chat.END)
    order = "ORDER BY turn, role || chr(10) || escaped || '<|im_end|>'"
    return (
        f"WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', {both} UNION ALL SELECT -1, 1, 'assistant', {both}), "
        f"e AS (SELECT *, {escaped} AS escaped FROM c), "
        f"g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {order}) AS whole, coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '') AS loss, "
        f"CAST(sum({frame} + length(role) + length(escaped)) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id) "
        "SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"
    )


# --- 7 ---------------------------------------------------------------------------------------------------------------


def _licenses() -> str:
    """Pieces stand between bars of their own ("| a | | b |"), so that runs need no look-ahead."""
    lib = licenses
    known = sorted(lib.known_plain(lib.SENTENCES).items(), key=lambda x: (-len(x[0]), x[0]))
    runs = "|".join(lib.sentence_pattern(p, r" (?:\| \| )?") for p, _ in known)
    words = "|".join(sorted({max(p.split(), key=len) for p, _ in known}))
    fixed = "MAP {" + ", ".join(f"{quoted(p)}: {quoted(n)}" for p, n in known if "*" not in p) + "}"
    loose = " ".join(f"WHEN regexp_full_match(x, {quoted(lib.sentence_pattern(p, ' '))}) THEN {quoted(n)}" for p, n in known if "*" in p)
    rules = sorted(lib.RULES, key=lambda r: -len(r[1]))
    text = "' ' || array_to_string(found, '  ') || ' '"
    for i, (_, names) in enumerate(rules):
        text = f"replace({text}, {quoted(' ' + '  '.join(names) + ' ')}, ' @{i} ')"
    names = "[" + ", ".join(quoted(r[0]) for r in rules) + "]"
    cut = rf"regexp_replace(regexp_replace(text, '(^|[\r\n])[ \t]*(?:dnl|rem|REM|C)[ \t]+', '\1', 'g'), '([.!?:;])[ \t]+([A-Z])', E'\\1\n\\2', 'g')"
    plain = rf"regexp_replace(regexp_replace(lower({cut}), '[^a-z0-9\r\n]+', ' ', 'g'), ' ?[\r\n][ \r\n]*', ' | | ', 'g')"
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), p AS (SELECT doc_id, '| ' || trim({plain}) || ' |' AS pieces FROM d WHERE regexp_matches(lower(text), {quoted(words)})), "
        rf"h AS (SELECT doc_id, list_transform(regexp_extract_all(pieces, {quoted(rf'\| ({runs}) \|')}, 1), lambda v: replace(v, '| ', '')) AS hits FROM p), "
        f"f AS (SELECT doc_id, list_transform(hits, lambda x: coalesce(m[x], CASE {loose} END)) AS found FROM h, (SELECT {fixed} AS m) WHERE len(hits) > 0), "
        rf"r AS (SELECT doc_id, CAST(len(found) AS BIGINT) AS n_sentences, list_transform(regexp_extract_all({text}, '@(\d+)', 1), lambda v: {names}[CAST(v AS INT) + 1]) AS licenses FROM f) "
        "SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, CAST(coalesce(len(licenses), 0) AS BIGINT) AS n_licenses, coalesce(array_to_string(licenses, ','), '') AS licenses FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id"
    )


# --- 10 --------------------------------------------------------------------------------------------------------------


def _fences(name: str, keys: tuple[str, ...]) -> str:
    by = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {by}metric"
    slack = "CASE metric " + " ".join(f"WHEN '{m}' THEN {s}" for m, (s, _) in quality.METRICS.items()) + " END"
    two = ", ".join(f"'{m}'" for m, (_, both) in quality.METRICS.items() if both)
    edge = "((bin - 64 * greatest(0, bin // 64 - 1)) << greatest(0, bin // 64 - 1))"
    q = lambda p: f"min(CASE WHEN 100 * upto >= {p} * total THEN {edge} END) AS q{p}"
    high = f"q90 + {quality.FENCE} * (q90 - q50) + {slack}"
    low = f"CASE WHEN metric IN ({two}) THEN q10 - {quality.FENCE} * (q50 - q10) - {slack} ELSE -1 END"
    cols = ", ".join(f"max(CASE WHEN metric = '{m}' THEN {side} END) AS {label}_{m}" for label, side in (("low", low), ("high", high)) for m in quality.METRICS)
    return (
        f"{name} AS (SELECT {by}max(total) AS n, {cols} FROM (SELECT {by}metric, max(total) AS total, {q(10)}, {q(50)}, {q(90)} FROM (SELECT *, sum(n) OVER ({part} ORDER BY bin) AS upto, sum(n) OVER ({part}) AS total FROM "
        f"(SELECT {by}metric, bin, sum(n) AS n FROM sk GROUP BY {by}metric, bin)) GROUP BY {by}metric)" + (f" GROUP BY {by[:-2]}" if keys else "") + ")"
    )


def _narrowest(side: str, m: str) -> str:
    """The rule of quality.thresholds: the narrowest of the group's and its language's fences, shrunk to what is above them, and (one-sided metrics) all documents'."""
    x, pick = f"{side}_{m}", "greatest" if side == "low" else "least"
    shrunk = lambda n, fence, above: f"(CAST({n} AS DOUBLE) * {fence} + {quality.PRIOR} * {above}) / ({n} + {quality.PRIOR})"
    of_lang = shrunk("la.n", f"la.{x}", f"CAST(al.{x} AS DOUBLE)")
    near = f"{pick}({shrunk('own.n', f'own.{x}', of_lang)}, {of_lang})"
    return f"{near} AS {x}" if quality.METRICS[m][1] else f"{pick}({near}, al.{x}) AS {x}"


def _quality() -> str:
    within = " AND ".join(f"coalesce({m} >= low_{m} AND {m} <= high_{m}, true)" for m in quality.METRICS)
    pick = ", ".join(_narrowest(side, m) for side in ("low", "high") for m in quality.METRICS)
    share = lambda a, b: f"CAST(1000 * {a} // greatest({b}, 1) AS BIGINT)"
    e = lambda m: f"greatest(0, length(bin({m})) - 7)"
    bins = ", ".join(f"64 * {e(m)} + ({m} >> {e(m)})" for m in quality.METRICS)
    names = ", ".join(f"'{m}'" for m in quality.METRICS)
    return rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), grams AS (
  SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS gram, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2
), rep AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM grams), (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id
), b AS (
  SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEAT_PERCENT} * n_words AS base_failed, {share("n_symbols", "word_chars")} AS symbols, {share("n_dup_lines", "n_lines")} AS dup_lines,
    {share("n_repeat_words", "n_words")} AS repeats, CAST(10 * word_chars // greatest(n_words, 1) AS BIGINT) AS word_length FROM m
), sk AS (
  SELECT lang, source, metric, bin, count(*) AS n FROM (SELECT lang, source, unnest([{names}]) AS metric, unnest([{bins}]) AS bin FROM b WHERE NOT base_failed) GROUP BY ALL
), {_fences("own", ("lang", "source"))}, {_fences("la", ("lang",))}, {_fences("al", ())},
lim AS (SELECT own.lang, own.source, {pick} FROM own LEFT JOIN la ON own.lang IS NOT DISTINCT FROM la.lang LEFT JOIN al ON true)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {within} AS kept FROM b LEFT JOIN lim ON b.lang IS NOT DISTINCT FROM lim.lang AND b.source IS NOT DISTINCT FROM lim.source
"""


# --- 11 --------------------------------------------------------------------------------------------------------------


LINES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {linededup.LEAST_CHARS} GROUP BY key HAVING count(DISTINCT rid) >= {linededup.LEAST_DOCS}),
j AS (SELECT rid, k.doc_id, line, i, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.last AS goes FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT goes), '')) AS kept_sha256 FROM j GROUP BY rid
"""


# --- 12 --------------------------------------------------------------------------------------------------------------


SPELLINGS = rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n, string_split(concat(doc_id, ':', run), '') AS letters FROM r GROUP BY doc_id, run),
b AS (SELECT doc_id, run, n, flatten(list_transform(letters, lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), ord(x) - 64] END)) AS bytes FROM c),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], bytes), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM b, crc),
d AS (SELECT n, CASE WHEN h % {spelling.DAMAGE} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= {spelling.LEAST_CHARS} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
cut AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT cut.word, w.word FROM cut JOIN w ON cut.rest = w.word
  UNION SELECT w.word, cut.word FROM cut JOIN w ON cut.rest = w.word
),
f AS (
  SELECT word, count(*) AS n_near, min({{'o': -other_n, 'w': other}}) AS best, any_value(n) AS n FROM (SELECT p.word, a.n, p.other, b.n AS other_n FROM p JOIN w a ON a.word = p.word JOIN w b ON b.word = p.other) GROUP BY word
),
g AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.o >= 2 * w.n THEN best.w END AS form, CASE WHEN -best.o >= 2 * w.n THEN -best.o END AS form_n FROM w LEFT JOIN f ON f.word = w.word),
walk AS (SELECT word, word AS at FROM g UNION ALL SELECT walk.word, g.form FROM walk JOIN g ON g.word = walk.at WHERE g.form IS NOT NULL)
SELECT g.word, g.form, walk.at AS root, g.n, g.n_near, CAST(g.form_n AS BIGINT) AS form_n FROM g JOIN walk ON walk.word = g.word JOIN g e ON e.word = walk.at WHERE e.form IS NULL
"""


# --- 13 --------------------------------------------------------------------------------------------------------------


PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, '{collocations.NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (SELECT lang, words[i:i + k - 1] AS words FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w) JOIN (SELECT unnest(range(1, {collocations.LONGEST + 1})) AS k) ON i + k - 1 <= len(words)),
f AS (SELECT lang, words, count(*) AS f FROM g GROUP BY lang, words HAVING count(*) >= {collocations.LEAST}),
n AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
cover AS (SELECT lang, words[1:len(words) - 1] AS words, f FROM f UNION ALL SELECT lang, words[2:], f FROM f),
cand AS (SELECT f.* FROM f WHERE len(words) > 1 AND NOT EXISTS (SELECT 1 FROM cover WHERE cover.lang = f.lang AND cover.words = f.words AND cover.f >= f.f)),
cut AS (
  SELECT c.lang, c.words, c.f AS a, n.n, k, a.f AS l, b.f AS r, (1000::HUGEINT * c.f * n.n) // (a.f::HUGEINT * b.f) AS score
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM cand) c JOIN n ON n.lang = c.lang JOIN f a ON a.lang = c.lang AND a.words = c.words[1:k] JOIN f b ON b.lang = c.lang AND b.words = c.words[k + 1:]
),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, k) AS place FROM cut),
ranked AS (SELECT *, array_to_string(words, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank FROM best WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {collocations.TOP}
"""


ORACLES = {
    "op2_quality_classifier": _classifier(),
    "op4_jaccard_join": JACCARD,
    "op5_secret_scan": _secrets(),
    "op6_chat_format": _chat(),
    "op7_license_scan": _licenses(),
    "op10_quality_rules": _quality(),
    "op11_line_dedup": LINES,
    "op12_spelling_variants": SPELLINGS,
    "op13_collocations": PHRASES,
}
