"""SQL for another engine that must give the same rows as the queries of the same names."""

from __future__ import annotations

from .licenses import BASE, TEMPLATES, Template

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def _uniform(key: str, salt: str) -> str:
    return f"((CAST(CAST('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '') || ':' || {salt}), 1, 13) AS UBIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


#: The checksum over the bytes of a text, one after another, from a table made by the polynomial.
RENDEZVOUS = f"""WITH RECURSIVE poly(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents),
sums AS (SELECT row, doc_id, CAST(length(digits) // 2 + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(digits, '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS text_crc32 FROM d, steps),
race AS (SELECT row, CAST(s AS INTEGER) AS s, -ln({_uniform("doc_id", "s")}) AS time FROM d, range(17) r(s)),
won AS (SELECT row, first(s ORDER BY time, s) FILTER (s < 16) AS shard, first(s ORDER BY time, s) AS grown_shard FROM race GROUP BY row)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY {_uniform("concat_ws(':', doc_id, text_crc32)", "'slot'")}, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM sums JOIN won USING (row)"""

MIX = f"""WITH w AS (SELECT doc_id, source, md5(coalesce(text, '')) AS hash, coalesce({_WORDS}, []) AS words FROM documents),
q AS (SELECT doc_id, source, CAST(len(words) AS BIGINT) AS size, concat(doc_id, ':', hash) AS own, CASE WHEN len(words) > 0 AND length(array_to_string(words, '')) / len(words) BETWEEN 2 AND 12 THEN greatest(0.1::DOUBLE, least(1::DOUBLE, list_unique(words) / least(len(words), 400))) ELSE 0.1::DOUBLE END AS quality FROM w),
keyed AS (SELECT *, -ln({_uniform("own", "0")}) / quality AS key FROM q),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM q GROUP BY source),
-- sources whose limit is reached at the lowest shares come first; at each, what is left for it and those after it
shares AS (SELECT *, (SELECT sum(n) FROM sources) - coalesce(sum(3 * n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS whole FROM sources WINDOW o AS (ORDER BY 3 * n / weight, source NULLS LAST)),
free AS (SELECT first(CAST(rest AS DOUBLE) / whole ORDER BY 3 * n / weight) AS share FROM shares WHERE CAST(rest AS DOUBLE) * weight / whole <= 3 * n),
goal AS (SELECT source, n AS source_size, CASE WHEN share * weight > 3 * n THEN CAST(3 * n AS DOUBLE) ELSE share * weight END AS target FROM sources, free),
placed AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed k JOIN goal g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN size > 0 AND target - epochs * source_size - before > size / 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM placed"""

QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS} AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
seats AS (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
five AS (SELECT row, i, array_to_string(words[i : i + 4], ' ') AS said FROM seats),
twice AS (SELECT row, i, count(*) OVER (PARTITION BY row, said) AS n FROM five),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) WHERE n > 1 GROUP BY row),
c AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - list_unique(lines) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN covered USING (row))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c"""

_PLACES = " UNION ALL ".join(f"SELECT row, i, '{label}' AS label FROM seats WHERE words[i : i + {len(p.split()) - 1}] = {p.split()}" for p, label in BASE.items())
#: Words with which a phrase or a notice's first mandatory phrase starts: only there is anything looked for.
_STARTS = ", ".join(f"'{w}'" for w in sorted({p.split()[0] for p in BASE} | {t.places()[0][1][0] for t in TEMPLATES}))
_FOUND = rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
heard AS (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
seats AS MATERIALIZED (SELECT row, words, i FROM heard JOIN d USING (row) WHERE word IN ({_STARTS})),
places AS ({_PLACES}),
found AS (SELECT row, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY row)"""
_COUNTED = "doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, a AS first_word, b AS last_word, coalesce(f.labels, '') AS base_labels"
LICENCES = f"{_FOUND} SELECT {_COUNTED} FROM d LEFT JOIN found f USING (row)"


def _notice(t: Template) -> str:
    """Places (from 1, before the text too) at which all mandatory phrases stand as in the template, and the share of its words in place."""
    first, rest = t.places()[0], t.places()[1:]
    tests = [f"words[i : i + {len(first[1]) - 1}] = {first[1]}", *(f"i + {p - first[0]} > 0 AND words[i + {p - first[0]} : i + {p - first[0] + len(k) - 1}] = {k}" for p, k in rest)]
    return f"SELECT row, '{t.label}' AS label, list_sum(list_transform({t.words}, lambda w, j: CAST(i + j - {first[0] + 1} > 0 AND coalesce(words[i + j - {first[0] + 1}] = w, false) AS INTEGER))) / {len(t.words)} AS share FROM seats WHERE {' AND '.join(tests)}"


NOTICES = f"""{_FOUND},
notices AS ({" UNION ALL ".join(map(_notice, TEMPLATES))}),
everything AS (SELECT row, label, 1.0::DOUBLE AS share FROM places UNION ALL SELECT * FROM notices),
best AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM everything GROUP BY row)
SELECT {_COUNTED}, coalesce(b.labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN found f USING (row) LEFT JOIN best b USING (row)"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []) AS words FROM documents),
said AS (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM said GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM said a JOIN said b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 10 * c.n >= 8 * (x.n + y.n - c.n)),
reach(a, b) AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b)
SELECT doc_id, coalesce(c, doc_id) AS class_id, coalesce(n, 0) AS links FROM documents LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM linked GROUP BY a) USING (doc_id)"""

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(x AS HUGEINT), 0) > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INTEGER) ELSE 2 * CAST(x AS INTEGER) - 9 * CAST(CAST(x AS INTEGER) > 4 AS INTEGER) END)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
}
# where matches start: all that stands between them, and they themselves, up to there
_SPANS = " UNION ALL ".join(
    f"""SELECT row, {k} AS nth, '{kind}' AS kind, m, start FROM (SELECT row, unnest(ms) AS m, unnest(list_transform(ms, lambda x, i: list_sum(list_transform(rest[1 : i], lambda y: length(y))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda y: length(y))), 0))) AS start
 FROM (SELECT row, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS rest FROM d)) WHERE {test}"""
    for k, (kind, (pattern, test)) in enumerate(_KINDS.items())
)
PERSONAL = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({_SPANS}),
found AS (SELECT row, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _KINDS)}, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(m) AS BIGINT), ',' ORDER BY nth, start) AS listed FROM spans GROUP BY row)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in _KINDS)}, sha256(coalesce(listed, '')) AS base_sha256 FROM d LEFT JOIN found USING (row)"""

#: The exact nearest, which op1 gives where its shortlist reaches them: on a table of hundreds of vectors it does, on larger ones its recall is measured.
NEAREST = """WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
usual AS (SELECT len(v) AS n FROM e GROUP BY n ORDER BY count(*) DESC, n LIMIT 1),
v AS (SELECT vec_id, v FROM e JOIN usual ON len(v) = n),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, max(list_reduce(list_prepend(0::DOUBLE, list_transform(q.v, lambda x, i: x * c.v[i])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, c.vec_id),
placed AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM placed WHERE rank <= 20"""


def _normal(text: str) -> str:
    return rf"trim(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _sentences(text: str) -> str:
    return rf"string_split_regex({text}, '[.!?\x{{2026}}][\x22\x27)\]\x{{201d}}\x{{2019}}\x{{00bb}}]*[\s\x0B]+')"


def _said(text: str) -> str:
    """Lines and sentences, of each line and of the whole, as they are compared; empty ones left out."""
    lines = f"string_split({text}, chr(10))"
    return f"list_filter(list_transform(list_concat({lines}, {_sentences(text)}, flatten(list_transform({lines}, lambda y: {_sentences('y')}))), lambda z: {_normal('z')}), lambda z: z <> '')"


#: Replies are ordered by the turns on the way to them.
QUOTES = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
cut AS (SELECT row, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
l AS (SELECT row, i, length(replace(regexp_extract(line, '^[ \t>]*>'), '>', '>>')) - length(regexp_extract(line, '^[ \t>]*>')) AS depth, trim(regexp_replace(line, '^[ \t>]*>', ''), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM cut),
near AS (SELECT *, coalesce(lag(depth) OVER o <> depth, true) AS starts, coalesce(lead(depth) OVER o, 0) AS below FROM l WINDOW o AS (PARTITION BY row ORDER BY i)),
own AS (SELECT row, string_agg(line, chr(10) ORDER BY i) FILTER (depth = 0 AND NOT (below > 0 AND regexp_matches(line, '^.{{0,200}}\b(wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t]*$'))) AS body, max(depth) > 0 AS quotes FROM near GROUP BY row),
b AS (SELECT d.*, trim(CASE WHEN quotes THEN coalesce(body, '') ELSE text END, ' ' || chr(10) || chr(9) || chr(13)) AS body FROM d JOIN own USING (row)),
runs AS (SELECT *, sum(CAST(starts AND depth > 0 AS INTEGER)) OVER (PARTITION BY row ORDER BY i) - 1 AS nth FROM near),
passages AS (SELECT DISTINCT conv_id, turn, level, nth, r.text FROM (SELECT row, depth AS level, nth, string_agg(line, chr(10) ORDER BY i) AS text FROM runs WHERE depth > 0 GROUP BY row, depth, nth) r JOIN d USING (row) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
wanted AS (SELECT DISTINCT conv_id, turn, level, nth, text, 1 AS whole, {_normal("text")} AS said FROM passages WHERE {_normal("text")} <> '' UNION SELECT conv_id, turn, level, nth, text, 0, unnest({_said("text")}) FROM passages),
held AS (SELECT said, c, min(t) AS t FROM (SELECT conv_id AS c, turn AS t, unnest(list_concat([{_normal("body")}], {_said("body")})) AS said FROM b WHERE conv_id IS NOT NULL AND turn IS NOT NULL) WHERE said <> '' GROUP BY said, c),
sources AS (SELECT w.*, h.c, h.t, h.c = w.conv_id AS near FROM wanted w JOIN held h USING (said) WHERE CASE WHEN h.c = w.conv_id THEN h.t < w.turn ELSE len(string_split(said, ' ')) >= 4 END),
first AS (SELECT conv_id, turn, level, nth, text, whole, said, first(struct_pack(near := near, c := c, t := t) ORDER BY near DESC, c) AS s FROM sources GROUP BY conv_id, turn, level, nth, text, whole, said),
votes AS (SELECT conv_id, turn, level, nth, s, max(whole) AS whole, count(*) AS n FROM first GROUP BY conv_id, turn, level, nth, s),
best AS (SELECT conv_id, turn, level, nth, first(s ORDER BY whole DESC, s.near DESC, n DESC, s.c, s.t DESC) AS s FROM votes GROUP BY conv_id, turn, level, nth),
counted AS (SELECT conv_id, turn, count(*) AS n_quotes, count(s) AS n_linked, first(s.t ORDER BY level, nth, s.t) FILTER (s.c = conv_id) AS source FROM passages LEFT JOIN best USING (conv_id, turn, level, nth) GROUP BY conv_id, turn),
turns AS (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM d WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
tree AS (SELECT conv_id, turn, n_quotes, n_linked, coalesce(source, before) AS reply_to FROM turns LEFT JOIN counted USING (conv_id, turn)),
walk AS (SELECT conv_id, turn, [turn] AS path FROM tree WHERE reply_to IS NULL UNION ALL SELECT t.conv_id, t.turn, list_append(path, t.turn) FROM walk w JOIN tree t ON t.conv_id = w.conv_id AND t.reply_to = w.turn),
places AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS place FROM walk)
SELECT b.conv_id, b.turn, role, body, CAST(coalesce(n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, reply_to, place FROM b LEFT JOIN tree USING (conv_id, turn) LEFT JOIN places USING (conv_id, turn)"""

#: One row for each vendor goes through its end days, with the best numbers so far (cost, then segments) and where each one's last segment starts.
CHANGES = """WITH RECURSIVE daily AS (SELECT vendor_id, CAST(CAST(shipped_at AS DATE) - DATE '1970-01-01' AS BIGINT) AS day, CAST(sum(quantity) AS HUGEINT) AS q FROM sale_lines WHERE flag = 'kept' AND quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL),
span AS (SELECT vendor_id, min(day) AS first, max(day) AS last FROM daily GROUP BY vendor_id),
filled AS (SELECT s.vendor_id, s.first, d.day, coalesce(q, 0) AS q FROM (SELECT vendor_id, first, unnest(range(first, last + 1)) AS day FROM span) d JOIN span s ON s.vendor_id IS NOT DISTINCT FROM d.vendor_id LEFT JOIN daily ON daily.vendor_id IS NOT DISTINCT FROM d.vendor_id AND daily.day = d.day),
running AS (SELECT vendor_id, first, day, sum(q) OVER w AS s, sum(q * q) OVER w AS qq FROM filled WINDOW w AS (PARTITION BY vendor_id ORDER BY day)),
series AS (SELECT vendor_id, first, CAST(count(*) AS BIGINT) AS n, list_prepend(0::HUGEINT, list(s ORDER BY day)) AS s, list_prepend(0::HUGEINT, list(qq ORDER BY day)) AS qq FROM running GROUP BY vendor_id, first),
steps AS (SELECT vendor_id, first, n, s, qq, least(7, n) - 1 AS j, [-20000000000::BIGINT] AS best, [0::BIGINT] AS back FROM (SELECT * FROM series)
 UNION ALL SELECT vendor_id, first, n, s, qq, j, list_append(list_resize(best, j, 4000000000000000000::BIGINT), list_min(reach)), list_append(list_resize(back, j, 0::BIGINT), list_position(reach, list_min(reach)) - 1)
 FROM (SELECT vendor_id, first, n, s, qq, j + 1 AS j, best, back, list_transform(range(0, j + 1 - least(7, n) + 1), lambda i: CASE WHEN i > 0 AND i < least(7, n) THEN 4000000000000000000::BIGINT ELSE best[i + 1] + 20000000001 + CAST(1000000 * (j + 1 - i) * floor(1000 * ln(CAST(1 + ((j + 1 - i) * (qq[j + 2] - qq[i + 1]) - (s[j + 2] - s[i + 1]) * (s[j + 2] - s[i + 1])) // ((j + 1 - i) * (j + 1 - i)) AS DOUBLE))) AS BIGINT) END) AS reach FROM steps WHERE j < n)),
done AS (SELECT * FROM steps WHERE j = n),
cuts AS (SELECT vendor_id, first, s, qq, back, best[n + 1] // 1000000 AS best_cost, n AS b, back[n + 1] AS a FROM done UNION ALL SELECT vendor_id, first, s, qq, back, best_cost, a, back[a + 1] FROM cuts WHERE a > 0),
parts AS (SELECT vendor_id, first, best_cost, a, b - a AS n_days, CAST(s[b + 1] - s[a + 1] AS BIGINT) AS total, CAST(1 + ((b - a) * (qq[b + 1] - qq[a + 1]) - (s[b + 1] - s[a + 1]) * (s[b + 1] - s[a + 1])) // ((b - a) * (b - a)) AS BIGINT) AS spread FROM cuts)
SELECT vendor_id, CAST(row_number() OVER (PARTITION BY vendor_id ORDER BY a) AS INTEGER) AS segment_no, first + a AS first_day, n_days, total, spread, CAST(n_days * floor(1000 * ln(CAST(spread AS DOUBLE))) AS BIGINT) AS cost, count(*) OVER (PARTITION BY vendor_id) AS n_segments, best_cost FROM parts"""

_WHOLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
TOP = f"""WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))) AS whole FROM embeddings WHERE vec_id IS NOT NULL AND {_WHOLE} GROUP BY vec_id),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.whole, c.whole) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.whole) = len(c.whole)),
listed AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM listed WHERE rank <= 5"""


def _rounds(n: int) -> str:
    """Assignments a0 to an and the codebooks b1 to bn between them. Distances are whole numbers in doubles, less what all entries share."""
    assign = lambda i: f", a{i} AS MATERIALIZED (SELECT row, part, piece, arg_min(entry, struct_pack(d := far, e := entry)) AS entry, list_inner_product(piece, piece) + min(far) AS error FROM (SELECT row, part, p.piece, entry, b.square - 2 * list_inner_product(p.piece, b.piece) AS far FROM pieces p JOIN (SELECT *, list_inner_product(piece, piece) AS square FROM b{i}) b USING (part)) GROUP BY row, part, piece)"
    move = lambda i: f", b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.piece, b.piece) AS piece FROM b{i} b LEFT JOIN (SELECT part, entry, list(mean ORDER BY nth) AS piece FROM (SELECT part, entry, nth, floor(sum(x) / count(*)) AS mean FROM (SELECT part, entry, unnest(piece) AS x, unnest(range(len(piece))) AS nth FROM a{i}) GROUP BY part, entry, nth) GROUP BY part, entry) m USING (part, entry))"
    return "".join(assign(i) + move(i) for i in range(n)) + assign(n)


CODES = f"""WITH good AS (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS whole FROM embeddings WHERE {_WHOLE}),
usual AS (SELECT len(whole) AS n FROM good GROUP BY n ORDER BY count(*) DESC, n LIMIT 1),
kept AS (SELECT good.* FROM good JOIN usual ON len(whole) = n),
pieces AS MATERIALIZED (SELECT row, CAST(p AS INTEGER) AS part, whole[p * (len(whole) // 4) + 1 : (p + 1) * (len(whole) // 4)] AS piece FROM kept, range(4) r(p)),
starts AS (SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, whole) - 1 AS entry FROM kept),
b0 AS MATERIALIZED (SELECT part, entry, piece FROM pieces JOIN starts USING (row) WHERE entry < 256){_rounds(4)},
books AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, nth)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(piece) AS x, unnest(range(len(piece))) AS nth FROM b4)),
coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a4 GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (row), books"""


def oracle_sql() -> dict[str, str]:
    return {"op11_change_points": CHANGES, "op12_exact_top_k": TOP, "op13_filtering_lloyd": CODES, "op1_additive_quantisation": NEAREST, "op2_quotation_linking": QUOTES, "op5_efraimidis_spirakis": MIX, "op6_positional_licenses": NOTICES, "op9_jaccard_join": JACCARD, "op10_rendezvous": RENDEZVOUS, "base_quality": QUALITY, "base_licenses": LICENCES, "base_personal_data": PERSONAL}
