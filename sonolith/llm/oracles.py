"""SQL of an independent engine for the operators that SQL can express.

Each statement finds the operator's rows by a plainer way: substring positions from
split pieces, words as rows, seeds as joined words instead of hashes, and all pairs
that share a shingle instead of chosen paths. They assume that doc_id is unique.
"""

from __future__ import annotations

from sonolith.llm import decontaminate, licenses, neardup, phrases, secrets


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rows(rows) -> str:
    cell = lambda x: _quoted(x) if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def _either_case(words: str) -> str:
    """A pattern of ASCII letters in either case, without the case folding of Unicode."""
    return "".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in words)


def secret_scan(copied_owners: int = 3, copied_share: float = 0.1, min_symbols: int = 6) -> str:
    names = _either_case("password|passwd|secret|token|api_?key")
    assign = rf"""(?:{names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    # A bare value starts a run of its letters and dots, and ends at the first dot.
    run = r"[A-Za-z0-9+/_=.-]+"
    patterns = (assign, secrets.ACCESS, secrets.HEX, secrets.PROVIDER, run)
    kinds = _rows(enumerate(secrets.KINDS))
    found = "\nUNION ALL ".join(f"SELECT doc_id, owner, {k} AS rank, regexp_extract_all(text, {_quoted(p)}) AS found, string_split_regex(text, {_quoted(p)}) AS pieces FROM d WHERE regexp_matches(text, {_quoted(p)})" for k, p in enumerate(patterns))
    return f"""WITH d AS (SELECT doc_id, source AS owner, coalesce(text, '') AS text FROM documents),
m AS ({found}),
u AS (SELECT doc_id, owner, rank, unnest(found) AS found, unnest(pieces[1:len(found)]) AS piece, generate_subscripts(found, 1) AS i FROM m),
p AS (SELECT doc_id, owner, rank, found, (sum(length(piece) + length(found)) OVER (PARTITION BY doc_id, rank ORDER BY i) - length(found))::BIGINT AS start FROM u),
v AS (SELECT doc_id, owner, rank, start, CASE rank WHEN 0 THEN regexp_extract(found, {_quoted(assign)}, 1) WHEN 4 THEN regexp_extract(found, '^[A-Za-z0-9+/_=-]+') ELSE found END AS value, length(found) AS n FROM p),
c AS (SELECT doc_id, owner, rank, start, start + CASE rank WHEN 4 THEN length(value) ELSE n END AS stop, value FROM v
 WHERE CASE rank WHEN 0 THEN length(value) >= 6 WHEN 4 THEN length(value) >= 20 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') ELSE true END),
e AS (SELECT * FROM c WHERE rank < 4 UNION ALL
 SELECT * FROM c o WHERE rank = 4 AND NOT EXISTS (SELECT 1 FROM c s WHERE s.rank < 4 AND s.doc_id = o.doc_id AND s.start < o.stop AND s.stop > o.start)),
h AS (SELECT value, count(DISTINCT coalesce('x' || owner, '')) AS owners FROM e GROUP BY value),
b AS (SELECT greatest({copied_owners}, ceil({copied_share}::DOUBLE * count(DISTINCT coalesce('x' || owner, '')))) AS breadth FROM d),
j AS (SELECT doc_id, rank, start, stop, kind, CASE WHEN owners >= (SELECT breadth FROM b) THEN 'copied' WHEN len(list_distinct(string_split(value, ''))) < {min_symbols} THEN 'placeholder' ELSE 'live' END AS status
 FROM e JOIN h USING (value) JOIN (VALUES {kinds}) k(rank, kind) USING (rank)),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
 count(*) FILTER (status = 'live') AS n_live, count(*) FILTER (status = 'copied') AS n_copied FROM j WHERE rank < 4 OR status = 'live' GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
 coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


def license_scan(least_share: float = 0.6) -> str:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    places = [(w, t, p) for t, (_, notice, _) in enumerate(licenses.TEMPLATES) for p, w in enumerate(notice.split()) if w not in licenses.COMMON]
    templates = [(t, label, f" {key} ") for t, (label, _, key) in enumerate(licenses.TEMPLATES)]
    starts = " ".join(f"WHEN [word, {', '.join(f'lead(word, {k}) OVER o' for k in range(1, len(p.split())))}] = {p.split()} THEN {_quoted(label)}" for p, label in licenses.PHRASES.items())
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
b AS (SELECT doc_id, pos, CASE {starts} END AS label FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM b WHERE label IS NOT NULL GROUP BY doc_id),
place(word, template, place) AS (VALUES {_rows(places)}), template(template, label, phrase) AS (VALUES {_rows(templates)}),
vocabulary AS (SELECT DISTINCT word FROM place),
hit AS (SELECT w.* FROM w JOIN vocabulary USING (word)),
idf AS (SELECT word, ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 0.01 AS idf FROM vocabulary LEFT JOIN (SELECT word, count(DISTINCT doc_id) AS df FROM hit GROUP BY word) USING (word)),
mass AS (SELECT template, sum(idf) AS mass FROM place JOIN idf USING (word) GROUP BY template),
lined AS (SELECT doc_id, template, pos - place AS off, sum(idf) AS got FROM hit JOIN idf USING (word) JOIN place USING (word) GROUP BY ALL),
scored AS (SELECT doc_id, template, least(1.0, max(got) / any_value(mass)) AS share FROM lined JOIN mass USING (template) GROUP BY doc_id, template),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM scored JOIN template USING (template) JOIN d USING (doc_id)
 WHERE share >= {least_share} AND contains(' ' || array_to_string(words, ' ') || ' ', phrase) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
 coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
 CASE WHEN base.n > 0 THEN 1.0 ELSE round(coalesce(share, 0.0), 6) END::DOUBLE AS score
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN more ON more.doc_id = d.doc_id"""


def decontaminate_() -> str:
    masks = _rows((k, *([j for j, bit in enumerate(m) if bit == "1"],)) for k, m in enumerate(decontaminate.MASKS))
    span, window = decontaminate.SPAN, decontaminate.WINDOW
    picked = lambda words, at: f"array_to_string(list_transform(ones, lambda o: {words}[{at} + o + 1]), ' ')"
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS toks FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS item FROM benchmark),
fixed(k, ones) AS (VALUES {masks}),
mask AS (SELECT k, ones, {span} AS span, false AS is_whole FROM fixed UNION ALL
 SELECT 100 + len(item), range(len(item)), len(item), true FROM b WHERE len(item) > 0 AND len(item) < {span} GROUP BY len(item)),
ds AS (SELECT doc_id, i, k, {picked("toks", "i")} AS seed FROM (SELECT doc_id, toks, unnest(range(len(toks))) AS i FROM d), mask WHERE i + span <= len(toks)),
bs AS (SELECT item_id, j, k, {picked("item", "j")} AS seed FROM (SELECT item_id, item, unnest(range(len(item))) AS j FROM b), mask WHERE j + span <= len(item) AND (NOT is_whole OR span = len(item))),
line AS (SELECT doc_id, item_id, i - j AS shift, count(*) AS hits FROM ds JOIN bs USING (k, seed) GROUP BY ALL),
part AS (SELECT line.*, toks, item, greatest(0, shift) AS low, least(len(toks), shift + len(item)) AS high FROM line JOIN d USING (doc_id) JOIN b USING (item_id)),
word AS (SELECT doc_id, item_id, shift, hits, least({window}, high - low) AS size, least({decontaminate.LEAST_WINDOW}, len(item)) AS least_size, unnest(range(low, high)) AS x, toks, item, low FROM part),
same AS (SELECT *, sum((toks[x + 1] = item[x - shift + 1])::INTEGER) OVER (PARTITION BY doc_id, item_id, shift ORDER BY x ROWS {window - 1} PRECEDING) AS n FROM word),
best AS (SELECT doc_id, item_id, shift, any_value(hits) AS hits, max(n)::DOUBLE / any_value(size) AS matched FROM same WHERE x - low + 1 >= size AND size >= least_size GROUP BY doc_id, item_id, shift)
SELECT doc_id, string_agg(item_id, ',' ORDER BY item_id) AS items, round(max(matched), 6) AS matched, sum(hits)::BIGINT AS hits
FROM (SELECT doc_id, item_id, max(matched) AS matched, sum(hits) AS hits FROM best WHERE matched >= {decontaminate.LEAST_SHARE} GROUP BY doc_id, item_id) GROUP BY doc_id"""


def jaccard_join() -> str:
    return r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN CASE WHEN len(w) = 0 THEN [] ELSE [array_to_string(w, ' ')] END ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM t),
k AS (SELECT min(doc_id) AS id, count(*) AS weight, len(any_value(s)) AS n, any_value(s) AS s FROM s GROUP BY array_to_string(s, '|')),
u AS (SELECT id, n, weight, unnest(s) AS x FROM k),
link AS (SELECT a.id AS a, b.id AS b, any_value(b.weight) AS weight FROM u a JOIN u b USING (x) WHERE a.id != b.id GROUP BY a.id, b.id HAVING 9 * count(*) >= 4 * (any_value(a.n) + any_value(b.n))),
reach AS (SELECT id AS a, id AS b FROM k UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
class AS (SELECT a AS id, min(b) AS class_id FROM reach GROUP BY a),
n AS (SELECT a AS id, sum(weight) AS links FROM link GROUP BY a)
SELECT s.doc_id, class_id, (weight - 1 + coalesce(links, 0))::BIGINT AS n_links
FROM s JOIN k ON array_to_string(k.s, '|') = array_to_string(s.s, '|') JOIN class USING (id) LEFT JOIN n USING (id)"""


def mix_targets() -> str:
    return r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
r AS (SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(3 * source_size) OVER b, 0))::DOUBLE / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER b, 0)) AS level, 3.0 * source_size / w AS room
 FROM w WINDOW b AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, room) AS level FROM r WHERE level <= room)
SELECT d.doc_id, d.size, r.source_size, round(least(3.0 * r.source_size, r.w * coalesce((SELECT level FROM f), 1e300)), 4)::DOUBLE AS target FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source"""


def media_payloads() -> str:
    return r"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS held FROM documents),
p AS (SELECT doc_id, octet_length(held)::BIGINT AS n, held, CASE WHEN octet_length(held) = 0 THEN 64 ELSE (64 - octet_length(held) % 64) % 64 END AS more FROM d)
SELECT doc_id, n AS n_bytes, n + more AS payload_bytes, sha256(held || repeat('\x00'::BLOB, more)) AS payload_sha256 FROM p"""


def _crc32(key: str) -> str:
    """crc32 of an id's digits: each character, then eight steps of the remainder."""
    steps = f"[4294967295::BIGINT] || flatten(list_transform(string_split({key}::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce({steps}, lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"


def lm_base() -> str:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    crc = _crc32("doc_id")
    return rf"""WITH d AS (SELECT doc_id, coalesce({crc} % 5 = 1, false) AS held_out, regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, held_out, unnest(words || [' ']) AS token FROM d),
c AS (SELECT token, count(*) AS n FROM t WHERE NOT held_out GROUP BY token),
a AS (SELECT coalesce(sum(n), 0)::BIGINT AS total, count(*) AS types FROM c)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(c.n)::BIGINT AS n_known, any_value(total)::BIGINT AS train_tokens, round(sum(log10((coalesce(c.n, 0) + 0.5::DOUBLE) / (total + 0.5::DOUBLE * (types + 1)))), 3) AS base_score
FROM t LEFT JOIN c USING (token), a GROUP BY doc_id, held_out"""


def chat_digests() -> str:
    said = _quoted("<|im_end|><|im_start|>assistant ok")
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', {said}), (-1, 1, 'assistant', {said}))
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM c GROUP BY conv_id"""


def prefix_trie() -> str:
    # A node is the list of its turns' digests.
    return f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
 md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM conversations),
own AS (SELECT conv_id, list(d ORDER BY pos) AS d, list(size ORDER BY pos) AS size FROM t GROUP BY conv_id),
h AS (SELECT own.*, coalesce({_crc32("conv_id")} % 9, 0) AS h FROM own),
conv AS (SELECT h.conv_id, coalesce(b.d[1:h], []) || h.d[h + 1:] AS d, coalesce(b.size[1:h], []) || h.size[h + 1:] AS size FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
pre AS (SELECT conv_id, len(d) AS turns, d[1:k] AS node, k AS depth, size[k] AS size FROM (SELECT *, unnest(range(len(d) + 1)) AS k FROM conv)),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*)::BIGINT AS n, any_value(size) AS size, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = depth), '') AS ends FROM pre GROUP BY node, depth),
kids AS (SELECT node[1:depth - 1] AS node, count(*)::BIGINT AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0)::BIGINT AS n_children FROM n LEFT JOIN kids ON kids.node = n.node),
up AS (SELECT node[1:k] AS node, n_children = 0 AS leaf, CASE WHEN depth > 0 THEN (n - 1) * size ELSE 0 END AS saved FROM (SELECT *, unnest(range(depth + 1)) AS k FROM f)),
s AS (SELECT node, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY node)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s ON s.node = f.node LEFT JOIN n p ON f.depth > 0 AND p.node = f.node[1:f.depth - 1]"""


def phrase_mining() -> str:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    least, longest, top = phrases.LEAST, phrases.LONGEST, phrases.TOP
    inner = "unnest(flatten(list_transform(range(2, len(w)), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1]))))"
    return rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '[.,;:!?
-
]')) AS piece FROM documents),
s AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM s GROUP BY lang),
g AS (SELECT lang, w[i:i + k - 1] AS w FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM s, range(1, {longest + 1}) x(k))),
f AS (SELECT lang, w, count(*)::BIGINT AS a FROM g GROUP BY lang, w HAVING count(*) >= {least}),
inside AS (SELECT lang, w, max(a) AS longer FROM (SELECT lang, {inner} AS w, a FROM f WHERE len(w) > 2) GROUP BY lang, w),
c AS (SELECT lang, w, a, unnest(range(1, len(w))) AS k FROM f LEFT JOIN inside USING (lang, w) WHERE len(w) > 1 AND NOT coalesce(100 * longer >= 100 * a, false)),
cut AS (SELECT c.*, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score FROM c JOIN n USING (lang) JOIN f l ON l.lang = c.lang AND l.w = c.w[1:k] JOIN f r ON r.lang = c.lang AND r.w = c.w[k + 1:]),
low AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score FROM low QUALIFY rank <= {top}"""


def near_vectors() -> str:
    good = "len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(x, lambda v: v != 0)) > 0"
    return f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT * FROM v WHERE {good}),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id != b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {neardup.LEVEL}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
class AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM class LEFT JOIN n USING (vec_id)"""


SQL = {
    "op1_secret_scan": secret_scan,
    "op5_decontaminate": decontaminate_,
    "op7_license_scan": license_scan,
    "op10_jaccard_join": jaccard_join,
    "op11_conversation_trie": prefix_trie,
    "op12_phrase_mining": phrase_mining,
    "op13_embedding_near_dup": near_vectors,
    "mix_targets": mix_targets,
    "media_payloads": media_payloads,
    "lm_base": lm_base,
    "chat_digests": chat_digests,
}
