"""DuckDB SQL of the numbered queries that SQL can express: all pairs and plain counts over the same tables."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Shingle sets as lists of distinct strings, all pairs through common shingles, reachability by recursion.
OP3 = f"""
WITH RECURSIVE worded AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM worded),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.e = b.e AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * shared >= 80 * (n + m - shared)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, (SELECT min(b) FROM reached WHERE a = s.doc_id)) AS component_id FROM sets s
"""

#: Lines of a document at their places; counts of distinct texts per host and normalised line.
OP5 = f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS same FROM documents),
worded AS (SELECT doc_id, {WORDS.format("text")} AS w FROM docs),
spots AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM worded),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM spots) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) t(k) GROUP BY doc_id),
split AS (SELECT doc_id, same, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM docs),
lines AS (SELECT *, {WORDS.format(LOWER.format("line"))} AS w FROM split),
normal AS (SELECT doc_id, same, source, line, place, len(w) AS n, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') END AS norm FROM lines),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM normal WHERE n > 0 GROUP BY doc_id),
hosts AS (SELECT source, greatest(5.0, count(DISTINCT same) * 0.005) AS most FROM docs GROUP BY source),
common AS (SELECT n.source, n.norm FROM normal n JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source WHERE n.n > 0
  GROUP BY n.source, n.norm, h.most HAVING count(DISTINCT n.same) > h.most),
marked AS (SELECT n.*, c.norm IS NOT NULL AS gone FROM normal n LEFT JOIN common c ON n.source IS NOT DISTINCT FROM c.source AND n.norm = c.norm),
left_over AS (SELECT doc_id, coalesce(sum(n) FILTER (WHERE gone), 0) AS removed, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS clean FROM marked GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(u.n, 0)::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, l.removed::BIGINT AS removed_words, l.clean
  FROM docs d JOIN worded w USING (doc_id) JOIN left_over l USING (doc_id) LEFT JOIN repeated r USING (doc_id) LEFT JOIN dups u USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
judged AS (SELECT *, NOT base_failed AND 100 * (n_words - removed_words) >= 30 * n_words AS kept FROM failed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed, kept, CASE WHEN kept THEN sha256(clean) END AS text_sha256 FROM judged
"""

#: All inner products.
OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x))
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored) WHERE rank <= 20
"""

#: Digests of the given pages; captures numbered within a URL key by page, as all have one timestamp.
OP10 = """
WITH sums AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sum, lower(trim(coalesce(url, ''))) AS url FROM pages),
bare AS (SELECT *, regexp_replace(split_part(url, '#', 1), '^.*?://', '') AS rest FROM sums),
parts AS (SELECT *, regexp_extract(rest, '^[^/?]*') AS whole, regexp_replace(rest, '^[^/?]*', '') AS path FROM bare),
hosts AS (SELECT *, split_part(regexp_replace(whole, '^.*@', ''), ':', 1) AS host, regexp_replace(regexp_extract(regexp_replace(whole, '^.*@', ''), ':.*$'), '^:(80|443)?$', '') AS port FROM parts),
labels AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS names FROM hosts),
keyed AS (SELECT *, array_to_string(list_reverse(CASE WHEN names[1] = 'www' THEN names[2:] ELSE names END), ',') || port || ')' || CASE WHEN path = '' THEN '/' ELSE path END AS urlkey FROM labels),
digits AS (SELECT *, list_transform(range(8), lambda g: ('0x' || sum[g * 5 + 1:g * 5 + 5])::BIGINT) AS five FROM keyed),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY sum) AS first, row_number() OVER (PARTITION BY urlkey ORDER BY page_id) AS capture FROM digits)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(five, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda b: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> b) & 31) + 1]), '')), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to, capture
FROM firsts
"""

#: Terms of documents and items, integer scores of all pairs that share one.
OP11 = f"""
WITH worded AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
spots AS (SELECT k, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM worded),
counted AS (SELECT k, doc_id, n, term, count(*)::BIGINT AS tf FROM spots GROUP BY k, doc_id, n, term),
sizes AS (SELECT count(*)::BIGINT AS all_docs, sum(len(w))::BIGINT AS all_terms FROM worded WHERE len(w) > 0),
asked AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all({LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wanted AS (SELECT DISTINCT item, item_id, unnest(w) AS term FROM asked),
held AS (SELECT term, count(*)::BIGINT AS df FROM counted WHERE term IN (SELECT term FROM wanted) GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM held, sizes),
posted AS (SELECT k, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * all_docs) // all_terms))) AS s FROM counted JOIN weights USING (term), sizes),
summed AS (SELECT item, item_id, k, doc_id, sum(s)::BIGINT AS score FROM wanted JOIN posted USING (term) GROUP BY item, item_id, k, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM summed WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""

#: crc32 of each distinct word by its table; gains of buckets; noise from sha256; the rank over all eligible rows.
OP13 = f"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
texts AS (SELECT 's' AS part, row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT 't', NULL, NULL, text FROM benchmark),
worded AS (SELECT part, k, doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM texts),
spots AS (SELECT part, k, unnest(w) AS word FROM worded),
words AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM spots),
hashed AS (SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM words, steps),
counts AS (SELECT bucket, count(*) FILTER (WHERE part = 's')::BIGINT AS s, count(*) FILTER (WHERE part = 't')::BIGINT AS t FROM spots JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT sum(s)::BIGINT AS all_s, sum(t)::BIGINT AS all_t FROM counts),
gained AS (SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000))::DOUBLE / ((s + 1) * (all_t + 10000))::DOUBLE))::BIGINT AS gain FROM counts, sums),
added AS (SELECT k, sum(gain)::BIGINT AS total FROM spots JOIN hashed USING (word) JOIN gained USING (bucket) WHERE part = 's' GROUP BY k),
weighed AS (SELECT doc_id, len(w)::BIGINT AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END::BIGINT AS weight,
  ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM worded LEFT JOIN added USING (k) WHERE part = 's'),
scored AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM weighed),
drawn AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM drawn
"""

SQL = {"op11_lexical_search": OP11, "op13_importance_resampling": OP13, "op3_jaccard_join": OP3, "op5_line_quality": OP5, "op7_exact_top_k": OP7, "op10_warc": OP10}
