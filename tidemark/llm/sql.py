"""DuckDB SQL of the queries that SQL can express."""

URL_SQL = r"""
WITH rules(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
    ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
hosts AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
parsed AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM hosts)
SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule,
    coalesce(arg_max(rules.verdict, length(rh || rp)), CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
GROUP BY page_id, host, path
"""

MIXTURE_SQL = r"""
WITH sized AS (SELECT doc_id, source, md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS draw,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size,
    (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::BIGINT AS weight FROM sized GROUP BY source),
filled AS (SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER below, 0) AS capped, sum(weight) OVER upward AS free
  FROM src WINDOW below AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    upward AS (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
-- The first source, by cap per weight, that its share does not fill: all before it stand at their caps.
levels AS (SELECT arg_min((total - capped)::DOUBLE, source_size / weight) AS num, arg_min(free::DOUBLE, source_size / weight) AS den
  FROM filled WHERE 3 * source_size * free > weight * (total - capped)),
plan AS (SELECT source, source_size, least(3.0 * source_size, num * weight / den)::DOUBLE AS target FROM src, levels),
cuts AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM plan),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized)
SELECT doc_id, size, source_size, round(target, 6) AS target,
    (whole * size + greatest(0, least(size, round(target)::BIGINT - whole * source_size - before)))::BIGINT AS taken
FROM placed JOIN cuts ON placed.source IS NOT DISTINCT FROM cuts.source
"""

CONTAINMENT_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
    FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
    FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
    FROM (SELECT item_id, w, least(len(w), 5) AS n, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
ds AS (SELECT DISTINCT doc_id, n, s FROM (SELECT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bs) WHERE len(w) >= n))
    WHERE s IN (SELECT s FROM bs))
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM ds JOIN bs USING (n, s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) + 1e-9 >= 0.8 * any_value(n_item)
"""

#: CRC-32 by the recurrence over bytes, with its table made by rule; a word is hashed once however often it occurs.
RESAMPLING_SQL = r"""
WITH steps AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM steps),
split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
occ AS (SELECT doc_id, unnest(w) AS word FROM split),
words AS (SELECT DISTINCT word FROM (SELECT word FROM occ UNION ALL SELECT word FROM item)),
coded AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(word))),
    lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM words, tab),
s AS (SELECT bucket, count(*) AS n FROM occ JOIN coded USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM item JOIN coded USING (word) GROUP BY bucket),
gain AS (SELECT coded.bucket, floor(1000 * ln((coalesce(any_value(t.n), 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
    / ((any_value(s.n) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS g
    FROM coded JOIN s USING (bucket) LEFT JOIN t USING (bucket) GROUP BY coded.bucket),
summed AS (SELECT doc_id, sum(g)::BIGINT AS total FROM occ JOIN coded USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT split.doc_id, len(w)::BIGINT AS n_features,
    CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || split.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS noise
    FROM split LEFT JOIN summed ON split.doc_id = summed.doc_id),
placed AS (SELECT *, weight + noise AS score, n_features >= 20 AS fit FROM scored),
ordered AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY fit) AS n FROM placed)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= n * 10 // 100 THEN place END::BIGINT AS rank FROM ordered
"""


def component_sql(width: int, percent: int, kept: bool = False) -> str:
    """Components of documents whose word shingles are similar, by comparing all pairs that share one."""
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ 	-]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), {width}) - 1], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width} + 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
    JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
    WHERE 100 * least(nx.n, ny.n) >= {percent} * greatest(nx.n, ny.n)
    GROUP BY 1, 2 HAVING 100 * count(*) >= {percent} * (any_value(nx.n) + any_value(ny.n) - count(*))),
reached(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reached.b) AS component_id{", d.doc_id = min(reached.b) AS kept" if kept else ""}
FROM d JOIN reached ON reached.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def _codes_sql(parts: int = 4, rounds: int = 4, entries: int = 256) -> str:
    """Rounds of k-means per part, comparing every part with every entry."""
    out = [rf"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024::DOUBLE * x)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, q AS part, x[q * (len(x) // {parts}) + 1:(q + 1) * (len(x) // {parts})] AS x FROM v, range({parts}) AS r(q)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS e FROM p
    WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))"""]
    for i in range(rounds + 1):
        out.append(rf""",
a{i} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (SELECT vec_id, p.part, entry,
    list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far FROM p JOIN c{i} ON p.part = c{i}.part)
    GROUP BY vec_id, part)""")
        if i < rounds:
            out.append(rf""",
m{i} AS MATERIALIZED (SELECT part, entry, list((total - ((total % n) + n) % n) // n ORDER BY place) AS e FROM (SELECT part, entry, place,
    sum(value)::BIGINT AS total, count(*) AS n FROM (SELECT a{i}.part, entry, unnest(x) AS value, unnest(range(len(x))) AS place
    FROM a{i} JOIN p USING (vec_id, part)) GROUP BY part, entry, place) GROUP BY part, entry),
c{i + 1} AS MATERIALIZED (SELECT c{i}.part, c{i}.entry, coalesce(m{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN m{i} USING (part, entry))""")
    out.append(rf""",
coded AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS digest FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256
FROM coded JOIN v USING (vec_id), books""")
    return "".join(out)


CODES_SQL = _codes_sql()
