"""The same results as SQL, for the operators that SQL can express."""

from postmill.llm import licenses

WARC_INDEX = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
    d AS (SELECT page_id, strlen(h) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(0, 32)], '') AS payload_digest FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""

JACCARD = r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g FROM w),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
    reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
    SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, min(y)) AS component_id
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON x = w.doc_id GROUP BY w.doc_id"""

SUFFIX_DEDUP = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    l AS (SELECT doc_id, unnest([{'i': i, 'byte': substr(h, 2 * i + 1, 2), 's': CASE WHEN 2 * i + 100 <= length(h) THEN hash(substr(h, 2 * i + 1, 100)) END}
          FOR i IN range(0, length(h) // 2)]) AS x FROM d),
    b AS MATERIALIZED (SELECT doc_id, x.i AS i, x.byte AS byte, x.s AS s FROM l),
    f AS (SELECT s, min(doc_id) AS first FROM b WHERE s IS NOT NULL GROUP BY s),
    m AS (SELECT b.doc_id, i, byte, CASE WHEN first < b.doc_id THEN 1 ELSE 0 END AS hit FROM b LEFT JOIN f USING (s)),
    g AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
    e AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g)
    SELECT d.doc_id, any_value(length(h) // 2) AS n_bytes, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed, count(*) FILTER (WHERE gone = 1 AND before = 0) AS n_spans,
           sha256(from_hex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0), ''))) AS kept_sha256
    FROM d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id"""


FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


def bond_negatives() -> str:
    return f"""
    WITH r AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {FINITE}),
    s AS MATERIALIZED (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same,
        CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.id) AS INTEGER) AS rank,
           s.id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3"""


def bitplane_clusters(rounds: int = 10, k: int = 8) -> str:
    """Every round of assignment and of means as two tables of the statement."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
    a{i} AS MATERIALIZED (SELECT v.n, v.vec_id, v.v, c.cluster, CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
        FROM v CROSS JOIN c{i} c QUALIFY row_number() OVER (PARTITION BY v.n ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            steps.append(f"""
    m{i} AS (SELECT cluster, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, 65) t(j) GROUP BY ALL),
    l{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM m{i} GROUP BY cluster),
    c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(l.v, c.v) AS v FROM c{i} c LEFT JOIN l{i} l USING (cluster))""")
    return f"""
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = 64 AND {FINITE}),
    c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS INTEGER) AS cluster, v FROM v QUALIFY cluster < {k}),{",".join(steps)}
    SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""


def diagonal_licenses() -> str:
    """Grams are compared as words; votes, merging and cover as in the operator."""
    k, slack, least, cover = licenses.GRAM, licenses.SLACK, licenses.VOTES, licenses.COVER
    templates = [(label, t, True) for label, t in licenses.PHRASES] + [(label, t, False) for label, t in licenses.NOTICES]
    values = ", ".join(f"({t}, '{label}', {exact}, {words}, {p}, '{gram}')" for t, label, exact, words, p, _, gram in licenses.template_rows(templates, k))
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
    WITH t(template, label, exact, words, place, gram) AS (VALUES {values}),
    d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array({lowered}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
    g AS (SELECT doc_id, unnest(list_transform(range(0, len(ws) - {k - 1}), lambda i: {{'pos': i, 'gram': array_to_string(ws[i + 1:i + {k}], ' ')}})) AS x FROM d WHERE len(ws) >= {k}),
    h AS (SELECT doc_id, template, label, exact, words, place, x.pos AS pos, x.pos - place AS diagonal,
          count(*) OVER (PARTITION BY doc_id, template, x.pos - place) AS votes FROM g JOIN t ON x.gram = t.gram),
    e AS (SELECT doc_id, label, exact, pos AS first_word, CAST(1 AS DOUBLE) AS score FROM h WHERE exact AND place = 0 AND votes = words - {k - 1}),
    f AS (SELECT *, max(votes) OVER (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN {slack} PRECEDING AND {slack} FOLLOWING) AS strong FROM h WHERE NOT exact),
    a AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= least({slack}, words // 2) THEN 0 ELSE 1 END AS apart
          FROM f WHERE strong >= least({least}, words - {k - 1}) WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal, place)),
    m AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal, place ROWS UNBOUNDED PRECEDING) AS span FROM a),
    c AS (SELECT doc_id, template, label, words, span, count(DISTINCT place + i) AS n, min(pos) AS low, max(pos) + {k} AS high
          FROM m, range(0, {k}) r(i) GROUP BY doc_id, template, label, words, span),
    s AS (SELECT * FROM e UNION ALL SELECT doc_id, label, false, low, n / greatest(words, high - low) FROM c WHERE n / greatest(words, high - low) >= {cover}),
    p AS (SELECT doc_id, count(*) FILTER (WHERE exact) AS n_base, min(first_word) FILTER (WHERE exact) AS first_word, max(first_word) FILTER (WHERE exact) AS last_word,
          string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
          FROM s GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN p USING (doc_id)"""
