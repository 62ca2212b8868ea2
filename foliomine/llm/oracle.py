"""DuckDB SQL of the operators' queries, where SQL can express them."""

ORACLES = {}

# The hostile conversation comes back unchanged. Only its turns are escaped (its two
# control strings and its backslash take one more character each), any other text of
# the supplied table holds no control string, backslash or mark.
ORACLES["op9_chat_format"] = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES
        (-7, 0, 'user', '\### Assistant: </turn> ok'),
        (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), said AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(length('### ' || role || ': ' || text || '</turn>') + 1
            + CASE WHEN contains(text, '\### Assistant: </turn>') THEN 3 ELSE 0 END) AS formatted_chars
    FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
    sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM said
"""

ORACLES["op2_decontamination"] = r"""
WITH texts AS (
    SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL
    UNION ALL SELECT 'i', item_id, text FROM benchmark WHERE item_id IS NOT NULL
), split AS (
    SELECT kind, id,
        list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words
    FROM texts
), items AS (
    SELECT id, least(len(words), 5) AS k, words FROM split WHERE kind = 'i' AND len(words) > 0
), texts_of_size AS (
    SELECT 'i' AS kind, id, k, words FROM items
    UNION ALL SELECT 'd', id, k, words FROM split, (SELECT DISTINCT k FROM items) WHERE kind = 'd' AND len(words) >= k
), shingles AS (
    SELECT DISTINCT kind, id, k,
        unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i+k-1], ' '))) AS s
    FROM texts_of_size
), counted AS (
    SELECT id, k, s, count(*) OVER (PARTITION BY id) AS n_item FROM shingles WHERE kind = 'i'
)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n_item) AS n_item, count(*) AS n_common
FROM shingles d JOIN counted i USING (k, s) WHERE d.kind = 'd'
GROUP BY ALL HAVING 100 * count(*) >= 80 * any_value(n_item)
"""

ORACLES["op8_near_duplicates"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents WHERE text IS NOT NULL
), sets AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM sets a JOIN sets b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT reach.a, l.b
    FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON reach.b = l.a
), smallest AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN smallest USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

ORACLES["op12_source_audit"] = r"""
WITH rows AS (
    SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
        coalesce(source, '') AS source
    FROM documents
), said AS (
    SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM rows
), kept AS (
    SELECT lang, term, count(*) AS n FROM said GROUP BY ALL HAVING count(DISTINCT row) >= 30
), sizes AS (
    SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), groups AS (
    SELECT DISTINCT lang, source FROM rows
), own AS (
    SELECT lang, source, term, count(*) AS n FROM said SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
    SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL
), shares AS (
    SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
        1 + 1000000000::HUGEINT * (coalesce(o.n, 0) + 5) // (coalesce(t.total, 0) + 5 * s.v) AS p,
        1 + 1000000000::HUGEINT * (k.n + 5) // (s.total + 5 * s.v) AS q
    FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang)
    LEFT JOIN own o USING (lang, source, term) LEFT JOIN totals t USING (lang, source)
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    GROUP BY ALL
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 50
"""


def _clustering(rounds: int) -> str:
    """Rounds of assignments and of new centroids, one after the other."""

    def assignment(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (
    SELECT row, vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) ** 2))::BIGINT AS d
    FROM vectors, c{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, k) = 1
)"""

    def update(r: int) -> str:
        return f"""s{r} AS (
    SELECT k, i, sum(x) AS s, count(*) AS n
    FROM (SELECT k, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY ALL
), c{r + 1} AS MATERIALIZED (
    SELECT k, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN (
        SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{r} GROUP BY k
    ) m USING (k)
)"""

    steps = [x for r in range(rounds) for x in (assignment(r), update(r))]
    return f"""
WITH vectors AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id,
        list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k, v AS c
    FROM vectors QUALIFY k < 8
), {", ".join([*steps, assignment(rounds)])}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia,
    sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)
"""


ORACLES["op13_centroids"] = _clustering(10)
