"""DuckDB texts of the registered queries, where SQL can express them and runs on whole tables."""

WORDS = r"[^\x20\x09-\x0D]+"

MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size,
         concat_ws(':', coalesce(doc_id::VARCHAR, ''), coalesce('=' || source, '-'), md5(coalesce(text, '')), '') AS draw_key
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY draw_key) AS nth FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
         [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::BIGINT AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (150 * sum(source_size) OVER () - 100 * coalesce(sum(cap) OVER before, 0))::DOUBLE
            / (100 * (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)))::DOUBLE AS level
  FROM sources
  WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), common AS (
  SELECT min_by(level, row(cap::DOUBLE / weight, source IS NULL, source)) AS level FROM levels WHERE level * weight <= cap
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(common.level * weight, cap::DOUBLE)) AS target
  FROM levels, common
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
), drawn AS (
  SELECT doc_id, size, source_size, target, rate,
         ('0x' || substr(md5('8:' || draw_key || ':' || nth), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS draw
  FROM numbered JOIN rates ON numbered.source IS NOT DISTINCT FROM rates.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn
"""

LEAK_WORDS = r"""list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

DECONTAMINATION = f"""
WITH docs AS (
  SELECT doc_id, coalesce({LEAK_WORDS}, []) AS words FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, {LEAK_WORDS} AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(words), 13) AS size, array_to_string(words[i:i + least(len(words), 13) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM items WHERE len(words) > 0)
), starts AS (
  SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)
), hits AS (
  SELECT doc_id, size, i, item FROM starts JOIN windows USING (size, win)
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _merkle(arity: int = 16, levels: int = 8) -> str:
    """Trees of up to 16^8 leaves: `levels` rounds, each of which leaves finished trees as they are."""
    fields = ", ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # DuckDB has no crc32: a table of its 256 steps, folded over the id's digits.
    steps = "SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) t(i)"
    parts = [f"""WITH steps AS ({steps}), crc AS (SELECT list(v ORDER BY i) AS t FROM steps), leaves AS (
  SELECT doc_id, source, sha256(concat({fields})) AS leaf,
    xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda d: ascii(d)::BIGINT),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 5 = 0 AS hit,
    sha256(concat({fields.replace("text::", lower + "::")})) AS changed
  FROM documents, crc
), t0 AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    CASE WHEN hit THEN changed ELSE leaf END AS folded, '' AS proof FROM leaves
), n0 AS (SELECT tree, place, leaf AS digest FROM t0)"""]

    def rounds(t: str, n: str, tree: str, place: str) -> str:
        for k in range(levels):
            parts.append(f"""{n}{k}s AS (SELECT *, count(*) OVER (PARTITION BY tree) AS size FROM {n}{k}),
{n}{k}r AS (SELECT tree, place // {arity} AS run, max(size) AS size, list(digest ORDER BY place) AS l FROM {n}{k}s GROUP BY 1, 2),
{n}{k + 1} AS MATERIALIZED (SELECT tree, run AS place, CASE WHEN size = 1 THEN l[1] ELSE sha256(array_to_string(l, '')) END AS digest FROM {n}{k}r),
{t}{k + 1} AS MATERIALIZED (SELECT t.* EXCLUDE (folded, proof, {place}), t.{place} // {arity} AS {place},
  proof || array_to_string(l[1:{place} % {arity}] || l[{place} % {arity} + 2:], '') AS proof,
  CASE WHEN size = 1 THEN folded ELSE sha256(array_to_string(l[1:{place} % {arity}] || [folded] || l[{place} % {arity} + 2:], '')) END AS folded
  FROM {t}{k} t JOIN {n}{k}r r ON t.{tree} = r.tree AND t.{place} // {arity} = r.run)""")
        return f"{t}{levels}"

    last = rounds("t", "n", "tree", "place")
    parts.append(f"subroots AS (SELECT tree, digest FROM n{levels})")
    parts.append(f"u0 AS (SELECT s.*, tree AS top_place, 0 AS top, digest AS subroot FROM {last} s JOIN subroots USING (tree))")
    parts.append("m0 AS (SELECT 0 AS tree, tree AS place, digest FROM subroots)")
    last = rounds("u", "m", "top", "top_place")
    return ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified
FROM {last} JOIN m{levels} ON true"""


MERKLE = _merkle()


def _codes(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Every part against every entry. All numbers are whole and far below 2^53, so doubles are exact."""
    out = [f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) t(p)
), b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})
)"""]
    for k in range(rounds + 1):
        out.append(f"""a{k} AS MATERIALIZED (
  SELECT vec_id, p, min(row(list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), e)) AS best
  FROM parts JOIN b{k} USING (p) GROUP BY vec_id, p)""")
        if k < rounds:
            out.append(f"""m{k} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i)::DOUBLE[] AS c FROM (
    SELECT p, e, i, sum(value)::BIGINT AS s, count(*) AS n FROM (
      SELECT p, best[2] AS e, unnest(range(len(x))) AS i, unnest(x)::BIGINT AS value FROM a{k} JOIN parts USING (vec_id, p))
    GROUP BY p, e, i) GROUP BY p, e
), b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))""")
    return ",\n".join(out) + f""", coded AS (
  SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(list_aggregate(c::BIGINT[], 'string_agg', ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


VECTOR_CODES = _codes()
