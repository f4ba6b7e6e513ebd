"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

WORDS = r"len(regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+'))"

# The letters of base32, five bits each; and the table of the CRC-32 polynomial.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def crc_table() -> list[int]:
    out = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def base32(digest: str) -> str:
    """Base32 of a SHA-1 in hexadecimal: eight times five digits, four letters each."""
    part = f"('0x' || substr({digest}, 5 * i + 1, 5))::BIGINT"
    letters = " || ".join(f"substr('{BASE32}', CAST(({part} >> {shift}) & 31 AS BIGINT) + 1, 1)" for shift in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range(0, 8), lambda i: {letters}), '')"


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text; ``crc_table`` is a column of the query."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    step = "xor(a >> 8, list_extract(crc_table, (xor(a, b) & 255) + 1))"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: {step}))"


def secrets_sql() -> str:
    """Every rule's leftmost matches, placed by the lengths of the pieces before them."""
    from .secrets import BASE_KINDS, RULES

    def quoted(pattern):
        return "'" + pattern.replace("'", "''") + "'"

    found = " UNION ALL ".join(
        f"SELECT rid, '{r.kind}' AS kind, {rank} AS rnk, {r.min_len} AS least, "
        f"regexp_extract_all(t, {quoted(r.pattern)}, 0) AS whole, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS val, "
        f"string_split_regex(t, {quoted(r.pattern)}) AS gaps FROM d WHERE regexp_matches(t, {quoted(r.pattern)})"
        for rank, r in enumerate(RULES)
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    outs = ", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in BASE_KINDS)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
    m AS ({found}),
    e AS (SELECT rid, kind, rnk, least, whole, val, gaps, unnest(range(1, len(whole) + 1)) AS k FROM m),
    p AS (SELECT rid, kind, rnk, least, length(val[k]) AS vlen, length(whole[k]) AS mlen,
                 sum(length(gaps[k]) + length(whole[k])) OVER (PARTITION BY rid, rnk ORDER BY k) AS stop FROM e),
    s AS (SELECT rid, kind, rnk, stop - mlen AS start, stop FROM p WHERE vlen >= least),
    a AS (SELECT rid, {counts}, count(*) AS n_spans,
                 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rnk) AS spans,
                 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rnk) FILTER (WHERE rnk < {len(BASE_KINDS)}) AS base
          FROM s GROUP BY rid)
    SELECT d.doc_id, {outs}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
           CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans
    FROM d LEFT JOIN a USING (rid)
    """


def codebooks_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Plain k-means of every part position: all parts against all entries of their position."""
    rounds_sql = []
    for r in range(rounds):
        rounds_sql.append(f"""
    a{r} AS (SELECT p.rid, p.part, arg_min(b.entry, b.entry + {entries} * list_sum(list_transform(range(1, w + 1),
                 lambda i: (p.pv[i] - b.c[i]) * (p.pv[i] - b.c[i])))) AS entry
             FROM p JOIN b{r} b ON p.part = b.part GROUP BY p.rid, p.part),
    s{r} AS (SELECT a.part, a.entry, i, CAST(floor(sum(p.pv[i]) / count(*)) AS BIGINT) AS val
             FROM a{r} a JOIN p ON a.rid = p.rid AND a.part = p.part, range(1, (SELECT w FROM dims) + 1) t(i)
             GROUP BY a.part, a.entry, i),
    b{r + 1} AS (SELECT b.part, b.entry, coalesce(
                     (SELECT list(s.val ORDER BY s.i) FROM s{r} s WHERE s.part = b.part AND s.entry = b.entry), b.c) AS c
             FROM b{r} b),""")
    last = f"b{rounds}"
    return f"""
    WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
               FROM embeddings
               WHERE embedding IS NOT NULL
                 AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
    firsts AS (SELECT v FROM k ORDER BY vec_id NULLS LAST, v LIMIT {entries}),
    dims AS (SELECT len(v) AS d, len(v) // {parts} AS w FROM firsts LIMIT 1),
    kept AS (SELECT row_number() OVER () AS rid, vec_id, label, v FROM k, dims WHERE len(v) = dims.d),
    p AS (SELECT rid, part, list_slice(v, part * w + 1, part * w + w) AS pv, w
          FROM kept, dims, range(0, {parts}) t(part)),
    e AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry, v
          FROM (SELECT vec_id, v FROM k ORDER BY vec_id NULLS LAST, v LIMIT {entries})),
    b0 AS (SELECT part, entry, list_slice(v, part * w + 1, part * w + w) AS c FROM e, dims, range(0, {parts}) t(part)),
    {"".join(rounds_sql)}
    fin AS (SELECT p.rid, p.part, arg_min(b.entry, b.entry + {entries} * list_sum(list_transform(range(1, w + 1),
                lambda i: (p.pv[i] - b.c[i]) * (p.pv[i] - b.c[i])))) AS entry,
                min(list_sum(list_transform(range(1, w + 1), lambda i: (p.pv[i] - b.c[i]) * (p.pv[i] - b.c[i])))) AS dist
            FROM p JOIN {last} b ON p.part = b.part GROUP BY p.rid, p.part),
    per AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error
            FROM fin GROUP BY rid),
    book AS (SELECT sha256(coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, i), '')) AS h
             FROM (SELECT part, entry, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM {last}))
    SELECT kept.vec_id, per.code, per.error,
           CAST(sum(per.error) OVER (PARTITION BY kept.label) AS BIGINT) AS label_error, book.h AS codebooks_sha256
    FROM kept JOIN per USING (rid), book
    """


ORACLES: dict[str, str] = {
    "op1_warc_dictionary": f"""
    WITH same AS (
        SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response_id
        FROM pages),
    digests AS (SELECT *, sha1(payload) AS sha FROM same)
    SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {base32("sha")} AS payload_digest,
        CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> response_id THEN response_id END AS refers_to
    FROM digests
    """,
    "op2_host_rules": r"""
    WITH docs AS (
        SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
        FROM documents),
    windows AS (
        SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS shown
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM docs)),
    repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, shown) > 1),
    covered AS (
        SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated CROSS JOIN range(0, 5) AS t(k) GROUP BY doc_id),
    measured AS (
        SELECT d.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
            CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
            CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
            coalesce(c.n, 0) AS n_repeat_words
        FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id),
    judged AS (
        SELECT doc_id, source, n_words, word_chars, n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
            CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
            n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed
        FROM measured),
    hosts AS (
        SELECT source, count(*) AS n,
            count(*) FILTER (WHERE base_failed OR n_symbols * 100 > word_chars * 10 OR n_dup_lines * 100 > n_lines * 30) AS failed
        FROM judged WHERE source IS NOT NULL GROUP BY source),
    sums AS (
        SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(failed) AS DOUBLE) / sum(n) AS mean, count(*) AS hosts,
            sum(CAST(failed AS DOUBLE) * failed / n) AS squares FROM hosts),
    spread AS (SELECT *, mean * (1 - mean) AS one, squares / n - mean * mean - mean * (1 - mean) * (hosts - 1) / n AS two FROM sums),
    prior AS (SELECT mean, CASE WHEN two > 0 AND one > 0 THEN least(n, one / two) ELSE n END AS weight FROM spread),
    rates AS (SELECT source, (failed + mean * weight) / (n + weight) AS host_rate FROM hosts CROSS JOIN prior)
    SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
        round(host_rate, 6) AS host_rate, NOT base_failed AND coalesce(host_rate <= 0.5, true) AS kept
    FROM judged j LEFT JOIN rates r ON j.source = r.source
    """,
    "op6_jump_sharding": f"""
    WITH RECURSIVE steps AS (
        SELECT doc_id, n, CASE WHEN doc_id < 0 THEN CAST(doc_id AS HUGEINT) + 18446744073709551616 ELSE CAST(doc_id AS HUGEINT) END AS state,
            CAST(-1 AS BIGINT) AS bucket, CAST(0 AS BIGINT) AS ahead
        FROM documents CROSS JOIN (VALUES (8), (9)) AS s(n)
        UNION ALL
        SELECT doc_id, n, state, ahead,
            CAST(floor((ahead + 1) * (2147483648.0::DOUBLE / CAST(state // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
        FROM (SELECT doc_id, n, ahead, (state * 2862933555777941757 + 1) % 18446744073709551616 AS state FROM steps WHERE ahead < n)),
    placed AS (
        SELECT doc_id, CAST(max(bucket) FILTER (WHERE n = 8) AS INTEGER) AS shard,
            CAST(max(bucket) FILTER (WHERE n = 9) AS INTEGER) AS grown_shard
        FROM steps WHERE ahead >= n GROUP BY doc_id),
    sized AS (
        SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {crc32("coalesce(text, '')")} AS text_crc32
        FROM documents CROSS JOIN (SELECT {crc_table()}::BIGINT[] AS crc_table))
    SELECT doc_id, size, text_crc32, 'key' AS law, shard,
        row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
    FROM sized JOIN placed USING (doc_id)
    """,
    "op7_cover_suffixes": """
    WITH coded AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
    strings AS (
        SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM coded)),
    later AS (SELECT doc_id, i FROM strings QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
    begun AS (
        SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM later),
    numbered AS (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM begun),
    spans AS (SELECT doc_id, span, min(i) AS start, max(i) + 100 AS stop FROM numbered GROUP BY doc_id, span),
    pieces AS (
        SELECT s.doc_id, start, stop,
            substr(h, 2 * coalesce(lag(stop) OVER before, 0) + 1, 2 * (start - coalesce(lag(stop) OVER before, 0))) AS piece, h, n
        FROM spans s JOIN coded c ON s.doc_id = c.doc_id
        WINDOW before AS (PARTITION BY s.doc_id ORDER BY start)),
    joined AS (
        SELECT doc_id, sum(stop - start) AS n_removed, count(*) AS n_spans,
            string_agg(piece, '' ORDER BY start) || substr(any_value(h), 2 * max(stop) + 1) AS kept
        FROM pieces GROUP BY doc_id)
    SELECT c.doc_id, CAST(c.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
        CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
    FROM coded c LEFT JOIN joined j ON c.doc_id = j.doc_id
    """,
    "op9_curriculum_mix": f"""
    WITH sized AS (
        SELECT doc_id, source, CAST({WORDS.format(text="text")} AS BIGINT) AS size,
               coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS ord
        FROM documents),
    sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    ranked AS (
        SELECT source, source_size, 3.0::DOUBLE * source_size AS lim,
               row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk,
               CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                   WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
        FROM sums),
    leveled AS (
        SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
               lim / weight < (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(lim) OVER before, 0))
                   / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS is_cut
        FROM ranked
        WINDOW before AS (ORDER BY lim / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    aims AS (
        SELECT source, source_size, weight,
               CASE WHEN is_cut THEN lim ELSE
                   (total - sum(CASE WHEN is_cut THEN lim ELSE 0 END) OVER ())
                   / sum(CASE WHEN NOT is_cut THEN weight END) OVER () * weight END AS target
        FROM leveled),
    begun AS (
        SELECT *, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id, size
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
        FROM sized),
    counted AS (
        SELECT b.doc_id, b.size, a.source_size, a.target, a.weight,
               CAST(b.start + b.size / 2.0::DOUBLE <= a.target AS INTEGER)
             + CAST(a.source_size + b.start + b.size / 2.0::DOUBLE <= a.target AS INTEGER)
             + CAST(2 * a.source_size + b.start + b.size / 2.0::DOUBLE <= a.target AS INTEGER) AS passes,
               CASE WHEN a.target > 0 THEN (b.start + b.size / 2.0::DOUBLE) * (1.0::DOUBLE / a.target)
                    ELSE 0.0::DOUBLE END AS u
        FROM begun b JOIN aims a ON b.source IS NOT DISTINCT FROM a.source)
    SELECT doc_id, size, source_size, target, CAST(passes * size AS BIGINT) AS taken, passes,
        CASE WHEN passes = 0 THEN NULL
             WHEN weight = 5 THEN CASE
                 WHEN u <= 0.375 THEN least(u * 2 / (0.5 + sqrt(0.25 + u * 2)), 0.5)
                 ELSE least(greatest(u - 0.375, 0) * 2 / (1 + sqrt(1 + greatest(u - 0.375, 0) * 2)), 0.5) + 0.5 END
             WHEN weight = 2 THEN least(u * 2 / (1 + sqrt(1.0)), 1.0)
             ELSE CASE
                 WHEN u <= 0.625 THEN least(u * 2 / (1.5 + sqrt(greatest(2.25 - u * 2, 0))), 0.5)
                 ELSE least(greatest(u - 0.625, 0) * 2 / (1 + sqrt(greatest(1 - greatest(u - 0.625, 0) * 2, 0))), 0.5)
                      + 0.5 END
        END AS position
    FROM counted
    """,
    "op11_trigram_secrets": secrets_sql(),
    "op12_hilbert_codebooks": codebooks_sql(),
    "op13_cover_negatives": r"""
    WITH r AS (
        SELECT row_number() OVER () AS rid, vec_id,
               CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
    a AS (SELECT * FROM r WHERE vec_id % 100 = 0),
    s AS (
        SELECT a.rid AS arid, a.vec_id AS aid, a.label AS alab, o.rid AS orid, o.vec_id AS oid, o.label AS olab,
               CAST(list_sum(list_transform(range(1, least(len(a.v), len(o.v)) + 1), lambda i: a.v[i] * o.v[i])) AS BIGINT)
                   AS score
        FROM a, r o),
    p AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, oid ASC NULLS LAST, orid) AS k
            FROM s WHERE olab = alab AND orid <> arid)
        WHERE k <= 5),
    n AS (
        SELECT p.aid, p.oid AS pid, p.score AS ps, s.oid AS nid, s.score AS ns,
               row_number() OVER (PARTITION BY p.arid, p.orid ORDER BY s.score DESC, s.oid ASC NULLS LAST, s.orid) AS rank
        FROM p JOIN s ON s.arid = p.arid AND s.olab <> p.alab AND 80 * p.score <= 100 * s.score
                     AND 100 * s.score <= 100 * p.score)
    SELECT aid AS anchor_id, pid AS positive_id, CAST(rank AS INTEGER) AS rank, nid AS negative_id,
           ps AS positive_score, ns AS negative_score
    FROM n WHERE rank <= 5
    """,
}
