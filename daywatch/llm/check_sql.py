"""The registered queries in DuckDB SQL."""

from __future__ import annotations

from daywatch.llm import quality

SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def url_filters(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"({text(h)}, {text(p)}, {text(v)})" for h, p, v in rules)
    return f"""
WITH rules(rh, rp, rv) AS (VALUES {values}),
parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
best AS (
  SELECT host, path, arg_max({{'rule': rh || rp, 'verdict': rv}}, length(rh) + length(rp) + length(rh) / 100000.0) AS b
  FROM (SELECT DISTINCT host, path FROM parts) p
  JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY host, path)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (host, path)
"""


EXACT_DEDUP = f"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '{SPACE_CLASS}', '', 'g') AS norm FROM documents),
ranked AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""


def license_scan(
    known: list[tuple[str, str]], spellings: list[tuple[str, str]], more: list[tuple[str, str]], prose: str
) -> str:
    def statement(line: str) -> str:
        """Whether a line is a copyright statement; what "copyright" must not be followed by is a test of its own."""
        marks = r"^[ \t]*(©|\(c\)[ \t]*(copyright|©)|copyright[ \t]*(\(c\)|©|:|,?[ \t]*[0-9]{4}))"
        year = r"^[ \t]*\(c\)([^\n]*[^0-9])?(19|20)[0-9]{2}([^0-9]|$)"
        holder = r"^[ \t]*copyright[ \t]+[\p{L}\p{N}<\[{]"
        text_of_licence = rf"^[ \t]*copyright[ \t]+({prose})([^\p{{L}}\p{{N}}]|$)"
        return (
            f"(regexp_matches({line}, {text(marks)}) OR regexp_matches({line}, {text(year)})"
            f" OR regexp_matches({line}, {text(holder)}) AND NOT regexp_matches({line}, {text(text_of_licence)}))"
        )

    def canonical(column: str) -> str:
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        out = f"translate(coalesce({column}, ''), '{upper}', '{upper.lower()}')"
        kept = f"CASE WHEN {statement('x')} THEN '' ELSE x END"
        out = f"array_to_string(list_transform(string_split({out}, chr(10)), lambda x: {kept}), chr(10))"
        out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
        for a, b in spellings:
            out = f"replace({out}, {text(a)}, {text(b)})"
        return out

    def whole(canonical_text: str) -> str:
        out = f"regexp_replace({canonical_text}, '[ \n]+', ' ', 'g')"
        for a, b in spellings:
            if " " in a:
                out = f"replace({out}, {text(a)}, {text(b)})"
        return f"sha256(trim({out}))"

    given = ", ".join(f"({text(i)}, {text(d)})" for i, d in more)
    values = ", ".join(f"({text(i)}, {text(t)})" for i, t in known)
    return f"""
WITH known AS (
  SELECT digest, min(i) AS id FROM (
    SELECT {whole(canonical("t"))} AS digest, i FROM (VALUES {values}) AS k(i, t) UNION ALL SELECT d, i FROM (VALUES {given}) AS g(i, d))
  GROUP BY digest),
d AS (SELECT doc_id, {canonical("text")} AS c FROM documents),
w AS (SELECT doc_id, c, {whole("c")} AS text_digest FROM d),
lines AS (SELECT doc_id, trim(x) AS line FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS x FROM d)),
notices AS (
  SELECT doc_id, string_agg(DISTINCT id, ',' ORDER BY id) AS notice_ids, count(*) AS n
  FROM lines JOIN known ON digest = sha256(line) WHERE line <> '' GROUP BY doc_id)
SELECT w.doc_id, text_digest, k.id AS license_id, notice_ids, coalesce(n, 0) AS n_notices
FROM w LEFT JOIN known k ON k.digest = text_digest LEFT JOIN notices USING (doc_id)
"""


def quality_counts(rows: str) -> str:
    """Common table expressions that end in ``counts``, from a query of all columns of documents."""
    return f"""
src AS ({rows}),
toks AS (
  SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE_CLASS}+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM src),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM toks)),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c > 1)
  GROUP BY doc_id),
counts AS (
  SELECT t.doc_id, lang, source, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM toks t LEFT JOIN repeats r ON r.doc_id = t.doc_id)"""


def quality_verdicts() -> str:
    """Common table expressions from ``counts`` to ``verdicts``."""
    spread = {r: s for r, s in quality.RATES.items()}
    rate_rows = " UNION ALL ".join(
        f"SELECT lang, source, '{r}' AS rate, {r} AS v, {s} AS least FROM rated WHERE NOT base_failed" for r, s in spread.items()
    )

    def level(keys: str, name: str) -> str:
        part = f"{keys}, rate" if keys else "rate"
        group = f"{keys}, " if keys else ""
        return f"""
{name}_b AS (SELECT {part}, b, any_value(least) AS least, count(*) AS n FROM binned GROUP BY {part}, b),
{name}_r AS (
  SELECT *, sum(n) OVER (PARTITION BY {part} ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {part}) AS total FROM {name}_b),
{name}_q AS (
  SELECT {part}, any_value(least) AS least, any_value(total) AS total,
         min(b) FILTER (upto * 4 >= total) AS q1, min(b) FILTER (upto * 4 >= total * 2) AS q2,
         min(b) FILTER (upto * 4 >= total * 3) AS q3 FROM {name}_r GROUP BY {part}),
{name}_f AS (
  SELECT {group}max(total) AS total,
         {", ".join(f"max(q2 + {quality.SPREADS} * greatest(q2 - q1, least)) FILTER (rate = '{r}') AS max_{r}" for r in spread)},
         max(q2 - {quality.SPREADS} * greatest(q3 - q2, least)) FILTER (rate = 'word_length') AS min_word_length
  FROM {name}_q {f"GROUP BY {keys}" if keys else ""})"""

    pick = ", ".join(
        f"CASE WHEN g.total >= {quality.GROUP_ROWS} THEN g.{c} WHEN l.total >= {quality.GROUP_ROWS} THEN l.{c} ELSE a.{c} END AS {c}"
        for c in quality.LIMITS
    )
    within = " AND ".join(f"{r} <= max_{r}" for r in spread) + " AND word_length >= min_word_length"
    return f"""
rated AS (
  SELECT *, coalesce(n_symbols * 10000 // nullif(word_chars, 0), 0) AS symbol_rate,
         coalesce(n_dup_lines * 10000 // nullif(n_lines, 0), 0) AS line_rate,
         coalesce(n_repeat_words * 10000 // nullif(n_words, 0), 0) AS repeat_rate,
         coalesce(word_chars * 100 // nullif(n_words, 0), 0) AS word_length,
         n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed
  FROM counts),
binned AS (
  SELECT *, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS b FROM ({rate_rows})),
{level("lang, source", "g")},
{level("lang", "l")},
{level("", "a")},
limits AS (
  SELECT g.lang, g.source, {pick}
  FROM g_f g LEFT JOIN l_f l ON l.lang IS NOT DISTINCT FROM g.lang CROSS JOIN a_f a),
verdicts AS (
  SELECT r.*, NOT base_failed AND coalesce({within}, false) AS kept
  FROM rated r LEFT JOIN limits t ON t.lang IS NOT DISTINCT FROM r.lang AND t.source IS NOT DISTINCT FROM r.source)"""


def quality_rules() -> str:
    return f"""
WITH {quality_counts("SELECT * FROM documents")}, {quality_verdicts()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdicts
"""


SUBSTRING_DEDUP = f"""
WITH toks AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE_CLASS}+'), lambda x: x <> '') AS words
  FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 12), ' ')) AS w
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) AS i FROM toks)),
first AS (SELECT *, min(doc_id) OVER (PARTITION BY w) AS earliest FROM windows),
covered AS (
  SELECT doc_id, list(DISTINCT p) AS gone FROM (
    SELECT doc_id, unnest(range(i, i + 13)) AS p FROM first WHERE earliest < doc_id) GROUP BY doc_id),
kept AS (
  SELECT t.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
         coalesce((SELECT string_agg(k.word, ' ' ORDER BY k.p) FROM (
           SELECT unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p) k
           WHERE gone IS NULL OR NOT list_contains(gone, k.p)), '') AS kept_text
  FROM toks t LEFT JOIN covered c ON c.doc_id = t.doc_id)
SELECT doc_id, n_words, n_removed, sha256(kept_text) AS kept_sha256 FROM kept
"""


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, octet_length(html::BLOB) AS n FROM (SELECT page_id, digest, encode(html) AS html FROM p)),
f AS (SELECT digest, min(page_id) AS first_id FROM q WHERE n >= 100 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to, true AS digest_ok
FROM q LEFT JOIN f USING (digest)
"""


LINE_DEDUP = f"""
WITH src AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(regexp_replace(lines[i], '^{SPACE_CLASS}+|{SPACE_CLASS}+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM src)),
common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM lines LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def merkle_manifest(levels: int = 8) -> str:
    """Trees of up to ``16 ** levels`` documents a source, and as many sources."""

    def leaf(text_column: str) -> str:
        fields = [
            f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
            for c in ("doc_id", "d.source", "lang", "n_chars", text_column)
        ]
        return f"sha256({' || '.join(fields)})"

    def tree(name: str, start: str) -> str:
        """Common table expressions {name}0.. with g, i, h, n, and {name}_path0.. with what stands beside a node."""
        parts = [f"{name}0 AS MATERIALIZED ({start})"]
        for k in range(levels):
            parts.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT g, i // 16 AS i, "
                "CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, "
                f"(any_value(n) + 15) // 16 AS n FROM {name}{k} GROUP BY g, i // 16)"
            )
            run = "PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
            parts.append(
                f"{name}_path{k} AS MATERIALIZED (SELECT g, i, n > 1 AS up, "
                f"coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, "
                f"coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z FROM {name}{k})"
            )
        return ", ".join(parts)

    def walk(name: str, before: str, g: str, i: str) -> tuple[str, str]:
        """Common table expressions that lead rows ``doc_id, g, i, s, proof, node`` up a tree, and the last one's name."""
        parts = []
        for k in range(levels):
            parts.append(
                f"{name}_walk{k} AS MATERIALIZED (SELECT w.* EXCLUDE (proof, node), "
                "CASE WHEN up THEN proof || a || z ELSE proof END AS proof, "
                f"CASE WHEN up THEN sha256(a || node || z) ELSE node END AS node FROM {before} w "
                f"JOIN {name}_path{k} p ON p.g = w.{g} AND p.i = w.{i} // {16**k})"
            )
            before = f"{name}_walk{k}"
        return ", ".join(parts), before

    lower, last = walk("t", "shown", "g", "i")
    upper, last = walk("r", last, "zero", "g")
    return f"""
WITH bits AS (SELECT range(0, 8) AS eight),
crc(b, v) AS (
  SELECT b, list_reduce(list_prepend(b, eight),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
  FROM (SELECT unnest(range(0, 256)) AS b), bits),
steps AS (SELECT list(v ORDER BY b) AS t FROM crc),
ids AS (
  SELECT doc_id, list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)) AS codes
  FROM documents WHERE doc_id IS NOT NULL),
tampered AS (
  SELECT DISTINCT doc_id FROM ids, steps
  WHERE xor(list_reduce(codes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 5 = 0),
groups AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM documents)),
docs AS (
  SELECT doc_id, g, 0 AS zero, {leaf("text")} AS leaf,
         {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered
  FROM documents d JOIN groups s ON s.source IS NOT DISTINCT FROM d.source),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n
  FROM docs),
{tree("t", "SELECT g, i, leaf AS h, n FROM leaves")},
{tree("r", f"SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM t{levels}")},
shown AS (
  SELECT doc_id, g, i, zero, leaf, '' AS proof,
         CASE WHEN doc_id IN (SELECT doc_id FROM tampered) THEN lowered ELSE leaf END AS node FROM leaves),
{lower}, {upper}
SELECT w.doc_id, w.leaf, s.h AS subroot, root.h AS root, sha256(w.proof) AS proof_sha256,
       w.node AS folded_root, w.node = root.h AS verified
FROM {last} w JOIN t{levels} s ON s.g = w.g, r{levels} root
"""
