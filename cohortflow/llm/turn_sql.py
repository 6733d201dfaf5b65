"""SQL that must give the rows of the conversation and license queries."""

from __future__ import annotations

from cohortflow.llm.licences import NOTICES, PHRASES, Templates, bare_words

# crc32 of a short ASCII string by the usual table of 256 values, which the query computes
CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i)))"""


def crc32(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)])), 4294967295)"


TRIE_SQL = f"""
WITH {CRC_TABLE},
own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), text) AS s
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
begun AS (SELECT conv_id, s, {crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM own, crc),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.s, [])[1:c.h], c.s[c.h + 1:]) AS s FROM begun c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
short AS (SELECT conv_id, list_transform(s, lambda x: sha256(length(x.r) || ':' || x.r || x.t)) AS s,
    list_transform(s, lambda x: len(regexp_extract_all(x.t, '[^\\x20\\x09-\\x0D]+'))) AS w FROM rebuilt),
prefixes AS (SELECT conv_id, d, s[1:d] AS p, w[d] AS w, len(s) AS n FROM short, unnest(range(len(s) + 1)) u(d)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(w), 0) AS w,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM prefixes GROUP BY p, d),
children AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
own_sums AS (SELECT nodes.p, d, (n_convs - 1) * w AS saved, CASE WHEN children.n IS NULL THEN 1 ELSE 0 END AS leaf FROM nodes LEFT JOIN children USING (p)),
subtrees AS (SELECT p[1:k] AS p, sum(saved) AS saved, sum(leaf) AS leaves FROM own_sums, unnest(range(d + 1)) u(k) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
    CAST(t.leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees t ON t.p = n.p LEFT JOIN children c ON c.p = n.p LEFT JOIN nodes a ON a.d = n.d - 1 AND a.p = n.p[1:n.d - 1]"""

# states: 0 nothing yet, 1 system, 2 user, 3 assistant
REPAIR_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM hit, unnest(range(CASE WHEN k = 0 THEN 0 WHEN k = 3 THEN 2 ELSE 1 END)) u(copy)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN '' ELSE 'truncated' END AS fault,
    lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
inserts(st, st2, cost, letters, lines) AS (VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
    (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
    (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
keeps(st, initial, st2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
states(st) AS (VALUES (0), (1), (2), (3)),
actions AS (
    SELECT conv_id, pos, st, st AS st2, 2 AS cost, 'D' AS letter, CAST([] AS VARCHAR[]) AS lines FROM judged, states
    UNION ALL
    SELECT conv_id, pos, st, st2, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'K', [role || ':' || text]
    FROM judged JOIN keeps ON initial = role[1:1] WHERE fault NOT IN ('blank', 'duplicate')
    UNION ALL
    SELECT conv_id, pos, st, CASE WHEN st = 2 THEN 3 ELSE 2 END, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END, 'R',
        [CASE WHEN st = 2 THEN 'assistant:' ELSE 'user:' END || text] FROM judged, states WHERE fault NOT IN ('blank', 'duplicate')),
ways AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, i.st2 AS st, i.cost, i.letters AS audit, CAST(i.lines AS VARCHAR[]) AS lines
    FROM conversations, inserts i WHERE i.st = 0
    UNION ALL
    SELECT conv_id, pos, st, cost, audit, lines FROM (
        SELECT w.conv_id, a.pos, i.st2 AS st, w.cost + a.cost + i.cost AS cost, w.audit || a.letter || i.letters AS audit,
            list_concat(w.lines, a.lines, i.lines) AS lines,
            row_number() OVER (PARTITION BY w.conv_id, i.st2 ORDER BY w.cost + a.cost + i.cost, w.audit || a.letter || i.letters) AS rank
        FROM ways w JOIN actions a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.pos = w.pos + 1 AND a.st = w.st JOIN inserts i ON i.st = a.st2)
    WHERE rank = 1),
ends AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC, cost, audit) AS rank FROM ways WHERE st IN (0, 3)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pos > 1 AND before[1:1] || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, CAST(e.cost AS BIGINT) AS cost, e.audit, sha256(array_to_string(e.lines, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id WHERE rank = 1"""


def _words(names) -> str:
    return "[" + ", ".join(f"'{w}'" for w in names) + "]"


def _licence_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    need = Templates.of().need
    templates = ", ".join(f"('{label}', {_words(sorted(set(bare_words(t))))}, {n})" for (label, t), n in zip(NOTICES, need, strict=True))
    phrases = ", ".join(f"('{label}', {_words(bare_words(p))})" for p, label in PHRASES.items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH templates(label, w, need) AS (VALUES {templates}), phrases(label, w) AS (VALUES {phrases}),
docs AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS text FROM documents),
words AS (SELECT row, doc_id, regexp_extract_all(text, '{word}') AS w FROM docs),
places AS (SELECT row, label, i FROM (SELECT row, label, unnest(list_filter(range(len(words.w)), lambda i: words.w[i + 1:i + len(phrases.w)] = phrases.w)) AS i
    FROM words JOIN phrases ON list_contains(words.w, phrases.w[1]))),
named AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY row),
line AS (SELECT row, i, regexp_extract_all(string_split(text, chr(10))[i], '{word}') AS w FROM docs, unnest(range(1, 1 + len(string_split(text, chr(10))))) u(i)),
part AS (SELECT *, count(*) FILTER (len(w) = 0) OVER (PARTITION BY row ORDER BY i) AS part FROM line),
blocks AS (SELECT row, i AS first, i AS last, list_distinct(w) AS w FROM line WHERE len(w) > 0
    UNION ALL SELECT row, min(i), max(i), list_distinct(flatten(list(w))) FROM part WHERE len(w) > 0 GROUP BY row, part HAVING count(*) > 1),
pairs AS (SELECT row, first, last, label, n / len(t) AS containment, n FROM (
    SELECT row, first, last, label, templates.w AS t, need, len(list_intersect(blocks.w, templates.w)) AS n FROM blocks, templates) WHERE n >= need),
best AS (SELECT * FROM pairs QUALIFY rank() OVER (PARTITION BY row, first, last ORDER BY containment DESC, n DESC) = 1),
told AS (SELECT row, max(containment) AS most, list(DISTINCT label) AS labels FROM best GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(array_to_string(list_sort(named.labels), ','), '') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(named.labels, []), coalesce(told.labels, [])))), ',') AS labels,
    CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0::DOUBLE) END AS score
FROM words LEFT JOIN named USING (row) LEFT JOIN told USING (row)"""


LICENCE_SQL = _licence_sql()
