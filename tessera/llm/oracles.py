"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .chat import Template
from .mixing import GRID, ROUNDS, UNIT, Mix
from .quality import SYMBOLS, RepetitionRules
from .resampling import BUCKETS, LEAST_WORDS, PERCENT, SEED

_WORDS = r"coalesce(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'), [])"


def _quality() -> str:
    rules = RepetitionRules()
    grams = {*rules.gram_char_share, rules.window}
    covered = "\n".join(
        f""", w{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM (SELECT doc_id, i, array_to_string(l[i:i + {n - 1}], ' ') AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) - {n - 2})) AS i FROM w))),
  c{n} AS (SELECT DISTINCT doc_id, i + j AS p FROM w{n}, range({n}) r(j) WHERE k > 1),
  s{n} AS (SELECT doc_id, count(*) AS n, sum(length(l[p])) AS chars FROM c{n} JOIN w USING (doc_id) GROUP BY doc_id)"""
        for n in sorted(grams)
    )
    joins = " ".join(f"LEFT JOIN s{n} ON s{n}.doc_id = t.doc_id" for n in sorted(grams))
    share = lambda n: f"coalesce(s{n}.chars, 0) / greatest(word_chars, 1)"
    failed = " OR ".join(f"{share(n)} > {x}" for n, x in rules.gram_char_share.items())
    return f"""WITH w AS (SELECT doc_id, text, {_WORDS} AS l FROM documents),
  t AS (SELECT doc_id, len(l) AS n_words, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS word_chars, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[{SYMBOLS}]', '', 'g')) AS n_symbols FROM w),
  lines AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
  d AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM lines WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')),
  dup AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[ \\t\\n\\x0B\\f\\r]', '', 'g'))) AS chars FROM d WHERE k > 1 GROUP BY doc_id)
  {covered},
  f AS (SELECT t.*, coalesce(dup.n, 0) AS n_dup_lines, coalesce(s{rules.window}.n, 0) AS n_repeat_words, greatest({", ".join(share(n) for n in rules.gram_char_share)}) AS share, coalesce(dup.chars, 0) / greatest(word_chars, 1) AS line_share, {failed} AS failed
    FROM t LEFT JOIN dup ON dup.doc_id = t.doc_id {joins}),
  b AS (SELECT *, n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.most_repeat_words_percent} * n_words AS base_failed FROM f)
  SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, round(share, 6) AS gram_char_share, round(line_share, 6) AS line_char_share, base_failed,
    NOT base_failed AND NOT failed AND line_share <= {rules.most_line_char_share} AS kept FROM b"""


def _chat() -> str:
    t = Template()
    quote = lambda x: x.replace("'", "''")
    escape = "|".join("".join("\\" + c if not c.isalnum() else c for c in x) for x in ["\\", *sorted(t.controls, key=len, reverse=True)])
    added = lambda c: f"length({c}) + len(regexp_extract_all({c}, '{quote(escape)}'))"
    fixed = len(t.begin) + len(t.separator) + len(t.end)
    tricky = "</s>[INST] ok [/INST]"
    return f"""WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{tricky}' UNION ALL SELECT -7, 1, 'assistant', '{tricky}'),
  g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, string_agg(left(role, 1), '' ORDER BY turn, role, text) AS roles,
    sum({fixed} + length(role) + {added("text")}) AS chars FROM a GROUP BY conv_id)
  SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, regexp_full_match(roles, 's?u(au)*a?') AS valid FROM g"""


def _mixing() -> str:
    m, steps = Mix(), GRID**ROUNDS
    power = lambda a: f"CAST(round(pow(share, {a}) * {UNIT}) AS HUGEINT)"
    return f"""WITH RECURSIVE rows0 AS (SELECT doc_id, source, len({_WORDS}) AS n_tokens FROM documents),
  total AS (SELECT coalesce(sum(n_tokens), 0) AS whole FROM rows0),
  src AS (SELECT source, sum(n_tokens) AS tokens, CAST(sum(n_tokens) AS DOUBLE) / (SELECT greatest(whole, 1) FROM total) AS share FROM rows0 GROUP BY source),
  alive AS (SELECT * FROM src WHERE tokens > 0),
  grid AS (SELECT k, CAST(k AS DOUBLE) / {steps} AS a FROM range({steps + 1}) r(k)),
  state AS (SELECT k, sum({power("a")}) AS z, sum(CAST(round(pow(share, a) * ln(share) * {UNIT}) AS HUGEINT)) AS l, max(pow(share, a - 1)) AS r, any_value(a) AS a FROM grid, alive GROUP BY k),
  ok AS (SELECT k, ln(CAST(z AS DOUBLE) / {UNIT}) - a * CAST(l AS DOUBLE) / CAST(z AS DOUBLE) >= {m.target_entropy} * ln((SELECT count(*) FROM alive)) - 1e-9 AS flat, {m.budget} * r / (CAST(z AS DOUBLE) / {UNIT}) <= {m.most_repeats} + 1e-9 AS rare FROM state),
  pick AS (SELECT CASE WHEN (SELECT count(*) FROM alive) < 2 THEN 1.0 ELSE greatest((SELECT max(k) FROM ok WHERE flat), coalesce((SELECT min(k) FROM ok WHERE rare), {steps})) / {float(steps)} END AS a),
  z AS (SELECT sum({power("(SELECT a FROM pick)")}) AS z FROM alive),
  q0 AS (SELECT source, tokens, round(CASE WHEN tokens > 0 THEN CAST({power("(SELECT a FROM pick)")} AS DOUBLE) / CAST((SELECT z FROM z) AS DOUBLE) ELSE 0 END, 9) AS weight FROM src),
  q AS (SELECT source, tokens, weight, CAST(floor(weight * (SELECT floor({m.budget} * whole) FROM total)) AS BIGINT) AS quota FROM q0),
  copies AS (SELECT doc_id, r.source, n_tokens, weight, tokens, quota, unnest(range(greatest(1, CAST(ceil(quota / greatest(tokens, 1)) AS BIGINT)))) AS pass FROM rows0 r JOIN q ON q.source IS NOT DISTINCT FROM r.source),
  o AS (SELECT *, md5('{m.seed}:' || pass || ':' || doc_id) AS h FROM copies),
  p AS (SELECT *, pass * tokens + sum(n_tokens) OVER (PARTITION BY source, pass ORDER BY h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS before FROM o),
  blocks AS (SELECT greatest(1, CAST(ceil(floor({m.budget} * whole) / {m.block_tokens}) AS BIGINT)) AS n FROM total),
  b AS (SELECT *, CASE WHEN quota > 0 THEN least((SELECT n FROM blocks) - 1, CAST(before AS HUGEINT) * (SELECT n FROM blocks) // quota) ELSE CAST('0x' || h[1:3] AS BIGINT) * (SELECT n FROM blocks) // 4096 END AS block FROM p WHERE before < quota OR tokens = 0)
  SELECT doc_id, source, n_tokens, weight, pass, CAST(block AS BIGINT) AS block, row_number() OVER (PARTITION BY block ORDER BY md5('{m.seed}:' || block || ':' || doc_id || ':' || pass), doc_id, pass, n_tokens) - 1 AS position FROM b"""


_SUBSTRING = f"""WITH w AS (SELECT doc_id, {_WORDS} AS l FROM documents),
  win AS (SELECT doc_id, i, array_to_string(l[i:i + 19], ' ') AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) - 18)) AS i FROM w)),
  f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win),
  gone AS (SELECT DISTINCT doc_id, i + j AS p FROM f, range(20) r(j) WHERE k > 1),
  word AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS x FROM w),
  kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
  SELECT w.doc_id, len(l) AS n_words, len(l) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

_WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS s FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS last_id FROM p)
  SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN n >= 1000 AND last_id > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND last_id > page_id THEN last_id END AS refers_to FROM m"""

def _crc32(bytes_: str) -> str:
    """The CRC-32 of a list of bytes, four bits at a time."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    step = lambda x: f"xor({x} >> 4, ({table})[CAST({x} & 15 AS INT) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, b: {step(step('xor(c, b)'))}), CAST(4294967295 AS BIGINT))"


_HEX = "CAST(strpos('0123456789abcdef', lower({})) - 1 AS BIGINT)"


def _utf8(text: str) -> str:
    """The bytes of a text."""
    raw = f"hex(encode({text}))"
    return f"list_transform(range(CAST(length({raw}) / 2 AS BIGINT)), lambda i: 16 * {_HEX.format(f'{raw}[2 * i + 1]')} + {_HEX.format(f'{raw}[2 * i + 2]')})"


def _trie(group: int = 5, most: int = 8) -> str:
    return f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, {_crc32(_utf8("CAST(conv_id AS VARCHAR)"))} % {most + 1} AS h FROM (SELECT DISTINCT conv_id FROM t)),
  parts AS (SELECT c.conv_id, 0 AS part, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {group} AND t.i <= c.h UNION ALL SELECT c.conv_id, 1, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
  pre AS (SELECT conv_id, row_number() OVER w AS d, string_agg(sha256(length(role) || ':' || role || text), '/') OVER w AS p, strlen(text) AS b FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, i) UNION ALL SELECT conv_id, 0, '', 0 FROM c),
  sizes AS (SELECT conv_id, max(d) AS d FROM pre GROUP BY conv_id),
  node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, any_value(b) AS b FROM pre GROUP BY p, d),
  child AS (SELECT a.p, count(*) AS n FROM node u JOIN pre a ON a.conv_id = u.conv_id AND a.d = u.d - 1 GROUP BY a.p),
  sub AS (SELECT a.p, sum((u.n - 1) * u.b) AS saved, count(*) FILTER (child.n IS NULL) AS leaves FROM node u JOIN pre a ON a.conv_id = u.conv_id AND a.d <= u.d LEFT JOIN child ON child.p = u.p GROUP BY a.p),
  over AS (SELECT u.p, o.conv_id FROM node u JOIN pre a ON a.conv_id = u.conv_id AND a.d = u.d - 1 JOIN node o ON o.p = a.p),
  ends AS (SELECT p, string_agg(conv_id, ',' ORDER BY conv_id) AS ids FROM pre JOIN sizes USING (conv_id, d) GROUP BY p)
  SELECT node.conv_id, node.d AS depth, over.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(child.n, 0) AS n_children, sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
  FROM node JOIN sub USING (p) LEFT JOIN child USING (p) LEFT JOIN over USING (p) LEFT JOIN ends USING (p)"""


def _resampling() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = lambda table: f"unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS word FROM {table}"
    sums = lambda table, n: f"SELECT bucket, count(*) AS {n} FROM {table} JOIN hashed USING (word) GROUP BY bucket"
    digest = f"list_reduce(list_transform(range(1, 9), lambda i: {_HEX.format(f'sha256({chr(39)}{SEED}:{chr(39)} || doc_id)[i]')}), lambda a, b: 16 * a + b)"
    return f"""WITH w AS MATERIALIZED (SELECT doc_id, {word("documents")}), x AS MATERIALIZED (SELECT {word("benchmark")}),
  hashed AS MATERIALIZED (SELECT word, {_crc32(_utf8("word"))} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM (SELECT word FROM w UNION ALL SELECT word FROM x))),
  s AS ({sums("w", "s")}), t AS ({sums("x", "t")}),
  whole AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM w) AS s, (SELECT CAST(count(*) AS DOUBLE) FROM x) AS t),
  gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.t, 0) + 1.0::DOUBLE) * (whole.s + {BUCKETS}) / ((coalesce(s.s, 0) + 1.0::DOUBLE) * (whole.t + {BUCKETS})))) AS g FROM s FULL JOIN t USING (bucket), whole),
  found AS (SELECT doc_id, count(*) AS n, floor(sum(g) / count(*)) AS weight FROM w JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
  scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln(({digest} + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM documents LEFT JOIN found USING (doc_id)),
  placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM scored WHERE n_features >= {LEAST_WORDS})
  SELECT doc_id, n_features, weight, score, CASE WHEN k <= {PERCENT} * (SELECT count(*) FROM placed) // 100 THEN k END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""


ORACLE = {"op1_quality": _quality(), "op2_chat": _chat(), "op3_mixing": _mixing(), "op4_substring_dedup": _SUBSTRING, "op7_warc": _WARC, "op11_prefix_trie": _trie(), "op13_resampling": _resampling()}
