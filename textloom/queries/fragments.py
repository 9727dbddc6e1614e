"""SQL text shared by the oracle statements."""

# RE2 has no Unicode \s; this class equals Python's white space.
SPACE = (r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WORD = r"[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\s]+"


def collapse(c: str) -> str:
    return f"regexp_replace({c}, '[{SPACE}]+', ' ', 'g')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def clean_plain(c: str) -> str:
    swapped = rf"regexp_replace({c}, '[\x{{200b}}\x{{a0}}]', ' ', 'g')"
    return f"trim({collapse(swapped)})"


def unescape(c: str) -> str:
    for name, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"),
                       ("&nbsp;", "chr(160)"), ("&middot;", "chr(183)"), ("&copy;", "chr(169)"),
                       ("&amp;", "'&'")):
        c = f"replace({c}, '{name}', {char})"
    return c


def clean_html(c: str) -> str:
    no_tags = f"regexp_replace({unescape(c)}, '<[^>]+>', ' ', 'g')"
    return f"trim({collapse(no_tags)})"


def n_tokens(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{WORD}'))::BIGINT"


def human_size(c: str) -> str:
    cases = " ".join(f"WHEN {c} < {1024 ** (i + 1)} THEN format('{{:.1f}}{u}', {c} / {1024 ** i})"
                     for i, u in enumerate(("B", "KB", "MB", "GB")))
    return f"CASE {cases} ELSE format('{{:.1f}}TB', {c} / {1024 ** 4}) END"


CLEANED_DOCS = f"""docs AS (
  SELECT doc_id, source, lang, t AS text, {n_tokens('t')} AS n_tok
  FROM (SELECT doc_id, source, lang, {clean_plain('text')} AS t FROM documents WHERE text <> '')
  WHERE length(t) >= 32)"""

# Every source of the documents table, plus an unknown key, a repeated key, a
# bad number and a part without '='. Weights are exact in binary.
MIX = ",".join(f"src{i}={(i % 4 + 1) * 0.25}" for i in range(20)) + ",nope=0.3, src5 = 2.5 ,src3=abc,bad"
SHARD_TOKENS = 2000

MIX_SQL = f"""registry AS (SELECT DISTINCT source AS source_key FROM documents),
parts AS (SELECT unnest(string_split('{MIX}', ',')) AS part, generate_subscripts(string_split('{MIX}', ','), 1) AS pos),
entries AS (SELECT pos, trim(split_part(part, '=', 1)) AS source_key,
    TRY_CAST(trim(split_part(part, '=', 2)) AS DOUBLE) AS weight FROM parts WHERE contains(part, '=')),
lasts AS (SELECT source_key, arg_max(weight, pos) AS w FROM entries
    WHERE weight IS NOT NULL AND source_key IN (SELECT source_key FROM registry) GROUP BY source_key),
mix AS (SELECT source_key, w / (SELECT sum(w) FROM lasts) AS weight FROM lasts)"""

BUDGETED_SQL = f"""{CLEANED_DOCS}, {MIX_SQL},
budgets AS (SELECT source_key, weight, CAST(trunc(weight * (SELECT sum(n_tok) * 6 // 10 FROM docs)) AS BIGINT) AS budget FROM mix),
run AS (SELECT d.*, budget, sum(n_tok) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS running
    FROM docs d JOIN budgets b ON d.source = b.source_key WHERE n_tok > 0),
admitted AS (SELECT * FROM run WHERE running - n_tok < budget AND running <= CAST(trunc(budget * 1.01::DOUBLE) AS BIGINT))"""


def greedy_sql(rows: str, size: int) -> str:
    """CTEs ``cuts`` and ``sharded`` over a table with source, running, n_tok."""
    return f"""cuts(source, k, cut) AS (
  SELECT DISTINCT source, 0::BIGINT, 0::BIGINT FROM {rows}
  UNION ALL
  SELECT c.source, c.k + 1, (SELECT min(r.running) FROM {rows} r WHERE r.source = c.source AND r.running >= c.cut + {size})
  FROM cuts c WHERE c.cut IS NOT NULL),
sharded AS (SELECT r.*, (SELECT count(*) FROM cuts c WHERE c.source = r.source AND c.k >= 1 AND c.cut < r.running)::BIGINT AS shard_id
  FROM {rows} r)"""

SEQ_LEN, ROWS_PER_SHARD = 64, 40

WORD_TOKENS = f"""toks AS (SELECT doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS word,
  generate_subscripts(regexp_extract_all(text, '{WORD}'), 1) AS pos FROM documents)"""
WORD_VOCABULARY = f"""{WORD_TOKENS},
specials(id, token) AS (VALUES (0, '<unk>'), (1, '<pad>'), (2, '<|endoftext|>'), (3, '<|im_start|>'), (4, '<|im_end|>')),
vocab AS (SELECT word, (row_number() OVER (ORDER BY count(*) DESC, word) + 4)::INTEGER AS id FROM toks GROUP BY word)"""
TOKEN_STREAM = f"""{WORD_VOCABULARY}, picked AS (SELECT doc_id FROM documents),
stream AS (SELECT doc_id, pos, id FROM toks JOIN vocab USING (word) WHERE doc_id IN (SELECT doc_id FROM picked)
  UNION ALL SELECT doc_id, 1000000000, 2 FROM picked)"""
PACKED = f"""{TOKEN_STREAM},
line AS (SELECT id, row_number() OVER (ORDER BY doc_id, pos) - 1 AS p FROM stream),
cut AS (SELECT p // {SEQ_LEN} AS row_idx, string_agg(id::VARCHAR, ' ' ORDER BY p) AS ids, count(*) AS n,
  min(id) AS lo, max(id) AS hi, count(*) FILTER (id = 2) AS ends FROM line GROUP BY 1),
packed AS (SELECT row_idx, row_idx // {ROWS_PER_SHARD} AS shard_id, ids || repeat(' 0', {SEQ_LEN} - n) AS input_ids,
  substr(repeat(' 1', n), 2) || repeat(' 0', {SEQ_LEN} - n) AS attention_mask, n, lo, hi, ends
  FROM cut WHERE n >= {SEQ_LEN // 2})"""

# Byte-pair induction. A word is a string of one code point (65536 + id) per symbol. State kinds: w words (key: the word),
# v tokens (key: the symbol), m merges (key: the rank); a step makes only changed rows again. A step merges the top pairs up to
# the first one that has a symbol on the other side of an earlier one: until there they cannot affect each other.
_SYMBOL = "chr(CAST(65536 + id AS INTEGER))"
BPE_STATE = f"""{WORD_TOKENS},
counts AS MATERIALIZED (SELECT word, count(*) AS freq FROM toks GROUP BY word),
letters AS (SELECT ch, row_number() OVER (ORDER BY ch) + 4 AS id FROM (SELECT DISTINCT unnest(string_split(word, '')) AS ch FROM counts)),
spelled AS (
  SELECT word, freq, string_agg({_SYMBOL}, '' ORDER BY i) AS s
  FROM (SELECT word, freq, unnest(string_split(word, '')) AS ch, generate_subscripts(string_split(word, ''), 1) AS i FROM counts) JOIN letters USING (ch)
  GROUP BY ALL),
state(kind, k, s, n) USING KEY (kind, k) AS (
  SELECT 'w', word, s, freq FROM spelled
  UNION ALL SELECT 'v', {_SYMBOL}, ch, id FROM letters
  UNION
  (WITH places AS MATERIALIZED (
     SELECT k, n, unnest([substr(s, i, 2) FOR i IN range(1, length(s))]) AS pair FROM recurring.state WHERE kind = 'w' AND length(s) > 1),
   ranked AS MATERIALIZED (
     SELECT pair, left(pair, 1) AS a, right(pair, 1) AS b, row_number() OVER (ORDER BY c DESC, pair) AS r
     FROM (SELECT pair, sum(n) AS c FROM places GROUP BY pair HAVING sum(n) >= 2 ORDER BY c DESC, pair LIMIT 400)),
   stops AS (SELECT min(y.r) AS r FROM ranked x JOIN ranked y ON x.a = y.b AND x.r < y.r
             UNION ALL SELECT min(y.r) FROM ranked x JOIN ranked y ON x.b = y.a AND x.r < y.r),
   sizes AS (SELECT max(n) FILTER (kind = 'v') AS last, count(*) FILTER (kind = 'm') AS merges FROM recurring.state WHERE kind <> 'w'),
   taken AS MATERIALIZED (
     SELECT pair, a, b, last + r AS id, merges + r - 1 AS rank
     FROM ranked, sizes WHERE r < coalesce((SELECT min(r) FROM stops), 1000) AND last + r < 32000),
   touched AS (SELECT k, list(DISTINCT {{'pair': pair, 'new': {_SYMBOL}}}) AS todo FROM places JOIN taken USING (pair) GROUP BY k)
   SELECT 'w', w.k, list_reduce(list_prepend({{'pair': '', 'new': w.s}}, todo), lambda x, y: {{'pair': '', 'new': replace(x.new, y.pair, y.new)}}).new, w.n
   FROM recurring.state w JOIN touched ON touched.k = w.k WHERE w.kind = 'w'
   UNION ALL SELECT 'v', {_SYMBOL}, x.s || y.s, id
   FROM taken JOIN recurring.state x ON x.kind = 'v' AND x.k = a JOIN recurring.state y ON y.kind = 'v' AND y.k = b
   UNION ALL SELECT 'm', CAST(rank AS VARCHAR), pair, id FROM taken))"""
