"""DuckDB SQL for the training-data queries that SQL can express on whole tables."""

_SPLIT = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\v\f\r]+'), lambda w: w <> '')"

# Positions where a document word equals an item word, by diagonal; windows of 13 aligned words
# with at most two that differ are counted from the matches they hold; an item of 8 to 12 words
# is one window, all of whose words must agree.
OP9 = rf"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
dw AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d WHERE len(w) >= 8),
b AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
bw AS (SELECT item_id, len(w) AS m, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS q FROM b WHERE len(w) >= 8),
same AS (SELECT doc_id, item_id, n, m, p, p - q AS diag FROM dw JOIN bw USING (word)),
dense AS (SELECT doc_id, item_id, diag FROM same GROUP BY ALL HAVING count(*) >= least(11, any_value(m))),
hit AS (SELECT same.* FROM same JOIN dense USING (doc_id, item_id, diag)),
starts AS (
  SELECT doc_id, item_id, diag, least(m, 13) AS win, unnest(range(greatest(0, diag), least(n, m + diag) - least(m, 13) + 1)) AS s
  FROM (SELECT DISTINCT doc_id, item_id, diag, n, m FROM hit)),
good AS (
  SELECT starts.doc_id, starts.item_id, s, win
  FROM starts JOIN hit ON hit.doc_id = starts.doc_id AND hit.item_id = starts.item_id AND hit.diag = starts.diag
    AND p BETWEEN s AND s + win - 1
  GROUP BY starts.doc_id, starts.item_id, starts.diag, s, win HAVING count(*) >= CASE WHEN win = 13 THEN 11 ELSE win END)
SELECT doc_id, item_id, CAST(min(s) AS INTEGER) AS first_word, CAST(max(s + win) AS INTEGER) AS last_word,
  count(DISTINCT s) AS n_windows
FROM good GROUP BY doc_id, item_id
"""

# Lines with a word; pairs share a word among the n/5 + 1 rarest of each.
OP3 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no
  FROM documents),
s AS (
  SELECT doc_id, no, list_distinct(list_filter(regexp_split_to_array(line, '[ 	

]+'), lambda w: w <> '')) AS w
  FROM l),
e AS (SELECT doc_id, no, w, len(w) AS n FROM s WHERE len(w) > 0),
sets AS (SELECT list_sort(w) AS w, min((doc_id, no)) AS first FROM e GROUP BY list_sort(w)),
f AS (SELECT first AS pos, w, len(w) AS n FROM sets),
tok AS (SELECT pos, n, unnest(w) AS word FROM f),
df AS (SELECT word, count(*) AS c FROM tok GROUP BY word),
ranked AS (SELECT pos, n, word, row_number() OVER (PARTITION BY pos ORDER BY c, word) AS i FROM tok JOIN df USING (word)),
pre AS (SELECT pos, n, word FROM ranked WHERE i <= n // 5 + 1),
cand AS (
  SELECT DISTINCT a.pos AS u, b.pos AS v FROM pre a JOIN pre b USING (word)
  WHERE b.pos < a.pos AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
near AS (
  SELECT DISTINCT u FROM cand JOIN f a ON a.pos = u JOIN f b ON b.pos = v
  WHERE 9 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n)),
gone AS (
  SELECT e.doc_id, e.no FROM e JOIN sets ON list_sort(e.w) = sets.w
  WHERE (e.doc_id, e.no) <> sets.first OR sets.first IN (SELECT u FROM near))
SELECT l.doc_id, count(*) AS n_lines, count(gone.no) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY l.no) FILTER (WHERE gone.no IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.no = l.no
GROUP BY l.doc_id
"""

# All phrases of 1 to 5 words inside pieces, by language; parts of a phrase are phrases themselves.
OP12 = r"""
WITH p AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\v\f\r]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
st AS (SELECT lang, w, unnest(range(len(w))) AS i FROM w),
g AS (SELECT lang, unnest([w[i + 1:i + j] for j in range(1, least(5, len(w) - i) + 1)]) AS g FROM st),
f AS (SELECT lang, g, len(g) AS k, count(*) AS a FROM g GROUP BY lang, g HAVING count(*) >= 100),
size AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
sub AS (
  SELECT lang, a, unnest(flatten([[g[i + 1:i + m] for i in range(k - m + 1)] for m in range(2, k)])) AS g FROM f WHERE k > 2),
around AS (SELECT lang, g, max(a) AS a FROM sub GROUP BY lang, g),
c AS (
  SELECT f.* FROM f LEFT JOIN around ON around.lang = f.lang AND around.g = f.g
  WHERE k > 1 AND (around.a IS NULL OR 100 * around.a < 100 * f.a)),
cut AS (SELECT *, unnest(range(1, k)) AS j FROM c),
s AS (
  SELECT cut.lang, cut.g, cut.a, x.a AS l, y.a AS r, size.n, j,
    (1000::HUGEINT * cut.a * size.n) // (x.a::HUGEINT * y.a) AS score
  FROM cut JOIN size ON size.lang = cut.lang
    JOIN f x ON x.lang = cut.lang AND x.g = cut.g[1:cut.j] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[j + 1:cut.k]),
least_cut AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
  array_to_string(g, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM least_cut QUALIFY rank <= 2000
"""

# Words inside 5-word windows found twice in a text; failures by host, shrunk by a moment-fitted beta prior.
OP13 = r"""
WITH l AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, unnest(range(len(w) - 4)) AS i, unnest([w[j + 1:j + 5] for j in range(len(w) - 4)]) AS k
  FROM l WHERE len(w) >= 5),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win),
cover AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT l.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[ \t\n\v\f\r]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM l LEFT JOIN cover USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
f AS (
  SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 25 * n_words AS failed FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(bad) / sum(n) AS p, sum(bad * bad / n) AS ff, sum(n * n) AS nn FROM h),
r AS (SELECT *, n - nn / n - (k - 1) AS room, CASE WHEN p > 0 AND p < 1 THEN (ff - n * p * p) / (p * (1 - p)) - (k - 1) END AS spread FROM s),
prior AS (
  SELECT p, CASE WHEN k > 1 AND p > 0 AND p < 1 AND room > 0
    THEN CASE WHEN spread <= 0 THEN 10000.0 ELSE greatest(1.0, least(10000.0, room / spread - 1)) END ELSE 20.0 END AS strength FROM r),
gone AS (SELECT source FROM h, prior WHERE (bad + p * strength) / (n + strength) >= 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM gone)) AS kept
FROM f
"""

SQL: dict[str, str] = {
    "op3_line_dedup": OP3,
    "op9_decontamination": OP9,
    "op12_collocations": OP12,
    "op13_host_rules": OP13,
}
