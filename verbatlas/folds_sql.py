"""DuckDB statements of the folds over cues: each step of a recursion takes all videos one row further."""

# said: cues reduced to their new words. Reads timed (video_id, cue_index, second, text).
OVERLAP_SQL = """
worded AS (SELECT video_id, cue_index, second, w, [trim(lower(x), '.,;:!?¿¡()[]{}"') FOR x IN w] AS heard, row_number() OVER (PARTITION BY video_id ORDER BY cue_index) AS k
  FROM (SELECT *, string_split(text, ' ') AS w FROM timed)),
heard_so_far AS (
  SELECT video_id, k, cue_index, second, w AS new, heard[-80:] AS said FROM worded WHERE k = 1
  UNION ALL
  SELECT video_id, k, cue_index, second, w[shared + 1:], (base || heard[shared + 1:])[-80:] FROM (
    SELECT *, CASE WHEN len(heard) <= len(base) AND base[-len(heard):] = heard THEN len(heard) ELSE coalesce(list_max([n FOR n IN range(1, least(len(heard), len(base)) + 1) IF base[-n:] = heard[:n]]), 0) END AS shared
    FROM (SELECT c.*, CASE WHEN c.second - f.second > 15 THEN [] ELSE f.said END AS base FROM heard_so_far f JOIN worded c ON c.video_id = f.video_id AND c.k = f.k + 1))),
said AS (SELECT video_id, cue_index, second, array_to_string(new, ' ') AS text FROM heard_so_far WHERE len(new) > 0)"""

# packed_units: (video_id, position, part, second, text, fragments). Reads said (video_id, cue_index, second, text).
UNITS_SQL = r"""
pieces AS (SELECT video_id, cue_index, second, text, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
  SELECT *, string_split(regexp_replace(text, '([.!?…]+["''»”)\]]*)\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM said) WHERE trim(text) <> ''),
placed AS (SELECT *, coalesce(sum(length(piece) + 1) OVER (PARTITION BY video_id, cue_index ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, lag(piece) OVER (PARTITION BY video_id, cue_index ORDER BY i) AS before FROM pieces WHERE piece <> ''),
joined AS (SELECT *, sum(CASE WHEN before IS NULL OR NOT (regexp_matches(before, '(?i)(^|[^\p{L}\p{N}_])(sr|sra|srta|dr|dra|ing|lic|etc|ej|núm|num)\.$') OR (regexp_matches(before, '(^|[^\p{L}\p{N}_])\p{Nd}+\.$') AND regexp_matches(piece, '^\p{Nd}'))) THEN 1 ELSE 0 END)
  OVER (PARTITION BY video_id, cue_index ORDER BY i) AS g FROM placed),
parts AS (SELECT video_id, cue_index, second, min(a)::BIGINT AS a, (min(a) + length(string_agg(piece, ' ' ORDER BY i)))::BIGINT AS b, string_agg(piece, ' ' ORDER BY i) AS part, regexp_full_match(any_value(text), '(\s*\[[^\]]+\]\s*)+') AS alone FROM joined GROUP BY video_id, cue_index, second, g),
numbered AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY cue_index, a) AS k, len(regexp_extract_all(part, '[\p{L}\p{N}_]+')) AS n, regexp_matches(part, '[.!?…]["''»”)\]]*$') AS ended FROM parts),
folded AS (
  SELECT video_id, k, cue_index, second, a, b, part, alone, ended, n AS words, 1 AS cues, 1 AS unit FROM numbered WHERE k = 1
  UNION ALL
  SELECT video_id, k, cue_index, second, a, b, part, alone, ended, CASE WHEN fresh THEN n ELSE words + n END, CASE WHEN fresh THEN 1 WHEN cue_index = pc THEN cues ELSE cues + 1 END, unit + CASE WHEN fresh THEN 1 ELSE 0 END
  FROM (SELECT x.*, f.words, f.cues, f.unit, f.cue_index AS pc,
      f.ended OR (x.cue_index <> f.cue_index AND (x.second - f.second > 15 OR x.alone OR f.alone OR f.cues >= 4)) OR f.words + x.n > 80 AS fresh
    FROM folded f JOIN numbered x ON x.video_id = f.video_id AND x.k = f.k + 1)),
grouped AS (SELECT video_id, unit, min(cue_index) AS position, first(second ORDER BY k) AS second, string_agg(part, ' ' ORDER BY k) AS text, list({'cue_index': cue_index, 'second': second, 'start': a, 'end': b, 'text': part} ORDER BY k) AS fragments FROM folded GROUP BY video_id, unit),
packed_units AS (SELECT *, row_number() OVER (PARTITION BY video_id, position ORDER BY unit) - 1 AS part FROM grouped)"""


def concepts_sql(stop: str, generic: str, actions: str, connectors: str, determiners: str, descriptors: str, ending: str, limit: int = 15, most: int = 400) -> str:
    """chosen: (video_id, rank, name, score, n, frequency, distribution, association, timestamps). Reads packed (video_id, unit, second,
    text, fragments). The lists are quoted words."""
    token = "(?i)[a-záéíóúñüÁÉÍÓÚÑÜ0-9]+(?:[.-][a-záéíóúñüÁÉÍÓÚÑÜ0-9]+)*"
    broken = "[,;:!?…—–]|\\s-\\s"
    return f"""
spoken AS (SELECT video_id, unit, f, fragments[f].second AS second, regexp_extract_all(fragments[f].text, '{token}') AS t FROM (SELECT video_id, unit, fragments, unnest(range(1, len(fragments) + 1)) AS f FROM packed)),
tokens AS (SELECT video_id, unit, lower(w) AS t, second, row_number() OVER (PARTITION BY video_id, unit ORDER BY f, j) AS i FROM (SELECT video_id, unit, f, second, unnest(t) AS w, generate_subscripts(t, 1) AS j FROM spoken)),
gaps AS (SELECT video_id, unit, [regexp_matches(g, '{broken}') FOR g IN regexp_split_to_array(text, '{token}')] AS g FROM packed),
near AS (SELECT t.*, g.g, lag(t) OVER w AS before, lead(t) OVER w AS t1, lead(t, 2) OVER w AS t2 FROM tokens t JOIN gaps g USING (video_id, unit) WINDOW w AS (PARTITION BY video_id, unit ORDER BY i)),
runs AS (SELECT video_id, unit, i, before, second, unnest([[t], CASE WHEN t1 IS NOT NULL AND NOT g[i + 1] THEN [t, t1] END, CASE WHEN t1 IS NOT NULL AND NOT g[i + 1] AND t2 IS NOT NULL AND NOT g[i + 2] THEN [t, t1, t2] END]) AS w FROM near),
grams AS (SELECT video_id, unit, i, second, w, len(w) AS size, array_to_string(w, ' ') AS name, coalesce(before IN ({determiners}), false) OR regexp_matches(w[-1], '{ending}') OR w[-1] IN ({descriptors}) AS hinted,
  w[1] NOT IN ({stop}) AND w[-1] NOT IN ({stop}) AND NOT list_bool_or([regexp_full_match(x, '[0-9]+') FOR x IN w]) AND len(list_distinct(w)) = len(w)
  AND CASE WHEN len(w) = 1 THEN length(w[1]) >= 3 AND w[1] NOT IN ({generic}) AND w[1] NOT IN ({actions}) ELSE NOT list_bool_or([x IN ({actions}) FOR x IN w]) END AS possible FROM runs WHERE w IS NOT NULL),
times AS (SELECT video_id, min(second) AS t0, max(second) AS t1, CASE WHEN min(second) = max(second) THEN 1 ELSE least(count(DISTINCT second), 5) END AS bins FROM packed GROUP BY 1),
counts AS (SELECT video_id, name, any_value(w) AS w, any_value(size) AS size, bool_or(possible) AS possible, count(*) AS n, sum(hinted::INT) AS hints, min(unit) AS first, count(DISTINCT least(bins - 1, (second - t0) * bins // (t1 - t0 + 1))) AS parts, any_value(bins) AS bins
  FROM grams JOIN times USING (video_id) WHERE possible OR (size = 1 AND name NOT IN ({stop})) GROUP BY ALL),
found AS (SELECT * FROM counts WHERE possible AND (size = 1 OR ((n >= 2 OR (length(w[1]) >= 4 AND length(w[-1]) >= 4 AND (size < 3 OR w[2] IN ({stop}) OR length(w[2]) >= 4))) AND CASE WHEN size = 3 THEN w[2] IN ({connectors}) OR n >= 2 ELSE n >= 2 OR hints > 0 END))),
single AS (SELECT video_id, name AS word, n AS of FROM counts WHERE size = 1 AND name NOT IN ({stop})),
most AS (SELECT video_id, name, max(of) AS most FROM (SELECT video_id, name, unnest(w) AS word FROM found WHERE size > 1) JOIN single USING (video_id, word) GROUP BY ALL),
facts AS (SELECT f.*, ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY video_id)) AS frequency, CASE WHEN bins <= 1 THEN 1.0::DOUBLE ELSE parts::DOUBLE / bins END AS distribution, n::DOUBLE / most AS association FROM found f LEFT JOIN most USING (video_id, name)),
sums AS (SELECT *, least(1.0::DOUBLE, 0.45::DOUBLE * frequency + 0.25::DOUBLE * distribution + 0.30::DOUBLE * association + 0.08::DOUBLE) AS multi FROM facts),
scores AS (SELECT *, CASE WHEN size = 1 THEN 0.65::DOUBLE * frequency + 0.35::DOUBLE * distribution WHEN size = 3 AND w[2] IN ({connectors}) THEN least(1.0::DOUBLE, multi + 0.12::DOUBLE) ELSE multi END AS score FROM sums),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(score, 12) DESC, n DESC, size DESC, first, name) AS r FROM scores QUALIFY r <= {most}),
inside AS (SELECT l.video_id, s.name AS short, l.name AS long FROM (SELECT video_id, name, n, size, unnest(flatten([[array_to_string(w[a:b], ' ') FOR b IN range(a, size + 1)] FOR a IN range(1, size + 1)])) AS part FROM (SELECT * FROM ranked WHERE size > 1)) l
  JOIN ranked s ON s.video_id = l.video_id AND s.name = l.part AND s.name <> l.name WHERE l.n >= 0.8::DOUBLE * greatest(s.n, l.n)),
candidates AS (SELECT r.video_id, r.r, r.name, coalesce((SELECT list(long) FROM inside i WHERE i.video_id = r.video_id AND i.short = r.name), []) AS longer, coalesce((SELECT list(short) FROM inside i WHERE i.video_id = r.video_id AND i.long = r.name), []) AS shorter FROM ranked r),
choice AS (
  SELECT video_id, r, [name] AS kept FROM candidates WHERE r = 1
  UNION ALL
  SELECT video_id, r, [kept[k] FOR k IN range(1, len(kept) + 1) IF NOT (list_contains(shorter, kept[k]) AND (stop IS NULL OR k < stop))] || CASE WHEN stop IS NULL THEN [name] ELSE [] END
  FROM (SELECT c.*, f.kept, list_min([k FOR k IN range(1, len(f.kept) + 1) IF list_contains(c.longer, f.kept[k])]) AS stop FROM choice f JOIN candidates c ON c.video_id = f.video_id AND c.r = f.r + 1 WHERE len(f.kept) < {limit})),
kept AS (SELECT video_id, unnest(kept) AS name, generate_subscripts(kept, 1) AS rank FROM (SELECT video_id, arg_max(kept, r) AS kept FROM choice GROUP BY 1)),
seen AS (SELECT video_id, name, second, min((unit, i)) AS p FROM grams JOIN kept USING (video_id, name) GROUP BY ALL),
stamps AS (SELECT video_id, name, array_to_string(list(printf('%02d:%02d:%02d', second // 3600, second % 3600 // 60, second % 60) ORDER BY p)[1:5], ' ') AS timestamps FROM seen GROUP BY ALL),
chosen AS (SELECT video_id, rank, name, round(score, 6) AS score, n, round(frequency, 6) AS frequency, round(distribution, 6) AS distribution, round(association, 6) AS association, timestamps FROM kept JOIN ranked USING (video_id, name) JOIN stamps USING (video_id, name))"""


def marks_sql(text: str, negations: str) -> str:
    """What two texts must have in common before their words are compared: see functions.text.markers."""
    words, gaps = f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')", f"regexp_split_to_array(lower({text}), '[\\p{{L}}\\p{{N}}_]+')"
    doubled = f"regexp_replace(' ' || lower({text}) || ' ', '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"
    listed = lambda x: f"array_to_string(list_sort(list_distinct({x})), ' ')"
    # Both lists are made once: [... FOR x IN [{...}]][1].
    repeated = f"[[x.w[j] FOR j IN range(1, len(x.w)) IF x.w[j] = x.w[j + 1] AND regexp_full_match(x.w[j], '[a-záéíóúñü]+') AND regexp_full_match(x.s[j + 1], '(\\s*[,;:]\\s*|\\s+)')] FOR x IN [{{'w': {words}, 's': {gaps}}}]][1]"
    return f"{{'n': {listed(f"regexp_extract_all({doubled}, '[^\\p{{L}}\\p{{N}}_]({negations})[^\\p{{L}}\\p{{N}}_]', 1)")}, 'd': {listed(f"regexp_extract_all({text}, '\\b\\d+(?:[.,]\\d+)?\\b')")}, 'r': {listed(repeated)}}}"


def distinct_windows_sql(content: str, negations: str) -> str:
    """wins: (video_id, position, part, second, text, fragments), units nearly the same as one of the eight kept before within 15 s left
    out. Reads kept (video_id, k, position, part, second, text, fragments, n words); content is the content tokens of text."""
    return f"""
profiled AS (SELECT *, {content} AS words, {marks_sql('text', negations)} AS marks FROM kept),
judged AS (
  SELECT video_id, k, true AS stays, [{{'second': second, 'marks': marks, 'words': words}}] AS seen FROM profiled WHERE k = 1
  UNION ALL
  SELECT video_id, k, NOT again, CASE WHEN again THEN seen ELSE (seen || [{{'second': second, 'marks': marks, 'words': words}}])[-8:] END
  FROM (SELECT p.*, j.seen, coalesce(list_bool_or([abs(p.second - x.second) <= 15 AND p.marks = x.marks AND len(p.words) > 0 AND len(x.words) > 0 AND len(list_intersect(p.words, x.words)) / len(list_distinct(p.words || x.words)) >= 0.72::DOUBLE FOR x IN j.seen]), false) AS again
    FROM judged j JOIN profiled p ON p.video_id = j.video_id AND p.k = j.k + 1)),
staying AS (SELECT p.* EXCLUDE (k), row_number() OVER (PARTITION BY p.video_id ORDER BY p.k) AS k FROM profiled p JOIN judged j USING (video_id, k) WHERE stays),
stepped AS (SELECT video_id, k, position, part, second, text, fragments, n AS words, 1 AS size, 1 AS win FROM staying WHERE k = 1 UNION ALL
  SELECT video_id, k, position, part, second, text, fragments, CASE WHEN fresh THEN n ELSE words + n END, CASE WHEN fresh THEN 1 ELSE size + 1 END, win + fresh::INT
  FROM (SELECT x.video_id, x.k, x.position, x.part, x.second, x.text, x.fragments, x.n, w.words, w.size, w.win, w.size >= 3 OR w.words + x.n > 90 OR x.second - w.fragments[-1].second > 15 AS fresh FROM stepped w JOIN staying x ON x.video_id = w.video_id AND x.k = w.k + 1)),
wins AS (SELECT video_id, first(position ORDER BY k) AS position, first(part ORDER BY k) AS part, first(second ORDER BY k) AS second, string_agg(text, ' ' ORDER BY k) AS text, flatten(list(fragments ORDER BY k)) AS fragments FROM stepped GROUP BY video_id, win)"""


def filler_sql(text: str) -> str:
    """Fillers in a text: see functions.text.filler_penalty."""
    t = f"lower({text})"
    edge = "[^\\p{L}\\p{N}_]"
    return (
        f"(len(regexp_extract_all(regexp_replace(' ' || {t} || ' ', '({edge})', '\\1\\1', 'g'), '{edge}(eh|em|mmm+){edge}')) + len(regexp_extract_all(' ' || {t} || ' ', '{edge}bueno\\s*[,;:]?\\s+bueno{edge}'))"
        f" + len(regexp_extract_all({t}, '(^|(^|{edge})(eh|bueno)\\s*[,;:]?\\s+)a ver\\s*[,;:]')))"
    )


def ideas_sql(term: str, stop: str, content: str, negations: str, limit: int = 12) -> str:
    """ideas: (video_id, rank, position, part, second, text, fragments). Reads kept and wins."""
    return f"""
terms AS (SELECT video_id, position, part, trim(unnest(x), '.-_') AS term, generate_subscripts(x, 1) AS i FROM (SELECT *, regexp_extract_all(lower(text), '{term}') AS x FROM kept)),
weights AS (SELECT video_id, term, count(*) AS n FROM terms WHERE term <> '' AND term NOT IN ({stop}) AND NOT regexp_full_match(term, '[0-9]+') GROUP BY video_id, term QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY count(*) DESC, min((position, part, i))) <= 25),
said_in AS (SELECT video_id, position, part, second, text, fragments, {content} AS words, len(regexp_extract_all(lower(text), '[a-záéíóúñü0-9_.-]+')) AS w FROM wins),
weighed AS (SELECT video_id, position, part, sum(n) AS weight FROM (SELECT video_id, position, part, unnest(words) AS term FROM said_in) JOIN weights USING (video_id, term) GROUP BY ALL),
best AS (SELECT s.*, {marks_sql('text', negations)} AS marks,
  row_number() OVER (PARTITION BY video_id ORDER BY coalesce(weight, 0)::DOUBLE + len(words)::DOUBLE / greatest(w, 1) * 3 + least(w, 60)::DOUBLE / 60 + 1::DOUBLE / (position + 2) - CASE WHEN w < 10 THEN 3 ELSE 0 END - least(4.0::DOUBLE, 1.25::DOUBLE * {filler_sql('text')}) DESC, position, part) AS r
  FROM said_in s LEFT JOIN weighed USING (video_id, position, part)),
picked AS (
  SELECT video_id, r, [r] AS chosen_r, [{{'marks': marks, 'words': words}}] AS seen FROM best WHERE r = 1
  UNION ALL
  SELECT video_id, r, CASE WHEN again THEN chosen_r ELSE chosen_r || [r] END, CASE WHEN again THEN seen ELSE seen || [{{'marks': marks, 'words': words}}] END
  FROM (SELECT b.video_id, b.r, b.marks, b.words, p.chosen_r, p.seen, coalesce(list_bool_or([b.marks = x.marks AND len(b.words) > 0 AND len(x.words) > 0 AND len(list_intersect(b.words, x.words)) / len(list_distinct(b.words || x.words)) >= 0.72::DOUBLE FOR x IN p.seen]), false) AS again
    FROM picked p JOIN best b ON b.video_id = p.video_id AND b.r = p.r + 1 WHERE len(p.chosen_r) < {limit})),
ideas AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY position, part) AS rank, position, part, second, text, fragments FROM best JOIN (SELECT video_id, unnest(arg_max(chosen_r, r)) AS r FROM picked GROUP BY 1) USING (video_id, r))"""


def sections_sql(term: str, stop: str, content: str, negations: str, openers: str) -> str:
    """sections: (video_id, chunk, start, end, topic, sentences). Reads kept."""
    stamp = lambda s: f"printf('%02d:%02d:%02d', ({s}) // 3600, ({s}) % 3600 // 60, ({s}) % 60)"
    return f"""
bucketed AS (SELECT *, second // 300 * 300 AS bucket FROM kept),
chunked AS (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM bucket THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY k)::BIGINT AS chunk FROM (SELECT *, lag(bucket) OVER (PARTITION BY video_id ORDER BY k) AS p FROM bucketed)),
stretches AS (SELECT video_id, chunk, bucket, string_agg(text, ' ' ORDER BY k) AS text FROM chunked GROUP BY ALL),
chunk_terms AS (SELECT video_id, chunk, trim(unnest(x), '.-_') AS term, generate_subscripts(x, 1) AS i FROM (SELECT *, regexp_extract_all(lower(text), '{term}') AS x FROM stretches)),
chunk_words AS (SELECT video_id, chunk, term, count(*) AS n, row_number() OVER (PARTITION BY video_id, chunk ORDER BY count(*) DESC, min(i)) AS rank FROM chunk_terms WHERE term <> '' AND term NOT IN ({stop}) AND NOT regexp_full_match(term, '[0-9]+') GROUP BY video_id, chunk, term),
topics AS (SELECT video_id, chunk, string_agg(term, ', ' ORDER BY rank) AS topic FROM chunk_words WHERE rank <= 5 GROUP BY ALL),
squeezed AS (SELECT video_id, chunk, trim(regexp_replace(text, '[\\s\\x{{00A0}}]+', ' ', 'g')) AS t FROM stretches),
split AS (SELECT *, string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS marked, string_split(regexp_replace(t, '\\s+({openers})([^\\p{{L}}\\p{{N}}_]|$)', chr(1) || '\\1\\2', 'g'), chr(1)) AS told FROM squeezed),
lists AS (SELECT video_id, chunk, [trim(x) FOR x IN (CASE WHEN len(marked) = 1 THEN told ELSE marked END) IF length(trim(x)) >= 50] AS l FROM split),
lines AS (SELECT video_id, chunk, text, i, {content} AS words, {marks_sql('text', negations)} AS marks FROM (SELECT video_id, chunk, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM lists)),
sifted AS (
  SELECT video_id, chunk, i, [i] AS stay, [{{'marks': marks, 'words': words}}] AS seen FROM lines WHERE i = 1
  UNION ALL
  SELECT video_id, chunk, i, CASE WHEN again THEN stay ELSE stay || [i] END, CASE WHEN again THEN seen ELSE seen || [{{'marks': marks, 'words': words}}] END
  FROM (SELECT l.*, s.stay, s.seen, coalesce(list_bool_or([l.marks = x.marks AND len(l.words) > 0 AND len(x.words) > 0 AND len(list_intersect(l.words, x.words)) / len(list_distinct(l.words || x.words)) >= 0.72::DOUBLE FOR x IN s.seen]), false) AS again
    FROM sifted s JOIN lines l ON l.video_id = s.video_id AND l.chunk = s.chunk AND l.i = s.i + 1)),
stayed AS (SELECT video_id, chunk, unnest(stay) AS i, generate_subscripts(stay, 1) - 1 AS pos FROM (SELECT video_id, chunk, arg_max(stay, i) AS stay FROM sifted GROUP BY ALL)),
sentences AS (SELECT s.video_id, s.chunk, s.pos, l.text, l.words, len(regexp_extract_all(lower(l.text), '[a-záéíóúñü0-9_.-]+')) AS w FROM stayed s JOIN lines l USING (video_id, chunk, i)),
sentence_weights AS (SELECT video_id, chunk, pos, sum(n) AS weight FROM (SELECT video_id, chunk, pos, unnest(words) AS term FROM sentences) JOIN (SELECT * FROM chunk_words WHERE rank <= 20) USING (video_id, chunk, term) GROUP BY ALL),
told_best AS (SELECT s.*, row_number() OVER (PARTITION BY video_id, chunk ORDER BY coalesce(weight, 0)::DOUBLE + len(words)::DOUBLE / greatest(w, 1) * 3 + least(w, 60)::DOUBLE / 60 + 1::DOUBLE / (pos + 2) - CASE WHEN w < 10 THEN 3 ELSE 0 END - least(4.0::DOUBLE, 1.25::DOUBLE * {filler_sql('text')}) DESC, pos) AS r
  FROM sentences s LEFT JOIN sentence_weights USING (video_id, chunk, pos)),
three AS (SELECT video_id, chunk, string_agg(text, ' | ' ORDER BY pos) AS sentences FROM told_best WHERE r <= 3 GROUP BY ALL),
sections AS (SELECT video_id, chunk, {stamp('bucket')} AS start, {stamp('bucket + 300')} AS "end", coalesce(topic, '') AS topic, coalesce(sentences, trim(text[1:240]) || CASE WHEN length(text) > 240 THEN '...' ELSE '' END) AS sentences
  FROM stretches LEFT JOIN topics USING (video_id, chunk) LEFT JOIN three USING (video_id, chunk))"""
