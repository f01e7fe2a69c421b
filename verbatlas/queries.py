"""The core operators over whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lexicon as L
from .functions import text as T
from .functions.timecode import code, seconds
from .folds_sql import OVERLAP_SQL, UNITS_SQL, concepts_sql, distinct_windows_sql, ideas_sql, sections_sql
from .operators import captions, concepts, ideas, keywords, library, quality, search, subtitles, tools, units
from .session import cut, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Clock of operations that write a time, so that their results can be compared.
NOW = "2026-01-01T00:00:00+00:00"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words)))


STOP = quoted(L.STOPWORDS)
TERM_SQL = f"regexp_extract_all(lower(text), '{L.TERM}')"


def timed_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Cues with their start in seconds; unreadable ones and repeated deliveries left out."""
    cues = table(spark, sf, "cues").select("video_id", F.col("cue_index").cast("bigint").alias("cue_index"), seconds(F.col("ts")).alias("second"), T.caption_text(F.col("text")).alias("text"))
    return cues.where("second is not null and text <> ''").groupBy("video_id", "cue_index").agg(F.min(F.struct("second", "text")).alias("x")).select("video_id", "cue_index", "x.*")


CAPTION_SQL = "trim(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(text,'&lt;','<'),'&gt;','>'),'&quot;','\"'),'&#39;',''''),'&apos;',''''),'&nbsp;',chr(160)),'&#160;',chr(160)),'&amp;','&'),'<[^>]+>','','g'),'&nbsp;',' '),'[\\s\\x{00A0}]+',' ','g'))"
SECONDS_SQL = (
    "CASE WHEN regexp_full_match(trim(ts), '(\\d+:)?\\d+:\\d+(\\.\\d*)?') THEN list_sum([x[1]::BIGINT * x[2] FOR x IN list_zip(list_reverse(string_split(split_part(trim(ts), '.', 1), ':')), [1, 60, 3600]) IF x[1] IS NOT NULL])::BIGINT END"
)
TIMED_SQL = f"""timed AS (
  SELECT video_id, cue_index, second, text FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id, cue_index ORDER BY second, text) AS k FROM (
      SELECT video_id, cue_index::BIGINT AS cue_index, {SECONDS_SQL} AS second, {CAPTION_SQL} AS text FROM cues
    ) WHERE second IS NOT NULL AND text <> '') WHERE k = 1)"""


@query(f"""
WITH t AS (SELECT doc_id, trim(w, '.-_') AS term, i FROM (SELECT doc_id, unnest({TERM_SQL}) AS w, generate_subscripts({TERM_SQL}, 1) AS i FROM documents)),
c AS (SELECT doc_id, term, count(*) AS n, min(i) AS first FROM t WHERE term <> '' AND term NOT IN ({STOP}) AND NOT regexp_full_match(term, '[0-9]+') GROUP BY ALL)
SELECT doc_id, rank, term, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 10
""")
def kw_topk_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.keywords(table(spark, sf, "documents"), ["doc_id"], "text", 10)


@query(f"""
WITH t AS (SELECT trim(unnest({TERM_SQL}), '.-_') AS term FROM documents)
SELECT term, count(*) AS n FROM t WHERE term <> '' AND term NOT IN ({STOP}) AND NOT regexp_full_match(term, '[0-9]+') GROUP BY 1 ORDER BY n DESC, term LIMIT 25
""")
def kw_corpus_topk(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.corpus_keywords(table(spark, sf, "documents"), "text", 25)


@query(f"""
SELECT video_id, cue_index, second, printf('%02d:%02d:%02d', second // 3600, second % 3600 // 60, second % 60) AS code FROM (SELECT video_id, cue_index, {SECONDS_SQL} AS second FROM cues) WHERE second IS NOT NULL
""")
def ts_format_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "cues").select("video_id", "cue_index", seconds(F.col("ts")).alias("second"))
    return s.where("second is not null").select("video_id", "cue_index", "second", code(F.col("second")).alias("code"))


@query("""
SELECT id, CASE WHEN coalesce(duration, 0) = 0 THEN 'N/D' WHEN floor(duration) >= 3600 THEN printf('%d:%02d:%02d', floor(duration)::BIGINT // 3600, floor(duration)::BIGINT % 3600 // 60, floor(duration)::BIGINT % 60)
ELSE printf('%d:%02d', floor(duration)::BIGINT // 60, floor(duration)::BIGINT % 60) END AS label FROM library
""")
def duration_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "library").select("id", T.duration_label(F.col("duration")).alias("label"))


@query("""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, t, string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS marked, string_split(regexp_replace(t, '\\s+(Entonces|Ahora|Bien|Primero|Segundo|Tercero|Si vos|La idea)([^\\p{L}\\p{N}_]|$)', chr(1) || '\\1\\2', 'g'), chr(1)) AS spoken FROM t)
SELECT doc_id, s AS sentence FROM (SELECT doc_id, trim(unnest(CASE WHEN len(marked) = 1 THEN spoken ELSE marked END)) AS s FROM p) WHERE length(s) >= 50
""")
def sentence_split_long(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))


CONTENT_SQL = "list_distinct(list_filter([trim(w, '.-_') FOR w IN regexp_extract_all(lower(COLUMN), '" + L.TERM + "') IF NOT regexp_full_match(w, '[0-9]+')], lambda w: w NOT IN (" + STOP + ")))"


@query(f"""
WITH a AS (SELECT question_id, {CONTENT_SQL.replace('COLUMN', 'question')} AS x, {CONTENT_SQL.replace('COLUMN', 'answer')} AS y FROM (SELECT DISTINCT question_id, question, answer FROM study_questions WHERE question IS NOT NULL AND answer IS NOT NULL))
SELECT question_id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(x || y)), 9) END AS shared FROM a
""")
def token_set_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "study_questions").where("question is not null and answer is not null").select("question_id", "question", "answer").distinct()
    return rows.select("question_id", F.round(T.jaccard(T.content_tokens(F.col("question")), T.content_tokens(F.col("answer"))), 9).alias("shared"))


@query("""
SELECT doc_id, list_sort(list_distinct([trim(regexp_replace(w, '[^a-záéíóúñü]', '', 'g')) FOR w IN regexp_extract_all(regexp_replace(' ' || lower(text) || ' ', '([^\\p{L}\\p{N}_])', '\\1\\1', 'g'), '[^\\p{L}\\p{N}_](no|sin|nunca|jamás|tampoco|ni)[^\\p{L}\\p{N}_]')]))::VARCHAR AS negations
FROM documents WHERE text IS NOT NULL
""")
def negation_markers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.concat(F.lit("["), F.array_join(T.negations(F.col("text")), ", "), F.lit("]")).alias("negations"))


@query(f"""
SELECT video_id, cue_index, second,
 (len({CONTENT_SQL.replace('COLUMN', 'text')}) * 3.0 / greatest(w, 1) + least(w, 60) / 60.0 + 1.0 / (cue_index + 2) - CASE WHEN w < 10 THEN 3 ELSE 0 END - least(4.0, 1.25 * f)).round(6) AS score
FROM (SELECT *, len(regexp_extract_all(lower(text), '[a-záéíóúñü0-9_.-]+')) AS w,
  len(regexp_extract_all(regexp_replace(' ' || lower(text) || ' ', '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '[^\\p{{L}}\\p{{N}}_](eh|em|mmm+)[^\\p{{L}}\\p{{N}}_]'))
  + len(regexp_extract_all(' ' || lower(text) || ' ', '[^\\p{{L}}\\p{{N}}_]bueno\\s*[,;:]?\\s+bueno[^\\p{{L}}\\p{{N}}_]')) + len(regexp_extract_all(lower(text), '(^|(^|[^\\p{{L}}\\p{{N}}_])(eh|bueno)\\s*[,;:]?\\s+)a ver\\s*[,;:]')) AS f FROM (WITH {TIMED_SQL} SELECT * FROM timed))
""")
def filler_and_text_score(spark: SparkSession, sf: str) -> DataFrame:
    return timed_cues(spark, sf).select("video_id", "cue_index", "second", F.round(T.text_score(F.col("text"), F.lit(0), F.col("cue_index")), 6).alias("score"))


def word_sql(*words: str) -> str:
    """A pattern for whole words, whose edges RE2 has to be given."""
    return "(^|[^\\p{L}\\p{N}_])(" + "|".join(words) + ")([^\\p{L}\\p{N}_]|$)"


def noise_sql(text: str) -> str:
    """Whether a text is noise: see functions.text.is_noise."""
    t = f"trim(regexp_replace(lower({text}), '\\s+', ' ', 'g'))"
    stage = "\\[(música|musica|aplausos?|risas?|silencio)\\]"
    bare = f"regexp_replace({t}, '{stage}', '', 'g')"
    words = lambda x: f"len(regexp_extract_all({x}, '[a-záéíóúñü0-9]+'))"
    rest = f"regexp_replace(regexp_replace(' ' || {bare} || ' ', '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '([^\\p{{L}}\\p{{N}}_])(bueno|ahora  sí|comenzamos|empezamos|comenzar|empezar)([^\\p{{L}}\\p{{N}}_])', '\\1\\3', 'g')"
    has = lambda *w: f"regexp_matches({t}, '{word_sql(*w)}')"
    promotion = " AND ".join([has("recuerd[\\p{L}\\p{N}_]*", "no olvid[\\p{L}\\p{N}_]*"), has("suscrib[\\p{L}\\p{N}_]*"), f"contains({t}, 'al canal')", has("activar las notificaciones?")])
    production = " AND ".join([has("esperen", "espera(d)?", "un momento"), has("revisar", "probar", "comprobar"), has("sonido", "audio", "micrófono", "microfono")])
    passing = " AND ".join([has("creo que se entiende", "no sé"), has("seguimos con otra cosa", "pasamos a otra cosa")])
    return f"(NOT regexp_matches({bare}, '[a-záéíóúñü0-9]') OR ({words(t)} <= 28 AND ((regexp_matches({t}, '{stage}') AND {words(rest)} <= 1) OR ({promotion}) OR ({production}) OR ({passing}))))"


#: Sentences of each kind of noise, and some that are none, beside the cues.
NOISE_CASES = (
    "Recuerden suscribirse al canal y activar las notificaciones", "No olviden que se suscriben al canal y activar la notificación", "No olvides suscribirte al canal, activar la notificacion", "Un momento, hay que probar el micrófono", "Esperen que voy a revisar el audio",
    "El audio se puede probar", "Creo que se entiende, pasamos a otra cosa", "No sé, seguimos con otra cosa", "no sé qué otra cosa", "[Música] Bueno, ahora sí, comenzamos", "[música] ahora sí hablamos de bombas", "...",
)


@query("WITH t AS (SELECT video_id, cue_index, text FROM cues WHERE text IS NOT NULL UNION ALL SELECT 'case', k, t FROM (SELECT unnest([" + ", ".join("'" + x + "'" for x in NOISE_CASES) + "]) AS t, generate_subscripts([" + ", ".join("'" + x + "'" for x in NOISE_CASES) + "], 1) AS k)) SELECT video_id, cue_index, count(*) AS copies FROM t WHERE " + noise_sql("text") + " GROUP BY ALL")
def noise_flags(spark: SparkSession, sf: str) -> DataFrame:
    cases = spark.createDataFrame([("case", k + 1, t) for k, t in enumerate(NOISE_CASES)], "video_id string, cue_index int, text string")
    rows = table(spark, sf, "cues").where("text is not null").select("video_id", "cue_index", "text").unionByName(cases)
    return rows.where(T.is_noise(F.col("text"))).groupBy("video_id", "cue_index").agg(F.count("*").alias("copies"))


@query("""
WITH alias AS (SELECT lower(name) AS name, description, category, unnest(list_append([lower(a) FOR a IN coalesce(aliases, [])], lower(name))) AS alias FROM tools),
runs AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_.-]+')) AS alias FROM documents)
SELECT doc_id, name, count(*) AS n, description, category FROM runs JOIN alias USING (alias) GROUP BY ALL
""")
def tool_mentions_known(spark: SparkSession, sf: str) -> DataFrame:
    return tools.known_tools(table(spark, sf, "documents"), ["doc_id"], "text", table(spark, sf, "tools"))


EDGE_SQL = "[^\\p{L}\\p{N}_]"
#: f: every name of a tool's shape in d (key, o, text): key, o, shape, pos, name. Marks that names can't hold are doubled, so that two names may share one.
SHAPES_SQL = "f AS (" + " UNION ALL ".join(
    f"SELECT key, o, {k} AS shape, unnest(x) AS name, generate_subscripts(x, 1) AS pos FROM (SELECT key, o, regexp_extract_all(' ' || regexp_replace(text, '({inside})', '\\1\\1', 'g') || ' ', '(?:{EDGE_SQL})({shape})(?:{EDGE_SQL})', 1) AS x FROM d)"
    for k, (shape, inside) in enumerate((("[a-zA-Z][a-zA-Z0-9]*(?:[.-][a-zA-Z0-9]+)+", "[^\\p{L}\\p{N}_.-]"), ("[A-Z]{2,8}", "[^\\p{L}\\p{N}_]"), ("[A-Z][a-z]+(?:[A-Z][a-z0-9]+)+", "[^\\p{L}\\p{N}_]")))
) + ")"
UNKNOWN_SQL = SHAPES_SQL + f""", c AS (SELECT key, name, count(*) AS n, min((shape, o, pos)) AS first FROM f GROUP BY key, name HAVING count(*) >= 2),
u AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, first) AS r FROM c WHERE trim(lower(name), '.-') NOT IN ({STOP}) AND name NOT IN ({quoted(L.IGNORED_CANDIDATES)}) AND trim(lower(name), '.-') NOT IN (SELECT lower(name) FROM tools))"""


@query(f"WITH d AS (SELECT lower(trim(source)) AS key, doc_id AS o, text FROM documents WHERE source IS NOT NULL), {UNKNOWN_SQL} SELECT key AS source, name, n FROM u")
def unknown_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("source is not null").select(F.lower(F.trim("source")).alias("source"), "text", "doc_id")
    return tools.unknown_tools(rows, ["source"], "text", table(spark, sf, "tools"), limit=2**31 - 1, order="doc_id").drop("rank")


@query(f"""
WITH d AS (SELECT lower(trim(source)) AS key, doc_id AS o, text FROM documents WHERE source IS NOT NULL), {UNKNOWN_SQL},
alias AS (SELECT lower(name) AS name, unnest(list_append([lower(a) FOR a IN coalesce(aliases, [])], lower(name))) AS alias FROM tools),
runs AS (SELECT key, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_.-]+')) AS alias FROM d),
k AS (SELECT key, name, count(*) AS n FROM runs JOIN alias USING (alias) GROUP BY ALL)
SELECT key AS source, row_number() OVER (PARTITION BY key ORDER BY kind <> 'known', n DESC, name) AS rank, name, n, kind FROM (SELECT key, name, n, 'known' AS kind FROM k UNION ALL SELECT key, name, n, 'unknown' FROM u WHERE r <= 8)
""")
def tool_mentions_ranked(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("source is not null").select(F.lower(F.trim("source")).alias("source"), "text", "doc_id")
    return tools.tool_mentions(rows, ["source"], "text", table(spark, sf, "tools"), order="doc_id").select("source", "rank", "name", "n", "kind")


@query("""
WITH t AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 // 300 * 300 AS bucket, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events),
g AS (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM bucket THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY o) AS chunk FROM (SELECT *, lag(bucket) OVER (PARTITION BY user_id ORDER BY o) AS p FROM t))
SELECT user_id, chunk::BIGINT AS chunk, count(*) AS n, printf('%02d:%02d:%02d', bucket // 3600, bucket % 3600 // 60, bucket % 60) AS start FROM g GROUP BY user_id, chunk, bucket
""")
def chunk_runs_5min(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", F.struct("ts", "event_id").alias("o"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), F.lit("").alias("text"))
    return captions.chunks(rows, ["user_id"], "o", "second", "text").select("user_id", "chunk", "n", "start")


@query(f"""
WITH {TIMED_SQL}, b AS (SELECT *, second // 300 * 300 AS bucket FROM timed), g AS (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM bucket THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY cue_index) AS chunk FROM (SELECT *, lag(bucket) OVER (PARTITION BY video_id ORDER BY cue_index) AS p FROM b))
SELECT video_id, chunk::BIGINT AS chunk, printf('%02d:%02d:%02d', bucket // 3600, bucket % 3600 // 60, bucket % 60) AS start, md5(string_agg(text, ' ' ORDER BY cue_index)) AS digest FROM g GROUP BY video_id, chunk, bucket
""")
def transcript_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return captions.chunks(timed_cues(spark, sf), ["video_id"], "cue_index", "second", "text").select("video_id", "chunk", "start", F.md5("text").alias("digest"))


@query("""
WITH g AS (SELECT *, sum(CASE WHEN epoch_us(ts) // 1000000 - epoch_us(p) // 1000000 <= 21600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
SELECT user_id, session::BIGINT AS session, count(*) AS n FROM g GROUP BY ALL
""")
def gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return captions.sessions(rows, ["user_id"], "ts", 21600).select("user_id", F.col("session").cast("bigint"), "n")


@query(f"SELECT video_id, cue_index, {CAPTION_SQL} AS text FROM cues WHERE text IS NOT NULL")
def caption_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "cues").where("text is not null").select("video_id", "cue_index", T.caption_text(F.col("text")).alias("text"))


@query("""
WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(replace(lower(text), chr(10), ' ; '), '[,;:!?…—–]|\\s-\\s')) AS s, generate_subscripts(regexp_split_to_array(replace(lower(text), chr(10), ' ; '), '[,;:!?…—–]|\\s-\\s'), 1) AS k FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, k, regexp_extract_all(s, '[a-záéíóúñü0-9]+(?:[.-][a-záéíóúñü0-9]+)*') AS t FROM s),
g AS (SELECT doc_id, list_aggregate(t[i:i + n - 1], 'string_agg', ' ') AS name FROM t, range(1, 4) r(n), LATERAL (SELECT unnest(range(1, len(t) - n + 2)) AS i))
SELECT name, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY 1 HAVING count(*) >= 3
""")
def ngram_counts_1_3(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", F.lit(0).alias("unit"), F.lit(0).alias("second"), F.replace(F.lower("text"), F.lit("\n"), F.lit(" ; ")).alias("text"))
    return concepts.ngrams(rows, ["doc_id"]).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).where("n >= 3")


@query(f"""
WITH {TIMED_SQL}, p AS (SELECT video_id, cue_index, regexp_split_to_array(text, '(?i)\\s+(?:porque|ya que|debido a que)\\s+') AS p FROM timed), c AS (SELECT video_id, cue_index, trim(p[1], ' .,:;') AS claim FROM p WHERE len(p) >= 2)
SELECT video_id, cue_index, '¿Por qué se afirma que ' || CASE WHEN contains(split_part(claim, ' ', 1), '.') OR regexp_matches(split_part(claim, ' ', 1), '^.+\\p{{Lu}}') THEN claim ELSE lower(claim[1:1]) || claim[2:] END || '?' AS question
FROM c WHERE len(regexp_extract_all(lower(claim), '[a-záéíóúñü0-9]+')) BETWEEN 3 AND 18
""")
def causal_questions(spark: SparkSession, sf: str) -> DataFrame:
    return timed_cues(spark, sf).select("video_id", "cue_index", T.causal_question(F.col("text")).alias("question")).where("question is not null")


def valid_sql(w: str) -> str:
    return f"({w} <> '' AND {w} NOT IN ({quoted(set(L.STOPWORDS) | set(L.TOPIC_EXCLUDED))}) AND NOT regexp_full_match({w}, '[0-9]+'))"


@query(f"""
WITH q AS (SELECT DISTINCT question_id, [trim(w, '.-_') FOR w IN regexp_extract_all(lower(question), '{L.TERM}')] AS t FROM study_questions WHERE question IS NOT NULL),
e AS (SELECT question_id, t, list_min([k FOR k IN range(1, len(t) + 1) IF {valid_sql('t[k]')}]) AS k0 FROM q),
s AS (SELECT question_id, t, k0, coalesce(list_min([k FOR k IN range(k0 + 1, len(t) + 1) IF t[k] IN ({quoted(L.TOPIC_ENDS)})]), len(t) + 1) AS stop FROM e),
w AS (SELECT question_id, [t[k] FOR k IN range(k0, stop) IF {valid_sql('t[k]')} AND list_position(t, t[k]) = k][1:3] AS w FROM s)
SELECT question_id, CASE WHEN w IS NULL OR len(w) = 0 THEN 'este tema' ELSE array_to_string(w, ' ') END AS topic FROM w
""")
def question_topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "study_questions").where("question is not null").select("question_id", T.question_topic(F.col("question")).alias("topic")).distinct()


LINES_SQL = f"WITH {TIMED_SQL}, l AS (SELECT video_id, cue_index AS line_no, printf('[%02d:%02d:%02d] ', second // 3600, second % 3600 // 60, second % 60) || text AS line FROM timed)"


def transcript(spark: SparkSession, sf: str) -> DataFrame:
    return captions.transcript_lines(timed_cues(spark, sf)).withColumnRenamed("cue_index", "line_no")


@query(f"""{LINES_SQL}, w AS (SELECT *, lag(line) OVER (PARTITION BY video_id ORDER BY line_no) AS b, lead(line) OVER (PARTITION BY video_id ORDER BY line_no) AS a FROM l)
SELECT video_id, line_no, line[2:instr(line, ']') - 1] AS timestamp, ltrim(line[instr(line, ']') + 1:]) AS line, coalesce(b, '') AS before, coalesce(a, '') AS after FROM w WHERE contains(lower(line), 'impresora')""")
def search_context(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.search(transcript(spark, sf), "Impresora", limit=None, context=1)
    return hits.select("video_id", "line_no", "timestamp", "line", F.array_join("before", " ").alias("before"), F.array_join("after", " ").alias("after"))


@query(f"""{LINES_SQL}, latest AS (SELECT id, title, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY try_cast(updated_at AS timestamptz) DESC NULLS LAST, path DESC NULLS LAST, title DESC NULLS LAST) AS k FROM library WHERE id IS NOT NULL) WHERE k = 1), v AS (SELECT id, title, row_number() OVER (ORDER BY coalesce(updated_at, '') DESC, id) AS place FROM latest)
SELECT video_id, line_no FROM l JOIN v ON id = video_id WHERE contains(lower(line), 'aluminio') ORDER BY place, video_id, line_no LIMIT 40""")
def search_global_limit(spark: SparkSession, sf: str) -> DataFrame:
    entries = library.latest(table(spark, sf, "library")).select("id", "title", "updated_at")
    return search.search(transcript(spark, sf), "aluminio", library=entries, limit=40).select("video_id", "line_no")


LATEST_SQL = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY try_cast(updated_at AS timestamptz) DESC NULLS LAST, path DESC NULLS LAST, title DESC NULLS LAST, channel DESC NULLS LAST, duration DESC NULLS LAST, url DESC NULLS LAST, tools DESC NULLS LAST) AS k FROM library WHERE id IS NOT NULL) WHERE k = 1)"""


@query(f"WITH {LATEST_SQL} SELECT id, path, title, channel, duration, url, updated_at FROM latest")
def library_latest(spark: SparkSession, sf: str) -> DataFrame:
    return library.latest(table(spark, sf, "library")).select("id", "path", "title", "channel", "duration", "url", "updated_at")


@query(f"""WITH {LATEST_SQL}, n AS (SELECT c_custkey::VARCHAR AS id, c_name AS title FROM customer UNION ALL SELECT id, title || ' (2)' FROM latest WHERE duration > 300)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.title, o.title) AS title, CASE WHEN n.id IS NULL THEN o.created_at ELSE coalesce(o.created_at, '{NOW}') END AS created_at, CASE WHEN n.id IS NULL THEN o.updated_at ELSE '{NOW}' END AS updated_at
FROM latest o FULL JOIN n ON n.id = o.id""")
def library_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = library.latest(table(spark, sf, "library"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("channel", "string"), ("duration", "double"), ("url", "string"))]
    new = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), *none, F.lit("p").alias("path"), F.array().cast("array<string>").alias("tools"))
    again = old.where("duration > 300").select("id", F.concat("title", F.lit(" (2)")).alias("title"), "channel", "duration", "url", F.coalesce("path", F.lit("p")).alias("path"), "tools")
    return library.upsert(old, new.unionByName(again), NOW).select("id", "title", "created_at", "updated_at")


@query(f"""WITH {LATEST_SQL}, f AS (SELECT *, CASE WHEN duration > 300 THEN duration + 1 ELSE duration END AS d FROM latest WHERE path IS NOT NULL)
SELECT id, d AS duration, coalesce(created_at, '{NOW}') AS created_at, CASE WHEN duration IS NOT DISTINCT FROM d THEN coalesce(updated_at, '{NOW}') ELSE '{NOW}' END AS updated_at FROM f""")
def library_rebuild_merge(spark: SparkSession, sf: str) -> DataFrame:
    old = library.latest(table(spark, sf, "library"))
    old = old.withColumn("tools", F.coalesce("tools", F.array().cast("array<string>")))
    found = old.where("path is not null").select(*[c for c in library.FIELDS if c not in ("duration", "tools")], F.when(F.col("duration") > 300, F.col("duration") + 1).otherwise(F.col("duration")).alias("duration"), F.lit(None).cast("array<string>").alias("tools"))
    return library.rebuilt(found, old, NOW).select("id", "duration", "created_at", "updated_at")


@query("""
SELECT id, url, path, reason FROM (SELECT id, url, path, CASE WHEN coalesce(id, '') = '' THEN '''id'' debe ser texto no vacío' WHEN coalesce(path, '') = '' THEN '''path'' debe ser texto no vacío' WHEN title = '' THEN '''title'' debe ser texto no vacío'
  WHEN duration < 0 THEN '''duration'' debe ser un número no negativo o null' WHEN list_bool_or([coalesce(t, '') = '' FOR t IN tools]) THEN '''tools'' debe ser una lista de textos no vacíos'
  WHEN created_at = '' THEN '''created_at'' debe ser texto no vacío' WHEN updated_at = '' THEN '''updated_at'' debe ser texto no vacío' END AS reason FROM library)
""")
def library_validate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "library")
    checked = library.validated(rows.select("url", F.to_json(F.struct("id", "title", "channel", "duration", "url", "path", "tools", "created_at", "updated_at")).alias("value")))
    return checked.select("id", "url", "path", "reason")


#: Tracks of one video each, as candidates: several that are asked for, originals and translations, English, and nothing that fits.
TRACKS = (
    ("a", "es", "automatic", False, 10), ("a", "es-419", "manual", False, 5), ("a", "en", "manual", False, 90), ("b", "es", "manual", True, 1), ("b", "es-orig", "automatic", False, 1), ("b", "fr", "manual", False, 2), ("c", "es-orig", "automatic", False, 1),
    ("c", "es", "automatic", False, 1), ("c", "fr", "automatic", False, 7), ("d", "en", "unknown", False, 3), ("d", "en-GB", "manual", False, 2), ("d", "pt", "manual", False, 900), ("e", "it", "manual", False, 4), ("e", "pt", "manual", False, 9), ("e", "de", "manual", False, 9),
    ("f", "es", "automatic", True, 1), ("f", "fr", "unknown", False, 1), ("g", "fr-CA", "unknown", False, 1), ("g", "es", "unknown", False, 1), ("h", "fr", "manual", False, 1), ("h", "es-MX", "manual", False, 1),
)
TRACKS_SQL = ", ".join(f"('{v}', 'd/{v}.{x}.vtt', '{x}', '{k}', {t}, {n})" for v, x, k, t, n in TRACKS)
RANK_SQL = "CASE WHEN lower(language) = '{0}' THEN 0 WHEN lower(language) = '{0}-orig' THEN 1 WHEN base = '{0}' THEN 2 ELSE 99 END"


@query(f"""
WITH r AS (SELECT *, lower(split_part(regexp_replace(language, '-orig$', ''), '-', 1)) AS base FROM (VALUES {TRACKS_SQL}) t(video_id, path, language, kind, tr, size)),
a AS (SELECT *, {RANK_SQL.format('es')} AS r0, {RANK_SQL.format('fr')} AS r1, array_position(['manual', 'automatic', 'unknown'], kind) AS k FROM r),
t AS (SELECT *, CASE WHEN r0 < 99 THEN 0 WHEN r1 < 99 THEN 1 END AS ask, CASE WHEN r0 < 99 THEN r0 ELSE r1 END AS near FROM a),
u AS (SELECT *, CASE WHEN ask IS NULL THEN CASE WHEN base = 'en' THEN 5 ELSE 6 END WHEN kind = 'manual' AND NOT tr THEN 1 WHEN kind = 'automatic' AND NOT tr THEN 2 WHEN kind = 'automatic' THEN 3 WHEN kind = 'unknown' AND NOT tr THEN 4 WHEN base = 'en' THEN 5 ELSE 6 END AS tier FROM t)
SELECT video_id, path, tier FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY tier, CASE WHEN tier <= 4 THEN ask WHEN tier = 5 THEN k ELSE -size END, CASE WHEN tier <= 4 THEN near WHEN tier = 5 THEN tr::INT ELSE 0 END, path) AS n FROM u) WHERE n = 1
""")
def subtitle_choice_of_several(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(v, f"d/{v}.{x}.vtt", x, k, t, None, n) for v, x, k, t, n in TRACKS]
    df = spark.createDataFrame(rows, "video_id string, path string, language string, kind string, is_translation boolean, source_language string, size bigint")
    tier = F.array_position(F.array(*[F.lit(r) for r in subtitles.REASONS]), F.col("reason")) - 1
    return subtitles.choose(df, ["es", "fr"]).select("video_id", "path", tier.cast("int").alias("tier"))


@query("""
WITH c AS (SELECT DISTINCT video_id, path, coalesce(language, '') AS language, kind, coalesce(is_translation, false) AS tr FROM subtitles),
r AS (SELECT *, lower(split_part(regexp_replace(language, '-orig$', ''), '-', 1)) AS base FROM c), a AS (SELECT *, CASE WHEN base IN ('es', 'fr') THEN true ELSE false END AS asked FROM r)
SELECT video_id, path, CASE WHEN asked AND kind = 'manual' AND NOT tr THEN 1 WHEN asked AND kind = 'automatic' AND NOT tr THEN 2 WHEN asked AND kind = 'automatic' THEN 3 WHEN asked AND kind = 'unknown' AND NOT tr THEN 4 WHEN base = 'en' THEN 5 ELSE 6 END AS tier FROM a
""")
def subtitle_choice(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "subtitles").select("video_id", "path", F.coalesce("language", F.lit("")).alias("language"), "kind", F.coalesce("is_translation", F.lit(False)).alias("is_translation"), "source_language", F.lit(0).alias("size")).distinct()
    chosen = subtitles.choose(rows, ["es", "fr"])
    tier = F.array_position(F.array(*[F.lit(r) for r in subtitles.REASONS]), F.col("reason")) - 1
    return chosen.select("video_id", "path", tier.cast("int").alias("tier"))


@query("""
SELECT id, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 't=' || floor(duration)::BIGINT AS at FROM library WHERE regexp_matches(url, '^https?://') AND duration IS NOT NULL
""")
def url_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "library").where("duration is not null").select("id", T.url_at(F.col("url"), F.floor("duration").cast("bigint")).alias("at")).where("at is not null")


@query("""
SELECT id, trim(regexp_replace(strip_accents(lower(replace(title, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g')) AS folded, contains(' ' || trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', ' ', 'g')) || ' ', ' camara trasera ') AS named FROM library WHERE title IS NOT NULL
""")
def accent_fold_match(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "library").where("title is not null").select("id", T.folded(F.col("title")).alias("folded"), T.contains_alias(F.col("title"), F.lit("Cámara  TRASERA")).alias("named"))


@query("""
WITH j AS (SELECT event_id, json_type(props) AS kind FROM events WHERE props IS NOT NULL) SELECT kind, count(*) AS n FROM j GROUP BY 1
""")
def json_validate(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.regexp_extract(F.schema_of_variant(F.try_parse_json("props")), r"^(\w+)", 1)
    return table(spark, sf, "events").where("props is not null").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


FOLDED_SQL = f"WITH RECURSIVE {TIMED_SQL},{OVERLAP_SQL}"


@query(f"{FOLDED_SQL} SELECT video_id, cue_index, second, text FROM said")
def rolling_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return captions.without_overlap(timed_cues(spark, sf))


def informative_units(spark: SparkSession, sf: str) -> DataFrame:
    return cut(units.informative(units.sentence_units(timed_cues(spark, sf), overlap=True)))


@query(f"{FOLDED_SQL},{UNITS_SQL} SELECT video_id, position, part, second, text, to_json(fragments)::VARCHAR AS fragments FROM packed_units WHERE NOT {noise_sql('text')}")
def sentence_units(spark: SparkSession, sf: str) -> DataFrame:
    return informative_units(spark, sf).withColumn("fragments", F.to_json("fragments"))


@query(f"""{FOLDED_SQL},{UNITS_SQL}, kept AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY position, part) AS k, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS n FROM packed_units WHERE NOT {noise_sql('text')}),
w AS (SELECT video_id, k, position, part, second, text, fragments, n AS words, 1 AS size, 1 AS win FROM kept WHERE k = 1 UNION ALL
  SELECT video_id, k, position, part, second, text, fragments, CASE WHEN fresh THEN n ELSE words + n END, CASE WHEN fresh THEN 1 ELSE size + 1 END, win + fresh::INT
  FROM (SELECT x.*, w.words, w.size, w.win, w.size >= 3 OR w.words + x.n > 90 OR x.second - w.fragments[-1].second > 15 AS fresh FROM w JOIN kept x ON x.video_id = w.video_id AND x.k = w.k + 1))
SELECT video_id, first(position ORDER BY k) AS position, first(part ORDER BY k) AS part, first(second ORDER BY k) AS second, string_agg(text, ' ' ORDER BY k) AS text, to_json(flatten(list(fragments ORDER BY k)))::VARCHAR AS fragments FROM w GROUP BY video_id, win""")
def windows_of_all(spark: SparkSession, sf: str) -> DataFrame:
    """Windows with repetitions left in."""
    return units.windows(informative_units(spark, sf), distinct=False).withColumn("fragments", F.to_json("fragments"))


KEPT_SQL = f"kept AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY position, part) AS k, position, part, second, text, fragments, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS n FROM packed_units WHERE NOT {noise_sql('text')})"
WINDOWS_SQL = f"{FOLDED_SQL},{UNITS_SQL}, {KEPT_SQL},{distinct_windows_sql(CONTENT_SQL.replace('COLUMN', 'text'), '|'.join(L.NEGATIONS))}"


@query(f"{WINDOWS_SQL} SELECT video_id, position, part, second, text, to_json(fragments)::VARCHAR AS fragments FROM wins")
def packed_windows(spark: SparkSession, sf: str) -> DataFrame:
    return units.windows(informative_units(spark, sf)).withColumn("fragments", F.to_json("fragments"))


IDEAS_SQL = f"{WINDOWS_SQL},{ideas_sql(L.TERM, STOP, CONTENT_SQL.replace('COLUMN', 'text'), '|'.join(L.NEGATIONS))}"


@query(f"{IDEAS_SQL} SELECT video_id, rank, position, part, second, text, to_json(fragments)::VARCHAR AS fragments FROM ideas")
def ideas_topk(spark: SparkSession, sf: str) -> DataFrame:
    return ideas.ideas(informative_units(spark, sf)).withColumn("fragments", F.to_json("fragments"))


SECTIONS_SQL = f"{FOLDED_SQL},{UNITS_SQL}, {KEPT_SQL},{sections_sql(L.TERM, STOP, CONTENT_SQL.replace('COLUMN', 'text'), '|'.join(L.NEGATIONS), '|'.join(L.SENTENCE_OPENERS))}"


@query(f"{SECTIONS_SQL} SELECT * FROM sections")
def section_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return ideas.sections(informative_units(spark, sf)).withColumn("sentences", F.array_join("sentences", " | "))


def numbered(found: DataFrame) -> DataFrame:
    return units.in_order(found)


CONCEPTS_SQL = concepts_sql(STOP, quoted(L.GENERIC_TERMS), quoted(L.GENERIC_ACTIONS), quoted(L.CONNECTORS), quoted(L.DETERMINERS), quoted(L.DESCRIPTORS), L.DESCRIPTIVE_ENDING)


@query(f"{FOLDED_SQL},{UNITS_SQL}, packed AS (SELECT * EXCLUDE (unit), position * 1048576 + part AS unit FROM packed_units WHERE NOT {noise_sql('text')}),{CONCEPTS_SQL} SELECT * FROM chosen")
def concept_select_topk(spark: SparkSession, sf: str) -> DataFrame:
    return concepts.concepts(numbered(informative_units(spark, sf)), ["video_id"]).withColumn("timestamps", F.array_join("timestamps", " "))


@query()
def review_questions(spark: SparkSession, sf: str) -> DataFrame:
    from .plans.analysis import analyze

    return analyze(timed_cues(spark, sf), table(spark, sf, "tools"))["questions"].withColumn("fragments", F.to_json("fragments"))


@query()
def review_cards(spark: SparkSession, sf: str) -> DataFrame:
    from .plans.analysis import analyze

    return analyze(timed_cues(spark, sf), table(spark, sf, "tools"))["cards"].withColumn("fragments", F.to_json("fragments"))


@query(f"""
WITH {TIMED_SQL}, p AS (SELECT video_id, cue_index, regexp_split_to_array(text, '(?i)\\s+cuando\\s+') AS p FROM timed), c AS (SELECT video_id, cue_index, trim(p[1], ' .,:;') AS claim FROM p WHERE len(p) >= 2)
SELECT video_id, cue_index, '¿En qué situación se afirma que ' || CASE WHEN contains(split_part(claim, ' ', 1), '.') OR regexp_matches(split_part(claim, ' ', 1), '^.+\\p{{Lu}}') THEN claim ELSE lower(claim[1:1]) || claim[2:] END || '?' AS question
FROM c WHERE len(regexp_extract_all(lower(claim), '[a-záéíóúñü0-9]+')) BETWEEN 3 AND 18
""")
def conditional_questions(spark: SparkSession, sf: str) -> DataFrame:
    return timed_cues(spark, sf).select("video_id", "cue_index", T.conditional_question(F.col("text")).alias("question")).where("question is not null")


# Numbers next to each other with one mark between them pair up from the left: 1.2.3 is 1.2 and 3.
@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS w, regexp_split_to_array(text, '[\\p{L}\\p{N}_]+') AS s FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(w) AS w, unnest(s[1:len(w)]) AS gap, generate_subscripts(w, 1) AS k FROM t),
d AS (SELECT *, regexp_full_match(w, '[0-9]+') AS d, coalesce(regexp_full_match(lag(w) OVER (PARTITION BY doc_id ORDER BY k), '[0-9]+'), false) AND gap IN ('.', ',') AND regexp_full_match(w, '[0-9]+') AS link FROM u),
c AS (SELECT *, sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS chain FROM d),
n AS (SELECT doc_id, w || coalesce(lead(gap) OVER x || lead(w) OVER x, '') AS number, row_number() OVER x AS pos FROM c WHERE d WINDOW x AS (PARTITION BY doc_id, chain ORDER BY k))
SELECT doc_id, coalesce(numbers, '') AS numbers FROM t LEFT JOIN (SELECT doc_id, array_to_string(list_sort(list_distinct(list(number))), ' ') AS numbers FROM n WHERE pos % 2 = 1 GROUP BY 1) USING (doc_id)
""")
def number_markers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.array_join(T.numbers(F.col("text")), " ").alias("numbers"))


@query("""
WITH t AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, regexp_extract_all(t, '[\\p{L}\\p{N}_]+') AS w, regexp_split_to_array(t, '[\\p{L}\\p{N}_]+') AS s FROM t),
p AS (SELECT doc_id, [w[k] FOR k IN range(1, len(w)) IF w[k] = w[k + 1] AND regexp_full_match(w[k], '[a-záéíóúñü]+') AND regexp_full_match(s[k + 1], '(\\s*[,;:]\\s*|\\s+)')] AS r FROM w)
SELECT doc_id, array_to_string(list_sort(list_distinct(r)), ' ') AS repeated FROM p
""")
def repetition_markers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.array_join(T.repetitions(F.col("text")), " ").alias("repeated"))


@query("""
WITH l AS (SELECT doc_id, [trim(x) FOR x IN string_split(text, chr(10))] AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(list_reduce(list_prepend('', l), lambda a, x: CASE WHEN a = '' OR starts_with(x, a) THEN x WHEN starts_with(a, x) THEN a ELSE a || ' ' || x END)) AS merged FROM l
""")
def caption_lines_merged(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(T.merged_lines(lines)).alias("merged"))


@query(f"""
WITH {TIMED_SQL}, t AS (SELECT * FROM timed WHERE NOT regexp_matches(text, '-->|^(WEBVTT|Kind:|Language:|NOTE)|^[0-9]+$')) -- what a file can't hold as text of a cue
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY cue_index) - 1 AS cue_index, second, md5(text) AS digest FROM t
""")
def vtt_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The cues of each video written as a WebVTT file and read again."""
    from .sources.artifacts import joined
    from .sources.files import parse_vtt

    rows = timed_cues(spark, sf)
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    # What looks like a tag once it is decoded would go.
    block = F.concat((F.col("cue_index") + 1).cast("string"), F.lit("\n"), code(F.col("second")), F.lit(".500 --> 99:00:00.000\n"), F.when(F.col("text").rlike("<[^>]+>"), F.col("text")).otherwise(escaped), F.lit("\n"))
    texts = joined(rows, ["cue_index"], block).select("video_id", F.concat(F.lit("WEBVTT\nKind: captions\n\n"), "text").alias("value"))
    return parse_vtt(texts, "video_id").select("video_id", "cue_index", "second", F.md5("text").alias("digest"))


@query(f"""
WITH {TIMED_SQL} SELECT video_id, md5(string_agg(printf('[%02d:%02d:%02d] ', second // 3600, second % 3600 // 60, second % 60) || text, chr(10) ORDER BY cue_index) || chr(10)) AS transcript, md5(string_agg(text, chr(10) ORDER BY cue_index) || chr(10)) AS clean FROM timed GROUP BY 1
""")
def transcript_files(spark: SparkSession, sf: str) -> DataFrame:
    from .sources.artifacts import joined

    rows = timed_cues(spark, sf)
    text = lambda with_time: joined(captions.transcript_lines(rows, with_time), ["cue_index"], F.col("line"))
    both = text(True).select("video_id", F.md5(F.concat("text", F.lit("\n"))).alias("transcript")).join(text(False).select("video_id", F.md5(F.concat("text", F.lit("\n"))).alias("clean")), "video_id")
    return both


@query(f"""
WITH {TIMED_SQL} SELECT video_id, cue_index, regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_.-])impresora($|[^\\p{{L}}\\p{{N}}_.-]|[.-]($|[^\\p{{L}}\\p{{N}}_]))') AS has
FROM timed WHERE contains(lower(text), 'impresora')
""")
def term_in_cue(spark: SparkSession, sf: str) -> DataFrame:
    rows = timed_cues(spark, sf).where(F.contains(F.lower("text"), F.lit("impresora")))
    return rows.select("video_id", "cue_index", T.has_term(F.col("text"), F.lit("Impresora")).alias("has"))


@query("""
WITH l AS (SELECT *, lower(trim(language)) AS low, lower(split_part(regexp_replace(trim(language), '-orig$', ''), '-', 1)) AS base FROM subtitles WHERE language IS NOT NULL)
SELECT video_id, language, kind, count(*) AS n, any_value(CASE WHEN low = 'es' THEN 0 WHEN low = 'es-orig' THEN 1 WHEN base = 'es' THEN 2 ELSE 99 END) AS rank,
  any_value(CASE WHEN kind = 'automatic' THEN coalesce(is_translation, CASE WHEN coalesce(source_language, '') <> '' THEN lower(split_part(regexp_replace(source_language, '-orig$', ''), '-', 1)) <> base ELSE video_id < 'M' END) ELSE false END) AS translated
FROM l GROUP BY video_id, language, kind, is_translation, source_language
""")
def subtitle_languages(spark: SparkSession, sf: str) -> DataFrame:
    """How near each track's language is to es, and whether it's a translation; a URL asks for one in some videos."""
    rows = table(spark, sf, "subtitles").where("language is not null").groupBy("video_id", "language", "kind", "is_translation", "source_language").agg(F.count("*").alias("n"))
    low = F.trim("language")
    url = F.concat(F.lit("https://v.example/api?tlang=&lang=es"), F.when(F.col("video_id") < "M", F.lit("&tlang=en&tlang=es#x")).otherwise(F.lit("#tlang=es")))
    return rows.select("video_id", "language", "kind", "n", subtitles.language_rank(low, F.lit("es")).alias("rank"), subtitles.is_translation(F.col("kind"), F.col("is_translation"), F.col("source_language"), low, url).alias("translated"))


@query("SELECT id, coalesce(len(tools), 0) AS n, tools IS NULL OR len(tools) = 0 OR list_contains(tools, 'vtt') AS readable FROM library")
def formats_readable(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "library").select("id", F.coalesce(F.size("tools"), F.lit(0)).cast("bigint").alias("n"), subtitles.has_vtt(F.col("tools")).alias("readable"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 1 THEN 1 ELSE least(power(2, greatest(l_quantity::INT - 1, 0)), 8) END::INT AS wait, array_to_string([x::INT FOR x IN regexp_extract_all(strftime(l_shipdate, '%Y.%m.%d'), '[0-9]+')], '-') AS parts FROM lineitem
""")
def waits_and_versions(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.array_join(T.version_parts(F.date_format("l_shipdate", "yyyy.MM.dd")).cast("array<string>"), "-")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.retry_seconds(F.col("l_quantity").cast("int")).alias("wait"), parts.alias("parts"))


FOLD_SQL = "trim(regexp_replace(strip_accents(lower(replace(title, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""
WITH f AS (SELECT id, title, ' ' || {FOLD_SQL} || ' ' AS t FROM library WHERE title IS NOT NULL)
SELECT id, title, (contains(t, ' camara trasera ') OR contains(t, ' impresora ')) AND (contains(t, ' video ') OR contains(t, ' la ') OR contains(t, ' le ')) AS fits, (len(t) - len(replace(t, ' la ', ''))) // 4 AS times FROM f
""")
def alias_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = F.array(F.array(F.lit("Cámara trasera"), F.lit("IMPRESORA")), F.array(F.lit("vídeo"), F.lit("la"), F.lit("le")))
    t = F.col("title")
    return table(spark, sf, "library").where("title is not null").select("id", "title", T.matches_groups(t, groups).alias("fits"), T.occurrences(t, F.lit("Là")).cast("bigint").alias("times"))


@query("""
WITH r AS (SELECT lower(trim(source)) AS source, n_chars > 400 AS said, contains(text, '?') AS has FROM documents WHERE source IS NOT NULL AND text IS NOT NULL AND n_chars IS NOT NULL),
c AS (SELECT source, sum((said AND has)::INT) AS hit, sum(said::INT) AS said, sum(has::INT) AS truth FROM r GROUP BY 1), p AS (SELECT source, CASE WHEN said = 0 THEN 0.0 ELSE hit / said END AS p, CASE WHEN truth = 0 THEN 0.0 ELSE hit / truth END AS r FROM c)
SELECT source, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM p
""")
def quality_prf1(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("source is not null and text is not null and n_chars is not null").select(F.lower(F.trim("source")).alias("source"), "n_chars", "text")
    got = quality.precision_recall(rows, ["source"], F.col("n_chars") > 400, F.contains("text", F.lit("?")))
    return got.select("source", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""
WITH c AS (SELECT video_id, card_id, min(question) AS question FROM flashcards WHERE question IS NOT NULL AND video_id IS NOT NULL GROUP BY 1, 2),
w AS (SELECT video_id, card_id, list_distinct([x FOR x IN string_split({FOLD_SQL.replace('title', 'question')}, ' ') IF x <> '']) AS w FROM c),
p AS (SELECT a.video_id, avg((len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) >= 0.72)::INT) AS rate FROM w a JOIN w b ON a.video_id = b.video_id AND a.card_id < b.card_id WHERE len(a.w) > 0 AND len(b.w) > 0 GROUP BY 1)
SELECT video_id, round(coalesce(rate, 0.0), 9) AS rate FROM (SELECT DISTINCT video_id FROM c) LEFT JOIN p USING (video_id)
""")
def duplicate_rate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "flashcards").where("question is not null and video_id is not null").groupBy("video_id", "card_id").agg(F.min("question").alias("question"))
    return quality.duplicate_rate(rows, "video_id", "question", "card_id").select("video_id", F.round("rate", 9).alias("rate"))


@query("""
WITH m AS (SELECT 'case:' || lower(trim(source)) AS location, avg((length(text) > 300)::INT) AS topic_coverage, avg((length(text) > 300)::INT) AS summary_duplicate_rate FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1),
a AS (SELECT location, 'topic_coverage' AS metric, round(topic_coverage, 6) AS actual FROM m UNION ALL SELECT location, 'summary_duplicate_rate', round(summary_duplicate_rate, 6) FROM m)
SELECT location, metric FROM a WHERE (metric = 'topic_coverage' AND actual < 0.5) OR (metric <> 'topic_coverage' AND actual > 0.5)
""")
def baseline_regressions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("source is not null and text is not null").groupBy(F.concat(F.lit("case:"), F.lower(F.trim("source"))).alias("location")).agg(F.round(F.avg((F.char_length("text") > 300).cast("int")), 6).alias("v"))
    actual = rows.select("location", F.col("v").alias("topic_coverage"), F.col("v").alias("summary_duplicate_rate")).unpivot(["location"], ["topic_coverage", "summary_duplicate_rate"], "metric", "value")
    return quality.regressions(actual, actual.withColumn("value", F.lit(0.5))).select("location", "metric")


@query(f"""
WITH {LATEST_SQL}, c AS (SELECT card_id, min((video_id, question, answer, coalesce(ts, ''), coalesce(tags, ''))) AS x FROM flashcards WHERE answer IS NOT NULL AND question IS NOT NULL AND video_id IS NOT NULL GROUP BY 1),
j AS (SELECT card_id, x[1] AS video_id, x[2] AS question, x[3] AS answer, x[4] AS ts, x[5] AS tags, channel, url FROM c LEFT JOIN latest ON id = x[1]),
s AS (SELECT *, {SECONDS_SQL} AS second FROM j),
u AS (SELECT *, CASE WHEN regexp_matches(url, '^https?://') AND second IS NOT NULL THEN regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 't=' || second END AS link FROM s)
SELECT card_id, question AS front, answer || CASE WHEN ts = '' THEN '' ELSE '<br><br>Referencia: ' || CASE WHEN link IS NULL THEN ts ELSE '<a href="' || replace(link, '&', '&amp;') || '">' || ts || '</a>' END END AS back,
  'video::' || video_id || CASE WHEN trim(coalesce(channel, '')) = '' THEN '' ELSE ' channel::' || regexp_replace(trim(channel), '\\s+', '_', 'g') END || CASE WHEN tags = '' THEN '' ELSE ' ' || tags END AS tags FROM u
""")
def anki_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Cards with their video's channel and URL; of differing deliveries of a card the least counts."""
    from .sources.artifacts import anki_card

    cards = table(spark, sf, "flashcards").where("answer is not null and question is not null and video_id is not null")
    one = cards.groupBy("card_id").agg(F.min(F.struct("video_id", "question", "answer", F.coalesce("ts", F.lit("")).alias("ts"), F.coalesce("tags", F.lit("")).alias("tags"))).alias("x")).select("card_id", "x.*")
    videos = library.latest(table(spark, sf, "library")).select(F.col("id").alias("video_id"), "channel", "url")
    return anki_card(one.join(videos, "video_id", "left")).select("card_id", "front", "back", "tags")


@query(f"""
WITH {LATEST_SQL} SELECT id, md5(coalesce(title, id) || '|' || CASE WHEN coalesce(duration, 0) = 0 THEN 'N/D' WHEN floor(duration) >= 3600 THEN printf('%d:%02d:%02d', floor(duration)::BIGINT // 3600, floor(duration)::BIGINT % 3600 // 60, floor(duration)::BIGINT % 60) ELSE printf('%d:%02d', floor(duration)::BIGINT // 60, floor(duration)::BIGINT % 60) END) AS line
FROM latest ORDER BY coalesce(updated_at, '') DESC, id LIMIT 200
""")
def library_list(spark: SparkSession, sf: str) -> DataFrame:
    """The 200 entries updated last, as they are listed."""
    entries = library.ordered(library.latest(table(spark, sf, "library")).where("id is not null")).limit(200)
    return entries.select("id", F.md5(F.concat_ws("|", F.coalesce("title", "id"), T.duration_label(F.col("duration")))).alias("line"))
