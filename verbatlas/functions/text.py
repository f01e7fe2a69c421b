"""Column builders over text. None of them leaves the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

EDGE = r"(?<![\p{L}\p{N}_])"
END = r"(?![\p{L}\p{N}_])"


def listed(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in sorted(set(words))])


def any_of(words: Iterable[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\u00a0]+", " "))


def terms(text: Column) -> Column:
    """Words of three characters and more, dots and hyphens inside kept, at the edges stripped; in order."""
    return F.transform(all_matches(F.lower(text), L.TERM), lambda w: F.btrim(w, F.lit(".-_")))


def is_term(word: Column, stopwords: Iterable[str] = L.STOPWORDS) -> Column:
    return (word != "") & ~word.isin(*sorted(stopwords)) & ~word.rlike("^[0-9]+$")


def content_tokens(text: Column, stopwords: Iterable[str] = L.STOPWORDS) -> Column:
    """Different terms that carry content."""
    stop = listed(stopwords)
    kept = F.filter(all_matches(F.lower(text), L.TERM), lambda w: ~w.rlike("^[0-9]+$"))
    return F.array_distinct(F.filter(F.transform(kept, lambda w: F.btrim(w, F.lit(".-_"))), lambda w: ~F.array_contains(stop, w)))


def negations(text: Column) -> Column:
    return F.array_sort(F.array_distinct(all_matches(F.lower(text), EDGE + any_of(L.NEGATIONS) + END)))


def numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(all_matches(text, EDGE + r"\d+(?:[.,]\d+)?" + END)))


def repetitions(text: Column) -> Column:
    """Words that follow themselves, with nothing but blanks or one of , ; : between."""
    found = F.regexp_extract_all(F.lower(text), F.lit(EDGE + r"([a-záéíóúñü]+)" + END + r"(?:\s*[,;:]\s*|\s+)\1" + END), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def markers(text: Column) -> Column:
    """What two texts must share before their words are compared."""
    return F.struct(negations(text).alias("negations"), numbers(text).alias("numbers"), repetitions(text).alias("repetitions"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets of words; 0 where one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def similarity(a: Column, b: Column) -> Column:
    return F.when(markers(a) == markers(b), jaccard(content_tokens(a), content_tokens(b))).otherwise(F.lit(0.0))


def sentences(text: Column, least: int = 50) -> Column:
    """Sentences of at least `least` characters. A text without a final mark inside is split before discourse markers."""
    t = squeezed(text)
    marked = F.split(t, r"(?<=[.!?])\s+")
    spoken = F.split(t, r"\s+(?=" + any_of(L.SENTENCE_OPENERS) + END + ")")
    return F.filter(F.transform(F.when(F.size(marked) == 1, spoken).otherwise(marked), lambda s: F.trim(s)), lambda s: F.char_length(s) >= least)


def n_words(text: Column) -> Column:
    return F.size(all_matches(F.lower(text), L.WORD + "+"))


def is_noise(text: Column) -> Column:
    """Production noise: several signs together in a short text, or nothing but stage directions."""
    t = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    bare = F.regexp_replace(t, L.STAGE, "")
    has = lambda words: t.rlike(EDGE + any_of(words) + END)
    rest = F.regexp_replace(bare, EDGE + any_of(L.OPENERS) + END, "")
    intro = t.rlike(L.STAGE) & (F.size(all_matches(rest, L.WORD + "+")) <= 1)
    promotion = has([r"recuerd[\p{L}\p{N}_]*", r"no olvid[\p{L}\p{N}_]*"]) & has([r"suscrib[\p{L}\p{N}_]*"]) & F.contains(t, F.lit("al canal")) & has(["activar las notificaciones?"])
    production = has(["esperen", "espera(?:d)?", "un momento"]) & has(["revisar", "probar", "comprobar"]) & has(["sonido", "audio", "micrófono", "microfono"])
    passing = has(["creo que se entiende", "no sé"]) & has(["seguimos con otra cosa", "pasamos a otra cosa"])
    return F.when(~bare.rlike(L.WORD), True).when(F.size(all_matches(t, L.WORD + "+")) > 28, False).otherwise(intro | promotion | production | passing)


def filler_penalty(text: Column) -> Column:
    t = F.lower(text)
    hits = F.regexp_count(t, F.lit(EDGE + "(?:eh|em|mmm+)" + END)) + F.regexp_count(t, F.lit(EDGE + r"bueno\s*[,;:]?\s+bueno" + END))
    hits = hits + F.regexp_count(t, F.lit(r"(?:^|" + EDGE + r"(?:eh|bueno)\s*[,;:]?\s+)a ver\s*[,;:]"))
    return F.least(F.lit(4.0), hits * F.lit(1.25))


def text_score(text: Column, weight: Column, position: Column) -> Column:
    """weight: what the keywords among the text's content tokens weigh."""
    words = F.size(all_matches(F.lower(text), "[a-záéíóúñü0-9_.-]+"))
    dense = F.size(content_tokens(text)) / F.greatest(words, F.lit(1)) * 3
    return weight + dense + F.least(words, F.lit(60)) / 60 + 1 / (position + 2) - F.when(words < 10, 3).otherwise(0) - filler_penalty(text)


def lower_start(text: Column) -> Column:
    """First letter in lower case, unless the first word has a dot or a capital inside."""
    first = F.regexp_extract(text, r"^\s*(\S+)", 1)
    return F.when(F.contains(first, F.lit(".")) | first.rlike(r"^.+\p{Lu}"), text).otherwise(F.concat(F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2))))


def claim_before(text: Column, connectors: Iterable[str]) -> Column:
    """What a text says before a connector, if that is 3 to 18 words; else null."""
    parts = F.split(text, r"(?iu)\s+" + any_of(connectors) + r"\s+", 2)
    claim = F.btrim(parts[0], F.lit(" .,:;"))
    return F.when((F.size(parts) == 2) & n_words(claim).between(3, 18), lower_start(claim))


def causal_question(text: Column) -> Column:
    return F.concat(F.lit("¿Por qué se afirma que "), claim_before(text, L.CAUSES), F.lit("?"))


def conditional_question(text: Column) -> Column:
    return F.concat(F.lit("¿En qué situación se afirma que "), claim_before(text, L.CONDITIONS), F.lit("?"))


def question_topic(text: Column, stopwords: Iterable[str] = L.STOPWORDS) -> Column:
    """First three different content words, none after a verb that ends a topic; "este tema" without any."""
    out, ends = listed(set(stopwords) | set(L.TOPIC_EXCLUDED)), listed(L.TOPIC_ENDS)
    start = F.struct(F.array().cast("array<string>").alias("w"), F.lit(False).alias("done"))

    def step(s: Column, w: Column) -> Column:
        done = s["done"] | ((F.size(s["w"]) > 0) & F.array_contains(ends, w))
        skip = done | (w == "") | F.array_contains(out, w) | w.rlike("^[0-9]+$") | F.array_contains(s["w"], w)
        return F.struct(F.when(skip, s["w"]).otherwise(F.array_append(s["w"], w)).alias("w"), done.alias("done"))

    words = F.aggregate(terms(text), start, step)["w"]
    return F.when(F.size(words) == 0, F.lit("este tema")).otherwise(F.array_join(F.slice(words, 1, 3), " "))


def term_pattern(term: Column) -> Column:
    """A pattern for term as a whole word; a dot may follow where no word does."""
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_.-])\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}_]|[.-](?=[\p{L}\p{N}_]))"))


def has_term(text: Column, term: Column) -> Column:
    return F.regexp_like(text, term_pattern(term))


def explains(text: Column, term: Column) -> Column:
    """Whether term stands whole before the first explaining verb of a text that names no cause."""
    verb = F.regexp_instr(text, F.lit("(?iu)" + EDGE + any_of(L.EXPLAINS) + END))
    at = F.regexp_instr(text, term_pattern(term))
    return (verb > 0) & ~text.rlike(r"(?iu)\s+" + any_of(L.CAUSES) + r"\s+") & (at > 0) & (at + F.char_length(term) <= verb)


def _folds() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition makes of letters and digits once marks are gone: single ones, theirs, and those that become several."""
    single, several = {}, {}
    for code in range(0x80, 0x10000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or not (c.isalnum() or unicodedata.combining(c)):
            continue
        t = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))
        t = unicodedata.normalize("NFKD", t.casefold())
        if t == c or not t.isascii():
            continue
        if len(t) == 1:
            single[c] = t
        elif t and t.isalnum() and len(t) <= 3 and not c.isnumeric():
            several[c] = t
    return "".join(single), "".join(single.values()), several


MARKED, BARE, SEVERAL = _folds()
SEVERAL = {c: t for c, t in SEVERAL.items() if c < "\u0250" or c >= "\ufb00"}


def folded(text: Column) -> Column:
    """Runs of a to z and digits, one blank apart; case, accents and other forms of a letter (full-width, ligatures) aside."""
    t = F.lower(text)
    wide = t
    for c, plain in SEVERAL.items():
        wide = F.replace(wide, F.lit(c), F.lit(plain))
    t = F.when(t.rlike("[^\\x00-\\x7f]"), F.regexp_replace(F.translate(wide, MARKED, BARE), r"\p{M}+", "")).otherwise(t)
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def contains_alias(text: Column, alias: Column) -> Column:
    """Whether alias stands in text as whole words, case and accents aside; an empty one never does."""
    t, a = folded(text), folded(alias)
    return (a != "") & F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" ")))


def matches_groups(text: Column, groups: Column) -> Column:
    """Whether every group has an alias that text contains."""
    return F.forall(groups, lambda g: F.exists(g, lambda a: contains_alias(text, a)))


def occurrences(text: Column, alias: Column) -> Column:
    """How often alias stands in text; repeats that share a blank count once."""
    t, a = F.concat(F.lit(" "), folded(text), F.lit(" ")), F.concat(F.lit(" "), folded(alias), F.lit(" "))
    return F.when(folded(alias) == "", 0).otherwise(((F.char_length(t) - F.char_length(F.replace(t, a, F.lit("")))) / F.char_length(a)).cast("int"))


# Entities that captions carry most.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0", "&#160;": "\u00a0", "&amp;": "&"}
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: Named entities as HTML defines them, of one character each.
NAMED = {f"&{k}": v for k, v in html5.items() if k.endswith(";") and len(v) == 1}


def unescaped(text: Column) -> Column:
    """Entities decoded, once: named and numbered ones. What names no character stays."""
    few = text
    for entity, char in ENTITIES.items():
        few = F.replace(few, F.lit(entity), F.lit(char))
    names = F.create_map(*[F.lit(x) for pair in sorted(NAMED.items()) for x in pair])
    digits = lambda e: F.when(F.lower(F.substring(e, 3, 1)) == "x", F.conv(F.regexp_extract(e, "([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(e, "([0-9]+);", 1)).cast("bigint")

    def char(e: Column) -> Column:
        code = digits(e)
        sound = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        number = F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(F.when(F.startswith(e, F.lit("&#")), number).otherwise(F.try_element_at(names, e)), e)

    parts, found = F.split(text, ENTITY, -1), all_matches(text, ENTITY)
    rest = F.array_join(F.zip_with(parts, found, lambda t, e: F.concat(t, F.coalesce(char(e), F.lit("")))), "")
    other = F.replace(F.regexp_replace(text, "&(?:lt|gt|quot|apos|nbsp|amp|#39|#160);", ""), F.lit("\u0001"), F.lit(""))
    return F.when(~F.contains(text, F.lit("&")), text).when(other.rlike(ENTITY), rest).otherwise(few)


def caption_text(line: Column) -> Column:
    """Entities decoded, tags removed, blanks squeezed. Decoding comes first, so encoded tags go too."""
    return squeezed(F.replace(F.regexp_replace(unescaped(line), "<[^>]+>", ""), F.lit("&nbsp;"), F.lit(" ")))


def with_aliases(text: Column, aliases: dict[str, str]) -> Column:
    """text with whole words replaced, case aside: what is often misheard by what was meant, in order."""
    for said, meant in aliases.items():
        text = F.regexp_replace(text, "(?iu)" + EDGE + "(?:" + said + ")" + END, meant)
    return text


def merged_lines(lines: Column) -> Column:
    """One text of a cue's lines: a line that continues the text so far replaces it, one it begins with is skipped."""
    def step(a: Column, x: Column) -> Column:
        return F.when((a == "") | F.startswith(x, a), x).when(F.startswith(a, x), a).otherwise(F.concat(a, F.lit(" "), x))

    return F.aggregate(lines, F.lit(""), step)


def duration_label(seconds: Column) -> Column:
    """H:MM:SS or M:SS; N/D for null and 0."""
    s = F.floor(seconds).cast("bigint")
    hours, rest = F.floor(s / 3600), F.pmod(s, F.lit(3600))
    label = F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, F.floor(rest / 60), F.pmod(rest, F.lit(60)))).otherwise(F.format_string("%d:%02d", F.floor(rest / 60), F.pmod(rest, F.lit(60))))
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, F.lit("N/D")).otherwise(label)


def url_at(url: Column, second: Column) -> Column:
    """The http(s) URL with its query's t set to second; null for others. Other parameters and the fragment stay."""
    m = lambda k: F.regexp_extract(url, r"^(https?://[^?#]*)(?:\?([^#]*))?(#.*)?$", k)
    kept = F.filter(F.split(m(2), "&"), lambda p: (p != "") & ~p.rlike("^t(?:=|$)"))
    query = F.array_join(F.array_append(kept, F.concat(F.lit("t="), second.cast("string"))), "&")
    return F.when(url.rlike("^https?://"), F.concat(m(1), F.lit("?"), query, m(3)))


def retry_seconds(attempt: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(8.0)).cast("int")


def version_parts(version: Column) -> Column:
    return F.transform(all_matches(version, r"\d+"), lambda x: x.cast("int"))
