"""Prompt and response pairs that cannot be learnt from, each with the defect it has.

Language: a character n-gram naive Bayes gives prompt and response a posterior over languages each,
and a response that is surely in another one is flagged. Truncation: n-grams of words and of a word's
characters say how likely a text ends where it does. Refusals: a naive Bayes over word n-grams, whose
first labels come from a list of phrases. The languages are fitted on a bounded labelled sample, endings
and refusals on counts over all pairs.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Shipped, cut
from .languages import language_of
from .profiles import encode, grams
from .runs import in_order

#: Labelled questions and as many answers of each language that the languages are fitted on, taken by hash. Endings and refusals are counted over all pairs.
#: Longer pairs than LONGEST characters are in no sample.
SAMPLE_LANGUAGE, LONGEST = 900, 4000
#: Words, n-grams and their like of each kind that the models hold, the most frequent of all pairs. The rest is joined to the pairs that ask for it.
MOST_COUNTS = 400_000

# What stands in for an answer that isn't there, letters and blanks only.
PLACEHOLDERS = set(
    "n a|n d|na|nd|s d|null|none|nil|nan|todo|tbd|tba|fixme|xxx|x|undefined|empty|vacío|vacio|pendiente|pending|sin respuesta|no answer|sin contestar|unanswered|"
    "sans réponse|pas de réponse|keine antwort|ohne antwort|sem resposta|nessuna risposta|senza risposta|leer|vide|vazio|vuoto|no disponible|not available|answer|respuesta".split("|")
)
# Phrases that only a refusal has; in lower case without accents.
REFUSALS = (
    "no puedo responder|no puedo contestar|no puedo ayudar|no me es posible ayudar|no estoy en condiciones de|tengo que declinar|debo abstenerme|prefiero no contestar|prefiero no responder|no sabria que decirte|no dispongo de informacion|"
    "i can t help|i cannot help|i can t answer|i cannot answer|i m unable to|i am unable to|i must decline|i d rather not|i don t have enough information|i do not have enough information|nothing i can tell you|guidelines don t let me|i have no answer to give|"
    "nao posso responder|nao posso ajudar|nao consigo ajudar|nao consigo responder|prefiro nao responder|devo abster me|nao tenho informacao|tenho de recusar|nao estou em condicoes|nao saberia o que dizer|"
    "je ne peux pas repondre|je ne peux pas vous aider|je ne peux pas aider|je ne suis pas en mesure|je prefere ne pas repondre|dois m abstenir|pas assez d informations|je dois refuser|je ne saurais|"
    "nicht beantworten|ich nicht helfen|nicht in der lage das zu|muss ich hier passen|nicht genug angaben|muss ich ablehnen|als sprachmodell|"
    "non posso rispondere|non posso aiutar|preferisco non rispondere|devo astenermi|non ho abbastanza informazioni|non sono in grado di|devo rifiutare|non saprei cosa"
).split("|")
# Marks that show whose turn it is.
LEADS = {"p", "q", "r", "a", "f", "d", "pregunta", "respuesta", "question", "answer", "pergunta", "resposta", "reponse", "frage", "antwort", "domanda", "risposta"}

TAGS = re.compile(r"<[^<>]*>|\[/?[a-z*]+[^\[\]]*\]|&nbsp;?", re.I)
QUOTED = re.compile(r"\([^()]*\)|\"[^\"]*\"|«[^»]*»|“[^”]*”|„[^“]*“")
FINAL = re.compile(r"(?:[.!?]+|\.{3})[\s\"'»”)\]]*$")
SENTENCE, CLAUSE = re.compile(r"[^.!?…]+([.!?…]*)"), re.compile(r"([^\W_]+(?:['’\-][^\W_]+)*['’]?)\s*([,;:—–(\[]?)")


# Dots that may stand for what is missing.
ELLIPSIS = re.compile(r"(?:…|\.{2})[.…\s\"'»”)\]]*$")


class Letters(dict):
    """What each character becomes: letters and digits stay, the rest are blanks, combining marks go if `bare`."""

    def __init__(self, bare: bool):
        self.bare = bare

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        self[code] = None if self.bare and unicodedata.combining(c) else c if c.isalnum() else " "
        return self[code]


BARE, WHOLE = Letters(True), Letters(False)


def plain_words(text: str) -> list[str]:
    return unicodedata.normalize("NFKD", text.casefold()).translate(BARE).split()


def unmarked(text: str) -> str:
    """text without mark-up, entities decoded."""
    if "&" in text:
        text = html.unescape(text)
    return TAGS.sub(" ", text) if "<" in text or "[" in text or "&" in text else text


def is_empty(answer: str | None) -> bool:
    """No answer, or only a placeholder or mark-up in its stead."""
    words = unmarked(answer or "").casefold().translate(WHOLE).split()
    return not words or (len(words) <= 3 and " ".join(words) in PLACEHOLDERS)


def is_copied(question: str, answer: str) -> bool:
    """Whether the answer says only the question again: nearly all of its words stand in the question in the
    same order, and they are most of it."""
    q, a = plain_words(unmarked(question)), plain_words(unmarked(answer))
    if a and a[0] in LEADS and a[0] not in q[:1]:
        a = a[1:]
    if not a or not q:
        return False
    if len(a) < 0.6 * len(q):
        return False
    held = set(q)  # a word that the question lacks is in no common subsequence
    if sum(w in held for w in a) < 0.9 * len(a):
        return False
    times = max(1, round(len(a) / len(q)))  # or says it several times over
    return in_order(a, q * times) >= 0.9 * len(a)


class Refusals:
    """Naive Bayes over words and pairs of words of a sample; what has a phrase of REFUSALS is the first truth."""

    def __init__(self, answers: list[str], counted: Counter | None = None, totals: tuple[int, int, int] | None = None):
        """From answers, or from what `count` gives, added up over all answers. totals: how many different parts there are and the
        sums of the counts of both kinds, where `counted` hasn't all."""
        got = self.count(answers) if counted is None else counted
        counts = {said: Counter({w: n for (x, w), n in got.items() if w and x == ("refused" if said else "said")}) for said in (True, False)}
        n = {True: got["refused", ""], False: got["said", ""]}
        known = set(counts[True]) | set(counts[False])
        different, refused, said = totals or (len(known), sum(counts[True].values()), sum(counts[False].values()))
        self.total = refused + 0.5 * different, said + 0.5 * different
        self.odds = {w: self.odds_of(counts[True][w], counts[False][w]) for w in known if counts[True][w] or counts[False][w] > 1}
        self.prior = math.log((n[True] + 1) / (n[False] + 1))

    def odds_of(self, refused: int, said: int) -> float:
        return math.log((refused + 0.5) / self.total[0]) - math.log((said + 0.5) / self.total[1])

    @classmethod
    def count(cls, answers: list[str]) -> Counter:
        """Answers that have a part, by (whether one has a phrase of REFUSALS, part); of part "", all."""
        out: Counter = Counter()
        for a in answers:
            words = plain_words(a)
            kind = "refused" if cls.has_phrase(words) else "said"
            out.update((kind, x) for x in cls.parts(words) | {""})
        return out

    @staticmethod
    def has_phrase(words: list[str]) -> bool:
        t = " ".join(words)
        return any(p in t for p in REFUSALS)

    @staticmethod
    def parts(words: list[str]) -> set[str]:
        return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}

    def score(self, words: list[str]) -> float:
        """Log odds that an answer of these words declines, words of a sound answer counting against it."""
        return self.prior + sum(self.odds.get(w, 0.0) for w in self.parts(words))

    def is_refusal(self, answer: str) -> bool:
        words = plain_words(answer)
        score = self.score(words) if words else 0.0
        return score > 0 and (score > 8 or self.has_phrase(words))


class LanguageBayes:
    """Naive Bayes of languages over the characters that follow two others."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(k for k, v in texts.items() if v)
        self.table = np.zeros((1 << 18, len(self.languages)), np.float32)
        for k, lang in enumerate(self.languages):
            c = np.bincount(grams(encode([t.lower() for t in texts[lang]])[0]), minlength=1 << 18).astype(np.float64)
            pairs = c.reshape(-1, 64)
            self.table[:, k] = np.log((pairs + 0.05) / (pairs.sum(1, keepdims=True) + 3.2)).ravel()

    def logs(self, texts: list[str]) -> np.ndarray:
        if not texts or not self.languages:
            return np.zeros((len(texts), len(self.languages)))
        symbols, starts = encode([t.lower() for t in texts])
        codes = grams(symbols)
        codes[starts[1:] - 1] &= ~63  # a text ends where it ends, whichever comes next
        return np.add.reduceat(self.table[codes], starts, axis=0, dtype=np.float64)

    @classmethod
    def trained(cls, rows: list[tuple[str, str]], rounds: int = 2) -> LanguageBayes:
        """From (label, text), texts that are surely of another language being left out in turn."""
        kept = rows
        for r in range(rounds + 1):
            texts: dict[str, list[str]] = {}
            for lang, t in kept:
                texts.setdefault(lang, []).append(t)
            model = cls(texts)
            if r < rounds and len(model.languages) > 1:
                best = model.logs([t for _, t in kept]).argmax(axis=1)
                kept = [x for x, k in zip(kept, best) if model.languages[k] == x[0]]
        return model


class Endings:
    """How likely a text ends after its last words, and a word after its last characters."""

    def __init__(self, texts: list[str], order: int = 3, letters: int = 12, counted: Counter | None = None, chars: dict[str, tuple[int, int]] | None = None):
        """From texts, or from what `count` gives, added up over all texts. chars: what `endings_of` gives, where `counted` hasn't all words."""
        self.order, self.letters = order, letters
        got = self.count(texts, order) if counted is None else counted
        ends, goes = (Counter({tuple(x.split(" ")): n for (kind, x), n in got.items() if kind == which}) for which in ("ends", "goes"))
        vocabulary = Counter({x: n for (kind, x), n in got.items() if kind == "word"})
        if chars is None:
            chars = self.endings_of(vocabulary.items(), letters)
        self.at = {c: (ends[c], ends[c] + goes[c]) for c in set(ends) | set(goes)}
        self.chars = {c: (a, a + b) for c, (a, b) in chars.items() if a + b > 1}
        self.vocabulary = {w for w, n in vocabulary.items() if n > 1}

    @classmethod
    def count(cls, texts: list[str], order: int = 3) -> Counter:
        """Uses of whole words, by ("word", word), and of n-grams that a sentence ends or goes on after."""
        uses: dict[str, list[str]] = {"word": [], "ends": [], "goes": []}
        goes, ends = uses["goes"], uses["ends"]
        for text in texts:
            for sentence, closed in cls.sentences(text):
                words = [w for w, _ in sentence]
                uses["word"] += words if closed else words[:-1]
                last = len(words) - 1
                for k, (w, comma) in enumerate(sentence):
                    if comma or (k == last and not closed):
                        continue
                    into = ends if k == last else goes
                    into.append(w)
                    for n in range(2, min(order, k + 1) + 1):
                        w = f"{words[k + 1 - n]} {w}"
                        into.append(w)
        return Counter({(kind, x): n for kind, each in uses.items() for x, n in Counter(each).items()})

    @staticmethod
    def endings_of(words: Iterable[tuple[str, int]], letters: int = 12) -> dict[str, tuple[int, int]]:
        """How often words (word, n) end after characters and how often they go on."""
        ends, goes = Counter(), Counter()
        for w, n in words:
            w = "^" + w
            for k in range(1, len(w) + 1):
                for m in {min(k, x) for x in range(2, letters + 1)}:
                    (ends if k == len(w) else goes)[w[k - m : k]] += n
        return {c: (ends[c], goes[c]) for c in set(ends) | set(goes)}

    @staticmethod
    def sentences(text: str) -> Iterator[tuple[list[tuple[str, bool]], bool]]:
        """(words with whether a comma follows, whether a final mark closes the sentence)."""
        t = QUOTED.sub(" ", unmarked(text)).lower()
        for m in SENTENCE.finditer(t):
            words = [(w, bool(c)) for w, c in CLAUSE.findall(m[0])]
            if words:
                yield words, bool(m[1]) and "…" not in m[1] and ".." not in m[1]

    def last(self, answer: str) -> tuple[float, float]:
        """(chance that a sentence ends after the last words, chance that the last word ends there)."""
        found = list(self.sentences(answer))
        if not found:
            return 1.0, 1.0
        words = [w for w, _ in found[-1][0]]
        word = "^" + words[-1]
        whole = 1.0
        if words[-1] not in self.vocabulary:
            for m in range(min(len(word), self.letters), 1, -1):
                if word[-m:] in self.chars:
                    e, n = self.chars[word[-m:]]
                    whole = (e + 0.2) / (n + 1)
                    break
        for n in range(min(self.order, len(words)), 0, -1):
            c = tuple(words[-n:])
            if c in self.at and self.at[c][1] >= (2 if n > 1 else 1):
                e, total = self.at[c]
                return (e + 0.1) / (total + 1), whole
        return 0.5, whole

    @staticmethod
    def bare_end(text: str) -> str:
        return ELLIPSIS.sub("", text).rstrip("…. ")

    def asked(self, answer: str) -> list[str]:
        """What `last` may look up of an answer and isn't held, by "kind part"."""
        found = list(self.sentences(self.bare_end(unmarked(answer).rstrip())))
        if not found:
            return []
        words = [w for w, _ in found[-1][0]]
        word = "^" + words[-1]
        tails = (words[-n:] for n in range(1, min(self.order, len(words)) + 1))
        out = [f"ends {' '.join(x)}" for x in tails if tuple(x) not in self.at]
        if words[-1] not in self.vocabulary:
            out += [f"word {words[-1]}", *(f"chars {word[-m:]}" for m in range(2, min(len(word), self.letters) + 1) if word[-m:] not in self.chars)]
        return out

    def is_truncated(self, answer: str) -> bool:
        t = unmarked(answer).rstrip()
        if re.search(r"[,;:\-–—(\[{«“¿¡/&]$", t):
            return True
        bare = QUOTED.sub(" ", t)
        if bare.count("(") > bare.count(")") or bare.count("[") > bare.count("]"):
            return True
        if FINAL.search(t) and not ELLIPSIS.search(t):
            return False
        end, whole = self.last(self.bare_end(t))
        return end < 0.08 or (whole < 0.1 and end <= 0.5)


def judge_all(pairs: Iterable[tuple[str | None, str | None]], languages: LanguageBayes, endings: Endings, refusals: Refusals, sure: float = 6.0) -> list[str | None]:
    """Each pair's defect or null. The order is that of certainty; a question that is missing has no language and isn't copied."""
    pairs = list(pairs)
    out: list[str | None] = [None] * len(pairs)
    rest = []
    for r, (question, answer) in enumerate(pairs):
        if is_empty(answer):
            out[r] = "empty"
        elif question and is_copied(question, answer):
            out[r] = "copied"
        elif refusals.is_refusal(answer):
            out[r] = "refusal"
        else:
            rest.append(r)
    asked = [r for r in rest if pairs[r][0]]
    lq, la = (languages.logs([QUOTED.sub(" ", unmarked(pairs[r][side])) for r in asked]) for side in (0, 1))
    if len(languages.languages) > 1 and asked:
        k, j, at = lq.argmax(axis=1), la.argmax(axis=1), np.arange(len(asked))
        other = (k != j) & (la[at, j] - la[at, k] > sure) & (lq[at, k] - lq[at, j] > sure)
        for r in np.flatnonzero(other).tolist():
            out[asked[r]] = "other_language"
    for r in rest:
        if out[r] is None and endings.is_truncated(pairs[r][1]):
            out[r] = "truncated"
    return out


def judge(question: str | None, answer: str | None, languages: LanguageBayes, endings: Endings, refusals: Refusals, sure: float = 6.0) -> str | None:
    return judge_all([(question, answer)], languages, endings, refusals, sure)[0]


class Counts(Counter):
    """What Endings and Refusals count, by (kind, part). Where it is too much to hold, the most frequent are here, rest (key, a, b) has all
    that may be asked for by "kind part", large names the kinds it has, and totals and chars are those of all."""

    rest: DataFrame | None = None
    large: frozenset[str] = frozenset()
    totals: tuple[int, int, int] | None = None
    chars: dict[str, tuple[int, int]] | None = None


#: Kinds of counts that are asked for together, as (a, b).
TOGETHER = {"said": ("refused", "said"), "ends": ("ends", "goes"), "word": ("word", "")}


def counted(pairs: DataFrame) -> Counts:
    """What Endings and Refusals count, over all pairs. Counts are added up batch by batch before they are shuffled. Of each kind that has more
    than MOST_COUNTS the most frequent are collected, the others stay in a table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers = [a for a in f["answer"] if a]
            total = Endings.count(answers + [q for q in f["question"] if q]) + Refusals.count(answers)
            yield pd.DataFrame({"kind": [k for k, _ in total], "x": [x for _, x in total], "n": list(total.values())})

    def letters(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = Endings.endings_of(zip(f["x"], f["n"].tolist()))
            yield pd.DataFrame({"x": list(got), "a": [a for a, _ in got.values()], "b": [b for _, b in got.values()]})

    each = pairs.select("question", "answer").mapInPandas(run, "kind string, x string, n bigint")
    sums = cut(each.groupBy("kind", "x").agg(F.sum("n").alias("n")))
    size = {r.kind: r["count"] for r in sums.groupBy("kind").count().collect()}
    large = [kind for kind, own in TOGETHER.items() if max(size.get(k, 0) for k in own) > MOST_COUNTS]
    out = Counts({(r.kind, r.x): r.n for r in sums.where(~F.col("kind").isin([k for kind in large for k in TOGETHER[kind]])).collect()})
    if not large:
        return out
    tables = []
    for kind in large:
        first, second = TOGETHER[kind]
        n = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
        tables.append(sums.where(F.col("kind").isin(first, second)).groupBy("x").agg(n(first).alias("a"), n(second).alias("b")).select(F.lit(kind).alias("of"), "x", "a", "b"))
    if "word" in large:
        tables.append(sums.where("kind = 'word'").select("x", "n").mapInPandas(letters, "x string, a bigint, b bigint").groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select(F.lit("chars").alias("of"), "x", "a", "b"))
    both = cut(reduce(DataFrame.unionByName, tables))
    # Of what occurs once only a single word's end and a part of a refusal are ever looked at.
    out.rest = both.where("a + b > 1 or (of = 'ends' and not contains(x, ' ')) or (of = 'said' and a > 0)").select(F.concat_ws(" ", "of", "x").alias("key"), "a", "b")
    out.large = frozenset([*large, *(["chars"] if "word" in large else [])])
    for kind in out.large:
        top = both.where(F.col("of") == kind).orderBy(F.desc(F.col("a") + F.col("b")), "x").limit(MOST_COUNTS).collect()
        if kind == "chars":
            out.chars = {r.x: (r.a, r.b) for r in top}
        else:
            out.update({(k, r.x): n for r in top for k, n in zip(TOGETHER[kind], (r.a, r.b)) if n})
    if "said" in large:
        r = both.where("of = 'said' and x <> ''").agg(F.count("*"), F.sum("a"), F.sum("b")).first()
        out.totals = r[0], r[1] or 0, r[2] or 0
        # Of "" there are all answers.
        out.update({(k, ""): n for r in both.where("of = 'said' and x = ''").collect() for k, n in zip(TOGETHER["said"], (r.a, r.b)) if n and (k, "") not in out})
    return out


def asked(answer: str | None, endings: Endings, refusals: Refusals, large: frozenset[str]) -> list[str]:
    """Keys of Counts.rest that an answer's judgement may depend on."""
    if is_empty(answer):
        return []
    out = [f"said {x}" for x in refusals.parts(plain_words(answer)) if x not in refusals.odds] if "said" in large else []
    return out + [k for k in endings.asked(answer) if k.partition(" ")[0] in large]


@contextmanager
def knowing(rest: Iterable[tuple[str, int, int]], endings: Endings, refusals: Refusals) -> Iterator[None]:
    """Models that know rest (key, a, b) too, for a while."""
    added: list[tuple[dict | set, str | tuple]] = []
    for key, a, b in rest:
        kind, _, x = key.partition(" ")
        if kind == "word":
            into, at = endings.vocabulary, x
        else:
            into, at = {"said": refusals.odds, "ends": endings.at, "chars": endings.chars}[kind], tuple(x.split(" ")) if kind == "ends" else x
        if at in into:
            continue
        added.append((into, at))
        if kind == "word":
            into.add(at)
        else:
            into[at] = refusals.odds_of(a, b) if kind == "said" else (a, a + b)
    try:
        yield
    finally:
        for into, at in added:
            into.discard(at) if isinstance(into, set) else into.pop(at)


def defects(pairs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(kind, id, question, answer, defect) with one row per pair, defect null where it is sound.

    pairs (kind, id, video_id, question, answer): a pair delivered twice counts once, of differing
    deliveries the smallest (question, answer), nulls first. labels (video_id, language) give the languages their
    first texts; without them no answer is in another language. Null ids are ids like others; an empty
    table gives an empty result. Other columns are ignored.
    """
    spark = pairs.sparkSession
    base = pairs.groupBy("kind", "id").agg(F.min(F.struct("question", "answer", "video_id")).alias("x")).select("kind", "id", "x.*")
    short = pairs.where(F.coalesce(F.char_length("question"), F.lit(0)) + F.coalesce(F.char_length("answer"), F.lit(0)) <= LONGEST)
    texts: list[tuple[str, str]] = []
    if labels is not None:
        known = labels.select("video_id", language_of(F.col("language")).alias("lang")).where("lang is not null").groupBy("video_id").agg(F.min("lang").alias("lang"))
        sides = F.array(
            F.when(F.length(F.trim("question")) > 10, F.struct(F.lit("q").alias("side"), F.col("question").alias("t"))), F.when(F.length(F.trim("answer")) > 40, F.struct(F.lit("a").alias("side"), F.col("answer").alias("t")))
        )
        each = short.select("video_id", "kind", "id", F.explode(F.array_compact(sides)).alias("x")).select("video_id", "x.*", F.xxhash64("kind", "id", "x.t").alias("h"))
        # Thinned by hash first, so that no task hands on more than a few times what is taken.
        share = {(r.lang, r.side): min(1.0, 4.0 * SAMPLE_LANGUAGE / r["count"]) for r in each.join(known, "video_id").groupBy("lang", "side").count().collect()}
        if share:
            limit = F.create_map(*[F.lit(x) for (lang, side), p in sorted(share.items()) for x in (lang + side, p)])
            of = F.pmod("h", F.lit(1_000_003)) / 1_000_003
            each = each.where(of <= max(share.values())).join(known, "video_id").where(of <= F.try_element_at(limit, F.concat("lang", "side")))
            few = each.withColumn("k", F.row_number().over(W.partitionBy("lang", "side").orderBy("h", "t"))).where(F.col("k") <= SAMPLE_LANGUAGE)
            texts = sorted((r.lang, r.t) for r in few.select("lang", "t").collect())
    got = counted(pairs)
    models = LanguageBayes.trained(texts), Endings([], counted=got, chars=got.chars), Refusals([], got, got.totals)
    sent = Shipped(spark, models)

    @F.pandas_udf("string")
    def defect(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        models = sent.value
        for q, a in batches:
            yield pd.Series(judge_all(zip(q, a), *models), dtype=object)

    if got.rest is None:
        return base.select("kind", "id", "question", "answer", defect("question", "answer").alias("defect"))
    large = got.large

    @F.pandas_udf("array<string>")
    def lacking(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _, endings, refusals = sent.value
        for a in batches:
            yield pd.Series([asked(x, endings, refusals, large) for x in a], dtype=object)

    @F.pandas_udf("string")
    def defect_with(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        models = sent.value
        for q, a, more in batches:
            rest = [(r["key"], r["a"], r["b"]) for x in more if x is not None for r in x]
            with knowing(rest, *models[1:]):
                yield pd.Series(judge_all(zip(q, a), *models), dtype=object)

    base = cut(base.withColumn("_id", F.xxhash64("kind", "id")))
    wanted = base.select("kind", "id", "_id", F.explode(lacking("answer")).alias("key")).join(got.rest, "key")
    more = wanted.groupBy(F.col("kind").alias("_k"), F.col("id").alias("_i"), F.col("_id").alias("_h")).agg(F.collect_list(F.struct("key", "a", "b")).alias("more"))
    joined = base.join(more, F.expr("_id = _h and kind <=> _k and id <=> _i"), "left")
    return joined.select("kind", "id", "question", "answer", defect_with("question", "answer", "more").alias("defect"))
