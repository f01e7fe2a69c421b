"""Personal information inside free text: found by weak supervision, replaced by typed placeholders.

Wide patterns propose spans. Several labelers (formats, a gazetteer, words around the span, corpus
counts) vote on each for, against or not at all; expectation-maximisation over the votes on all documents
estimates how reliable each is and what each span probably is; a logistic span classifier is trained
on these probabilities from the votes and the span's shape and surroundings, and decides.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Shipped, bounded_rows, cut

#: Different spans of each kind, by hash, that the classifier is trained on; a kind of which fewer than LEAST were proposed in
#: all documents has no classifier and goes by the sum of its votes; names the gazetteer may hold; features by hash.
SAMPLE, LEAST, MOST_NAMES, WIDTH = 20_000, 20, 100_000, 1 << 14
#: Copies of a span that training counts at most: spam sent again and again teaches no more than that.
COPIES = 8
#: A word is common from this share of documents on, or half of it if it's mostly in lower case; at most MOST_WORDS are kept, by frequency.
COMMON, MOST_WORDS = 0.004, 200_000
#: Share of its texts from which on a word that stands where a name is due is a name's and not common.
NAMED = 0.5
#: What the log odds of a name lose by each of its words that is common: the surest that a labeler may be.
AGAINST_COMMON = float(np.log(0.99 / 0.01))

KINDS = ("email", "id_number", "phone", "address", "name")

# How "at" and "dot" of an address are disguised.
AT = r"(?:@|&\#64;|&\#x40;|&commat;|\s?[\[({<]\s?(?:at|arroba|arobase|chiocciola|ät|@)\s?[\])}>]\s?|\s(?:at|arroba|arobase|chiocciola|ät)\s)"
DOT = r"(?:\.|&\#46;|&period;|\s?[\[({<]\s?(?:dot|punto|ponto|point|punkt|\.)\s?[\])}>]\s?|\s(?:dot|punto|ponto|point|punkt)\s)"
EMAIL = re.compile(rf"(?<![\w.+\-&#/=@])\w[\w.+\-]{{0,63}}{AT}\w[\w\-]{{0,63}}(?:{DOT}\w[\w\-]{{0,63}}){{1,5}}(?![\w@])", re.I)

# Numbers of persons in several countries.
ID_FORMATS = [
    re.compile(x)
    for x in (
        r"\d{3}([- ])\d{2}\1\d{4}", r"\d{8}[- ]?[A-Z]", r"\d{2}\.\d{3}\.\d{3}[- ]?[A-Z]", r"[XYZ][- ]?\d{7}[- ]?[A-Z]", r"[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2}\d?",
        r"[1-9] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3} ?\d{2}", r"[A-Z]{6} ?\d{2}[A-Z]\d{2} ?[A-Z]\d{3}[A-Z]", r"\d{3}\.\d{3}\.\d{3}-\d{2}",
    )
]
ID = re.compile(r"(?<![\w.\-/+#@])(?:" + "|".join(re.sub(r"\(\[- \]\)|\\1", "[- ]", p.pattern) for p in ID_FORMATS) + r")(?![\w@]|[-.]\d)")

PHONE_FORMATS = [
    re.compile(x)
    for x in (
        r"\+\d{1,3}[\s.\-/()]*\d[\d\s.\-/()]{5,14}\d", r"00\d{2}[\s.\-/]?\d[\d\s.\-/()]{5,14}\d", r"\(\d{2,4}\)\s?\d{3}[\s.\-]?\d{4}", r"\d{3}[-.]\d{4}", r"1[-.]\d{3}[-.]\d{3}[-.]\d{4}",
        r"\d{3}[-.]\d{3}[-.]\d{4}", r"0\d(?:[ .\-]\d{2}){4}", r"0\d{9,10}", r"0\d{2,4}[ /]\d{3,6}(?:[ \-]?\d{2,6})?", r"07\d{3} \d{6}", r"[6789]\d{2} \d{3} \d{3}", r"[6789]\d{8}",
    )
]
PHONE = re.compile(r"(?<![\w.\-/+#@=?:])(?:\+|\()?\d(?:[\d().\-/]|[  ](?=[\d(])){4,22}\d(?![\w@]|[-.]\d|[-.]\w)")

# Words of street names.
WORD = r"[^\W\d_][\w'’\-]*"
STREET_END = r"(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|ring|damm)"
BEFORE = r"(?:calle|plaza|avenida|avda\.?|av\.|paseo|c/|rua|travessa|largo|praça|via|viale|piazza|corso|vicolo)"
FRENCH = r"(?:rue|avenue|chemin|boulevard|bd|place|impasse|allée|quai|route|cours)"
ENGLISH = r"(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|square|way|court|close)\b(?:\.(?=,))?"
OF = r"(?:de la|de los|de las|des|del|della|dello|dei|do|da|dos|das|de|du|d['’]|di|l['’])"
HOUSE = r"\d{1,4}(?:[a-z]\b|[ \u00a0][a-z](?=[,.;!?<\n]|$))?(?!\d)"
FLAT = r"(?:,?[ \u00a0](?:flat|apt\.?|apartment|unit|whg\.?|wohnung|appt\.?|int\.?)[ \u00a0]?\d{1,4}[a-z]?\b|,?[ \u00a0]\d{1,2}[ \u00a0]?[ºª°](?:[ \u00a0]?[a-z]\b)?)"
PLACE = r"(?-i:[A-ZÀ-Þ])[\w'’\-]+(?:[ \u00a0](?-i:[A-ZÀ-Þ])[\w'’\-]+){0,2}"
ANYPLACE = r"[^\W\d_][\w'’\-]+"
TAIL = rf"{FLAT}?(?:,[ \u00a0](?:[A-Z]-)?\d{{4,5}}[ \u00a0]{ANYPLACE}|,[ \u00a0]{ANYPLACE}[ \u00a0]\d{{4,5}}\b|,[ \u00a0](?-i:[A-ZÀ-Þ])[\w'’\-]+)?"
ADDRESS = re.compile(
    rf"(?<![\w])(?:{WORD}{STREET_END}[ \u00a0]{HOUSE}|{BEFORE}[ \u00a0](?:{OF}[ \u00a0]?)?{WORD}(?:[ \u00a0]{WORD}){{0,2}}?,?[ \u00a0](?:n[.º°][ \u00a0]?)?{HOUSE}|{HOUSE},?[ \u00a0]{FRENCH}[ \u00a0](?:{OF}[ \u00a0]?)?{WORD}|{HOUSE}[ \u00a0]{WORD}(?:[ \u00a0]{WORD})?[ \u00a0]{ENGLISH}){TAIL}", re.I
)

TOKEN = r"[^\W\d_]{2,}(?:['’][^\W\d_]{2,})?"
NAME = re.compile(rf"(?<![\w.+\-@/=#&])({TOKEN})(,?[ \u00a0](?:[^\W\d_]\.[ \u00a0])?)({TOKEN})(-{TOKEN})?(?![\w@=/+]|\.\w|-\w)")

# Words around spans that speak for or against a kind.
FOR = {
    "email": "mail|write|contact|address|photos|escrib|correo|escreve|adresse|schreib|bilder|écris|scrivi|fotos|foto|photos|e-mail|endereço|indirizzo|or|oder|contatt|kontakt",
    "phone": "call|number|text|tel|whatsapp|☎|phone|contact|llámame|número|numéro|appelle|nummer|ruf|chiam|numero|liga|móvil|mobile|handy|sms|contatt|kontakt",
    "id_number": "id|identity|identidad|documento|dni|nie|nif|ausweis|ausweisnummer|identité|identità|identidade|carta|ssn|fiscale|sécurité|bilhete|cpf|passport",
    "address": "live|ship|pick|vivo|envíalo|recog|moro|envia|levantar|abito|spedis|ritir|habite|envoie|envoyer|récupérer|wohne|schick|abholen|address|send|lives|wohnt",
    "name": "name|llamo|appelle|heiße|chiamo|chamo|ask for|pregunta por|pergunta por|demande|laden nach|chiedi di|it was|fue|c'était|es war|era|foi|è stato|nome|nombre|signed",
}
AFTER_NAME = "who fixed|sold me|at the counter|hat es repariert|hat mir|me vendió|lo arregló|en la tienda|na loja|au magasin|m'a vendu|l'a réparé|in negozio|al banco|mi ha venduto|lo ha riparato|me vendeu|arranjou|consertou|im laden"
AGAINST = {
    "email": "when nobody|nobody looks|looks",
    "phone": "score|isbn|order|part no|ticket|page|thread|post|build|firmware|costs|it was|on|am|le|el|error|sha1|serial|version|code|lane|screws|eur|chapter|room",
    "id_number": "order|ticket|part no|isbn|build|firmware|serial|error|sha1|page|thread|score|version",
    "address": "chapter|edition|lane|page|score|firmware|order",
    "name": "best|team|thanks|günstig|jetzt|sent from|the|mehr|comprar|compra|mejores|melhores",
}
MARKS = re.compile(r"&gt;|<[^<>]*>|\[[^\[\]]*\]|[\s>»*_~|.!\-]")
# What of MARKS is a single character, what else may end and begin one of them.
SKIPPED, ENDS_MARK, BEGINS_MARK = set(" >»*_~|.!-"), set("\n>];"), set("\n&<[")
#: Characters of its line that are looked at on each side of a name.
LINE = 240
PRODUCT = re.compile(r"\s*(?:pump|pills|v\d|phone|since|edition|degrees|günstig|kaufen|\+|said|wrote|schrieb|escribió|escreveu|cloud|ha scritto|a écrit|dijo)", re.I)


@dataclass(frozen=True)
class Word:
    """What is known of a word as it is written."""

    low: str
    common: bool
    given: bool
    family: bool
    upper: bool
    capitals: bool

    @property
    def listed(self) -> bool:
        return self.given or self.family


@dataclass
class Known:
    """What the labelers look words up in."""

    given: set[str]
    family: set[str]
    common: set[str]
    seen: dict[str, Word] = field(default_factory=dict, repr=False, compare=False)

    def word(self, w: str) -> Word:
        low = w.lower()
        got = Word(low, low in self.common, low in self.given, low in self.family, w[:1].isupper(), w.isupper())
        if len(self.seen) < MOST_WORDS:
            self.seen[w] = got
        return got

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}


@dataclass
class Span:
    kind: str
    start: int
    end: int
    votes: tuple[int, ...]
    features: tuple[int, ...]
    usual: int = 0  # a name's words that are common: as many votes against it


AGAINST_NEAR = {k: re.compile(rf"(?<!\w)(?:{v})[\s#:.\w]{{0,4}}$") for k, v in AGAINST.items()}
FOR_NEAR = {k: re.compile(rf"(?<!\w)(?:{v})") for k, v in FOR.items()}
AFTER_NAME_NEAR, FOR_NAME = re.compile(AFTER_NAME), re.compile(FOR["name"])
ID_WHOLE = [re.compile(p.pattern + r"\Z") for p in ID_FORMATS]
PHONE_WHOLE = [re.compile(p.pattern + r"\Z") for p in PHONE_FORMATS]
DATE = re.compile(r"\d{1,2}\.\d{1,2}\.\d{2,4}(?:\s.*)?\Z|\d{1,3}(?:\.\d{1,3}){3}\Z|\d{4}-\d{2}-\d{2}|(?:19|20)\d{6}\Z")


def _shape(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in s))[:24]


def _features(kind: str, text: str, a: int, b: int, votes: tuple[int, ...]) -> tuple[int, ...]:
    before = re.findall(r"\w+|[^\w\s]", text[max(0, a - 30) : a].lower())[-2:]
    after = re.findall(r"\w+|[^\w\s]", text[b : b + 30].lower())[:2]
    names = [f"v{k}={v}" for k, v in enumerate(votes) if v] + [f"b{k}={w}" for k, w in enumerate(reversed(before))] + [f"a{k}={w}" for k, w in enumerate(after)]
    names += [f"s={_shape(text[a:b])}" if kind != "name" else f"e={text[a:b][-3:].lower()}", f"n={sum(c.isdigit() for c in text[a:b])}", "1"]
    return tuple(zlib.crc32(f"{kind} {x}".encode()) % WIDTH for x in names)


def _span(kind: str, text: str, a: int, b: int, votes: list[int]) -> Span:
    before = text[max(0, a - 48) : a].lower()
    line = before.rpartition("\n")[2]
    votes = [1 if FOR_NEAR[kind].search(line[-40:]) else 0, -1 if AGAINST_NEAR[kind].search(line) else 0, *votes]
    return Span(kind, a, b, tuple(votes), _features(kind, text, a, b, tuple(votes)))


class Due:
    """Where in a text a full name is due: alone, for nothing but marks is on its line, whose ends are looked for nearby;
    before words that follow a name; after words that lead to one. Those words are looked up once for all pairs."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def low(self) -> str:
        low = self.text.lower()
        return low if len(low) == len(self.text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in self.text)

    @cached_property
    def leads(self) -> list[tuple[int, int]]:
        low = self.low
        return [m.span() for m in FOR_NAME.finditer(low) if not (m.start() and (low[m.start() - 1].isalnum() or low[m.start() - 1] == "_"))]

    @cached_property
    def ends(self) -> list[int]:
        return [b for _, b in self.leads]

    @cached_property
    def follow(self) -> set[int]:
        return {m.start() for m in AFTER_NAME_NEAR.finditer(self.low)}

    def alone(self, a: int, b: int) -> bool:
        text = self.text
        k = a - 1
        while k >= 0 and text[k] in SKIPPED:
            k -= 1
        if k >= 0 and text[k] not in ENDS_MARK and not text[k].isspace():
            return False
        k = b
        while k < len(text) and text[k] in SKIPPED:
            k += 1
        if k < len(text) and text[k] not in BEGINS_MARK and not text[k].isspace():
            return False
        start = max(text.rfind("\n", max(0, a - LINE), a) + 1, a - LINE, 0)
        stop = text.find("\n", b, b + LINE)
        stop = min(b + LINE, len(text)) if stop < 0 else stop
        return not MARKS.sub("", text[start:a] + text[b:stop])

    def after(self, b: int) -> bool:
        if not self.follow:
            return False
        text = self.text
        while b < len(text) and (text[b] == "," or text[b].isspace()):
            b += 1
        return b in self.follow

    def led(self, a: int, whole: bool) -> bool:
        """Whether words on the same line lead to what begins at a; whole asks for the same sentence."""
        k = bisect_right(self.ends, a) - 1
        if k < 0 or self.leads[k][0] < a - 24 or "\n" in self.text[self.ends[k] : a]:
            return False
        return not whole or not any(c in ".!?" for c in self.text[max(0, a - 24) : a].rstrip())

    def any(self, a: int, b: int) -> bool:
        return self.alone(a, b) or self.led(a, False) or self.after(b)


def propose(text: str, known: Known) -> list[Span]:
    """Every span that may be personal, with the labelers' votes: the first two are by words before it."""
    out = []
    digits = any(map(text.__contains__, "0123456789"))
    for m in EMAIL.finditer(text):
        v = m[0]
        sign = "@" in v or "&" in v
        bracket = bool(re.search(r"[\[({<]", v))
        local = re.split(r"[@&\[({<\s]", v)[0].lower()
        prose = not sign and not bracket and local in known.common
        out.append(_span("email", text, m.start(), m.end(), [1 if sign else 0, 1 if bracket else 0, -1 if prose else 0, 1 if re.search(r"[._+\-\d]", local) else 0, 1 if re.search(r"(?:example|invalid|test|localhost|com|org|net|de|fr|es|it|pt|uk|info)\Z", v, re.I) else -1]))
    for m in ID.finditer(text) if digits else ():
        out.append(_span("id_number", text, m.start(), m.end(), [1 if any(p.match(m[0]) for p in ID_WHOLE) else -1, 1 if re.search("[A-Z]", m[0]) else 0, -1 if DATE.match(m[0]) else 0]))
    for m in PHONE.finditer(text) if digits else ():
        v = m[0]
        n = sum(c.isdigit() for c in v)
        if not 7 <= n <= 15 or v.count("(") != v.count(")"):
            continue
        known_form = any(p.match(v) for p in PHONE_WHOLE)
        out.append(_span("phone", text, m.start(), m.end(), [1 if known_form else -1, 1 if v[0] == "+" else 0, -1 if DATE.match(v) else 0, -1 if any(p.match(v) for p in ID_WHOLE) else 0, -1 if text[m.start() - 1 : m.start()] in ("#", "x") else 0]))
    for m in ADDRESS.finditer(text) if digits else ():
        words = re.findall(r"[^\W\d_]{3,}", m[0].lower())
        common = sum(w in known.common for w in words)
        out.append(_span("address", text, m.start(), m.end(), [1 if re.search(r"\d{4,5}", m[0]) else 0, 1 if common <= 1 + len(words) // 3 else -1, 1 if re.search(r"[A-ZÀ-Þ]", m[0]) else 0]))
    places, seen, at = Due(text), known.seen, 0
    while m := NAME.search(text, at):
        one, two, tail = m.group(1, 3, 4)
        a, at = m.start(), m.end(1)  # the second token may begin a name of its own
        x, y = seen.get(one) or known.word(one), seen.get(two) or known.word(two)
        z = known.word(tail[1:]) if tail else None
        usual = x.common + (y.common and not y.listed)
        listed = x.listed or y.listed or bool(z and z.listed)
        if not usual and not listed and x.upper != y.upper:
            continue
        b = m.end()
        due = places.led(a, bool(usual))  # what leads to a common word stands in the same sentence
        after, alone = places.after(b), places.alone(a, b)
        # Common words, and unknown ones in lower case, are taken for a name only where a name is due.
        if not (alone or after or due) and (usual or not listed and not (x.upper and y.upper)):
            continue
        words = [w for w in (x, y, z) if w]
        n_listed, n_strange = sum(w.listed for w in words), sum(not w.listed and not w.common for w in words)
        both = (x.given and y.family) or (x.family and y.given)
        same = x.capitals == y.capitals and x.upper == y.upper
        votes = [
            1 if both else -1 if x.given and y.given and not z else 0, 1 if n_listed >= 1 and n_listed + n_strange >= 2 else 0, 1 if alone else 0, 1 if after else 0,
            -1 if PRODUCT.match(text[b : b + 20]) else 0, -1 if "," in m[2] and x.given and not y.given else 0, 0 if same else -1,
        ]
        out.append(replace(_span("name", text, a, b, votes), usual=usual))
    return out


def em(votes: np.ndarray, times: np.ndarray | None = None, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each vector of votes, chance that each labeler's votes are right, prior), where vector k was seen times[k]
    times, labelers vote 1 or -1 independently and 0, no vote, says nothing. No labeler is taken to be wrong more often than not."""
    n, k = votes.shape
    times = np.ones(n) if times is None else times
    right, prior = np.full(k, 0.75), 0.5
    post = np.full(n, 0.5)
    for _ in range(rounds):
        z = np.log(prior / (1 - prior)) + votes @ np.log(right / (1 - right))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        moved = np.abs(new - post).max() if n else 0
        post = new
        if moved < 1e-6:
            break
        prior = float(np.clip(((times * post).sum() + 1) / (times.sum() + 2), 0.02, 0.98))
        agree = (((votes > 0) * post[:, None] + (votes < 0) * (1 - post)[:, None]) * times[:, None]).sum(0)
        right = np.clip((agree + 3) / (((votes != 0) * times[:, None]).sum(0) + 4), 0.55, 0.99)
    return post, right, prior


def logistic(features: list[tuple[int, ...]], truth: np.ndarray, rounds: int = 8, rate: float = 0.2, decay: float = 1e-5) -> np.ndarray:
    """Weights of a logistic classifier on hashed features, by stochastic gradient on soft labels."""
    w = np.zeros(WIDTH)
    seen = np.ones(WIDTH)
    order = np.random.default_rng(9)
    often = np.bincount([y for x in features for y in x], minlength=WIDTH) >= 5  # what is rarer says nothing
    rows = [np.array([y for y in x if often[y]], np.int64) for x in features]
    for _ in range(rounds):
        for k in order.permutation(len(rows)):
            x = rows[k]
            p = 1 / (1 + np.exp(-np.clip(w[x].sum(), -30, 30)))
            g = truth[k] - p
            w[x] += rate * (g / np.sqrt(seen[x]) - decay * w[x])
            seen[x] += g * g
    return w


@dataclass
class Model:
    known: Known
    weights: dict[str, np.ndarray]
    reliability: dict[str, list[float]]

    def choose(self, spans: Iterable[Span]) -> list[tuple[str, int, int]]:
        """(kind, start, end) of the spans that are personal, none overlapping; the surer kind, then the one of fewer common words,
        then the longer span wins."""
        kept: list[tuple[int, int, int, int, int]] = []
        for s in spans:
            z = self.weights[s.kind][list(s.features)].sum() - s.usual * AGAINST_COMMON if s.kind in self.weights else float(sum(s.votes)) - s.usual - 0.5
            if z > 0:
                kept.append((KINDS.index(s.kind), s.usual, s.start - s.end, s.start, s.end))
        out: list[tuple[str, int, int]] = []
        starts: list[int] = []  # of what is taken, in order
        ends: list[int] = []
        for k, _, _, a, b in sorted(kept):
            at = bisect_right(starts, a)
            if (at == 0 or ends[at - 1] <= a) and (at == len(starts) or b <= starts[at]):
                starts.insert(at, a)
                ends.insert(at, b)
                out.append((KINDS[k], a, b))
        return sorted(out, key=lambda x: x[1])

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        return self.choose(propose(text, self.known)) if text else []

    def redact(self, text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for kind, a, b in self.find(text):
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        return "".join(out) + text[at:]


SPAN = "kind string, start int, end int, votes array<int>, features array<int>, usual int, value string"
SPANS = "array<struct<" + ", ".join(f"{n}: {t}" for n, t in (x.split(" ") for x in SPAN.split(", "))) + ">>"


def proposals(documents: DataFrame, known: Known) -> DataFrame:
    """(doc_id, spans) of each document with a text: what `propose` gives, values included."""
    sent = Shipped(documents.sparkSession, known)
    small = pa.list_(pa.int32())
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("votes", small), ("features", small), ("usual", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Known = sent.value
        for batch in batches:
            rows = [
                [{"kind": s.kind, "start": s.start, "end": s.end, "votes": s.votes, "features": s.features, "usual": int(s.usual), "value": t[s.start : s.end]} for s in propose(t, known)]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kinds)], names=["doc_id", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.where("text is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


def fitted(spans: DataFrame, known: Known) -> Model:
    """The model of what `proposals` gives. EM works on the vectors of votes with their counts over all documents, whose number
    is bounded by the labelers; the classifier is trained on at most SAMPLE different spans of each kind, taken by hash."""
    # Pairs with common words are so many that EM would take them for one of the two classes.
    each = spans.select(F.explode("spans").alias("s")).select("s.*").where("usual = 0")
    seen: dict[str, list[tuple[tuple[int, ...], int]]] = {}
    for r in each.groupBy("kind", "votes").count().collect():
        seen.setdefault(r.kind, []).append((tuple(r.votes), r["count"]))
    share = {k: min(1.0, 4.0 * SAMPLE / sum(n for _, n in v)) for k, v in seen.items()}
    weights, reliability = {}, {}
    if share:
        limit = F.create_map(*[F.lit(x) for k, p in sorted(share.items()) for x in (k, p)])
        each = each.select("kind", "votes", "features", F.xxhash64("kind", "value", "features").alias("h"))
        thin = each.where(F.pmod("h", F.lit(1_000_003)) <= F.try_element_at(limit, F.col("kind")) * 1_000_003).groupBy("kind", "votes", "features", "h").agg(F.least(F.count("*"), F.lit(COPIES)).cast("int").alias("n"))
        rows = thin.withColumn("k", F.row_number().over(W.partitionBy("kind").orderBy("h", "features", "votes"))).where(F.col("k") <= SAMPLE).collect()
        sample: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: (r.kind, r.k)):
            sample.setdefault(r.kind, []).append(r)
        for kind, found in sorted(seen.items()):
            if sum(n for _, n in found) < LEAST:
                continue
            found.sort()
            post, right, _ = em(np.array([v for v, _ in found]), np.array([n for _, n in found], float))
            truth = dict(zip((v for v, _ in found), post))
            rows = [r for r in sample[kind] for _ in range(r.n)]
            weights[kind] = logistic([tuple(r.features) for r in rows], np.array([truth[tuple(r.votes)] for r in rows]))
            reliability[kind] = right.round(3).tolist()
    return Model(known, weights, reliability)


PLAIN_WORD = re.compile(r"(?<![\w.+@\-])[^\W\d_]{2,}(?![\w@+]|\.[^\W\d_])")


# What a post repeats of others: quoted lines and blocks.
QUOTES = r"(?im)^[ \t]*(?:>|&gt;).*$|(?s:<blockquote>.{0,20000}?</blockquote>|\[quote[^\[\]]{0,80}\].{0,20000}?\[/quote\])"


def named_pairs(text: str) -> set[tuple[str, str]]:
    """Pairs of capitalised words that stand where a full name is due, in lower case."""
    out, at, places = set(), 0, Due(text)
    while m := NAME.search(text, at):
        at = m.end(1)
        one, two = m.group(1, 3)
        if one[0].isupper() and two[0].isupper() and places.any(m.start(), m.end()):
            out.add((one.lower(), two.lower()))
    return out


def common_words(documents: DataFrame) -> set[str]:
    """Words of the language rather than names: by the share of all documents that have them, and of their uses that
    are in lower case. However often a word is there, it's a name's if of the different texts that have it, without what
    they quote, few have it in lower case and most have it as the second word where a full name is due, or as the first
    with one same word after it. The list is bounded by MOST_WORDS."""
    texts = documents.where("text is not null").select("text")

    def count(named: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # Documents per word are added up batch by batch, so that no document's words are shuffled; at "" stands how
            # many there are. What is counted is a word, with `next` "", or a pair where a name is due.
            for f in frames:
                total: Counter = Counter({("", ""): len(f)})
                low: Counter = Counter()
                for t in f["text"]:
                    words = set(PLAIN_WORD.findall(t))
                    total.update({(w.lower(), "") for w in words})
                    total.update(named_pairs(t) if named else ())
                    low.update({(w, "") for w in words if w == w.lower()})
                yield pd.DataFrame({"w": [w for w, _ in total], "next": [x for _, x in total], "n": list(total.values()), "low": [low[w] for w in total]})

        return run

    def counted(rows: DataFrame, named: bool) -> DataFrame:
        each = rows.mapInPandas(count(named), "w string, next string, n bigint, low bigint")
        return cut(each.groupBy("w", "next").agg(F.sum("n").alias("n"), F.sum("low").alias("low")))

    df = counted(texts, False)
    least = max(3.0, COMMON * sum(r.n for r in df.where("w = ''").collect()))
    df = df.where((F.col("w") != "") & (F.col("n") >= max(3.0, least / 2))).select("w", "n", "low")
    own = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", QUOTES, " "), r"\d+", "0"), r"[ \t]+", " ")
    once = counted(texts.select(own.alias("text")).distinct(), True)  # copies that differ in numbers count once
    pairs = once.where("next <> ''")
    first, second = pairs.groupBy("w").agg(F.max("n").alias("first")), pairs.groupBy(F.col("next").alias("w")).agg(F.sum("n").alias("second"))
    most = F.greatest(F.coalesce("first", F.lit(0)), F.coalesce("second", F.lit(0)))
    names = once.where("next = ''").join(first, "w", "left").join(second, "w", "left").where((F.col("low") < (1 - NAMED) * F.col("n")) & (most >= NAMED * F.col("n")))
    keep = df.where(F.col("n") >= least).join(names.select("w"), "w", "left_anti").unionByName(df.where((F.col("n") < least) & (F.col("low") >= 0.6 * F.col("n"))))
    return {r.w for r in keep.orderBy(F.desc("n"), "w").limit(MOST_WORDS).collect()}


def known_words(documents: DataFrame, names: DataFrame) -> Known:
    """names (name, name_part) is a table of at most MOST_NAMES rows, which is checked."""
    rows = bounded_rows(names.select(F.lower("name").alias("n"), "name_part").where("name is not null"), MOST_NAMES)
    given, family = ({r.n for r in rows if r.name_part == part} for part in ("given", "family"))
    return Known(given, family, common_words(documents) - given - family)


def _proposed(documents: DataFrame, names: DataFrame) -> tuple[DataFrame, Model]:
    known = known_words(documents, names)
    spans = cut(proposals(documents, known))
    return spans, fitted(spans, known)


def model_for(documents: DataFrame, names: DataFrame) -> Model:
    return _proposed(documents, names)[1]


def personal_spans(documents: DataFrame, names: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, kind, start, value): every piece found, start counting characters from 0. Texts that are null or
    empty give none; documents that repeat give their pieces each time; an empty table gives an empty
    result. Other columns are ignored. Spans are proposed once, for fitting and for the result."""
    spans, model = _proposed(documents, names) if model is None else (proposals(documents, model.known), model)
    sent = Shipped(documents.sparkSession, replace(model, known=Known(set(), set(), set())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            for k, spans in enumerate(batch.column(1).to_pylist()):
                value = {(s["start"], s["end"]): s["value"] for s in spans}
                found = m.choose(Span(s["kind"], s["start"], s["end"], s["votes"], s["features"], s["usual"]) for s in spans)
                rows += [(kind, a, value[a, b]) for kind, a, b in found]
                at += [k] * len(found)
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string())))], names=["doc_id", "kind", "start", "value"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return spans.mapInArrow(run, f"doc_id {kind}, kind string, start int, value string")


def redacted(documents: DataFrame, names: DataFrame, model: Model | None = None) -> DataFrame:
    """documents with text replaced by the text in which [EMAIL], [ID_NUMBER], [PHONE], [ADDRESS] and [NAME] stand
    for the pieces found; null stays null."""
    sent = Shipped(documents.sparkSession, model or model_for(documents, names))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(sent.value.redact)

    return documents.withColumn("text", clean("text"))
