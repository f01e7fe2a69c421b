"""Rank-order n-gram profiles of languages and the out-of-place distance to them.

A profile ranks a language's most frequent n-grams (two and three characters inside a word, its
edges included). A text's distance to a profile sums, over its n-grams, how far each one's rank in
the text is from its rank in the profile; an n-gram that the profile lacks counts as its length. In
a single cue hardly an n-gram occurs twice, so all share the first rank there.
"""

from __future__ import annotations

import numpy as np

#: N-grams a profile keeps, of each length.
KEPT = 1200
#: A sum of rank differences of this many units is one step of the stored distance.
UNIT = 16

# Fixed value: letters besides a to z that have a symbol of their own.
LETTERS = "áàâäãåéèêëíìîïóòôöõúùûüñçßœæøýÿ"
OTHER = 63


def _symbols() -> np.ndarray:
    table = np.zeros(65536, np.uint8)
    for code in range(65536):
        if chr(code).isalpha():
            table[code] = OTHER
    table[0xD800:0xE000] = OTHER
    for k, c in enumerate("abcdefghijklmnopqrstuvwxyz" + LETTERS):
        table[ord(c)] = k + 1
    return table


SYMBOLS = _symbols()


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts (in lower case), each led by a 0 and with one 0 between words, and the position where each text starts."""
    raw = np.frombuffer(("\n" + "\n".join(t.replace("\n", " ") for t in texts)).encode("utf-16-le", "surrogatepass"), np.uint16)
    symbols, leads = SYMBOLS[raw], raw == 10
    keep = leads.copy()
    keep[1:] |= (symbols[1:] != 0) | (symbols[:-1] != 0)
    return symbols[keep], np.cumsum(keep)[leads] - 1


def grams(symbols: np.ndarray) -> np.ndarray:
    """At each position the code of the three symbols there; the text is padded by word ends."""
    s = np.concatenate([symbols.astype(np.int32), np.zeros(2, np.int32)])
    return (s[:-2] << 12) | (s[1:-1] << 6) | s[2:]


def profile(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of two- and of three-character n-grams; KEPT where one isn't in the profile. Equal counts
    rank by code."""
    code = grams(encode(texts)[0])
    a, b, c = code >> 12, code >> 6 & 63, code & 63
    two = code[(a > 0) | (b > 0)] >> 6
    three = code[(b > 0) & ((a > 0) | (c > 0))]
    ranks = []
    for found, size in ((two, 1 << 12), (three, 1 << 18)):
        count = np.bincount(found, minlength=size)
        order = np.argsort(-count, kind="stable")[:KEPT]
        order = order[count[order] > 0]
        rank = np.full(size, KEPT, np.int32)
        rank[order] = np.arange(len(order))
        ranks.append(rank)
    return ranks[0], ranks[1]


class Profiles:
    """Profiles of several languages, as one table from the three symbols at a position to the distances
    that its two n-grams add."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(k for k, v in texts.items() if any(SYMBOLS[ord(c)] for t in v for c in t if ord(c) < 65536))
        code = np.arange(1 << 18)
        a, b, c = code >> 12, code >> 6 & 63, code & 63
        self.table = np.zeros((1 << 18, len(self.languages)), np.uint16)
        self.ranks = [profile(texts[k]) for k in self.languages]
        for k, (two, three) in enumerate(self.ranks):
            self.table[:, k] = np.where((a > 0) | (b > 0), two[code >> 6], 0) + np.where((b > 0) & ((a > 0) | (c > 0)), three, 0)

    def distances(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): sums of out-of-place distances in UNITs."""
        if not texts:
            return np.zeros((0, len(self.languages)), np.int64)
        symbols, starts = encode(texts)
        return np.add.reduceat(self.table[grams(symbols)], starts, axis=0, dtype=np.int64) // UNIT

    def out_of_place(self, text: str, most: int = 400) -> np.ndarray:
        """Mean distance of the most frequent n-grams of a longer text, ranked, to each language's, from 0 to 1."""
        return self.ranked_distance(encode([text])[0], most)

    def ranked_distance(self, symbols: np.ndarray, most: int = 400) -> np.ndarray:
        """out_of_place of encoded text."""
        code = grams(symbols)
        a, b, c = code >> 12, code >> 6 & 63, code & 63
        out = np.zeros(len(self.languages))
        for k, (found, size) in enumerate(((code[(a > 0) | (b > 0)] >> 6, 1 << 12), (code[(b > 0) & ((a > 0) | (c > 0))], 1 << 18))):
            if len(found) > 20_000:
                count = np.bincount(found, minlength=size)
                held = np.flatnonzero(count)
                count = count[held]
            else:
                held, count = np.unique(found, return_counts=True)
            order = np.argsort(-count, kind="stable")[:most]
            top, n = held[order], count[order]
            # Equally frequent n-grams share their mean rank, or the order of their codes would count.
            new = np.ones(len(n), bool)
            new[1:] = n[1:] != n[:-1]
            group = np.cumsum(new) - 1
            rank = (np.bincount(group, np.arange(len(n))) / np.bincount(group))[group] if len(n) else np.zeros(0)
            for j, ranks in enumerate(self.ranks):
                r = ranks[k][top]
                away = np.where(r < KEPT, np.minimum(np.abs(r - rank), KEPT), KEPT)
                out[j] += away.mean() / KEPT / 2 if len(top) else 0.5
        return out


def trained(labelled: list[tuple[str, str, str]], rounds: int = 2) -> Profiles:
    """Profiles from (group, language, text), where the language is the group's label and some labels are
    wrong: after each round groups and texts that are nearer to another language are left out."""
    kept = [x for x in labelled if x[2]]
    model = Profiles(_by_language(kept))
    for _ in range(rounds):
        if len(model.languages) < 2:
            break
        of = {x: k for k, x in enumerate(model.languages)}
        d = model.distances([x[2] for x in kept])
        total: dict[str, np.ndarray] = {}
        for (group, _, _), row in zip(kept, d):
            total[group] = total.get(group, 0) + row
        right = [(total[g] if x else d[k]).argmin() == of.get(lang, -1) for x in (1, 0) for k, (g, lang, _) in enumerate(kept)]
        n = len(kept)
        sound = [x for k, x in enumerate(kept) if right[k] and right[n + k]]
        if {x[1] for x in sound} != {x[1] for x in kept if x[1] in of}:
            break
        kept = sound
        model = Profiles(_by_language(kept))
    return model


def _by_language(rows: list[tuple[str, str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for _, lang, text in rows:
        out.setdefault(lang, []).append(text)
    return out
