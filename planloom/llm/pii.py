"""Personal information in free text by bootstrapped contextual extraction.

1. Seeds: identifiers with a format of their own (formats.py) and a list of given names. Which seed
   names are also ordinary words is counted in the corpus: a spelling that more texts hold in lower
   case than in capitals is one. Every run of name-like words of a text is a slot; its context is the
   two tokens on either side, with typed identifiers, numbers and neighbouring slots as placeholders.
2. Each round scores the graph of patterns and instances over the whole corpus: a pattern (left
   context, right context, or both nearest tokens) is as good as the share of its slots that hold a
   known name, and a word is as name-like as the share of its uses in accepted slots; the parts of
   'first.last' e-mail addresses are such uses too. Accepted slots make their words known, which
   lifts further patterns. Identifiers of every kind are seeds of patterns in the same way: codes with
   many digits, stretches like streets and stretches like addresses of mail that have no known format
   are put out where their left context mostly holds identifiers of one kind.
   A run of more than 7 words (capitals, a heading, names without commas) is cut once lower-case uses
   are known: at words seen more in lower case or hardly ever as names, at titles, before given names
   that follow a surname, and at last after 7 words. The pieces are slots like others.
3. In the last pass slots in good patterns, after a title, or made of known names are put out.
   All-capitals slots without a listed given name need a good pattern, and a word of four letters or
   one that is known as a name: shorter ones are mostly abbreviations.

Scale: texts are tokenised once; their slots are kept in compressed groups of texts. What a round
judges are chains: slots that hang on each other, with their words and contexts but without their
places. Equal chains are judged alike, so each round judges every distinct chain once and weighs it
by its count; the texts are gone through again only to put out. Scores are exact, keyed by 64-bit
hashes of patterns and words, and only those that can matter are kept. Up to `most_keys` of them are
broadcast; beyond, each group of texts or chains asks for the words and then the patterns it holds,
and gets them by joins, with the same results.

Defined results
- null and empty texts, texts without identifiers: no row. Texts are read whole.
- the same stretch several times in a text: one row. Overlaps: formatted identifiers win over names.
- titles and labels are not part of a value; 'Last, First' is one name.
"""

from __future__ import annotations

import json
import pickle
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.formats import typed_spans
from planloom.llm.names import LONG_FORMS, NICKNAMES
from planloom.llm.textfold import fold_word as fold
from planloom.session import cut, drop_cut, spread

# Seed given names (with those of NICKNAMES), titles and particles.
SEED_NAMES = frozenset(
    "amara anais anh bjorn edouard hieu hoang ingrid inigo jean-luc kenji lidia lukasz marie-claude mira noemie priya quynh soren thao tor zoe anna maria peter john james mary thomas daniel david laura julia paul pierre marie sophie claire jose juan carlos ana luis miguel elena sofia hannes giulia marco luca emma olivia noah mia".split()
) | frozenset(NICKNAMES) | frozenset(LONG_FORMS)
TITLES = frozenset(
    "mr mrs ms miss mx dr prof herr frau hr fr sr sra srta dra m mme mlle monsieur madame señor señora don doña ing eng ông bà chị cô ong ba chi co anh professor".split()
)
_LOWER_TITLES = frozenset("ông bà chị cô anh".split())
_SURE_TITLES = frozenset("mr mrs miss mx dr prof herr frau madame monsieur".split())
LONGEST = 7  # words of a slot
PARTICLES = frozenset("van von der den de di del della la le du da dos".split())
_TOKEN = re.compile(r"(\x00\d+\x00|[^\W\d_]+(?:[-'’][^\W\d_]+)*|\d[\w.,:/\-]*|\n|[^\w\s])", re.UNICODE)
_CODE = re.compile(r"(?<![\w.,/:+\-])[A-Z]{0,4}[ \-]?\d(?:[ .\-/]?[\dA-Z]){4,}(?![\w])")
_IN_CODE = re.compile(r"\d(?:[ .\-/]?[\dA-Z]){5}")
_BEGINS = re.compile("[CIsp]")
_NUMBER = re.compile(r"\d{1,5}[A-Za-z]?")
_AT_LIKE = re.compile(r"[@＠]|[(\[{<] ?(?:at|AT|arroba|chez) ?[)\]}>]")
_AFTER_AT = re.compile(r" ?\w[\w-]*(?: ?(?:\.|[(\[{<] ?(?:dot|DOT|punto|point) ?[)\]}>]) ?\w[\w-]*)+")
_PLACE = {"email": "<E>", "phone": "<P>", "id_number": "<I>", "address": "<A>"}


KINDS = ("name", "id_number", "phone", "email", "address")


@lru_cache(maxsize=1 << 18)
def _key(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def _mail_like(text: str, typed: list[tuple[int, int, str]]) -> Iterator[tuple[str, int, int]]:
    """Stretches round an at sign in any of its spellings."""
    for m in _AT_LIKE.finditer(text):
        if any(x <= m.start() < y for x, y, _ in typed):
            continue
        end = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
        begin = end
        while begin > 0 and (text[begin - 1].isalnum() or text[begin - 1] in "_.+-"):
            begin -= 1
        right = _AFTER_AT.match(text, m.end())
        if begin < end and right:
            yield "mail", begin, right.end()


def _street_like(text: str, tokens: list[str], starts: list[int], ends: list[int], kinds: str) -> Iterator[tuple[str, int, int]]:
    """A number and up to four capitalised words behind it or, without such, before it."""
    i = kinds.find("d")
    while i >= 0:
        t, bare = tokens[i], tokens[i].rstrip(".,:/-")
        if _NUMBER.fullmatch(bare) and len(t) - len(bare) <= 1:
            for step, ok in ((1, t[-1] not in ".:/-"), (-1, True)):
                edge, j = i, i + step
                while ok and 0 <= j < len(tokens) and abs(j - i) <= 4 and kinds[j] == "C" and text[ends[min(j, edge)] : starts[max(j, edge)]] in (" ", ", "):
                    edge, j = j, j + step
                if edge != i:
                    yield "street", min(starts[i], starts[edge]), max(starts[i] + len(bare), ends[edge])
                    break
        i = kinds.find("d", i + 1)


class _Remembered(dict):
    """What a function gives for a token: words recur."""

    def __init__(self, of) -> None:  # noqa: ANN001
        super().__init__()
        self.of = of

    def __missing__(self, token: str):  # noqa: ANN204
        if len(self) > 200_000:
            self.clear()
        self[token] = x = self.of(token)
        return x

    def __reduce__(self):  # noqa: ANN204
        return _Remembered, (self.of,)


def _low(t: str) -> str:
    """A token as it stands in a context."""
    return t if t[0] in "<\n" else "#" if t[0].isdigit() else fold(t)


class Spelling:
    """Words as they are compared; `ordinary` holds the spellings that fold to a seed name but are ordinary words."""

    def __init__(self, ordinary: frozenset[str]) -> None:
        self.ordinary = ordinary
        self.known = _Remembered(self._plain)
        self.plain = self.known.__getitem__
        self.kinds = _Remembered(self._kind)
        self.lows = _Remembered(_low)
        self.lower_keys = _Remembered(lambda t: _key("v" + self.plain(t)) if self.kinds[t] == "l" else None)

    def __reduce__(self):  # noqa: ANN204
        return Spelling, (self.ordinary,)

    def _plain(self, w: str) -> str:
        """The folded word; accented ordinary words are told apart from the seed they fold to."""
        bare = w.rstrip(".")
        f = fold(bare)
        return f + "~" if f in SEED_NAMES and not bare.isascii() and bare.lower() in self.ordinary else f

    def _kind(self, t: str) -> str:
        """A letter for a token: capitalised word, initial, particle, seed name in lower case, other word, number, rest."""
        if not t[0].isalpha():
            return "d" if t[0].isdigit() else "."
        if t[0].isupper():
            return "I" if len(t) == 1 else "C"
        f = fold(t)
        if f in PARTICLES:
            return "p"
        return "s" if f in SEED_NAMES and len(f) > 2 and t not in self.ordinary else "l"


class Slot:
    """A run of name-like words: word texts with offsets, and the tokens around."""

    __slots__ = ("before", "code", "left", "piece", "right", "titled", "words")

    def __init__(self, words: list[tuple[str, int, int]], left: list[str], right: list[str], before: int, titled: bool, code: str, piece: bool = False) -> None:
        self.words, self.left, self.right, self.before, self.titled, self.code, self.piece = words, left, right, before, titled, code, piece


def _scan(text: str, typed: list[tuple[int, int, str]]) -> tuple[list[str], list[int], list[int]]:
    """The tokens, where they start and where they end; a typed stretch is one token, its kind's placeholder."""
    tokens: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    at = 0
    for a, b, kind in [*typed, (len(text), len(text), "")]:
        parts = _TOKEN.split(text[at:a])  # tokens stand between the blanks
        edges = list(accumulate(map(len, parts), initial=at))
        tokens += parts[1::2]
        starts += edges[1:-1:2]
        ends += edges[2::2]
        if kind:
            tokens.append(_PLACE[kind])
            starts.append(a)
            ends.append(b)
        at = b
    return tokens, starts, ends


def find_slots(text: str, typed: list[tuple[int, int, str]], spelling: Spelling, lower_case: set[int] | None = None) -> list[Slot]:
    """The slots of a text; lower_case gets the keys of its lower-case words."""
    tokens, starts, ends = _scan(text, typed)
    n = len(tokens)
    kinds = "".join(map(spelling.kinds.__getitem__, tokens))
    lows = spelling.lows
    if lower_case is not None:
        lower_case.update(map(spelling.lower_keys.__getitem__, set(tokens)))
        lower_case.discard(None)
    slots: list[Slot] = []
    last_end = -9
    i = 0
    while begin := _BEGINS.search(kinds, i):
        i = begin.start()
        k = kinds[i]
        # 'de' and 'von' before a name are prepositions; 'van' begins surnames
        if k == "p" and not (lows[tokens[i]] == "van" and i + 1 < n and kinds[i + 1] == "C" and starts[i + 1] == ends[i] + 1):
            i += 1
            continue
        j, words, lower = i, [], k == "s"
        while j < n:
            w, a, b = tokens[j], starts[j], ends[j]
            if words and ((a > words[-1][2] + 3) or text[words[-1][2] : a].strip("\u00a0 ")):
                break
            kj = kinds[j]
            if kj == "I" and j + 1 < n and tokens[j + 1] == "." and starts[j + 1] == b:
                words.append((w + ".", a, b + 1))
                j += 2
                continue
            if kj in "CIp" or (kj == "s" and lower) or (lower and kj == "l" and len(words) < 4 and len(w) > 3):
                words.append((w, a, b))
                j += 1
                if lower and kj == "l":
                    break
                if kj == "C" and j < n and tokens[j] == "." and starts[j] == b and fold(w) in TITLES:
                    j += 1  # the dot of a title
                    words[-1] = (w + ".", a, b + 1)
                continue
            break
        end = j
        while words and fold(words[-1][0]) in PARTICLES:
            words.pop()
        titled = False
        first = i
        while len(words) > 1 and fold(words[0][0].rstrip(".")) in TITLES and (words[0][0] != "Anh"):
            words.pop(0)
            titled = True
        if words and not titled and i > 0 and tokens[i - 1] in _LOWER_TITLES:
            titled = True
            first = i - 1
        if words:
            left = [lows[t] for t in tokens[max(0, first - 2) : first]]
            while len(left) < 2:
                left.insert(0, "\n")
            right = ([lows[t] for t in tokens[end : end + 2]] + ["\n", "\n"])[:2]
            slots.append(Slot(words, left, right, first - last_end, titled, ""))
            last_end = end
        i = max(end, i + 1)
    codes = (("code", *m.span()) for m in _CODE.finditer(text) if sum(c.isdigit() for c in m.group()) >= 6) if _IN_CODE.search(text) else ()
    for what, a, b in (*_mail_like(text, typed), *_street_like(text, tokens, starts, ends, kinds), *codes):
        if all(b <= x or a >= y for x, y, _ in typed):
            k = bisect_right(ends, a)
            before = [lows[t] for t in tokens[max(0, k - 2) : k]]
            slots.append(Slot([(text[a:b], a, b)], (["\n", "\n"] + before)[-2:], ["", ""], 9, False, what))
    # neighbours of a slot as placeholders: C for a slot that follows closely
    names = [s for s in slots if not s.code]
    for s, t in zip(names, names[1:]):
        if 0 < t.before <= 2 and "\n" not in t.left[2 - t.before :]:
            keep = t.before
            s.right = (s.right[:keep] + ["<C>", ""])[:2]
            t.left = (["<C>"] + t.left[2 - keep :])[-2:]
    return slots


class Scores:
    """What the rounds have learnt: (good, all) by the key of a pattern or word."""

    def __init__(self, spelling: Spelling, held: dict[int, tuple[int, int]] | None = None) -> None:
        self.spelling, self.held, self.learnt = spelling, held or {}, held is not None
        self.asked: set[int] | None = None  # where patterns are only listed
        self.judged: dict[Chain, list] = {}

    def word(self, f: str) -> float | None:
        """Share of a word's uses that are names; None when it has hardly been seen."""
        used, seen = self.held.get(_key("w" + f), (0, 0))
        return used / seen if seen >= 3 else None

    def common(self, f: str) -> bool:
        """A word seen more in lower case than in capitals."""
        low = self.held.get(_key("v" + f), (0, 0))[1]
        return (f not in SEED_NAMES or f in self.spelling.ordinary) and low >= 3 and low > self.held.get(_key("w" + f), (0, 0))[1]

    def is_known(self, f: str) -> bool:
        if f in SEED_NAMES:
            return True
        used, seen = self.held.get(_key("w" + f), (0, 0))
        return used >= 2 and used >= 0.6 * seen

    def given(self, f: str) -> bool:
        """A given name: listed, or mostly the first word of accepted names of several words."""
        if f in SEED_NAMES:
            return True
        first, uses = self.held.get(_key("g" + f), (0, 0))
        return first >= 3 and first >= 0.7 * uses and self.is_known(f)

    def pattern(self, key: str, kind: int) -> float:
        k = _key(f"{kind}{key}")
        if self.asked is not None:
            self.asked.add(k)
        good, every = self.held.get(k, (0, 0))
        return good / (every + 0.5) if good >= 2 else 0.0


def _keys(left: list[str], right: list[str]) -> tuple[str, str, str]:
    return "l" + " ".join(left), "r" + " ".join(right), "m" + left[-1] + " | " + right[0]


def _shouted(words: list[tuple[str, int, int]], plain) -> bool:  # noqa: ANN001
    return all(w[0].isupper() for w in words) and any(len(plain(w[0])) > 1 for w in words)


def pieces(s: Slot, scores: Scores) -> list[Slot]:
    """A slot of more than LONGEST words cut into slots; the words between them are context."""
    n = len(s.words)
    ordinary = scores.spelling.ordinary
    plain = [scores.spelling.plain(w[0]) for w in s.words]
    around = [*s.left, *plain, *s.right]  # word k stands at k + 2
    out: list[Slot] = []
    a, titled = 0, s.titled

    def close(b: int) -> None:
        if b > a:
            out.append(Slot(list(s.words[a:b]), around[a : a + 2], around[b + 2 : b + 4], s.before if a == 0 else 9, titled, "", True))

    for k, f in enumerate(plain):
        share = scores.word(f)
        given = scores.given(f) and f not in ordinary
        is_title = f in _SURE_TITLES and k + 1 < n
        # 'WILL' is a name only before one
        word_too = f in SEED_NAMES and f in ordinary and scores.common(f) and not (k + 1 < n and scores.is_known(plain[k + 1]))
        odd = len(f) > 1 and not scores.given(f) and f not in PARTICLES and ((share is not None and share < 0.15) or scores.common(f))
        if is_title or word_too or odd:
            if titled and k == a and not is_title and not scores.common(f):
                continue  # a title outweighs a word's share
            close(k)
            a, titled = k + 1, is_title
        elif k > a and ((given and len(plain[k - 1]) > 1 and not scores.given(plain[k - 1]) and plain[k - 1] not in PARTICLES) or k - a >= LONGEST):
            close(k)
            a, titled = k, False
    close(n)
    return out


def trimmed(s: Slot, scores: Scores) -> tuple[list[tuple[str, int, int]], list[str], list[str]]:
    """The slot without leading and trailing words that are hardly ever names, and its contexts."""
    words = list(s.words)
    left, right = list(s.left), list(s.right)
    _plain = scores.spelling.plain
    capitals = _shouted(words, _plain)

    def odd(w: str) -> bool:
        f = _plain(w)
        if len(f) == 1 or scores.given(f) or f in PARTICLES:
            return False
        share = scores.word(f)
        return (share is not None and share < 0.15) or (capitals and scores.common(f))

    while words and not s.titled and (odd(words[0][0])):
        left = [left[-1], _plain(words.pop(0)[0])]
    tail = len(words)
    for k in range(1, len(words)):
        if odd(words[k][0]):
            tail = k
            break
    if tail < len(words):
        right = ([_plain(w[0]) for w in words[tail:]] + right)[:2]
        words = words[:tail]
    while words and (_plain(words[-1][0]) in PARTICLES or len(words[-1][0]) == 1):
        words.pop()
    return words, left, right


def _rest(s: Slot, words: list[tuple[str, int, int]], scores: Scores) -> Slot | None:
    """What follows the word at which trimmed() cut a slot short, as a slot of its own."""
    if not words or words[-1][2] >= s.words[-1][2]:
        return None
    _plain = scores.spelling.plain
    after = [w for w in s.words if w[1] > words[-1][1]]
    if len(after) < 2:
        return None
    return Slot(after[1:], [_plain(words[-1][0]), _plain(after[0][0])], s.right, 9, False, "", s.piece)


# Kinds (places in KINDS) that a stretch without a known format may have.
_CODE_KINDS = {"code": (1, 2), "mail": (3,), "street": (4,)}


def judge(slots: list[Slot], scores: Scores, threshold: float) -> list[tuple[Slot, list[tuple[str, int, int]], bool, tuple[str, str, str], bool]]:
    """(slot, words, accepted, pattern keys, holds a known name) for each slot, left to right."""
    out = []
    previous = False
    _plain = scores.spelling.plain
    waiting = list(reversed(slots))
    while waiting:
        s = waiting.pop()
        if len(s.words) > LONGEST and not s.piece:
            # without counts of lower-case words there is nothing to cut by
            waiting += reversed(pieces(s, scores) if scores.learnt else [])
            continue
        words, left, right = trimmed(s, scores)
        rest = _rest(s, words, scores)
        if rest is not None:
            waiting.append(rest)
        if 0 < s.before <= 2 and left and left[0] == "<C>":
            follows = ["<N>", *left[1:]]
            if scores.asked is not None and words:
                for k in _keys(follows, right):
                    scores.pattern(k, 0)
            if previous:
                left = follows
        if not words:
            out.append((s, words, False, ("", "", ""), False))
            previous = False
            continue
        keys = _keys(left, right)
        plain = [_plain(w[0]) for w in words]
        known = any(scores.is_known(f) for f in plain if len(f) > 1)
        good = max(scores.pattern(k, 0) for k in keys)
        spelled = [f for f in plain if len(f) > 1 and f not in PARTICLES]
        lower = words[0][0][0].islower() and plain[0] not in PARTICLES
        seeds = scores.given(plain[0]) or scores.given(plain[-1])
        shouted = _shouted(words, _plain) and not s.titled
        full = len(spelled) >= 2 and (scores.given(plain[0]) or scores.given(plain[-1])) and not lower
        accepted = bool(spelled) and ((s.titled and not lower) or good >= threshold or (full and good >= threshold / 4) or (full and scores.given(plain[0]) and scores.word(spelled[-1]) is None))
        if s.piece and full and scores.given(plain[0]) and scores.is_known(spelled[-1]):
            accepted = True
        if shouted and not seeds:
            accepted = good >= threshold and any(len(f) > 3 or scores.is_known(f) for f in spelled)
        if lower and len(spelled) < 2:
            accepted = False
        out.append((s, words, accepted, keys, known))
        previous = accepted
    return out


# A chain: slots whose judgement doesn't hang on other slots, without offsets; each one is (words, left, right, before, titled).
Chain = tuple[tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], int, bool], ...]


def _chains(slots: list[Slot]) -> Iterator[tuple[Chain, list[tuple[int, int]]]]:
    """The chains of a text's slots with the offsets of their words. Long slots stay with the slot before, which is the one that counts where they have no pieces."""
    chain: list = []
    at: list[tuple[int, int]] = []
    for s in slots:
        if s.code:
            continue
        before = s.before if 0 < s.before <= 2 else 9
        if chain and not (before < 9 and "<C>" in s.left) and len(s.words) <= LONGEST:
            yield tuple(chain), at
            chain, at = [], []
        chain.append((tuple([w[0] for w in s.words]), tuple(s.left), tuple(s.right), before, s.titled))
        at += [w[1:] for w in s.words]
    if chain:
        yield tuple(chain), at


def _slots_of(chain: Chain) -> list[Slot]:
    """The slots of a chain; a word's offset is its place in the chain."""
    out, k = [], 0
    for words, left, right, before, titled in chain:
        out.append(Slot([(w, i, i + 1) for i, w in enumerate(words, k)], list(left), list(right), before, titled, ""))
        k += len(words)
    return out


def _stretches(chain: Chain, scores: Scores, threshold: float) -> list[tuple[int, int, bool, bool, bool]]:
    """(first word, last word, accepted, may be the surname, may be the given names of 'Last, First') of what a chain's slots are judged to hold."""
    known = scores.judged.get(chain)
    if known is None:
        slots = _slots_of(chain)
        begin, end = {s.words[0][1] for s in slots}, {s.words[-1][2] for s in slots}
        known = []
        for _, words, accepted, _, _ in judge(slots, scores, threshold):
            if not words:
                known.append((-1, -1, False, False, False))
                continue
            f = [scores.spelling.plain(w[0]) for w in words]
            last = len(f) <= 2 and words[-1][2] in end and not any(scores.given(x) and len(x) > 3 for x in f)
            first = len(f) <= 2 and words[0][1] in begin and (scores.given(f[0]) or (len(f[0]) == 1 and words[0][0].endswith("."))) and all(len(x) == 1 for x in f[1:])
            known.append((words[0][1], words[-1][1], accepted, last, first))
        if len(scores.judged) > 100_000:
            scores.judged.clear()
        scores.judged[chain] = known
    return known


def _joined(found: list[tuple[int, int, bool, bool, bool]], text: str) -> list[tuple[int, int]]:
    """The accepted stretches; 'Last, First' becomes one."""
    spans: list[tuple[int, int]] = []
    k = 0
    while k < len(found):
        x, y, accepted, last, _ = found[k]
        if last and k + 1 < len(found):
            then, until, ok, _, first = found[k + 1]
            if first and (accepted or ok) and then == y + 2 and text[y:then] == ", ":
                spans.append((x, until))
                k += 2
                continue
        if accepted:
            spans.append((x, y))
        k += 1
    return spans


def _ordinary(docs: DataFrame) -> frozenset[str]:
    """Lower-case spellings that fold to a seed name and stand in lower case in three texts more than in capitals, or beyond.

    Words are counted in the JVM; what is collected are spellings of the seed list."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}+(?:[-'’]\p{L}+)*"), F.lit(0)))
    counts = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[fold(w) in SEED_NAMES for w in b["w"]]]

    low: dict[str, int] = {}
    for r in counts.mapInPandas(seeds, "w string, n long").collect():
        low[r.w.lower()] = low.get(r.w.lower(), 0) + (r.n if r.w[0].islower() else -r.n)
    return frozenset(w for w, n in low.items() if n >= 3)


GROUP, GROUP_CHARS = 500, 500_000  # texts and characters of a group, the last text in full
MOST_COUNTED = 100_000  # chains, and keys, that a task counts before it passes the counts on


def _packed(chains: list[Chain], rest: list) -> tuple[int, bytes]:
    blob = zlib.compress(pickle.dumps((chains, rest), protocol=5), 1)
    return xxhash.xxh3_64_intdigest(blob) - (1 << 63), blob


def _load(blob: bytes) -> tuple[list[Chain], list]:
    return pickle.loads(zlib.decompress(blob))  # noqa: S301 - written by _packed


def slots_table(docs: DataFrame, spelling: Spelling) -> DataFrame:
    """Three kinds of rows: (gid, blob), groups of texts with their chains, codes and typed stretches, compressed;
    (chain, n), how often a task saw a chain; (key, good, n), its counts of what no round changes: lower-case words, contexts of typed stretches, names in addresses of mail."""
    columns = ["gid", "blob", "chain", "key", "good", "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often: Counter = Counter()
        every: Counter = Counter()
        good: Counter = Counter()

        def counted() -> pd.DataFrame:
            rows = [(None, None, json.dumps(c, ensure_ascii=False, separators=(",", ":")), None, None, n) for c, n in often.items()] + [(None, None, None, k, good[k], n) for k, n in every.items()]
            often.clear(), every.clear(), good.clear()
            return pd.DataFrame(rows, columns=columns, dtype=object)

        for b in batches:
            out, rows, size, places = [], [], 0, {}
            for d, t in zip(b["doc_id"], b["text"]):
                typed = typed_spans(t)
                low: set[int] = set()
                slots = find_slots(t, typed, spelling, low)
                refs = []
                for chain, at in _chains(slots):
                    often[chain] += 1
                    refs.append((places.setdefault(chain, len(places)), at))
                every.update(low)
                for x, y, kind in typed:
                    left = _around(t, x)
                    for i in (1, 2, 3, 4):
                        k = _key(f"{i}l{left}")
                        every[k] += 1
                        good[k] += kind == KINDS[i]
                    for f in _mail_names(t[x:y]) if kind == "email" else ():
                        k = _key("w" + f)
                        every[k] += 1
                        good[k] += 1
                rows.append((d, t, typed, [(s.code, *s.words[0][1:], s.left) for s in slots if s.code], refs))
                size += len(t)
                if len(rows) == GROUP or size > GROUP_CHARS:
                    out.append(_packed(list(places), rows))
                    rows, size, places = [], 0, {}
            if rows:
                out.append(_packed(list(places), rows))
            yield pd.DataFrame([(*x, None, None, None, None) for x in out], columns=columns, dtype=object)
            if len(often) > MOST_COUNTED or len(every) > MOST_COUNTED:
                yield counted()
        yield counted()

    return docs.mapInPandas(run, "gid long, blob binary, chain string, key long, good long, n long")


def chains_table(slots: DataFrame) -> DataFrame:
    """(gid, blob): every distinct chain with the times it stands in the texts, in compressed groups."""
    spark = slots.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # tasks have counted their own chains; a fixed number of parts, since judging costs more than the bytes tell
    counts = slots.where("chain IS NOT NULL").select("chain", "n").repartition(parts, "chain").groupBy("chain").agg(F.sum("n").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            chains, n = b["chain"].tolist(), b["n"].tolist()
            yield pd.DataFrame([_packed([json.loads(c) for c in chains[i : i + 1000]], n[i : i + 1000]) for i in range(0, len(n), 1000)], columns=["gid", "blob"])

    return counts.mapInPandas(run, "gid long, blob binary")


def _around(text: str, a: int) -> str:
    left = [fold(x) if x[0].isalpha() else "#" if x[0].isdigit() else x for x in _TOKEN.findall(text[max(0, a - 60) : a])][-2:]
    return " ".join((["\n", "\n"] + left)[-2:])


def _mail_names(t: str) -> list[str]:
    """The parts of a 'first.last' local part."""
    parts = re.split(r"[._\-+]", re.split(r"\s?[@＠(\[{]", t, maxsplit=1)[0])
    return [fold(p) for p in parts if len(p) > 2 and p.isalpha()] if len(parts) > 1 else []


class Learning:
    """Rounds over a table of chains and the counts that stay; `scored` lends each group the scores it needs."""

    def __init__(self, chains: DataFrame, fixed: DataFrame, spelling: Spelling, most_keys: int, threshold: float) -> None:
        self.chains, self.fixed, self.most, self.threshold = chains, fixed, most_keys, threshold
        self.spelling = spelling
        self.scores: DataFrame | None = None

    def scored(self, table: DataFrame, use, schema: str) -> DataFrame:  # noqa: ANN001
        """use(chains, rest, Scores) for every group of the table."""
        spelling, scores = self.spelling, self.scores
        if scores is None or scores.count() <= self.most:
            rows = None if scores is None else scores.toPandas()
            held = None if rows is None else dict(zip(rows["key"].tolist(), zip(rows["good"].tolist(), rows["n"].tolist())))
            shared = table.sparkSession.sparkContext.broadcast(held)

            def from_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                s = Scores(spelling, shared.value)
                for b in batches:
                    for blob in b["blob"]:
                        yield use(*_load(blob), s)

            return table.select("blob").mapInPandas(from_all, schema)
        asked = _asked(table, scores, lambda blob, held: _word_keys(blob, spelling), ["blob"])
        threshold = self.threshold
        both = _asked(asked, scores, lambda blob, held: _pattern_keys(blob, spelling, held, threshold), ["blob", "held"])

        def from_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for blob, held in zip(b["blob"], b["held"]):
                    yield use(*_load(blob), Scores(spelling, _as_dict(held)))

        return both.select("blob", "held").mapInPandas(from_own, schema)

    def round(self, first: bool) -> None:
        threshold, plain = self.threshold, self.spelling.plain

        def tally(chains: list[Chain], times: list[int], now: Scores) -> pd.DataFrame:
            counts: dict[int, list[int]] = {}

            def add(key: str, good: bool, n: int) -> None:
                c = counts.setdefault(_key(key), [0, 0])
                c[0] += n if good else 0
                c[1] += n

            for chain, n in zip(chains, times):
                counted: set[int] = set()
                for s, words, accepted, keys, known in judge(_slots_of(chain), now, threshold):
                    if words:
                        for key in keys:
                            add("0" + key, known, n)
                    if accepted and len(words) > 1:
                        for w, a, _ in words:
                            if len(plain(w)) > 1 and plain(w) not in PARTICLES:
                                add("g" + plain(w), a == words[0][1], n)
                    inside = {w[1] for w in words} if accepted or (first and known and len(words) > 1 and plain(words[0][0]) in SEED_NAMES) else set()
                    for w, a, _ in words:
                        f = plain(w)
                        if len(f) > 1:
                            add("w" + f, a in inside, n)
                    at = {a for _, a, _ in words}
                    for w, a, _ in s.words:
                        if a not in at and a not in counted and len(plain(w)) > 1:
                            add("w" + plain(w), False, n)
                            counted.add(a)
                    counted |= at
            return pd.DataFrame([(k, g, n) for k, (g, n) in counts.items()], columns=["key", "good", "n"])

        counts = self.scored(self.chains, tally, "key long, good long, n long").unionByName(self.fixed).groupBy("key").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
        # A pattern needs two good slots, a word, its lower case or its first places three uses; the rest never counts.
        new = cut(counts.where("n >= 3 or good >= 2"), "scores")
        if self.scores is not None:
            drop_cut(self.scores)
        self.scores = new


def _as_dict(held) -> dict[int, tuple[int, int]]:  # noqa: ANN001
    return {r["key"]: (r["good"], r["n"]) for r in held}


def _asked(table: DataFrame, scores: DataFrame, ask, columns: list[str]) -> DataFrame:  # noqa: ANN001
    """(gid, blob, held): what the scores hold of the keys that ask(blob, held so far) lists for each group, with those held so far."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for gid, blob, held in zip(b["gid"], b["blob"], b["held"] if "held" in columns else [None] * len(b)):
                yield pd.DataFrame({"gid": gid, "key": list(ask(blob, held))}).astype({"gid": "int64", "key": "int64"})

    # one group's keys are bounded by the group's size
    got = table.select("gid", *columns).mapInPandas(keys, "gid long, key long").join(scores, "key").groupBy("gid").agg(F.collect_list(F.struct("key", "good", "n")).alias("got"))
    none = F.array().cast("array<struct<key:bigint,good:bigint,n:bigint>>")
    j = table.join(got, "gid", "left")
    before = F.col("held") if "held" in columns else none
    return cut(j.select("gid", "blob", F.concat(before, F.coalesce("got", none)).alias("held")), "asked")


def _word_keys(blob: bytes, spelling: Spelling) -> set[int]:
    plain = {spelling.plain(w) for chain in _load(blob)[0] for words, *_ in chain for w in words}
    return {_key(x + f) for f in plain for x in "wvg"}


def _pattern_keys(blob: bytes, spelling: Spelling, held, threshold: float) -> set[int]:  # noqa: ANN001
    scores = Scores(spelling, _as_dict(held))
    scores.asked = set()
    chains, rest = _load(blob)
    for chain in chains:
        judge(_slots_of(chain), scores, threshold)
    for row in rest:
        for code, _, _, left in row[3] if isinstance(row, tuple) else ():  # chains have counts instead of texts
            _code_score(code, left, scores)
    return scores.asked


def _code_score(code: str, left: list[str], scores: Scores) -> tuple[float, int]:
    """The best score of the kinds that a stretch without a known format may have, and that kind's place in KINDS."""
    key = _keys(left, ["", ""])[0]
    score, kind = max((scores.pattern(key, i), -i) for i in _CODE_KINDS[code])
    return score, -kind


def find_pii(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 3, threshold: float = 0.5, most_keys: int = 1_000_000) -> DataFrame:
    """(doc_id, start, end, kind, pii_text, by): every stretch of personal information; offsets in code points; `by` is 'format' or 'pattern'."""
    docs = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0))
    spelling = Spelling(_ordinary(docs))
    table = cut(slots_table(docs, spelling), "slots")
    chains = cut(chains_table(table), "chains")
    fixed = cut(table.where("key IS NOT NULL").groupBy("key").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "fixed")
    learning = Learning(chains, fixed, spelling, most_keys, threshold)
    for k in range(rounds):
        learning.round(k == 0)
    drop_cut(chains)
    drop_cut(fixed)

    def put_out(chains: list[Chain], texts: list[tuple], scores: Scores) -> pd.DataFrame:
        rows = []
        judged = [_stretches(c, scores, threshold) for c in chains]
        for d, t, typed, codes, refs in texts:
            rows += [(d, x, y, k, t[x:y], "format") for x, y, k in typed]
            found = [(at[i][0], at[j][1], *more) if i >= 0 else (-1, -1, *more) for k, at in refs for i, j, *more in judged[k]]
            spans = _joined(found, t)
            rows += [(d, x, y, "name", t[x:y], "pattern") for x, y in spans]
            for code, a, b, left in codes:
                score, kind = _code_score(code, left, scores)
                if score >= 0.8 and all(b <= x or a >= y for x, y in (spans if code != "code" else ())):
                    rows.append((d, a, b, KINDS[kind], t[a:b], "pattern"))
        return pd.DataFrame(rows, columns=["doc_id", "start", "end", "kind", "pii_text", "by"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start int, end int, kind string, pii_text string, by string"
    return learning.scored(table.where("blob IS NOT NULL").select("gid", "blob"), put_out, schema)


def redact(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """documents with `redacted`: each stretch replaced by its kind in brackets, the rest as it stands. Of overlapping stretches the first counts."""
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end", "kind"))).alias("spans"))
    joined = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(spans, "doc_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, found_in in zip(b["text"], b["spans"]):
                if t is None or found_in is None:
                    out.append(t)
                    continue
                parts, at = [], 0
                for x in found_in:
                    if x["start"] >= at:
                        parts += [t[at : x["start"]], f"[{x['kind'].upper()}]"]
                        at = x["end"]
                out.append("".join(parts) + t[at:])
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": b["text"], "redacted": out})

    return joined.mapInPandas(run, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, text string, redacted string")
