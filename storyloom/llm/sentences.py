"""Sentence units of texts in any language and script (problem 1).

A linear-chain model tags characters as the last of a unit (boundary) or as inside one; Viterbi decoding finds the best
tagging of a line. Only characters at a place — behind an end mark with what closes after it, at a gap of a script that marks no
ends, or between two characters of an unmarked line in Han or kana — can be boundaries. Emission and transition weights are learned from a
sample of the corpus itself: from texts whose typist sets sentences apart by two spaces, and from texts whose line breaks or
marks were stripped, so that the places where they stood are known ends. Word lists only serve as features.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sampling import sample_of_bytes

#: Characters of text, for each kind of script, on which the model is trained: chosen by hash, about so many at most.
TRAINING_CHARS = 2_000_000
#: A text shows its sentence ends by two spaces if it has at least so many such gaps behind a mark.
LEAST_WIDE_GAPS = 3
#: Rounds of training, and by how much a mistake changes a weight.
ROUNDS, STEP = 5, 0.5

_UNSEEN = "\xad\u200b-\u200f\u2060\ufeff"
_BREAKS = "\n\r\x0b\x0c\x85\u2028\u2029"
_ENDS = ".!?…。！？।॥؟۔｡‼⁇⁈⁉"
_FULL = "。！？｡।॥؟۔"
_BARE = "\u0e00-\u0eff\u1780-\u17ff\u1000-\u109f"  # Thai, Lao, Khmer, Burmese: no sentence ends are marked
_QUOTED = "\"'”’»›」』）)】〉》\\]“"
_CLOSE = f"(?P<close>(?:[{_UNSEEN}]|[ \xa0\u202f\u2009]*»(?!\\w)|[”’›」』）)】〉》\\]]|[\"'“](?!\\w))*)(?P<gap>[^\\S{_BREAKS}]*)"
_MARK = f"(?P<mark>(?<=\\.)(?:[ \xa0\u202f]\\.){{2,}}|(?<=[。！？!?])[。！？!?]*(?=…+[\u3040-\u30ff\u3400-\u9fff])|[{_ENDS}]*){_CLOSE}"
#: A line's end, or a mark with what closes after it. The first character alone decides whether to look further.
_STOP = f"[{_BREAKS}{_ENDS}](?:(?<=[{_BREAKS}])(?P<line>[{_BREAKS}]*)|(?<=[{_ENDS}]){_MARK})"
_PLACE = re.compile(_STOP)
_PLACE_OR_GAP = re.compile(f"{_STOP}|(?<=[{_BARE}”\"'’)\\d])(?P<bare>[^\\S{_BREAKS}]+)(?=[{_BARE}“\"'‘(\\d])")
_UNMARKED = re.compile(f"[{_BARE}]")
_STRIP = re.compile(f"[{_UNSEEN}]")
_SKIP = re.compile(f"[{_UNSEEN}][{_UNSEEN}\\s]*")
_HAS_WORD = re.compile(r"\w")
_CLAUSE = re.compile(f"[^{_ENDS}{_BREAKS}]*")
_NEXT = re.compile(f"[^\\s{_ENDS}]+")
_LEADING = re.compile(r"^[\W_]+")
_DOTTED = re.compile(r"(?:[^\W\d_]\.-?)+[^\W\d_]")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th)")
_HAN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uac00-\ud7af]")
_HAN_RUN = re.compile(r"[\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")
_ANY_MARK = re.compile(f"[{_ENDS}、，；：,;:·・「」『』“”（）《》]")
_LINE_END = re.compile(f"[{_BREAKS}]")
_UNSEEN_SET = frozenset("\xad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff")
_DASH = "—–―-"
_OPENING = "“\"‘«„「『¿¡([（" + _DASH
_LEFT_MARKS = "\"'“‘«„([{¿¡—–-「『"

# Features by lists. Words before a figure that an article and a full stop make an ordinal.
_ARTICLES = frozenset("im am vom zum beim der die das den dem des ein eine seit bis".split())
# Abbreviations (lower case, without the last full stop) that a capital follows within a sentence.
_BEFORE_NAME = frozenset(
    "dr mr mrs ms prof st sr sra dra srta dña mme mlle mgr me m hr fr hrn rev gen col capt lt sgt cpl maj gov sen rep hon pres messrs vs v cf bzw ca z d p pp av bd ing dipl geb gest ud uds vd excmo г гр д ул пр им проф акад т ср тыс млн млрд mio mrd bn пл डॉ पं श्री د أ ดร"
    .split()
)
# Abbreviations that end a sentence only before a capital.
_MAY_END = frozenset("etc ex jr inc co ltd corp bros esq usw usf uvm u.a approx am pm a.m p.m h hrs pts min sec ft lb oz kg km cm mm j.-c ap ch.d n.chr v.chr p.s и.т.д др пр.к".split())
# Abbreviations before a figure.
_BEFORE_FIGURE = frozenset("no nr nos núm n num vol ch chap fig sec art kap abb abs s p pp lv lvl bd t tab eq ed par pag pág стр рис гл № тел cap".split())
_NEVER_LAST = frozenset("i.e e.g z.b d.h p.ex p.ej u.a. o.ä s.o s.u т.е т.д".split())
_MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
# Verbs of speech, by which a clause behind a quotation is its tag.
_VERBS = frozenset(
    "said says say asked asks screamed shouted muttered whispered cried replied answered yelled called added snapped growled murmured sighed laughed hissed exclaimed agreed insisted continued demanded wondered told began barked "
    "sagte fragte rief schrie flüsterte murmelte antwortete meinte erwiderte brüllte "
    "dit demanda cria crie répondit murmura ajouta demande s'écria chuchota hurla "
    "dijo preguntó gritó respondió murmuró exclamó susurró añadió contestó "
    "сказал сказала спросил спросила крикнул крикнула ответил ответила прошептал прошептала воскликнул пробормотал закричал".split()
)
_SPOKEN_LAST = re.compile(r"(?:说|道|问|喊|答|叫|嚷|說|問|叫道|कहा|पूछा|बोला|बोली|चिल्लाया|चिल्लाई)(?:着|了)?$")
_SPOKEN_FIRST = re.compile(r"(?:と|って|قال|قالت|سأل|سألت|صاح|صاحت|همس|أجاب|أجابت)")
_PARTICLES = frozenset("de von van der den del la le of the du des di da el".split())
#: The weights with which training begins, by what is seen at a place. A feature not listed begins at 0.
INITIAL = {
    "nothing follows": -8.0, "closing follows": -8.0, "dot inside": -7.0, "dash, small": -6.0, "dash, small after dot": -2.0, "dash, tag": -5.0, "dash, new": 5.0,
    "full, tag": -5.0, "full": 6.0, "tight": -7.0, "tight, capital": 2.0, "tight, capital after dot": -4.0,
    "pause, quoted, goes on": -5.0, "pause, quoted": 4.0, "pause, one word": -4.0, "pause, new": 3.0, "pause": -5.0,
    "number of a list": -6.0, "before a figure": -7.0, "counted": -5.0, "ordinal": -5.0, "initials end": 3.0, "initials": -6.0, "before a name": -6.0, "may end": 3.0, "may end, goes on": -6.0,
    "before a month": -5.0, "closed, small": -4.0, "dot, verb": -5.0, "dot, tag": -3.0, "dot, small": 3.0, "dot": 6.0,
    "call, odd": 2.0, "call, goes on": -5.0, "call, verb": -5.0, "call, small": 2.0, "call, tag": -5.0, "call": 6.0,
    "BB empty": -12.0, "gap": 1.0, "run": -6.0,
}


@dataclass
class Chain:
    """The places of one line: their features, whether a word precedes each since the last, their tags where known, the classes of
    their distances, and their scores."""

    features: list[tuple[str, ...]] = field(default_factory=list)
    filled: list[bool] = field(default_factory=list)
    known: list[bool | None] = field(default_factory=list)
    rooms: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)


def _tagged(text: str, at: int, end: int) -> bool:
    """Whether what begins at ``at``, behind a quotation, begins with the tag that belongs to it."""
    clause = _CLAUSE.match(text, at, end).group().strip()
    if not clause:
        return False
    if _SPOKEN_FIRST.match(clause):
        return ":" not in clause and "：" not in clause
    if _SPOKEN_LAST.search(clause) and not re.search(r"[:：“「«\"]", clause):
        return True
    for k, word in enumerate(clause.split()):
        bare = word.strip(",;:'\"”’").lower()
        if bare in _VERBS:
            return k > 0 or word[0].islower()
        if not (word[0].isupper() or bare in _PARTICLES):
            return False
    return False


def _odd_start(word: str) -> bool:
    """Whether a word in lower case can begin a sentence all the same: a compound, or a name such as 'eBook'."""
    return "-" in word[1:-1] or any(c.isupper() for c in word[1:])


def _situation(text: str, mark: str, close: str, gap: bool, after: int, end: int, token: str, before: str, alone: bool, initials: bool) -> str:
    """What is seen at a place: ``mark`` and ``close``, then the rest of the line from ``after`` to ``end``. ``token`` is the word that
    the mark follows, ``before`` the one ahead of it; ``alone``: the token opens its line; ``initials``: it ends a name of initials."""
    first = text[after]
    if first in ",;:，、；：،؛)]）】”’」』»":
        return "closing follows"
    letter = first.isalnum()
    word = _NEXT.match(text, after, end)
    word = word.group() if word else ""
    if not letter:
        word = _LEADING.sub("", word)
    small = first.islower() if letter else word[:1].islower() and first not in _OPENING
    quoted = bool(close) and any(c in _QUOTED for c in close)
    han = first > "⿿" and bool(_HAN.match(first))
    if mark == "." and not gap and not quoted and not han:
        return "dot inside"
    if first in _DASH:
        inner = after + 1
        while inner < end and text[inner].isspace():
            inner += 1
        if inner < end and text[inner].islower():
            return "dash, small" if mark[-1] != "." or quoted or len(mark) > 1 else "dash, small after dot"
        return "dash, tag" if quoted and _tagged(text, inner, end) else "dash, new"
    if mark[-1] in _FULL:
        return "full, tag" if quoted and _tagged(text, after, end) else "full"
    if not gap and not han and not quoted:
        if mark == "." or first.isdigit() or not first.isupper():
            return "tight"
        return "tight, capital" if set(mark) <= set("!?") else "tight, capital after dot"
    if len(mark) > 1 and mark[-1] == "." or mark[-1] == "…":
        if quoted:
            return "pause, quoted, goes on" if small or _tagged(text, after, end) else "pause, quoted"
        if alone and token.strip("\"“”«„").isalpha():
            return "pause, one word"  # a single word that hesitates
        return "pause, new" if gap and (first.isupper() or first in "“\"«„¿¡—「") else "pause"
    if mark == ".":
        bare = token.lstrip(_LEFT_MARKS).lower()
        if not bare or bare.isdigit() and alone:
            return "number of a list"
        if not close or set(close) <= set(")]"):
            if first.isdigit() and bare in _BEFORE_FIGURE:
                return "before a figure"
            if bare.isdigit() and len(bare) < 3 and before.lower() in _ARTICLES and not small:
                return "counted"
            if _ORDINAL.fullmatch(bare) and small:
                return "ordinal"
            if initials:
                return "initials end" if first.isupper() and text[after + 1 : after + 2] != "." else "initials"
            if bare in _BEFORE_NAME or bare in _NEVER_LAST or len(bare) == 1 and bare.isalpha():
                return "before a name"
            if bare in _MAY_END or _DOTTED.fullmatch(bare):
                return "may end" if first.isupper() or first in "“\"«„¿¡" else "may end, goes on"
            if bare.isdigit() and word.lower().strip(",.;") in _MONTHS:
                return "before a month"
            if close and small:
                return "closed, small"
        if quoted and small and word.strip(",.").lower() in _VERBS:
            return "dot, verb"
        if quoted and not small and _tagged(text, after, end):
            return "dot, tag"
        return "dot, small" if small else "dot"
    if small:
        if quoted:
            return "call, odd" if _odd_start(word.strip("\"'”’,.;:!?")) else "call, goes on"
        return "call, verb" if word.strip(",.").lower() in _VERBS else "call, small"
    return "call, tag" if quoted and _tagged(text, after, end) else "call"


def _kind(c: str) -> str:
    """The class of the character with which the next unit would begin."""
    if c.isupper():
        return "A"
    if c.islower():
        return "a"
    if c.isdigit():
        return "0"
    if c > "⿿":
        return "H" if _HAN.match(c) else c
    return "o" if c.isalpha() else c


def _context(left: str, right: str) -> list[str]:
    """What is seen of a gap between words, or of a joint of an unmarked line: the ends of the stretches around it."""
    return [f"L:{left[-n:]}" for n in (2, 4, 7)] + [f"R:{right[:n]}" for n in (2, 4, 7)]


def _joint(text: str, i: int) -> tuple[str, ...]:
    a, b = text[max(0, i - 3) : i], text[i : i + 3]
    return ("run", f"l:{a[-1:]}", f"l:{a[-2:]}", f"l:{a}", f"r:{b[:1]}", f"r:{b[:2]}", f"r:{b}", f"j:{a[-1:]}{b[:1]}", f"j:{a[-2:]}{b[:2]}")


def _room(n: int) -> str:
    """The class of the distance, in characters, between a place and the one before."""
    return "4" if n < 5 else "12" if n < 13 else "40" if n < 41 else "more"


def viterbi(scores: list[float], filled: list[bool], weights: dict[str, float] | None = None, rooms: list[str] | None = None) -> list[bool]:
    """The best tagging of a chain of places as boundary (True) or inside. ``filled[i]``: a word lies between place
    i - 1, or the beginning, and place i; a unit without one is all but forbidden. ``rooms``: the distances' classes, by
    which the steps boundary–boundary and inside–boundary are weighed."""
    w = weights or INITIAL
    empty = w.get("BB empty", INITIAL["BB empty"])
    inside, boundary = -math.inf, 0.0  # a text begins as behind a boundary
    back: list[tuple[bool, bool]] = []
    for i, (s, full) in enumerate(zip(scores, filled)):
        room = rooms[i] if rooms else ""
        again = (boundary if full else boundary + empty) + w.get("BB" + room, 0.0)
        first = inside + w.get("IB" + room, 0.0)
        back.append((boundary > inside, again > first))
        inside, boundary = max(inside, boundary), max(first, again) + s
    tags: list[bool] = []
    at = boundary > inside
    for from_inside, from_boundary in reversed(back):
        tags.append(at)
        at = from_boundary if at else from_inside
    return tags[::-1]


class Tagger:
    """Weights by feature, and the gap model's among them; ``lines`` gives the places of a text, line by line."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = {**INITIAL, **(weights or {})}
        self.runs = self.weights["run"] != INITIAL["run"]

    def lines(self, text: str, labels: bool = False) -> Iterator[tuple[int, int, list[tuple[int, int]], Chain]]:
        """(start, end, places, chain) of each line; a place is where a unit would end and the next begin. ``labels``: its
        tags are known by its wide gaps, if it has any."""
        bare = not text.isascii() and _UNMARKED.search(text)
        pattern = _PLACE_OR_GAP if bare else _PLACE
        han = self.runs and not text.isascii() and _HAN.search(text)
        start, size = 0, len(text)
        at = 0
        while start <= size:
            m = _LINE_END.search(text, at)
            end = m.start() if m else size
            if start < end:
                yield self._line(text, start, end, pattern, bool(han), labels)
            if not m:
                return
            start = at = m.end()

    def _line(self, text: str, start: int, end: int, pattern: re.Pattern, han: bool, labels: bool) -> tuple[int, int, list[tuple[int, int]], Chain]:
        chain, places, w = Chain(), [], self.weights
        last_word = end  # behind the last character of a word
        looked = False
        behind = opened = start  # where the stretch since the last place, and since the last likely end, begins
        token_from, run = start, 0
        for m in pattern.finditer(text, start, end):
            kind, at, after = m.lastgroup, m.start(), m.end()
            if after >= end:
                continue
            if text[after] in _UNSEEN_SET and (skip := _SKIP.match(text, after, end)):
                after = skip.end()
                if after >= end:
                    continue
            if kind == "bare":
                stop = at
                features = ("gap", *_context(_STRIP.sub("", text[max(start, at - 12) : at]), _STRIP.sub("", text[after : min(end, after + 12)])))
            else:
                stop, close = m.end("close"), m.group("close")
                mark = text[at : m.end("mark")]
                if not looked:
                    looked = True
                    while last_word > start and not _HAS_WORD.match(text, last_word - 1):
                        last_word -= 1
                # The word ahead of the mark: sought back to the last place only, for its beginning is known beyond.
                i = at
                while i > behind and not text[i - 1].isspace():
                    i -= 1
                if i > behind or i == opened or text[i - 1].isspace():
                    token_from = i
                token = text[token_from:at]
                if not token.isascii():
                    token = _STRIP.sub("", token)
                single = len(token) == 1 and "A" <= token <= "Z" and mark == "." and after == stop + 1
                initials = run > 0 and token_from == behind and len(token) == 1 and "A" <= token <= "Z" and text[max(0, token_from - 3 * run - 4) : token_from - 3 * run] == "the "
                run = run + 1 if single and (not run or token_from == behind) else int(single)
                if after >= last_word:
                    what = "nothing follows"
                else:
                    j = token_from - 1
                    before = ""
                    if token.isdigit():
                        while j > start and not text[j - 1].isspace() and token_from - j < 8:
                            j -= 1
                        before = text[j : token_from - 1]
                    i = opened
                    while i < token_from and text[i].isspace():
                        i += 1
                    what = _situation(text, mark, close, after > stop, after, end, token, before, i >= token_from, initials)
                nxt = _NEXT.match(text, after, end)
                features = (what, f"{what}|{_kind(text[after])}", f"{mark[-1]}{bool(close):d}{after > stop:d}{_kind(text[after])}", f"w:{nxt.group().lower() if nxt else text[after]}{bool(close):d}", f"t:{token.lower()}" if mark == "." else f"m:{mark}{close}")
            places.append((stop, m.end()))
            chain.features.append(features)
            chain.filled.append(bool(_HAS_WORD.search(text, behind, stop)))
            chain.rooms.append(_room(stop - behind))
            chain.known.append(kind != "bare" and len(m.group("gap")) > 1 if labels else None)
            s = sum(w[f] for f in features if f in w)
            chain.scores.append(s)
            behind = after
            if s > 0:
                opened = after
        if not any(chain.known):
            chain.known = [None] * len(places)
        if han and not places and not _ANY_MARK.search(text, start, end):
            for m in _HAN_RUN.finditer(text, start, end):
                for i in range(m.start() + 2, m.end() - 1):
                    features = _joint(text, i)
                    places.append((i, i))
                    chain.features.append(features)
                    chain.scores.append(sum(w[f] for f in features if f in w))
                    chain.filled.append(True)
                    chain.rooms.append(_room(i - behind))
                    chain.known.append(None)
        return start, end, places, chain

    def tags(self, chain: Chain) -> list[bool]:
        return viterbi(chain.scores, chain.filled, self.weights, chain.rooms)

    def units(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the sentence units of ``text``, in code points; a blank text has none."""
        found: list[tuple[int, int]] = []

        def add(a: int, b: int) -> None:
            while a < b and text[a].isspace():
                a += 1
            while a < b and text[b - 1].isspace():
                b -= 1
            if a < b:
                found.append((a, b))

        for start, end, places, chain in self.lines(text):
            if places:
                for (stop, begin), tag in zip(places, self.tags(chain)):
                    if tag:
                        add(start, stop)
                        start = begin
            add(start, end)
        return found


def units(text: str, model: dict[str, float] | None = None) -> list[tuple[int, int]]:
    return Tagger(model).units(text)


def train_gap_model(texts: list[str], rounds: int = 6) -> dict[str, float]:
    """Feature → log-odds that a gap between words is a unit's end, for scripts that mark none.

    The line breaks of the texts are stripped: the places where they stood are known ends, other gaps may be
    either. Expectation–maximization gives each of those a probability, starting from how its surroundings compare
    with those of the known ends.
    """
    ends: Counter = Counter()
    gaps: Counter = Counter()
    for text in texts:
        lines = [line.strip() for line in re.split(f"[{_BREAKS}]+", _STRIP.sub("", text))]
        lines = [line for line in lines if _UNMARKED.search(line)]
        for a, b in zip(lines, lines[1:] + lines[:1]):
            ends[tuple(_context(a, b))] += 1
        for line in lines:
            for m in re.finditer(r"\s+", line):
                gaps[tuple(_context(line[max(0, m.start() - 8) : m.start()], line[m.end() : m.end() + 8]))] += 1
    if not ends:
        return {}
    chance = dict.fromkeys(gaps, 0.5)
    known: Counter = Counter()
    for context, n in ends.items():
        for f in context:
            known[f] += n
    for context in gaps:
        chance[context] = 0.9 if all(known[f] > 0 for f in (context[1], context[4])) else 0.1
    weights: dict[str, float] = {}
    for _ in range(rounds):
        yes: Counter = Counter(known)
        no: Counter = Counter()
        total_yes, total_no = float(sum(ends.values())), 1.0
        for context, n in gaps.items():
            p = chance[context] * n
            total_yes += p
            total_no += n - p
            for f in context:
                yes[f] += p
                no[f] += n - p
        weights = {f: math.log((yes[f] + 0.05) / (total_yes + 1)) - math.log((no[f] + 0.05) / (total_no + 1)) for f in yes.keys() | no.keys()}
        spaced_yes = total_yes - sum(ends.values())
        weights["gap"] = math.log((spaced_yes + 1) / (total_no + 1))
        for context in gaps:
            s = weights["gap"] + sum(weights[f] for f in context)
            chance[context] = 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
    return weights


def _taught(chains: list[Chain], weights: dict[str, float], rounds: int = ROUNDS) -> dict[str, float]:
    """Weights after training on chains of which some tags are known: averaged structured perceptron (Collins, 2002).

    Where the best tagging differs from the best one that agrees with what is known, the weights of the features of
    both — at places and of steps — are moved towards the latter.
    """
    w = dict(weights)
    summed: dict[str, float] = {}
    now = 0

    def move(f: str, by: float) -> None:
        w[f] = w.get(f, 0.0) + by
        summed[f] = summed.get(f, 0.0) + by * now

    for _ in range(rounds):
        for c in chains:
            now += 1
            scores = [sum(w[f] for f in fs if f in w) for fs in c.features]
            forced = [s if k is None else s + (1e6 if k else -1e6) for s, k in zip(scores, c.known)]
            told, right = viterbi(scores, c.filled, w, c.rooms), viterbi(forced, c.filled, w, c.rooms)
            if told == right:
                continue
            for tags, by in ((right, STEP), (told, -STEP)):
                last = True
                for fs, full, room, tag in zip(c.features, c.filled, c.rooms, tags):
                    if tag:
                        for f in fs:
                            move(f, by)
                        move(("BB" if last else "IB") + room, by)
                        if last and not full:
                            move("BB empty", by)
                    last = tag
    return {f: x - summed.get(f, 0.0) / (now + 1) for f, x in w.items()}


def _wide_gaps(text: str) -> bool:
    return len(_WIDE.findall(text)) >= LEAST_WIDE_GAPS


_WIDE_GAP = "[.!?…؟।][\"'”’»)\\]]*[ \xa0]{2,}(?=[^\\s])"
_WIDE = re.compile(_WIDE_GAP)


def _stripped_runs(text: str, tagger: Tagger) -> list[Chain]:
    """Chains of the text's lines in Han or kana after their marks are stripped; the units of the marked lines are known."""
    chains = []
    for start, end, places, chain in tagger.lines(text):
        ends = {stop for (stop, _), tag in zip(places, tagger.tags(chain)) if tag} if places else set()
        bare, known = [], set()
        for i in range(start, end):
            if i in ends and bare:
                known.add(len(bare))
            if _HAN_RUN.match(text, i, i + 1):
                bare.append(text[i])
        line = "".join(bare)
        c = Chain()
        behind = 0
        for i in range(2, len(line) - 1):
            c.features.append(_joint(line, i))
            c.filled.append(True)
            c.rooms.append(_room(i - behind))
            c.known.append(i in known)
        if c.features:
            chains.append(c)
    return chains


def train(texts: list[str], run_chars: int = 150_000) -> dict[str, float]:
    """The model's weights, from whole texts.

    Texts with wide gaps behind marks show all their ends; gaps of unmarked scripts are learned from stripped line
    breaks; and so are joints between characters in lines of Han or kana without marks, from ``run_chars`` characters
    of lines whose marks are stripped. What the texts don't show keeps its initial weight.
    """
    weights = {**INITIAL, **train_gap_model([t for t in texts if _UNMARKED.search(t)])}
    tagger = Tagger(weights)
    shown = [c for t in texts if _wide_gaps(t) for *_, c in tagger.lines(t, labels=True) if any(c.known)]
    weights = _taught(shown, weights)
    tagger, runs, seen = Tagger(weights), [], 0
    for t in texts:
        n = sum(map(len, _HAN_RUN.findall(t)))
        if 2 * n > len(t) and seen < run_chars:
            seen += n
            runs += _stripped_runs(t, tagger)
    return _taught(runs, weights, 3) if runs else weights


def sentence_model_of(texts: DataFrame, text: str = "text", most: int = TRAINING_CHARS) -> dict[str, float]:
    """The model trained on a sample of ``texts``: of each kind — with wide gaps, of an unmarked script, in Han or kana — about
    ``most`` characters of whole texts, chosen by hash. The driver holds the sample and nothing else. An empty table,
    or one of which no text shows its ends, gives the initial weights.
    """
    c = F.col("_text")
    kind = F.when(F.regexp_count(c, F.lit(_WIDE_GAP)) >= LEAST_WIDE_GAPS, 0).when(c.rlike(f"[{_BARE}]{{4}}"), 1).when(c.rlike("[\u3040-\u30ff\u3400-\u9fff]{4}"), 2)
    return train(sample_of_bytes(texts.select(F.col(text).alias("_text")), "_text", kind, most))


def sentence_units(texts: DataFrame, model: dict[str, float] | None = None) -> DataFrame:
    """(place, row_id, char_start, char_end) of every unit of ``texts`` (place, row_id, text).

    Every character that isn't white space lies in exactly one unit; offsets count code points, ends are exclusive. Null,
    empty and blank texts have no units; a repeated row gives its units again. Other columns are left out. An empty table
    gives an empty result. Texts are taken whole, each where it is read: nothing is shuffled. ``model``: see train.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            parent: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                if text:
                    for a, b in tagger.units(text):
                        parent.append(i)
                        starts.append(a)
                        ends.append(b)
            at = pa.array(parent, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["place", "row_id", "char_start", "char_end"])

    return texts.select("place", F.col("row_id").cast("long").alias("row_id"), "text").where("text is not null").mapInArrow(run, "place string, row_id long, char_start int, char_end int")
