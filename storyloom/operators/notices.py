"""Notices that a text was stolen from a site, or from elsewhere, found by how they are worded and by cues.

All lists are fixed values. In a phrase a space is any white space and '…' anything within the sentence; in cues '*' lets a word go on.
"""

from __future__ import annotations

import re
from functools import cache

#: The sites whose notices are removed unless others are given; SITE stands for any of them.
SITES = ("royal road",)
PHRASES = (
    "stolen content warning…SITE…", "taken from SITE…", "this narrative has been unlawfully taken from SITE…", "if you see it on amazon…please report it",
    "this tale has been pilfered from SITE…", "if you stumble upon this narrative on amazon…", "if you discover this tale on amazon…", "this content has been unlawfully taken from SITE…",
    "unlawfully taken from SITE…", "unauthorized duplication…", "this novel'?s true home is a different platform…", "read this novel on SITE",
    "support the creativity of authors by visiting SITE…", "this tale has been unlawfully lifted…", "the author'?s narrative has been misappropriated…", "report any appearances on amazon", "report any occurrences",
)
CUES = {
    "theft": "stolen, steal*, pilfer*, unlawful*, unauthorised, unauthorized, misappropriat*, lifted, pirat*, report*",
    "claim": "genuine, original, authentic, support*, true home, visit*, head to, head over to",
    "work": "story, stories, tale, narrative, novel, content, book, fiction, chapter",
    "reading": "support*, genuine, read*",
    "store": "amazon",
    "elsewhere": ", ".join(f"{which} {what}" for which in ("official", "original", "another", "different", "other") for what in ("site", "website", "source", "platform")) + ", published elsewhere",
}
#: What a sentence names, and the cues of which one group must be there too; the first named thing decides.
TOGETHER = (("site", ({"theft"}, {"claim"})), ("elsewhere", ({"reading"}, {"theft"}, {"work"})), ("store", ({"theft", "work"},)))
#: Sentences that are notices by themselves.
ALONE = (
    r"(?:please )?report (?:the violation|any sightings|sightings)\.?", r"(?:ensure|support)\b.*\bauthors?\b.*\b(?:there|original|deserve)\b.*[.!?]?",
    r"you could be reading stolen content[.!?]?", r"reading on this site\?[.!?]?",
)
#: Words of which each notice holds one, beside a site's name.
HINTS = ("amazon", "report", "duplication", "platform", "lifted", "misappropriated", "author", "stolen", "reading", "elsewhere", "site", "source")
MOST_WORDS = 30

_SENTENCE_GAP = re.compile(r"(?<=[.!?…])\s+")


def _pattern(words: str) -> str:
    return words.replace(" ", r"\s+").replace("…", "[^.]*").replace("*,", r"\w*,")


class Notices:
    """What to remove for one choice of sites."""

    def __init__(self, sites: tuple[str, ...]):
        site = "(?:" + "|".join(_pattern(re.escape(s).replace("\\ ", " ")) for s in sites) + ")"
        self.phrases = [re.compile(_pattern(p).replace("SITE", site) + r"\.", re.I) for p in PHRASES if sites or "SITE" not in p]
        alternatives = lambda listed: "|".join(c.replace(" ", r"\s+").replace("*", r"\w*") for c in listed.split(", "))
        self.cues = {name: re.compile(rf"\b(?:{alternatives(listed)})\b", re.I) for name, listed in CUES.items()}
        if sites:
            self.cues["site"] = re.compile(r"\b(?:" + "|".join(r"\s*".join(map(re.escape, s.split())) for s in sites) + r")\b", re.I)
        self.alone = re.compile("|".join(a.replace(" ", r"\s+") for a in ALONE), re.I)
        self.hints = (*HINTS, *(_folded(s.split()[0]) for s in sites))

    def hinted(self, text: str) -> bool:
        text = _folded(text)
        return any(h in text for h in self.hints)

    def is_notice(self, sentence: str) -> bool:
        if len(sentence.split()) > MOST_WORDS:
            return False
        if self.alone.fullmatch(sentence.strip()):
            return True
        holds = lambda cue: cue in self.cues and self.cues[cue].search(sentence)
        groups = next((groups for named, groups in TOGETHER if holds(named)), ())
        return any(all(map(holds, group)) for group in groups)

    def without(self, text: str) -> str:
        """``text`` without what is worded like a notice, then without sentences that are one; other lines stay as they are."""
        if self.hinted(text):
            for phrase in self.phrases:
                text = phrase.sub("", text)
            lines = text.split("\n")
            for i, line in enumerate(lines):
                if self.hinted(line):
                    sentences = _SENTENCE_GAP.split(line)
                    kept = [s for s in sentences if not self.is_notice(s)]
                    lines[i] = line if len(kept) == len(sentences) else " ".join(kept)
            text = "\n".join(lines)
        return text


def _folded(text: str) -> str:
    """In lower case, with the letters that regular expressions also take for i, k and s whatever their case."""
    return text.replace("İ", "i").replace("ı", "i").replace("ſ", "s").lower()


@cache
def notices_of(sites: tuple[str, ...] = SITES) -> Notices:
    return Notices(tuple(sites))
