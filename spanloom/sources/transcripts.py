"""Transcripts of conversations in the CHAT format: headers, utterances and their dependent tiers.

`@` lines are headers: of the document, of one speaker, or counted (episodes). They hold until they change, so an utterance carries the
headers in force and all that is known of its speaker. `*SPK:` lines are utterances (spans `u`), whose codes are taken out by one scan; `%mor`
lines give parts of speech and lemmas of the words that are not taken back. Lines that begin with a blank go on with the line before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

# Fixed values of the format: headers of the document, those counted, and those with a speaker's code at the end.
SIMPLE = (
    "pid", "transcriber", "coder", "date", "location", "situation", "number", "interaction type", "activities", "comment", "bck", "warning",
    "transcription", "time start", "time duration", "tape location", "room layout", "recording quality", "media", "g", "page",
)
COUNTED = ("new episode",)
OF_SPEAKER = ("birth of", "birthplace of", "l1 of", "age of")
IGNORED = ("font", "options", "exceptions", "colorwords")
#: The fields of an `@ID` line.
ID_FIELDS = ("language", "corpus", "code", "age", "sex", "group", "SES", "role", "education", "custom")
#: Marks of prosody and the like, which are no part of words.
MARKS = "↓↑⇗↗→↘⇘∞≈≋≡∙⌈⌉⌊⌋∆∇⁎⁇°◉▁▔☺∬Ϋ∮§∾↻Ἡ„‡̣ʰ̄ʔ"
MONTHS = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}

_SCAN = re.compile(r"\[[^\]]*\]|<|>|[^\s\[\]<>]+")
_PAUSE = re.compile(r"\((?:\.+|\d*\.\d*)\)")


def lines_of(text: str) -> Iterator[str]:
    """Whole lines, those that go on put together."""
    whole: str | None = None
    for line in re.split(r"\r\n|\n|\r", text.lstrip("﻿")):
        if line[:1] in ("\t", " ") and whole is not None:
            whole += " " + line.strip()
        elif line.strip():
            if whole is not None:
                yield whole
            whole = line.rstrip()
    if whole is not None:
        yield whole


def months(age: str) -> int | None:
    """The months of an age like 3;6.14: years, months and days, of which the days don't count."""
    m = re.fullmatch(r"(\d+)(?:[;.:,/-](?:(\d{1,2})(?:[;.:,/-](?:\d+)?)?)?)?", age.strip())
    return None if m is None else int(m.group(1)) * 12 + int(m.group(2) or 0)


def iso_date(text: str) -> str:
    """A date like 14-JUN-1998 as 1998-06-14; anything else as it is."""
    m = re.fullmatch(r"(\d{1,2})-([A-Za-z]{3})-(\d{4})", text.strip())
    month = m and MONTHS.get(m.group(2).lower())
    return f"{m.group(3)}-{month:02}-{int(m.group(1)):02}" if m and month else text.strip()


@dataclass
class Headers:
    """What the headers have said so far."""

    document: dict[str, str] = field(default_factory=dict)
    speakers: dict[str, dict[str, str]] = field(default_factory=dict)
    every: dict[str, list[str]] = field(default_factory=dict)

    def read(self, line: str) -> None:
        name, colon, value = line[1:].partition(":")
        name, value = name.strip(), value.strip()
        low = name.lower()
        if low in COUNTED:
            self.document[_field(low)] = str(int(self.document.get(_field(low), 0)) + 1)
        if not colon:
            return
        if value:
            self.every.setdefault(_field(low), []).append(value)
        if low == "participants":
            for person in value.split(","):
                parts = person.split()
                if len(parts) in (2, 3):
                    self._of(parts[0], {"role": parts[-1]} | ({"name": parts[1]} if len(parts) == 3 else {}))
        elif low == "id":
            known = dict(zip(ID_FIELDS, (x.strip() for x in value.split("|"))))
            code = known.pop("code", "")
            if code:
                self._of(code, known | _with_months(known.get("age", "")))
        elif low[:-3].strip() in OF_SPEAKER:
            base, code = low[:-3].strip(), name[-3:]
            self._of(code, {"age": value} | _with_months(value) if base == "age of" else {_field(base): iso_date(value) if base == "birth of" else value})
        elif low in SIMPLE:
            self.document[_field(low)] = iso_date(value) if low == "date" else value

    def _of(self, code: str, more: dict[str, str]) -> None:
        self.speakers.setdefault(code, {}).update({k: v for k, v in more.items() if v})

    def in_force(self, code: str) -> dict[str, str]:
        return self.document | self.speakers.get(code, {})


def _field(name: str) -> str:
    return re.sub(r" +", "_", name.strip())


def _with_months(age: str) -> dict[str, str]:
    n = months(age) if age else None
    return {"months": str(n)} if n else {}


def words_of(said: str) -> list[tuple[str, bool]]:
    """The words of an utterance, and whether each still stands: false for those that the speaker took back.

    Codes in brackets go; `[: text]` is read instead of the word before it, and words before `[/]`, `[//]` and `[///]` stay but
    don't stand. Pauses, events, fragments, linkers and what isn't transcribed go; marks within words and brackets of left out letters
    too, while the letters stay. Punctuation with blanks around is a word.
    """
    said = re.sub("\x15[^\x15]*\x15", " ", said)
    said = re.sub(r"\+<", " ", said)
    out: list[tuple[str, bool]] = []
    opened: list[int] = []
    last = 0  # where the word or group before begins
    for m in _SCAN.finditer(said):
        part = m.group()
        if part == "<":
            opened.append(len(out))
        elif part == ">":
            last = opened.pop() if opened else len(out)
        elif part[0] == "[":
            code = part[1:-1].strip()
            if code.startswith(":"):
                out[max(last, len(out) - 1) :] = [(w, True) for x in code.lstrip(":").split() for w in _cleaned(x)]
            elif code in ("/", "//", "///", "/-", "/?"):
                out[last:] = [(w, False) for w, _ in out[last:]]
        else:
            last = len(out)
            out += [(w, w not in ("xxx", "yyy")) for w in _cleaned(part)]
    return out


def _cleaned(word: str) -> list[str]:
    """The words within one part of an utterance between blanks."""
    if _PAUSE.fullmatch(word) or word[0] in "&+" or word in ("www", "0", "#"):
        return []
    word = _PAUSE.sub("", word)
    word = re.sub(r"@[\w:$&*]+", "", word).replace("(", "").replace(")", "").replace("_", "").replace("^", "")
    word = word[1:] if word[0:1] == "0" and word[1:2].isalpha() else word
    return [w for w in re.split("[~" + MARKS + "]", word) if w]


def mor_items(line: str) -> list[tuple[str, str | None]]:
    """Part of speech and lemma of each item of a `%mor` line; punctuation has itself and no lemma. Clitics are items of their own."""
    out = []
    for item in re.split(r"[\s~$]+", line.strip()):
        if not item:
            continue
        pos, bar, stem = item.partition("|")
        out.append((pos.rpartition("#")[2], re.split(r"[-&=]", stem)[0].replace("+", "")) if bar else (item, None))
    return out
