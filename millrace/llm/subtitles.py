"""Subtitle files as dialogue: cues, without markup, sound descriptions and adverts."""

from __future__ import annotations

import html
import re
import unicodedata

_MARKUP = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}")
_SOUND = re.compile(
    r"\[[^\[\]]*\]|\([^()]*\)|（[^（）]*）|【[^【】]*】|\*[^*\n]+\*|[♪♫🎵🎶#][^♪♫🎵🎶#\n]*[♪♫🎵🎶#]|^[^\w\n]*[♪♫🎵🎶][^\n]*|^[?�] [^\n]*", re.M
)
_MARKS = re.compile(r"[\[(（【*♪♫🎵🎶#]")
_SPEAKER = re.compile(r"^[^\w\n]*[\w .'’-]{1,24}:(?=\s)", re.M)
# What adverts in subtitle files look like (addresses, and the phrases of their usual kinds).
_ADVERT = re.compile(
    r"www\.|https?:|\w@\w|(?:\.|\[ ?dot ?\]|\( ?dot ?\)) ?(?:example|com|net|org|tv|info|io)\b"
    r"|\b(?:subtitles|subtitled|captions|captioned|synced|ripped|encoded|translated|corrected|brought to you|provided|uploaded) by\b"
    r"|\bvip member\b|\badvertise your\b|\bdownloaded from\b|\bwant more\? visit\b|\brate this (?:file|subtitle)|-= .* =-",
    re.I,
)
#: One of these stands in every advert; plain searches that spare most texts the pattern.
_ADVERT_PARTS = (
    "www. http @ example .com .net .org .tv .info .io dot subtitle caption synced ripped encoded translated corrected provided uploaded advertise downloaded -="
).split() + ["brought to you", "vip member", "want more", "rate this"]
#: Characters that bytes of UTF-8 turn into when they are read as a one-byte encoding.
_BYTE_OF = {bytes([b]).decode("cp1252", "ignore") or chr(b): b for b in range(0x80, 0x100)} | {chr(b): b for b in range(0x80, 0x100)}
_MISREAD = re.compile("[Â-ô][" + re.escape("".join(c for c, b in _BYTE_OF.items() if b < 0xC0)) + "]{1,3}")


def _reread(match: re.Match[str]) -> str:
    try:
        return bytes(_BYTE_OF[c] for c in match[0]).decode("utf-8")
    except UnicodeDecodeError:
        return match[0]


def repaired(text: str) -> str:
    """UTF-8 that was read as a one-byte encoding, once or twice, put right; entities resolved."""
    for _ in range(2):
        if text.isascii() or not _MISREAD.search(text):
            break
        again = _MISREAD.sub(_reread, text)
        if again == text:
            break
        text = again
    return html.unescape(text) if "&" in text else text


def normal(text: str) -> str:
    """One kind of line end, no byte order marks or soft hyphens, composed letters, misread bytes repaired."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return html.unescape(text) if "&" in text else text
    text = repaired(text).replace("\x85", "\n").replace(" ", "\n")
    for mark in ("﻿", "­", "​", "‎", "‏"):
        if mark in text:
            text = text.replace(mark, "")
    return unicodedata.normalize("NFC", text)


def cues(text: str) -> list[str]:
    """The texts of the cues in file order, without markup. Text before the first timing line belongs to none."""
    parts = text.split("-->")
    if len(parts) < 2:
        return []
    out, last = [], len(parts) - 1
    for k in range(1, last + 1):
        part = parts[k]
        at = part.find("\n")
        if at < 0:
            out.append("")
            continue
        if k < last:  # the line of the next cue's start ends the part, its number stands before that
            body = part[at + 1 : part.rfind("\n") + 1].rstrip()
            end = body.rfind("\n")
            tail = body[end + 1 :].strip()
            body = body[: max(end, 0)] if tail.isdigit() else body
        else:
            body = part[at + 1 :]
        if "<" in body or "{" in body:
            body = _MARKUP.sub("", body)
        out.append(body.strip())
    return out


def spoken(text: str) -> list[str]:
    """What is spoken in each cue, line by line; '' for adverts and for cues of sounds only."""
    text = normal(text)
    parts = cues(text)
    low = text.lower()
    if any(p in low for p in _ADVERT_PARTS):
        parts = ["" if _ADVERT.search(p) else p for p in parts]
    if "\n? " in text or "\n� " in text:
        parts = [_SOUND.sub(" ", p) for p in parts]
    elif _MARKS.search(text):
        parts = [_SOUND.sub(" ", p) if _MARKS.search(p) else p for p in parts]
    return [_SPEAKER.sub("", p) if ":" in p else p for p in parts]
