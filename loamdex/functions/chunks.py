"""Chunks of a page: sections cut to a token budget, small neighbours merged, overlaps carried on.

Each step is a fold over what came before, so it runs as plain Python inside one Arrow function; the token
estimate is the one of ``loamdex.functions.text``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from loamdex.config import ChunkSettings

#: White space as Unicode has it; Python's own strip() would also take the four separators U+001C to U+001F.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WORDS = re.compile(f"[^{re.escape(SPACE)}]+")
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")
_INDENTED = re.compile(r"^ {4}", re.M)


def strip(text: str) -> str:
    return text.strip(SPACE)


def tokens(text: str) -> int:
    return (40 * len(_WORDS.findall(text)) + 3 * len(_PUNCTUATION.findall(text))) // 30


def code_in(text: str) -> bool:
    return "```" in text or _INDENTED.search(text) is not None


def overlap_of(text: str, size: int) -> str:
    n, words = int(size * 0.75), _WORDS.findall(text)
    return " ".join(words[-n:]) if n and len(words) > n else ""


class _Packer:
    """Greedy packing: parts go on while the sum of their estimates stays within the limit."""

    def __init__(self, limit: int, glue: str):
        self.limit, self.glue = limit, glue
        self.parts: list[str] = []
        self.sum = 0
        self.done: list[str] = []

    def add(self, part: str, size: int) -> None:
        if self.sum + size > self.limit and strip(self.glue.join(self.parts)):
            self.flush()
        self.parts.append(part)
        self.sum += size

    def flush(self) -> None:
        text = strip(self.glue.join(self.parts))
        if text:
            self.done.append(text)
        self.parts, self.sum = [], 0


def split_words(text: str, s: ChunkSettings) -> list[str]:
    pack = _Packer(s.target_chunk_size, " ")
    for w in _WORDS.findall(text):
        pack.add(w, max(1, tokens(w)))
    pack.flush()
    return pack.done


def split_sentences(text: str, s: ChunkSettings) -> list[str]:
    """At . ! and ?; what ended a sentence is written as a full stop, and one sentence above the target stays whole."""
    found = [x for x in map(strip, re.split("[.!?]", text)) if x]
    pack = _Packer(s.target_chunk_size, "")
    for k, x in enumerate(found):
        x += ". " if k + 1 < len(found) else ""
        pack.add(x, tokens(x))
    pack.flush()
    return pack.done


def split_paragraphs(text: str, s: ChunkSettings) -> list[str]:
    """At blank lines, packed to the target; only a paragraph above the maximum is broken."""
    pack = _Packer(s.target_chunk_size, "\n\n")
    for paragraph in text.split("\n\n"):
        if not strip(paragraph):
            continue
        size = tokens(paragraph)
        if size <= s.max_chunk_size:
            pack.add(paragraph, size)
            continue
        for piece in (split_sentences if s.sentence_boundary_splitting else split_words)(paragraph, s):
            pack.add(piece, tokens(piece))
    pack.flush()
    return pack.done


def split_code(text: str, s: ChunkSettings) -> list[str]:
    """By lines up to the maximum, never inside a fence; the fence is looked at before the size."""
    pack, fenced = _Packer(s.max_chunk_size, "\n"), False
    for line in text.removesuffix("\n").split("\n"):
        line = line.removesuffix("\r")
        fenced ^= line.lstrip().startswith("```")
        size = tokens(line)
        if not fenced:
            pack.add(line, size)
        else:
            pack.parts.append(line)
            pack.sum += size
    pack.flush()
    return pack.done


def chunk_section(section: dict, s: ChunkSettings) -> list[dict]:
    content, flag = section.get("content") or "", bool(section.get("has_code_blocks"))
    if not strip(content):
        return []
    path = section.get("heading_path") or "Content"
    size = tokens(content)
    if size <= s.target_chunk_size:
        return [{"content": content, "heading_path": path, "token_count": size, "has_code_blocks": flag}]
    pieces = (split_code if flag and s.preserve_code_blocks else split_paragraphs)(content, s)
    return [{"content": p, "heading_path": path, "token_count": tokens(p), "has_code_blocks": flag and code_in(p)} for p in pieces if strip(p)]


def merged(chunks: Iterable[dict], s: ChunkSettings) -> list[dict]:
    """A chunk below the minimum takes in the next one, if that is as small, of the same path, and both fit."""
    out: list[dict] = []
    held: dict | None = None
    for c in chunks:
        small = c["token_count"] < s.min_chunk_size
        if held is not None:
            if small and c["heading_path"] == held["heading_path"] and held["token_count"] + c["token_count"] <= s.max_chunk_size:
                held = {**held, "content": f"{held['content']}\n\n{c['content']}", "token_count": held["token_count"] + c["token_count"], "has_code_blocks": held["has_code_blocks"] or c["has_code_blocks"]}
                continue
            out.append(held)
            held = None
        if small:
            held = c
        else:
            out.append(c)
    return [*out, held] if held is not None else out


def overlapped(chunks: list[dict], s: ChunkSettings) -> list[dict]:
    """Each chunk begins with the end of the one before it under the same path, which has its own overlap by then."""
    out: list[dict] = []
    for c in chunks:
        if out and s.overlap_size > 0 and out[-1]["heading_path"] == c["heading_path"] and (head := overlap_of(out[-1]["content"], s.overlap_size)):
            c = {**c, "content": f"{head}\n\n{c['content']}", "token_count": c["token_count"] + tokens(head)}
        out.append(c)
    return out


def chunk_page(title: str | None, sections: list[dict] | None, raw_text: str | None, s: ChunkSettings | None = None) -> list[dict]:
    """Chunks of a page in order, numbered from 0; its whole text where the sections give none."""
    s = s or ChunkSettings()
    found = [c for section in sections or [] for c in chunk_section(section, s)]
    if not found and raw_text and strip(raw_text):
        found = chunk_section({"content": raw_text, "heading_path": title or "Content", "has_code_blocks": code_in(raw_text)}, s)
    return [{**c, "chunk_index": k} for k, c in enumerate(overlapped(merged(found, s), s))]
