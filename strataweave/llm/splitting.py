"""Splitting oversized items at natural boundaries, by recursive bisection.

A text is first divided into atoms: a word with the white space after it, or fragments of at most `FRAGMENT`
characters where a run is longer.  A range of atoms that does not fit with its overlap is cut at the strongest boundary
near its middle (heading, blank line, line end, sentence, clause, word, inside a word), and both halves recurse.
Each piece but the first then gets the last `overlap` words before it in front.

The pieces without their overlaps, put together, are the text itself.  Where 64 words of overlap would not fit beside
even one atom, the overlap is as many words as do.

Defined cases: null text gives one piece with null text; empty text one empty piece; repeated rows of a key count once
(latest updated_at, then greatest text); a word longer than the limit is cut inside; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.text import WHITE_SPACE

MAX_WORDS, MAX_CHARS, OVERLAP = 512, 4000, 64
FRAGMENT = 1000
KEY = ["page_id", "revision", "chunk_index"]

_ATOM = re.compile(f"[^{WHITE_SPACE}]+[{WHITE_SPACE}]*|[{WHITE_SPACE}]+")
_WORD = re.compile(f"[^{WHITE_SPACE}]+")
_BLANK_LINE = re.compile(r"(\r\n|\r|\n)[^\S\r\n]*(\r\n|\r|\n)")
_SENTENCE = re.compile("[.!?…。！？][\"'”’)\\]]*$")


def atoms_of(text: str) -> tuple[list[int], list[int], list[int]]:
    """Starts of the atoms (and the end), words begun before each atom, and the strength of the boundary before each."""
    starts, words, strength, n = [], [], [], 0
    last = 6
    for m in _ATOM.finditer(text):
        a, b = m.span()
        run = m.group()
        is_word = _WORD.match(run) is not None
        if last == 5 and run.startswith("#"):
            last = 6
        for k, s in enumerate(range(a, b, FRAGMENT)):
            starts.append(s)
            words.append(n)
            strength.append(last if k == 0 else 0)
            n += is_word and k == 0
        core = run.rstrip()
        gap = run[len(core):]
        last = 5 if _BLANK_LINE.search(gap) else 4 if "\n" in gap or "\r" in gap else 3 if _SENTENCE.search(core) else 2 if core[-1:] in ",;:" and gap else 1
        if last == 4 and text[b : b + 1] == "#":
            last = 5
    return [*starts, len(text)], [*words, n], strength


def split(text: str, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start with overlap, start, end) of each piece, in order."""
    if len(text) <= max_chars and (len(text) < 2 * max_words or len(_WORD.findall(text)) <= max_words):
        return [(0, 0, len(text))]
    at, words, strength = atoms_of(text)

    def lead(a: int) -> int:
        """The atom at which the overlap of a piece from atom a begins."""
        k = a
        while k > 0 and words[a] - words[k] < overlap:
            k -= 1
        return k

    def fits(a: int, b: int) -> bool:
        k = lead(a)
        return words[b] - words[k] <= max_words and at[b] - at[k] <= max_chars

    out, todo = [], [(0, len(at) - 1)]
    while todo:
        a, b = todo.pop()
        if fits(a, b) or b - a == 1:
            k = lead(a)
            while k < a and not (words[b] - words[k] <= max_words and at[b] - at[k] <= max_chars):
                k += 1
            out.append((at[k], at[a], at[b]))
            continue
        middle, reach = (at[a] + at[b]) / 2, (at[b] - at[a]) / 4
        near = [c for c in range(a + 1, b) if abs(at[c] - middle) <= reach] or range(a + 1, b)
        c = max(near, key=lambda c: (strength[c], -abs(at[c] - middle)))
        todo += [(c, b), (a, c)]
    return out


def split_items(rows: DataFrame, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(page_id, revision, chunk_index, section_path, piece_index, n_pieces, overlap_chars, text) of every piece."""
    version = F.max(F.struct("updated_at", "text", "section_path")).alias("m")
    once = rows.groupBy(*KEY).agg(version).select(*KEY, "m.section_path", "m.text")

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for *key, text in f.itertuples(index=False):
                if text is None:
                    out.append((*key, 0, 1, 0, None))
                    continue
                spans = split(text, max_words, max_chars, overlap)
                out += [(*key, i, len(spans), s - o, text[o:e]) for i, (o, s, e) in enumerate(spans)]
            yield pd.DataFrame(out, columns=[*f.columns[:-1], "piece_index", "n_pieces", "overlap_chars", "text"], dtype=object)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in KEY)
    return once.mapInPandas(pieces, f"{kinds}, section_path string, piece_index int, n_pieces int, overlap_chars int, text string")
