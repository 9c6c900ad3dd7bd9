"""Pre-tokens of the byte-level BPE vocabulary, and the pieces of one pre-token.

A text is first cut at the vocabulary's special strings (the library's default), then by the published
pre-token pattern. Both cuts are made for a whole block of texts at once, over an array of code points:
the pattern only depends on the classes letter, number, white space and other of neighbouring characters.
Pre-tokens get 64-bit keys, so that equal ones can be counted without making strings.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Characters of text that are cut together; bounds a worker's memory (about 40 bytes a character).
BLOCK_CHARS = 2_000_000
SPACE, LETTER, NUMBER, OTHER, EDGE = range(5)
FACTOR = 0x9E3779B97F4A7C15 | 1


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point; surrogates never occur in a text."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = "".join(regex.findall(name, every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    split = Tokenizer.from_file(VOCABULARY).pre_tokenizer.pre_tokenize_str
    for c in np.flatnonzero(out != OTHER):  # the modules follow different editions of Unicode: the library decides
        if unicodedata.category(char := chr(c)) == "Cn":
            out[c] = LETTER if len(split("x" + char)) == 1 else NUMBER if len(split("1" + char)) == 1 else OTHER
    return out


_up = _down = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of FACTOR and of its inverse modulo 2 ** 64; the longest ones asked for are kept."""
    global _up, _down
    if n > len(_up):
        with np.errstate(over="ignore"):
            up, down = np.full(n, FACTOR, np.uint64), np.full(n, pow(FACTOR, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _up, _down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _up[:n], _down[:n]


@functools.cache
def specials(path: str = VOCABULARY) -> dict[str, int]:
    return {x["content"]: x["id"] for x in json.load(open(path, encoding="utf-8"))["added_tokens"]}


@functools.cache
def core(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The file's merges as ranks: in this vocabulary a piece's id is its merge rank."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = specials(path)
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def piece_ids(token: str, path: str = VOCABULARY) -> list[int]:
    """Ids of one pre-token."""
    special = specials(path).get(token)
    return [special] if special is not None else core(path)._core_bpe.encode_single_piece(token.encode("utf-8"))


@dataclass
class Cut:
    """Pre-tokens of a block of texts, in order. ``text``: the texts, each followed by one edge character."""

    text: str
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    key: np.ndarray

    def string(self, i: int) -> str:
        return self.text[self.start[i]:self.end[i]]


def cut(texts: list[str], path: str = VOCABULARY) -> Cut:
    """Pre-tokens of ``texts``; empty texts have none. Texts may hold any character, the edge character too."""
    rows = np.arange(len(texts))
    names = [s for s in specials(path) if any(s in t for t in texts)]
    if names:  # a special string, and the text before and after it, are cut as if they stood alone
        parts = [re.split("(" + "|".join(map(re.escape, names)) + ")", t) for t in texts]
        rows = np.repeat(rows, [len(p) for p in parts])
        texts = [x for p in parts for x in p]
    text = "\0".join([*texts, ""])
    point = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = classes()[point]
    edges = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    kind[edges] = EDGE
    first = np.empty(len(kind), bool)
    first[:1] = True
    first[1:] = kind[1:] != kind[:-1]
    gap = kind == SPACE
    nearby = gap[:-1] & (kind[1:] != SPACE) & (kind[1:] != EDGE)
    first[:-1] |= nearby
    first[1:][nearby & (point[:-1] == 32)] = False
    first[edges + 1 if len(edges) and edges[-1] + 1 < len(kind) else edges[:-1] + 1] = True
    at = np.flatnonzero((point == 39) & first)
    at = at[(at + 1 < len(kind))]
    at = at[(kind[at + 1] == LETTER) & first[at + 1]]
    if len(at):
        padded = np.concatenate([point, np.zeros(3, np.uint32)])
        one, two = padded[at + 1], padded[at + 2]
        short = np.isin(one, [115, 116, 109, 100])  # s t m d
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)  # re ve ll
        for found, size in ((at[short], 2), (at[long], 3)):
            first[found + 1] = False
            after = found + size
            after = after[after < len(kind)]
            first[after[kind[after] == LETTER]] = True
    if names:
        whole = np.flatnonzero([t in names for t in texts])
        for a, b in zip(np.concatenate([[0], edges[:-1] + 1])[whole], edges[whole]):
            first[a], first[a + 1:b] = True, False
    start = np.flatnonzero(first & (kind != EDGE))
    stops = np.flatnonzero(first | (kind == EDGE))
    end = stops[np.searchsorted(stops, start, "right")] if len(start) else start
    with np.errstate(over="ignore"):
        up, down = powers(1 << max(1, len(point)).bit_length())
        total = np.zeros(len(point) + 1, np.uint64)
        np.cumsum((point.astype(np.uint64) + np.uint64(0x632BE5AB)) * up[:len(point)], out=total[1:])
        key = (total[end] - total[start]) * down[start]
        key ^= key >> np.uint64(29)
        key = key * np.uint64(0xBF58476D1CE4E5B9) + (end - start).astype(np.uint64)
    return Cut(text, start, end, rows[np.searchsorted(edges, start)], key)


def blocks(rows, size: int = BLOCK_CHARS):
    """(texts, other values) of at most ``size`` characters, but at least one row; rows: (text, other) pairs."""
    texts, rest, total = [], [], 0
    for text, other in rows:
        if texts and total + len(text) > size:
            yield texts, rest
            texts, rest, total = [], [], 0
        texts.append(text)
        rest.append(other)
        total += len(text)
    if texts:
        yield texts, rest
