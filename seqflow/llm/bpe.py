"""Byte-pair merging for vocabularies of public tokenizers.

A pre-token's symbols form a doubly linked list; a heap holds the ranks of
neighbouring pairs. The lowest rank merges first (leftmost among equals), and
entries whose pair no longer stands are skipped when they come up. A pre-token
of n symbols takes O(n log n), so one without any space is no trouble.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from dataclasses import dataclass, field

import regex

#: Patterns that split a text into pre-tokens, by the form in which a vocabulary file asks for them (fixed values).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode white space: what ``\s`` means in those patterns (fixed values).
WHITE_SPACE = "\t\n\v\f\r \x85\xa0  -     　"
#: Letters and numbers of Unicode editions after the one of the tokenizers' splitter, which counts them as symbols (fixed values).
NEWER = """558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3
16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6
1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4
1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"""
#: Capitals that Python's tables don't know yet: first, last, distance to the small letter (fixed values).
NEWER_CAPITALS = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1),
                  (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
                  (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]
_SMALL = {c: c + by for first, last, by in NEWER_CAPITALS for c in range(first, last + 1)}
_SEPARATORS = re.compile("[\x1c-\x1f]").search  # white space to Python, but not to the patterns
_PRIVATE = ""  # a symbol to every pattern


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the other bytes get the characters from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


def lower_each(text: str) -> str:
    """Every character lower-cased by itself (a final capital sigma is not special)."""
    if text.isascii():
        return text.lower()
    return "σ".join(part.lower() for part in text.split("Σ")).translate(_SMALL)


@dataclass
class Vocabulary:
    """Merge ranks, token strings and splitting rules of one tokenizer file."""

    tokens: dict[str, int]
    merges: list[tuple[str, str]]
    pattern: str
    suffix: str = ""
    normal: list[dict] = field(default_factory=list)
    special: dict[str, int] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError(f"not a merge vocabulary: {model['type']}")
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"]])
        split = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        rules = spec["normalizer"] or {}
        return cls(model["vocab"], [tuple(m) for m in model["merges"]], split[0] if split else BYTE_LEVEL_PATTERN,
                   model["end_of_word_suffix"] or "", rules.get("normalizers", [rules] if rules else []),
                   {t["content"]: t["id"] for t in spec["added_tokens"]})


class Merger:
    """Encodes pre-tokens with one vocabulary; built once per worker."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        ids = vocab.tokens
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(vocab.merges)}
        self.made = [ids[a + b] for a, b in vocab.merges]
        symbols = byte_symbols()
        self.inner = [ids.get(s) for s in symbols]
        self.final = [ids.get(s + vocab.suffix) for s in symbols]
        pattern = vocab.pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\s", f"[{WHITE_SPACE}]").replace(
            r"\S", f"[^{WHITE_SPACE}]")
        self.split = regex.compile(pattern)
        self.find = self.split.findall
        self.newer = regex.compile("[" + "".join(
            "-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER.split()) + "]")
        self.space = regex.compile(f"[{WHITE_SPACE}]+")
        self.doubled = regex.compile(f"[{WHITE_SPACE}] | [{WHITE_SPACE}]").search
        #: White space is in no pre-token: a text may be cut there, and replacing it by a space changes nothing.
        self.blind = not any(self.find(c) for c in "\t\n \xa0")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, vocab.special)) + ")") if vocab.special else None

    def normalise(self, text: str) -> str:
        for step in self.vocab.normal:
            if step["type"] == "NFC":
                text = text if text.isascii() else unicodedata.normalize("NFC", text)
            elif step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"} and step["content"] == " ":
                text = text if self.blind else self.space.sub(" ", text)
            elif step["type"] == "Lowercase":
                text = lower_each(text)
            else:
                raise ValueError(f"unknown normalisation {step}")
        return text

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """Parts of the text and whether each is a special token."""
        if self.cut is None:
            return [(text, False)]
        return [(p, bool(k % 2)) for k, p in enumerate(self.cut.split(text)) if p]

    def pre_tokens(self, piece: str) -> list[str]:
        text = self.normalise(piece)
        if text.isascii() or not self.newer.search(text):
            return self.find(text)
        return [text[m.start():m.end()] for m in self.split.finditer(self.newer.sub(_PRIVATE, text))]

    def chunks(self, piece: str) -> list[str]:
        """Parts of the piece that can be split into pre-tokens one by one; most are a word with its space.

        Cuts lie at white space that no pre-token holds, or ahead of a single space between other characters.
        """
        if self.blind:
            return piece.split() if not _SEPARATORS(piece) else [piece]
        if self.vocab.normal or self.doubled(piece):
            return [piece]
        first, *rest = piece.split(" ")
        return ([first] if first else []) + [" " + r for r in rest]

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode()
        start = [self.inner[b] for b in raw[:-1]] + [self.final[b] for b in raw[-1:]]
        return self.merge([s for s in start if s is not None])

    def merge(self, symbols: list[int]) -> list[int]:
        n, rank, made = len(symbols), self.rank, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] < 0 or rank.get((symbols[i], symbols[j])) != r:
                continue  # stale
            symbols[i], symbols[j] = made[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (s := rank.get((symbols[i], symbols[after[j]]))) is not None:
                    heapq.heappush(heap, (s, i))
            if before[i] >= 0 and (s := rank.get((symbols[before[i]], symbols[i]))) is not None:
                heapq.heappush(heap, (s, before[i]))
        return [s for s in symbols if s >= 0]

    def whole_tokens(self) -> set[str]:
        """Token strings that, as a pre-token of their own, are proved to encode as that one token."""
        back = {s: b for b, s in enumerate(byte_symbols())}
        found = set()
        for token, number in self.vocab.tokens.items():
            body = token.removesuffix(self.vocab.suffix) if self.vocab.suffix else token
            if any(c not in back for c in body):
                continue
            try:
                word = bytes(back[c] for c in body).decode()
            except UnicodeDecodeError:
                continue
            if word and self.encode_word(word) == [number]:
                found.add(word)
        return found
