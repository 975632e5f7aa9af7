"""Exact ids, and counts at every prefix, of the word-level BPE vocabulary, through caches of white-space chunks.

The vocabulary's pre-tokens never cross white space, so the ids of a text are those of its chunks, joined. A chunk of
letters and closing marks is split here and merged by a byte-pair core; every other chunk (digits, quotes,
special strings, rare scripts) goes to the tokenizer library itself, so the ids are the library's by construction.

Counts come from a dynamic programme over prefixes: the merged form of a prefix ends with the one token that stays whole
beside the last token of what precedes it, so each entry follows from earlier entries, in time linear in the text. The
programme follows normalisation and pre-tokens as the text grows; a chunk outside plain letters and marks is checked once
against the library (its whole count), and only where that differs every prefix of the chunk is asked for.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from itertools import pairwise

import numpy as np

#: Letters whose lower case and composed form are one code point each, in every Unicode version; then one run of ASCII
#: marks, without those that begin contractions or special strings.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")
#: ASCII white space, which the vocabulary's own splitting drops; other white space stays inside its chunk.
BLANK = re.compile(r"([\x09-\x0d\x20]+)")
#: White space beyond that, and what a contraction's apostrophe takes (with the letter after, if one must follow).
WHITE = frozenset("\x09\x0a\x0b\x0c\x0d\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
CONTRACTED = {"s": "", "t": "", "m": "", "d": "", "r": "e", "v": "e", "l": "l"}
HEAD, START = 24, 4  # bytes of a word's beginning whose entries are kept; those that are taken at once
CACHE_ENTRIES, CACHED_LENGTH = 200_000, 200  # of a generation (two are held, about 100 MB); longer chunks are not kept
DELTA_ENTRIES = 400_000  # of a generation of chunks' steps (two are held, about 220 MB): a third fewer chunks come again than with half
MARK = b"\xff"  # never a byte of UTF-8; stands for the end of a pre-token


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, by rule: printable Latin-1 stays, the rest moves above 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class WordBpe:
    """One per worker and vocabulary file: ``ids`` and ``prefix_counts`` of whole texts."""

    _made: dict[str, WordBpe] = {}

    @classmethod
    def at(cls, path: str) -> WordBpe:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are kept as little-endian 32-bit integers")
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, symbols = spec["model"]["end_of_word_suffix"], byte_symbols()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks: dict[bytes, int] = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                ends = token.endswith(suffix)
                raw = bytes(symbols[c] for c in (token[: -len(suffix)] if ends else token))
                ranks[raw + MARK if ends else raw] = i
        lone = ranks.pop(MARK, None)  # the symbol of byte 255 cannot occur in UTF-8
        ranks[MARK] = lone if lone is not None else len(ranks) + 10_000
        self.by_bytes = ranks
        self.ending = {b[:-1]: i for b, i in ranks.items() if b.endswith(MARK) and b != MARK}
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._back = self._backwards()
        self.core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._ids: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}
        self._closing: dict[str, list[int]] = {}
        self._deltas: dict[str, tuple[bytes, int]] = {}
        self._older_deltas: dict[str, tuple[bytes, int]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._wholes: dict[int, bool] = {}
        self._words: dict[str, list[int]] = {}
        self._heads: dict[int, tuple[int, int, int, int]] = {}
        self._starts: dict[bytes, tuple[list[int], list[int], list[int], int]] = {}
        self._made_heads = 0
        self._special = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True)) or r"(?!)")

    def _backwards(self) -> dict[int, tuple[int, int, int]]:
        """The tokens from their last byte to their first as a tree: node << 8 | byte to node (0: the root), with the tokens that
        the node is inside a word and at its end (-1: none)."""
        back: dict[int, tuple[int, int, int]] = {}
        for kind, tokens in ((1, self.by_bytes), (2, self.ending)):
            for raw, token in tokens.items():
                if kind == 2 or not raw.endswith(MARK):
                    node = 0
                    for byte in reversed(raw):
                        key = node << 8 | byte
                        node = back.setdefault(key, (len(back) + 1, -1, -1))[0]
                    back[key] = (node, token, back[key][2]) if kind == 1 else (node, back[key][1], token)
        return back

    # -- ids ---------------------------------------------------------------------------------------------------
    def _chunk_ids(self, chunk: bytes) -> bytes:
        """A chunk's ids; full caches become the older generation, which is asked before anything is encoded again."""
        out = self._older.get(chunk)
        if out is None:
            text = chunk.decode()
            m = SIMPLE.fullmatch(text)
            if m:
                word, close = m.groups()
                ids = self.core.encode_single_piece(word.lower().encode() + MARK)
                if close:
                    ids += self._closing.get(close) or self._closing.setdefault(close, self.core.encode_single_piece(close.encode() + MARK))
            else:
                ids = self.library.encode(text, add_special_tokens=False).ids
            out = array("I", ids).tobytes()
        if len(chunk) > CACHED_LENGTH:
            return out
        if len(self._ids) >= CACHE_ENTRIES:
            self._older = dict(self._ids)
            self._ids.clear()
            self._closing.clear()
        self._ids[chunk] = out
        return out

    def chunk_ids(self, text: str) -> list[bytes]:
        """The ids of the text's chunks, one by one; splitting bytes cuts at ASCII white space only."""
        get, make = self._ids.get, self._chunk_ids
        return [get(c) or make(c) for c in text.encode().split()]

    def ids(self, text: str) -> bytes:
        """The text's ids as unsigned 32-bit integers of this machine (little-endian), without the tokenizer's own special tokens."""
        return b"".join(self.chunk_ids(text))

    # -- counts at every prefix ----------------------------------------------------------------------------------
    def _joins(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens as they are when they stand side by side."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= 4 * CACHE_ENTRIES:
                self._fits.clear()
            known = self._fits[key] = self.core.encode_single_piece(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def _whole(self, token: int) -> bool:
        known = self._wholes.get(token)
        if known is None:
            known = self._wholes[token] = self.core.encode_single_piece(self.bytes_of[token]) == [token]
        return known

    def _ends(self, raw: bytes, end: int, last: list[int]) -> tuple[int, int, int]:
        """The last token of the merged ``raw[:end]``, where it starts, and where the last one starts if the word ends there."""
        get, joins = self._back.get, self._fits
        node, at, plain, ending = 0, end, [], []
        while at and (step := get(node << 8 | raw[at - 1])) is not None:
            at -= 1
            node, inside, closing = step
            if inside >= 0:
                plain.append((at, inside))
            if closing >= 0:
                ending.append((at, closing))
        found = []
        for tokens in (plain, ending):  # the longest that stays whole beside what precedes it
            while tokens:
                at, t = tokens.pop()
                if self._whole(t) if at == 0 else (self._joins(last[at], t) if (f := joins.get((last[at], t))) is None else f):
                    found.append((t, at))
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return *found[0], found[1][1]

    def word_prefix_counts(self, word: str) -> list[int]:
        """The programme over one pre-token: entry j is the exact count of the word cut after j code points.

        Words share their beginnings, so the entries of short ones are kept: last token and count of a beginning, and its
        count as a whole word."""
        known = self._words.get(word)
        if known is not None:
            return known
        if len(self._heads) >= 2 * CACHE_ENTRIES:
            self._heads.clear()
            self._starts.clear()
            self._made_heads = 0
        raw, get = word.encode(), self._heads.get
        known = self._starts.get(raw[:START])
        if known is None:
            last, plain, out, node, end = [-1], [0], [0], 0, 0
        else:
            last, plain, out, node, end = known[0].copy(), known[1].copy(), known[2].copy(), known[3], START
        for byte in raw[end:] if end else raw:  # along the beginnings that are known
            entry = get(node << 8 | byte)
            if entry is None:
                break
            node, token, count, whole = entry
            last.append(token)
            plain.append(count)
            out.append(whole)
            end += 1
        while end < len(raw):
            end += 1
            token, start, close = self._ends(raw, end, last)
            last.append(token)
            plain.append(plain[start] + 1)
            out.append(plain[close] + 1)
            if end <= HEAD:
                self._made_heads += 1
                self._heads[node << 8 | raw[end - 1]] = (self._made_heads, token, plain[-1], out[-1])
                node = self._made_heads
                if end == START:
                    self._starts[raw[:START]] = (last.copy(), plain.copy(), out.copy(), node)
        if len(raw) > len(word):  # counts where a code point ends
            out = [n for n, after in zip(out, [*raw, 0], strict=True) if after & 0xC0 != 0x80]
        if len(word) <= CACHED_LENGTH:
            if len(self._words) >= CACHE_ENTRIES:
                self._words.clear()
            self._words[word] = out
        return out

    def chunk_prefix_counts(self, chunk: str) -> list[int]:
        """Entry j: the exact count of the chunk cut after j code points."""
        m = SIMPLE.fullmatch(chunk)
        if m:
            out = self.word_prefix_counts(m[1].lower())
            return out + [out[-1] + n for n in self.word_prefix_counts(m[2])[1:]] if m[2] else out
        out, base, at = [0], 0, 0
        for special in self._special.finditer(chunk):
            # Up to its last character a special string is ordinary text; then it is one token, and so is what precedes it cut off.
            counts = Growing(self).counts(chunk[at : special.end() - 1])
            out += [base + n for n in counts[1:]]
            base += counts[special.start() - at] + 1
            out.append(base)
            at = special.end()
        out += [base + n for n in Growing(self).counts(chunk[at:])[1:]]
        total = len(self.library.encode(chunk, add_special_tokens=False).ids)
        return out if out[-1] == total else [len(e.ids) for j in range(0, len(chunk) + 1, 256) for e in self.library.encode_batch([chunk[:k] for k in range(j, min(j + 256, len(chunk) + 1))], add_special_tokens=False)]

    def _chunk_deltas(self, chunk: str) -> tuple[bytes, int]:
        """The steps from each prefix's count to the next, as 16-bit integers, and their sum."""
        out = self._older_deltas.get(chunk)
        if out is not None:
            pass
        elif not chunk or BLANK.match(chunk):
            out = (bytes(2 * len(chunk)), 0)
        else:
            counts = self.chunk_prefix_counts(chunk)
            out = (array("h", [b - a for a, b in pairwise(counts)]).tobytes(), counts[-1])
        if len(chunk) <= CACHED_LENGTH:
            if len(self._deltas) >= DELTA_ENTRIES:
                self._older_deltas = dict(self._deltas)
                self._deltas.clear()
            self._deltas[chunk] = out
        return out

    def prefix_deltas(self, text: str) -> tuple[bytes, int]:
        """For each code point, by how much it changes the exact count of the text up to it (16 bits each); the whole count."""
        get, make = self._deltas.get, self._chunk_deltas
        parts = [get(c) or make(c) for c in BLANK.split(text)]
        return b"".join([d for d, _ in parts]), sum([n for _, n in parts])

    def prefix_counts(self, text: str) -> np.ndarray:
        """Entry j: the exact token count of ``text[:j]`` (``len(text) + 1`` entries)."""
        return np.concatenate(([0], np.cumsum(np.frombuffer(self.prefix_deltas(text)[0], "<i2"), dtype=np.int64)))


class Growing:
    """The programme over a growing text without special strings: normalised, pre-tokenised and merged as it grows.

    ``kind`` is what the text ends in: letters L, marks M, an apostrophe that may begin a contraction A, such an apostrophe with
    a letter that needs another one R, or a finished pre-token (empty). ``base`` counts the tokens of finished pre-tokens, and
    ``at`` is where the unfinished one starts in ``raw``.
    """

    def __init__(self, bpe: WordBpe):
        self.bpe, self.raw, self.last, self.plain, self.kind, self.base, self.at = bpe, bytearray(), [-1], [0], "", 0, 0

    def counts(self, text: str) -> list[int]:
        """Entry j: the exact count of ``text[:j]``."""
        out = [0]
        if unicodedata.is_normalized("NFC", text):  # then all its prefixes are
            for char in text:
                for c in char.lower():
                    self._push(c)
                out.append(self._count())
            return out
        group, kept = "", self._state()  # characters that later ones may still compose with, and the state before them
        compose = lambda t: unicodedata.normalize("NFC", t)
        for char in text:
            if not unicodedata.combining(char) and compose(group + char) == compose(group) + compose(char):
                group, kept = "", self._state()
            group += char
            self._restore(kept)
            for composed in compose(group):
                for c in composed.lower():
                    self._push(c)
            out.append(self._count())
        return out

    def _state(self) -> tuple:
        return self.kind, self.base, self.at, len(self.raw)

    def _restore(self, state: tuple) -> None:
        self.kind, self.base, self.at, n = state
        del self.raw[n:], self.last[n + 1 :], self.plain[n + 1 :]

    def _tail(self, end: int, marked: bool) -> tuple[int, int]:
        """The last token of the merged pre-token up to ``end`` and how many tokens precede it."""
        bpe, raw, at = self.bpe, self.raw, self.at
        for start in range(max(at, end - bpe.longest), end):
            key = bytes(raw[start:end])
            token = bpe.by_bytes.get(key + MARK if marked else key)
            if token is not None and (bpe._whole(token) if start == at else bpe._joins(self.last[start], token)):
                return token, self.plain[start] if start > at else 0
        raise ValueError("the vocabulary lacks a byte")

    def _extend(self, c: str) -> None:
        for byte in c.encode():
            self.raw.append(byte)
            token, before = self._tail(len(self.raw), False)
            self.last.append(token)
            self.plain.append(before + 1)

    def _word(self, word: str) -> int:
        return len(self.bpe.core.encode_single_piece(word.encode() + MARK))

    def _count(self) -> int:
        if not self.kind:
            return self.base
        if self.kind == "R":
            return self.base + self._word("'") + self._word(chr(self.raw[-1]))
        return self.base + self._tail(len(self.raw), True)[1] + 1

    def _finish(self) -> None:
        self.base, self.kind, self.at = self._count(), "", len(self.raw)

    def _push(self, c: str) -> None:
        if self.kind == "A" and c in CONTRACTED or self.kind == "R" and CONTRACTED[chr(self.raw[-1])] == c:
            if self.kind == "A" and CONTRACTED[c]:
                self.kind = "R"
            else:
                self.base += self._word(self.raw[self.at :].decode() + c)
                self.kind = ""
            self._note(c)
            if not self.kind:
                self.at = len(self.raw)
            return
        if self.kind == "R":  # no contraction: the apostrophe is done and its letter begins a word
            letter = chr(self.raw[-1])
            self.base, self.kind = self.base + self._word("'"), "L"
            self._restore((self.kind, self.base, len(self.raw) - 1, len(self.raw) - 1))
            self._extend(letter)
        group = unicodedata.category(c)[0]
        kind = "" if c in WHITE else group if group in "LN" else "M"
        if kind == "M" and self.kind in ("A", "M"):
            self.kind = "M"
        elif kind != self.kind or kind in ("", "N"):
            self._finish() if self.kind else None
            self.at = len(self.raw)
            self.kind = "A" if c == "'" else kind
        if kind:
            self._extend(c)
            if kind == "N":
                self.kind = "M"
                self._finish()
        else:
            self._note(c)
            self.at, self.kind = len(self.raw), ""

    def _note(self, c: str) -> None:
        """Room for a character whose pre-token is not merged step by step."""
        for byte in c.encode():
            self.raw.append(byte)
            self.last.append(-1)
            self.plain.append(0)
