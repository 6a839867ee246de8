"""Byte-level BPE by per-prefix dynamic programming, and its inverse.

The last token of the encoding of a prefix is unique. For every end position the tokens that are suffixes there come from a
suffix-matching automaton; a candidate is the last token if it may follow the stored last token of the prefix before it,
which is decided by undoing the merges of both tokens (no merge across the border may come before those that built them).
Back-pointers then give the ids. Encodings of pieces are kept in a bounded table, as pieces repeat much.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import ahocorasick
import numpy as np
import regex

from .common import kept

#: The split pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII and Latin letters only: the plain engine is faster.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_FAST = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^ \t-\r{_LATIN}0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
_PLAIN = re.compile(rf"[\x00-\x1b -\x7f{_LATIN}]*")
#: Entries of a table of pieces or token pairs before it is emptied.
KEEP = 450_000


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file (the JSON of a byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = byte_letters()
        self._letters = letters
        back = {c: b for b, c in letters.items()}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in self.vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self._prepare(spec)
        self._pieces: dict[str, bytes] = {}
        self._split = regex.compile(PATTERN)
        self._split_fast = re.compile(_FAST)
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _prepare(self, spec: dict) -> None:
        """The tables of the dynamic programme."""
        # Ranks: single letters first, then merges in order; _parts undoes a merge.
        self._merged: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        singles = [c for c in self._letters.values() if c in self.vocab]
        rank = {c: i for i, c in enumerate(singles)}
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if a in rank and b in rank and (a + b) in self.vocab:
                r = rank.setdefault(a + b, len(rank))
                self._merged.setdefault((rank[a], rank[b]), r)
                self._parts.setdefault(r, (rank[a], rank[b]))
        self._rank_id = [0] * len(rank)
        self._matches = ahocorasick.Automaton()
        for token, r in rank.items():
            self._rank_id[r] = self.vocab[token]
            self._matches.add_word(token, (r, len(token)))
        self._matches.make_automaton()
        self._fits: dict[int, bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may directly follow token a: undo the later merge of the two again and again; no pair at the border may
        have been merged before the merge that is being undone."""
        key = a << 20 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > KEEP:
                self._fits.clear()
            known = self._fits[key] = self._fits_slow(a, b)
        return known

    def _fits_slow(self, a: int, b: int) -> bool:
        merged, parts, before = self._merged, self._parts, 1 << 40
        while True:
            across = merged.get((a, b))
            if across is not None and across < before:
                return False
            whole_a, whole_b = a in parts, b in parts
            if not (whole_a or whole_b):
                return True
            if whole_a and (a > b or not whole_b):
                before, a = a, parts[a][1]
            else:
                before, b = b + 1, parts[b][0]

    def piece_ids(self, piece: str) -> list[int]:
        """The ids of one piece of the split, by the dynamic programme over its prefixes."""
        text = "".join(map(self._letters.__getitem__, piece.encode("utf-8", "surrogatepass")))
        last, length, fits = [-1] * len(text), [0] * len(text), self._fits.get
        for end, (token, n) in self._matches.iter(text):
            if last[end] < 0:
                start = end - n
                if start >= 0:
                    before = last[start]
                    if before < 0:
                        continue
                    ok = fits(before << 20 | token)
                    if not (self.fits(before, token) if ok is None else ok):
                        continue
                last[end] = token
                length[end] = n
        ids, at = [], len(text) - 1
        while at >= 0:
            ids.append(self._rank_id[last[at]])
            at -= length[at]
        return ids[::-1]

    def pieces(self, text: str) -> list[str]:
        return (self._split_fast if _PLAIN.fullmatch(text) else self._split).findall(text)

    def _known(self, piece: str) -> bytes:
        got = self._pieces.get(piece)
        if got is None:
            if len(self._pieces) > KEEP:
                self._pieces.clear()
            got = np.array(self.piece_ids(piece), "<u4").tobytes()
            if len(piece) < 64:
                self._pieces[piece] = got
        return got

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out = []
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                pieces = self.pieces(part)
                try:
                    out.append(b"".join(map(self._pieces.__getitem__, pieces)))
                except KeyError:
                    out.append(b"".join(map(self._known, pieces)))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; broken sequences become replacement characters."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode("utf-8")

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(list(ids), "<u4").tobytes()).decode("utf-8")


class LibraryCodec(Codec):
    """The same ids, with pieces not yet in the table encoded by the tokenizers library's model, which never splits them again: a piece
    of any length costs n log n."""

    def _prepare(self, spec: dict) -> None:
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_str(json.dumps(spec)).model
        self._shown = {b: ord(c) for b, c in self._letters.items()}

    def piece_ids(self, piece: str) -> list[int]:
        return [t.id for t in self._model.tokenize(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._shown))]


def codec(path: str, kind: type = Codec) -> Codec:
    """One codec a worker process and file."""
    if (kind, path) not in kept:
        kept[kind, path] = kind(path)
    return kept[kind, path]
