"""Exact BPE encoding by backtracking over Aho-Corasick matches, and decoding through an offset table.

The encoder walks a word once. At each position it tries the longest vocabulary entry that an Aho-Corasick automaton
found there; the entry is kept if the pair it forms with the previous token could stand side by side in a finished merge
sequence (the pair-compatibility table), else the next shorter entry is tried, and with none left the previous token is
taken back. A bit per position says whether a dead end is known there, so that each position is left once at most and
the work is linear in the word's length.

Defined results: a null text is an empty text and has no tokens; text of any length is one pass; unknown bytes cannot
occur, as every byte is a token. Equal texts have equal ids, however often they come.
"""

from __future__ import annotations

import functools
import json
import re

import ahocorasick
import numpy as np

#: Stands for the mark that some vocabularies put at a word's end; no byte is written with this character.
END = "\ue000"


@functools.cache
def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable, else the next free one from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class BacktrackingBPE:
    """Encodes words (str of byte characters) into token ids exactly as repeated lowest-rank merging does."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end_of_word: str = "") -> None:
        inner = (lambda t: t[: -len(end_of_word)] + END if end_of_word and t.endswith(end_of_word) else t)
        self.end = END if end_of_word else ""
        made = {a + b if not (end_of_word and a.endswith(end_of_word)) else "" for a, b in merges}
        base = sorted((i, t) for t, i in vocab.items() if t not in made and len(inner(t).removesuffix(END)) == 1)
        # internal numbers: single bytes first, then merges by rank, so that a smaller number merges earlier
        names = [t for _, t in base] + [a + b for a, b in merges]
        number = {t: n for n, t in enumerate(names)}
        self.ids = [vocab[t] for t in names]
        self.text = [inner(t) for t in names]
        self.length = [len(t) for t in self.text]
        self.parts = [(n, n) for n in range(len(base))] + [(number[a], number[b]) for a, b in merges]
        self.merged = {p: n for n, p in enumerate(self.parts) if n >= len(base)}
        self.compatible: dict[tuple[int, int], bool] = {}
        own = {t: n for n, t in enumerate(self.text) if self.parts[n][0] == n or self._stands(*self.parts[n], n)}
        self.shorter = [next((own[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in own), -1) for t in self.text]
        self.automaton = ahocorasick.Automaton()
        for t, n in own.items():
            self.automaton.add_word(t, n)
        self.automaton.make_automaton()

    def _stands(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """False if undoing merges in reverse rank order shows a merge across the boundary that would have come first."""
        merged, parts = self.merged, self.parts
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, parts[left][1]
                if left == limit:
                    limit, right = right + 1, parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, parts[right][0]
                if right + 1 == limit:
                    limit, left = left, parts[left][1]
                    if left == limit:
                        return True

    def pair_ok(self, left: int, right: int) -> bool:
        """The pair-compatibility table, filled as pairs are met; emptied at a million pairs to bound memory."""
        ok = self.compatible.get((left, right))
        if ok is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            ok = self.compatible[left, right] = self._stands(left, right)
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token written in byte characters."""
        if not word:
            return []
        text, length, shorter = word + self.end, self.length, self.shorter
        n = len(text)
        longest = [-1] * n
        for at, token in self.automaton.iter(text):
            start = at + 1 - length[token]
            if longest[start] < 0 or length[longest[start]] < length[token]:
                longest[start] = token
        open_at, found, at, token = bytearray(b"\x01") * (n + 1), [], 0, longest[0]
        while at < n:
            stop = -1
            while token >= 0:
                stop = at + length[token]
                if open_at[stop] and (not found or self.pair_ok(found[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                found.append(token)
                at = stop
                token = longest[at] if at < n else -1
                # a word-end mark never starts a token; such a position is a dead end
            else:
                open_at[at] = 0
                token = found.pop()
                at -= length[token]
        return [self.ids[t] for t in found]


class TextEncoder:
    """Whole texts to ids with a tokenizers file of kind BPE with byte characters, lower-casing and word ends.

    ``words="backtracking"`` encodes words here; ``words="library"`` asks the tokenizers library for each new word.
    White-space separated chunks are looked up in a bounded memo first: most chunks repeat.
    """

    #: Words kept in each of the memo's two generations, the longest word that is kept, and words kept between partitions.
    MEMO, MEMO_CHARS, KEPT = 350_000, 48, 100_000

    def __init__(self, path: str, words: str = "backtracking") -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = (spec := json.load(f))["model"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = words
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        own = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.bpe = BacktrackingBPE(own, merges, model["end_of_word_suffix"] or "") if words == "backtracking" else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.letters = dict(enumerate(byte_alphabet()))
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # In this range lower-casing is one character to one of the range, normal form needs no tables, and the pre-tokenizer's
        # classes are these. Letters whose lower case lies beyond the range, or is two characters, are left to the library.
        within = [c for c in "".join(map(chr, [*range(9, 14), *range(32, 127), *range(0xA1, 0x1BC), *range(0x1C0, 0x250)])) if len(c.lower()) == 1 and ord(c.lower()) < 0x250]
        self.plain = re.compile("[" + "".join(map(re.escape, within)) + "]*")
        letter = "".join(sorted({c for c in map(chr, range(0x250)) if c.isalpha()}))
        digit = "".join(c for c in map(chr, range(0x250)) if c.isnumeric())
        self.pieces = f"('s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^\\s{letter}{digit}]+)"
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            self.strings[i] = t
        self.decoder = OffsetTable([(t + " ").encode() for t in self.strings])
        self.decimals = OffsetTable([f"{i} ".encode() for i in range(size)])

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids, as bytes of int32, of pre-tokens in the plain range."""
        out = list(map(self.young.get, words))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            w = words[k]
            ids = self.old.get(w)
            if ids is None:
                ids = np.array(self._word(w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)), np.int32).tobytes()
            out[k] = ids
            if len(w) <= self.MEMO_CHARS:
                if len(self.young) >= self.MEMO:
                    self.old, self.young = self.young, {}
                self.young[w] = ids
        return out

    def _word(self, word: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(word)] if self.bpe is None else self.bpe.encode_word(word)

    def _odd(self, text: str) -> np.ndarray:
        """Any text: the library's own normalisation and word split (or all of its encoding)."""
        if self.bpe is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
        out: list[int] = []
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    out += self.bpe.encode_word(word)
        return np.array(out, np.int32)

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the n + 1 bounds of each text's ids."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = [t or "" for t in texts]
        odd = {k for k, t in enumerate(texts) if self.plain.fullmatch(t) is None or (self.at_special and self.at_special.search(t))}
        split = pc.ascii_split_whitespace(pa.array(["" if k in odd else t for k, t in enumerate(texts)], pa.large_string()))
        bounds = split.offsets.to_numpy().astype(np.int64)
        chunks = split.values.dictionary_encode()
        codes = chunks.indices.to_numpy(zero_copy_only=False)
        # each distinct chunk is one word if it has letters only, else it is split into several
        lower = pc.utf8_lower(chunks.dictionary)
        whole = pc.utf8_is_alpha(lower)
        parts = pc.ascii_split_whitespace(pc.if_else(whole, lower, pc.replace_substring_regex(pc.if_else(whole, "", lower), pattern=self.pieces, replacement=r"\1 ")))
        words = parts.values.dictionary_encode()
        table = OffsetTable(self._known(words.dictionary.to_pylist()), np.int32)
        word = words.indices.to_numpy(zero_copy_only=False)
        held = np.concatenate([[0], np.cumsum(table.sizes[word])])[parts.offsets.to_numpy()]
        table = OffsetTable.cut(table.gather(word), held)
        sizes = np.concatenate([[0], np.cumsum(table.sizes[codes])])
        starts = sizes[bounds - bounds[0]]
        flat = table.gather(codes)
        if odd:
            parts = [self._odd(t) if k in odd else flat[starts[k] : starts[k + 1]] for k, t in enumerate(texts)]
            flat, starts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return flat.astype(np.int32, copy=False), starts.astype(np.int64)

    def rest(self) -> None:
        """At a partition's end: the memo goes, but for a small one, as the worker process goes on to other stages."""
        self.old = {}
        if len(self.young) > self.KEPT:
            self.young = {}

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8, special tokens included: token strings with a space between, from the offset table."""
        return self.decoder.gather(np.asarray(ids, np.int64)).tobytes()[:-1]


class OffsetTable:
    """Entries of any length in one array, found by the offsets of their bounds; ``gather`` joins entries by number."""

    #: Output elements in a step, which bounds the memory for positions.
    STEP = 1 << 21

    def __init__(self, entries: list[bytes], dtype: type = np.uint8) -> None:
        self.flat = np.frombuffer(b"".join(entries), dtype)
        self.sizes = np.array([len(e) for e in entries], np.int64) // self.flat.itemsize
        self.starts = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def cut(cls, flat: np.ndarray, bounds: np.ndarray) -> OffsetTable:
        """Entry k is flat[bounds[k]:bounds[k + 1]]."""
        self = cls.__new__(cls)
        self.flat, self.starts, self.sizes = flat, bounds[:-1].astype(np.int64), np.diff(bounds).astype(np.int64)
        return self

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        if not len(numbers):
            return self.flat[:0]
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        out, done = np.empty(int(ends[-1]), self.flat.dtype), 0
        while done < len(numbers):
            before = int(ends[done - 1]) if done else 0
            stop = max(done + 1, int(np.searchsorted(ends, before + self.STEP, "right")))
            n, s = numbers[done:stop], sizes[done:stop]
            to = int(ends[stop - 1])
            shift = self.starts[n] - (ends[done:stop] - s - before)
            out[before:to] = self.flat[np.arange(to - before) + np.repeat(shift, s)]
            done = stop
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str, words: str = "backtracking") -> TextEncoder:
    """One encoder for each file and worker process."""
    return TextEncoder(path, words)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
