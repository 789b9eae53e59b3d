"""Merge vocabularies of the tokenizers JSON format: exact BPE of single pre-tokens.

A word is encoded by *speculate and verify*. Greedy longest match proposes tokens. A proposal equals
the BPE result exactly when every token can be built by merges alone and no pair of neighbours would
merge across its border, so all pairs of a batch of words are tested together in NumPy. Only words
with a failing pair run the merges one by one.

The pair test replays merge time. Left of the border the last symbol walks down the right spine of
the left token, right of it the first symbol walks down the left spine of the right token. Two
symbols on either side exist together between the ranks at which they are built and used up; a merge
of the two with a rank inside that span would have crossed the border. Equal ranks merge leftmost
first, so a crossing merge loses a tie to the left parent and wins one against the right parent.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache
from itertools import pairwise

import numpy as np

#: Word ends are one character outside the byte alphabet, so that symbols are plain strings.
END = "\ue000"
NEVER = np.int64(2**31)
#: Encoded words that a worker keeps; past it the memory is emptied, which costs time only.
CACHE_WORDS = 300_000

#: Characters that Python and the tokenizers library sort into the same classes; a text with any other
#: one is split by the library itself.
_STABLE = (
    r"\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u0391-\u03a1\u03a3-\u03ff\u0400-\u04ff"
    r"\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
)
UNSTABLE = re.compile(f"[^{_STABLE}]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in set(kept) else chr(next(other)) for b in range(256)]


class Merges:
    """Tokens and merges of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        inner = (lambda s: s[: -len(suffix)] + END if s.endswith(suffix) else s) if suffix else str
        self.end = END if suffix else ""
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        alphabet = byte_alphabet()
        self.to_alphabet = {b: c for b, c in enumerate(alphabet)}
        self.from_alphabet = {c: b for b, c in enumerate(alphabet)}
        self.ids = {inner(s): i for s, i in model["vocab"].items()}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.rank = np.full(size, -1, np.int64)
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = map(inner, merge.split(" ") if isinstance(merge, str) else merge)
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.merged.setdefault((left, right), (rank, whole))
            if self.rank[whole] < 0:
                self.left[whole], self.right[whole], self.rank[whole] = left, right, rank
        keys = np.array([(a << 32) | b for a, b in self.merged], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        ranks = np.array([r for r, _ in self.merged.values()], np.int64)
        self.key_ranks = np.append(ranks[order], NEVER)
        built = self.rank >= 0
        #: The replay holds only if a merge always comes after those that build its parts.
        self.ordered = bool(
            (np.maximum(self.rank[self.left[built]], self.rank[self.right[built]]) < self.rank[built]).all()
            and built.sum() == len(self.merged)
        )
        self.proposals = self._proposals()
        self.longest: dict[str, int] = {}
        for s in self.proposals:
            self.longest[s[:2]] = max(self.longest.get(s[:2], 1), len(s))
        self.bytes_of = [b""] * size
        for s, i in self.ids.items():
            self.bytes_of[i] = bytes(self.from_alphabet[c] for c in s if c != END)
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.known: dict[str, bytes] = {}
        self.speculated = self.failed = 0

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.key_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge of a rank under ``before`` crosses the border of each pair of tokens."""
        x, y = a.copy(), b.copy()
        used_x = np.full(len(a), NEVER) if before is None else before.copy()
        used_y = used_x.copy()
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            p, q = x[live], y[live]
            cross = self._pair_rank(p, q)
            bad = (cross < used_x[live]) & (cross <= used_y[live])
            good[live[bad]] = False
            rank_p, rank_q = self.rank[p], self.rank[q]
            go = ~bad & (np.maximum(rank_p, rank_q) >= 0)
            down_x = go & (rank_p > rank_q)
            down_y = go & ~down_x
            i, j = live[down_x], live[down_y]
            used_x[i], x[i] = rank_p[down_x], self.right[p[down_x]]
            used_y[j], y[j] = rank_q[down_y], self.left[q[down_y]]
            live = live[go]
        return good

    def _proposals(self) -> dict[str, int]:
        """Tokens that merges can build; a proposal of another one would never be right."""
        built = np.flatnonzero(self.rank >= 0)
        built = built[np.argsort(self.rank[built])]
        fine = self.compatible(self.left[built], self.right[built], self.rank[built])
        reachable = np.zeros(len(self.rank), bool)
        reachable[[i for i in self.ids.values() if self.rank[i] < 0]] = True
        for t, ok in zip(built.tolist(), fine.tolist(), strict=True):
            reachable[t] = ok and reachable[self.left[t]] and reachable[self.right[t]]
        return {s: i for s, i in self.ids.items() if reachable[i]}

    def _greedy(self, s: str) -> list[int]:
        out, at, n, ids, longest = [], 0, len(s), self.proposals, self.longest
        last = n - 1 if self.end else -1  # a token never ends between the last symbol and its end mark
        while at < n:
            end = min(n, at + longest.get(s[at : at + 2], 1))
            while end == last or s[at:end] not in ids:
                end -= 1
            out.append(ids[s[at:end]])
            at = end
        return out

    def _exact(self, s: str) -> list[int]:
        """The merges one by one, lowest rank first and leftmost first among equals."""
        ids = [self.ids[c] for c in s] if not self.end else self._symbols(s)
        if len(ids) <= 48:
            return self._exact_short(ids)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        queue = []
        for i in range(len(ids) - 1):
            if found := self.merged.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, whole = heapq.heappop(queue)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = whole, -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < len(ids) and (found := self.merged.get((ids[p], ids[q]))):
                    heapq.heappush(queue, (found[0], p, ids[p], ids[q], found[1]))
        return [i for i in ids if i >= 0]

    def _exact_short(self, ids: list[int]) -> list[int]:
        merged, none = self.merged, (1 << 40, -1)
        pairs = [merged.get(p, none) for p in pairwise(ids)]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = merged.get((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = merged.get((ids[i], ids[i + 1]), none)
        return ids

    def _symbols(self, s: str) -> list[int]:
        return [self.ids[c] for c in s[:-2]] + [self.ids[s[-2:]]]

    def symbols_text(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.to_alphabet) + self.end

    def encode_words(self, new: list[str]) -> list[list[int]]:
        """Token ids of each distinct non-empty word."""
        texts = [self.symbols_text(w) for w in new]
        out = [self._greedy(s) for s in texts]
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((i for ids in out for i in ids), np.int64, int(lengths.sum()))
        word = np.repeat(np.arange(len(out)), lengths)
        inside = np.flatnonzero(word[1:] == word[:-1])
        if self.ordered:
            bad = inside[~self.compatible(flat[inside], flat[inside + 1])]
            redo = np.unique(word[bad])
        else:
            redo = np.arange(len(out))
        for i in redo.tolist():
            out[i] = self._exact(texts[i])
        self.speculated += len(out)
        self.failed += len(redo)
        return out

    def learn(self, words: set[str]) -> None:
        """Put the packed ids of all ``words`` into ``known``."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for w, ids in zip(new, self.encode_words(new), strict=True):
            self.known[w] = np.array(ids, "<u4").tobytes()

    def pieces(self, text: str) -> list[tuple[bool, str]]:
        """The text cut at special strings: (whether special, piece)."""
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [(False, text[at : m.start()]), (True, m.group())]
            at = m.end()
        return [*out, (False, text[at:])]

    def plain_word(self, piece: str) -> str:
        """A pre-token of the library, which is in the byte alphabet, as text."""
        return bytes(self.from_alphabet[c] for c in piece).decode()


class ByteLevel:
    """Pre-tokens of byte-level files, as the library cuts them."""

    PATTERN = re.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
    )

    def __init__(self, path: str) -> None:
        self.path, self.merges, self._library = path, Merges(path), None

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def words(self, text: str) -> list[str]:
        if UNSTABLE.search(text):
            cut = self.library().pre_tokenizer.pre_tokenize_str(text)
            return [self.merges.plain_word(piece) for piece, _ in cut]
        return self.PATTERN.findall(text)


class LowerCase(ByteLevel):
    """Pre-tokens of the lower-case file, white space dropped, as the library cuts them."""

    PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

    def words(self, text: str) -> list[str]:
        if UNSTABLE.search(text):
            text = self.library().normalizer.normalize_str(text)
            cut = self.library().pre_tokenizer.pre_tokenize_str(text)
            return [self.merges.plain_word(piece) for piece, _ in cut]
        # the library lowers each character alone: no final sigma
        return self.PATTERN.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


@lru_cache(maxsize=2)
def splitter(path: str, kind: str) -> ByteLevel:
    """One per worker process and file."""
    return {"byte": ByteLevel, "word": LowerCase}[kind](path)
