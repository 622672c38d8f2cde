"""Token ids of whole texts. Pre-tokens are found by array operations, and each distinct one is encoded once."""

from __future__ import annotations

import functools
import json
import os
import unicodedata

import numpy as np

from quarry.llm.common import SLICE_BYTES, mix, power_tables

_LIMIT = 0x250  # texts with characters beyond go to the tokenizer as they are
_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3
_CLASS = np.array([{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(_LIMIT)], np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = _SPACE
_CODE = mix(np.arange(1, _LIMIT + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
#: The suffixes that the byte-level pattern splits off after an apostrophe, in its order.
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker: it serves task after task, and its tables are built once."""
    return Encoder(path)


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer file, with a bounded cache of pre-tokens."""

    def __init__(self, path: str, cache: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.fast, self.compared = self._same_by_ranks(path), 0
        self._clear()

    def _same_by_ranks(self, path: str):
        """An encoder that merges by rank, built from the same file, where its merges are in the order of their ids.

        Byte-level BPE with such merges gives the same ids; each worker still compares the first words with the
        tokenizer itself, and does without it where they differ.
        """
        try:
            import tiktoken
        except ImportError:
            return None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocabulary["".join(m)] for m in merges]
        if ids != sorted(ids):
            return None
        plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
        shown = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
        ranks = {bytes(shown[x] for x in word): n for word, n in vocabulary.items() if word not in self.specials}
        pattern = r"[\n]|[^\n]+"
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after another, and how many each has.

        Those without a line break are encoded as one text, where a line break is a pre-token of its own.
        """
        broken = [k for k, w in enumerate(words) if "\n" in w]
        lines = [w for w in words if "\n" not in w] if broken else words
        joined, ids = "\n".join(lines), None
        if lines and self.fast is not None:
            ids = self.fast.encode_ordinary(joined)
            if self.compared < 20_000:
                self.compared += len(lines)
                plain = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids
                if ids != plain:
                    self.fast, ids = None, plain
        if ids is None:
            ids = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids if lines else []
        ids = np.array(ids, np.uint32)
        at = np.flatnonzero(ids == self.line)
        if self.line is None or len(at) != max(0, len(lines) - 1):
            parts = self._plain(words)
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        lengths = np.diff(at, prepend=-1, append=len(ids)) - 1 if lines else np.zeros(0, np.int64)
        ids = np.delete(ids, at)
        if broken:
            parts = self._plain([words[k] for k in broken])
            whole = np.zeros(len(words), np.int64)
            plain = np.ones(len(words), bool)
            plain[broken] = False
            whole[plain], whole[broken] = lengths, [len(x) for x in parts]
            spread = np.repeat(plain, whole)
            every = np.empty(len(spread), np.uint32)
            every[spread], every[~spread] = ids, np.concatenate(parts)
            return every, whole
        return ids, lengths

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the tokenizer gives them with add_special_tokens=False."""
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE_BYTES // 2):
                size += len(texts[j])
                j += 1
            out += self._slice(texts[i:j])
            i = j
        return out

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        odd = {int(x) for x in np.unique(np.searchsorted(offsets, np.flatnonzero(codes >= _LIMIT), side="right") - 1)}
        odd |= {k for k, t in enumerate(texts) for s in self.specials if s in t}
        if odd:
            out: list = [None] * len(texts)
            rest = [k for k in range(len(texts)) if k not in odd]
            for k, ids in zip(rest, self._slice([texts[k] for k in rest]) if rest else []):
                out[k] = ids
            order = sorted(odd)
            for k, ids in zip(order, self._plain([texts[k] for k in order])):
                out[k] = ids
            return out
        n = len(codes)
        if not n:
            return [np.zeros(0, np.uint32)] * len(texts)
        cls = _CLASS[codes]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        mark = edge[:-1].copy()
        mark[1:] |= cls[1:] != cls[:-1]
        space = cls == _SPACE
        last = np.zeros(n, bool)  # last white space before another character of the same text
        last[:-1] = space[:-1] & ~space[1:] & ~edge[1:-1]
        mark |= last
        at = np.flatnonzero(last)
        joins = at[codes[at] == 32] + 1
        mark[joins] = False
        quote = np.flatnonzero((codes[:-1] == 39) & (cls[1:] == _LETTER) & mark[:-1] & ~edge[1:-1])
        for k in quote:  # a joined space would have taken the mark
            for s in _SUFFIXES:
                if joined.startswith(s, k + 1) and not edge[k + 1 : k + 1 + len(s)].any():
                    mark[k + 1] = False
                    if k + 1 + len(s) < n:
                        mark[k + 1 + len(s)] = True
                    break
        start = np.flatnonzero(mark)
        end = np.append(start[1:], n)
        with np.errstate(over="ignore"):
            power, inverse = power_tables(n)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_CODE[codes] * power[:n], out=total[1:])
            h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
        keys, first, word = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(keys) > self.cache:
            self._clear()
        known = self.known
        slot = np.fromiter((known.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        new = np.flatnonzero(slot < 0)
        if len(new):
            ids, lengths = self._words([joined[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
            slot[new] = np.arange(len(self.length), len(self.length) + len(new))
            known.update(zip(keys[new].tolist(), slot[new].tolist()))
            begin = np.cumsum(lengths) - lengths + len(self.ids)
            self.ids = np.concatenate([self.ids, ids])
            self.start, self.length = np.concatenate([self.start, begin]), np.concatenate([self.length, lengths])
        slot = slot[word]
        lengths = self.length[slot]
        stop = np.cumsum(lengths)
        flat = self.ids[np.repeat(self.start[slot] - (stop - lengths), lengths) + np.arange(stop[-1])]
        bound = np.concatenate([[0], stop])[np.searchsorted(start, offsets)]
        return [flat[a:b] for a, b in zip(bound[:-1], bound[1:])]
