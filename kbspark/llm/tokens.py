"""Tokenizing whole texts with a public tokenizer, a word cache in front.

The tokenizer drops white space before it splits a text into words, so the ids
of a text are the ids of its white-space-separated chunks in a row. Chunks
repeat far more often than texts do; each worker keeps the ids of the chunks it
has met (a bounded number) and asks the library only for new ones. Texts with
something that could reach across chunks (special-token strings, separators on
which Python and the library disagree) go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np

from kbspark.llm.common import worker_state

#: Chunks that a worker remembers, and as many older ones; about 200 MB in all.
CACHE_CHUNKS = 700_000
_WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")


def _nulls(parts: list) -> list[int]:
    """Where ``parts`` has None; list.index is far quicker than a loop over all."""
    at, k = [], -1
    try:
        while True:
            at.append(k := parts.index(None, k + 1))
    except ValueError:
        return at


class ChunkTokenizer:
    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # ours stands before it; its own would only be filled and missed
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_chunks = cache_chunks
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.ends = None  # by id: whether the token ends a word, if the vocabulary tells
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            vocab = self.tokenizer.get_vocab(with_added_tokens=False)
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def _pack(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _ask(self, chunks: list[str]) -> None:
        """Have the library encode ``chunks``: words of letters alone many to a
        text, as each is one word to the tokenizer, the others one by one."""
        words = [c for c in chunks if c.isalpha()] if self.ends is not None else []
        many = [words[i : i + 200] for i in range(0, len(words), 200)]
        for some, e in zip(many, self.tokenizer.encode_batch_fast([" ".join(x) for x in many], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            last = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            if len(last) == len(some):
                packed = ids.tobytes()
                self.cache.update(zip(some, (packed[a:b] for a, b in zip([0, *last], last))))
        rest = [c for c in chunks if c not in self.cache]
        self.cache.update(zip(rest, (self._pack(e.ids) for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))))

    def _learn(self, new: set[str]) -> None:
        """Look up chunks that aren't in the cache. A comma or full stop after a
        Latin letter is always a piece of its own, so the word before it is
        enough. (Normalising ends some other letters with a mark, which goes with
        the stop; so does lower case with a capital I with a dot.)"""
        cache, older = self.cache, self.older
        known = [c for c in new if c in older]
        cache.update((c, older[c]) for c in known)
        new = new.difference(known)
        cut = {c: c[:-1] for c in new if c[-1] in ",." and len(c) > 1 and c[-2].isalpha() and c[-2] < "\u0250" and c[-2] != "İ"}
        self._ask([c for c in {cut.get(c, c) for c in new}.union(",.") if c not in cache])
        cache.update((c, cache[word] + cache[c[-1]]) for c, word in cut.items())

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text, packed in ``self.dtype``; a null is empty."""
        out: list[bytes] = []
        for i in range(0, len(texts), 64):
            if len(self.cache) > self.cache_chunks:
                self.cache, self.older = {}, self.cache
            block: list[tuple[list[str], list[bytes | None]]] = []
            find, gaps = self.cache.get, []
            for text in texts[i : i + 64]:
                if text is None:
                    block.append(([], []))
                elif any(x in text for x in _WHOLE):
                    block.append(([], [self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)]))
                else:
                    words = (text.lower() if text.isascii() else text).split()
                    block.append((words, list(map(find, words))))
                gaps.append(_nulls(block[-1][1]))
            if new := {words[k] for (words, _), at in zip(block, gaps) for k in at}:
                self._learn(new)
            for (words, parts), at in zip(block, gaps):
                for k in at:
                    parts[k] = find(words[k])
                out.append(b"".join(parts))
        return out


def load(path: str) -> ChunkTokenizer:
    """The worker's tokenizer for ``path``, its cache kept between tasks."""
    return worker_state(f"tokens {path}", lambda: ChunkTokenizer(path))
