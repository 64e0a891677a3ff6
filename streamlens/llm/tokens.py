"""Token ids by a public tokenizer, looked up word by word (helper that runs inside tasks)."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

from streamlens.llm.kernels import CACHES

WORD_BPE = "word_bpe_49k.json"
#: Words a worker remembers.
CACHE_WORDS = 1_200_000
#: ASCII punctuation but the apostrophe, which opens patterns of its own.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_MARK_SET = frozenset(_MARKS)


def _forget() -> None:
    word_ids.cache_clear()


CACHES.append(_forget)


def vocabulary_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of texts by a tokenizer that lower-cases, drops white space and never joins words.

    Such a tokenizer maps a text to the ids of its words in order, so each word between white space is encoded once per
    worker. Texts with the opening of a special token are left whole to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.size = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _add(self, words: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        """Remember words whose ids stand one after the other."""
        k, n, more = len(self.at), len(words), len(ids)
        while k + n > len(self.size):
            self.size, self.start = np.resize(self.size, 2 * len(self.size)), np.resize(self.start, 2 * len(self.size))
        while self.used + more > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.at.update(zip(words, range(k, k + n)))
        self.size[k : k + n] = size
        self.start[k : k + n] = self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + more] = ids
        self.used += more

    def _learn(self, missing: set[bytes]) -> None:
        """Encode words not seen before. Plain words of letters are encoded many at a time: each is one run, and only its
        last id ends a word. Letters followed by punctuation are the ids of both parts, as the pattern splits them there."""
        at = self.at
        ended = [(w, s) for w, s in ((w, w.rstrip(_MARKS)) for w in missing if w[-1] in _MARK_SET) if s and 97 <= s[-1] <= 122]
        plain = missing.difference([w for w, _ in ended])
        plain.update([s for _, s in ended if s not in at], {w[len(s):] for w, s in ended}.difference(at))
        ascii_ = [w for w in plain if w.isalpha()]  # of bytes: a-z only
        single = []
        if len(ascii_) < len(plain):
            for w in plain.difference(ascii_):
                t = w.decode("utf-8", "replace")
                if t.isalpha() and t == t.lower() and max(t) < "\u0250":
                    ascii_.append(w)
                else:
                    single.append((w, t))
        for lo in range(0, len(ascii_), 2000):
            some = ascii_[lo : lo + 2000]
            (found,) = self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            edge = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
            if len(edge) == len(some) + 1:
                self._add(some, ids, np.diff(edge))
            else:
                single += [(w, w.decode()) for w in some]
        if single:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t for _, t in single], add_special_tokens=False)]
            self._add([w for w, _ in single], np.array(list(chain.from_iterable(found)), np.uint32), np.array([len(x) for x in found]))
        if ended:
            pair = np.array([[at[s], at[w[len(s):]]] for w, s in ended]).ravel()
            size = self.size[pair].astype(np.int64)
            self._add([w for w, _ in ended], self._ids(pair, size), size.reshape(-1, 2).sum(axis=1))

    def _ids(self, words: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of words, one after the other."""
        upto = np.cumsum(size)
        return self.pool[np.repeat(self.start[words] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        split = [t.lower().split() for t in texts]
        count = np.array([len(s) for s in split], np.int64)
        flat = list(chain.from_iterable(split))
        if len(self.at) > CACHE_WORDS:
            self.reset()
        missing = set(flat).difference(self.at)
        if missing:
            self._learn(missing)
        return np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat)), count

    def _whole(self, texts: list[bytes]) -> dict[int, list[int]]:
        return {k: self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for k, t in enumerate(texts) if b"<|" in t}

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Ids of each text."""
        odd = self._whole(texts)
        word, count = self._words([b"" if k in odd else t for k, t in enumerate(texts)])
        upto = np.concatenate([[0], np.cumsum(self.size[word])])
        edge = np.concatenate([[0], np.cumsum(count)])
        n = np.diff(upto[edge])
        for k, ids in odd.items():
            n[k] = len(ids)
        return n

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, ids of each text), every text followed by the id ``end``."""
        odd = self._whole(texts)
        word, count = self._words([b"" if k in odd else t for k, t in enumerate(texts)])
        size = self.size[word].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self._ids(word, size)
        edge = upto[np.concatenate([[0], np.cumsum(count)])]
        if odd:
            parts = [np.array(odd[k], np.uint32) if k in odd else ids[edge[k] : edge[k + 1]] for k in range(len(texts))]
            ids = np.concatenate(parts).astype(np.uint32)
            edge = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        n = np.diff(edge)
        out = np.full(len(ids) + len(texts), end, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), n)] = ids
        return out, n + 1


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordIds(path)


def chunks(column, size: int = 1 << 21):
    """Lists of texts (bytes; null is empty) of an Arrow binary column, about ``size`` bytes each, with their first row."""
    held, bytes_held, first = [], 0, 0
    for k, v in enumerate(column):
        t = v.as_py() or b""
        if held and bytes_held + len(t) > size:
            yield first, held
            held, bytes_held, first = [], 0, k
        held.append(t)
        bytes_held += len(t)
    if held:
        yield first, held
