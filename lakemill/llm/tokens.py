"""Token ids of whole texts, exactly as the tokenizers or sentencepiece library gives them, with a bounded word cache.

For the word tokenizer of word_bpe_49k.json a text is cut at ASCII white space first: its normalizer and its pattern
never join anything across white space, so the ids of a text are those of its words in turn. Words are encoded by the
library once and then looked up by their 64-bit hash. ``check_words`` decides from the file whether that cut is allowed;
any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import types
from collections.abc import Iterator

import numpy as np

from .words import EXACT, LOWER, slices, words

#: Places of the word cache, a power of two (14 bytes each); it starts anew when half of them are taken.
PLACES = 1 << 20
#: Ids that the cache holds, four bytes each.
STORED = 1 << 21
#: Words encoded in one text.
JOINED = 256
TRAILING = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: Words that are one run of letters, which nothing normalizes away.
LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")


def version(path: str) -> str:
    """Digest of the tokenizer file: part of the key of every cached count."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def check_words(path: str) -> bool:
    """Whether this file's pipeline treats each white-space separated word by itself and lower-cases."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    kinds = [n.get("type") for n in (j.get("normalizer") or {}).get("normalizers", [])]
    pre = (j.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    pattern = (pre[0].get("pattern") or {}).get("Regex", "")
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not set(t["content"]) & set(" \t\n\r\x0b\x0c") for t in j.get("added_tokens", []))
    return kinds == ["NFC", "Replace", "Lowercase"] and pre[0].get("type") == "Split" and pre[0].get("invert") and r"[^\s\p{L}\p{N}]+" in pattern and r"\s*" not in pattern and r"\s+" not in pattern and plain


class Cache:
    """64-bit word hash -> ids, in open addressing over plain arrays."""

    def __init__(self, places: int = PLACES, stored: int = STORED) -> None:
        self.mask = places - 1
        self.key, self.begin, self.count = np.zeros(places, np.uint64), np.zeros(places, np.uint32), np.zeros(places, np.uint16)
        self.ids, self.words, self.used = np.zeros(stored, np.uint32), 0, 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, or of the first free place after where it should be."""
        place = (hashes & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            key = self.key[place[left]]
            left = left[(key != hashes[left]) & (key != 0)]
            place[left] = (place[left] + 1) & self.mask
        return place

    def add(self, hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bool:
        """Distinct new hashes; False if there is no room."""
        if self.words + len(hashes) > len(self.key) // 2 or self.used + len(ids) > len(self.ids) or counts.max(initial=0) > 65535:
            return False
        left = np.arange(len(hashes))
        where = self.find(hashes)
        while len(left):  # of several that want one place the last gets it
            self.key[where[left]] = hashes[left]
            left = left[self.key[where[left]] != hashes[left]]
            where[left] = self.find(hashes[left])
        self.begin[where] = self.used + np.cumsum(counts) - counts
        self.count[where] = counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.words += len(hashes)
        self.used += len(ids)
        return True

    def clear(self) -> None:
        self.key[:] = 0
        self.words = self.used = 0


class Encoder:
    """Ids of the texts of a column, a slice of rows at a time."""

    def __init__(self, path: str, places: int = PLACES, stored: int = STORED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.words = check_words(path)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.batch = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.batch = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            if self.words:
                vocabulary = model.get_vocab()
                self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
                self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
                self.cache, self.tails = Cache(places, stored), {}

    def slices(self, column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, where each text's ids begin in them and the last ones end) of consecutive rows of an Arrow string column."""
        for data, offsets in slices(column):
            if not self.words:
                each = self.batch([bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                yield np.array([i for ids in each for i in ids], np.uint32), np.concatenate(([0], np.cumsum([len(ids) for ids in each]))).astype(np.int64)
            elif len(offsets) > 2 and b"<|" in data.tobytes():  # special strings are matched in their own case only
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    yield self.of_words(data[a:b], np.array([0, b - a]))
            else:
                yield self.of_words(data, offsets)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        import pyarrow as pa

        return [ids[a:b] for ids, at in self.slices(pa.array(texts, pa.large_string())) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def of_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        exact = b"<|" in raw
        start, end, hashes, first = words(data, offsets, EXACT if exact else LOWER)
        raw, hashes = raw if exact else raw.lower(), np.maximum(hashes, np.uint64(1))
        cache = self.cache
        place = cache.find(hashes)
        missing = np.flatnonzero(cache.key[place] != hashes)
        if len(missing):
            new = self.learn(raw, start, end, hashes, missing)
            if not cache.add(*new):
                cache.clear()
                _, which = np.unique(hashes, return_index=True)
                new = self.learn(raw, start, end, hashes, which)
                if not cache.add(*new):  # more words than the cache holds: sorted, for this slice alone
                    return gathered(new[2], np.cumsum(new[1]) - new[1], new[1], np.searchsorted(new[0], hashes), first)
            place = cache.find(hashes)
        return gathered(cache.ids, cache.begin, cache.count, place, first)

    def learn(self, raw: bytes, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, counts, ids) of the distinct words among the missing, by hash. Punctuation that follows a letter or digit
        is a piece of its own, so the two are encoded apart."""
        new, at = np.unique(hashes[missing], return_index=True)
        at = missing[at]
        bodies, tails = [], []
        for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True):
            w = raw[a:b]
            body = w.rstrip(TRAILING)
            cut = len(body) if body and len(body) < len(w) and b"<|" not in w and (body[-1] in ALNUM or letter(body)) else len(w)
            bodies.append(w[:cut].decode("utf-8", "replace"))
            tails.append(w[cut:])
        ids = self.each(bodies)
        if len(self.tails) > 10_000:
            self.tails.clear()
        unknown = [t for t in set(tails) if t and t not in self.tails]
        self.tails.update(zip(unknown, self.batch([t.decode() for t in unknown]), strict=True))
        ids = [i + self.tails[t] if t else i for i, t in zip(ids, tails, strict=True)]
        return new, np.array([len(i) for i in ids], np.int64), np.array([i for each in ids for i in each], np.uint32)

    def each(self, texts: list[str]) -> list[list[int]]:
        """A run of letters is one pre-token and its last id ends a word, so many such words fit in one text."""
        out: list[list[int] | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if LETTERS.fullmatch(t)]
        groups = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        for which, ids in zip(groups, self.batch([" ".join([texts[i] for i in g]) for g in groups]), strict=True):
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(which) and cuts[-1] == len(ids):
                at = 0
                for i, cut in zip(which, cuts, strict=True):
                    out[i], at = ids[at:cut], cut
        alone = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(alone, self.batch([texts[i] for i in alone]), strict=True):
            out[i] = ids
        return out


def gathered(ids: np.ndarray, begin: np.ndarray, count: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words in turn, and where those of each text begin. first: where each text's words begin."""
    n = count[place].astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(n)))
    return ids[np.repeat(begin[place].astype(np.int64) - ends[:-1], n) + np.arange(ends[-1])], ends[first]


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file. Workers run many tasks, and each task gets this module anew, so the encoder and its
    cache are kept in a module of the worker's own."""
    state = sys.modules.setdefault("lakemill_worker", types.ModuleType("lakemill_worker")).__dict__
    if path not in state:
        state[path] = Encoder(path)
    return state[path]


def letter(body: bytes) -> bool:
    """Ends in a two-byte Latin-1 letter."""
    return len(body) >= 2 and body[-2] == 0xC3 and 0x80 <= body[-1] <= 0xBF and body[-1] not in (0x97, 0xB7)
