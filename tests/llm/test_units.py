"""Parts of the operators that need no Spark, against brute force."""

import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lakemill.llm import features, induced, packing, suffix_dedup
from lakemill.llm.minhash import Circulant, Shingler
from lakemill.llm.tokens import Encoder


def brute_suffixes(text, cap):
    t = text.tolist()
    order = sorted(range(len(t)), key=lambda i: t[i:])
    shared = [0]
    for a, b in zip(order, order[1:]):
        n = 0
        while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
            n += 1
        shared.append(min(n, cap))
    return order, shared


@pytest.mark.parametrize("base", [1, 4, 1000])
@pytest.mark.parametrize("memory", [200, 1 << 20])
def test_suffix_and_common_prefix_arrays(base, memory):
    """Recursion down to one name, queues that go to disk, and the in-memory base all give the same."""
    r = random.Random(base * memory)
    for _ in range(300):
        t = [r.randint(1, r.choice([1, 2, 3, 26])) for _ in range(r.randint(0, 100))]
        if len(t) > 10:
            i = r.randrange(len(t) // 2)
            t += t[i : i + r.randint(3, 40)]
        text = np.array([*t, 0], r.choice([np.uint16, np.int64]))
        order, shared = induced.suffix_array(text, 10**6, memory=memory, base=base)
        assert (list(order), list(shared)) == brute_suffixes(text, 10**6)


@pytest.mark.parametrize(("block", "lane"), [(5, 2), (1 << 15, 1 << 13)])
def test_large_alphabets_and_small_blocks(monkeypatch, block, lane):
    """Recursion works on as many characters as there are names; batches, lanes and sorted runs end anywhere."""
    monkeypatch.setattr(induced, "BLOCK", block)
    monkeypatch.setattr(induced, "LANE", lane)
    r = random.Random(lane)
    for alphabet in (3, 100, 500):
        for _ in range(12):
            t = [r.randint(1, alphabet) for _ in range(r.randint(30, 400))]
            for _ in range(5):
                i, j = r.randrange(len(t)), r.randrange(len(t))
                t[j:j] = t[i : i + r.randint(5, 80)]
            text = np.array([*t, 0], np.int64)
            for cap in (12, 10**6):
                _, want = induced.in_memory(text, cap)
                order, shared = induced.suffix_array(text, cap, memory=r.choice([300, 1 << 20]), base=1)
                assert list(shared) == list(want)
                prefixes = [t[i : i + cap] for i in order]
                assert prefixes == sorted(prefixes)


def test_a_substring_that_ends_where_a_pass_does_is_told_from_a_longer_one():
    t = [130, 19, 150, 215, 222, 227, 69, 130, 19, 150, 215, 222, 227, 69, 60, 17, 281, 0]
    assert [list(x) for x in induced.suffix_array(np.array(t), 12, base=1)] == [list(x) for x in brute_suffixes(np.array(t), 12)]


def test_external_sorter():
    r = np.random.default_rng(4)
    for memory, n in ((100, 3000), (1 << 20, 3000), (100, 0)):
        rows = r.integers(0, 50, (n, 2))
        sorter = induced.Sorter(memory)
        for at in range(0, n, 37):
            sorter.push(rows[at : at + 37])
        got = np.concatenate([np.empty((0, 2), np.int64), *sorter.blocks()])
        assert (np.diff(got[:, 0]) >= 0).all() and Counter(map(tuple, got.tolist())) == Counter(map(tuple, rows.tolist()))


PEAK = """
import json, re, threading, time
import numpy as np
from lakemill.llm import induced, suffix_dedup
r = np.random.default_rng(1)
words = [r.integers(97, 123, r.integers(2, 9), dtype=np.uint8).tobytes() for _ in range(3000)]
anonymous = lambda: sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
peak, shard, repeated = [0], suffix_dedup.Shard(), b" ".join(words[i] for i in r.integers(0, 3000, 400))
for k in range(40):
    own = b" ".join(words[i] for i in r.integers(0, 3000, 16_000))
    shard.add([(f"{k:032d}", own + (repeated if k % 20 == 0 else b""), 1)])
start = anonymous()
threading.Thread(target=lambda: [(peak.append(anonymous()), time.sleep(0.02)) for _ in iter(int, 1)], daemon=True).start()
found = [(int(k), s) for k, s in shard.found(memory=1 << 20) if s]
print(json.dumps([shard.size, max(peak) - start, induced.seen["spills"], induced.seen["depth"], [k for k, _ in found], len(repeated), [s[1] - s[0] for _, s in found]]))
"""


def test_a_shard_far_larger_than_memory():
    """4 MB of text, whose arrays take 100 times as much, sorted with 1 MB for each of queues, sorts and arrays."""
    import subprocess
    import sys
    from pathlib import Path

    done = subprocess.run([sys.executable, "-c", PEAK], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    size, peak, spills, depth, holders, length, runs = json.loads(done.stdout)
    assert size > 3_500_000 and spills >= 10 and depth >= 2
    assert peak < 40  # MB: blocks of work, beside what is given
    assert holders == [0, 20] and all(abs(n - (length - 199)) <= 1 for n in runs)


def test_capped_prefixes_find_every_repeat():
    r = random.Random(3)
    for _ in range(300):
        t = [r.randint(2, 4) for _ in range(r.randint(20, 200))]
        part = t[5 : 5 + r.randint(5, 40)]
        for _ in range(3):
            t += [r.randint(2, 4) for _ in range(r.randint(0, 9))] + part + [1] * r.randint(0, 1)
        text, cap = np.array([*t, 0], np.uint16), r.choice([6, 12, 20])
        order, shared = induced.suffix_array(text, cap, memory=1000, base=r.choice([1, 8, 1000]))
        seen = Counter(tuple(t[i : i + cap]) for i in range(len(t) - cap + 1))
        hit = {int(order[k + d]) for k in np.flatnonzero(shared >= cap) for d in (0, -1)}
        assert hit == {i for i in range(len(t) - cap + 1) if seen[tuple(t[i : i + cap])] > 1}


def brute_removed(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def test_equal_strings_have_equal_keys():
    r = np.random.default_rng(1)
    a = r.integers(0, 256, 5000, dtype=np.uint8)
    b = np.concatenate((r.integers(0, 256, 777, dtype=np.uint8), a[1000:2000], r.integers(0, 256, 99, dtype=np.uint8)))
    for gram in (32, 96):

        def keys(x, gram=gram):
            out = np.empty(len(x) - 199, np.int64)
            for lo, hi, k, _ in zip(*suffix_dedup.runs(x, gram)):
                out[lo:hi] = k
            return out

        assert (keys(a)[1000:1801] == keys(b)[777:1578]).all()
        assert keys(a[300:700])[0] == keys(a)[300]


def test_hot_keys_are_cut_again_without_losing_starts():
    r = np.random.default_rng(2)
    text = r.integers(97, 101, 900, dtype=np.uint8).tobytes() * 2
    data = np.frombuffer(text, np.uint8)
    keys = {k: True for k in suffix_dedup.runs(data, suffix_dedup.GRAM)[2].tolist()}
    starts = [lo + i for _, lo, x, _ in suffix_dedup.items_of(text, keys) for i in range(len(x) - 199)]
    assert sorted(starts) == list(range(len(text) - 199))


def test_repeats_within_and_between_items():
    r = random.Random(5)
    word = lambda n: bytes(r.choice(b"ab") for _ in range(n))
    shared = word(260)
    items = [word(220) + shared, shared + word(210), word(400), b"z" * 300]
    got = suffix_dedup.repeats(items, [1, 1, 1, 1])
    for x, spans, gone in zip(items, got, brute_removed(items)):
        mask = np.zeros(len(x), bool)
        for lo, hi in suffix_dedup.merged(spans):
            mask[lo:hi] = True
        assert (mask == gone).all()
    assert suffix_dedup.repeats([word(230)], [2]) == [[0, 31]]


def test_encoder_gives_the_ids_of_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library, r = Encoder(path), Tokenizer.from_file(path), random.Random(3)
    assert encoder.words
    parts = [*"aAbBéÉêΣσςİıßK '<|>.,!?\n\t\x0b\x1c\x85\xa0́漢1٣½—😀÷×À_", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "the", "THE", "***", " "]
    texts = ["", " \n"] + ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    for text, ids in zip(texts, encoder.ids(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_encoder_with_a_cache_that_overflows():
    """Words that find no room are encoded again; long words, and slices of several rows, give the library's ids too."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library, r = Encoder(path, 64, 256), Tokenizer.from_file(path), random.Random(8)
    texts = [" ".join(r.choice(["the", "of", "Été,", "x1", "***"]) + str(r.randint(0, k)) for _ in range(r.randint(0, 40))) for k in range(200)] + ["x" * 9000 + " y", "Z" * 300_000 + " end. " * 60_000]
    for text, ids in zip(texts, encoder.ids(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_words_of_slices():
    """Words end at white space and where a text ends; equal words have equal hashes wherever they stand."""
    import pyarrow as pa

    from lakemill.llm import words

    r = random.Random(2)
    texts = ["", " ", "a", "b", "", "é\tB\n"] + [" ".join(r.choice(["Ab", "ab", "c", "y" * 5000, "é", "x\x00", "x"]) for _ in range(r.randint(0, 60))) for _ in range(150)] + ["q " * 200_000]
    known, n = {}, 0
    for data, offsets in words.slices(pa.array(texts)):
        start, end, hashes, first = words.words(data, offsets)
        raw = data.tobytes()
        for a, b in zip(first[:-1], first[1:]):
            mine = [raw[i:j].lower() for i, j in zip(start[a:b], end[a:b])]
            assert mine == texts[n].encode().lower().split()
            for w, h in zip(mine, hashes[a:b].tolist()):
                assert known.setdefault(w, h) == h
            n += 1
    assert n == len(texts) and len(set(known.values())) == len(known)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_encoder_of_other_files(name):
    encoder = Encoder(public_tokenizers.path(name))
    assert not encoder.words and len(encoder.ids(["Hello there, world"])[0]) >= 3


def test_shortest_pack_first():
    r = random.Random(4)
    for _ in range(50):
        size = r.choice([16, 64, 2048])
        lengths = Counter(r.randint(1, size) for _ in range(r.randint(0, 300)))
        patterns = packing.shortest_pack_first(dict(lengths), size)
        assert all(sum(x * k for x, k in p) <= size and [x for x, _ in p] == sorted({x for x, _ in p}, reverse=True) for _, p in patterns)
        placed = Counter()
        for n, p in patterns:
            for x, k in p:
                placed[x] += n * k
        assert placed == lengths
        ranks = Counter()
        for length, lo, hi, _, _, _ in packing.slots(patterns):
            assert lo == ranks[length]
            ranks[length] = hi
        assert ranks == lengths


def one_by_one(lengths, size):
    """The method word for word: each piece, longest first, goes to the pack with the most room that it fits in."""
    packs = []
    for x in sorted(lengths, reverse=True):
        room = max((size - sum(p) for p in packs), default=0)
        if room >= x:
            next(p for p in packs if size - sum(p) == room).append(x)
        else:
            packs.append([x])
    return packs


def test_packs_are_those_of_one_piece_at_a_time():
    r = random.Random(6)
    for _ in range(60):
        lengths = [r.choice([r.randint(1, 64), 7, 30]) for _ in range(r.randint(1, 120))]
        got = packing.shortest_pack_first(dict(Counter(lengths)), 64)
        assert sum(n for n, _ in got) == len(one_by_one(lengths, 64))


@pytest.mark.parametrize("lengths", [{7: 2000}, {1: 5000}, {2048: 500, 300: 200, 50: 1000}, {1025: 3, 500: 900, 3: 10_000}])
def test_short_documents_leave_little_padding(lengths):
    patterns = packing.shortest_pack_first(lengths)
    packs, ids = sum(n for n, _ in patterns), sum(x * n for x, n in lengths.items())
    assert 1 - ids / (packs * 2048) < 0.05 or packs - ids / 2048 < len(lengths)
    if len(lengths) == 1:  # every sequence but the last is full
        (x,) = lengths
        assert sum(n for n, p in patterns if sum(a * k for a, k in p) + x <= 2048) <= 1


def test_pack_uses_the_shortest_pack_that_has_room():
    assert sorted(packing.shortest_pack_first({9: 1, 7: 1, 2: 1}, 10)) == [(1, ((7, 1), (2, 1))), (1, ((9, 1),))]


def test_circulant_signatures_estimate_jaccard():
    circulant, r = Circulant(), np.random.default_rng(1)
    for j in (0.5, 0.75, 0.9):
        estimates, met = [], 0
        for _ in range(60):
            a = r.integers(0, 2**63, 400, dtype=np.uint64)
            n = round(800 * j / (1 + j))
            b = np.concatenate((a[:n], r.integers(0, 2**63, 400 - n, dtype=np.uint64)))
            estimates.append((circulant.signature(a) == circulant.signature(b)).mean())
            met += bool((circulant(a) == circulant(b)).any())
        assert abs(np.mean(estimates) - j) < 0.02
        assert j < 0.75 or met == 60


def test_shingles():
    s = Shingler()
    words = [f"w{i}" for i in range(30)] * 2
    assert len(s(" ".join(words))) == len({tuple(words[i : i + 5]) for i in range(56)})
    assert len(s("")) == len(s(" \n ")) == len(s(None)) == 0
    assert list(s("A b")) == list(s("a\tB")) and len(s("a b")) == 1 and list(s("a b")) != list(s("a b c"))


def test_features_of_odd_texts():
    for f in (features.letters, features.style):
        assert f(None).sum() == f("").sum() == 0 and f("x" * 3_000_000).sum() > 0
