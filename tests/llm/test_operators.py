"""Each operator over a small table with awkward rows, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lakemill.llm import fingerprints, graph, language_id, minhash, mixing, packing, quality_classifier, quality_rules, suffix_dedup, token_counts, url_filter

from lakemill.llm.common import written

from ..conftest import SF

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Names that the operators use inside, as extra columns of the input.
EXTRA = ", 1 as n_words, 'x' as kept, 2 as node, 3 as bucket, 4 as length, 5 as start, 'y' as sha, 'z' as digest, 6 as rank, 'q' as score, 8 as copies, 9 as place"


@pytest.fixture(scope="module")
def docs(spark):
    prose = "the quick brown fox jumps over the lazy dog and runs into a very dark forest where nobody has ever been seen before today "
    rows = [
        (9001, None, "en", "s"), (9002, "", None, None), (9003, " \n\t ", "en", "s"), (9004, "one two", "de", "s"), (9005, "One\tTWO", "de", "s"), (9006, "12 34 !", "fr", None),
        (9007, prose * 40, "en", "big"), (9008, prose * 40, "en", "big"), (9008, prose * 40, "en", "big"), (None, "no id at all but some words " * 12, "en", "s"), (None, None, None, None),
        (9009, "é" * 500, "fr", "s"), (9010, "a " * 3000, "en", "s"), (9011, prose * 3 + "Ünïcödé " * 30 + prose, "es", "s"), (9012, "x\n" * 50 + prose, "en", "s"), (9013, prose * 2000, "en", "big"),
    ]
    extra = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    df = base.unionByName(extra).cache()
    return df.selectExpr("*", *EXTRA[2:].split(", "))


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def labels(spark):
    real = spark.read.parquet(f"{SF}/labels.parquet")
    return real.unionByName(spark.createDataFrame([(9004, None, None), (None, 1, 0), (77777, 0, 0), (9007, 5, 0)], real.schema))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def words_of(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def test_quality_rules(docs, rows, labels, empty):
    got = by_id(quality_rules.quality_rules(docs, labels))
    assert sum(map(len, got.values())) == len(rows)
    for i, text in rows:
        if i is None:
            continue
        w, r = words_of(text), got[i][0]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often, hit = Counter(grams), set()
        for k, g in enumerate(grams):
            if often[g] > 1:
                hit |= {k, k + 1, k + 2}
        lines = [x for x in (text or "").split("\n") if words_of(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty, labels).count() == 0
    assert quality_rules.quality_rules(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_exact_binomial_tail(spark):
    cases = [(0, 30), (0, 300), (3, 300), (5, 300), (6, 300), (10, 5000), (80, 5000), (100, 5000), (0, 0), (1, 1), (900, 50000), (1500, 100000)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", quality_rules.binomial_tail(df.k, df.n, 0.02).alias("p")).collect():
        want = 1.0 if r.k >= r.n * 0.02 else sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(0.02) + (r.n - j) * math.log(0.98)) for j in range(r.k + 1))
        assert r.p == pytest.approx(want, rel=1e-8)


def test_cutoffs_reject_bad_and_keep_good(spark):
    """400 good and 100 bad texts in one stratum; only what is proven safe is cut."""
    good = "all these ordinary words make up some quite normal prose text here number"
    data = [(i, " ".join(f"{w}{i * 7 + k}" for k, w in enumerate(good.split() * 6)), "en") for i in range(500)]
    data = [(i, t if i % 5 else t.replace(" ", "*** "), lang) for i, t, lang in data]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    truth = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(500)], "doc_id long, quality int")
    got = by_id(quality_rules.quality_rules(docs, truth))
    assert all(got[i][0].kept == (i % 5 > 0) for i in range(500))
    few = truth.where("doc_id < 50")
    assert quality_rules.quality_rules(docs, few).where("not kept").count() == 0


def shares(spark, n_good, each):
    """Features and labels: every rule alone meets ``each`` good documents, no two rules the same one, and 100 bad ones."""
    own = ["n_symbols", "n_repeat_words", "n_dup_lines", "__rule_capitals", "__rule_shouts"]
    rows = [(i, "en", False, 100, 100, 100, *(90 * (i // each == r) for r in range(5)), 1) for i in range(n_good)]
    rows += [(n_good + i, "en", False, 100, 100, 100, *(90 * (i // 100 == r) for r in range(5)), 0) for i in range(500)]
    known = spark.createDataFrame(rows, ["doc_id", "lang", "base_failed", "word_chars", "n_words", "__rule_lines", *own, "quality"])
    return known.drop("quality"), known.select("doc_id", "quality")


def test_all_rules_together_keep_the_limit(spark):
    """Each of five rules rejects 3 % of the good documents, which is proven for each, but 15 % together."""
    features, truth = shares(spark, 4000, 120)
    cuts = quality_rules.cutoffs(features, truth)
    out = quality_rules.judged(features, cuts).join(truth, "doc_id").where("quality = 1")
    assert 0 < out.where("not kept").count() <= 4000 * quality_rules.MAX_FALSE_REJECTION
    features, truth = shares(spark, 4000, 8)  # 1 % together: all five stay
    out = quality_rules.judged(features, quality_rules.cutoffs(features, truth))
    assert out.where("not kept").count() == 540


def test_quality_classifier(spark, docs, rows, labels, empty):
    got = quality_classifier.quality_classifier(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = quality_classifier.quality_classifier(big, truth).where("held_out").join(truth, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    assert quality_classifier.quality_classifier(empty, labels).count() == 0
    assert {r.score for r in quality_classifier.quality_classifier(docs, labels.limit(0)).collect()} == {0.5}


def test_votes_against_brute_force():
    r = np.random.default_rng(3)
    counts = r.poisson(0.05, (60, quality_classifier.fit.__globals__["np"].int64(4096))).astype(np.float32)
    labels = ["1" if i % 3 else "0" for i in range(60)]
    model = quality_classifier.fit(labels, counts)
    got = quality_classifier.votes(model, counts[:9], 5)
    x = quality_classifier.unit(quality_classifier.weighted(counts, model["idf"]) @ model["basis"])
    for i in range(9):
        near = sorted(((float(x[i] @ x[j]), j) for j in range(60)), reverse=True)[:5]
        weight = [max(s, 0) ** quality_classifier.POWER for s, _ in near]
        want = sum(w for w, (_, j) in zip(weight, near) if j % 3) / sum(weight)
        assert got[i] == pytest.approx(want, abs=1e-4)


def test_fingerprints(docs, rows, empty):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    # Rows with one id are ordered by a digest; here they are equal. Null ids come first, so the last row is followed by one.
    got = by_id(fingerprints.fingerprints(docs))
    assert sum(map(len, got.values())) == len(rows)

    def elements(text):
        return set(Counter(re.findall(fingerprints.PARAGRAPH, text)).items())

    def near(a, b):
        x, y = elements(a), elements(b)
        return 1 - len(x ^ y) / (len(x) + len(y)) if x or y else 1.0

    prints = {}
    for k, (i, text) in enumerate(order[:-1]):
        text, follow = text or "", order[k + 1][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        shas = {r.edited_sha256 for r in got[i]}
        assert hashlib.sha256(edited.encode()).hexdigest() in shas, i
        r = next(r for r in got[i] if r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest())
        assert r.n_chars == len(text)
        assert r.near_edited == pytest.approx(near(text, edited)) and r.near_next == pytest.approx(near(text, follow)), i
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert fingerprints.fingerprints(empty).count() == 0


def test_quality_scores_against_brute_force(spark, docs, labels, rows):
    """The whole query: sample, term counts, weights, singular vectors and votes in plain numpy over all rows at once."""
    from lakemill.llm import features

    got = {r.doc_id: r.score for r in quality_classifier.quality_classifier(docs, labels, per_label=40).collect()}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    known = {}
    for r in labels.collect():
        if r.quality in (0, 1) and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            known[r.doc_id] = r.quality
    order = {r.doc_id: r.d for r in labels.selectExpr("doc_id", "pmod(xxhash64(doc_id), 4503599627370496L) as d").collect()}
    sample = [i for label in (0, 1) for i in sorted((i for i, q in known.items() if q == label), key=order.__getitem__)[:40] if i in texts]

    def counts(text):
        data, out = list((text or "").encode()), np.zeros(features.TERMS, np.int64)
        kind = [int(features.KINDS[b]) for b in data]
        for n, salt, at in ((3, 5, 0), (2, 13, features.TERMS // 2)):
            for k in range(len(kind) - n + 1):
                h = salt
                for x in kind[k : k + n]:
                    h = (h * 0x01000193 + x + 1) % 2**32
                h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
                out[at + (h >> 32 - 11)] += 1
        grams = Counter(bytes(data[k : k + 16]) for k in range(len(data) - 15))
        lines = (text or "").split("\n")
        out[-2:] = sum(n - 1 for n in grams.values()), sum(map(len, lines)) - sum(map(len, set(lines)))
        return out

    ids = [i for i in texts if i is not None and (len(texts[i] or "") < 6000 or i in sample)]
    table = {i: counts(texts[i]) for i in ids}
    x = np.stack([table[i] for i in sample]).astype(float)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1

    def vector(c):
        v = np.sqrt(c / max(c.sum(), 1)) * idf
        return v / max(np.linalg.norm(v), 1e-12)

    x = np.stack([vector(c) for c in x])
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    basis = vt[: quality_classifier.DIMENSIONS][s[: quality_classifier.DIMENSIONS] ** 2 > 1e-6].T
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    latent = [(unit(v @ basis), known[i]) for v, i in zip(x, sample)]
    for i in ids:
        v = unit(vector(table[i].astype(float)) @ basis)
        near = sorted(((float(v @ w), q) for w, q in latent), reverse=True)[: quality_classifier.NEIGHBOURS]
        weight = [max(c, 0) ** quality_classifier.POWER for c, _ in near]
        want = sum(w * q for w, (_, q) in zip(weight, near)) / sum(weight) if sum(weight) else 0.5
        assert got[i] == pytest.approx(want, abs=0.02), i


def spark_hash(*values):
    """Spark's xxhash64: text as UTF-8, ("int", x) as four bytes, other numbers as eight."""
    import struct

    import xxhash

    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def element_set(text):
    return {(spark_hash(p), n) for p, n in Counter(re.findall(fingerprints.PARAGRAPH, text)).items()}


def sketch(elements, width):
    cells = {}
    for d, t in elements:
        for lane in range(fingerprints.LANES):
            at = lane, spark_hash(d, t, ("int", lane)) % width
            n, a, b, c = cells.get(at, (0, 0, 0, 0))
            cells[at] = (n + 1, a ^ d, b ^ t, c ^ spark_hash(d, t, ("int", -1)))
    return cells


def printed_sketch(elements):
    digits = lambda x: f"{x & (1 << 64) - 1:X}"
    return ".".join(":".join((f"{lane * fingerprints.CELLS + at:X}", digits(n), digits(a), digits(b), digits(c)[:8])) for (lane, at), (n, a, b, c) in sorted(sketch(elements, fingerprints.CELLS).items()))


def test_buckets_are_ranges_of_ids(spark, docs, monkeypatch):
    """Many small buckets give what one gives; null ids come first, a hot id is parted by the digests of its texts."""
    want = sorted(map(str, fingerprints.fingerprints(docs).collect()))
    monkeypatch.setattr(fingerprints, "BUCKET", 7)
    assert sorted(map(str, fingerprints.fingerprints(docs).collect())) == want
    hot = spark.range(300).selectExpr("if(id < 200, 5L, id) as doc_id", "concat('text ', id) as text")
    keyed = hot.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("digest")))
    got = fingerprints.bucketed(keyed).groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("bucket").collect()
    assert len(got) > 20 and max(r.n for r in got) < 30 and all(a.hi < b.lo for a, b in zip(got, got[1:]))


def test_fingerprints_are_the_sketches_and_digests_are_recovered(docs, rows):
    order = sorted((r for r in rows if r[0] is not None and r[0] != 9008), key=lambda r: r[0])
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs.where("doc_id <> 9008")).collect()}
    for (i, text), (_, follow) in zip(order, order[1:]):
        text, follow = text or "", follow or ""
        half = len(text) // 2
        own, edited = element_set(text), element_set(text[: len(text) - half] + follow[:half])
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (printed_sketch(own), printed_sketch(edited)), i
        assert got[i].only_own == sorted(d for d, _ in own - edited) and got[i].only_edited == sorted(d for d, _ in edited - own), i


def test_wide_sketches_fold_into_narrow_ones(spark):
    r = np.random.default_rng(3)
    elements = {(int(d), int(t)) for d, t in zip(r.integers(-(2**62), 2**62, 300), r.integers(1, 4, 300))}
    df = spark.createDataFrame([(1, w, list(elements)) for w in (4, 64, 256)], "v long, width long, elements array<struct<d: long, t: long>>")
    cells = fingerprints.sketches(df, "v")
    for w in (4, 64, 256):
        mine = {(c["at"] >> fingerprints.LANE, c["at"] & (1 << fingerprints.LANE) - 1): (c["count"], c["keys"], c["times"], c["checks"]) for c in cells.where(f"width = {w}").collect()}
        assert mine == sketch(elements, w)
    low = fingerprints.summed(cells.withColumn("at", fingerprints.folded(F.col("at"), 4)), "width", "at")
    assert len({frozenset((c["at"], c["count"], c["keys"], c["times"], c["checks"]) for c in low.where(f"width = {w}").collect()) for w in (4, 64, 256)}) == 1


@pytest.mark.parametrize("space", [0.02, 8.0])
def test_a_sketch_that_cannot_be_peeled_is_tried_larger(spark, monkeypatch, space):
    """Pairs with few differences are peeled from their fingerprints; with too narrow a rung the others double until it works."""
    monkeypatch.setattr(fingerprints, "SPACE", space)
    tries, peel = [], fingerprints.peeled

    def counted(pairs, first):
        tries.append(pairs.select("width").distinct().collect())
        return peel(pairs, first)

    monkeypatch.setattr(fingerprints, "peeled", counted)
    pair = lambda n, k, shift: ([(1000 + i, 1) for i in range(n)], [(1000 + i + (shift if i < k else 0), 1) for i in range(n)])
    cases = [pair(400, 0, 0), pair(400, 1, 10**6), pair(400, 150, 10**6), ([], []), ([(5, 2)], [(5, 3)]), pair(60, 60, 10**6), ([], [(i, 1) for i in range(90)])]
    df = spark.createDataFrame([(i, a, b, b) for i, (a, b) in enumerate(cases)], "row long, own array<struct<d: long, t: long>>, edited array<struct<d: long, t: long>>, next array<struct<d: long, t: long>>")
    done, prints = fingerprints.compared(written(df, "test_pairs"))
    got = {(r["row"], r["kind"]): r for r in done.collect()}
    for i, (a, b) in enumerate(cases):
        for kind in (0, 1):
            r = got.get((i, kind))
            want = (len(set(a) - set(b)), len(set(b) - set(a)))
            assert (want if r is not None else (0, 0)) == want and (r is None or (r.only_own, r.only_other) == want)
        if r is not None:
            r = got[(i, 0)]
            assert sorted(r.own_digests) == sorted(d for d, _ in set(a) - set(b)) and sorted(r.other_digests) == sorted(d for d, _ in set(b) - set(a))
    assert len(tries) >= 4 if space < 1 else len(tries) == 1
    assert {r["row"]: (r.own_print, r.other_print) for r in prints.collect()} == {i: (printed_sketch(a), printed_sketch(b)) for i, (a, b) in enumerate(cases) if a or b}


def some_pairs(spark, n):
    """Pairs of 40 elements each, of which 15 differ."""
    side = lambda i, k: [(1000 * i + j + (10**6 if j < k else 0), 1) for j in range(40)]
    rows = [(i, side(i, 0), side(i, 15), side(i, 15)) for i in range(n)]
    return spark.createDataFrame(rows, "row long, own array<struct<d: long, t: long>>, edited array<struct<d: long, t: long>>, next array<struct<d: long, t: long>>")


def test_a_further_try_reads_only_the_pairs_that_failed(spark, monkeypatch):
    """What is tried again has been written apart; a few elements are one task's, and dealt by no exchange."""
    monkeypatch.setattr(fingerprints, "SPACE", 0.02)
    tries, peel = [], fingerprints.peeled

    def seen(pairs, first):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        tries.append((pairs.count(), {p.split("/")[-2].split("-")[0] for p in pairs.inputFiles()}, pairs.rdd.getNumPartitions(), "Exchange" in plan))
        return peel(pairs, first)

    monkeypatch.setattr(fingerprints, "peeled", seen)
    done, _ = fingerprints.compared(written(some_pairs(spark, 30), "test_pairs"))
    assert sorted((r["row"], r["kind"], r["only_own"], r["only_other"]) for r in done.collect()) == [(i, k, 15, 15) for i in range(30) for k in (0, 1)]
    assert tries[0][0] == 60 and len(tries) > 1 and all(a[0] >= b[0] for a, b in zip(tries, tries[1:]))
    assert all(t[1:] == ({"again"}, 1, False) for t in tries[1:])
    monkeypatch.setattr(fingerprints, "PART", 10)  # too many for one task: dealt as before, with the same result
    tries.clear()
    again, _ = fingerprints.compared(written(some_pairs(spark, 30), "test_pairs"))
    assert sorted(map(str, again.collect())) == sorted(map(str, done.collect())) and all(t[3] for t in tries)


def test_a_peel_holds_few_pages_at_a_time(spark):
    """The maps of all rounds are not there at once; the caller's setting is as it was."""
    import threading
    import time

    setting, manager = "spark.sql.codegen.aggregate.map.twolevel.enabled", spark._jvm.org.apache.spark.SparkEnv.get().memoryManager()
    rows, over, most = written(some_pairs(spark, 2000).coalesce(1), "test_pairs"), threading.Event(), [0]

    def watch():
        while not over.is_set():
            most[0] = max(most[0], manager.executionMemoryUsed())
            time.sleep(0.002)

    before, shuffled = spark.conf.get(setting), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        fingerprints.compared(rows)
    finally:
        over.set()
        watcher.join()
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
    assert spark.conf.get(setting) == before
    assert 0 < most[0] < 8 * manager.pageSizeBytes(), most[0] / manager.pageSizeBytes()


def test_a_single_document_follows_itself(docs):
    r = fingerprints.fingerprints(docs.where("doc_id = 9011")).first()
    assert r.near_next == 1.0


def test_suffix_dedup(docs, rows, empty):
    from .test_units import brute_removed

    got = by_id(suffix_dedup.suffix_dedup(docs))
    assert sum(map(len, got.values())) == len(rows)
    texts = [(t or "").encode() for _, t in rows]
    removed = brute_removed(texts)
    for (i, _), t, gone in zip(rows, texts, removed):
        edges = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()
        assert (len(t), int(gone.sum()), edges, kept) in {(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got[i]}, i
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    by = by_id(out)
    for (i, _), t, gone in zip(rows, texts, removed):
        if i is not None:
            assert (by[i][0].text or "") == np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")


def test_a_short_passage_in_many_texts_does_not_fill_a_shard(spark, monkeypatch):
    """150 equal bytes in 4000 texts, each with its own text around them; some share more, one is a run of one letter."""
    mark = hashlib.sha512(b"passage").hexdigest()[:125] + "the end of this passage.."
    own = lambda i, side: hashlib.sha512(f"{side}{i}".encode()).hexdigest() * 2
    texts = [own(i, "a")[:180] + mark + own(i if i >= 40 else i % 20, "b")[:180] for i in range(4000)] + ["z" * 900, "y" * 230]
    monkeypatch.setattr(suffix_dedup, "SHARD", 1 << 16)
    monkeypatch.setattr(suffix_dedup, "KEY_BYTES", 1 << 14, raising=False)
    largest = 1 << 18

    def watched(batches, sort=suffix_dedup.sort_shard):
        parts = list(batches)
        if sum(len(x) for b in parts for x in b.column("bytes").to_pylist()) > largest:
            raise MemoryError("a shard is too large")
        yield from sort(iter(parts))

    monkeypatch.setattr(suffix_dedup, "sort_shard", watched)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(docs).collect()}
    often = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    for i, t in enumerate(texts):
        gone = set()
        for k in range(len(t) - 199):
            if often[t[k : k + 200]] > 1:
                gone.update(range(k, k + 200))
        assert got[i] == len(gone), i
    assert got[0] > 200 and got[4000] == 900 and got[4001] == 230 and got[3999] == 0


def test_url_filter(spark):
    urls = [
        "http://Sub.Example.ORG/es/1?x", "https://example.org/en/1", "https://example.org/en/2#a", "http://a.example.com/fr/1", "http://a.example.com/de/", "HTTP://b.example.com/it/", "example.com/de/", "http://notexample.org",
        "http://example.net", "http://EXAMPLE.net/?utm_source=a", "https://www.example.net/a/?b=2&a=1", "http://example.net/a?a=1&b=2", "http://example.net/c", None, "", "://x.com/de/y", "ftp://com/de/", "http://com?/de/",
    ]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host int")
    listed = spark.createDataFrame([("http://example.net/",), ("http://example.net/a?b=2&a=1",), ("http://example.org/zzz",), (None,), ("http://example.net/",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, listed).collect()}
    assert got == {
        0: ("sub.example.org", "/es/1", "example.org/es/", "block"), 1: ("example.org", "/en/1", "example.org/en/1", "block"), 2: ("example.org", "/en/2", "org/", "allow"), 3: ("a.example.com", "/fr/1", "com/fr/", "allow"),
        4: ("a.example.com", "/de/", "com/de/", "block"), 5: ("b.example.com", "/it/", None, "allow"), 6: ("", "", None, "allow"), 7: ("notexample.org", "", None, "allow"),
        8: ("example.net", "", None, "block"), 9: ("example.net", "/", None, "block"), 10: ("www.example.net", "/a/", None, "block"), 11: ("example.net", "/a", None, "block"), 12: ("example.net", "/c", None, "allow"),
        13: ("", "", None, "allow"), 14: ("", "", None, "allow"), 15: ("x.com", "/de/y", "com/de/", "block"), 16: ("com", "/de/", "com/de/", "block"), 17: ("com", "", None, "allow"),
    }
    assert url_filter.url_filter(pages, listed.limit(0)).where("listed").count() == 0
    assert url_filter.url_filter(pages.limit(0), listed).count() == 0


def test_bloom_filter_passes_every_listed_url(spark, monkeypatch):
    """Even a filter of one block, where nearly everything passes, gives the exact result."""
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://h.net/', id) as url")
    got = url_filter.url_filter(pages, pages.where("page_id % 7 = 0").select("url"))
    assert got.where("(verdict = 'block') <> (page_id % 7 = 0)").count() == 0 and got.count() == 3000


def test_language_id(spark, docs, rows, empty):
    got = language_id.language_id(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")), r.doc_id
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.language_id(big).where("held_out").join(big.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert language_id.language_id(empty).count() == 0
    assert {r.lang_pred for r in language_id.language_id(docs.where("lang is null")).collect()} == {"und"}


def test_language_model_against_brute_force():
    """Spherical k-means, TF-IDF and cosines written out in plain Python over dictionaries."""
    import random

    from lakemill.llm import features

    r = random.Random(4)
    syllables = {"aa": ["ba", "lo", "mi", "tu"], "bb": ["sch", "ei", "ung", "rt"], "cc": ["eau", "que", "ois", "ille"]}
    make = lambda lang: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(20, 60)))
    labels = [lang for lang in syllables for _ in range(30)]
    texts = [make(lang) for lang in labels]
    counts = np.stack([features.letters(t) for t in texts])
    model = language_id.fit(labels, counts)

    def vector(c):
        total, out = sum(c), {}
        for term, n in enumerate(c):
            if n:
                seen = sum(1 for other in counts.tolist() if other[term]) if term not in vector.seen else vector.seen[term]
                vector.seen[term] = seen
                out[term] = math.sqrt(n / total) * (math.log((1 + len(counts)) / (1 + seen)) + 1)
        norm = math.sqrt(sum(x * x for x in out.values()))
        return {k: x / norm for k, x in out.items()}

    vector.seen = {}
    x = [vector(c) for c in counts.tolist()]
    dot = lambda a, b: sum(v * b.get(k, 0.0) for k, v in a.items())
    centroids = []
    for lang in sorted(syllables):
        mine = [v for v, of in zip(x, labels) if of == lang]
        starts = [0]
        while len(starts) < language_id.CENTROIDS:
            near = [max(dot(v, mine[s]) for s in starts) for v in mine]
            starts.append(near.index(min(near)))
        c = [mine[s] for s in starts]
        for _ in range(language_id.ROUNDS):
            best = [max(range(len(c)), key=lambda i: dot(v, c[i])) for v in mine]
            for i in range(len(c)):
                group = [v for v, b in zip(mine, best) if b == i]
                if group:
                    total = Counter()
                    for v in group:
                        for k, y in v.items():
                            total[k] += y
                    norm = math.sqrt(sum(y * y for y in total.values()))
                    c[i] = {k: y / norm for k, y in total.items()}
        centroids += [(lang, v) for v in c]
    for lang in syllables:
        for _ in range(5):
            c = features.letters(make(lang))
            v = vector(c.tolist())
            score, want = max((dot(v, m), name) for name, m in centroids)
            cosine = (features.weighted(c[None], model["idf"]) @ model["centroids"].T)[0]
            assert model["names"][model["of"][cosine.argmax()]] == want == lang and cosine.max() == pytest.approx(score, abs=1e-4)


def test_a_sample_of_many_labels_stays_bounded(spark, monkeypatch):
    from lakemill.llm import features

    monkeypatch.setattr(features, "SAMPLE", 60)
    docs = spark.range(3000).selectExpr("id as doc_id", "'t' as text").union(spark.createDataFrame([(5, "t")] * 500, "doc_id long, text string"))
    rows = docs.selectExpr("doc_id", "cast(doc_id % 20 as string) as label")
    got = Counter(r.label for r in features.bounded_sample(rows, docs, 400).collect())
    assert len(got) == 20 and set(got.values()) == {3}


def test_labels_of_held_out_rows_change_nothing(spark, docs):
    held = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5, 0) = 0"
    other = docs.selectExpr(*(f"case when {held} then 'xx' else lang end as lang" if c == "lang" else c for c in docs.columns))
    a, b = (sorted(map(tuple, language_id.language_id(d).collect()), key=str) for d in (docs, other))
    assert a == b


def library_ids(text):
    from tokenizers import Tokenizer

    library_ids.t = getattr(library_ids, "t", None) or Tokenizer.from_file(TOKENIZER)
    return library_ids.t.encode(text or "", add_special_tokens=False).ids


def test_packing(docs, rows, empty):
    got = packing.packing(docs, TOKENIZER).collect()
    want = Counter()
    for i, text in rows:
        ids = [*library_ids(text), 1]
        want[(i, len(ids))] += 1
        for r in got:
            if r.doc_id == i and i is not None and r.doc_tokens == len(ids) and i != 9008:
                part = ids[r.start : r.start + r.length]
                assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    total = Counter()
    for r in got:
        total[(r.doc_id, r.doc_tokens)] += r.length
    assert total == {k: k[1] * n for k, n in want.items()}
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.packing(empty, TOKENIZER).count() == 0


def test_packing_of_short_documents(spark):
    """2,000 documents of a few ids each fill their sequences."""
    docs = spark.range(2000).selectExpr("id as doc_id", "'one two three four five six' as text")
    got = packing.packing(docs, TOKENIZER).collect()
    ids = sum(r.length for r in got)
    sequences = {r.sequence_id for r in got}
    assert len(got) == 2000 and ids >= 2000 * 7 and len(sequences) == -(-2000 // (2048 // got[0].length))
    places = sorted((r.sequence_id, r.offset) for r in got)
    assert len(set(places)) == 2000 and all(o % got[0].length == 0 for _, o in places)


def test_near_duplicates(docs, rows, empty):
    got = by_id(minhash.near_duplicates(docs))
    assert sum(map(len, got.values())) == len(rows)
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(parent)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    for i in ids:
        r = got[i][0]
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), root(i), root(i) == i), i
    kept = minhash.kept_documents(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == Counter(i for i in ids if root(i) == i)
    assert minhash.near_duplicates(empty).count() == 0


def test_an_id_with_several_texts(spark):
    """No text goes that nothing resembles; the near copy of one of them does; the id's components are one."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("b")), (1, text("b")), (2, text("b") + " more"), (3, text("c")), (5, text("d")), (5, text("e")), (4, text("d")), (6, text("e") + " more"), (None, text("f"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.text.split()[0][:2] for r in minhash.kept_documents(docs).collect()]
    assert sorted(kept) == ["wa", "wb", "wc", "wd", "we", "wf"]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4, None: None}


def test_near_copies_in_a_large_group(spark):
    """Each differs from the others in a few words of its own; some are too far from all of them."""
    import random

    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    data = []
    for i in range(150):
        w = base[:]
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 9])):
            w[r.randrange(120)] = f"own{i}_{r.randrange(99)}"
        data.append((i, " ".join(w)))
    got = by_id(minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for _, t in data]
    parent = list(range(150))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(150):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert [got[i][0].component_id for i in range(150)] == [root(i) for i in range(150)]


def test_large_groups_meet_compiled_methods(spark, monkeypatch):
    """A generated method of over 8000 bytes is never compiled: the pairs of a hot bucket then took some fifty times as long."""
    import random

    sizes, real = [], graph.written

    def written_and_sized(df, name):
        found = df._jdf.queryExecution().debug().codegenToSeq()
        sizes.extend(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size()))
        return real(df, name)

    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    swapped = lambda i: {r.randrange(120): f"own{i}_{k}" for k in range(r.choice([0, 1, 2, 3, 9]))}
    data = [(i, " ".join(new.get(k, w) for k, w in enumerate(base))) for i in range(60) for new in [swapped(i)]]
    for module in (graph, minhash):
        monkeypatch.setattr(module, "written", written_and_sized)
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        assert minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).count() == 60
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) > 50 and max(sizes) < 8000


def test_bitmaps_never_rule_out_a_link(spark):
    """The bound by bitmaps is that of shared bits and of shingles that fall together, and is none without a bitmap."""
    r = np.random.default_rng(5)
    pairs = []
    for both in [*range(0, 200, 7), 160, 165, 170, 171, 172]:
        found = r.integers(0, 1 << 62, 400 - both, dtype=np.uint64)
        pairs.append((found[:200], found[200 - both :]))
    side = lambda s: (len(s), int(np.unique(s & np.uint64(1023)).size), minhash.bitmap(s).tolist())
    rows = [(k, side(x), side(y)) for k, (x, y) in enumerate(pairs)] + [(-1, (9, None, None), side(pairs[0][0]))]
    kind = "struct<n:long,ones:int,bits:array<long>>"
    got = {x.k: x.ok for x in spark.createDataFrame(rows, f"k long, x {kind}, y {kind}").select("k", minhash.bits_allow("x", "y", 75).alias("ok")).collect()}
    assert got.pop(-1)
    for k, (x, y) in enumerate(pairs):
        a, b = (np.bitwise_or.reduce(np.eye(1024, dtype=bool)[s & np.uint64(1023)]) for s in (x, y))
        most = min(len(x) - (a & ~b).sum(), len(y) - (b & ~a).sum())
        both = len(np.intersect1d(x, y))
        assert got[k] == (100 * most >= 75 * (len(x) + len(y) - most)), k
        assert got[k] or 100 * both < 75 * (len(x) + len(y) - both), k
    assert {True, False} == set(got.values())


def test_components(spark, monkeypatch):
    """Stars need no round beyond the first table; paths and forests end at their least node."""
    tables, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: tables.append(name) or real(df, name))
    links = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    stars = [(1, k) for k in range(10, 60)] + [(3, 2), (2, 4), (4, 2), (70, 70)]
    assert {r.node: r.component for r in graph.components(links(stars)).collect()} == {**dict.fromkeys([1, *range(10, 60)], 1), 2: 2, 3: 2, 4: 2}
    assert tables == ["links"]
    assert graph.components(links([])).count() == 0 and tables == ["links"] * 2
    path = [(k, k + 1) for k in range(40)] + [(50, 60), (55, 60), (55, 65)]
    expected = {**dict.fromkeys(range(41), 0), **dict.fromkeys([50, 55, 60, 65], 50)}
    assert {r.node: r.component for r in graph.components(links(path)).collect()} == expected
    forest = real(spark.createDataFrame([(k, k - 1) for k in range(1, 41)] + [(60, 50), (55, 50), (65, 55)], "node long, parent long"), "parents")
    tables.clear()
    assert {r.node: r.parent for r in graph.roots(forest).collect()} == {n: c for n, c in expected.items() if n != c}
    assert len(tables) == 6


def test_mixing(spark, docs, rows, empty):
    got = mixing.mixing(docs).collect()
    counts = Counter((r["source"]) for r in docs.select("source").collect())
    named = 0.15 if counts["src0"] else 0
    for r in got:
        share = named if r.source == "src0" else (1 - named) * counts[r.source] / (sum(counts.values()) - counts["src0"])
        assert r.rate == pytest.approx(share * sum(counts.values()) / counts[r.source])
    copies = Counter()
    for i, source in ((r.doc_id, r.source) for r in docs.select("doc_id", "source").collect()):
        rate = next((r.rate for r in got if r.source == source), None)
        if rate is None:
            continue
        u = int(hashlib.md5(f"{mixing.SEED}|{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        p = total = math.exp(-rate)
        k = 0
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        copies[i] += k
    assert Counter(r.doc_id for r in got) == +copies
    assert mixing.mixing(empty).count() == 0
    big = spark.range(40000).selectExpr("id as doc_id", "if(id % 4 = 0, 'src0', 'b') as source", "'t' as text")
    out = mixing.mixing(big).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in out}
    assert n["src0"] / sum(n.values()) == pytest.approx(0.15, abs=0.01) and sum(n.values()) == pytest.approx(40000, rel=0.02)


def test_mixing_of_a_rare_source(spark):
    """5 of 20,000 documents are to be 15 %: a rate of 600 each, drawn in parts."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id < 5, 'src0', 'src1') as source")
    got = {r.doc_id: (r.copies, r.n, r.rate) for r in mixing.mixing(docs).where("source = 'src0'").groupBy("doc_id").agg(F.max("copies").alias("copies"), F.count("*").alias("n"), F.max("rate").alias("rate")).collect()}
    assert len(got) == 5 and all(c == n and r == pytest.approx(600) for c, n, r in got.values())
    assert all(abs(c - 600) < 150 for c, _, _ in got.values()) and len({c for c, _, _ in got.values()}) > 1


def test_token_counts(spark, docs, rows, empty, tmp_path):
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = by_id(token_counts.token_counts(docs, TOKENIZER, cache))
        assert sum(map(len, got.values())) == len(rows)
        for i, text in rows:
            want = (len((text or "").encode()), len(library_ids(text)), len(library_ids(text)) > 2048)
            assert want in {(r.n_bytes, r.n_tokens, r.over_limit) for r in got[i]}, i
        stored = spark.read.parquet(cache)
        # Every distinct normalised text is stored once; the second run finds all of them.
        assert stored.count() == stored.select("digest").distinct().count() == len({re.sub(r"[ \t-\r]+", " ", t or "") for _, t in rows})
    n = stored.count()
    token_counts.token_counts(docs, TOKENIZER, cache).count()
    assert spark.read.parquet(cache).count() == n
    assert token_counts.token_counts(empty, TOKENIZER, f"file://{tmp_path}/none").count() == 0


def test_each_digest_is_encoded_once(spark, tmp_path, monkeypatch):
    """300 rows with one id and text, 200 without an id, 100 copies under ids of their own, in many partitions."""
    from lakemill.llm import tokens

    data = [(7, "some words here")] * 300 + [(None, "other words")] * 200 + [(i, "a  b\tc") for i in range(100)] + [(200 + i, "a b c") for i in range(100)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(13)
    cache, log = f"file://{tmp_path}/cache", f"{tmp_path}/encoded"

    class Counted(tokens.Encoder):
        def slices(self, column):
            with open(log, "a") as f:
                f.writelines("x" for _ in range(len(column)))
            return super().slices(column)

    monkeypatch.setattr(token_counts, "encoder", Counted)
    assert token_counts.token_counts(docs, TOKENIZER, cache).count() == 700
    assert spark.read.parquet(cache).count() == 3 and len(open(log).read()) == 3
    more = docs.union(spark.createDataFrame([(1, "new")], docs.schema))
    got = token_counts.token_counts(more, TOKENIZER, cache).collect()
    assert spark.read.parquet(cache).count() == 4 and len(open(log).read()) == 4  # the others were found
    assert all(r.n_tokens == len(library_ids({7: "some words here", None: "other words"}.get(r.doc_id, "a b c"))) for r in got if r.doc_id != 1)


def test_votes_of_labels_count_once(spark, docs, labels):
    """Repeated label rows and copies of labelled texts prove nothing new; contradicting labels prove nothing at all."""
    plain = {(r.doc_id, r.n_words): r.broken_rule for r in quality_rules.quality_rules(docs, labels).collect()}
    often = labels
    for _ in range(5):
        often = often.union(often)
    assert {(r.doc_id, r.n_words): r.broken_rule for r in quality_rules.quality_rules(docs, often).collect()} == plain
    features, truth = shares(spark, 60, 1)  # too few to prove anything
    features = features.withColumn("__rule_text", F.col("doc_id"))
    copies = features.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).withColumn("doc_id", F.col("doc_id") * 100 + F.col("copy")).drop("copy")
    named = truth.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).select((F.col("doc_id") * 100 + F.col("copy")).alias("doc_id"), "quality")
    assert quality_rules.cutoffs(features, truth).count() == quality_rules.cutoffs(copies, named).count() == 0
    both = truth.withColumn("quality", F.lit(0)).union(truth.withColumn("quality", F.lit(1)))
    assert quality_rules.cutoffs(features, both).count() == 0


def test_op1_against_its_sql(spark, tmp_path):
    """Several strata and rules, copies, contradicting labels, null strata: the operator and its SQL agree."""
    import random

    import duckdb

    from lakemill.llm import oracle

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    data, truth = [], []
    for i in range(2400):
        lang, bad = r.choice(["en", "de", None]), r.random() < 0.3
        words = [word() for _ in range(r.randint(40, 90))]
        junk = r.choice(["***", "SHOUT", "wow!", "x"]) if bad else ""
        if bad:
            words = [w + junk if r.random() < 0.6 else w for w in words]
            words = [w.upper() for w in words] if junk == "SHOUT" else words
            words = words[:25] * 2 + words[25:] if junk == "x" else words
        text = " ".join(words)
        if data and r.random() < 0.1:
            lang, text = r.choice(data)[1:3]
        data.append((i, lang, text))
        if r.random() < 0.9:
            truth += [(i, int(not bad))] * r.choice([1, 1, 3])
        if r.random() < 0.02:
            truth.append((i, int(bad)))
    spark.createDataFrame(data, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(truth, "doc_id long, quality long").write.parquet(str(tmp_path / "labels.parquet"))
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = {x[0]: x[1:] for x in c.sql(f"select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, broken_rule from ({oracle.op1()})").fetchall()}
    table = lambda n: spark.read.parquet(str(tmp_path / f"{n}.parquet"))
    got = {x[0]: tuple(x[1:]) for x in quality_rules.quality_rules(table("documents"), table("labels")).collect()}
    assert got == want and len(set(x[-1] for x in got.values())) >= 4


def test_native_operators_run_no_python(spark, docs, labels):
    for df in (quality_rules.quality_rules(docs, labels), fingerprints.fingerprints(docs.limit(20)), mixing.mixing(docs)):
        text = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", text)
