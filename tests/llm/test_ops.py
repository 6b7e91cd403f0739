"""Each operator against brute force or a round trip, and on nulls, empty, long and repeated rows, clashing columns, empty tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from compare import database, same
from pyspark.sql import functions as F

from kilnmark.llm import _text, decontaminate, fingerprints, jaccard, langid, licenses, linededup, packing, quality, queries, tokenfile, toxicity
from kilnmark.llm.tokens import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 5000} and then" for i in range(20_000))
NAMES = ("class", "token", "n", "score", "block", "sketch", "n_removed", "start", "pattern", "slot")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty and long texts, repeated rows, columns whose names the operators use themselves."""
    same_text = "the quick brown fox jumps over the lazy dog again and again today"
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "x"), (5, LONG), (6, same_text), (6, same_text), (7, same_text), (8, same_text + " indeed"), (9, "ünï ÇØDÉ 中文 😀"), (None, "no id here at all but some words")]
    df = spark.createDataFrame([(i, t, None if i == 4 else "en", None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in NAMES]).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


# --- 1


def bottom(spark, texts, k=fingerprints.K):
    """Bottom-k sketches by plain Python over the engine's hash of each word and shingle."""
    words = {t: re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for t in texts}
    every = sorted({w for ws in words.values() for w in ws})
    rows = spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    of = {r["w"]: r["h"] for r in rows}
    grams = {}
    for t, ws in words.items():
        h = [of[w] for w in ws]
        grams[t] = [tuple(h[i : i + 5]) for i in range(len(h) - 4)] if len(h) >= 5 else [tuple(h)] if h else []
    flat = sorted({g for gs in grams.values() for g in gs})
    whole = [g for g in flat if len(g) == 5]
    of = {tuple(r["g"]): r["h"] for r in spark.createDataFrame([(list(g),) for g in whole], "g array<bigint>").select("g", F.xxhash64(*[F.col("g")[i] for i in range(5)]).alias("h")).collect()}
    short = [g for g in flat if len(g) < 5]
    if short:
        of |= {tuple(r["g"]): r["h"] for r in spark.createDataFrame([(list(g),) for g in short], "g array<bigint>").select("g", F.xxhash64("g").alias("h")).collect()}
    return {t: sorted({of[g] for g in gs})[:k] for t, gs in grams.items()}


def likeness(a, b, k=fingerprints.K):
    union = sorted({*a, *b})[:k]
    return len({*union} & {*a} & {*b}) / len(union) if union else 1.0


def test_fingerprints(spark, sf, odd, empty):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op1_fingerprints(spark, sf).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    edits = {}
    for i, k in enumerate(order):
        t, nxt = texts[k], texts[order[(i + 1) % len(order)]]
        q = len(t) // 4
        edits[k] = t[: len(t) - q] + nxt[:q]
    sketches = bottom(spark, {*texts.values(), *edits.values()})
    digits = lambda s: "".join(f"{h % 2**64:016x}" for h in s)
    for i, k in enumerate(order):
        t, nxt, edited = texts[k], texts[order[(i + 1) % len(order)]], edits[k]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k]["fingerprint"] == digits(sketches[t]) and got[k]["edited_fingerprint"] == digits(sketches[edited])
        assert got[k]["near_edited"] == likeness(sketches[t], sketches[edited]) and got[k]["near_next"] == likeness(sketches[t], sketches[nxt])
        a, b = shingles(t, 5), shingles(edited, 5)
        assert abs(got[k]["near_edited"] - len(a & b) / len(a | b)) < 0.2
    out = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(odd).collect()}
    assert out[1]["fingerprint"] == out[2]["fingerprint"] == out[3]["fingerprint"] == "" and out[1]["near_next"] == 1.0
    assert out[6]["fingerprint"] == out[7]["fingerprint"] and len(out[5]["fingerprint"]) <= 16 * fingerprints.K
    assert fingerprints.edited_fingerprints(odd).count() == 11 and fingerprints.edited_fingerprints(empty).count() == 0


@pytest.mark.parametrize("kind", ["hashed", "outlier", "edges", "nulls", "one", "wide"])
def test_next_documents_of_any_ids(spark, kind, monkeypatch):
    """Hashed, far-off, extreme and null ids: every row has its next one, in blocks of like size."""
    rng = random.Random(5)
    n = 1 if kind == "one" else 600
    ids = {
        "hashed": [rng.randrange(-(2**63), 2**63) for _ in range(n)], "outlier": [*range(n - 2), 2**60, -(2**61)],
        "edges": [-(2**63), 2**63 - 1, -1, 0, *range(1, n - 3)], "nulls": [None] * (n // 3) + list(range(n - n // 3)), "one": [7],
        "wide": [2**62 + i for i in range(n)],
    }[kind]
    rows = [(i, f"text number {j} of some words {rng.random()}") for j, i in enumerate(ids)]
    monkeypatch.setattr(fingerprints, "BLOCK", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprints.next_texts(df).collect()
    follow = {r["text"]: r["next_text"] for r in got}
    assert len(got) == n == len(follow) and sorted(follow.values()) == sorted(follow)
    known = sorted(((-1 if i is None else i), t) for i, t in rows)
    if kind != "nulls":
        assert all(follow[t] == known[(j + 1) % n][1] for j, (_, t) in enumerate(known))
    else:  # rows of one id go by their hashes, before all other ids
        nulls = {t for i, t in known if i < 0}
        assert len({follow[t] for t in nulls} & nulls) == len(nulls) - 1
    keys = df.select(F.coalesce("doc_id", F.lit(-1).cast("long")).alias("key"), F.shiftrightunsigned(F.xxhash64("text"), 4).alias("tie"))
    fine, coarse = fingerprints.blocks(keys.select(fingerprints.order_value(F.col("key"), F.col("tie")).alias("v")))
    if kind != "one":
        bounds = {r["cut"]: r["bounds"] for r in fine.collect()}
        vs = [r["v"] for r in keys.select(fingerprints.order_value(F.col("key"), F.col("tie")).alias("v")).collect()]
        sizes = {}
        for v in vs:
            c = sum(b <= v for b in coarse)
            at = c, sum(b <= v for b in bounds[c])
            sizes[at] = sizes.get(at, 0) + 1
        assert max(sizes.values()) < (n / 4 if kind != "wide" else n + 1)


def test_containment_and_lost_keys(spark):
    texts = {"a": " ".join(f"w{i}" for i in range(90)), "b": " ".join(f"w{i}" for i in range(60)), "c": "", "d": None, "e": "v w x"}
    df = fingerprints.with_sketch(spark.createDataFrame(list(texts.items()), "k string, t string"), "t", "s")
    both = df.alias("x").crossJoin(df.alias("y")).select("x.k", F.col("y.k").alias("o"), fingerprints.containment(F.col("x.s"), F.col("y.s")).alias("c"))
    for r in both.collect():
        a, b = shingles(texts[r["k"]], 5), shingles(texts[r["o"]], 5)
        assert r["c"] == pytest.approx(len(a & b) / len(a) if a else 1.0)
    keys = df.select(F.when(F.col("k") == "e", None).otherwise(F.col("k")).alias("k"), F.when(F.col("k") != "d", F.col("s")).alias("s"))
    merged = {r["k"]: r["s"] for r in fingerprints.merge_sketches(keys, "k", "s").collect()}
    assert set(merged) == {"a", "b", "c", "d", None} and merged["c"] == merged["d"] == [] and len(merged["a"]) == 86


def test_sketches_merge(spark):
    parts = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(lo, lo + 600))) for lo in (0, 300, 300)], "k string, text string")
    merged = fingerprints.merge_sketches(fingerprints.with_sketch(parts, "text", "s"), "k", "s").first()["s"]
    whole = fingerprints.with_sketch(spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(900)))], "k string, text string"), "text", "s").first()["s"]
    both = set(merged) & set(whole)
    assert len(merged) == len(whole) == fingerprints.K and len(both) > 0.95 * len(whole)
    est = spark.createDataFrame([(merged,)], "s array<bigint>").select(fingerprints.distinct_count(F.col("s")).alias("n")).first()["n"]
    assert 600 < est < 1200


# --- samples


def test_samples_are_bounded_and_the_same_however_dealt(spark):
    from kilnmark.llm._shared import Scratch, hash_sample

    df = spark.range(5000).select((F.col("id") % 1300).alias("a"), (F.col("id") % 3 % 2).alias("b"))
    scratch = Scratch(spark, "test")
    one, two = ({tuple(r) for r in hash_sample(df.repartition(n), 100, scratch, "b").collect()} for n in (1, 7))
    assert one == two and sum(b for _, b in one) == 100 and len(one) == 200
    assert hash_sample(spark.range(10).select((F.col("id") % 4).alias("a")), 100, scratch).count() == 4
    few = hash_sample(df, 50, scratch).collect()
    hashes = sorted(r["h"] for r in df.distinct().select(F.xxhash64("a", "b").alias("h")).collect())
    assert sorted(r["h"] for r in spark.createDataFrame(few).select(F.xxhash64("a", "b").alias("h")).collect()) == hashes[:50]
    assert hash_sample(df.limit(0), 50, scratch).count() == hash_sample(df.limit(0), 50, scratch, "b").count() == 0


# --- 2, 3


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(5)
    bits = [*"ab c .,'s\n\tRé1İßΣσ", " ", "  ", "\x1c", "\x85", "<|endoftext|>", "'ll", "中", "😀", "don't", " foo", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 50))) for _ in range(3000)]
    for path, kind in ((BYTE, "byte"), (WORD, "word")):
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        assert Encoder(path, kind).encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def test_best_fit_takes_the_fullest_that_fits():
    p = packing.BestFit(10, 3)
    assert [p.place(n) for n in (6, 7, 3, 4, 9)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    p = packing.BestFit(10, 1)
    assert [p.place(n) for n in (6, 7, 3)] == [(0, 0), (1, 0), (1, 7)]


def test_packing(spark, sf, odd, empty):
    rows = packing.packed_documents(odd, WORD, capacity=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len([r for r in rows if r["doc_id"] == 6]) == 2 and sorted({r["length"] for r in rows if r["doc_id"] in (1, 2, 3)}) == [1]
    assert packing.packed_documents(empty, WORD).count() == 0
    whole = queries.op2_best_fit_packing(spark, sf).collect()
    total = sum(r["length"] for r in whole)
    assert len({r["sequence_id"] for r in whole}) <= 1.1 * total / 4096 + 2
    made = packing.sequences(odd, WORD, capacity=64).collect()
    assert sum(r["length"] for r in made) == sum(r["length"] for r in rows) and all(len(r["ids"]) == 4 * r["length"] for r in made)


def test_elias_fano():
    rng = np.random.default_rng(2)
    for values in ([], [0], [5, 5, 5], [2**40], np.sort(rng.integers(0, 10**7, 3000)).tolist(), list(range(1000))):
        e = tokenfile.EliasFano.encode(np.array(values, np.uint64))
        again, _ = tokenfile.EliasFano.frombytes(e.tobytes(), 0, len(values))
        assert again.all().tolist() == values and [again.select(i) for i in range(len(values))] == values
    with pytest.raises(ValueError, match="does not fit"):
        tokenfile.write_shard([1], [np.array([5, 70_000], "<u4").tobytes()], 2)
    shard = tokenfile.Shard(tokenfile.write_shard([None, -(2**63), 2**63 - 1], [np.array(x, "<u4").tobytes() for x in ([1], [2, 3], [])], 2))
    assert shard.doc_ids() == [None, -(2**63), 2**63 - 1] and [shard.ids(i).tolist() for i in range(3)] == [[1], [2, 3], []]
    n = 3000
    assert 8 * len(e.low) + 8 * len(e.high) < 64 * n


def test_token_files(spark, sf, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op3_token_files(spark, sf).collect()}
    at = 0
    for r in rows:
        x = [*t.encode(r["text"], add_special_tokens=False).ids, 0]
        assert got[r["doc_id"]] == (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    out = tokenfile.round_trip(odd, BYTE).collect()
    assert len(out) == 11 and {r["doc_id"]: r["n_tokens"] for r in out}[1] == 1 and min(r["start"] for r in out if r["doc_id"] is None) == 0
    assert tokenfile.round_trip(empty, BYTE).count() == 0


# --- 4


def test_leaks(spark, sf, odd, empty):
    docs, bench = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got >= {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    rng, rows = random.Random(1), []
    for n in range(60):
        i = rng.choice(sorted(items))
        y = list(items[i])
        for _ in range(len(y) // 30):
            k = rng.randrange(len(y))
            y[k : k + rng.randrange(2)] = rng.choice(["", "x", "qé"])
        rows.append((n, "Clean words stand before it. " + "".join(y) + " And some after.", i))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), bench).collect()}
    assert {(n, i) for n, _, i in rows} <= found
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.keep_clean(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.keep_clean(odd, bench).columns == odd.columns and decontaminate.keep_clean(odd, bench).count() == 11


CODE = """def area(shape, scale=1.0):
\tif shape is None:
\t\treturn 0

    total = sum(x  *  y for x, y in shape)
\treturn scale * total
"""
ITEMS = [
    (1, CODE), (2, "  - first of the things to do\r\n    - and one below it, indented\r\n  - second of the things to do\r\n"),
    (3, "Which\u00a0of the following   statements about rivers is true?  (A) They run uphill.  (B) They run to the sea."),
    (4, "ΤΟ ΤΕΛΟΣ ΤΟΥ ΔΡΟΜΟΥ ΕΙΝΑΙ ΜΑΚΡΥ ΚΑΙ ΟΛΟΙ ΤΟ ΞΕΡΟΥΝ ΑΠΟ ΠΑΛΙΑ, İstanbul'da da öyle."), (5, "Yes."), (6, None), (7, "")]


def test_verbatim_copies_in_any_layout(spark):
    """Copies with the item's blanks, with others, as excerpts; short items only as whole texts; null and repeated ids."""
    around = "Words before it stand here.\n", "\nAnd more words come after it."
    flat = {i: " ".join((t or "").split()) for i, t in ITEMS}
    rows = [(10 + i, around[0] + (t or "") + around[1]) for i, t in ITEMS[:4]] + [(20 + i, around[0] + flat[i] + around[1]) for i in (1, 2, 3, 4)]
    rows += [(30 + i, flat[i].replace(" ", " \u2003\n ").upper()) for i in (1, 2, 3)] + [(40, "yes.\n"), (41, "Yes. It is so."), (42, ""), (43, None), (44, around[0] * 9), (None, flat[3]), (44, flat[1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS * 2, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["end"], r["edits"]) for r in decontaminate.leaks(docs, bench).collect()}
    want = {(k + i, i) for k in (10, 20, 30) for i in (1, 2, 3)} | {(14, 4), (24, 4), (40, 5), (None, 3), (44, 1)}
    assert set(got) == want
    texts = dict(rows)
    for (d, i), (a, b, e) in got.items():
        if d in (11, 12, 13, 21, 22, 23):
            assert e == 0 and " ".join(texts[d][a:b].split()).lower() == flat[i].lower()
    kept = decontaminate.keep_clean(docs, bench).collect()
    assert sorted(((r["doc_id"], len(r["text"] or "")) for r in kept), key=str) == sorted([(41, 14), (42, 0), (43, 0), (44, 9 * len(around[0]))], key=str)


def test_many_blocks_and_split_searches(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    found, kept = (sorted(map(str, x.collect())) for x in (decontaminate.leaks(docs, bench), decontaminate.keep_clean(docs, bench)))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1000)
    assert sorted(map(str, decontaminate.leaks(docs, bench).collect())) == found
    assert sorted(map(str, decontaminate.keep_clean(docs, bench).collect())) == kept
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    whole = pa.array([*texts, "\n".join(texts), None])
    index = decontaminate.Index(items)
    want = sorted((r, i) for r, i, *_ in decontaminate._found(whole, index))
    monkeypatch.setattr(decontaminate, "MEETINGS", 300)
    assert sorted((r, i) for r, i, *_ in decontaminate._found(whole, index)) == want


def test_leaks_against_brute_force():
    """A text has an item exactly if some pattern of it is within its edits of some region, by plain edit distance."""
    rng = random.Random(9)
    letters = "abcdefghij klmnop"
    item = "".join(rng.choice(letters) for _ in range(150)).replace("  ", "x ").strip()
    index = decontaminate.Index([(1, item)])
    clean = decontaminate.normal(item)
    starts = [*range(0, len(clean) - decontaminate.PATTERN, decontaminate.STRIDE), len(clean) - decontaminate.PATTERN]

    def least(p, t):
        row = np.zeros(len(t) + 1, int)
        for x in p:
            diagonal = np.minimum(row[:-1] + (t != x), row[1:] + 1)
            new = np.concatenate(([row[0] + 1], diagonal))
            row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        return row.min()

    texts = []
    for _ in range(150):
        a = rng.randrange(0, 80)
        y = list(item[a : a + rng.randrange(30, 150)])
        for _ in range(rng.randrange(0, 16)):
            k = rng.randrange(len(y))
            y[k : k + rng.randrange(2)] = rng.choice(["", "q", "zz"])
            if not y:
                y = ["a"]
        texts.append("nothing of it here " + "".join(y) + " nor there")
    edits = decontaminate.budget(decontaminate.PATTERN)
    points = [decontaminate.normal(t) for t in texts]
    want = {i for i, p in enumerate(points) if any(least(clean[a : a + decontaminate.PATTERN], p) <= edits for a in starts)}
    got = {r for r, *_ in decontaminate._found(pa.array(texts), index)}
    assert got == want and 20 < len(want) < 140


def test_excerpts_of_a_pattern_and_a_stride_are_covered():
    rng = random.Random(2)
    item = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(60))
    index, size = decontaminate.Index([(7, item)]), decontaminate.PATTERN + decontaminate.STRIDE - 1
    texts = [f"before {item[a : a + size]} after" for a in range(len(item) - size)]
    assert {r for r, *_ in decontaminate._found(pa.array(texts), index)} == set(range(len(texts)))


# --- 5


def components_of(sets, t):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = sorted(sets)
    for n, i in enumerate(keys):
        for j in keys[:n]:
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both * t.denominator >= t.numerator * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("width", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(1, 2))])
def test_jaccard(spark, width, t):
    rng, docs = random.Random(width), {}
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(2, 120))] for _ in range(12)]
    for i in range(160):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs[i] = " ".join(w).upper() if i % 9 == 0 else "  ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, width, t).collect()}
    sets = {i: shingles(x, width) for i, x in docs.items()}
    want = components_of(sets, t)
    assert got == {i: (len(sets[i]), want[i]) for i in docs}
    if width == 5:  # all links, between classes and counted by document
        near = lambda i, j: len(sets[i] & sets[j]) * t.denominator >= t.numerator * len(sets[i] | sets[j])
        counted = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.jaccard_components(df, width, t, count_links=True).collect()}
        assert counted == {i: (want[i], sum(near(i, j) for j in docs if j != i)) for i in docs}
        members, links = jaccard.jaccard_classes(df, width, t, every=True)
        of = {r["doc_id"]: r["class"] for r in members.collect()}
        pairs = {(min(of[i], of[j]), max(of[i], of[j])) for i in docs for j in docs if of[i] != of[j] and near(i, j)}
        assert sorted(tuple(r) for r in links.collect()) == sorted(pairs)


def test_sketches_bound_the_difference():
    """Parity sketches of any two lengths never show more than the symmetric difference, and grow with the sets."""
    from kilnmark.llm._links import _Sketches

    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 30_000).astype(np.uint64)
    sets = [base[:300], base[:520], base[100:900], base[:30_000], base[2000:30_000], rng.integers(0, 2**63, 30_000).astype(np.uint64)]
    raw = [jaccard.sketch(s, len(s)).tobytes() for s in sets]
    found = _Sketches(raw)
    for i, a in enumerate(sets):
        for j, d in enumerate(found.differ(i), i + 1):
            assert d <= len(np.setxor1d(a, sets[j]))
    assert found.differ(3)[1] > 0.43 * 30_000 and len(raw[3]) > len(raw[0])


def test_jaccard_odd(spark, odd, empty):
    rows = jaccard.jaccard_components(odd).collect()
    assert len(rows) == 11
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[7][1] == 6 and got[8][1] == 6
    assert jaccard.jaccard_components(empty).count() == 0 and jaccard.jaccard_components(empty, count_links=True).count() == 0


def test_jaccard_sql(spark, sf):
    same(queries.op5_ngram_jaccard(spark, sf), database(sf), queries.oracle_sql()["op5_ngram_jaccard"])


# --- 6


def test_em_finds_the_labellers():
    rng = np.random.default_rng(3)
    truth = rng.random(20000) < 0.7
    right = np.array([0.9, 0.8, 0.75, 0.6])
    votes = np.where(rng.random((20000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    rates, share = quality.estimate(patterns, counts)
    assert abs(share - 0.7) < 0.06 and np.all(np.abs(rates[:, 1, 1] - right) < 0.06)


def test_em_climbs_the_likelihood_by_plain_python():
    """Estimates against EM written out over single votes; posteriors are Bayes' rule."""
    rng = np.random.default_rng(8)
    patterns = np.unique(rng.integers(0, 3, (60, 4)), axis=0)
    counts = rng.integers(1, 30, len(patterns))
    rates, share = quality.estimate(patterns, counts, rounds=25)
    good = [0.9 if sum(v == 1 for v in p) >= 2 * sum(v == 0 for v in p) + 1 else 0.1 for p in patterns]
    for _ in range(25):
        table = [[[2.0, 1.0, 1.0], [1.0, 2.0, 1.0]] for _ in range(4)]
        for p, n, g in zip(patterns, counts, good, strict=True):
            for k, v in enumerate(p):
                table[k][1][v] += g * n
                table[k][0][v] += (1 - g) * n
        table = [[[x / sum(row) for x in row] for row in rows] for rows in table]
        prior = (sum(g * n for g, n in zip(good, counts, strict=True)) + 1) / (sum(counts) + 2)
        good = []
        for p in patterns:
            a, b = prior, 1 - prior
            for k, v in enumerate(p):
                a, b = a * table[k][1][v], b * table[k][0][v]
            good.append(a / (a + b))
    assert np.allclose(rates, table, atol=1e-4) and abs(share - prior) < 1e-4
    assert np.allclose(quality.posterior(patterns, rates, share), good, atol=1e-3)


def test_quality_scores_by_plain_python(spark):
    """Votes from plain counts, and scores from hashed words and shapes, on whole texts."""
    texts = ["", "The cat and the dog sat on the mat of the house, and it was good.", "$$$ %%% ### @@@", "AAA BBB " * 30, "one two\none two\none two", "12 34 56 78 90"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    votes, found = quality.statistics(data, offsets)
    scorer = quality.Scorer(np.full((len(quality.LABELLERS), 2, 3), 1 / 3), 0.5)
    scorer.w = np.random.default_rng(1).normal(size=1 << quality.LOG_DIM)
    scores = scorer.score(data, offsets, found)

    def bucket(raw, shape):
        h = _text.range_hash(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))
        return int((_text.mix(h + np.uint64(1)) if shape else h)[0] >> np.uint64(64 - quality.LOG_DIM))

    for t, v, s in zip(texts, votes, scores, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        n, size = len(words), max(1, len(t))
        share = sum(w.lower() in quality.COMMON for w in words) / max(1, n)
        mean = sum(map(len, words)) / max(1, n)
        marks = sum(c in "#$%&*+/<=>@[]^_`{|}~\\" for c in t) / size
        want = {"length": 1 if n >= 40 else 0 if n < 8 else 2, "common": 0 if share < 0.04 else 1 if share > 0.12 else 2, "marks": 0 if marks > 0.04 else 1 if marks < 0.005 else 2, "word_length": 0 if mean < 2 or mean > 16 else 1 if 3 < mean < 10 else 2}
        assert all(v[quality.LABELLERS.index(k)] == x for k, x in want.items())
        shape = lambda w: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", w)))[:12]
        z = sum(scorer.w[bucket(w.lower().encode(), False)] + scorer.w[bucket(shape(w).encode(), True)] for w in words) / max(1, n)
        assert s == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op6_quality(spark, sf).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert np.mean([rows[d]["keep"] == bool(q) for d, q in labels]) > 0.88
    out = quality.score(odd).collect()
    assert len(out) == 11 and all(0 <= r["score"] <= 1 for r in out) and quality.score(empty).count() == 0


# --- 7


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_bit_parallel_distance():
    rng = random.Random(3)
    for _ in range(5000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(2))
        assert linededup.within(a, b) == (edit_distance(a, b) <= 2)


def removed_by_brute_force(lines):
    """(doc_id, line) of lines, taken in order, that are within their edits of an earlier line that was kept."""
    kept, seen, want = [], {}, set()
    for d, j, x in sorted(lines, key=lambda r: r[:2]):
        if x not in seen:
            seen[x] = any(abs(len(x) - len(y)) <= 2 and edit_distance(x, y) <= min(2, min(len(x), len(y)) // 8) for y in kept)
            if not seen[x]:
                kept.append(x)
                continue
        want.add((d, j))
    return want


def lines_of(docs):
    return [(d, j, x) for d, t in docs if t for j, x in enumerate(t.split("\n")) if x.strip()]


def test_line_dedup(spark, odd, empty, monkeypatch):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdé fgh") for _ in range(rng.randrange(14, 50))) for _ in range(16)]

    def worn(x):
        y = list(x)
        for _ in range(rng.randrange(5)):
            y[rng.randrange(len(y))] = rng.choice(["", "x", "yé"])
        return "".join(y)

    docs = [(i, None if i == 5 else "\n".join(worn(rng.choice(base)) for _ in range(rng.randrange(6)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = removed_by_brute_force(lines_of(docs))
    assert {(r["doc_id"], r["line"]) for r in linededup.removed_lines(df).collect()} == want
    monkeypatch.setattr(linededup, "BLOCK", 2)  # in this process only: dealt in small blocks, compared by them
    assert {(r["doc_id"], r["line"]) for r in linededup.removed_lines(df).collect()} == want
    out = linededup.dedup_lines(odd)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in out.collect()}
    assert out.count() == 11 and got[1] == (None, 0) and got[2] == ("", 0) and got[7] == ("", 1) and got[None][1] == 0 and got[6][1] == 0
    assert linededup.dedup_lines(empty).count() == 0


def test_chains_of_lines_stay(spark):
    """Lines of a series are not all like the first: each that goes is within its edits of one that stays."""
    docs = [(0, "\n".join(f"The total for the year is {n}" for n in range(1000, 3200, 37))), (1, "\n".join(f"Chapter {n} of the collected works" for n in range(1, 130)))]
    docs += [(2 + i, "".join("b" if k < i else "a" for k in range(40))) for i in range(30)]
    lines = {(d, j): x for d, j, x in lines_of(docs)}
    want = removed_by_brute_force(lines_of(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["line"]) for r in linededup.removed_lines(df).collect()}
    assert got == want and len(lines) - len(got) > 20
    assert all(any(edit_distance(lines[k], lines[o]) <= 2 for o in lines if o < k and o not in got) for k in got)


def test_common_lines_are_joined_by_size(spark, monkeypatch):
    from kilnmark.llm import _shared

    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(9000)], "k long, v long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least")).filter("k <> 5")
    want = sorted(map(tuple, rows.join(table, "k").collect()))
    monkeypatch.setattr(_shared, "SHARE", 1 / 4)
    assert sorted(map(tuple, _shared.join_by_size(rows, table, "k", "n").collect())) == want


def test_short_lines(spark):
    """Every line with a mark takes part: exactly below 8 characters, with one edit below 16, with two from there on."""
    rng = random.Random(11)
    texts = ["\n".join("".join(rng.choice("ab") for _ in range(rng.choice((0, 1, 3, 6, 7, 8, 9, 12, 15, 16, 17)))) for _ in range(4)) for _ in range(60)]
    texts += ["Les.\nyes\n \n\t\n你好。\nA short line", "Les.\nyet\n \n\t\n你好。\nA short lime", "Les.\nA shirt lima"]
    want = removed_by_brute_force(lines_of(enumerate(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {(r["doc_id"], r["line"]) for r in linededup.removed_lines(df).collect()} == want
    assert {(61, 0), (61, 4), (61, 5), (62, 0)} <= want and not {(61, 1), (61, 2), (61, 3), (62, 1)} & want


# --- 8, 9


def test_language(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_language_id(spark, sf).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(langs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.95
    out = {r["doc_id"]: r for r in langid.predict(odd).collect()}
    assert len(out) == 10 and out[1]["lang_pred"] == out[2]["lang_pred"] == out[3]["lang_pred"] == "und" and out[5]["lang_pred"] == "en"
    assert langid.predict(empty).count() == 0


def test_convolution_by_plain_loops():
    """Probabilities of the multiplied-out tables against the network written out, window by window."""
    rng = np.random.default_rng(3)
    net = langid.Net(["a", "b", "c"], seed=5)
    net.out = rng.normal(size=net.out.shape).astype(np.float32)
    net.out_bias = rng.normal(size=3).astype(np.float32)
    net.bias = [rng.normal(size=b.shape).astype(np.float32) for b in net.bias]
    net.multiply_out()
    texts = ["", "Ab 1?", "Straße und Haus " * 90, "x" * 512, "é" * 300]
    raw = [t.encode() for t in texts]
    got = net.probabilities(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, p in zip(raw, got, strict=True):
        padded = [int(langid._FOLD[c]) for c in t] + [0] * 8
        total, weights = np.zeros(3), 0
        for at in range(0, max(1, len(t)), langid.WINDOW):
            end = min(at + langid.WINDOW, len(t))
            last = end + max(langid.WIDTHS) if end == len(t) else end
            pooled = []
            for w, f, b in zip(langid.WIDTHS, net.filters, net.bias, strict=True):
                z = [np.concatenate([net.embed[(padded + [0] * 8)[i + j]] for j in range(w)]) @ f + b for i in range(at, last)]
                pooled.append(np.max(z, axis=0))
            h = np.maximum(np.concatenate(pooled), 0)
            q = np.exp(h @ net.out + net.out_bias)
            size = max(1, end - at)
            total, weights = total + size * q / q.sum(), weights + size
        assert np.allclose(p, total / weights, atol=1e-4)


def test_stems_start_words_within_an_edit():
    rng, stems = random.Random(4), ("achlich", "boco", "idioti")
    a = toxicity.Automaton(stems, toxicity.stem_edits, stems=True)
    for _ in range(2000):
        w = list(rng.choice(stems) + rng.choice(["", "en", "xxxx"]))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(["", "x", "bo"])
            w = w or ["a"]
        word = "".join(w) or "a"
        want = min((d for t in stems for k in range(len(word) + 1) if (d := edit_distance(t, word[:k])) <= toxicity.stem_edits(t)), default=99)
        raw = np.frombuffer(word.encode(), np.uint8)
        assert a.distances(raw, np.array([0]), np.array([len(raw)]))[0] == want


def test_contexts_by_plain_python():
    """Counts of exact and near hits, aimed, plain or quoted, against a loop over words."""
    rng = random.Random(6)
    stems = ["schwach", "tonto"]
    automata = toxicity.Scorer(stems=stems).automata
    bits = ["idiot", "ldiot", "Moron", "schwachkopf", "tontos", "the", "you", "du", "said", "Wort", "tree", "house", "sky", "and", "runs", '"idiot"', "«tonto»", "„idiot“", "'moron", "été"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    got = toxicity.features(automata, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, x in zip(texts, got, strict=True):
        spans = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9é]+", t)]
        words = ["".join(c.lower() if c.isascii() else c for c in t[a:b]) for a, b in spans]
        want, kinds = np.zeros(toxicity.COUNTS), set()
        for i, (w, (a, b)) in enumerate(zip(words, spans, strict=True)):
            near = {words[j] for j in range(max(0, i - 6), min(len(words), i + 7)) if j != i}
            quoted = (t[:a].endswith(tuple('"“„«\'‘')) and t[b:].startswith(tuple('"”“»\'’'))) or bool(near & set(toxicity.QUOTING))
            kind = 2 if quoted else 0 if near & set(toxicity.AIMING) else 1
            whole = min((d for s in toxicity.LEXICON if (d := edit_distance(s, w)) <= toxicity.edits_allowed(s)), default=99)
            start = min((d for s in stems for k in range(len(w) + 1) if (d := edit_distance(s, w[:k])) <= toxicity.stem_edits(s)), default=99)
            if whole < 99:
                want[kind + 3 * (whole > 0)] += 1
            if start < 99:
                want[6 + kind + 3 * (start > 0)] += 1
                kinds.add(w)
        want[toxicity.TERMS], want[toxicity.TERMS + 1] = len(kinds), 100 * want[: toxicity.TERMS].sum() / max(1, len(words))
        assert x.tolist() == pytest.approx(want.tolist())


def test_levenshtein_automaton():
    rng, terms = random.Random(1), ("idiot", "moron", "disgusting", "abc")
    a = toxicity.Automaton(terms)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(["", "x", "iz"])
            if not w:
                w = ["a"]
        word = "".join(w) or "a"
        want = min((d for t in terms if (d := edit_distance(t, word)) <= toxicity.edits_allowed(t)), default=99)
        raw = np.frombuffer(word.encode(), np.uint8)
        assert a.distances(raw, np.array([0]), np.array([len(raw)]))[0] == want


def test_toxicity(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in queries.op9_toxicity(spark, sf).collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(d, y) for d, y in labels if rows[d]["held_out"]]
    assert all(rows[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, _ in labels)
    assert np.mean([rows[d]["predicted"] == y for d, y in held]) > 0.97
    out = toxicity.score(odd, None).collect()
    assert len(out) == 11 and all(r["predicted"] == 0 for r in out) and toxicity.score(empty, None).count() == 0
    said = spark.createDataFrame([(1, "you are such an idiot"), (2, 'the word "idiot" is an insult'), (3, "you ldiot you"), (4, "nothing here")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(said, None).collect()}
    assert s[1] > 0.5 > s[2] and s[1] >= s[3] > s[4]
    assert toxicity.keep_clean(odd, None).columns == odd.columns and toxicity.keep_clean(odd, None).count() == 11


# --- 10


def test_licenses(spark, sf, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r["doc_id"], r["line"]) for r in licenses.scan(docs).collect() if r["unit"] == "line"}
    index = licenses.Index()

    def words(x):
        return re.sub(r"[^0-9a-z\u0080-\U0010ffff]+", " ", x.lower()).split()

    def dice(a, b):
        from collections import Counter

        x, y = (Counter(zip(w, w[1:])) for w in (a, b))
        return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))

    templates = [words(t) for _, t in licenses.TEMPLATES]
    want = {(r["doc_id"], j) for r in docs.collect() for j, x in enumerate(r["text"].split("\n")) if len(words(x)) > 1 and max(dice(words(x), t) for t in templates) >= index.least}
    assert got == want
    one = spark.createDataFrame([(1, "A long introduction of many words that tell of nothing.\n\nReleased under the\nMIT License.\n\nThe end of it all.")], "doc_id long, text string")
    assert [(r["license"], r["unit"], r["line"]) for r in licenses.scan(one).collect()] == [("MIT", "paragraph", 2)]
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0


def test_licence_texts_and_windows(spark):
    """Bodies of licences, whole and within longer texts, and notices inside a longer line."""
    body = dict(licenses.TEXTS)
    around = "Some words that have nothing to do with it stand here, and quite a number of them too, so that the whole is long. " * 12
    rows = [
        (1, "Copyright 2024 Foo Inc. Licensed under the MIT License. See LICENSE for details."),
        (2, "Copyright 2024 Foo\n\n" + body["MIT"]),
        (3, "ISC License\n\n" + body["ISC"].replace("\n", " ")),
        (4, body["Unlicense"]),
        (5, "Copyright 2024 Foo\n" + body["BSD-2-Clause"]),
        (6, "Copyright 2024 Foo\n" + body["BSD-3-Clause"]),
        (7, around + body["Zlib"].replace("\n", " ") + " " + around + " Licensed under CC BY 4.0. " + around),
        (8, around),
    ]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["unit"], r["dice"]))
    assert got[1] == [("MIT", "window", 1.0)]
    assert {i: {x[0] for x in got[i]} for i in (2, 3, 4, 5, 6)} == {2: {"MIT"}, 3: {"ISC"}, 4: {"Unlicense"}, 5: {"BSD-2-Clause"}, 6: {"BSD-3-Clause"}}
    assert got[7] == [("Zlib", "window", 1.0), ("CC-BY-4.0", "window", 1.0)] and 8 not in got


# --- shared


def test_chunks_and_words():
    texts = pa.array(["Ab  c", None, "", "x\ty\n", "É é"])
    out = []
    for lo, hi, data, offsets in _text.chunks(texts, 4):
        starts, ends, rows, _ = _text.words(data, offsets)
        out += [(lo + r, data[a:b].tobytes().decode()) for a, b, r in zip(starts, ends, rows, strict=True)]
    assert out == [(0, "Ab"), (0, "c"), (3, "x"), (3, "y"), (4, "É"), (4, "é")]
    data, offsets = np.frombuffer(b"one two ONE", np.uint8), np.array([0, 11])
    h = _text.words(data, offsets)[3]
    assert h[0] == h[2] != h[1]
