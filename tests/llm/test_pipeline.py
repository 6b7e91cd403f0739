"""The pipeline's stages on planted cases, and run() as their sequence."""

import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from test_ops import components_of, lines_of, removed_by_brute_force, shingles

import corpus_pipeline as P
from kilnmark.llm import decontaminate, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")


def words(n, seed):
    return " ".join(f"{'abcdefghij'[(seed * 7 + i * i) % 10]}{(seed * 31 + i * 17) % 97}x{i % 13}" for i in range(n))


def test_stages(spark, tmp_path):
    item = "The committee of seven agreed after a long and very tiring debate that the northern bridge should be closed for repairs until the end of spring."
    rows = [(0, words(80, 1)), (1, words(80, 2)), (2, words(80, 1) + " tail"), (3, words(60, 3) + " " + item + " " + words(20, 4)), (4, "you are such an idiot, a pathetic moron and you are trash"), (5, None), (6, ""), (7, words(70, 5) + "\n" + "this very line is repeated in several documents of the corpus"), (8, words(70, 6) + "\n" + "this very line is repeated in several documents of the corpus")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf, cur = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in P.STAGES[:-1]:
        cur = stage(spark, cur, sf)
        assert cur.columns == docs.columns
        kept[name] = {r["doc_id"]: r for r in cur.collect()}
    assert set(kept["toxicity"]) == {0, 1, 2, 3, 5, 6, 7, 8}
    assert "repeated" in kept["line_dedup"][7]["text"] and "repeated" not in kept["line_dedup"][8]["text"]
    assert kept["line_dedup"][8]["n_chars"] == len(kept["line_dedup"][8]["text"])
    assert set(kept["ngram_jaccard"]) == {0, 1, 3, 5, 6, 7, 8}
    assert set(kept["decontamination"]) == {0, 1, 5, 6, 7, 8}
    packed = {r["doc_id"] for r in P.run(spark, sf).collect()}
    assert packed == {0, 1, 5, 6, 7, 8}


def plain_run(rows, items, labels):
    """The stages by loops over rows (doc_id, text) and plain Python; toxic rows by the lexicon, as without labels."""
    words = lambda t: [w.lower() for w in re.findall(r"[A-Za-z0-9]+", t or "")]
    rows = [r for r in rows if not any(w in toxicity.LEXICON for w in words(r[1]))]
    gone = removed_by_brute_force(lines_of([r for r in rows if r[0] is not None]))
    left = []
    for d, t in rows:
        drop = {j for e, j in gone if e == d} if d is not None else ()
        kept = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in drop) if t else t
        if not drop or kept.strip(" \t\n\r"):
            left.append((d, kept))
    group = components_of({d: shingles(t, 5) for d, t in left if d is not None}, Fraction(4, 5))
    left = [(d, t) for d, t in left if d is None or group[d] == d]
    flat = lambda t: " ".join((t or "").lower().split())

    def leaks(t):
        for i in items:
            x, size = flat(i), decontaminate.PATTERN
            if len(x) < decontaminate.Q + decontaminate.LEAST - 1:
                if flat(t) == x:
                    return True
                continue
            starts = {*range(0, max(1, len(x) - size), decontaminate.STRIDE), max(0, len(x) - size)}
            for p in (x[a : a + size] for a in starts):
                row = [0] * (len(flat(t)) + 1)
                for c in p:
                    new = [row[0] + 1]
                    for j, y in enumerate(flat(t)):
                        new.append(min(row[j] + (c != y), row[j + 1] + 1, new[-1] + 1))
                    row = new
                if min(row) <= decontaminate.budget(len(p)):
                    return True
        return False

    return [(d, t) for d, t in left if not leaks(t)]


def test_run_against_brute_force(spark, tmp_path):
    """Whole result on documents with copies, near copies, repeated lines, leaks, nulls, ties, repeated rows and clashing columns."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("bcdfghklmnprtw") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [say(30), "  - " + say(12) + "\n    - " + say(14), "ok"]
    shared = [say(9) for _ in range(4)]
    rows = []
    for i in range(60):
        kind = rng.randrange(8)
        if kind == 0 and rows:
            t = rng.choice(rows)[1]
        elif kind == 1 and rows:
            w = (rng.choice(rows)[1] or "").split(" ")
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            t = " ".join(w)
        elif kind == 2:
            t = say(20) + "\n" + rng.choice(items[:2]).replace("  ", " \n") + "\n" + say(5)
        elif kind == 3:
            t = say(15) + " you moron " + say(5)
        elif kind == 4:
            t = "\n".join([say(12), rng.choice(shared), say(13), rng.choice(shared)[:-1]])
        elif kind == 5:
            t = rng.choice([None, "", " \n", "ok", "Ok."])
        else:
            t = say(rng.randrange(3, 50))
        rows.append((i, t))
    rows += [(None, say(20)), (None, items[0]), (None, None), (100, say(25)), (100, rows[-1][1])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, class string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = P.run(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(((d, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for d, x in plain_run(rows, items, None)), key=str)
    assert sorted(((r["doc_id"], r["ids_crc32"]) for r in got), key=str) == want and 20 < len(want) < len(rows)


def test_empty(spark, sf, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
