"""Collocations, periodic runs and the boosted classifier against brute force, on documents with every kind of odd row."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cmp_to_key

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import boosted, collocations, runs
from ledgerloom.llm.queries import REGISTRY

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_phrases(rows, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= least}
        found = []
        for p, a in often.items():
            inside = [c for q, c in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if len(p) < 2 or any(100 * c >= 80 * a for c in inside):
                continue
            cuts = [(2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def made(seed, documents=240):
    """Documents of few words, so that many phrases are frequent, some just so, with ties and pieces."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(14)] + ["É", "漢字", "A", "a", "w1\xa0x"]
    phrase = ["New", "york", "city", "hall"]
    rows = []
    for i in range(documents):
        words = [rng.choice(vocabulary[: rng.choice([4, 19])]) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            words += phrase[: rng.randint(2, 4)]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "\r"]) for w in words)
        rows.append((i % 50 if i % 7 else None, text, [None, "en", "en", "und"][i % 4], "x", 1, None, None, None, None, None, None))
    return [*rows, *rows[:5], (1, None, "en", None, None, None, None, None, None, None, None), (2, "", None, None, None, None, None, None, None, None, None)]


@pytest.mark.parametrize(("seed", "shards", "block"), [(1, 3, 1 << 20), (2, 2, 70)])
def test_collocations(spark, docs, seed, shards, block):
    rows = made(seed)
    table = spark.createDataFrame(rows, docs.schema).repartition(3)
    got = collocations.collocations(table, least=9, top=40, shards=shards, block=block).collect()
    want = brute_phrases(rows, 9, 4, 40)
    assert len(want) > 60
    assert sorted(map(tuple, got)) == want


def test_collocations_of_odd_and_no_rows(docs, rows, none):
    assert sorted(map(tuple, collocations.collocations(docs, least=12).collect())) == brute_phrases(rows, 12, 4, 2000)
    assert collocations.collocations(none).count() == 0


def brute_runs(w, least, times):
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size, x = j - i + q, w[i : j + q]
            if j > i and size >= max(least, times * q) and not any(x[d:] == x[:-d] for d in range(1, q)):
                found.append((i, size, q))
            i = j if j > i else i + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_lyndon_arrays_and_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(400):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5])
        s = [rng.randrange(k) for _ in range(n)]
        if n > 4 and rng.random() < 0.5:
            p = 1 + rng.randrange(6)
            for i in range(max(p, rng.randrange(n)), n - rng.randrange(3)):
                s[i] = s[i - p]
        for order in (1, -1):
            t = [order * x for x in s]
            want = [next((j for j in range(i + 1, n) if t[j:] < t[i:]), n) - i for i in range(n)]
            assert runs.lyndon_array(t) == want
        for least, times in ((24, 3), (6, 2), (6, 3)):
            assert runs.runs_of([b"%d" % x for x in s], least, times) == brute_runs(s, least, times)


def test_runs_of_documents(spark, docs, rows, none):
    rng = random.Random(8)
    extra = []
    for i in range(2000, 2040):
        words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 200))]
        extra.append((i, " ".join(words + words[-rng.randint(1, 9) :] * 5), *rows[0][2:]))
    every = [r for r in rows if r[0] != 105] + extra
    out = runs.digest(runs.periodic_runs(spark.createDataFrame(every, docs.schema).repartition(3), runs.planted)).drop("n_words").collect()

    def better(x, y):
        return y[1] * x[2] - x[1] * y[2] or x[0] - y[0] or x[2] - y[2]

    want = []
    for doc_id, text, *_ in every:
        w = WORD.findall(text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        found = brute_runs(w, 24, 3)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = sorted(found, key=cmp_to_key(better))[0] if found else (None, None, None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    key = lambda r: tuple((v is None, v) for v in r)
    assert sum(r[1] > 0 for r in want) > 30
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    assert runs.periodic_runs(none).count() == 0


def test_boosted_trees_learn_and_score_every_row(spark, docs, none):
    rng = random.Random(1)
    words = ["the", "of", "and", "to", "in", "that", "reading"]
    table = [(i, ("".join(rng.choice(words) + (rng.choice([" ", ". "]) if i % 3 else "!! ") for _ in range(rng.randint(30, 90)))), 0 if i % 3 == 0 else 1) for i in range(900)]
    frame = spark.createDataFrame(table, "doc_id long, text string, quality int")
    held = boosted.held_out(F.col("doc_id"))
    assert {r[0] for r in frame.filter(held).select("doc_id").collect()} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    model = boosted.fit(frame.filter(~held), frame.filter(~held).select("doc_id", "quality"))
    out = boosted.scored(frame.filter(held), model).collect()
    assert np.mean([r.predicted == (r.doc_id % 3 != 0) for r in out]) > 0.97
    odd = boosted.scored(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in odd)
    assert boosted.scored(none, model).count() == 0
    one = frame.filter("quality = 1")
    assert all(r.score > 0.999 for r in boosted.scored(frame.limit(9), boosted.fit(one, one)).collect())
    assert boosted.fit(none, frame.filter("false")).score(np.zeros((1, len(boosted.STATISTICS)))) == [0.5]


def test_flattened_trees_equal_walked_ones():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (700, 5)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 2] > 6)).astype(np.int64)
    model = boosted.train(x, y)

    def walk(row, tree):
        node = 0
        while model.left[tree, node]:
            node = model.left[tree, node] + int(row[model.feature[tree, node]] > model.threshold[tree, node])
        return model.value[tree, node]

    plain = [model.base + sum(walk(r, k) for k in range(len(model.feature))) for r in x[:60]]
    assert np.allclose(model.logit(x[:60]), plain)
    assert np.mean((model.score(x) > 0.5) == y) > 0.99


def test_held_out_quality_of_the_given_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("quality IS NOT NULL")
    rows = REGISTRY["op13_classifier"](spark, folder).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_collocations_cut_texts_once_and_move_packed_counts(spark, docs):
    rows = made(3)
    table = spark.createDataFrame(rows, docs.schema).filter("text IS NOT NULL").selectExpr("coalesce(lang, 'und') lang", "text", "pmod(hash(text), 2) shard")
    cut = collocations._numbered(table.repartition(3), 4, 70, 2).cache()
    want, got = Counter(), Counter()
    for _, text, lang, *_ in rows:
        want.update(("und" if lang is None else lang, w) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)) for w in re.findall(r"[^\x20\x09]+", piece))
    blocks, hashes = cut.collect(), {}
    for r in blocks:
        ids, lang_of = (np.frombuffer(r[c], np.int32) for c in ("ids", "lang_of"))
        assert len(ids) == r["size"] + 4 and r["size"] <= 70
        words = bytes(r["words"]).split(b" ")
        for i in ids[: r["size"]][ids[: r["size"]] > 0]:
            got[r["langs"][lang_of[i]], words[i].decode()] += 1
        for i, h in enumerate(np.frombuffer(r["hashes"], np.uint64)):
            assert hashes.setdefault((lang_of[i] >= 0 and r["langs"][lang_of[i]], words[i]), h) == h
    assert got == want and len(set(hashes.values())) == len(hashes)
    # a scan sends a row for each block and bucket, not one for each phrase; sums part at the threshold
    packed = collocations._scan(cut, spark.sparkContext.broadcast((None, None)), 4, 3)
    assert packed.count() <= 8 * len(blocks) < sum(want.values())
    sums = collocations._merged(packed, 100).collect()
    often, rare = (np.concatenate([np.frombuffer(r[c], np.int64) for r in sums]) for c in ("n", "rare_n"))
    assert sorted([*often, *rare]) == sorted(want.values()) and often.min() >= 100 > rare.max()
