"""Operators against brute force, on documents with every kind of odd row."""

import binascii
import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontamination, language, lines, mixture, near_duplicates, passages, quality, secrets, sharding
from ledgerloom.llm import textarrays as ta
from ledgerloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(got, want):
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, None) for i in range(70)] + [(3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_counts(docs, rows, labels):
    want = []
    for doc_id, text, *_ in rows:
        w, s = words(text), text or ""
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) for j in range(3) if windows[tuple(w[k : k + 3])] > 1}
        held = [x for x in s.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in s), len(held) - len(set(held)), len(covered), failed))
    out = quality.quality(docs, labels).cache()
    same(out.drop("kept", "p_quality").collect(), want)
    assert out.filter("kept AND base_failed").count() == 0
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.filter("kept").count()


def test_quality_without_labels(docs, none, labels):
    out = quality.quality(docs, labels.filter("quality = 1"))
    assert out.filter("kept = base_failed OR p_quality IS NOT NULL").count() == 0
    assert quality.quality(none, labels).count() == 0


def test_quality_learns(spark):
    rng = random.Random(1)
    good, bad = "the of and to in that".split(), "###x $$y &&& win||".split()
    rows = [(i, " ".join(rng.choices(bad if i % 3 == 0 else good, k=80)) + f" {i}", 0 if i % 3 == 0 else 1) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(table.filter("doc_id < 200"), table.filter("doc_id < 200"))
    out = quality.score(table.filter("doc_id >= 200"), model).select("doc_id", "p_quality").collect()
    assert all((p >= 0.5) == (i % 3 != 0) for i, p in out)


SECRET = 'x = 1 password: "abc123" and token: pass: abcdefg AKIA' + "A" * 16 + " AKIAB " + "0123456789abcdef" * 2 + " API-key=zzzzzzz apikey = zzzzzzz ghp_" + "a" * 36


def test_secrets_and_ledger(spark, docs, none, folder):
    kinds = [k for k, _, _ in secrets.find(SECRET)]
    assert Counter(kinds) == {"assign": 2, "access": 1, "hex": 2, "github": 1}
    assert secrets.find("ſecret=abcdefgh") == []
    extra = spark.createDataFrame([(200, SECRET), (201, SECRET), (None, SECRET)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(extra)
    path = f"{folder}/ledger"
    first = secrets.secrets(table, path).cache()
    assert first.count() == table.count()
    assert first.filter(F.size("findings") > 0).count() == 3
    rows = spark.read.parquet(path).count()
    assert rows == table.select(F.coalesce("text", F.lit(""))).distinct().count()
    more = table.unionByName(spark.createDataFrame([(202, "new secret=abcdefgh")], "doc_id long, text string"))
    again = secrets.secrets(more, path)
    assert again.filter(F.size("findings") > 0).count() == 4
    assert spark.read.parquet(path).count() == rows + 1
    secrets.secrets(more, path, version="2").count()
    assert spark.read.parquet(path).count() == 2 * (rows + 1)
    assert secrets.secrets(none).count() == 0


def test_mixture(docs, rows, none):
    out = mixture.mixture(docs, block_words=8).cache()
    same(out.select("doc_id", "size").collect(), [(r[0], len(words(r[1]))) for r in rows])
    assert out.filter("taken > 3 * size").count() == 0
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    names = sorted((s for s in sizes if s is not None)) + [None]
    targets = mixture.waterfill([sizes[s] for s in names], [i % 3 + 1 for i in range(len(names))])
    assert abs(sum(targets) - sum(sizes.values())) < 1e-6
    got = {t for (t,) in out.select("target").distinct().collect()}
    assert np.allclose(sorted(got), sorted(set(targets)))
    taken = out.groupBy("target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(t - target) <= 0.05 * target + 16 for target, t in taken)
    # another layout of the input gives every document the same number of words
    key = lambda r: tuple((v is None, v) for v in r)
    taken = lambda d: sorted(map(tuple, mixture.mixture(d, block_words=8).select("doc_id", "size", "target", "taken").collect()), key=key)
    assert taken(docs) == taken(docs.repartition(7)) == taken(docs.coalesce(1).orderBy(F.rand(3)))
    assert mixture.mixture(none).count() == 0


def test_mixed_documents(docs, none):
    made = mixture.mixed_documents(docs, block_words=8).cache()
    assert made.columns == docs.columns
    plan = mixture.mixture(docs, block_words=8)
    total = made.select(F.sum(F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+")))).first()[0]
    assert total == plan.agg(F.sum("taken")).first()[0]
    assert made.filter("n_chars <> length(text)").count() == 0
    assert mixture.mixed_documents(none).count() == 0


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000])
def test_permutation(size):
    assert sorted(mixture.permute(np.arange(size), size, 99).tolist()) == list(range(size))


def test_waterfill_stops_small_sources():
    assert mixture.waterfill([10, 1000, 0], [3, 1, 2]) == pytest.approx([30, 980, 0])


def test_draws_use_every_slot_once():
    slots = np.array([1000, 17, 0, 333])
    drawn = [d for g in range(5) for d in mixture.draw_group(g, 5, slots, shard_slots=64)]
    assert sum(d[1] for d in drawn).tolist() == slots.tolist()
    for s in range(4):
        numbers = [n for _, count, first in drawn for n in range(first[s], first[s] + count[s])]
        assert sorted(numbers) == list(range(slots[s]))


def test_substring_dedup(docs, rows, none, monkeypatch):
    for size in (None, 200):
        if size:
            monkeypatch.setattr(ta.chunks, "__defaults__", (size,))
        windows = Counter(tuple(w[k : k + 35]) for w in (words(r[1]) for r in rows) for k in range(len(w) - 34))
        want = []
        for r in rows:
            w = words(r[1])
            gone = [False] * len(w)
            for k in range(len(w) - 34):
                if windows[tuple(w[k : k + 35])] > 1:
                    gone[k : k + 35] = [True] * 35
            kept = " ".join(x for x, g in zip(w, gone) if not g)
            want.append((r[0], len(w), sum(gone), sha(kept), kept))
        same(passages.substring_dedup(docs, texts=True).collect(), want)
    assert passages.substring_dedup(none).count() == 0


def jaccard(x, y):
    """Probability Jaccard by its definition."""
    out = 0.0
    for i in x.keys() & y.keys():
        out += 1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys())
    return out


def test_similarity_by_definition():
    rng = random.Random(3)
    for _ in range(50):
        x, y = (Counter(rng.choices(range(12), k=rng.randint(1, 30))) for _ in range(2))
        arrays = [np.array(v) for c in (x, y) for v in (sorted(c), [c[k] for k in sorted(c)])]
        assert near_duplicates.similarity(*arrays) == pytest.approx(jaccard(x, y))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    h = ta.mix(np.arange(300, dtype=np.uint64))
    text = np.concatenate([np.zeros(200, int), np.ones(200, int)])
    keys = np.concatenate([h[:200], h[100:]])
    weight = np.concatenate([rng.integers(1, 4, 200), rng.integers(1, 4, 200)]).astype(float)
    agree = []
    for turn in range(40):
        s = near_duplicates.signatures(text, ta.mix(keys + np.uint64(turn << 20)), weight, 2)
        agree.append((s[0] == s[1]).mean())
    x, y = (Counter(dict(zip(keys[text == t].tolist(), weight[text == t]))) for t in (0, 1))
    assert np.mean(agree) == pytest.approx(jaccard(x, y), abs=0.03)


def test_components_of_chains_stars_and_random_links(spark):
    draw = random.Random(5)
    links = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)] + [(i, 300) for i in range(301, 330)]
    links += [(draw.randrange(400, 500), draw.randrange(400, 500)) for _ in range(80)] + [(7, 7), (8, 9), (9, 8), (8, 9)]
    label = {n: n for link in links for n in link}
    for _ in range(len(label)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    alone = {a for a, b in links if a == b} - {n for a, b in links if a != b for n in (a, b)}
    same(components(spark.createDataFrame(links, "a long, b long")).collect(), [(n, c) for n, c in label.items() if n not in alone])
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates(docs, rows, none):
    texts = sorted({r[1] or "" for r in rows})
    sets = {}
    for t in texts:
        w = words(t)
        sets[t] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if sets[a].keys() & sets[b].keys() and jaccard(sets[a], sets[b]) >= 0.8:
                parent[root(a)] = root(b)
    ids = defaultdict(list)
    for r in rows:
        ids[root(r[1] or "")].append(r[0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    out = near_duplicates.near_duplicates(docs)
    same(out.select("doc_id", "class_id").collect(), [(r[0], least[root(r[1] or "")]) for r in rows])
    kept = near_duplicates.without_near_duplicates(docs).cache()
    assert kept.columns == docs.columns and kept.count() == len(ids)
    assert {r["doc_id"] for r in kept.collect()} == set(least.values())
    assert near_duplicates.near_duplicates(none).count() == 0 and near_duplicates.without_near_duplicates(none).count() == 0


def test_chunked_groups_lose_no_link(docs, monkeypatch):
    whole = near_duplicates.near_duplicates(docs).select("doc_id", "class_id").collect()
    monkeypatch.setattr(near_duplicates, "CHUNK_NODES", 3)
    same(near_duplicates.near_duplicates(docs).select("doc_id", "class_id").collect(), [tuple(r) for r in whole])


def test_written_shards_read_back(spark, tmp_path):
    rows = [(1, "1"), (2, "01"), (3, "00"), (4, "")]
    sharding.write_shards(spark.createDataFrame(rows, "doc_id long, shard string"), str(tmp_path / "shards"))
    same(spark.read.parquet(str(tmp_path / "shards")).select("doc_id", "shard").collect(), [(i, f"s{b}") for i, b in rows])


def test_chunked_families_and_templates_equal_all_pairs(spark, monkeypatch):
    draw = random.Random(11)
    texts = []
    for family in range(3):
        base = [f"f{family}w{k}" for k in range(90)]
        for _ in range(25):
            text = list(base)
            for _ in range(draw.randrange(1, 5)):
                text[draw.randrange(90)] = f"x{draw.randrange(10**9)}"
            texts.append(" ".join(text))
    template = [f"t{k}" for k in range(60)]
    for i in range(40):
        texts.append(" ".join([*template, *[f"own{i // 2 if i < 10 else i}v{k}" for k in range(30)], *(["end"] if i % 2 else [])]))
    rows = [(i, t) for i, t in enumerate(texts + texts[::7])] + [(0, texts[0]), (80, texts[80])]
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in texts]
    lead = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                lead = [lead[j] if x == lead[i] else x for x in lead]
    number = {t: i for i, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        least[lead[number[t]]] = min(i, least.get(lead[number[t]], i))
    assert 30 < len(least) < len(texts)
    monkeypatch.setattr(near_duplicates, "CHUNK_NODES", 7)
    monkeypatch.setattr(near_duplicates, "PIVOTS", 2)
    # all of one bucket's nodes are candidates: one group of everything
    monkeypatch.setattr(near_duplicates, "candidate_groups", one_group)
    out = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    same(out.select("doc_id", "class_id").collect(), [(i, least[lead[number[t]]]) for i, t in rows])


def one_group(nodes):
    least = nodes.agg(F.min("node").alias("label"))
    return nodes.select("node").crossJoin(least), nodes.select(F.col("node").alias("low"), F.lit(1).cast("long").alias("n"))


def test_prefixes_of_alike_texts_meet():
    draw = random.Random(2)
    for _ in range(300):
        keys = np.array(sorted(draw.sample(range(1000), 40)), np.uint64)
        other = np.array(sorted({*keys[draw.randrange(6) :].tolist(), *draw.sample(range(1000), draw.randrange(5))}), np.uint64)
        weights = [np.array([draw.randrange(1, 4) for _ in k], np.int32) for k in (keys, other)]
        if near_duplicates.similarity(keys, weights[0], other, weights[1]) >= 0.8:
            seen = np.array([draw.randrange(3) for _ in range(1000)])
            parts = [near_duplicates._prefix(k, w, seen[k.astype(int)]) for k, w in zip((keys, other), weights, strict=True)]
            assert set(parts[0].tolist()) & set(parts[1].tolist())


@pytest.mark.parametrize("limit", [200, 2000, 10**9])
def test_sharding(docs, rows, none, limit):
    out = sharding.sharded(docs, limit).cache()
    assert out.columns == [*docs.columns, "_shard", "shard_bits", "shard_bytes", "shard_rows", "oversized"]
    got = out.collect()
    same([r[: len(docs.columns)] for r in got], [tuple(r) for r in rows])
    shards = defaultdict(list)
    for r in got:
        shards[r["_shard"]].append(r)
    for bits, part in shards.items():
        total = sum(len((r["text"] or "").encode()) for r in part)
        assert all(r["shard_bytes"] == total and r["shard_rows"] == len(part) and r["oversized"] == (total > limit) for r in part)
        assert total <= limit or len(part) == 1
        # prefix-free
        assert not any(other != bits and other.startswith(bits) for other in shards)
        # only what had to be split was split
        parent = [r for other, p in shards.items() if bits and other.startswith(bits[:-1]) for r in p]
        assert not bits or sum(len((r["text"] or "").encode()) for r in parent) > limit
    assert sharding.sharded(none).count() == 0


def test_sharding_spreads_equal_rows(spark):
    table = spark.createDataFrame([(1, "x" * 10)] * 50, "doc_id long, text string")
    out = sharding.sharded(table, 40)
    assert out.count() == 50 and out.agg(F.max("shard_bytes")).first()[0] <= 40


def test_language(spark, docs, none):
    assert language.predict(docs, language.fit(docs.filter("lang IS NULL AND lang IS NOT NULL"))).filter("lang_pred <> 'und'").count() == 0
    rng = random.Random(4)
    parts = {"xx": ["ab", "ba", "aab"], "yy": ["éß", "ßé", "éé"], "zz": ["漢字", "字漢"]}
    rows = [(i, " ".join("".join(rng.choices(parts[k], k=3)) for _ in range(20)), k) for i in range(300) for k in [list(parts)[i % 3]]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = language.held_out(F.col("doc_id"))
    model = language.fit(table.filter(~held))
    got = language.predict(table, model).join(table, "doc_id").filter(held).collect()
    assert len(got) > 30 and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got)
    assert all((binascii.crc32(str(r["doc_id"]).encode()) % 4) == 2 for r in got)
    odd = language.predict(docs, model).filter("doc_id IN (100, 101, 102)").collect()
    assert [(r["lang_pred"], r["score"]) for r in odd] == [("und", 0.0)] * 3
    assert language.predict(none, model).count() == 0
    assert (model.table == 0).mean() > 0.9


def test_decontamination(spark, docs, rows, none, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate((4, 6, 11, 15, 30, 60))]
    planted = []
    for i, text in items:
        w = text.split()
        planted.append((300 + i, " ".join(rng.choices(vocabulary, k=20) + w + rng.choices(vocabulary, k=20)), w))
        if len(w) >= 30:
            w = [f"SUB{k}" if k % 14 == 7 else x.upper() + "," for k, x in enumerate(w)]
            planted.append((400 + i, " ".join(rng.choices(vocabulary, k=9) + w), w))
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([p[:2] for p in planted], "doc_id long, text string"))
    bench = spark.createDataFrame([*items, (None, items[5][1]), (50, None), (51, ""), items[5]], "item_id long, text string")
    want = {i: [k] for i, _, w in planted for k in [i % 100] if len(w) >= 5}
    for block in (17, 2):
        monkeypatch.setattr(decontamination, "BLOCK", block)
        out = decontamination.judged(table, bench).cache()
        assert out.count() == table.count()
        assert {r["doc_id"]: r["items"] for r in out.filter("contaminated").collect()} == want
        assert decontamination.cleaned(table, bench).count() == table.count() - len(want)
    assert decontamination.judged(none, bench).count() == 0
    assert decontamination.judged(table, bench.filter("false")).filter("contaminated").count() == 0


def test_overlaps_equal_all_items_against_all_documents(spark):
    rng = random.Random(13)
    # few words, so that seeds meet often and by chance
    line = lambda n, k=4: [f"w{rng.randint(1, k)}" for _ in range(n)]
    items = [(i, line(n)) for i, n in enumerate((3, 5, 8, 10, 11, 12, 13, 30, 60, 90))] + [(20, ["same"] * 40), (21, line(25, 2)), (5, line(40))]
    table = [(i, line(rng.randint(0, 120))) for i in range(25)] + [(30, ["same"] * 90), (31, line(20) + ["same"] * 15 + line(9)), (None, items[8][1]), (None, line(50))]
    for i in range(40, 60):
        own = list(items[rng.randint(6, 9)][1])
        for k in rng.sample(range(len(own)), len(own) // 14):
            own[k] = "other"
        table.append((i, line(rng.randint(0, 20)) + own + line(rng.randint(0, 20))))
    table += table[-2:]
    want = {}
    for doc, text in table:
        for item_id, item in items:
            for offset in range(1 - len(item), len(text)):
                low, high = max(0, -offset), min(len(item), len(text) - offset)
                equal = np.array([item[k] == text[k + offset] for k in range(low, high)], bool)
                masks = decontamination.masks_for(len(item), sum(map(len, item)))
                seeded = any(all(equal[p + i] for i, m in enumerate(mask) if m == "1") for mask in masks for p in range(len(equal) - len(mask) + 1))
                if seeded and (span := decontamination.verified(equal, len(item))):
                    most, start, end = span[0], offset + low + span[1], offset + low + span[2]
                    key = (doc, " ".join(text), item_id)
                    want[key] = max(want.get(key, (0, 0, 0)), (most, -start, end))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in table], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = decontamination.overlaps(docs, bench)
    prints = {r["fp"]: r["text"] for r in docs.select(F.xxhash64("text").alias("fp"), "text").collect()}
    got = {(r["doc_id"], prints[r["fp"]], r["item_id"]): (r["equal_tokens"], -r["from_token"], r["to_token"]) for r in found.collect()}
    assert len(want) > 20 and got == want
    kept = [tuple(r) for r in decontamination.cleaned(docs, bench).collect()]
    hit = {key[:2] for key in want}
    assert sorted(kept, key=str) == sorted([(i, " ".join(w)) for i, w in table if (i, " ".join(w)) not in hit], key=str)


def test_decontamination_of_clashing_columns_and_repetitive_texts(spark):
    item = " ".join(["same"] * 400)
    rows = [(1, " ".join(["same"] * 20_000), "a", 1), (2, None, "b", 2), (3, "", None, 3), (3, "", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, _TEXT_0 int").withColumn("tokens", F.lit(1)).withColumn("offsets", F.lit(2))
    bench = spark.createDataFrame([(7, item, 1)], "item_id long, text string, doc_id int")
    assert {r["doc_id"]: r["equal_tokens"] for r in decontamination.judged(docs, bench).collect()} == {1: 400, 2: 0, 3: 0}
    out = decontamination.cleaned(docs, bench)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["_TEXT_0"]) for r in out.collect()) == [(2, 2), (3, 3), (3, 3)]
    assert decontamination.cleaned(docs, bench.filter("false")).count() == 4


def test_verified_by_definition():
    rng = np.random.default_rng(6)
    for _ in range(300):
        equal = rng.random(int(rng.integers(1, 40))) < rng.choice([0.6, 0.9, 1.0])
        n = int(rng.integers(5, 20))
        runs = [(int(equal[a:b].sum()), -a, b) for a, b, _ in decontamination.stretches(equal)]
        enough = [r for r in runs if r[0] >= decontamination.needed(n)]
        want = max(enough, default=None)
        assert decontamination.verified(equal, n) == (want and (want[0], -want[1], want[2]))


def test_line_dedup(docs, rows, none):
    strip = lambda s: s.strip(" \t\n\r\x0b\x0c")
    spans = F.xxhash64("text")
    prints = {r["text"]: r["fp_"] for r in docs.select("text", spans.alias("fp_")).collect()}
    order = lambda r: (r[0] is not None, r[0] or 0, prints[r[1]])
    first, parts = {}, []
    for r in sorted(rows, key=order):
        full = [] if r[1] is None else r[1].split("\n")
        held = [k for k, line in enumerate(full) if WORD.search(line)]
        parts.append((r, full, held))
        for k in range(len(held) - lines.RUN + 1):
            first.setdefault(tuple(strip(full[i]) for i in held[k : k + lines.RUN]), (*order(r), k))
    want = []
    for r, full, held in parts:
        gone = set()
        for k in range(len(held) - lines.RUN + 1):
            if first[tuple(strip(full[i]) for i in held[k : k + lines.RUN])] != (*order(r), k):
                gone |= set(held[k : k + lines.RUN])
        text = None if r[1] is None else "\n".join(x for k, x in enumerate(full) if k not in gone)
        want.append((r[0], text, len(full), len(gone)))
    out = lines.deduplicated(docs)
    same(out.select("_row.doc_id", "text", "n_lines", "n_removed").collect(), want)
    assert sum(w[3] for w in want) > 10
    shorter = lines.line_dedup(docs)
    assert shorter.columns == docs.columns and shorter.filter("n_chars <> length(text)").count() == 0
    assert lines.line_dedup(none).count() == 0


@pytest.mark.parametrize("run", [1, 3, 6])
def test_line_dedup_of_other_lengths(spark, run):
    rng = random.Random(run)
    table = [(i, "\n".join(f" line {rng.randint(0, 30)}" if rng.random() < 0.9 else " " for _ in range(rng.randint(0, 12)))) for i in range(60)]
    copied = "\n".join(f"stands in short documents {k}" for k in range(run))
    table += [(100, copied), (101, copied), (102, None), (103, "")]
    first, want = {}, []
    for i, text in table:
        full = [] if text is None else text.split("\n")
        held = [k for k, line in enumerate(full) if line.strip()]
        gone = set()
        for k in range(len(held) - run + 1):
            if first.setdefault(tuple(full[j].strip() for j in held[k : k + run]), (i, k)) != (i, k):
                gone |= set(held[k : k + run])
        want.append((i, None if text is None else "\n".join(x for k, x in enumerate(full) if k not in gone), len(full), len(gone)))
    out = lines.deduplicated(spark.createDataFrame(table, "doc_id long, text string"), run)
    same(out.select("_row.doc_id", "text", "n_lines", "n_removed").collect(), want)
    assert next(w[3] for w in want if w[0] == 101) == run


def test_line_fingerprints_are_winnowed(spark):
    rng = random.Random(3)
    table = spark.createDataFrame([(i, [rng.randint(-3, 3) for _ in range(n)]) for i, n in enumerate((0, 4, 5, 6, 40, 200))], "doc_id long, h array<long>")
    gram = lambda k: F.xxhash64(*[F.get("h", F.lit(k + j)) for j in range(lines.GRAM)])
    grams = {r[0]: r[1] for r in table.select("doc_id", F.array(*[gram(k) for k in range(200)])).collect()}
    got = table.select("doc_id", F.size("h").alias("n"), lines._fingerprints(F.col("h"), lines.RUN).alias("s")).collect()
    for r in got:
        picked = {}
        for j in range(r["n"] - lines.RUN + 1):
            window = grams[r["doc_id"]][j : j + lines.WINDOW]
            picked.setdefault(j + window.index(min(window)), []).append(j)
        assert [(s["line"], s["print"], len(s["stretches"])) for s in r["s"]] == [(own[0], grams[r["doc_id"]][at], len(own)) for at, own in picked.items()]
    assert len(got[-1]["s"]) < 0.7 * (200 - lines.RUN + 1)


def test_every_stretch_of_an_offset_is_tested(spark):
    item = [f"w{k}" for k in range(32)]
    text = [x if k < 11 or 17 <= k and k not in (21, 26) else f"other{k}" for k, x in enumerate(item)]
    docs = spark.createDataFrame([(0, " ".join(["before"] * 3 + text))], "doc_id long, text string")
    found = decontamination.overlaps(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert [tuple(r)[2:] for r in found.collect()] == [(7, 13, 20, 35)]


def test_stretches_by_definition():
    rng = np.random.default_rng(8)
    for _ in range(300):
        equal = rng.random(int(rng.integers(0, 25))) < rng.choice([0.4, 0.7, 0.9])
        gain = [1 if e else -decontamination.PENALTY for e in equal]

        def split(a, b):
            """The best stretch (of these the longest, then the first), and the same left and right of it."""
            best = max(((sum(gain[i:j]), j - i, -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            score, size, i = best[0], best[1], -best[2]
            return [*split(a, i), (i, i + size, score), *split(i + size, b)]

        got = decontamination.stretches(equal)
        assert [s[2] for s in got] == [sum(gain[a:b]) for a, b, _ in got]
        assert sorted(s[2] for s in got)[-1:] == sorted(s[2] for s in split(0, len(equal)))[-1:]
        assert sum(int(equal[a:b].sum()) for a, b, _ in got) == int(equal.sum())
        assert all(a[1] < b[0] for a, b in zip(got, got[1:]))
        assert all(sum(gain[a:k]) > 0 and sum(gain[k:b]) > 0 for a, b, _ in got for k in range(a + 1, b))


def test_decontamination_without_spaces(spark):
    rng = random.Random(12)
    han, thai = ["".join(chr(k) for k in range(*r)) for r in ((0x4E00, 0x5200), (0x0E01, 0x0E2E))]
    clauses = lambda letters, *sizes: "\u3002".join("".join(rng.choices(letters, k=n)) for n in sizes)
    long_words = "Donaudampfschifffahrtsgesellschaft, Hauptversammlung"
    items = [(1, clauses(han, 14, 11)), (2, clauses(han, 9, 12, 8, 10, 7, 9)), (3, clauses(thai, 30)), (4, clauses(han, 7)), (5, clauses(han, 4)), (6, long_words), (7, "two short words")]
    around = lambda text, letters: "".join(rng.choices(letters, k=50)) + text + "".join(rng.choices(letters, k=50))
    table = [(i, around(f" {text} " if i > 5 else text, "abc " if i > 5 else thai if i == 3 else han)) for i, text in items]
    table += [(10, clauses(han, 300)), (11, clauses(thai, 300)), (12, long_words[:34]), (13, None)]
    changed = list(items[1][1])
    changed[15] = "x"
    table.append((14, around("".join(changed), han)))
    out = decontamination.judged(spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: r["items"] for r in out.filter("contaminated").collect()}
    assert got == {1: [1], 2: [2], 3: [3], 4: [4], 6: [6], 14: [2]}


def test_decontamination_builds_its_character_tables_in_little_memory():
    tracemalloc.start()
    inside, lower, _ = decontamination._token_tables.__wrapped__()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # each Python worker builds them; lists of all characters took above 100 MB
    for i in (*range(0, 0x110000, 13), 0x130, 0x4E00, 0x10FFFF):
        c = chr(i)
        assert inside[i] == c.isalnum() and chr(lower[i]) == (c.lower() if len(c.lower()) == 1 else c)
