"""The corpus operators against brute force, and on awkward tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sparktab.llm import bpe, decontam, eliasfano, langid, license, ngramlm, packing, quality, queries, sharding, simhash, substring, tokenstore

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


PASSAGE = prose(70, 99)
LONG = prose(6000, 1)
ROWS = [
    (0, prose(120, 2), "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, "  \n\t ", "fr", "b"), (4, "one", "en", "b"), (5, "One TWO three", "de", "a"),
    (6, prose(120, 2), "en", "a"), (7, prose(120, 2), "en", "c"), (8, LONG, "en", "a"), (9, "x " * 300, "en", "b"), (10, prose(40, 3) + " " + PASSAGE + "  " + prose(30, 4), "en", "a"),
    (11, prose(20, 5) + "\n" + PASSAGE + " " + prose(60, 6), "fr", "a"), (12, "a  b   c   d　e \x00 f", None, "a"), (13, "Released under the MIT License.\nsecond line\n\nsecond line", "en", "d"),
    (14, "#*$ %& |<>\nsame line\nsame line\nsame line", "en", "d"), (15, "<|endoftext|> it's 12 34ab", "en", "d"), (15, "a repeated id", "en", "d"), (17, " lead and trail ", "es", "e"),
    (18, PASSAGE, "en", "f"), (19, LONG + " extra", "en", "f"), (None, "no id here", "en", None),
]
BENCH = [(1, prose(20, 5) + " " + prose(3, 7)), (2, "One two three"), (3, None), (4, ""), (10, PASSAGE), (11, PASSAGE + " tail"), (None, "one"), (5, "!!")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, None if r[1] is None else len(r[1]), "x", 1) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, first long").repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


OPERATORS = {
    "simhash": simhash.simhash_components, "langid": lambda d: langid.identify(d, queries.PIECES), "quality": quality.quality_rules, "license": lambda d: license.scan(d, "doc_id", F.concat("source", F.lit("/x"))),
    "sharding": lambda d: sharding.assign_shards(d, "doc_id"), "substring": substring.repeated_passages, "packing": lambda d: packing.pack(d, queries.TOKENIZER), "tokenstore": lambda d: tokenstore.store_and_index(d, queries.TOKENIZER), "lm": ngramlm.score_documents,
}


@pytest.mark.parametrize("name", [*OPERATORS, "decontam"])
def test_empty_and_awkward_tables(name, docs, bench):
    run = OPERATORS.get(name) or (lambda d: decontam.contamination_report(d, bench))
    assert run(docs.where("false")).collect() == []
    rows = run(docs).collect()
    if name == "packing":
        assert len({r.doc_id for r in rows}) == len({r[0] for r in ROWS})
    elif name != "substring":
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    words = WORD.findall(lower(text))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    keys, parent = sorted(set(prints)), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in itertools.combinations(keys, 2):
        if (a ^ b).bit_count() <= 4:
            parent[find(a)] = find(b)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("table", ["docs", "small"])
def test_simhash_is_brute_force(table, request):
    df = request.getfixturevalue(table).where("doc_id is not null")
    texts = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    prints = [fingerprint(t) for _, t in texts]
    root = brute_components(prints)
    least = {}
    for (i, _), p in zip(texts, prints, strict=True):
        least[root[p]] = min(least.get(root[p], i), i)
    want = sorted((i, f"{p:016x}", least[root[p]]) for (i, _), p in zip(texts, prints, strict=True))
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect())
    assert got == want


@pytest.mark.parametrize("hot", [50, 100_000])
def test_hot_nodes_are_divided_without_loss(spark, hot):
    r = np.random.default_rng(3)
    center = int(r.integers(0, 2**63))
    fps = sorted({center ^ sum(1 << int(b) for b in r.choice(30, r.integers(0, 9), replace=False)) for _ in range(700)} | {int(x) for x in r.integers(0, 2**63, 200)})
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), hot=hot).collect()
    assert all((u ^ v).bit_count() <= 64 for u, v in links)
    at = {f: i for i, f in enumerate(fps)}
    label = simhash.local_labels(len(fps), np.array([at[u] for u, _ in links]), np.array([at[v] for _, v in links]))
    root = brute_components(fps)
    groups = {}
    for f, x in zip(fps, label.tolist(), strict=True):
        groups.setdefault(x, set()).add(root[f])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(root.values()))


def test_nodes_come_whole_or_cut():
    r = np.random.default_rng(5)
    mask = np.sort(r.integers(1, 4, 900).astype(np.uint64)) << np.uint64(8)
    fp = (np.sort(r.integers(0, 4, 900)).astype(np.uint64) << np.uint64(8)) | r.integers(0, 256, 900).astype(np.uint64)
    order = np.lexsort((fp & mask, mask))
    mask, fp = mask[order], fp[order]
    want = Counter(zip(mask.tolist(), (fp & mask).tolist(), strict=True))
    for step, size, hot in ((7, 1, 50), (7, 100, 1000), (900, 10, 20), (64, 10, 60)):
        batches = [pa.record_batch([pa.array(x[a : a + step].view(np.int64)) for x in (mask, fp)], names=["mask", "fp"]) for a in range(0, 900, step)]
        got = Counter()
        for (m, f), runs in simhash._complete(iter(batches), size, hot):
            for a, b in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
                assert (int(m[a]), int(f[a] & m[a])) not in got
                got[int(m[a]), int(f[a] & m[a])] = b - a
        assert {k: min(n, hot + 1) for k, n in want.items()} == {k: min(n, hot + 1) for k, n in got.items()}


def test_components_of_a_chain(spark):
    from sparktab.llm.components import components

    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 100: 50}


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba"]
    keys = {}
    for p in pieces:
        h = None
        for c in p:
            h = langid._code_hash(np.array([ord(c)], np.uint32), h)
        keys[int(h[0])] = p
    order = sorted(keys)
    p = {k: 0.03 + 0.05 * i for i, k in enumerate(pieces)}
    model = langid.PieceModel(["x"], np.array(order, np.uint64), np.log([[p[keys[k]]] for k in order]), np.log([0.001]))

    def brute(word):
        if not word:
            return 1.0
        return sum((p.get(word[:n]) or (0.001 if n == 1 else 0.0)) * brute(word[n:]) for n in range(1, min(3, len(word)) + 1))

    words = ["a", "ab", "ababa", "bbaab", "abz", "zz"]
    got = langid.forward(model, words)[:, 0]
    assert np.allclose(got, [math.log(brute("▁" + w)) for w in words])


def test_long_words_are_scored_whole(monkeypatch):
    pieces = ["▁", "a", "b", "ab", "ba", "aab"]
    keys = {}
    for p in pieces:
        h = None
        for c in p:
            h = langid._code_hash(np.array([ord(c)], np.uint32), h)
        keys[int(h[0])] = p
    order = sorted(keys)
    p = {k: 0.05 + 0.04 * i for i, k in enumerate(pieces)}
    model = langid.PieceModel(["x"], np.array(order, np.uint64), np.log([[p[keys[k]]] for k in order]), np.log([0.001]), 3)
    r = random.Random(3)
    word = "".join(r.choice("ab") for _ in range(100_000))
    logs = [0.0]
    marked = "▁" + word
    for end in range(1, len(marked) + 1):
        parts = [logs[end - n] + math.log(p.get(marked[end - n : end]) or 0.001) for n in (1, 2, 3) if n <= end and (n == 1 or marked[end - n : end] in p)]
        top = max(parts)
        logs.append(top + math.log(sum(math.exp(x - top) for x in parts)))
    got = langid.forward(model, ["ab", word, "b"])[:, 0]
    assert math.isclose(got[1], logs[-1], rel_tol=1e-9) and got[0] > got[1]
    monkeypatch.setattr(langid, "CELLS", 50)
    some = [word[:n] for n in (3, 40, 7, 500, 1)]
    small = langid.forward(model, some)[:, 0]
    monkeypatch.undo()
    assert np.allclose(small, langid.forward(model, some)[:, 0])


def test_letters_are_letters():
    assert langid.letter_runs("Ab½c Ⅷ x²y 12 ١ ñÑ_z 漢字") == ["ab", "c", "x", "y", "ññ", "z", "漢字"]


def test_sample_is_the_least_hashes(spark):
    df = spark.range(0, 30_000).selectExpr("id as doc_id", "'t' as text", "if(id % 10 = 0, 'few', 'many') as lang")
    hashes = df.selectExpr("doc_id", "lang", "pmod(xxhash64(doc_id), 9007199254740992) as h").collect()
    want = set()
    for lang in ("few", "many"):
        want |= {i for _, i in sorted((r.h, r.doc_id) for r in hashes if r.lang == lang)[:50]}
    assert set(langid.sample_ids(df, 50, "doc_id", "text", "lang")) == want
    assert len(langid.sample_ids(df.where("doc_id < 100"), 50, "doc_id", "text", "lang")) == 10 + 50


def test_no_label_and_no_long_piece_is_left_out(spark, monkeypatch):
    assert max(map(len, langid.vocabulary_pieces(queries.PIECES))) > 12
    df = spark.createDataFrame([(i, "some words", f"l{i % 3}") for i in range(9)], "doc_id long, text string, lang string")
    model = langid.fit(df, queries.PIECES)
    assert model.languages == ["l0", "l1", "l2"] and model.longest > 12
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid.fit(df, queries.PIECES)


def test_language_accuracy_on_held_out_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(df, queries.PIECES).where("held_out").join(df.select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_of_texts_without_letters(docs):
    got = {r.doc_id: r for r in langid.identify(docs, queries.PIECES).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_quality_counts_are_brute_force(docs):
    got = Counter(tuple(r) for r in quality.quality_rules(docs).select("doc_id", *quality.COUNTS, "base_failed").collect())
    want = Counter()
    for i, text, *_ in ROWS:
        words = WORD.findall(text or "")
        wins = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        rep = {p for k in range(len(words) - 2) if wins[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = Counter(x for x in (text or "").split("\n") if WORD.search(x))
        n = len(words)
        want[(i, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(c - 1 for c in lines.values()), len(rep), n < 50 or 100 * len(rep) > 50 * n)] += 1
    assert got == want


def test_bad_host_goes_and_small_host_is_shrunk(spark):
    rows = [("good", False)] * 90 + [("good", True)] * 10 + [("bad", True)] * 95 + [("bad", False)] * 5 + [("tiny", True)] + [(f"h{i}", k < 1) for i in range(20) for k in range(20)]
    got = {r.host: r for r in quality.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean"), "host").collect()}
    assert got["bad"].host_rejected and not got["good"].host_rejected and not got["tiny"].host_rejected
    assert got["tiny"].host_rate < 1


MIT_TEXT = license.TEMPLATES["MIT"][-1]


def wrapped(text, n, lead):
    words = text.split()
    return "\n".join(lead + " ".join(words[i : i + n]) for i in range(0, len(words), n))


def test_licences_and_nearest_ancestor(spark):
    files = [("LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/LICENSE.txt", "Copyright (c) 2020 Somebody\n\n" + wrapped(MIT_TEXT, 9, "")), ("a/b/c/x.py", "print(1)"), ("a/y.py", "y"), ("z.py", None), ("q/w.py", "some words\nThis work is licensed under the GNU General Public License, version 3."), ("a/b/COPYING", "nothing of note")]
    files += [("q/v.c", "/*\n" + wrapped(license.TEMPLATES["GPL-2.0"][-1], 7, " * ") + "\n */\nint main() { return 0; }\n" + prose(80, 71)), ("q/u.txt", prose(60, 72) + " as said, it is Licensed under the BSD 2-Clause License. " + prose(60, 73)), ("d/whatever", wrapped(license.TEMPLATES["ISC"][-1], 5, "")), ("d/e.py", "e")]
    files += [(f"o/{i}.py", prose(30, 500 + i)) for i in range(30)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "id long, path string, text string")
    got = {r.path: r for r in license.scan(df, "id", F.col("path")).collect()}
    want = {"LICENSE": "Apache-2.0", "a/LICENSE.txt": "MIT", "a/b/c/x.py": "MIT", "a/y.py": "MIT", "z.py": "Apache-2.0", "q/w.py": "GPL-3.0", "a/b/COPYING": "MIT", "q/v.c": "GPL-2.0", "q/u.txt": "BSD-2-Clause", "d/whatever": "ISC", "d/e.py": "ISC"}
    assert {p: got[p].license for p in want} == want and {got[f"o/{i}.py"].license for i in range(30)} == {"Apache-2.0"}
    assert got["q/w.py"].line_no == 2 and got["q/w.py"].cosine > 0.99 and got["a/b/c/x.py"].license_dir == "a" and got["z.py"].license_dir == ""
    assert got["q/v.c"].line_no == 2 and got["d/whatever"].coverage > 0.9 and got["q/u.txt"].coverage < 0.1


def test_licence_cosine_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(license, "RARE", 10)
    r = random.Random(9)
    templates = {"X": ["one two three four", "five six five"], "Y": ["one two nine", "ten"]}
    some = "one two three four five six nine ten eleven twelve the of".split()
    texts = [" ".join(r.choice(some) for _ in range(r.randint(0, 14))) for _ in range(150)] + [None, "", "Ten!", "one, TWO\nnine"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    bags = [item_words(t) for t in texts]
    df_of = Counter(w for b in bags for w in set(b))
    n = len(texts)
    idf = lambda w: math.log((1 + n) / (1 + max(df_of[w], n // 10))) + 1
    vector = lambda words: {w: c * idf(w) for w, c in Counter(words).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    got = {r.id: (r.own_license, r.cosine) for r in license.own_licences(df, templates).collect()}
    for i, words in enumerate(bags):
        best = []
        for name, forms in sorted(templates.items()):
            for form in forms:
                t = vector(item_words(form))
                size = len(item_words(form))
                for k in range(max(1, len(words) - size + 1) if words else 0):
                    v = vector(words[k : k + size])
                    cosine = sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / norm(t)
                    if cosine >= license.THRESHOLD:
                        best.append((-round(cosine, 9), name))
        if best:
            assert got[i][0] == min(best)[1] and math.isclose(got[i][1], -min(best)[0], abs_tol=1e-8)
        else:
            assert got[i] == (None, None)


def test_sharding_fill_is_taken_in_turns():
    names, slots = ["a", "b", "c", "d"], 13
    taken, lists = {}, []
    for s in names:
        offset, skip = sharding._preference(s, slots)
        lists.append([(offset + j * skip) % slots for j in range(slots)])
    turn = 0
    while len(taken) < slots:
        k = turn % len(names)
        slot = next(x for x in lists[k] if x not in taken)
        taken[slot] = k
        turn += 1
    assert sharding.fill(names, slots) == [taken[i] for i in range(slots)]
    with pytest.raises(ValueError):
        sharding.fill(names, 12)
    many = Counter(sharding.fill([f"s{i}" for i in range(64)]))
    assert max(many.values()) - min(many.values()) <= 1


def test_sharding_moves_little_and_is_native(spark):
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    one = {r.doc_id: r.shard for r in sharding.assign_shards(ids, "doc_id", [f"n{i}" for i in range(10)]).collect()}
    two = {r.doc_id: r.shard for r in sharding.assign_shards(ids, "doc_id", [f"n{i}" for i in range(11)]).collect()}
    assert sum(one[k] != two[k] for k in one) < 0.3 * len(one)
    plan = sharding.assign_shards(ids, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_compact_windows_are_brute_force():
    r = np.random.default_rng(1)
    values, ptr, width = r.integers(0, 40, 300).astype(np.uint64), np.array([0, 0, 120, 123, 300]), 7
    got = set(zip(*(x.tolist() for x in substring.compact_windows(values, ptr, width)), strict=True))
    want = set()
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        for c in range(a, b):
            left, right = c, c
            while left > a and values[left - 1] > values[c]:
                left -= 1
            while right + 1 < b and values[right + 1] >= values[c]:
                right += 1
            if right - left + 1 >= width:
                want.add((left, c, right))
    assert got == want


@pytest.mark.parametrize("table", ["docs", "small"])
def test_all_exact_repeats_are_found(table, request):
    df = request.getfixturevalue(table).where("doc_id is not null")
    texts = sorted((r.doc_id, WORD.findall(lower(r.text))) for r in df.select("doc_id", "text").collect())
    found = {}
    for r in substring.repeated_passages(df).collect():
        found.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert r.first_id < r.doc_id
    seen, clean = {}, set()
    for i, words in texts:
        need = set()
        for k in range(len(words) - 49):
            gram = tuple(words[k : k + 50])
            if seen.setdefault(gram, i) != i:
                need.update(range(k, k + 50))
        assert need <= found.get(i, set())
        if not need:
            clean.add(i)
    if table == "docs":
        assert clean == set(range(20)) - {6, 7, 11, 18, 19} - {16} and not clean & set(found)


def test_near_repeat_is_found_and_cut(spark):
    words = prose(400, 11).split()
    changed = [w if i % 60 else "zzz" for i, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words), 7), (2, prose(80, 12) + "\n" + " ".join(changed) + "\t" + prose(80, 13), 7), (3, " ".join(words), 7)], "doc_id long, text string, n_chars long")
    passages = substring.repeated_passages(df)
    total = {r.doc_id: r.n for r in passages.groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()}
    assert total[2] > 330 and total[3] == 400 and 1 not in total
    left = {r.doc_id: r for r in substring.without_repeats(df, passages).collect()}
    assert set(left) == {1, 2} and left[1].n_chars == 7 and left[2].n_chars == len(left[2].text) and left[2].text.startswith(prose(80, 12))


def test_short_near_repeats_are_found(spark):
    r = random.Random(17)
    fresh = lambda n: [f"{r.getrandbits(28):07x}" for _ in range(n)]
    rows, kinds = [], {}
    for size, changed in itertools.product((51, 55, 60), (1, 2, 5)):
        for _ in range(200):
            passage, i = fresh(size), 2 * len(kinds)
            middle = size // 2 - changed // 2
            copy = passage[:middle] + fresh(changed) + passage[middle + changed :]
            lead = [r.randint(60, 150) for _ in range(2)]
            texts = [" ".join(fresh(n) + x + fresh(r.randint(60, 150))) for n, x in zip(lead, (passage, copy), strict=True)]
            hashes, ptr = substring.shingle_hashes(substring.Words(pa.array(texts, pa.large_string())))
            first, own = (x >> np.uint64(32) for x in (hashes[: ptr[1]], hashes[ptr[1] :]))
            line = ((lead[0] - lead[1]) // substring.SHIFT, 0, len(own))
            kinds[i + 1] = (size, changed) if substring.repeats(own, [(i, [line], [(0, len(first))], first)], 46, 5, 0.8) else None
            rows += [(i, texts[0]), (i + 1, texts[1])]
    rows += [(len(rows) + k, " ".join(fresh(300))) for k in range(200)]
    got = {x.doc_id for x in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    wanted, found = Counter(kinds.values()), Counter(kinds[i] for i in got)
    assert all(wanted[k] >= 190 and found[k] >= 0.99 * wanted[k] for k in wanted if k) and None not in found


def test_repeats_do_not_depend_on_partitions(spark, small):
    wanted = None
    for parts in (1, 3, 16):
        got = sorted(map(tuple, substring.repeated_passages(small.repartition(parts)).collect()))
        assert wanted is None or got == wanted
        wanted = got


def brute_repeats(rows, width=46, need=37, step=substring.SHIFT):
    """Words of each document that repeat an earlier one, from all pairs and all places."""
    names, docs, found = {}, [], {}
    for i, text in rows:
        words = WORD.findall(lower(text))
        docs.append((i, np.array([names.setdefault(tuple(words[k : k + 5]), len(names)) for k in range(len(words) - 4)], np.int64)))
    for (i, own), (j, other) in itertools.product(docs, docs):
        if i is None or j is None or j >= i or np.isin(own, other).sum() < need:
            continue
        at, there = np.nonzero(own[:, None] == other[None, :])
        diagonal = (there - at) // step
        for k in range(diagonal.min() - 1, diagonal.max() + 2):
            hit = np.zeros(len(own), bool)
            hit[at[abs(diagonal - k) <= 1]] = True
            for a in range(len(own) - width + 1):
                if hit[a : a + width].sum() >= need:
                    inside = a + np.flatnonzero(hit[a : a + width])
                    found.setdefault(i, set()).update(range(inside[0], inside[-1] + 5))
    return found


def test_repeats_are_those_of_brute_force(spark):
    r, texts = random.Random(3), []
    fresh = lambda n: [r.choice(VOCAB) + r.choice(VOCAB) for _ in range(n)]
    edited = lambda words, rate: [x for w in words for x in ([w], [], fresh(1), [w, *fresh(1)])[r.randint(1, 3) if r.random() < rate else 0]]
    lines, base = [fresh(9) for _ in range(10)], fresh(120)
    mixed = lambda n: [w for _ in range(n) for w in r.choice(lines)]
    texts += [fresh(20) + edited(base, 0.04) + fresh(20) for _ in range(30)]
    texts += [fresh(60) + mixed(2) + fresh(40) for _ in range(30)]
    # passages of lines that many documents have, each in an order of its own, and near copies of some
    texts += [mixed(8) for _ in range(40)]
    for _ in range(15):
        passage = mixed(7)
        texts += [fresh(30) + passage + fresh(30), fresh(50) + edited(passage, 0.02) + fresh(10)]
    texts += [(list(x) * n)[: n + 7] for n in (30, 50, 200) for x in ("x", "abc", "qqr")]
    texts += [[r.choice("ab") for _ in range(r.randint(30, 80))] for _ in range(20)]
    texts += [short := fresh(42), short + fresh(60), fresh(4) + short + fresh(4)]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)] + [(None, "x " * 60), (5, " ".join(base)), (7, None)]
    r.shuffle(rows)
    got = {}
    for x in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(x.doc_id, set()).update(range(x.start_word, x.end_word))
        assert x.first_id < x.doc_id
    assert got == brute_repeats(rows)


def test_lines_in_another_order_are_no_passage(spark):
    lines = [prose(9, 700 + k) for k in range(12)]
    texts = ["\n".join(lines), "\n".join(lines[::-1]), "\n".join([lines[0]] * 12), prose(60, 800) + "\n" + lines[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert substring.repeated_passages(df).collect() == []


def test_words_lost_and_won_in_a_passage(spark):
    words = prose(200, 901).split()
    changed = words[:40] + words[43:90] + ["new", "words"] + words[90:150] + words[152:]
    df = spark.createDataFrame([(1, " ".join(words)), (2, prose(70, 902) + " " + " ".join(changed))], "doc_id long, text string")
    (r,) = substring.repeated_passages(df).collect()
    assert (r.doc_id, r.first_id) == (2, 1) and abs(r.start_word - 70) <= 2 and abs(r.end_word - 70 - len(changed)) <= 2


def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def brute_hits(text, items):
    words, hit, which, best = item_words(text), set(), set(), []
    for item, t in items:
        bench = item_words(t)
        if item is None or not bench:
            continue
        for k in range(max(1, len(bench) - 12)):
            w = bench[k : k + 13]
            for p in range(len(words) - len(w) + 1):
                if words[p : p + len(w)] == w:
                    n = len(w)
                    while k + n < len(bench) and p + n < len(words) and bench[k + n] == words[p + n]:
                        n += 1
                    best.append((-n, p, str(item)))
                    hit.update(range(p, p + len(w)))
                    which.add(str(item))
    n, at, item = min(best, default=(0, None, None))
    return len(words), len(hit), len(which), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words), -n, at, item


def hit_columns(r):
    return r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.longest, r.longest_start, r.longest_item


@pytest.mark.parametrize("block", [decontam.BLOCK_CHARS, 100])
def test_contamination_is_brute_force(docs, bench, block):
    got = Counter(map(hit_columns, decontam.find_contamination(docs.select("doc_id", "text"), bench, block_chars=block).collect()))
    assert got == Counter((i, *brute_hits(t, BENCH)) for i, t, *_ in ROWS)


#: Texts of few words, so that matches overlap, repeat and break off; the first item holds two stretches of a longer passage.
_FEW = [" ".join(random.Random(k).choice("ab") for _ in range(random.Random(k).randint(0, 90))) for k in range(40)]
TWISTED = [" ".join([*(f"w{i}" for i in range(13)), "q", *(f"w{i}" for i in range(1, 14))]), "a " * 60, "a " * 20 + "b " * 20, *_FEW[:6], "a b", "z", ""]


@pytest.mark.parametrize("block", [decontam.BLOCK_CHARS, 60])
def test_longest_matches_are_brute_force(spark, block):
    texts = [" ".join(f"w{i}" for i in range(14)), "x " + " ".join(f"w{i}" for i in range(14)) + " q " + " ".join(f"w{i}" for i in range(2, 14)), "a " * 100, *_FEW, None, "", _FEW[3], _FEW[3]]
    items = list(enumerate(TWISTED))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    test = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(hit_columns, decontam.find_contamination(df, test, block_chars=block).collect()))
    assert got == [(i, *brute_hits(t, items)) for i, t in enumerate(texts)] and got[0][6] == 13
    want = {}
    for item, t in items:
        bench = item_words(t)
        for k in range(len(bench)):
            for i, text in enumerate(texts):
                words = item_words(text)
                for p in range(len(words)):
                    n = 0
                    while k + n < len(bench) and p + n < len(words) and bench[k + n] == words[p + n]:
                        n += 1
                    if n >= 5:
                        want[str(item), k] = min(want.get((str(item), k), (0,)), (-n, i, p))
    found = {(r["item"], r.item_start): (-r.n_words, r.doc_id, r.start) for r in decontam.longest_matches(df, test, 5, block_chars=block).collect()}
    assert found == want


def test_suffix_array_is_sorted():
    r = np.random.default_rng(8)
    for words in (1, 2, 5):
        ids = r.integers(0, words + 1, 400)
        ptr = np.array([0, 0, 7, 200, 400])
        stops = np.union1d(np.flatnonzero(ids == 0), ptr[1:])
        ends = stops[np.searchsorted(stops, np.arange(400), "right")]
        suffix = lambda p: ids[p : ends[p]].tolist()
        assert [suffix(p) for p in decontam.suffix_array(ids, ends)] == sorted(suffix(p) for p in np.flatnonzero(ids).tolist())


def test_passage_that_many_documents_share(spark):
    rows = [(i, prose(30, 100 + i) + " " + PASSAGE + " " + prose(30, 500 + i)) for i in range(60)]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 60))
    assert all(r.first_id < r.doc_id and r.start_word <= 30 and r.end_word >= 100 for r in got)
    windows = spark.createDataFrame([(i, PASSAGE) for i in range(40)], "id long, text string").repartition(1)
    met = substring.matched_windows(windows).collect()
    assert {r.id for r in met} == set(range(40)) and {r["first"] for r in met} == {0}


def test_copies_are_not_compared(spark):
    long, short = prose(80, 31), prose(49, 32)
    rows = [(i, long) for i in range(40, 240)] + [(7, long + " more"), (40, long), (41, short), (300, short), (300, long), (None, long), (8, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    kept, copies = substring._without_copies(df, substring.PASSAGE)
    assert sorted(map(tuple, kept.collect())) == sorted([(7, long + " more"), (40, long), (40, long), (41, short)])
    assert sorted(map(tuple, copies.collect())) == [(i, 0, 80, 80, 40, 1.0) for i in [*range(41, 240), 300]]
    got = substring.repeated_passages(df, "id").collect()
    assert sorted((r.id, r.first_id, r.start_word, r.end_word) for r in got) == sorted([(40, 7, 0, 80)] * 2 + [(i, 40, 0, 80) for i in [*range(41, 240), 300]])


def test_documents_of_a_shingle_are_counted_once(spark):
    rows = [(1, k, 7, False) for k in range(50)] + [(2, 3, 7, True), (2, 9, 8, False)]
    got = substring._met(spark.createDataFrame(rows, "id long, at int, key long, loose boolean").repartition(4)).collect()
    assert {(r.key, r.docs, r.least, r.of) for r in got} == {(7, 2, 1, 2)} and len(got) == 51


def test_passages_with_windows_of_few_are_not_tried_again(spark):
    # a line of many documents, and words around it that two have: these two have met
    line = prose(30, 41)
    rows = [(i, prose(60, 600 + i) + " " + line + " " + prose(60, 700 + i)) for i in range(30)]
    rows += [(30 + i, prose(60, 800 + i) + " " + prose(12, 42) + " " + line + " " + prose(60, 900 + i)) for i in range(2)]
    pairs = substring.candidate_pairs(substring.matched_windows(spark.createDataFrame(rows, "id long, text string"))).collect()
    last = [r for r in pairs if r.id == 31]
    alone = [r for r in pairs if r.id == 29]
    assert [r["first"] for r in last if r["first"] is not None and r["first"] >= 30] == [30]
    assert [r.open for r in last if r.open] and sum(x.size for r in last for x in r.open or []) <= sum(x.size for r in alone for x in r.open or [])


def test_pairs_are_verified_together_as_one_by_one(monkeypatch):
    r = random.Random(21)
    for equal in (50, 1 << 18):
        monkeypatch.setattr(substring, "EQUAL", equal)
        monkeypatch.setattr(substring, "MATCHES", 40 * equal)
        owns, pairs = [], []
        for kind in (2, 30, 1 << 31) * 8:
            fresh = lambda n, kind=kind: [r.randrange(kind) for _ in range(n)]
            owns.append(np.array(fresh(r.choice([30, 46, 200])), np.int32))
            for _ in range(3):
                a = r.randrange(len(owns[-1]))
                part = owns[-1][a : a + 80].tolist()
                part[10:15] = fresh(r.randint(0, 9))
                text = fresh(r.randint(0, 60)) + part + fresh(40)
                cut = r.randint(0, len(text))
                ranges = [(0, cut // 2), (cut, len(text) - cut)]
                pairs.append((len(owns) - 1, ranges, np.array([x for b, n in ranges for x in text[b : b + n]], np.int32)))
        got = {k: sorted(covers) for k, covers, _ in substring.pair_hits(owns, pairs, 46, 5, 0.8)}
        wanted = {}
        for k, (i, ranges, flat) in enumerate(pairs):
            one = owns[i].astype(np.int64)
            lines = substring._lines(one, ranges, flat.astype(np.int64), 46, 37) if len(one) >= 46 and len(flat) else []
            if covers := substring._line_hits(one, lines, ranges, flat, 46, 5, 0.8)[0]:
                wanted[k] = sorted(covers)
        assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in wanted.items()} and len(wanted) > 10


def test_rows_of_a_shard_come_back_as_they_were():
    r = np.random.default_rng(4)
    ids = pa.array([f"d{k}" for k in r.integers(0, 50, 900)])
    key, at, flag = r.integers(-(2**62), 2**62, 900), r.integers(0, 9, 900).astype(np.int32), r.integers(0, 2, 900).astype(np.int8)
    shard = r.integers(0, 7, 900).astype(np.int32)
    parts = [substring._sent(ids.slice(a, 300), shard[a : a + 300], key[a : a + 300], at[a : a + 300], flag[a : a + 300]) for a in (0, 300, 600)]
    sent = pa.Table.from_batches(parts).sort_by("shard").combine_chunks().to_batches()
    got = [list(zip(x[0].to_pylist(), *(y.tolist() for y in x[2:]), strict=True)) for x in substring._received(sent, np.int64, np.int32, np.int8)]
    whole = list(zip(ids.to_pylist(), key.tolist(), at.tolist(), flag.tolist(), strict=True))
    assert [sorted(x) for x in got] == [sorted(x for x, k in zip(whole, shard, strict=True) if k == n) for n in range(7)]
    names, rank = next(substring._received(sent, np.int64, np.int32, np.int8))[:2]
    assert [x for _, x in sorted(zip(rank.tolist(), names.to_pylist(), strict=True))] == sorted(names.to_pylist())


def test_rounds_want_the_shingles_they_wanted_before(spark):
    # words that a round found do not change which shingles stand for a passage
    open_ = spark.createDataFrame([(9, [(0, 1)], False)], f"id long, open {substring._RANGES}, odd boolean")
    shared = spark.createDataFrame([(9, k, k, 30 - (k > 40), False) for k in range(46)], "id long, at int, key long, docs long, loose boolean")
    kind = "id long, start_word long, n_words long, alone boolean"
    none, some = (spark.createDataFrame(x, kind) for x in ([], [(9, 2, 48, True)]))
    first, later = (sorted(x.key for x in substring._still_open(open_, x, shared, 50, 5, 0.8, none).collect()) for x in (none, some))
    assert first == later and len(first) == 10


def test_decontamination_keeps_clean_documents_and_columns(docs, bench):
    out = decontam.decontaminate(docs, bench)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, t, *_ in ROWS if not brute_hits(t, BENCH)[4])


def library():
    """The untouched tokenizer of the library."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.TOKENIZER)


@pytest.mark.parametrize("memo", [300, 1_000_000])
def test_encoder_is_the_library(memo):
    tool, plain = bpe.Encoder(queries.TOKENIZER, memo), library()
    texts = [t for _, t, *_ in ROWS] + ["x.\nY z", "a, b. c; d", "\0a b\0", "é è.\nñ", "\n\n a", "a\r\n b  c", "a<|endoftext|>b c", "say <|endoftext|>", "a\n\nb c\n d\n", "\nx y", "it's I'll x'y '", "3×4÷2 ÀÉ×x Ωμ ½²", "a\u00a0b \u2003c", "ſ ɏ ɐ ʯ ʰ", "x-1,000.50% (y) [z]! …", "\x1c\x1f \x7f", "q " * 400 + "w" * 5000, "漢字 かな한국 🙂🙂 a🙂"]
    texts += [" ".join("".join(rng.choice("abzAZ019.,;'-\n\t×éñøſ€漢½🙂") for _ in range(rng.randint(1, 9))) for _ in range(40)) for _ in range(300)]
    for _ in range(3):
        for part in (texts, texts[::2], texts[1::3], [], [None, ""]):
            ids, counts = tool.encode(part)
            want = [e.ids for e in plain.encode_batch([t or "" for t in part], add_special_tokens=False)]
            assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_fullest_bin_and_plan():
    r = random.Random(2)
    for _ in range(60):
        items = [r.randint(1, 30) for _ in range(r.randint(1, 9))]
        room = r.randint(1, 60)
        best = max(sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room)
        chosen = packing.fullest(dict(Counter(items)), room)
        assert sum(chosen) == best and not Counter(chosen) - Counter(items)
    table = packing.plan({5: 7, 10: 3, 1: 4}, 10)
    assert table[:, 0].tolist() == sorted(table[:, 0].tolist())


def test_packing_is_gapless_and_tight(docs):
    rows = packing.pack(docs, queries.TOKENIZER).collect()
    plain = library()
    want = Counter()
    for i, t, *_ in ROWS:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        at = 0
        for piece, size in enumerate([first] + [1024] * ((len(ids) - first) // 1024)):
            want[(i, piece, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes()))] += 1
            at += size
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) == math.ceil(sum(r.length for r in rows) / 1024)


@pytest.mark.parametrize("parts", [1, 5])
def test_token_files_round_trip(spark, docs, tmp_path, parts):
    path = f"file://{tmp_path}/tokens"
    more = [(15, f"text {i % 7}" + " more" * (i % 5)) for i in range(40)]  # rows of one id that differ, and equal ones
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    tokenstore.write_tokens(table, path, queries.TOKENIZER, partitions=parts)
    plain = library()
    encode = lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, 2]
    want = Counter((i, tuple(encode(t))) for i, t in [*((r[0], r[1]) for r in ROWS), *more])
    stored = sorted(((r.file, r.row, r.doc_id, tuple(r.ids)) for r in tokenstore.read_tokens(spark, path).select("*", F.regexp_extract(F.col("_metadata.file_path"), r"part-(\d+)", 1).alias("file"), F.col("start").alias("row")).collect()))
    assert Counter((i, ids) for _, _, i, ids in stored) == want
    ids = [-1 if i is None else i for _, _, i, _ in stored]
    assert ids == sorted(ids)
    got, at, index = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenstore.token_index(spark, path).collect())), 0, []
    for _, _, i, x in stored:
        index.append((at, i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert got == index
    assert Counter(tuple(r) for r in tokenstore.store_and_index(table, queries.TOKENIZER).select("doc_id", "n_tokens").collect()) == Counter((i, n) for _, i, n, _ in index)


def test_lookups_skip_rows_and_stripes(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    table = spark.range(0, 40_000, 2).selectExpr("id as doc_id", "'some words' as text")
    tokenstore.write_tokens(table, path, queries.TOKENIZER, partitions=4)
    for wanted, rows in ((7_000, 1), (7_001, 0)):  # 7001 is within a stripe's range: its Bloom filter knows better
        found = tokenstore.lookup(spark, path, [wanted])
        assert len(found.collect()) == rows
        plan = found._jdf.queryExecution().executedPlan()
        assert f"EqualTo(doc_id,{wanted})" in plan.toString()
        assert plan.collectLeaves().head().metrics().get("numOutputRows").get().value() <= 1_000 * rows


def test_elias_fano_access_and_search():
    r = np.random.default_rng(7)
    for n, top in ((0, 10), (1, 5), (500, 100), (700, 2**62), (1000, 10**6)):
        values = np.sort(r.integers(0, top, n).astype(np.uint64))
        ef = eliasfano.EliasFano.build(values)
        if n:
            assert (ef.get(np.arange(n)) == values).all()
        probes = np.concatenate([values, values + np.uint64(1), r.integers(0, top * 2, 300).astype(np.uint64)])
        assert (ef.find(probes) == np.searchsorted(values, probes)).all()
        assert (ef.find(probes[:3]) == np.searchsorted(values, probes[:3])).all() and (ef.decode() == values).all()


def brute_scores(rows, held, prior=ngramlm.PRIOR):
    """(n_tokens, n_known, train_tokens, base_score, score) of each text, from whole Counters."""
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in rows}
    uni, two, three, ctx = Counter(), Counter(), Counter(), Counter()
    for i, t in tokens.items():
        if not held(i):
            full = ["<s>", *t]
            uni.update(t)
            ctx["<s>"] += 1
            two.update(zip(full, full[1:], strict=False))
            three.update(zip(full, full[1:], full[2:], strict=False))
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 1) / (n + v + 1)
    p2 = lambda u, w: (two[u, w] + prior * p1(w)) / ((ctx[u] if u == "<s>" else uni[u]) + prior)
    p3 = lambda t, u, w: (three[t, u, w] + prior * p2(u, w)) / (two[t, u] + prior)
    out = {}
    for i, t in tokens.items():
        full = ["<s>", *t]
        score = math.log10(p2("<s>", full[1])) + sum(math.log10(p3(*full[k - 2 : k + 1])) for k in range(2, len(full)))
        out[i] = (len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), score)
    return out


def check_scores(got, want):
    for i, (n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-3), (i, r.score, score)


@pytest.mark.parametrize("size", [1 << 20, 300])
def test_language_model_is_brute_force(spark, size):
    rows = [(i, " ".join(random.Random(i).choice(VOCAB[:12]) for _ in range(30)) + (" rare%d" % i)) for i in range(40)] + [(40, None), (41, "unknown words here"), (42, ""), (43, "x " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in ngramlm.lm_scores(df, ngramlm.remainder(7) == 2, block_bytes=2 * size, shard_bytes=size).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    assert {i: r.held_out for i, r in got.items()} == held
    check_scores(got, brute_scores(rows, held.get))


def test_rare_ngrams_shape_scores_of_a_large_table(spark):
    """More than 10,000 training tokens: nothing is left out for being rare, and a second copy counts."""
    r = random.Random(23)
    few = [f"w{k}" for k in range(6)]
    rows = [(i, " ".join(r.choice(few) for _ in range(40)) + (" odd pair here" if i == 1 else "")) for i in range(500)]
    fresh = lambda: " ".join(f"{r.getrandbits(28):07x}" for _ in range(60))
    twice = [fresh() for _ in range(20)]
    rows += [(500, "odd pair here"), *((600 + i, t) for i, t in enumerate(twice + twice)), *((700 + i, fresh()) for i in range(40))]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = {x.id: x for x in ngramlm.lm_scores(df, F.col("id") == 500, "id", block_bytes=4_000, shard_bytes=2_000).collect()}
    check_scores(got, brute_scores(rows, lambda i: i == 500))
    mean = lambda lo, hi: [got[i].score / got[i].n_tokens for i in range(lo, hi)]
    assert min(mean(600, 640)) > max(mean(700, 740))


def test_ngrams_sent_grow_with_the_corpus(spark):
    sizes = []
    for n in (60, 600):
        rows = [(i, " ".join(random.Random(i).choice(VOCAB) for _ in range(40))) for i in range(n)]
        df = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "false as held")
        sizes.append(sum(len(r.data) for r in ngramlm.block_rows(df, 40, 1).where("route >= 0").collect()))
    assert sizes[1] > 5 * sizes[0]


def test_trie_finds_successors_of_contexts():
    r = np.random.default_rng(4)
    pairs = np.unique(r.integers(0, 50 * 50, 600))
    context, word = pairs // 50, pairs % 50
    level = eliasfano.Level.build(context, word, 50)
    at = {(int(c), int(w)): i for i, (c, w) in enumerate(zip(context, word, strict=True))}
    asked = [(c, w) for c in range(50) for w in range(50)]
    for some in (asked, asked[::97]):  # many and few queries go different ways
        got = level.find(np.array([c for c, _ in some]), np.array([w for _, w in some]))
        assert got.tolist() == [at.get(x, -1) for x in some]


def test_bad_host_in_the_query_and_its_sql(spark, tmp_path):
    import duckdb

    good, bad = prose(80, 51), "too short"
    rows = [(good, "good")] * 95 + [(bad, "good")] * 5 + [(bad, "bad")] * 95 + [(good, "bad")] * 5 + [(bad, "tiny"), (good, "tiny"), (good, None), (None, "good")] + [(good if k else bad, f"h{i}") for i in range(20) for k in range(20)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op3_quality(spark, f"file://{tmp_path}").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.OP3_SQL)
    at = [d[0] for d in want.description]
    names = ["doc_id", *quality.COUNTS, "base_failed", "kept"]
    assert got == sorted(tuple(r[at.index(n)] for n in names) for r in want.fetchall())
    kept = {r[0] for r in got if r[-1]}
    assert not kept & set(range(100, 200)) and {i for i, (t, s) in enumerate(rows) if t == good and s != "bad"} == kept


@pytest.mark.parametrize("name", ["quality", "simhash", "substring", "decontamination", "packing"])
def test_pipeline_stages_on_awkward_tables(spark, bench, name, tmp_path):
    import corpus_pipeline

    sf_dir = f"file://{tmp_path}"
    bench.write.parquet(f"{sf_dir}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    long = prose(300, 41)
    rows = [(None, prose(120, 21), "s"), (None, "short", "s"), (1, "short", "s"), (1, prose(120, 22), "s"), (1, prose(120, 22), "s"), (2, prose(120, 22), None), (3, None, "s"), (4, long, "s"), (5, long, "s"), (None, long, "s"), (6, "w" * 200_000 + " " + prose(80, 23), "s"), *((10 + i, prose(90, 300 + i), "s") for i in range(9))]
    names = {"span_id": "a", "spans": 1, "row_no": 2, "fp": 3, "path_": 4, "first": 5, "c0": 6, "n_words": 7}
    df = spark.createDataFrame([(*r, "en", 5, *names.values()) for r in rows], "doc_id long, text string, source string, lang string, n_chars long, span_id string, " + ", ".join(f"`{n}` long" for n in list(names)[1:])).repartition(3)
    assert stage(spark, df.where("false"), sf_dir).collect() == []
    out = stage(spark, df, sf_dir)
    got = out.collect()
    if name != "packing":
        assert out.columns == df.columns and all(tuple(r)[5:] == tuple(names.values()) for r in got)
    kept = Counter((r.doc_id, r.text) for r in got) if name != "packing" else None
    every = Counter((i, t) for i, t, _ in rows)
    if name == "quality":
        assert kept == Counter({k: n for k, n in every.items() if k[1] and len(k[1].split()) >= 50})
    elif name == "simhash":
        assert kept[1, prose(120, 22)] == 1 and (2, prose(120, 22)) not in kept and kept[1, "short"] == 1 and (None, "short") not in kept
        assert kept[None, prose(120, 21)] == 1 and kept[4, long] == 1 and (5, long) not in kept and (None, long) not in kept and kept[3, None] == 1
    elif name == "substring":
        assert kept[4, long] == 1 and (5, long) not in kept and kept[None, long] == 1 and kept[3, None] == 1 and kept[1, prose(120, 22)] == 2 and (2, prose(120, 22)) not in kept
    elif name == "decontamination":
        assert kept == every
    else:
        assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(i for i, _, _ in rows)


def test_pipeline_stages(spark):
    import corpus_pipeline

    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    now, kept = df, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SMALL)
        now = spark.createDataFrame(now.toPandas(), now.schema)
        kept[name] = now
        if name != "packing":
            assert now.columns == df.columns
    ids = {k: {r.doc_id for r in v.select("doc_id").distinct().collect()} for k, v in kept.items()}
    texts = {r.doc_id: r.text for r in df.collect()}
    good = {r.doc_id for r in quality.quality_rules(df).where("kept").collect()}
    assert ids["quality"] == good
    root = brute_components([fingerprint(texts[i]) for i in good])
    least = {}
    for i in sorted(good):
        least.setdefault(root[fingerprint(texts[i])], i)
    assert ids["simhash"] == set(least.values())
    assert ids["substring"] <= ids["simhash"]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    after = {r.doc_id: r.text for r in kept["substring"].collect()}
    assert ids["decontamination"] == {i for i, t in after.items() if not brute_hits(t, items)[4]}
    assert ids["packing"] == ids["decontamination"]
