"""Operators against plain versions of themselves, round trips and held-out accuracy."""

import itertools
import math
import random
import re
import textwrap
import time
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from rasterloom.llm import embed_dedup, langid, license_scan, line_dedup, mixing, packing, quality, secret_scan, simhash, toxicity
from rasterloom.llm.common import components, in_blocks, ranked

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def plain(docs):
    return {r.doc_id: r for r in docs.collect()}


def groups(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups(2200, edges)
    assert all(found.get(i, i) == want[i] for i in range(2200))


def test_ranks_are_exact_under_skew(spark):
    df = spark.range(30_000).selectExpr("id", "case when id % 3 = 0 then 'hot' else cast(id % 50 as string) end as k", "xxhash64(id) & 4294967295 as h")
    rows = ranked(df, ["k"], "h", ["id"], "r", 30_000, per_bucket=500).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.k, r.h, r.id)):
        assert r.r == by.get(r.k, 0)
        by[r.k] = r.r + 1


def brute_fingerprint(text, width):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_links(spark, docs):
    rng = random.Random(1)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    texts = {r.doc_id: r.text for r in docs.limit(40).collect()}
    for k in range(60):
        near = list(base)
        for _ in range(k % 4):
            near[rng.randrange(300)] = f"x{k}"
        texts[1000 + k] = " ".join(near)
    texts |= {2000: "", 2001: None, 2002: "one", 2003: "ONE"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in ({}, {"block": 4}):
        found = {r.doc_id: r for r in simhash.classes(df, **block).collect()}
        ids = sorted(texts)
        marks = [brute_fingerprint(texts[i], 4) for i in ids]
        assert [found[i].fp & (2**64 - 1) for i in ids] == marks
        want = groups(len(ids), [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if (marks[i] ^ marks[j]).bit_count() <= 4])
        assert [found[i].component_id for i in ids] == [ids[g] for g in want]


def test_cover_holds_for_every_distance():
    for bits in range(8):
        agree = 8 - bits
        for size in range(1, agree + 1):
            sets = simhash.cover(agree, size)
            assert all(any(set(s) <= set(w) for s in sets) for w in itertools.combinations(range(8), agree))


def test_near_duplicates_by_similarity(spark):
    rng = random.Random(5)
    rows, words = [], lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    for g in range(12):
        base = words(250)
        rows.append((100 * g, " ".join(base)))
        rows.append((100 * g + 1, " ".join(base)))
        for k in range(2, 5):  # one word differs: about 0.96 of the shingles agree
            near = list(base)
            near[rng.randrange(250)] = "changed"
            rows.append((100 * g + k, " ".join(near)))
        rows.append((100 * g + 50, " ".join(base[:120] + words(130))))  # shares a passage only
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r["first"] for r in simhash.near_classes(df).collect()}
    assert all(found[100 * g + k] == 100 * g for g in range(12) for k in range(5))
    assert all(found[100 * g + 50] == 100 * g + 50 for g in range(12))
    assert simhash.one_of_each(df).count() == 24


def test_embedding_links(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 32))
    rows = [c + 0.12 * np.linalg.norm(c) / np.sqrt(32) * rng.standard_normal(32) * s for c in centres for s in (0, 0.5, 1, 1.5, 2, 2.4)]
    rows += list(rng.standard_normal((300, 32))) + [rows[0]] * 3
    data = np.array(rows, np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    out = {r.vec_id: r for r in embed_dedup.query(df).collect()}
    unit = data.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    got = sum(out[i].n_links for i in range(len(data)))
    assert all(out[i].n_links <= near[i].sum() for i in range(len(data))) and got >= 0.95 * near.sum()


def test_embedding_blocks_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    data = (centre + 0.05 * rng.standard_normal((90, 16))).astype(np.float32)
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    out = embed_dedup.query(df).collect()
    assert {r.n_links for r in out} == {89} and {r.component_id for r in out} == {0}


def test_embedding_recall_at_the_threshold(spark, tmp_path):
    """Pairs of a known cosine among 100,000 vectors: none below 0.9, nine tenths and more of those just above."""
    rng = np.random.default_rng(6)
    n, planted = 100_000, 3000
    data = rng.standard_normal((n, 48))
    data /= np.linalg.norm(data, axis=1)[:, None]
    cosine = rng.uniform(0.88, 0.92, planted)
    base, aside = data[:planted], data[planted : 2 * planted]
    aside = aside - (aside * base).sum(axis=1)[:, None] * base
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    data[planted : 2 * planted] = cosine[:, None] * base + np.sqrt(1 - cosine**2)[:, None] * aside
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(data.reshape(-1), 48).cast(pa.list_(pa.float64()))}), f"{tmp_path}/vectors.parquet")
    out = {r.vec_id: r for r in embed_dedup.query(spark.read.parquet(f"{tmp_path}/vectors.parquet").repartition(8)).collect()}
    true = (data[:planted] * data[planted : 2 * planted]).sum(axis=1)
    found = np.array([out[k + planted].component_id == k for k in range(planted)])
    assert len(out) == n and not found[true < 0.9].any()
    assert found[(true >= 0.9) & (true < 0.905)].mean() >= 0.93 and found[true >= 0.9].mean() >= 0.95
    assert all(out[k].n_links == 0 for k in range(2 * planted, n, 97))


def test_quality_counts(spark, docs, plain):
    texts = {i: r.text for i, r in plain.items()} | {10**6: "a b c d e f a b c d e g h\n\n x \n x \n#$%\x0bz", 10**6 + 1: "a a a a a a a a a a a a", 10**6 + 2: " \t"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for r in quality.query(df, labels.where("quality = 1")).collect():
        text = texts[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        again = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed)
        assert not (failed and r.kept)


def test_quality_ratio(spark):
    """The ratio of a tiny corpus, by hand."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "good good text"), (2, "bad bad text bad")], "doc_id long, text string")
    trusted = spark.createDataFrame([(1,)], "doc_id long")
    half = quality.HALF
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in ("good", "bad", "text")], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pair = {(a, b): spark.range(1).select(F.xxhash64(F.lit(h[a]), F.lit(h[b]))).first()[0] % half + half for a in h for b in h}

    def grams(text):
        w = text.split()
        return [h[x] % half for x in w] + [pair[x] for x in zip(w, w[1:], strict=False)]

    target, raw = Counter(grams("good good text")), Counter(grams("good good text") + grams("bad bad text bad"))
    t, n = sum(target.values()), sum(raw.values())
    weight = lambda b: math.log((target[b] + quality.SMOOTHING) / (raw[b] * t / n + quality.SMOOTHING))
    found = {r.doc_id: r.ratio for r in quality.query(df, trusted).collect()}
    for i, text in ((1, "good good text"), (2, "bad bad text bad")):
        assert found[i] == pytest.approx(sum(map(weight, grams(text))) / len(text.split()), abs=1e-12)


def test_line_dedup(spark):
    pages = [(i, "s", f"menu\nstory number {i} is told here at some length\n\nfooter  ") for i in range(20)] + [(100 + i, "t", "menu\nother") for i in range(3)] + [(200, "s", "menu")]
    df = spark.createDataFrame(pages, "doc_id long, source string, text string")
    from pyspark.sql import functions as F

    found, name = line_dedup.marked(df, F.col("source"), F.col("text"))
    out = {r.doc_id: r[name] for r in found.collect()}
    assert all(out[i].text == f"story number {i} is told here at some length\n" and out[i].n_dropped == 2 for i in range(20))
    assert all(out[100 + i].text == "" and out[100 + i].n_dropped == 2 for i in range(3)) and out[200].text == ""  # the ratio alone decides
    kept, left = line_dedup.marked(df, F.col("source"), F.col("text"), spare=True, min_pages=4)
    out2 = {r.doc_id: r[left] for r in kept.collect()}
    assert all(out2[100 + i].text == "menu\nother" for i in range(3)) and out2[200].text == "menu" and out2[0] == out[0]
    urls = spark.createDataFrame([("https://u@Ex.org:80/a?b", "ex.org"), ("no url", None), (None, None)], "u string, h string")
    assert all(r[0] == r[1] for r in urls.select(line_dedup.host_of_url(F.col("u")), "h").collect())
    monkey = line_dedup.BROADCAST_LINES
    line_dedup.BROADCAST_LINES = 0  # the other join
    try:
        again, name2 = line_dedup.marked(df, F.col("source"), F.col("text"))
        assert {r.doc_id: r[name2] for r in again.collect()} == out
    finally:
        line_dedup.BROADCAST_LINES = monkey


def test_mixing_deviates_less_than_a_block(spark):
    rows = [(i, "abc"[0 if i % 2 else 1 + i % 4 // 2]) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    weights = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "source string, weight long")
    found, name = mixing.scheduled(df, weights, block_docs=1)
    out = sorted((r[name].slot, r.source, r[name]) for r in found.collect())
    counts = Counter()
    slots = {s: (src, m) for s, src, m in out}
    for slot in range(900):
        src, m = slots[slot]
        assert m.release <= slot < m.deadline
        counts[src] += 1
        for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
            assert abs(counts[s] - w * (slot + 1)) < 1
    assert len(out) == 4000 and len(slots) == 4000
    with pytest.raises(ValueError):
        mixing.scheduled(df, weights.where("source <> 'c'"))
    pos = {}
    for r in found.collect():
        pos.setdefault(r.source, []).append((r[name].block, r[name].place))
    assert all(sorted(p) == [(k, 0) for k in range(len(p))] for p in pos.values())


def test_mixing_of_many_sources(spark):
    """A heap and the expression give one schedule; thousands of sources keep their shares, a hot one too."""
    weights = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2), ("d", 7), ("e", 1)], "source string, weight long")
    rows = lambda df: sorted(map(tuple, df.select("source", "nth", "slot", "period", "weight", "release", "deadline").collect()))
    assert rows(mixing.pattern(weights)) == rows(mixing.pattern_by_heap(weights))
    n = 5000
    df = spark.range(3 * n // 2).selectExpr("id as doc_id", f"case when id < {n} then cast(id as string) else 'hot' end as source")
    found, name = mixing.scheduled(df)
    out = found.collect()
    period = max(r[name].slot for r in out) + 1
    assert len(out) == 3 * n // 2 and all(r[name].release <= r[name].slot < r[name].deadline for r in out)
    share = math.sqrt(n / 2) / (math.sqrt(n / 2) + n)
    first = [r[name].deadline for r in out if r.source == "hot" and r[name].block == 0][0]
    assert period > n and abs(1 / first - share) < 0.1 * share


def test_licences(spark):
    files = [("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/x.py", "nothing"), ("a/c/LICENSE.txt", "Released under the MIT License."), ("a/c/d/y.py", None), ("z/q.py", "# Licensed under CC BY-NC 4.0.\ncode"), ("r.py", "x"), (None, "x"), ("a/c/z.py", "This licence is quite unlike any that is known to mankind so far")]
    df = spark.createDataFrame(files, "path string, text string")
    from pyspark.sql import functions as F

    found, name = license_scan.scanned(df, F.col("path"), F.col("text"))
    out = {r.path: tuple(r[name]) for r in found.collect()}
    assert out == {
        "a/LICENSE": ("Apache-2.0", "own", None), "a/b/x.py": ("Apache-2.0", "inherited", "a"), "a/c/LICENSE.txt": ("MIT", "own", None), "a/c/d/y.py": ("MIT", "inherited", "a/c"), "z/q.py": ("CC-BY-NC-4.0", "own", None),
        "r.py": (None, "none", None), None: (None, "none", None), "a/c/z.py": ("MIT", "inherited", "a/c"),
    }


def test_licence_texts(spark):
    """SPDX lines, wrapped headers, titles and whole texts; a mere copyright line is no licence."""
    from pyspark.sql import functions as F

    wrap = lambda text, sign: "\n".join(sign + x for x in textwrap.wrap(" ".join(text.split()), 60))
    texts = {k: dict(enumerate(v)) for k, v in license_scan.TEXTS.items()}
    files = [(f"spdx_{k}.py", f"// SPDX-License-Identifier: {k}\nint x;", k) for k in texts if k != "Proprietary"]
    files += [("o.c", "/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0"), ("n.c", "// SPDX-License-Identifier: Foo-1.0", None)]
    files += [(f"h{i}.py", "import os\n\n# Copyright (C) 2021 A. Person\n#\n" + wrap(texts[k][len(texts[k]) - 1], "# ") + "\n\nx = 1\n", k) for i, k in enumerate(("GPL-3.0", "GPL-2.0", "LGPL-2.1", "AGPL-3.0", "Apache-2.0", "MPL-2.0"))]
    files += [(f"{i}/LICENSE", f"{k} License\n\nCopyright (c) 2020, Jane Doe. All rights reserved.\n\n" + wrap(texts[k][2], ""), k) for i, k in enumerate(("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC"))]
    files += [("t/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy.", "GPL-3.0"), ("m.js", "/* Mozilla Public License Version 2.0 */", "MPL-2.0"), ("c.c", "/* Copyright (c) 2020 Jane Doe. All rights reserved. */", None)]
    df = spark.createDataFrame([f[:2] for f in files], "path string, text string")
    found, name = license_scan.scanned(df, F.col("path"), F.col("text"))
    out = {r.path: r[name].licence for r in found.collect()}
    assert {p: out[p] for p, _, _ in files} == {p: k for p, _, k in files}


def test_secret_base_spans():
    rng = random.Random(8)
    pieces = ["password", "PassWd", "api_key", "APIKEY", "token", "secret", " ", "  ", "=", ":", '"', "'", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeef", "xyz", "\n", "ſecret", "é", "Ab1+/_.=-"]
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        want = [(*m.span(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
        want += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base, spans = secret_scan.scan(text)
        assert base == sorted(want, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))
        assert set(base) <= set(spans)


def test_secret_assignments():
    text = 'seed = "kf93JfkQ02lds9"\nother = seed\ndb_password = other\ncolour = "kf93JfkQ02lds9"\n'
    assert [text[a:b] for a, b, k in secret_scan.scan(text)[1]] == ["kf93JfkQ02lds9"]
    for text in ('clientSecret: "kf93JfkQ02lds9!"', "auth_token := 'Zx81aaQ92kd0f'", '{"privateKey" : "kf93JfkQ02lds9!"}'):
        assert any(k == "pair" for *_, k in secret_scan.scan(text)[1])
    for text in ("password = changeme", 'title = "kf93JfkQ02lds9"', "a token is a word: really", "key: value"):
        assert not any(k == "pair" for *_, k in secret_scan.scan(text)[1])


def test_secret_names_need_no_cue_word():
    """A name that scores is found whatever else the text holds: as in the pairs of an ungated scan."""
    literal = "9fQ27bC1d8Zk4LmN"
    for text in (f"x-api-key: {literal}", f"private-key = '{literal}'", f"DB_PASS = '{literal}'", f"access.key = '{literal}'", f"sec_ret = '{literal}'"):
        for around in (text, text + "\nauthor"):
            assert [around[a:b] for a, b, k in secret_scan.scan(around)[1] if k == "pair"] == [literal], around


def test_secret_syntax():
    pair = lambda text: [text[a:b] for a, b, k in secret_scan.scan(text)[1] if k == "pair"]
    assert pair('api-key = "Zx81abQ9rT55mmL2"') == pair("private-key: \"Zx81abQ9rT55mmL2\"") == ["Zx81abQ9rT55mmL2"]
    assert pair('db_pass = "hunter2X9y8z7Q1w2"') == ["hunter2X9y8z7Q1w2"] and pair("x-access-key: Zx81+Q9rT/5mmL2==") == ["Zx81+Q9rT/5mmL2=="]
    assert pair('db_secret = "abc1" + "def2" + "gh3X"\n') == ["abc1", "def2", "gh3X"] == pair('a = "abc1"\nb = a + "def2"\nclient_secret = b + \\\n  "gh3X"\n')
    assert pair('db_secret = "abc1", "def2"') == [] and pair('colour = "abc1" + "def2" + "gh3Xkk2"') == []
    assert pair("token_store:\n  secret_key: |\n    kf93JfkQ02lds9aa\n    Zx81abQ9rT55mmL2\n  colour: red\n") == ["kf93JfkQ02lds9aa", "Zx81abQ9rT55mmL2"]
    assert pair("<config><password>Zx81abQ9rT55mmL2</password><colour>Zx81abQ9rT55mmL2</colour></config>") == ["Zx81abQ9rT55mmL2"]


def test_secret_values_may_double():
    text = 'secret_a = "Zx81abQ9rT55mmL2"\n' + "secret_a = secret_a + secret_a\n" * 100
    assert [text[a:b] for a, b, k in secret_scan.scan(text)[1] if k == "pair"] == ["Zx81abQ9rT55mmL2"]
    chain = 'v0 = "Zx81abQ9rT55mmL2"\n' + "".join(f'v{k + 1} = v{k} + "q{k}"\n' for k in range(3000)) + "password = v3000\n"
    assert sum(k == "pair" for *_, k in secret_scan.scan(chain)[1]) == 3001


def test_secret_propagation_against_brute_force():
    """Random programs: each name's strings by plain evaluation, all literals of each by plain recursion."""
    rng = random.Random(12)
    names = ["password", "client_secret", "colour", "seed", "v1", "auth_token"]
    for _ in range(400):
        lines, env, want = [], {}, set()
        at = 0
        for _ in range(rng.randrange(1, 12)):
            name, parts, value, held_ = rng.choice(names), [], "", []
            for _ in range(rng.randrange(1, 4)):
                if env and rng.random() < 0.5:
                    used = rng.choice(sorted(env))
                    parts.append(used)
                    value += env[used][0]
                    held_ += env[used][1]
                else:
                    text = "".join(rng.choices("abZY019-", k=rng.randrange(3, 18)))
                    start = at + len(f"{name} = " + " + ".join(parts) + (" + " if parts else "")) + 1
                    parts.append(f'"{text}"')
                    value += text
                    held_.append((start, start + len(text), text))
            line = f"{name} = " + " + ".join(parts) + "\n"
            n = secret_scan.name_score(name)
            whole = secret_scan.secret(n, secret_scan.literal_score(value))
            want |= {(a, b) for a, b, x in held_ if whole or secret_scan.secret(n, secret_scan.literal_score(x))}
            env[name] = (value, held_)
            lines.append(line)
            at += len(line)
        text = "".join(lines)
        assert secret_scan.added(text) == want, text


def fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    out = langid.query(df).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == fold(r.doc_id) for r in out)
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.95
    rows = [(r.doc_id, r.text, r.lang) for r in df.where("length(text) < 5000").limit(300).collect()]
    model = langid.fit(rows)
    words = {k: " ".join(t for _, t, lang in rows if lang == k).split()[:400] for k in ("en", "de")}
    (_, score, mix), und = langid.Predictor(model)([" ".join(words["en"] + words["de"]), "12 34"])
    assert mix.startswith(("en", "de")) and "en" in mix and "de" in mix and 0.35 < score < 0.75 and und[0] == "und"


def test_language_sets_have_no_cap(spark):
    """Twelve languages of words of their own: texts of eight equal parts keep all eight, and a rare label is learned."""
    rng = random.Random(4)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 6)) for _ in range(12)]
    text = lambda k, n: " ".join("".join(rng.choices(alphabets[k], k=7)) for _ in range(n))
    rows = [(100 * k + i, text(k, 80), f"l{k:02d}") for k in range(12) for i in range(3 if k == 11 else 60)]
    df = spark.createDataFrame([*rows, (9000, " ".join(text(k, 160) for k in range(8)), None), (9001, text(11, 200), None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.query(df).collect()}
    mix = {k: float(v) for k, v in (m.split(":") for m in out[9000].mixture.split(","))}
    assert set(mix) == {f"l{k:02d}" for k in range(8)} and all(0.08 < v < 0.17 for v in mix.values())
    assert out[9001].lang_pred == "l11" or not any(not r.held_out for k, r in out.items() if 1100 <= k < 1103)


def test_mixtures_against_plain_estimation():
    """Proportions and the chosen number of languages, by loops over single texts."""
    rng = np.random.default_rng(3)
    units = rng.normal(0, 30, (60, 4))
    starts = np.array([0, 5, 6, 30])
    got, chosen = langid.mixtures(units, starts)

    def em(u, allowed):
        share = [1 / len(allowed)] * len(allowed)
        for _ in range(langid.ROUNDS):
            r = []
            for row in u:
                p = [s * math.exp(row[k] - row.max()) + 1e-300 for s, k in zip(share, allowed, strict=True)]
                r.append([x / sum(p) for x in p])
            share = [sum(x[k] for x in r) / len(u) for k in range(len(allowed))]
            share = [s / sum(share) for s in share]
        return share, sum(math.log(sum(s * math.exp(row[k] - row.max()) for s, k in zip(share, allowed, strict=True)) + 1e-300) + row.max() for row in u)

    for t, (a, b) in enumerate(zip(starts, [*starts[1:], 60], strict=True)):
        u = units[a:b]
        free, _ = em(u, range(4))
        order = np.argsort(-np.array(free), kind="stable").tolist()
        values = []
        for m in range(1, 5):
            allowed = sorted(order[:m])
            share, likelihood = em(u, allowed)
            values.append((likelihood - langid.PENALTY * (m - 1) * math.log(len(u) + 1) * langid.UNIT, m, dict(zip(allowed, share, strict=True))))
        best = max(values, key=lambda v: (v[0], -v[1]))
        assert chosen[t] == best[1] and got[t] == pytest.approx([best[2].get(k, 0.0) for k in range(4)], abs=1e-6)


def test_network_gradients():
    net = toxicity.Network(3)
    rng = np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x, mask = rng.standard_normal((5, 3, toxicity.WORD_SIZE + toxicity.GRAM_SIZE)), np.ones((5, 3))
    mask[3:, 1] = 0
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    grads, dx, _ = net.gradients(x, mask, y, w)
    for k in ("wf", "ub", "ba", "wa", "va", "wo", "bo", "bf"):
        flat, g = net.p[k].reshape(-1), grads[k].reshape(-1)
        for i in rng.choice(len(flat), min(4, len(flat)), replace=False):
            old, step = flat[i], 1e-5
            losses = []
            for v in (old + step, old - step):
                flat[i] = v
                losses.append(net.gradients(x, mask, y, w)[2])
            flat[i] = old
            assert g[i] == pytest.approx((losses[0] - losses[1]) / (2 * step), rel=2e-2, abs=1e-6)
    old = x[1, 2, 3]
    losses = []
    for v in (old + 1e-5, old - 1e-5):
        x[1, 2, 3] = v
        losses.append(net.gradients(x, mask, y, w)[2])
    x[1, 2, 3] = old
    assert dx[1, 2, 3] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=2e-2, abs=1e-6)


def test_windows_cover_whole_texts():
    for n in range(0, 200):
        starts = toxicity.windows(n)
        assert {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))
        assert len(starts) == 1 or starts[-1] + toxicity.WINDOW >= n


def test_scores_by_a_plain_network():
    """Whole texts, window by window and word by word, with loops over single numbers' vectors."""
    net = toxicity.Network(5)
    net.p["bo"] = np.array([0.3], np.float32)
    p, n = {k: v.astype(np.float64) for k, v in net.p.items()}, toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        padded = "\n" + word + "\n"
        grams = []
        for size in toxicity.GRAMS:
            for k in range(len(padded) - size + 1):
                h = size
                for ch in padded[k : k + size]:
                    h = (h * 0x100000001B3 + ord(ch)) % 2**64
                h ^= h >> 29
                h = h * 0xBF58476D1CE4E5B9 % 2**64
                grams.append((h >> 40) % toxicity.GRAM_BUCKETS)
        mean = np.mean([p["grams"][g] for g in grams], axis=0) if grams else np.zeros(toxicity.GRAM_SIZE)
        return np.concatenate([p["words"][zlib.crc32(word.encode()) % toxicity.WORD_BUCKETS], mean])

    def run(words, side):
        h, out = np.zeros(n), []
        for w in words if side == "f" else words[::-1]:
            x = vector(w) @ p["w" + side] + p["b" + side]
            z, r = sigmoid(x[:n] + h @ p["u" + side][:, :n]), sigmoid(x[n : 2 * n] + h @ p["u" + side][:, n : 2 * n])
            h = h + z * (np.tanh(x[2 * n :] + (r * h) @ p["u" + side][:, 2 * n :]) - h)
            out.append(h)
        return out if side == "f" else out[::-1]

    def score(text):
        words, best = re.findall(r"[^\W_]+", text.lower()), -math.inf
        starts = range(0, max(1, len(words) - toxicity.STRIDE if len(words) > toxicity.WINDOW else 1), toxicity.STRIDE)
        for a in starts:
            part = words[a : a + toxicity.WINDOW]
            states = [np.concatenate(s) for s in zip(run(part, "f"), run(part, "b"), strict=True)]
            if not states:
                best = max(best, p["bo"][0])
                continue
            e = np.array([np.tanh(s @ p["wa"] + p["ba"]) @ p["va"] for s in states])
            a_ = np.exp(e - e.max())
            best = max(best, sum(x * s for x, s in zip(a_ / a_.sum(), states, strict=True)) @ p["wo"] + p["bo"][0])
        return sigmoid(best)

    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(k)) for k in (0, 1, 2, 15, 16, 17, 24, 25, 40, 75)]
    assert toxicity.Scorer(net)(texts) == pytest.approx([score(t) for t in texts], abs=2e-5)


def test_toxicity_learns(spark):
    rng = random.Random(0)
    clean = [f"word{k}" for k in range(300)]
    rows = []
    for i in range(600):
        words = rng.choices(clean, k=rng.randrange(5, 120))
        if i % 3 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(("vile", "nasty", "foul")) + rng.choice(("ly", "est", "ness")))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.query(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()
    held = [r for r in out if r.held_out]
    right = np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held])
    assert right > 0.85 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_tokens_and_packing(spark, plain):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = [r.text for r in plain.values()] + ["", "I'm don't 'twas we've 42½ №5", "<|endoftext|>x", "ΣΑΣ İstanbul ﬁ", "a\x85b\xa0c\x1cd", "é é ª²", "!!!'s ''s", "x" * 300, "日本語 text"]
    for text, ids in zip(texts, packing.encode(texts, packing.default_tokenizer()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    df = spark.createDataFrame([(i, r.text) for i, r in plain.items()] + [(10**6, "word " * 9000)], "doc_id long, text string")
    rows = packing.pack(df).collect()
    texts = {i: r.text for i, r in plain.items()} | {10**6: "word " * 9000}
    total = 0
    for i, text in texts.items():
        ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in mine] == [(k, a, min(4096, len(ids) - a)) for k, a in enumerate(range(0, len(ids), 4096))]
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine]
        total += len(ids)
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and len(used) <= math.ceil(total / 4096) + 2


def test_words_are_tokenized_once(spark, monkeypatch):
    """A word that stood alone is known beside other signs, a run is looked up once a call, and cuts of a batch lose no text."""
    path, asked, real = packing.default_tokenizer(), [], packing._encode_words
    monkeypatch.setattr(packing, "_encode_words", lambda words, path: asked.extend(words) or real(words, path))
    packing.encode(["Zyxomat qorvély zyxomat"], path)
    packing.encode(['"zyxomat," (QORVÉLY) qorvély\'s', "zyxomat"], path)
    assert sorted(w for w in asked if w.isalpha()) == ["qorvély", "zyxomat"]
    texts = ["a b", "", None, "one more text, of words", "x" * 50, " \n", "日本 a", "é\xa0è"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    whole = sorted(packing.pieces(df).collect())
    monkeypatch.setattr(packing, "ENCODED", 5)
    assert sorted(packing.pieces(df).collect()) == whole
    tok = packing.tokenizer(path)
    assert [r.ids_crc32 for r in whole] == [zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for t in texts]


def test_idle_workers_keep_no_runs(spark, monkeypatch):
    """Ids of runs go when no text has come for a while, and not before; small tables start no Python workers."""
    path = packing.default_tokenizer()
    monkeypatch.setattr(packing, "KEPT_S", 1.0)
    first = packing.encode(["some words to keep"], path)
    for _ in range(3):
        time.sleep(0.5)
        assert "keep" in packing.run_ids(path)[0] and packing.encode(["some words to keep"], path) == first
    time.sleep(1.5)
    assert packing.run_ids(path) == [{}, {}] and packing.encode(["some words to keep"], path) == first
    words = [f"w{i}" for i in range(50)]
    ids = packing.encode([" ".join(words)], path)
    packing.forget(path)
    assert packing.encode([" ".join(words)], path, 10) == ids and [len(x) for x in packing.run_ids(path)] == [0, 50]
    assert all(packing.encode([w], path, 10) == packing.encode([w], path) for w in words)
    plan = packing.pack_in_order(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation [run" in plan


def held(runs, capacity):
    got = np.zeros(capacity + 1, np.int64)
    for copies, lengths, times in runs:
        assert copies > 0 and (lengths * times).sum() <= capacity
        got[lengths] += copies * times
    return got


def test_plan_is_whole():
    rng = np.random.default_rng(1)
    for scale in (0, 3, 50):
        h = np.zeros(65, np.int64)
        for n in rng.integers(1, 65, 40 * scale):
            h[n] += 1
        found = packing.plan(h, 64)
        assert (held(found.runs, 64) == h).all()
        assert found.sequences <= math.ceil((h * np.arange(65)).sum() / 64) * 1.05 + 1
    look = packing._lookup(packing.plan(h, 64).runs)
    assert len(look) == len({(a, b) for a, b, *_ in look.tolist()})


def exact_triples(seed, capacity=100, times=200):
    """Twelve kinds of three lengths that fill a sequence; the best packing is known."""
    rng, h = np.random.default_rng(seed), np.zeros(capacity + 1, np.int64)
    for _ in range(12):
        a, b = sorted(rng.integers(1, capacity, 2))
        h[a] += times
        h[b - a] += times
        h[capacity - b] += times
    h[0] = 0
    return h


@pytest.mark.parametrize(("seed", "most"), [(4, 2412), (6, 2404)])
def test_configurations_matter(seed, most):
    """Where the longest and its fullest fill go wrong, the program's configurations don't."""
    h = exact_triples(seed)
    found, greedy = packing.plan(h, 100), packing.plan(h, 100, rounds=0)
    assert greedy.rounded == 0 and found.sequences < greedy.sequences
    assert found.sequences <= most and found.value <= 1.01 * found.bound and found.bound == pytest.approx(2400)
    assert found.rounded >= 0.9 * h.sum() and (held(found.runs, 100) == h).all()


def test_configurations_hold_most_pieces():
    rng = np.random.default_rng(2)
    lognormal = np.bincount(np.clip(rng.lognormal(4, 1, 8000).astype(int) + 1, 1, 511), minlength=513)
    few = np.bincount(np.clip(rng.lognormal(4.5, 1, 700).astype(int) + 1, 1, 511), minlength=513)
    for h in (lognormal, few):
        found, greedy = packing.plan(h, 512), packing.plan(h, 512, rounds=0)
        assert (held(found.runs, 512) == h).all() and found.rounded >= 0.9 * h.sum()
        assert found.sequences <= greedy.sequences and found.value <= 1.02 * found.bound


def test_pricing_is_the_brute_force_mean():
    """Coverage is the mean over all configurations, each weighed by its lengths' odds and full or not."""
    lengths, need, capacity = np.array([5, 3, 2]), np.array([1, 2, 1]), 10
    odds, waste = np.array([0.7, 0.4, 1.5]), 0.05
    pricing = packing._Pricing(lengths, need, capacity)
    pricing.weigh(odds, waste)
    got, spare = pricing.coverage()
    total, cover, left = 0.0, np.zeros(3), 0.0
    for takes in itertools.product(*([0, 1] for _ in pricing.steps)):
        k, copies, w = pricing.steps.T
        free = capacity - int(np.dot(takes, w))
        if free < 0:
            continue
        weight = math.prod(odds[i] for i, t in zip(k, takes, strict=True) if t) * (waste / capacity if free else 1)
        total += weight
        cover += weight * np.bincount(k, np.array(takes) * copies, 3)
        left += weight * free
    assert got == pytest.approx(cover / total, rel=1e-4) and spare == pytest.approx(left / total, rel=1e-4)


def test_pipeline(spark, plain):
    """The stages one after another, against plain versions of what each decides."""
    from tokenizers import Tokenizer

    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    passed = {q.doc_id for q in quality.query(docs, labels).where("kept").collect()}
    kept = {r.doc_id: r for r in docs.collect() if r.doc_id in passed}
    pages, holding = Counter(r.source for r in kept.values()), Counter()
    for r in kept.values():
        holding.update({(r.source, x.strip(" \t\n\x0b\x0c\r")) for x in r.text.split("\n")} - {(r.source, "")})
    bad = {k for k, n in holding.items() if n >= line_dedup.MIN_PAGES and n / pages[k[0]] > line_dedup.MAX_RATIO}
    texts = {}
    for i, r in kept.items():
        lines = r.text.split("\n")
        rest = [x for x in lines if (r.source, x.strip(" \t\n\x0b\x0c\r")) not in bad]
        stays = not "".join(rest).strip(" \t\n\x0b\x0c\r")
        texts[i] = r.text if stays or len(rest) == len(lines) else "\n".join(rest)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for i, t in texts.items()}
    ids = sorted(texts)
    near = [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if sets[ids[a]] == sets[ids[b]] or len(sets[ids[a]] & sets[ids[b]]) >= 0.8 * len(sets[ids[a]] | sets[ids[b]])]
    first = {ids[k] for k, g in enumerate(groups(len(ids), near)) if g == k}
    assert {r.doc_id for r in rows} == first
    tok = Tokenizer.from_file(packing.default_tokenizer())
    for i in first:
        assert sum(r.length for r in rows if r.doc_id == i) == len(tok.encode(texts[i], add_special_tokens=False).ids) + 1


@pytest.mark.parametrize("rows", ["messy", "empty"])
def test_pipeline_on_messy_tables(spark, rows, request, labels, tmp_path):
    """Nulls, repeats, empty and long texts, extra columns with clashing names, and no rows at all."""
    docs = request.getfixturevalue(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if rows == "empty":
        assert out == []
        return
    spans = {}
    for r in out:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096
    pieces = Counter((r.doc_id, r.piece) for r in out)
    assert max(pieces.values()) == 1 and {r.doc_id for r in out} <= {1, None, 5}


def test_sequences_follow_the_mixture(spark, tmp_path, monkeypatch):
    """Sources keep their target shares over prefixes of sequence_id, which an unmixed table's sequences don't."""
    monkeypatch.setattr(packing, "LEAST_RUN", 4)
    rng = random.Random(6)
    sizes = {"big": 1600, "mid": 400, "low": 400}  # weights 2 : 1 : 1
    source = dict(enumerate(s for s, n in sizes.items() for _ in range(n)))
    df = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(40, 400))), s) for i, s in source.items()], "doc_id long, text string, source string")
    mixing.mixed(df).write.parquet(f"{tmp_path}/mixed")
    df.repartition(2, "doc_id").write.parquet(f"{tmp_path}/plain")
    far = {}
    for name in ("mixed", "plain"):
        rows = corpus_pipeline.pack_sequences(spark, spark.read.parquet(f"{tmp_path}/{name}"), SF).collect()
        assert sorted(r.doc_id for r in rows if r.piece == 0) == sorted(source)
        last = max(r.sequence_id for r in rows)
        assert {r.sequence_id for r in rows} == set(range(last + 1))
        prefixes = [Counter(source[r.doc_id] for r in rows if r.sequence_id <= last * k // 20) for k in range(4, 10)]
        far[name] = max(abs(c["big"] / c.total() - 0.5) for c in prefixes)
    assert far["mixed"] < 0.05 < 0.1 < far["plain"]


def test_near_duplicates_against_exact_jaccard(spark):
    """Pairs of known similarity: no link below 0.8, and those above found, whatever bits estimate."""
    rng = random.Random(9)
    texts, want = {}, {}
    for k in range(900):
        base = [f"t{rng.randrange(10**6)}" for _ in range(304)]
        n = round(300 * (1 - (j := 0.7 + 0.1 * k / 200 if k < 200 else 0.8 + 0.05 * (k - 200) / 600 if k < 800 else 0.85 + 0.05 * (k - 800) / 100)) / (1 + j))  # the last n shingles differ
        near = base[: 304 - n] + [f"u{rng.randrange(10**6)}" for _ in range(n)]
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(near)
        a, b = ({tuple(w[i : i + 5]) for i in range(300)} for w in (base, near))
        want[k] = len(a & b) / len(a | b)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r["first"] for r in simhash.near_classes(df).collect()}
    linked = {k for k in want if found[2 * k + 1] == 2 * k}
    assert {found[2 * k] for k in want} == {2 * k for k in want}
    assert all(want[k] >= 0.8 for k in linked)
    for lo, hi, least in ((0.8, 0.81, 0.95), (0.8, 0.85, 0.96), (0.82, 0.9, 0.97)):
        inside = [k for k in want if lo <= want[k] < hi]
        assert sum(k in linked for k in inside) >= least * len(inside)


def test_near_duplicates_behind_a_wide_claim(spark, monkeypatch):
    """A claim that holds together what is not alike hides no link, and blocks lose none."""
    rng = random.Random(10)
    base = [f"t{rng.randrange(10**6)}" for _ in range(304)]
    new = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    texts = [base, base[:262] + new(42)]  # similarity 0.75 of the first two
    texts += [texts[1][:300] + new(4), new(2) + texts[1][2:]]
    monkeypatch.setattr(simhash, "differing", lambda similarity: (200, 1))  # bits call all of them near
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for block in (256, 2):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert {r.doc_id: r["first"] for r in simhash.near_classes(df).collect()} == {0: 0, 1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("size", simhash.POSTED)
def test_combinations_of_each_length_find_a_pair_at_the_similarity(size):
    rng = np.random.default_rng(7)
    n, c = 1500, 1.6 / 1.8  # the cosine of two sets at 0.8
    x, z = rng.standard_normal((2, n, 512))
    wide = [np.hstack([np.packbits(m > 0, axis=1), np.array([simhash.steadfast(np.abs(row)) for row in m])]) for m in (x, c * x + math.sqrt(1 - c * c) * z)]
    met = 0
    for lo in range(0, n, 100):
        keys = [simhash.postings(w[lo : lo + 100], size) for w in wide]
        met += sum(len(np.intersect1d(a, b)) > 0 for a, b in zip(*keys, strict=True))
    assert met >= 0.95 * n


def test_repeated_rows_go(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "quite other words than those are"), (None, "x y"), (None, "x y"), (3, "A b c d e f g"), (4, "one id"), (4, "two texts")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.one_of_each(df).collect()) == [(0, "x y"), (0, "x y"), (1, "a b c d e f g"), (2, "quite other words than those are"), (4, "one id"), (4, "two texts")]


def test_near_duplicates_are_the_same_among_any_number_of_texts(spark):
    """Links between the same texts, alone and among more than 20,312 others (where combinations once grew longer)."""
    rng = random.Random(11)
    new = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(400):  # pairs of similarity 0.8 and just above
        base = new(304)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: 271 + k % 5] + new(33 - k % 5)))]
    others = [(1000 + k, " ".join(new(8))) for k in range(21_000)]
    few, many = ({r.doc_id: r["first"] for r in simhash.near_classes(spark.createDataFrame(x, "doc_id long, text string")).collect()} for x in (rows, rows + others))
    assert {d: many[d] for d in few} == few


def test_near_duplicates_lose_no_link(spark):
    """Pairs at 0.8 and just above, in texts long and short, among texts that share a passage: all found, none below."""
    rng = random.Random(12)
    new = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    passage, texts, want = new(14), {}, set()
    for k in range(900):
        n = (6, 10, 40, 150, 400)[k % 5]
        base = new(n) + passage * (n > 100)
        cut = (len(base) - 4) // 9 + k // 5 % 2  # the first shingles differ
        near = new(cut) + base[cut:]
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(near if cut else base[1:])
        a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (texts[2 * k].split(), texts[2 * k + 1].split()))
        if len(a & b) / len(a | b) >= 0.8:
            want.add(k)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r["first"] for r in simhash.near_classes(df).collect()}
    assert len(want) > 300 and {k for k in range(900) if found[2 * k + 1] == 2 * k} == want
    assert all(found[2 * k] == 2 * k for k in range(900))


def test_postings_are_shuffled_once(spark):
    """Candidates' postings go through one shuffle by their key, and keys of one row and of many get the same blocks as by counts apart."""
    nodes = spark.createDataFrame([(i, bytes(range(128)), 5, b"") for i in range(3)], "node long, wide binary, n long, rare binary")
    plan = simhash.candidates(nodes, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(key#\d+L?, \d+\)", plan)) == 1
    assert plan.count("MapInArrow") == 2  # postings are made once; the other searches
    posts = spark.createDataFrame([(k, i, 1 + i % 3) for k, n in enumerate((1, 2, 5, 9, 1, 40)) for i in range(n)], "key long, node long, w long")
    for more in ({}, {"alone": True}, {"weight": "w", "heaviest": 8}):
        apart, once = (in_blocks(posts, ["key"], "node", 4, 3, 10, once=once, **more) for once in (False, True))
        columns = sorted(apart.columns)
        assert sorted(once.columns) == columns
        assert sorted(once.select(columns).collect()) == sorted(apart.select(columns).collect()) != []
