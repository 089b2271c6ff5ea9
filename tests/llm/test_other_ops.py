import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_words import words
from pyspark.sql import functions as F

from marlstone.llm import _trie, components, jaccard, lattice, pieces, suffixes, warc


def brute_dedup(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + 200] for d in data for k in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        runs = sum(1 for k in range(len(d)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def hard_texts():
    """Passages at and around the length, periodic texts, one passage in many surroundings, copies, long texts."""
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage, exact, short = some(300), some(180), some(150)
    exact = exact.encode()[:200].decode("utf-8", "ignore")
    texts = [some(50) + passage + some(70), some(10) + passage[20:] + some(400), passage, some(500) + passage[:260], "ab" * 400, "x" * 199, "x" * 200, "y" * 201, None, "", some(900)]
    texts += [some(rng.randrange(300)) + passage[: rng.randrange(150, 300)] + some(100) for _ in range(30)]
    texts += [some(100) + short + some(100) for _ in range(20)] + [texts[0]] * 3 + [some(3000) * 2]
    return texts


def test_suffix_sort_survives_a_collision(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "BASES", (0, *suffixes.BASES))  # under base 0 all strings of one first byte are equal
    rng = random.Random(4)
    some = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    shared = some(260)
    left, right = [some(152), shared[:100], some(40) + shared[:100], some(152)], [b"a" + some(199), shared[100:], shared[100:] + some(40), b"a" + some(199)]
    before, after = suffixes.settled(pa.chunked_array([pa.array(left)]), pa.chunked_array([pa.array(right)]), np.array([0]), np.array([4]))
    assert after.tolist() == [0, 160, 160, 0] and before.tolist() == [0, 100, 100, 0]


@pytest.mark.parametrize("large", [20_000, 5])
def test_suffix_dedup(spark, odd, small, large, monkeypatch):
    monkeypatch.setattr(suffixes, "LARGE", large)  # small enough, groups are sorted in parts
    if large == 5:  # and groups are split in the join, and those of one context into parts
        monkeypatch.setattr(suffixes, "HOT", 3)
        monkeypatch.setattr(suffixes, "PART", 3)
    hard = spark.createDataFrame(list(enumerate(hard_texts())), "doc_id long, text string")
    for df in (hard, odd) if large == 5 else (hard, odd, small):
        held = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        want = sorted((str(i), *rest) for (i, _), rest in zip(held, brute_dedup([t for _, t in held]), strict=True))
        assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in suffixes.digest(df).collect()) == want
    assert suffixes.digest(small.limit(0)).count() == 0
    kept = suffixes.cut(odd)
    assert kept.columns == odd.columns and kept.where("text is null").count() == 1 and kept.where("n_chars != length(text)").count() == 0


def crowded_texts():
    """One passage cut at any place in many surroundings, some of which a few texts share a bit further; copies among them."""
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    passage, sides = some(420), [some(120) for _ in range(12)]
    texts = []
    for k in range(240):
        a, b = rng.randrange(180), rng.randrange(200, 420)
        before = rng.choice(sides)[rng.randrange(100) :] if k % 2 else some(60)
        a, b = (0, b) if k % 2 else (a, 420 if k % 3 else b)
        after = rng.choice(sides)[: rng.randrange(20, 120)] if k % 5 else some(60)
        texts.append(before + passage[a:b] + after)
    return texts + texts[:40] * 2 + [some(100) + passage[60:250] + some(100) for _ in range(40)]


@pytest.mark.parametrize(("large", "part"), [(40, 20), (24, 12)])
def test_suffix_dedup_of_crowded_anchors(spark, large, part, monkeypatch):
    """Groups over `large` rows are sorted part by part; nothing that two parts share may get lost."""
    for name, n in (("LARGE", large), ("PART", part), ("HOT", 16)):
        monkeypatch.setattr(suffixes, name, n)
    rounds = []
    monkeypatch.setattr(suffixes, "_narrowed", lambda *a, made=suffixes._narrowed: rounds.append(1) or made(*a))
    texts = crowded_texts()
    got = sorted(tuple(r) for r in suffixes.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == [(i, *rest) for i, rest in enumerate(brute_dedup(texts))] and rounds


def test_quarters_of_intervals():
    """They hold each place once, and four rounds end with single places."""
    held = [(0, suffixes.LEFT)]
    for _ in range(4):
        held = [q for low, high in held for q in suffixes.quarters(low, high)]
        assert [k for a, b in held for k in range(a, b + 1)] == list(range(suffixes.LEFT + 1))
    assert all(a == b for a, b in held)


def brute_links(texts, least=0.8):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent, links = list(range(len(texts))), [0] * len(texts)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= least:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))], links


def near_texts():
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(90)]
    out = []
    for _ in range(120):  # one large group of near copies
        w = list(base)
        w[rng.randrange(90)] = "other"
        out.append(" ".join(w))
    for k in range(40):
        w = [f"v{rng.randrange(4000)}" for _ in range(rng.randrange(3, 300))]
        out += [" ".join(w), " ".join(w[: max(1, len(w) - 1)]), " ".join(w).upper() + " !"]
    return out


@pytest.mark.parametrize("sizes", [(64, 4096, 2048), (4, 16, 32)])
def test_jaccard(spark, odd, sizes, monkeypatch):
    for name, n in zip(("SMALL", "LARGE", "BLOCK"), sizes, strict=True):
        monkeypatch.setattr(jaccard, name, n)
    texts = near_texts()
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    classes, links = brute_links(texts)
    assert got == {i: (c, n) for i, (c, n) in enumerate(zip(classes, links, strict=True))}


def test_jaccard_on_odd_rows(spark, odd):
    rows = odd.select("doc_id", "text").collect()
    classes, links = brute_links([r.text for r in rows])
    got = sorted((str(r.doc_id), r.n_links) for r in jaccard.digest(odd).collect())
    assert got == sorted((str(r.doc_id), n) for r, n in zip(rows, links, strict=True))
    kept = jaccard.keep_one(odd)
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert kept.columns == odd.columns and ids == sorted(["0", "1", "2", "3", "None", "4", "5", "6", "7", "8", "9", "10", "12"])
    assert jaccard.digest(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)]
    parent = list(range(200))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for e in edges for i in e if e[0] != e[1] or any(i in f and f[0] != f[1] for f in edges)}


def brute_lattice(held, vocabulary, most):
    score = {vocabulary.texts[i].decode(): vocabulary.scores[i] for i in vocabulary.ordinary}

    def walk(word):
        at = [0.0]
        for k in range(1, len(word) + 1):
            parts = [at[j] + score[word[j:k]] for j in range(max(0, k - 20), k) if word[j:k] in score]
            if word[k - 1] not in score:
                parts.append(at[k - 1] + sum(vocabulary.scores[vocabulary.bytes_at[b]] for b in word[k - 1].encode()))
            top = max(parts)
            at.append(top if most else top + math.log(sum(math.exp(p - top) for p in parts)))
        return at[-1]

    return {w: walk(w) for w in held}


def test_encoding(spark, odd, small):
    vocabulary = _trie.load()
    for df in (odd, small):
        held = df.select("doc_id", "text")
        got = pieces.digest(df).collect()
        assert len(got) == held.count() and all(r.round_trip in (True, None) for r in got)
        back = pieces.decode(pieces.encode(held).withColumnRenamed("text", "was"))
        assert back.where("not (text <=> was)").count() == 0
    texts = ["Hello  world\n\tfoo ▁x ", "", "   ", "日本語 🎉\x00"] + [r.text for r in small.limit(20).collect()]
    ids, bounds = pieces.Encoder(vocabulary).encode(texts)
    for k, t in enumerate(texts):
        best = brute_lattice(set(pieces.MARKED.findall(" " + t)), vocabulary, True)
        assert sum(vocabulary.scores[i] for i in ids[bounds[k] : bounds[k + 1]]) == pytest.approx(sum(best[w] for w in pieces.MARKED.findall(" " + t)))
    assert pieces.digest(odd.limit(0)).count() == 0 and pieces.encode(odd).columns == [*odd.columns, "ids"]
    assert pieces.encode(odd.withColumn("round_trip", F.lit(1))).columns == [*odd.columns, "round_trip", "ids"]


def brute_training(counts, vocabulary):
    """Rounds of expected piece counts by going through every arc of every token's lattice, in numbers and not logarithms."""
    by_text = {vocabulary.texts[i].decode(): i for i in vocabulary.ordinary}
    pieces, ends = vocabulary, counts[None]
    for _ in range(lattice.ROUNDS if any(counts[w] for w in counts if w is not None) else 0):
        found = [0.0] * len(pieces.texts)
        p = [math.exp(x) for x in pieces.scores]
        for w, n in counts.items():
            if w is None or not n:
                continue
            w = " " + w
            arcs = []
            for a in range(len(w)):
                for b in range(a + 1, min(len(w), a + 20) + 1):
                    if w[a:b] in by_text:
                        arcs.append((a, b, [by_text[w[a:b]]]))
                    elif b == a + 1:
                        arcs.append((a, b, [pieces.bytes_at[x] for x in w[a].encode()]))
            scale = 2.0**20  # a character, so that long tokens don't vanish
            weight = [math.prod(p[i] for i in ids) * scale ** (b - a) for a, b, ids in arcs]
            ahead, behind = [1.0] + [0.0] * len(w), [0.0] * len(w) + [1.0]
            for (a, b, _), x in zip(arcs, weight, strict=True):
                ahead[b] += ahead[a] * x
            for (a, b, _), x in sorted(zip(arcs, weight, strict=True), key=lambda k: -k[0][0]):
                behind[a] += behind[b] * x
            if not 1e-290 < ahead[-1] < 1e290:
                continue
            for (a, b, ids), x in zip(arcs, weight, strict=True):
                for i in ids:
                    found[i] += n * ahead[a] * x * behind[b] / ahead[-1]
        pieces = pieces.estimated(found, ends)
    return pieces


def test_long_words(spark):
    import re as _re
    from pathlib import Path

    vocabulary = _trie.load()
    rng = random.Random(6)
    long = ["".join(rng.choice("abcdeé日x") for _ in range(n)) for n in (255, 256, 257, 300, 900)]
    walker, short = _trie.Walker(vocabulary), []
    best, total = brute_lattice(set(long), vocabulary, True), brute_lattice(set(long), vocabulary, False)
    for w in long:
        ids = list(next(walker.segment([w])))
        assert b"".join(vocabulary.texts[i] for i in ids) == w.encode() and sum(vocabulary.scores[i] for i in ids) == pytest.approx(best[w])
        assert next(walker.likelihood([w])) == pytest.approx(total[w])
        into = [0.0] * len(vocabulary.texts)
        walker.expected([w], [3], into)
        assert sum(n * len(t) for n, t in zip(into, vocabulary.texts, strict=True)) == pytest.approx(3 * len(w.encode()))
    mixed = sorted([*long, "ab", "abc", long[0][:40], long[3][:200]])
    assert [next(walker.segment([w])) for w in mixed] == [list(x) if isinstance(x, list) else x for x in walker.segment(mixed)]
    resident = lambda: sum(map(int, _re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
    text, before = "abcdefgh" * 250_000, resident()
    ids, bounds = pieces.Encoder(vocabulary).encode([text])
    back, ends = pieces.Decoder(vocabulary).decode(ids, bounds)
    assert back[1:].tobytes() == text.encode() and resident() - before < 150
    docs = spark.createDataFrame([(1, text[:400_000]), (2, "x " + text[:3])], "doc_id long, text string")
    assert {r.n_tokens for r in lattice.digest(docs).collect()} == {2, 3}


def test_lattice(spark, odd, small, monkeypatch):
    vocabulary = _trie.load()
    assert sum(math.exp(vocabulary.scores[i]) for i in vocabulary.ordinary) + 256 * math.exp(vocabulary.scores[vocabulary.bytes_at[0]]) + math.exp(vocabulary.end) == pytest.approx(1)
    for df in (odd, small):
        rows = df.select("doc_id", "text").collect()
        tokens = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")) for r in rows]
        out = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 1 for r in rows]
        counts = Counter(w for t, o in zip(tokens, out, strict=True) if not o for w in [*t, None])
        n, v = sum(counts.values()), len(counts)
        trained = brute_training(counts, vocabulary)
        logp = brute_lattice({" " + w for t in tokens for w in t}, trained, False)
        want = []
        for r, t, o in zip(rows, tokens, out, strict=True):
            base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t, None])
            want.append((str(r.doc_id), o, len(t) + 1, sum(counts[w] > 0 for w in [*t, None]), n, base, (sum(logp[" " + w] for w in t) + trained.end) / math.log(10)))
        got = [(str(r.doc_id), *tuple(r)[1:]) for r in lattice.digest(df).collect()]
        key = lambda x: (x[0], x[2], round(x[6], 3))
        for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-4)
    first = {r.doc_id: tuple(r) for r in lattice.digest(small).collect()}
    monkeypatch.setattr(lattice, "HELD", 50)  # lists are given out in parts
    assert {r.doc_id: tuple(r) for r in lattice.digest(small).collect()} == first
    monkeypatch.setattr(lattice, "word_hashes", lambda words: np.array([len(w) % 3 for w in words], dtype=np.uint64))  # all tokens collide
    monkeypatch.setattr(lattice, "_same_bytes", lambda *_: False)
    assert {r.doc_id: tuple(r) for r in lattice.digest(small).collect()} == first
    monkeypatch.undo()
    plain = {r.doc_id: r for r in lattice.digest(small, rounds=0).collect()}
    fitted = {r.doc_id: r for r in lattice.digest(small).collect()}
    for held in (True, False):  # learning raises the probability of training texts, and of those held out
        assert sum(r.score for r in fitted.values() if r.held_out == held) > sum(r.score for r in plain.values() if r.held_out == held)
    assert lattice.digest(odd.limit(0)).count() == 0
    assert {(r.train_tokens, r.base_score) for r in lattice.digest(odd.where("doc_id = 4").withColumn("doc_id", F.lit(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)).cast("long"))).collect()} == {(0, 0.0)}


def test_warc_audit(spark, tmp_path):
    rng = random.Random(2)
    for n, segments in ((1, 1), (5, 5), (400, 1), (900, 3)):
        rows = []
        for i in range(n):
            good = hashlib.sha256(str(i).encode()).hexdigest()
            rows.append((i % segments, i, good, "0" * 64 if rng.random() < 0.02 or n == 5 and i == 3 else good, 10 + i % 7))
        found = warc.audit(spark.createDataFrame(rows, "segment int, page_id long, digest string, replica_digest string, bytes long")).collect()
        assert len(found) == n and {r.page_id for r in found if r.state == "corrupt"} == {r[1] for r in rows if r[2] != r[3]}
        assert all(r.last - r.first == r.bytes for r in found)
    kinds = "page_id long, url string, html string, state string, first long, record string"
    pages = spark.createDataFrame([(1, "http://a/", "<p>é</p>", "", 1, ""), (1, "http://a/", "<p>é</p>", "", 1, ""), (1, "http://a/", "<p>other</p>", "", 1, ""), (None, None, None, "", 1, ""), (2, "http://b/", "", "", 1, ""), (3, "http://c/\r\nx", "WARC/1.0\r\n" * 9, "", 1, ""), (4, "d", "long " * 200_000, "", 1, "")], kinds)
    assert [r.state for r in warc.drill(pages, {}).collect()] == ["intact"] * 7 and warc.drill(pages.limit(0)).count() == 0
    warc.write_segments(pages, str(tmp_path / "w"), 2)
    held = warc.read_segments(spark, str(tmp_path / "w")).collect()
    want = Counter(r[0] for r in pages.select(warc.record(F.col("url"), F.col("html"), F.col("page_id"))).collect())
    assert Counter(bytes(r.record).decode() for r in held) == want and sorted(str(r.page_id) for r in held) == ["1", "1", "1", "2", "3", "4", "None"]
    assert all(r.digest == hashlib.sha256(bytes(r.record)).hexdigest() and r.last - r.first == r.bytes == len(r.record) for r in held)


def test_warc_reader_keeps_damage_in_its_record():
    make = lambda n, body: b"WARC/1.0\r\nWARC-Record-ID: <urn:md5:n%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, len(body), body)
    parts = [make(1, b"abc"), make(2, b"x" * 50), make(3, b""), make(4, b"\r\n\r\n")]
    for bad in (parts[1] + b"more\r\n", parts[1][:-30] + b"\r\n", parts[1].replace(b"Content-Length", b"Content-Lxngth"), parts[1].replace(b": 50", b": 5000"), parts[1][:-2] + b"X\n"):
        data = b"".join([parts[0], bad, *parts[2:]])
        found = [data[a:b] for a, b, _, _ in warc.records_in(data)]
        assert found == [parts[0], bad, *parts[2:]] and [n for *_, n, _ in warc.records_in(data)] == ["n1", "n2", "n3", "n4"]


def test_warc_audit_of_an_independent_replica(spark):
    kinds = "segment int, page_id long, name string, digest string, bytes long"
    for n, segments in ((40, 1), (257, 1), (600, 3)):
        mine = [(i % segments, i, f"n{i}", f"d{i}", 10 + i % 7) for i in range(n)]
        theirs = [(s, i, name, "bad" if i == 7 else d, b + 5 * (i == n - 4)) for s, i, name, d, b in mine if i != n - 9] + [(0, n - 12, "new", "x", 3)]
        theirs = [(s, i, name, "longer" if i == n - 4 else d, b) for s, i, name, d, b in theirs]
        spans = []
        for side in (mine, theirs):
            at, held = Counter(), {}
            for s, i, name, d, b in sorted(side, key=lambda r: (r[0], r[1], r[3])):
                held[name] = (d, at[s], at[s] + b)
                at[s] += b
            spans.append(held)
        state = lambda a, b: "missing" if b is None else "extra" if a is None else "corrupt" if a[0] != b[0] else "intact" if a == b else "moved"
        got = warc.audit(spark.createDataFrame(mine, kinds), spark.createDataFrame(theirs, kinds)).collect()
        assert len(got) == n + 1 and {r.name: r.state for r in got} == {k: state(spans[0].get(k), spans[1].get(k)) for k in spans[0] | spans[1]}
        assert {"missing", "extra", "corrupt", "intact", "moved"} == {r.state for r in got}
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>") for i in range(300)], "page_id long, url string, html string")
    harms = {"damage": "0", "lose": "1", "lengthen": "2", "add": "3"}
    hit = Counter(hashlib.md5(f"{i}|http://a/{i}".encode()).hexdigest()[0] for i in range(300))
    got = Counter(r.state for r in warc.drill(pages, harms).collect())
    assert (got["corrupt"], got["missing"], got["extra"]) == (hit["0"] + hit["2"], hit["1"], hit["3"]) and sum(got.values()) == 300 + hit["3"] and got["moved"]
    assert {r.state for r in warc.audit(spark.createDataFrame([], kinds), spark.createDataFrame(mine, kinds)).collect()} == {"extra"}


def brute_cut(texts):
    """Texts without the bytes of 200-byte strings that start twice; halves of characters go."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + 200] for d in data for k in range(len(d) - 199))
    out = []
    for t, d in zip(texts, data, strict=True):
        gone = bytearray(len(d))
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        runs = re.finditer(rb"\0+", bytes(gone))
        out.append(None if t is None else "".join(d[m.start() : m.end()].decode("utf-8", "ignore") for m in runs))
    return out


def run_by_hand(docs, items, known, contaminated):
    """(doc_id, text) after the four filtering stages, each by brute force on what the one before left."""
    left = [(r.doc_id, r.text) for r in docs if known(r.text)]
    left = sorted(set(left), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    classes, links = brute_links([t for _, t in left])
    left = [r for i, r in enumerate(left) if classes[i] == i]
    left = list(zip([i for i, _ in left], brute_cut([t for _, t in left]), strict=True))
    return [(i, t) for i, t in left if not contaminated(t, items)]


def test_pipeline(spark, tmp_path, odd):
    import corpus_pipeline
    from test_first_ops import brute_contamination

    from marlstone.llm import langid

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "suffix_dedup", "decontamination", "sentencepiece"]
    sf = "/root/testdata/sf0.001"
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    vocabulary = _trie.load()
    odd_folder = tmp_path / "odd"
    kept = odd.where("lang is not null or doc_id in (5, 10, 11)").withColumn("lang", F.lit("en"))
    kept.write.parquet(f"{odd_folder}/documents.parquet")
    bench.write.parquet(f"{odd_folder}/benchmark.parquet")
    for folder in (sf, str(odd_folder)):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        model = langid.learn(docs)

        def known(text, model=model):
            data = np.frombuffer((text or "").encode(), dtype=np.uint8)
            bits = model.bits(data, np.array([0, len(data)]))[0].min() if len(data) else 0
            return any(c.isalpha() for c in text or "") and bits <= 8 * len(data)

        want = run_by_hand(docs.collect(), items, known, lambda t, i: brute_contamination(t, i)[-1])
        got = corpus_pipeline.run(spark, folder).collect()
        back = sorted((str(r.doc_id), b"".join(vocabulary.texts[i] for i in r.ids)[1:].decode()) for r in got)
        assert back == sorted((str(i), t) for i, t in want) and all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
    docs = odd
    for name, stage in corpus_pipeline.STAGES:  # odd columns, and empty tables
        out = stage(spark, docs, str(odd_folder))
        assert stage(spark, docs.limit(0), str(odd_folder)).count() == 0
        if name != "sentencepiece":
            assert out.columns == odd.columns
            docs = spark.createDataFrame(out.collect(), odd.schema)


def test_jaccard_recall_on_table(spark):
    """Every link and class of sf0.01 against exact similarities by an inverted index."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    sets = []
    for r in rows:
        w = words(r.text)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    places = {}
    for i, s in enumerate(sets):
        for g in s:
            places.setdefault(g, []).append(i)
    shared = Counter((i, j) for held in places.values() for x, j in enumerate(held) for i in held[:x])
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, j), n in shared.items():
        if n / (len(sets[i]) + len(sets[j]) - n) >= 0.8:
            links[i] += 1
            links[j] += 1
            parent[max(root(i), root(j))] = min(root(i), root(j))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.digest(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert sum(links) > 200 and got == {r.doc_id: (rows[root(i)].doc_id, links[i]) for i, r in enumerate(rows)}
