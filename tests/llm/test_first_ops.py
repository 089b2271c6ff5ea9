import hashlib
import math
import random
import struct
import textwrap
import zlib

import numpy as np
import pytest
from conftest_words import words

from marlstone.llm import contamination, langid, licenses, media, sharding


def rows(df):
    return [r.asDict() for r in df.collect()]


def check_shards(df, n, k):
    got = rows(df)
    assert len(got) == n
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(s, ())) for s in range(k)]
    assert max(sizes) - min(sizes) <= 1
    return got


def test_sharding(spark, odd, small):
    check_shards(sharding.digest(odd), 15, 40)
    again = check_shards(sharding.digest(small), 200, 40)
    moved = check_shards(sharding.digest(small.repartition(7)), 200, 40)
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in again) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in moved)
    text = {r.doc_id: r.text for r in small.collect()}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in again)
    assert sharding.digest(small.limit(0)).count() == 0
    kept = sharding.assign(odd, 4)
    assert kept.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"]


def test_feistel_is_a_bijection(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 10, 997, 1000):
        left, right = sharding.domain(n)
        assert left * right >= n and left * right - n < left
        steps = sharding.walk_length(spark.range(1), n, 7)
        places = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, steps, 7)).collect()]
        assert sorted(places) == list(range(n))


def test_media(odd, small):
    for df in (odd, small):
        text = sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
        got = sorted(rows(media.digest(df)), key=lambda r: (str(r["doc_id"]), r["n_bytes"]))
        assert len(got) == len(text)
        want = sorted((str(i), len((t or "").encode()), t) for i, t in [(i, t or "") for i, t in text])
        for r, (i, n, t) in zip(got, want, strict=True):
            data = t.encode()
            data += b"\xff" * (-len(data) % 576 or (0 if data else 576))
            assert (str(r["doc_id"]), r["n_bytes"], r["payload_bytes"]) == (i, n, len(data))
            assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-32:])
    assert media.digest(small.limit(0)).count() == 0
    frames = media.media_columns(small.limit(3)).collect()[0]
    assert frames.frames and sum(frames.frames[0].histogram) % 24 == 0


def compress(samples, code_size):
    """A plain LZW coder with a growing table."""
    clear, bits, out = 1 << code_size, [], b""
    put = lambda code, width: bits.extend((code >> i) & 1 for i in range(width))
    table, width, word = {bytes([i]): i for i in range(clear)}, code_size + 1, b""
    put(clear, width)
    following = clear + 2
    for s in samples:
        longer = word + bytes([s])
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = following
        if following == 1 << width and width < 12:
            width += 1
        following += 1
        if following == 4096:
            put(clear, width)
            table, width, following = {bytes([i]): i for i in range(clear)}, code_size + 1, clear + 2
        word = bytes([s])
    put(table[word], width)
    put(clear + 1, width)
    out = np.packbits(np.array(bits, dtype=np.uint8), bitorder="little").tobytes()
    return out


@pytest.mark.parametrize("code_size", [2, 4, 8])
def test_lzw_with_a_table(code_size):
    rng = np.random.default_rng(code_size)
    samples = rng.integers(0, 1 << code_size, 9000).astype(np.uint8)
    samples[2000:6000] = samples[2000]
    assert (media.lzw_unpack(compress(samples.tolist(), code_size), code_size, len(samples)) == samples).all()


def expand(stream, code_size):
    """A plain LZW decoder that reads bit by bit."""
    bits, at, clear, out = [b >> i & 1 for b in stream for i in range(8)], 0, 1 << code_size, b""
    table, last, width = None, None, code_size + 1
    while True:
        code = sum(bits[at + i] << i for i in range(width))
        at += width
        if code == clear:
            table, last, width = [bytes([i]) for i in range(clear)] + [None, None], None, code_size + 1
            continue
        if code == clear + 1:
            return out, len(table)
        entry = table[code] if code < len(table) else last + last[:1]
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
        width = min(12, max(code_size + 1, len(table).bit_length()))
        out, last = out + entry, entry


def plain_gif(media):
    """Composed grey frames by the rules of the format, read without the library."""
    width, height = struct.unpack_from("<HH", media, 6)
    at, canvas, frames, grew = 13 + 768, [0] * (width * height), [], 0
    assert media[10] & 0x87 == 0x87 and media[13 : 13 + 768] == bytes(v for v in range(256) for _ in range(3))
    while media[at] != 0x3B:
        assert media[at : at + 3] == b"\x21\xf9\x04"
        packed, delay, index = struct.unpack_from("<BHB", media, at + 3)
        left, top, w, h, flags, size = struct.unpack_from("<HHHHBB", media, at + 9)
        assert (left, top, w, flags, size) == (0, 0, width, 0, 8)
        at, stream = at + 19, b""
        while media[at]:
            stream += media[at + 1 : at + 1 + media[at]]
            at += media[at] + 1
        at += 1
        samples, entries = expand(stream, 8)
        grew += entries > 258
        before = list(canvas)
        for k, v in enumerate(samples):
            if not (packed & 1 and v == index):
                canvas[k] = v
        frames.append((bytes(canvas), w * h, delay))
        disposal = packed >> 2 & 7
        canvas = before if disposal == 3 else [0] * (w * h) + canvas[w * h :] if disposal == 2 else canvas
    return frames, grew


def test_stored_media_by_a_plain_decoder(odd, small):
    for df in (odd, small.limit(40)):
        stored = {(str(r.doc_id), hashlib.sha256(bytes(r.media)).hexdigest(), len(r.media)): r for r in media.media_columns(df).collect()}
        got = rows(media.digest(df))
        assert {(str(r["doc_id"]), r["media_sha256"], r["media_bytes"]) for r in got} == set(stored)
        for r in got:
            frames, grew = plain_gif(bytes(stored[str(r["doc_id"]), r["media_sha256"], r["media_bytes"]].media))
            back = b"".join(c[:n] for c, n, _ in frames)
            assert hashlib.sha256(back).hexdigest() == r["payload_sha256"] and grew == len(frames)
            bins = np.bincount([(v >> 6) * 21 for c, _, _ in frames for v in c], minlength=64)
            assert r["feature"] == f"{len(frames)}x24:{sum(d for *_, d in frames) * 10}ms:" + ",".join(f"{i}={n}" for i, n in enumerate(bins) if n)


def test_lzw_streams_of_any_samples():
    rng = np.random.default_rng(1)
    for n in (1, 2, 576, 5000, 40_000):
        for most in (1, 2, 7, 256):
            samples = rng.integers(0, most, n).astype(np.uint8)
            stream = media.lzw_pack(samples.tobytes())
            assert expand(stream, 8)[0] == samples.tobytes() if n <= 5000 else True
            assert (media.lzw_unpack(stream, 8, n) == samples).all() and len(media.lzw_unpack(stream, 8, n // 2)) == n // 2
    with pytest.raises(ValueError):
        media.lzw_unpack(np.packbits(np.array([c >> i & 1 for c in (256, 65, 300, 257) for i in range(9)], dtype=bool), bitorder="little").tobytes(), 8, 9)


def picture(frames, width=4, height=4):
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81, 0, 0) + bytes([9, 9, 9, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    for disposal, transparent, (left, top, w, h), samples, flags in frames:
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), 5, transparent or 0, 0)
        data = compress(samples, 2)
        out += struct.pack("<BHHHHBB", 0x2C, left, top, w, h, flags, 2) + bytes([len(data)]) + data + b"\0"
    return out + b"\x21\xfe\x03abc\0\x3b"


def test_disposal_transparency_and_interlace():
    whole, corner = (0, 0, 4, 4), (2, 2, 2, 2)
    a, b, c, d = list(media.decode(picture([(1, None, whole, [1] * 16, 0), (2, None, corner, [2] * 4, 0), (3, 3, corner, [3, 1, 3, 1], 0), (0, None, (0, 0, 1, 4), [0, 1, 2, 3], 0x40)])))
    assert (a.canvas == [255, 0, 0]).all() and (b.canvas[2:, 2:] == [0, 255, 0]).all() and (b.canvas[:2] == [255, 0, 0]).all()
    assert (c.canvas[2:, 2] == [9, 9, 9]).all() and (c.canvas[2:, 3] == [255, 0, 0]).all()
    assert (d.canvas[2:, 2:] == [9, 9, 9]).all() and d.indices.ravel().tolist() == [0, 2, 1, 3]
    assert [f.start_ms for f in (a, b, c, d)] == [0, 50, 100, 150]


def brute_phrases(text):
    w, places, labels = words(text), [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return w, places, labels


def brute_templates(text):
    found = {}
    for line in (text or "").split("\n"):
        have = set(words(line))
        for label, template in licenses.TEMPLATES:
            t = set(words(template))
            share = len(have & t) / len(t)
            if share >= licenses.THRESHOLD:
                found[label] = max(share, found.get(label, 0))
    return found


def test_licenses(spark, odd, small):
    extra = spark.createDataFrame([(100 + k, "x y\n" + t.replace("free", "gratis") + "\nz") for k, (_, t) in enumerate(licenses.TEMPLATES)], "doc_id long, text string")
    for df in (odd.select("doc_id", "text"), small.select("doc_id", "text"), extra):
        text = sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
        got = sorted(rows(licenses.scan(df)), key=lambda r: (str(r["doc_id"]), r["n_words"]))
        want = []
        for i, t in text:
            w, places, labels = brute_phrases(t)
            found = brute_templates(t)
            want.append((str(i), len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | set(found))), 1.0 if places else max(found.values(), default=0.0)))
        want.sort(key=lambda r: (r[0], r[1]))
        assert [(str(r["doc_id"]), *list(r.values())[1:]) for r in got] == want
    assert licenses.scan(small.limit(0)).count() == 0


def brute_runs(text):
    found, w = {}, words(text)
    for label, template in licenses.TEMPLATES:
        t = words(template)
        n = math.ceil(len(t) / licenses.THRESHOLD)
        share = max((len(set(w[i : i + n]) & set(t)) / len(set(t)) for i in range(len(w))), default=0)
        if share >= licenses.THRESHOLD:
            found[label] = max(share, found.get(label, 0))
    return found


def test_wrapped_licenses(spark):
    rng, texts = random.Random(5), []
    for label, template in licenses.TEMPLATES:
        for width in (24, 72):
            texts.append("Lead words here.\n\n" + "\n".join(" * " + x for x in textwrap.wrap(template, width)) + "\n *\n * the rest")
        w = template.split()
        for share in (0.6, 0.75, 0.8, 0.85, 0.95):
            mixed = [x if rng.random() < share else rng.choice(["the", "of", "gratis", "license"]) for x in w]
            texts.append("\n".join(" ".join(mixed[i : i + 4]) for i in range(0, len(w), 4)))
    half = licenses.TEMPLATES[0][1].split()
    texts += [" ".join(half[:15]), " ".join(half[15:]), " ".join(half[:15]) + "\nlong gap\n" * 30 + " ".join(half[15:]), "\n".join(half * 3)]
    got = {r["doc_id"]: r for r in rows(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)))}
    for k, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in got[7 * k]["labels"].split(",") and label in got[7 * k + 1]["labels"].split(",") and got[7 * k + 1]["score"] == 1
    for k, t in enumerate(texts):
        base, (line, run) = brute_phrases(t)[2], (brute_templates(t), brute_runs(t))
        assert got[k]["labels"] == ",".join(sorted(base | set(line) | set(run)))
        assert got[k]["score"] == (1.0 if base else max([0.0, *line.values(), *run.values()]))


def test_language_by_brute_force(small):
    model, counts = langid.learn(small, order=2, sample=10**6), {}
    for r in small.collect():
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            language, s = model.languages.index(r.lang), b"  " + r.text.encode()
            for i in range(2, len(s)):
                for k in range(3):
                    seen = counts.setdefault((language, tuple(s[i - 2 + k : i])), {})
                    seen[s[i]] = seen.get(s[i], 0) + 1

    def p(language, context, s):
        if context is None:
            return 1 / langid.CLASSES
        seen, shorter = counts.get((language, context), {}), p(language, context[1:] if context else None, s)
        n, d = sum(seen.values()), len(seen)
        return seen[s] / (n + d) if s in seen else d * shorter / (n + d) if n else shorter

    texts = [r.text.encode() for r in small.limit(12).collect()]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.bits(data, bounds)
    for t, row in zip(texts, got, strict=True):
        s = [langid.SPACE] * 2 + [int(langid.FOLD[b]) for b in t]
        for language in range(len(model.languages)):
            want = sum(-np.log2(p(language, tuple(s[i - 2 : i]), s[i])) for i in range(2, len(s)))
            assert abs(row[language] - want) < 1e-5 * want + 1e-2


def test_language_order_with_many_languages(spark):
    texts = [(k, f"{x}ab{x}ac " * 20, f"l{k % 9}") for k, x in enumerate("qwrtypsdfghjklzxcvbnmqwrtyps")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert len(model.languages) == 9 and model.order == langid.ORDER == 3
    text = np.frombuffer(b"qabqac", dtype=np.uint8)
    one = langid.learn(docs.where(docs.lang == model.languages[0]))
    assert model.bits(text, np.array([0, 6]))[0, 0] == one.bits(text, np.array([0, 6]))[0, 0]


def test_language_tells_every_byte_apart(spark):
    assert len(set(langid.FOLD.tolist())) == langid.CLASSES == 256
    docs = spark.createDataFrame([(k, t * 30, lang) for k in range(8) for t, lang in (("casá fué ", "aa"), ("casñ fùé ", "bb"), ("дом ", "cc"), ("δομ ", "dd"))], "doc_id long, text string, lang string")
    ask = spark.createDataFrame([(1, "á", "aa"), (2, "ñ", "bb"), (3, "д", "cc"), (4, "δ", "dd")], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    for r in ask.collect():
        text = np.frombuffer(r.text.encode(), dtype=np.uint8)
        assert model.predict(text, np.array([0, len(text)]))[0] == [r.lang]


def test_language_held_out_accuracy_and_odd_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'").collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found) > 0
    got = {r["doc_id"]: r for r in rows(langid.digest(odd))}
    assert got[0]["lang_pred"] == got[6]["lang_pred"] == got[12]["lang_pred"] == "und" and got[7]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in rows(langid.digest(odd.where("lang is null")))} == {"und"}
    assert langid.digest(odd.limit(0)).count() == 0


def brute_contamination(text, items):
    w, hit, found, places = words(text), set(), set(), {}
    for item, t in items:
        p = words(t)
        m = min(13, len(p))
        for i in range(len(p) - m + 1) if m else ():
            places.setdefault(m, {}).setdefault(tuple(p[i : i + m]), set()).add(item)
    for m, windows in places.items():
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in windows:
                hit.update(range(i, i + m))
                found |= windows[tuple(w[i : i + m])]
    n = len(w)
    return n, len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= n


def test_contamination(spark, odd, small):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    short = spark.createDataFrame([(900, "x"), (901, "a"), (902, None), (903, "--"), (904, "Five SIX, one"), (905, "five six one"), (906, " ".join(f"w{i}" for i in range(30)) + " w3 w4 w3 w4")], "item_id long, text string")
    items = bench.union(short)
    listed = [(r.item_id, r.text) for r in items.collect()]
    spliced = spark.createDataFrame([(500 + k, "lead in " + " ".join((t or "").split()[5:30]) + " tail") for k, (_, t) in enumerate(listed)], "doc_id long, text string")
    for df in (odd.select("doc_id", "text"), small.select("doc_id", "text"), spliced):
        want = sorted(((str(r.doc_id), *brute_contamination(r.text, listed)) for r in df.collect()), key=str)
        for size in (contamination.ITEM_BYTES, 2000):
            spans = contamination.find_spans(df, items, item_bytes=size)
            assert spans.columns == ["doc_id", "text", "starts", "lengths", "items"]
            got = sorted(((str(r["doc_id"]), *list(r.values())[1:]) for r in rows(contamination.digest(df, items, item_bytes=size))), key=str)
            assert got == want
    assert contamination.digest(odd, items.limit(0)).where("contaminated").count() == 0
    assert contamination.digest(odd.limit(0), items).count() == 0
    one, many = (sorted(map(str, contamination.find_spans(small, items, item_bytes=b).select("doc_id", "items").collect())) for b in (contamination.ITEM_BYTES, 2000))
    assert one == many
    clash = odd.withColumns({c: odd.doc_id for c in ("starts", "lengths", "items", "n_hit", "contaminated")})
    assert contamination.clean(clash, items).columns == clash.columns and contamination.digest(clash, items).count() == 15
    kept = {r.doc_id for r in contamination.clean(small, items).collect()}
    assert kept == {r.doc_id for r in small.collect() if not brute_contamination(r.text, listed)[-1]}
