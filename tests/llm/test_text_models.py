"""Operators 4 and 5: held-out accuracy and odd rows; operators 3 and 6: exact round trip and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa

from draftlake.llm import language, licenses, mpeg_audio, quality


def corpus(spark, n=400):
    rng = random.Random(0)
    words = {"en": "the of and that with from have this were which".split(), "de": "der die und nicht eine werden auch nach über für".split()}
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        own = [rng.choice(words[lang]) + rng.choice(["", "", "ing" if lang == "en" else "ung"]) for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.3
        text = " ".join(w.upper() + "!!" for w in own) if bad else " ".join(own).capitalize() + "."
        docs.append((i, text, lang, "s", len(text)))
        labels.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark, odd, none):
    docs, labels = corpus(spark)
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in got if r.doc_id in (3, 4)} == {0.0}
    assert quality.score(none, model).count() == 0
    assert quality.score(odd, quality.train(none, labels)).count() == odd.count()  # nothing learned
    clash = labels.union(spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 0), (2, None, 0)], labels.schema))
    quality.train(docs, clash)


def test_languages_on_held_out_rows(spark, odd, none):
    docs, _ = corpus(spark)
    model = language.train(docs)
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    got = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (3, 4, 5, 8)] == ["und"] * 4
    assert got[6].lang_pred in model.languages
    assert language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.train(none)).collect()} == {"und"}


def test_code_lengths_are_exact():
    text = b"abracadabra abracadabra"
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    gram, n = np.unique(language.grams(data, offsets), return_counts=True)
    model = language.Model(["x"], [gram], [n])
    counts = {}
    for k in range(len(text)):
        for order in range(4):
            context = bytes(3 + k - max(0, k))[: max(0, order - k)] + text[max(0, k - order) : k]
            counts.setdefault(context, {}).setdefault(text[k], 0)
            counts[context][text[k]] += 1

    def bits(probe):
        out = 0.0
        for k in range(len(probe)):
            for order in (3, 2, 1, 0, -1):
                if order < 0:
                    out += 8
                    break
                context = bytes(max(0, order - k)) + probe[max(0, k - order) : k]
                seen = counts.get(context)
                if not seen:
                    continue
                total, kinds = sum(seen.values()), len(seen)
                if probe[k] in seen:
                    out -= np.log2(seen[probe[k]] / (total + kinds))
                    break
                out -= np.log2(kinds / (total + kinds))
        return out

    for probe in (text, b"abrac", b"cad xyz", b"z", b"dabra abra"):
        got = model.bits(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]))
        assert abs(got[0, 0] - bits(probe)) < 1e-9


def test_media_round_trip(odd, none):
    rows = mpeg_audio.media_columns(odd).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        raw = texts[r.doc_id]
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert "bad=0;resyncs=0" in r.feature
    assert len({r.media_sha256 for r in rows if r.doc_id in (1, 2)}) == 1
    assert mpeg_audio.media_columns(none).count() == 0


def test_media_resynchronises():
    data = bytes(random.Random(1).randrange(256) for _ in range(576 * 20))
    media = mpeg_audio.encode(data, len(data))
    whole = mpeg_audio.read(media)
    assert len(whole.frames) == 20 and whole.table["frames"] == 20 and whole.tags == {"payload-bytes": str(len(data))}
    assert mpeg_audio.stored(media, whole) == (data, 0)
    at = whole.frames[7].at
    broken = media[:at] + b"\xff\xfa noise" * 5 + media[at:]
    again = mpeg_audio.read(broken)
    assert again.resyncs == 1 and len(again.frames) == 20 and mpeg_audio.stored(broken, again) == (data, 0)
    lost = media[: at + 100] + media[at + 300 :]
    again = mpeg_audio.read(lost)
    assert mpeg_audio.stored(lost, again)[1] >= 1
    flipped = bytearray(media)
    flipped[at + 10] ^= 1
    assert mpeg_audio.read(bytes(flipped)).bad_crc == 1
    assert mpeg_audio.read(b"").frames == [] and mpeg_audio.read(b"\xff" * 999).frames == []


def test_media_with_the_mark_of_an_old_tag():
    data = bytearray(random.Random(2).randrange(256) for _ in range(576 * 3))
    data[576 * 2 + 460 : 576 * 2 + 463] = b"TAG"
    media = mpeg_audio.encode(bytes(data), len(data))
    assert media[-128:-125] == b"TAG"
    assert mpeg_audio.stored(media, mpeg_audio.read(media)) == (bytes(data), 0)
    tagged = mpeg_audio.encode(bytes(576), 1) + b"TAG" + b"\xff\xfb\xb0\x04" * 31 + b"x"
    s = mpeg_audio.read(tagged)
    assert (len(s.frames), s.skipped, s.resyncs) == (1, 0, 0) and mpeg_audio.stored(tagged, s) == (bytes(576), 0)


def test_audio_headers_of_other_layers():
    f = mpeg_audio.header(bytes([0xFF, 0xFB, 0x90, 0x64]), 0)
    assert (f.version, f.layer, f.kbits, f.rate, f.size, f.samples, f.channels) == (3, 3, 128, 44100, 417, 1152, 2)
    f = mpeg_audio.header(bytes([0xFF, 0xF3, 0x40, 0xC4]), 0)
    assert (f.version, f.layer, f.kbits, f.rate, f.size, f.samples, f.channels) == (2, 3, 32, 22050, 104, 576, 1)


def test_license_scan(spark, odd, none):
    extra = [(20, "Released under the MIT License."), (21, "x\nreleased under the mit license\ny"), (22, "Licensed under the Apache\nLicense, Version 2.0."), (23, "All rights reserved.\n\nAll rights reserved.")]
    mit = f"MIT License\n\nCopyright (c) 2020 Somebody\n\n{licenses.MIT_GRANT}\n\n{licenses.MIT_NOTICE}\n\n{licenses.MIT_WARRANTY.replace('. IN', '. ' + chr(10) + 'IN')}"
    bsd = "\n \n".join([licenses.BSD_GRANT, licenses.BSD_ONE, licenses.BSD_TWO, licenses.BSD_THREE, *licenses.BSD_WARRANTY.split(". ", 1), "the end", "of it"])
    extra += [(24, mit), (25, f"some prose\n\n{mit}\n\nmore prose of another kind"), (26, bsd), (27, "licence cc by 4.0")]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {(r.doc_id, r.unit, r.unit_no, r.license): r.dice for r in licenses.scan(docs).collect()}
    t, want = licenses.THRESHOLD, {}
    import re

    for doc, text in [(r.doc_id, r.text) for r in docs.collect()]:
        if text is None:
            continue
        parts = re.split(r"\n[ \t\r]*\n", text)
        units = [("line", k, x) for k, x in enumerate(text.split("\n"))] + [("block", k, x) for k, x in enumerate(parts) if "\n" in x]
        units += [(f"block{n}", k, " ".join(parts[k : k + n])) for n in licenses.WINDOWS for k in range(len(parts) - n + 1)]
        units += [("text", 0, text)] if len(parts) > licenses.WINDOWS[-1] else []
        for unit, k, body in units:
            own = set(licenses.bigrams(body))
            for name, grams in licenses.templates():
                dice = 2 * len(own & set(grams)) / (len(own) + len(grams))
                if dice >= t:
                    want[doc, unit, k, name] = max(want.get((doc, unit, k, name), 0), dice)
    assert got == want and (20, "line", 0, "MIT") in got and (22, "block", 0, "Apache-2.0") in got
    assert (24, "block5", 0, "MIT-text") in got and (25, "block5", 1, "MIT-text") in got and (26, "text", 0, "BSD-3-Clause-text") in got
    assert licenses.scan(none).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_unit_reaches_the_threshold_without_a_marker():
    chosen = set(licenses.markers(licenses.THRESHOLD))
    for _, grams in licenses.templates():
        own = [g for g in grams if not chosen & set(g.split())]
        for n in range(len(own), licenses.size_bounds(len(grams), licenses.THRESHOLD)[1] + 1):
            if n >= licenses.size_bounds(len(grams), licenses.THRESHOLD)[0]:
                assert 2 * len(own) / (n + len(grams)) < licenses.THRESHOLD


def test_media_columns_hold_durations_and_offsets(spark):
    r = mpeg_audio.media_columns(spark.createDataFrame([(1, "x" * 2000)], "doc_id long, text string")).first()
    media = mpeg_audio.encode(mpeg_audio.payload(b"x" * 2000), 2000)
    assert (r.duration_samples, r.sample_rate) == (4 * 1152, 44100)
    assert r.seek_offsets == [f.at for f in mpeg_audio.read(media).frames] and all(media[a : a + 4] == mpeg_audio.HEADER for a in r.seek_offsets)


def test_other_table_and_layer_one_checksums():
    entries = b"".join(x.to_bytes(2, "big") for x in (5, 6, 7))
    table = mpeg_audio.OPEN_HEADER + bytes(32) + b"VBRI" + b"\0\1\0\0\0\x4b" + (9999).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"\0\3\0\2\0\2\0\1" + entries
    frame = (mpeg_audio.OPEN_HEADER).ljust(mpeg_audio.SIZE, b"\1")
    s = mpeg_audio.read(table.ljust(mpeg_audio.SIZE, b"\0") + frame * 3)
    assert s.table == {"frames": 3, "bytes": 9999, "frames_per_entry": 1, "entries": [10, 12, 14]} and len(s.frames) == 3
    head = bytes([0xFF, 0xFE, 0x90, 0x04])  # Layer I, protected, stereo
    f = mpeg_audio.header(head, 0)
    body = bytes(range(1, 33))
    crc = int(mpeg_audio.crc16(np.frombuffer(head[2:] + body, np.uint8)[None])[0]).to_bytes(2, "big")
    good = (head + crc + body).ljust(f.size, b"\2")
    bad = (head + crc + body[:-1] + b"\0").ljust(f.size, b"\2")
    s = mpeg_audio.read(good + bad + good)
    assert (f.layer, len(s.frames), s.bad_crc) == (1, 2, 1)


def test_weights_and_threshold_against_brute_force():
    rng = np.random.default_rng(3)
    x = np.zeros((60, quality.N_FEATURES))
    x[:, :2] = rng.normal(size=(60, 2))
    good = x[:, 0] + 0.5 * x[:, 1] + 0.6 * rng.normal(size=60) > 0
    model = quality.fit(x, good, pairs=200_000)
    z = (x - model.mean) / model.scale
    gaps = np.array([z[a, :2] - z[b, :2] for a in np.flatnonzero(good) for b in np.flatnonzero(~good)])
    loss = lambda w: np.logaddexp(0, -gaps @ w).mean() + 0.5e-3 * (w @ w)
    grid = [(loss(np.array([a, b])), a, b) for a in np.linspace(0, 8, 161) for b in np.linspace(-2, 6, 161)]
    assert loss(model.weight[:2]) < min(grid)[0] * 1.02
    s = z @ model.weight
    right = lambda t: ((s >= t) == good).sum()
    assert right(model.threshold) == max(right(t) for t in [*s, *(s + 1e-9)])


def test_samples_of_huge_tables_are_not_empty(spark):
    from pyspark.sql import functions as F

    from draftlake.llm.common import share_of

    n = spark.range(200_000).select(share_of(F.col("id")).alias("x")).where("x < 0.0005").count()
    assert 50 < n < 160
    assert spark.range(1000).select(share_of(F.col("id")).alias("x")).where("x < 0 or x >= 1").count() == 0


def test_features_of_nothing():
    assert quality.features(pa.array(["", None], pa.string())).sum() == 0
