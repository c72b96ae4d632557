"""Queries without SQL, against plain Python over the smallest tables."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from titerlake.llm import idcoder, jaccard, language, mixing, packing, quality, secrets, telephony
from titerlake.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return {r["doc_id"]: r for r in rows}


def rows_of(spark, name):
    out = QUERIES[name](spark, SF).collect()
    return {r["doc_id"]: r for r in out}, out


def test_secret_scan_equals_plain_regexes(spark, docs):
    got, rows = rows_of(spark, "op2_secret_scan")
    assert len(rows) == len(docs)
    rules = [
        ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    for i, d in docs.items():
        found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, rx, ok) in enumerate(rules) for m in rx.finditer(d["text"] or "") if ok(m)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest()
        assert [got[i][f"n_{kind}"] for kind, *_ in rules] == [sum(x[1] == k for x in found) for k in range(3)]


def test_trigram_queries_hold_for_every_match():
    assert secrets.trigram_query("[0-9a-f]{24,}") == []
    clause = secrets.trigram_query(r"AKIA[A-Z0-9]+")
    assert frozenset({b"aki", b"kia"}) in clause[0]


def test_token_ids_equal_whole_text_encoding(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, rows = rows_of(spark, "op3_token_ids")
    assert len(rows) == len(docs)
    start = 0
    for i in sorted(docs):
        ids = [*tokenizer.encode(docs[i]["text"] or "", add_special_tokens=False).ids, 1]
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(raw))
        start += len(ids)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 129, 1025, 5000, 300000])
def test_id_coder_round_trip_and_damage(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 49000).astype(np.int64)
    coded = idcoder.encode(ids)
    assert (idcoder.decode(coded) == ids).all()
    if n > 1000:
        for at in (len(coded) // 2, len(coded) - 9, 40):
            bad = bytearray(coded)
            bad[at] ^= 0x55
            with pytest.raises(ValueError):
                idcoder.decode(bytes(bad))


def test_id_coder_takes_any_32_bit_id_in_several_blocks(monkeypatch):
    monkeypatch.setattr(idcoder, "BLOCK", 1 << 12)
    ids = np.random.default_rng(5).integers(0, 1 << 32, 10000)
    assert (idcoder.decode(idcoder.encode(ids)) == ids).all()
    for wrong in (-1, 1 << 32):
        with pytest.raises(ValueError):
            idcoder.encode(np.array([wrong]))


def test_id_coder_beats_zlib_and_the_ids_own_entropy():
    import public_tokenizers

    from titerlake.llm.tokenids import WordEncoder

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].combine_chunks()
    ids, _ = WordEncoder(public_tokenizers.path("word_bpe_49k.json")).encode(texts)
    share = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    coded = 8 * len(idcoder.encode(ids)) / len(ids)
    assert coded < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids)
    assert coded < -(share * np.log2(share)).sum()


def test_words_put_together_equal_whole_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from titerlake.llm.tokenids import WordEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["it's. a|b | || x. y, .z 3. ... don't, I'll. ok.,", "", None, "<|endoftext|>. é. e\u0301. \u0391\u03a3. \u03a3, |", "|", ".", " \n\t", "a.b. c,d, 'S. 'll,"]
    ids, counts = WordEncoder(path).encode(pa.array(texts))
    whole = Tokenizer.from_file(path)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_jaccard_components_equal_all_pairs(spark, docs):
    def shingles(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[j : j + 4]) for j in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set()

    sets = {i: shingles(d["text"]) for i, d in docs.items()}
    root = {i: i for i in docs}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got, rows = rows_of(spark, "op4_jaccard_join")
    assert len(rows) == len(docs)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(sets[i]), find(i)) for i in ids}


def test_packing_is_whole_tight_and_without_conflicts(spark, docs):
    rows = QUERIES["op5_best_fit_packing"](spark, SF).collect()
    filled, holders, bins = {}, {}, {}
    for r in rows:
        filled[r["doc_id"]] = filled.get(r["doc_id"], 0) + r["length"]
        key = (r["file"], r["window"], r["bin"])
        bins.setdefault(key, []).append((r["bin_offset"], r["length"]))
        holders.setdefault(key, []).append(docs[r["doc_id"]])
    assert filled == {i: len(WORD.findall(d["text"] or "")) + 1 for i, d in docs.items()}
    for key, parts in bins.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        assert len({d["source"] for d in holders[key]}) == len(holders[key]) == len({d["text"] for d in holders[key]})


def test_best_fit_equals_a_scan_of_all_bins():
    rng = np.random.default_rng(3)
    items = [(int(rng.integers(1, 90)), "abcd"[rng.integers(4)], int(rng.integers(12))) for _ in range(80)]
    got = packing.best_fit(items, 100)
    bins: list[list] = []
    for minus, i in sorted((-size, i) for i, (size, *_) in enumerate(items)):
        fits = [(b[0] + minus, k) for k, b in enumerate(bins) if b[0] >= -minus and items[i][1] not in b[1] and items[i][2] not in b[2]]
        if not fits:
            bins.append([100, set(), set()])
        k = min(fits)[1] if fits else len(bins) - 1
        assert got[i][0][1] == k
        bins[k][0] += minus
        bins[k][1].add(items[i][1])
        bins[k][2].add(items[i][2])


def test_quality_statistics_equal_plain_counts(spark, docs):
    got, rows = rows_of(spark, "op6_quality_rules")
    assert len(rows) == len(docs)
    for i, d in docs.items():
        text = d["text"] or ""
        words = WORD.findall(text)
        lines = [line for line in text.split("\n")]
        dup = sum(1 for k, line in enumerate(lines) if WORD.search(line) and line in lines[:k])
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        times = {}
        for g in grams:
            times[g] = times.get(g, 0) + 1
        covered = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        r = got[i]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (failed and r["kept"])


def test_pfair_round_stays_within_one_block():
    counts = mixing.slot_counts({"a": 0.5, "b": 0.3, "c": 0.19, "d": 0.01}, 100)
    assert sum(counts.values()) == 100
    done = dict.fromkeys(counts, 0)
    for now, (source, k) in enumerate(mixing.pfair_round(counts), 1):
        assert k == done[source]
        done[source] += 1
        assert all(abs(done[s] - now * counts[s] / 100) < 1 for s in counts)


def test_mix_keeps_all_and_cuts_streams_into_blocks(spark, docs):
    rows = QUERIES["op7_mix_sources"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    streams = {}
    for r in sorted(rows, key=lambda r: (r["slot"], r["start"])):
        assert r["start"] == streams.get(r["source"], 0)
        assert r["block"] == r["start"] // mixing.BLOCK_CHARS
        streams[r["source"]] = r["start"] + max(r["chars"], 1)
    owners = {}
    for r in rows:
        assert owners.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])


def test_language_is_right_on_held_out_documents(spark):
    rows = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()}
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_bit_slices_equal_sets():
    import pyarrow as pa

    texts = pa.array(["the cat sat", "der hund", "", None, "the hund"])
    grams = {name: np.unique(language.gram_codes(pa.array([t]))[0]).tolist() for name, t in (("x", "the cat sat"), ("y", "der hund"))}
    model = language.LanguageFilter(grams)
    codes, offsets = language.gram_codes(texts)
    for i, share in enumerate(model.shares(texts)):
        own = codes[offsets[i] : offsets[i + 1]].tolist()
        for k, name in enumerate(("x", "y")):
            exact = sum(c in set(grams[name]) for c in own) / max(len(own), 1)
            assert abs(share[k] - exact) < 0.05


def test_telephony_reads_back_what_was_stored(spark, docs):
    got, rows = rows_of(spark, "op10_telephony")
    assert len(rows) == len(docs)
    for i, d in docs.items():
        raw = (d["text"] or "").encode()
        payload = raw.ljust(-(-max(len(raw), 1) // 576) * 576, b"\xff")
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert tuple(got[i][c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) == want


def plain_ima(block):
    """One ADPCM block, sample by sample."""
    if len(block) < 4:
        return []
    value, index = int(block[:2].copy().view("<i2")[0]), min(int(block[2]), 88)
    out = [value]
    for byte in block[4:].tolist():
        for nibble in (byte & 15, byte >> 4):
            step = int(telephony.STEP[index])
            change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + int(telephony.INDEX_STEP[nibble])))
            out.append(value)
    return out


def plain_pcm(payload, codec, block=144):
    if codec == telephony.IMA:
        raw = np.frombuffer(payload, np.uint8)
        samples = [s for i in range(0, len(raw), block) for s in plain_ima(raw[i : i + block])]
    else:
        samples = telephony.TABLES[codec][np.frombuffer(payload, np.uint8)].tolist()
    return [x for i, s in enumerate(samples) for x in (s, (s + samples[min(i + 1, len(samples) - 1)]) >> 1)]


def test_telephony_pcm_and_feature_equal_plain_decoding(spark, docs):
    got, _ = rows_of(spark, "op10_telephony")
    for i in sorted(docs, key=lambda i: len(docs[i]["text"] or ""))[:60]:
        raw = (docs[i]["text"] or "").encode()
        payload = raw.ljust(-(-max(len(raw), 1) // 576) * 576, b"\xff")
        codec = (telephony.MULAW, telephony.ALAW, telephony.IMA)[zlib.crc32(payload) % 3]
        want = np.array(plain_pcm(payload, codec), "<i2")
        r = got[i]
        assert bytes(r["pcm"])[44:] == want.tobytes() and r["pcm_sha256"] == hashlib.sha256(r["pcm"]).hexdigest()
        assert r["media_bytes"] >= len(payload) + 44 and struct.unpack_from("<I", r["pcm"], 24)[0] == 16000
        wide = want.astype(int)
        assert r["feature"] == (
            f"codec={telephony.NAMES[codec]};seconds={len(wide) / 16000:.3f};rms={np.sqrt((wide**2).sum() / len(wide)):.2f};peak={abs(wide).max()};"
            f"crossings={sum((a < 0) != (b < 0) for a, b in zip(wide, wide[1:]))};mean={wide.sum() / len(wide):.2f}"
        )


def test_telephony_honours_the_header():
    blocks = np.random.default_rng(2).integers(0, 256, 600).astype(np.uint8).tobytes()
    form = struct.pack("<HHIIHHHH", 17, 1, 11025, 5600, 256, 4, 2, 505)
    wave = telephony.from_wav(b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"LIST\x01\0\0\0x\0" + b"data" + struct.pack("<I", 600) + blocks)
    (pcm,) = telephony.decode_many([wave])
    assert telephony.resample(pcm).tolist() == plain_pcm(blocks, telephony.IMA, 256) and wave.rate == 11025
    two = telephony.Wave(telephony.MULAW, 2, 8000, 2, 8, bytes([0, 0x80, 1, 1, 9]))
    assert telephony.decode_many([two])[0].tolist() == [0, telephony.TABLES[telephony.MULAW][1]]
    again = telephony.from_wav(telephony.to_wav(pcm.tobytes(), telephony.PCM, 16000))
    assert (telephony.decode_many([again])[0] == pcm).all()


def test_telephony_bad_audio(spark):
    good = telephony.to_wav(b"abc", telephony.ALAW)
    stereo = telephony.to_wav(b"x" * 144, telephony.IMA).replace(b"\x11\0\x01\0", b"\x11\0\x02\0", 1)
    rows = [(1, None), (2, b""), (3, b"RIFFxxxxWAVE"), (4, good), (5, good[:30]), (6, stereo), (7, telephony.to_wav(b"", telephony.MULAW))]
    frame = spark.createDataFrame([(i, m, "kept", "lost") for i, m in rows], "id int, media binary, __pcm string, pcm string")
    got = {r["id"]: r for r in telephony.expand_telephony(frame).collect()}
    assert got[1]["pcm"] is None and got[1]["feature"] is None and all(r["__pcm"] == "kept" for r in got.values())
    assert all(got[i]["pcm"] is None and got[i]["feature"].startswith("error=") for i in (2, 3, 5, 6))
    assert len(got[4]["pcm"]) == 44 + 12 and len(got[7]["pcm"]) == 44


def test_telephony_tables_and_block_decoder():
    mulaw, alaw = telephony.TABLES[telephony.MULAW], telephony.TABLES[telephony.ALAW]
    assert (mulaw[0], mulaw[0x80], mulaw[0xFF], mulaw[0x7F]) == (-32124, 32124, 0, 0)
    assert (alaw[0xD5], alaw[0x55], alaw[0xAA], alaw[0x2A]) == (8, -8, 32256, -32256)
    blocks = np.random.default_rng(1).integers(0, 256, (5, 144)).astype(np.uint8)
    for row, samples in zip(blocks, telephony.ima_decode(blocks), strict=True):
        assert samples.tolist() == plain_ima(row)


def test_jaccard_large_clusters_equal_all_pairs(spark, monkeypatch):
    """A cluster of many blocks, of near copies around the threshold, and one of texts that share most of a passage."""
    for name, value in (("BLOCK", 16), ("PIVOTS", 4), ("HEAVY", 4)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(8)
    texts = []
    for base in range(2):
        words = [f"b{base}w{j}" for j in range(60)]
        for i in range(90):
            mine = list(words)
            for at in rng.integers(0, 60, rng.integers(0, 5)):
                mine[at] = f"x{rng.integers(0, 6)}"
            texts.append(" ".join(mine[: 60 - int(rng.integers(0, 12))]))
    for i in range(60):
        texts.append(" ".join([f"p{j}" for j in range(40)] + [f"own{i}-{j}" for j in range(int(rng.integers(2, 14)))]))
    sets = [{tuple(w[j : j + 4]) for j in range(len(w) - 3)} for w in map(str.split, texts)]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(frame, 4, 85).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert len(set(got.values())) > 10


def test_quality_model_on_held_out_labels(spark):
    """Accuracy and calibration on labelled documents that the model has not seen."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 3 > 0"))
    scored = quality.score_quality(docs.join(labels.where("doc_id % 3 = 0").select("doc_id", "quality"), "doc_id"), model)
    rows = scored.join(labels.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id").toPandas()
    share = rows["quality"].mean()
    right = ((rows["probability"] >= quality.THRESHOLD) == (rows["quality"] == 1)).mean()
    brier = ((rows["probability"] - rows["quality"]) ** 2).mean()
    print("held out", len(rows), "share", share, "accuracy", right, "brier", brier, "mean", rows["probability"].mean())
    assert right > max(share, 1 - share) + 0.1
    assert brier < 0.7 * share * (1 - share)
    assert abs(rows["probability"].mean() - share) < 0.05
    assert (rows["kept"] == (~rows["base_failed"] & (rows["probability"] >= quality.THRESHOLD))).all()


def test_quality_n_grams_are_of_characters():
    import pyarrow as pa

    points, starts = quality.code_points(pa.array(["aé\u4e2d\U0001f600", None, "", "é"]))
    assert points.tolist() == [97, 0xE9, 0x4E2D, 0x1F600, 0xE9] and starts.tolist() == [0, 4, 4, 4, 5]
