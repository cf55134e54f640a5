"""The operators of the llm subpackage against brute force, exact round trips and hard inputs."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tabulon.llm import audio, bpe, common, components, dedup, langid, mixing, ngram_join, preferences, quality, tokencount, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 5), (4, "one", "en", "b", 3), (5, "ONE", "en", "b", 3), (6, "a b c", None, "b", 5),
    (7, "the quick brown fox jumps over the lazy dog", "en", "a", 43), (8, "The quick brown fox jumps over the lazy dog", "en", "a", 43),
    (9, "x" * 60_000, "de", "c", 60_000), (10, "der hund und die katze " * 3000, "de", None, 1), (11, "日本語 テキスト \u0000 é ½", "ja", "c", 1), (12, "12 34 !!", "en", "c", 1),
    (12, "12 34 !!", "en", "c", 1), (None, "no id", "en", "a", 5), (None, "no id", "en", "a", 5), (13, "a\u00a0b c\u000bd e", "fr", "a", 9),
]
EXTRA = ", lang_pred string, score double, replica int, keep_id long, row long, digest string, ids string, media string, x int, bits int"


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(HARD, DOCS)


@pytest.fixture(scope="session")
def clashing(spark):
    """The same rows with columns called like those of the operators."""
    return spark.createDataFrame([(*r, "q", 0.5, 3, 4, 5, "d", "i", "m", 6, 7) for r in HARD], DOCS + EXTRA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def ids(rows, *names):
    return sorted(((*(r[n] for n in names),) for r in rows), key=str)


# 7


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 5000])
def test_fuse_filter(n):
    keys = common.mix64(np.arange(n, dtype=np.uint64))
    f = dedup.FuseFilter.build(keys)
    assert f.may_hold(keys).all()
    assert f.may_hold(common.mix64(np.arange(10**6, 10**6 + 20_000, dtype=np.uint64))).mean() < 0.01


@pytest.mark.parametrize("which", ["hard", "clashing", "none"])
def test_exact_dedup(request, which):
    docs = request.getfixturevalue(which)
    got = dedup.exact_dedup(docs).collect()
    rows = [(r["doc_id"], (r["text"] or "").translate(str.maketrans(dedup.UPPER, dedup.LOWER))) for r in docs.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    want = sorted(((i, max((x for x in groups[t] if x is not None), default=None), len(groups[t])) for i, t in rows), key=str)
    assert ids(got, "doc_id", "keep_id", "group_size") == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert dedup.keep_one(docs).count() == len(groups)


@pytest.mark.parametrize("limits", [(0, 0), (1 << 20, 1000)])
def test_stored_snapshot_serves_several_batches(spark, tmp_path, monkeypatch, limits):
    monkeypatch.setattr(dedup, "FILTER_BYTES", limits[0])
    monkeypatch.setattr(dedup, "BROADCAST_DIGESTS", limits[1])
    monkeypatch.setattr(dedup, "SHARD_KEYS", 16)
    old = [(i, f"old text {i % 70}") for i in range(100)]
    path = f"{tmp_path}/snapshot"
    dedup.store_snapshot(dedup.digest_rows(spark.createDataFrame(old, "doc_id long, text string")), path)
    for k in (0, 1):
        batch = [(1000 + i, f"OLD text {i + 60 + 5 * k}") for i in range(30)] + [(2000 + i, f"new {i % 3}") for i in range(9)] + [(None, "new 1"), (None, None)]
        docs = spark.createDataFrame(old + batch, "doc_id long, text string")
        snapshot = dedup.open_snapshot(spark, path)
        got = dedup.exact_dedup(docs, dedup.F.col("doc_id") < 1000, snapshot=snapshot).collect()
        groups = {}
        for i, t in old + batch:
            groups.setdefault((t or "").lower(), []).append(i)
        want = [(i, max((x for x in groups[(t or "").lower()] if x is not None), default=None), len(groups[(t or "").lower()])) for i, t in old + batch]
        assert ids(got, "doc_id", "keep_id", "group_size") == sorted(want, key=str)
        assert sum(r["kept"] for r in got) == len(groups)
        few = dedup.screen(spark.createDataFrame([(hashlib.sha256(f"old text {i}".encode()).digest(),) for i in range(70)], "digest binary"), snapshot)
        assert few.count() == 70


# 3


def slow_mix(rows, weights, epochs):
    """Counts of (doc_id, source) by the definition, with a plain Poisson distribution."""
    import math

    size = {}
    for _, s in rows:
        size[s] = size.get(s, 0) + 1
    w = {s: weights.get(s, 0.0) if weights is not None else n**0.5 for s, n in size.items()}
    out = []
    for i, s in rows:
        rate = w[s] / sum(w.values()) * epochs * len(rows) / size[s]
        parts = max(1, math.ceil(rate / 2000))
        n = 0
        for k in range(parts if rate > 0 else 0):
            u = int(hashlib.md5(f"7{f'/{k}' if k else ''}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
            mass, total = math.exp(-rate / parts), math.exp(-rate / parts)
            j = 0
            while total <= u:
                j += 1
                mass *= rate / parts / j
                total += mass
            n += j
        out += [(i, s, r) for r in range(n)]
    return sorted(out, key=str)


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0, "none": 9.0}])
@pytest.mark.parametrize("small", [0, 32 << 20])
def test_mixing_of_hard_rows(spark, monkeypatch, hard, weights, small):
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", small)
    names = "doc_id long, source string, __count int, __key int, __cdf int, __source int, c0 int, id int, `a.b` int, replica int, `from` int"
    rows = [(r[0], r[3]) for r in HARD] * 5
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7, 8, 9) for r in rows], names)
    out = mixing.poisson_mix(docs, weights, epochs=1.5)
    assert out.columns == [c for c in docs.columns if c != "replica"] + ["replica"]
    got = out.collect()
    assert ids(got, "doc_id", "source", "replica") == slow_mix(rows, weights, 1.5)
    assert {(r["__count"], r["c0"], r["a.b"], r["from"]) for r in got} <= {(1, 5, 7, 9)}
    kept = mixing.poisson_mix(docs, weights, epochs=1.5, replica_col="n").collect()
    assert {r["replica"] for r in kept} <= {8} and ids(kept, "doc_id", "source", "n") == ids(got, "doc_id", "source", "replica")


def test_mixing(spark, hard, clashing, none):
    assert none.transform(mixing.poisson_mix).count() == 0
    assert "replica" in clashing.transform(mixing.poisson_mix).columns
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('t', id) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 30 = 1 THEN 'rare' ELSE 'mid' END AS source")
    weights = {"hot": 1.0, "rare": 1.0, "mid": 2.0}
    out = mixing.poisson_mix(docs, weights, epochs=2.0)
    share = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    for s, w in weights.items():
        assert abs(share[s] / 12_000 - w / 4) < 0.02
    assert sorted(out.collect()) == sorted(mixing.poisson_mix(docs.repartition(7), weights, epochs=2.0).collect())
    assert set(r["source"] for r in mixing.poisson_mix(docs, {"hot": 1.0}).collect()) == {"hot"}
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        mixing.poisson_mix(docs, {"hot": -1.0})
    rate = spark.range(1).select(mixing.thresholds(mixing.F.lit(900.0)).alias("c")).first()["c"]
    assert abs(rate[900] - 0.5088) < 0.001 and rate[-1] > 1 - 1e-9


def test_mixing_reaches_targets_of_small_sources(spark):
    docs = common.written(spark.range(100_000).selectExpr("id AS doc_id", "CASE WHEN id < 10 THEN 'small' ELSE 'large' END AS source"), "t")
    out = common.written(mixing.poisson_mix(docs, {"small": 0.5, "large": 0.5}), "t")
    share = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(share["small"] - 50_000) < 1200 and abs(share["large"] - 50_000) < 1200
    each = out.filter("source = 'small'").groupBy("doc_id").agg(mixing.F.count("*").alias("n"), mixing.F.countDistinct("replica").alias("kinds"), mixing.F.max("replica").alias("last")).collect()
    assert len(each) == len({r["n"] for r in each}) == 10 and all(abs(r["n"] - 5000) < 400 and r["kinds"] == r["n"] == r["last"] + 1 for r in each)


# 6


def test_preferences(spark):
    schema = "pair_id long, side string, turn long, role string, text string"
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "A"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "B"), (1, "rejected", 2, "user", None),
        (2, "chosen", 0, "user", "only"), (3, "chosen", 0, None, None), (3, "rejected", 0, None, None), (None, "chosen", 0, "user", "x"), (4, "other", 0, "user", "x"),
    ]
    got = {r["pair_id"]: r for r in preferences.format_preferences(spark.createDataFrame(turns, schema)).collect()}
    assert sorted(got) == [1, 2, 3]
    one = got[1]
    assert (one["n_common"], one["n_chosen"], one["n_rejected"]) == (1, 1, 2)
    assert one["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and one["chosen"] == "<|im_start|>assistant\nA<|im_end|>\n"
    assert [one["chosen"][s["start"] : s["end"]] for s in one["chosen_mask"]] == ["A<|im_end|>"]
    assert (got[2]["prompt"], got[2]["n_chosen"], got[2]["rejected"]) == ("", 1, "")
    assert (got[3]["n_common"], got[3]["chosen"], got[3]["chosen_mask"]) == (1, "", [])
    assert preferences.format_preferences(spark.createDataFrame([], schema)).count() == 0


# 1


def slow_counts(pairs):
    """Symbols after each context, of pairs (text, 1)."""
    code = lambda b: b - 32 if 32 < b < 127 else 95
    count = {}
    for t, _ in pairs:
        s = [0] * urls.ORDER + [code(b) for b in t.encode()]
        for i in range(urls.ORDER, len(s)):
            for k in range(urls.ORDER + 1):
                c = tuple(s[i - k : i])
                count.setdefault((k, c), {}).setdefault(s[i], 0)
                count[k, c][s[i]] += 1
    return count


def slow_log_probability(count, text, least):
    """Witten-Bell over dictionaries; ``count`` is of slow_counts, or the pairs themselves."""
    code = lambda b: b - 32 if 32 < b < 127 else 95
    count = count if isinstance(count, dict) else slow_counts(count)
    s, total = [0] * urls.ORDER + [code(b) for b in text.encode()], 0.0
    for i in range(urls.ORDER, len(s)):
        p = 1 / urls.SYMBOLS
        for k in range(urls.ORDER + 1):
            seen = count.get((k, tuple(s[i - k : i])), {})
            if sum(seen.values()) >= least:
                p = (seen.get(s[i], 0) + len(seen) * p) / (sum(seen.values()) + len(seen))
        total += np.log(p)
    return total


def test_url_model(spark):
    good, bad = ["a.org/fr/1", "b.org/fr/22", "é.org/fr/"], ["a.net/x", "b.net/yy"]
    models = urls.fit(spark.createDataFrame([(True, t) for t in good] + [(False, t) for t in bad], "allowed boolean, text string"))
    for text in ("c.org/fr/3", "a.net/x", "é"):
        want = slow_log_probability([(t, 1) for t in good], text, 2), slow_log_probability([(t, 1) for t in bad], text, 2)
        row = urls.score(spark.createDataFrame([(1, text)], "page_id int, text string"), models).first()
        assert abs(row["score"] - (want[0] - want[1]) / len(text.encode())) < 1e-6


def test_url_model_keeps_rare_contexts_of_a_larger_corpus(spark, monkeypatch):
    monkeypatch.setattr(urls, "BLOCK_POWER", 3, raising=False)
    draw = random.Random(6)
    made = lambda end: "".join(draw.choice("abcde") for _ in range(7)) + end
    good, bad = [made(".org/fr/") for _ in range(900)], [made(".net/de/") for _ in range(900)]
    models = urls.fit(spark.createDataFrame([(True, t) for t in good] + [(False, t) for t in bad], "allowed boolean, text string"))
    probe = [good[0], bad[1], good[2][:7], "abcabca.org", "q", "", None] + good[3:30] + bad[3:30]
    got = {r["page_id"]: r["score"] for r in urls.score(spark.createDataFrame(list(enumerate(probe)), "page_id int, text string"), models).collect()}
    assert len(got) == len(probe) and got[5] == got[6] == 0
    for i, text in enumerate(probe[:5]):
        want = slow_log_probability([(t, 1) for t in good], text, 2) - slow_log_probability([(t, 1) for t in bad], text, 2)
        assert abs(got[i] - want / len(text)) < 1e-6


def test_url_filter(spark):
    schema = "page_id long, url string, html string, score string, rule int"
    given = ["http://A.example.NET/en/1?x", "http://z.net", "http://z.net/", "https://b.example.com/de/#t", "x://q.org/fr/", "http://org.com/fr/", None, "nothing", "", "a://b://c.net/d", "http://notexample.net/en/", "ftp://x.net?y/en/"]
    out = urls.filter_urls(spark.createDataFrame([(i, u, None, None, 0) for i, u in enumerate(given)], schema)).orderBy("page_id").collect()
    assert [r["rule"] for r in out] == ["example.net/en/", None, "net/", "example.com/de/", "org/fr/", None, None, None, None, None, "net/", None]
    assert (out[0]["host"], out[0]["path"], out[9]["host"], out[9]["path"], out[11]["path"]) == ("a.example.net", "/en/1", "b:", "//c.net/d", "")
    assert all(r["verdict"] in ("allow", "block") for r in out)
    assert urls.filter_urls(spark.createDataFrame([], schema)).count() == 0


def test_url_query(spark, tmp_path):
    """Models, calibration and verdicts of the query against dictionaries."""
    draw = random.Random(4)
    name = lambda n: "".join(draw.choice("abcdef") for _ in range(n))
    given = [f"http://{name(4)}.net/x{name(2)}" if draw.random() < 0.4 else f"http://{name(4)}.org/fr/{name(3)}?q={name(2)}" if draw.random() < 0.6 else f"http://{name(3)}.com/{name(4)}#z" for _ in range(120)]
    given += [None, "", "no scheme", given[0], given[0], "http://q.net/" + "ab" * 3000]
    path = folder(spark, tmp_path, pages=spark.createDataFrame([(i, u, None) for i, u in enumerate(given)], "page_id long, url string, html string"))
    got = {r["page_id"]: r for r in urls.op1(spark, path).collect()}
    fold = {r[0]: r[1] for r in spark.createDataFrame([(i, u or "") for i, u in enumerate(given)], "i int, u string").selectExpr("i", "pmod(xxhash64(u), 5) = 0").collect()}
    kind = {i: {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}.get(got[i]["rule"]) for i in got}
    assert all((kind[i] == "block") == (".net/" in (u or "")) and (kind[i] == "allow") == (".org/fr/" in (u or "")) for i, u in enumerate(given))
    counts = {c: [(u, 1) for i, u in enumerate(given) if kind[i] == c and not fold[i]] for c in ("allow", "block")}
    table = {c: slow_counts(pairs) for c, pairs in counts.items()}
    score = {i: round((slow_log_probability(table["allow"], u, 2) - slow_log_probability(table["block"], u, 2)) / len(u), 9) if u else 0.0 for i, u in enumerate(given)}
    assert all(abs(got[i]["score"] - score[i]) < 1e-6 for i in score)
    best = lambda t: np.mean([np.mean([(score[i] >= t) == (c == "allow") for i in score if fold[i] and kind[i] == c]) for c in ("allow", "block")])
    reached = max(best(t) for t in [*score.values(), 99])
    free = [i for i in got if kind[i] is None]
    allowed, blocked = ([score[i] for i in free if got[i]["verdict"] == v] for v in ("allow", "block"))
    assert max(blocked, default=-99) <= min(allowed, default=99) and all(got[i]["verdict"] == kind[i] for i in got if kind[i])
    assert any(best(t) >= reached - 1e-9 for t in np.linspace(max(blocked, default=-20), min(allowed, default=20), 2001))


# 5


def slow_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            move = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                move += part if code & bit else 0
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + int(audio.MOVES[code])))
            out.append(value)
    return out


def test_audio_kernels():
    blocks = np.random.default_rng(1).integers(0, 256, (50, audio.BLOCK), dtype=np.uint8)
    assert audio.decode_blocks(blocks).tolist() == [slow_adpcm(b.tobytes()) for b in blocks]
    mu, a = audio.TABLES[audio.MULAW], audio.TABLES[audio.ALAW]
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert audio.upsample(np.array([0, 16, 32, 48], np.int16)).tolist()[:5:2] == [0, 16, 32]
    for broken in (None, b"", b"RIFF", audio.wav(audio.MULAW, b"abc")[:-2], audio.wav(99, b"ab")):
        assert audio.decode_all([broken]) == [None]


def slow_wave(payload):
    """(media, samples) of a payload, a byte at a time."""
    tag = (audio.MULAW, audio.ALAW, audio.IMA)[zlib.crc32(payload) % 3]
    little = lambda v, n: v.to_bytes(n, "little")
    ima = tag == audio.IMA
    form = little(tag, 2) + little(1, 2) + little(8000, 4) + little(8000 * 36 // 65 if ima else 8000, 4) + little(36 if ima else 1, 2) + little(4 if ima else 8, 2) + (little(2, 2) + little(65, 2) if ima else little(0, 2))
    body = b"WAVEfmt " + little(len(form), 4) + form + b"fact" + little(4, 4) + little(len(payload) // 36 * 65 if ima else len(payload), 4) + b"data" + little(len(payload), 4) + payload
    media = b"RIFF" + little(len(body), 4) + body
    if ima:
        return media, [v for k in range(0, len(payload), 36) for v in slow_adpcm(payload[k : k + 36])]
    out = []
    for byte in payload:
        if tag == audio.MULAW:
            byte = ~byte & 255
            size = (((byte & 15) * 2 + 33) << (byte >> 4 & 7)) * 4 - 132
            out.append(-size if byte & 128 else size)
        else:
            byte ^= 0x55
            size = (byte & 15) * 16 + 8 if not byte >> 4 & 7 else ((byte & 15) * 16 + 264) << (byte >> 4 & 7) - 1
            out.append(size if byte & 128 else -size)
    return media, out


def slow_feature(payload):
    media, x = slow_wave(payload)
    name = {6: "alaw", 7: "mulaw", 17: "ima"}[media[20]]
    wide = []
    for i, v in enumerate(x):
        a, b, c = x[max(i - 1, 0)], x[min(i + 1, len(x) - 1)], x[min(i + 2, len(x) - 1)]
        wide += [v, max(-32768, min(32767, (9 * (v + b) - a - c + 8) // 16))]
    stored = b"".join(v.to_bytes(2, "little", signed=True) for v in wide)
    turns = sum((p < 0) != (q < 0) for p, q in zip(x, x[1:], strict=False))
    return f"{name}:{len(x)}:{max(map(abs, x))}:{sum(map(abs, x)) // len(x)}:{turns}:{zlib.crc32(stored)}", stored


def folder(spark, path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("which", ["hard", "clashing", "none"])
def test_audio_query(spark, request, tmp_path, which):
    docs = request.getfixturevalue(which)
    rows = docs.collect()
    got = audio.op5(spark, folder(spark, tmp_path, documents=docs)).collect()
    want = []
    for r in rows:
        t = (r["text"] or "").encode()
        p = t + b"\xff" * (-len(t) % 576 if t else 576)
        media, _ = slow_wave(p)
        want.append((r["doc_id"], len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), slow_feature(p)[0]))
    assert ids(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature") == sorted(want, key=str)


def test_stored_pcm(spark, tmp_path):
    given = {1: b"abc" * 192, 2: b"x" * 576, 3: b"\x00\xff" * 288, 4: None, 5: b"RIFFbroken"}
    files = [(i, slow_wave(p)[0] if p and len(p) == 576 else p) for i, p in given.items()]
    out = {r["doc_id"]: r for r in audio.store_pcm(spark.createDataFrame(files, "doc_id int, media binary"), f"{tmp_path}/pcm").collect()}
    for i in (1, 2, 3):
        assert (out[i]["feature"], bytes(out[i]["pcm"])) == slow_feature(given[i])
    assert out[4]["pcm"] is out[5]["pcm"] is None
    bad = audio.describe_media(spark.createDataFrame(files[3:], "doc_id int, media binary")).orderBy("doc_id").collect()
    assert [r["media_bytes"] for r in bad] == [None, 10] and bad[1]["payload_bytes"] is None and bad[1]["feature"] is None


@pytest.mark.parametrize("which", ["hard", "clashing", "none"])
def test_audio_round_trip(request, which):
    docs = request.getfixturevalue(which)
    stored = audio.text_as_media(docs)
    out = audio.decode_media(stored).collect()
    want = []
    for r in docs.collect():
        t = (r["text"] or "").encode()
        want.append((r["doc_id"], t + b"\xff" * (-len(t) % 576 if t else 576)))
    assert ids(out, "doc_id", "payload") == sorted(((i, bytearray(p)) for i, p in want), key=str)
    assert all(len(r["pcm"]) > 0 and zlib.crc32(r["pcm"]) for r in out)


# 8 and 9


def texts(n=400):
    draw = random.Random(4)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    words = [base64.b64decode(line.split()[0]).decode("utf8", "ignore") for line in open(path, "rb")]
    odd = ["", " ", "a  b", "\r\n", "don't", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "日本語", "😀😀", "x" * 3000, "ab" * 3000, " " * 700, "<|endoftext|>", "<s> </s> <unk> ▁a▁▁b", "a\u0000b", "<0x0A>"]
    return odd + ["".join(draw.choice(words) for _ in range(draw.randint(1, 60))) for _ in range(n)]


def test_bpe_equals_the_library():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    given = texts()
    got, at = bpe.tokenizer(path, public_tokenizers.PATTERN).encode(given)
    for i, t in enumerate(given):
        assert got[at[i] : at[i + 1]].tolist() == library.encode_ordinary(t), t[:80]


def test_long_pieces_where_a_merge_makes_a_lower_rank(tmp_path):
    """A vocabulary in which later tokens rank lower, against merges one at a time."""
    draw = random.Random(5)
    for trial in range(6):
        tokens = [bytes([b]) for b in range(256)]
        for _ in range(60):
            tokens.append(draw.choice(tokens[97:100] + tokens[256:]) + draw.choice(tokens[97:100] + tokens[256:]))
        tokens = tokens[:256] + draw.sample(list(dict.fromkeys(tokens[256:])), len(set(tokens[256:])))
        path = f"{tmp_path}/{trial}.tiktoken"
        with open(path, "wb") as f:
            f.writelines(base64.b64encode(t) + b" %d\n" % r for r, t in enumerate(tokens))
        model = bpe.BytePairs(path, r"(?s).+")
        ranks = {t: r for r, t in enumerate(tokens)}
        for n in (300, 900):
            piece = "".join(draw.choice("abc") for _ in range(n)).encode()
            parts = [bytes([b]) for b in piece]
            while True:
                r, i = min(((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)), default=(1 << 40, 0))
                if r == 1 << 40:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert model.encode([piece.decode()])[0].tolist() == [ranks[p] for p in parts]


def test_token_queries(spark, hard, tmp_path):
    import sentencepiece
    import tiktoken

    path = folder(spark, tmp_path, documents=hard.unionByName(spark.createDataFrame([(70, "word " * 4096, "en", "a", 1), (71, "word " * 4095 + "word", "en", "a", 1), (72, "a" * 200_000, "en", "a", 1), (73, " " * 5000 + "z", "en", "a", 1)], DOCS)))
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(i, len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in rows]
    assert ids(tokencount.op9(spark, path).collect(), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        found = library.encode_ordinary(t)
        want.append((i, len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert ids(bpe.op8(spark, path).collect(), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    decoded = bpe.decode(bpe.encode(hard, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert ids(decoded.collect(), "doc_id", "decoded") == sorted(((r[0], bytearray((r[1] or "").encode())) for r in HARD), key=str)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    model = tokencount.transducer(path)
    given = ["unbelievable things happen here", "aaaa bbbb aaaa", "x", ""]
    model.counts(given)  # compiles what the texts need
    same = lambda points, begins, ends: np.zeros(len(begins), np.uint64)
    monkeypatch.setattr(tokencount, "word_hashes", same)
    assert model.counts(given).tolist() == [len(x) for x in library.encode(given)]


@pytest.mark.parametrize("which", ["hard", "clashing", "none"])
def test_bpe_round_trip(request, which):
    docs = request.getfixturevalue(which)
    out = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    want = sorted(((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect()), key=str)
    assert ids(out, "doc_id", "decoded_sha256") == want


def test_transducer_equals_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    given = texts(200) + ["thethe" * 3000, "-=" * 5000]
    assert tokencount.transducer(path).counts(given).tolist() == [len(x) for x in library.encode(given)]


@pytest.mark.parametrize("which", ["hard", "clashing", "none"])
def test_token_counts(request, which):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = request.getfixturevalue(which)
    out = tokencount.count_tokens(docs, path, limit=5).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "")), n > 5) for r in docs.collect()]
    assert ids(out, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)


# 4


def test_viterbi():
    draw = np.random.default_rng(2)
    sizes = [0, 1, 7, 3, 0, 5]
    first = np.append(0, np.cumsum(sizes))
    scores = draw.normal(0, 3, (first[-1], 3)).astype(np.float32)
    got = langid.viterbi(scores, first, 2.0)
    from itertools import product

    def value(path, s):
        return sum(s[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    for a, b in zip(first, first[1:], strict=False):
        if b > a:
            best = max(value(p, scores[a:b]) for p in product(range(3), repeat=int(b - a)))
            assert abs(value(got[a:b].tolist(), scores[a:b]) - best) < 1e-4


def test_languages(spark, hard, clashing, none):
    english, german, greek = "the cat and the dog were in the house", "der hund und die katze sind in dem haus", "ο σκύλος και η γάτα"
    rows = [(i, t, k, "s", 1) for i, (t, k) in enumerate([(english, "en"), (german, "de"), (greek, "el")] * 20)]
    model = langid.fit(spark.createDataFrame(rows, DOCS), langid.F.lit(True))
    mixed = f"{english} {english}. {german}; {greek}"
    probe = spark.createDataFrame([(1, mixed), (2, "ΓΑΤΑ"), (3, "12 !"), (4, None), (5, ""), (6, "漢字")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in langid.identify(probe, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["en", "el", "und", "und", "und"]
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "de", "el"] and got[6]["lang_pred"] in ("de", "el", "en")
    assert mixed[got[1]["spans"][1]["start"] : got[1]["spans"][1]["end"]] == german
    assert langid.identify(hard, model).count() == len(HARD) == langid.identify(clashing, model).count()
    assert langid.identify(none, langid.fit(none, langid.F.lit(True))).count() == 0
    assert {r["lang_pred"] for r in langid.identify(hard, langid.fit(none, langid.F.lit(True))).collect()} == {"und"}


def test_marks_are_no_letters(spark):
    rows = [(i, t, k, "s", 1) for i, (t, k) in enumerate([("the cat and the dog", "en"), ("он и она и мой кот", "ru"), ("यह एक घर है", "hi")] * 20)]
    model = langid.fit(spark.createDataFrame(rows, DOCS), langid.F.lit(True))
    given = ["\u0301", "\u0951\u0951", "12 \u0301!", "мои\u0306 кот", "यह है", "e\u0301", "\u0301the"]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame([*enumerate(given)], "doc_id int, text string"), model).collect()}
    assert [got[i]["lang_pred"] for i in range(6)] == ["und", "und", "und", "ru", "hi", "en"]
    assert [(s["start"], s["end"]) for s in got[3]["spans"]] == [(0, 8)] and got[6]["spans"][0]["start"] == 1
    # a mark at a text's beginning does not reach back into the text before
    words = langid.Words(["abc", "\u0301", "d\u0301e"])
    assert list(zip(words.begins.tolist(), words.ends.tolist())) == [(0, 3), (4, 7)]


def slow_languages(rows, train, probe):
    """The fit, the word scores, the Viterbi pass and the vote, a word at a time."""
    import unicodedata

    script, lower = langid.tables()

    def words(text):
        out, last = [], 0
        for i, c in enumerate(text):
            kind = int(script[ord(c)])
            kind = last if kind == langid.MARK else kind
            if kind and out and kind == last and out[-1][1] == i:
                out[-1][1] = i + 1
            elif kind:
                out.append([i, i + 1, kind])
            last = kind
        assert all(any(unicodedata.category(c)[0] == "L" for c in text[a:b]) for a, b, _ in out)
        return out

    bucket = lambda key: int(common.mix64(np.array([key], np.uint64))[0]) & (langid.BUCKETS - 1)

    def grams(word):
        codes = [int(lower[ord(c)]) + 1 for c in word]
        padded = [0, 0, *codes]
        for k in range(2, len(padded)):
            yield 0, bucket(padded[k])
            yield 1, bucket(padded[k - 1] << 21 | padded[k])
            yield 2, bucket(padded[k - 2] << 42 | padded[k - 1] << 21 | padded[k])
        yield 1, bucket(codes[-1] << 21)
        yield 2, bucket((codes[-2] if len(codes) > 1 else 0) << 42 | codes[-1] << 21)

    names = sorted({r[2] for r in train if r[2] is not None})
    counts, letters = {k: np.zeros((3, langid.BUCKETS)) for k in names}, {k: np.zeros(langid.OTHER + 1) for k in names}
    for _, text, lang, *_ in train:
        for a, b, kind in words(text or "") if lang is not None else []:
            letters[lang][kind] += b - a
            for order, key in grams(text[a:b]):
                counts[lang][order, key] += 1
    table = {k: np.log((c + 0.05) / (c.sum(axis=1, keepdims=True) + 0.05 * langid.BUCKETS)) for k, c in counts.items()}
    written = {k: letters[k] / max(1, letters[k].sum()) >= langid.LEAST_SHARE for k in names}
    out = []
    for i, text, *_ in probe:
        found = words(text or "")
        if not found or not names:
            out.append((i, "und", 0.0))
            continue
        value, back = None, []
        for a, b, kind in found:
            fits = [k for k in names if written[k][kind]] or names
            own = np.array([sum(table[k][g] for g in grams(text[a:b])) / 3 - (0 if k in fits else 1e4) for k in names])
            if value is None:
                value = own
            else:
                best = int(value.argmax())
                back.append([j if value[j] >= value[best] - langid.PENALTY else best for j in range(len(names))])
                value = np.maximum(value, value[best] - langid.PENALTY) + own
        path = [int(value.argmax())]
        for step in reversed(back):
            path.append(step[path[-1]])
        share = np.zeros(len(names))
        for (a, b, _), k in zip(found, reversed(path), strict=True):
            share[k] += b - a
        out.append((i, names[int(share.argmax())], round(share.max() / share.sum(), 9)))
    return out


def test_language_query(spark, hard, tmp_path):
    draw = random.Random(2)
    pools = {"en": "the cat and dog were in this house when rain came", "de": "der hund und die katze sind nicht in dem haus", "el": "ο σκύλος και η γάτα στο σπίτι"}
    rows = list(HARD)
    for i in range(100, 160):
        lang = draw.choice([*pools])
        text = " ".join(draw.choice(pools[lang if draw.random() < 0.9 else "de"].split()) for _ in range(draw.randint(1, 25)))
        rows.append((i, text, lang, "s", 1))
    got = langid.op4(spark, folder(spark, tmp_path, documents=spark.createDataFrame(rows, DOCS))).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    want = slow_languages(rows, [r for r in rows if not out(r[0])], rows)
    assert sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in got), key=str) == sorted(want, key=str)
    assert all(r["held_out"] == out(r["doc_id"]) for r in got)


# 10


def test_quality(spark, hard, clashing, none):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 8)))
    clean = lambda: " ".join(word() for _ in range(60)) + "."
    docs = [(i, clean() if i % 2 else " ".join(w.upper() + "!!" for w in clean().split())) for i in range(200)]
    labels = [(i, i % 2) for i in range(150)] + [(0, None)]
    out = quality.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), quality.F.lit(True)).collect()
    assert len(out) == 200 and all(r["predicted"] == r["doc_id"] % 2 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    few = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    for d in (hard, clashing):
        assert {r["predicted"] for r in quality.rank(d, few, quality.F.lit(True)).collect()} == {1}
    assert quality.rank(none, few, quality.F.lit(True)).count() == 0


def test_quality_threshold_covers_all_labels(spark, monkeypatch):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 9)))
    docs = [(i, " ".join(w.upper() if draw.random() < (0.2 if i % 3 else 0.3) else w for w in (word() for _ in range(draw.randint(30, 60))))) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(900)], "doc_id long, quality int")
    for held in (1000, 40):
        monkeypatch.setattr(quality, "HELD", held, raising=False)
        monkeypatch.setattr(quality, "BINS", 8, raising=False)
        out = quality.rank(spark.createDataFrame(docs, "doc_id long, text string"), labels, quality.F.lit(True), sample=60).collect()
        assert sum(r["predicted"] == 0 for r in out) == 300


def slow_measures(text):
    data = (text or "").encode()
    n = len(data)
    kind = lambda b: next((k for k, cs in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\v\f\r", b"\n", b".!?", b",;:'\"-()", b"#$%&*|<>{}[]\\^~=+_@/`")) if b in cs), 9 if b > 127 else 8)
    out = [np.log1p(n), *(sum(kind(b) == k for b in data) / max(1, n) for k in range(10))]
    words = data.split()
    mean = lambda flags: sum(flags) / max(1, len(words))
    has = lambda w, ks: any(kind(b) in ks for b in w)
    out += [np.log1p(len(words)), mean(min(len(w), 100) for w in words), mean(len(w) > 12 for w in words), mean(len(w) < 4 for w in words), mean(not has(w, (0, 1, 2, 9)) for w in words)]
    out.append(mean(kind(w[-1]) in (7, 8) or w[-2:] in (b"!!", b"!?", b"?!", b"??") for w in words))
    out += [mean(sum(kind(b) == 1 for b in w) > 1 and not has(w, (0,)) for w in words), mean(has(w, (2,)) for w in words)]
    out += [len(set(words)) / max(1, len(words)), mean(a == b for a, b in zip(words, words[1:], strict=False)), max((words.count(w) for w in set(words)), default=0) / max(1, len(words))]
    lines = [x for x in data.split(b"\n") if x]
    out += [np.log1p(len(lines)), (len(lines) - len(set(lines))) / max(1, len(lines)), np.log1p(n / max(1, len(lines)))]
    return [*out, sum(kind(x[-1]) != 5 for x in lines) / max(1, len(lines)), float(n == 0)]


def test_quality_measures():
    import pyarrow as pa

    given = [r[1] for r in HARD if r[1] != HARD[8][1]] + ["A B!! c?? ½\n\nAAA 12 AAA AAA\nA.\nx\nx", "#$% ok\x00\x7f", "\n\n"]
    got = quality.measure(pa.array(given, pa.string()))
    for row, text in zip(got, given, strict=True):
        assert np.allclose(row, slow_measures(text)), (text, [n for n, a, b in zip(quality.NAMES, row, slow_measures(text), strict=True) if abs(a - b) > 1e-8])


def test_quality_query(spark, tmp_path):
    """Scores, threshold, folds and predictions of the query against plain numpy on the slow measures."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 9)))
    docs = [(i, " ".join(w.upper() if draw.random() < (0.1 if i % 3 else 0.4) else w for w in (word() for _ in range(draw.randint(20, 50)))), None, "s", 1) for i in range(160)] + [(500, None, None, None, None), (501, "", None, None, 0), (None, "no id", None, None, 1)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(120)] + [(7, None, 0), (9999, 1, 0), (None, 0, 0)]
    path = folder(spark, tmp_path, documents=spark.createDataFrame(docs, DOCS), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in quality.op10(spark, path).collect()}
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    x = {d[0]: slow_measures(d[1]) for d in docs}
    train = sorted((i, q) for i, q, _ in labels if i in x and q is not None and i is not None and not out(i))
    # the order of the sample decides which pairs are drawn: it is by a hash that Spark knows
    order = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i, _ in train], "i long").selectExpr("i", "pmod(xxhash64(3, i), 1 << 30)").collect()}
    train.sort(key=lambda r: (order[r[0]], r[1]))
    model = quality.fit(np.array([x[i] for i, _ in train]), np.array([q == 1 for _, q in train]))
    raw = lambda i: float(model.weights @ quality.expand(np.array([x[i]]))[0] + model.bias)
    ranked, bad = sorted(raw(i) for i, _ in train), sum(q == 0 for _, q in train)
    cut = (ranked[bad - 1] + ranked[bad]) / 2
    for i in x:
        want = 1 / (1 + np.exp(-(raw(i) - cut + np.log(0.7 / 0.3))))
        assert abs(got[i]["score"] - want) < 1e-6 and got[i]["held_out"] == out(i) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)
    assert sum(got[i]["predicted"] == 0 for i, _ in train) == bad


# 2


def brute_components(rows, words, percent):
    sets = []
    for _, text in rows:
        t = (text or "").translate(str.maketrans(dedup.UPPER, dedup.LOWER))
        w = t.encode().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        mine = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(mine, default=None)))
    return sorted(out, key=str)


def near_copies(seed, n_bases=6, copies=25, length=70):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [draw.choice(vocabulary) for _ in range(12)]
    rows = []
    for _ in range(n_bases):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(3, length))]
        for _ in range(copies):
            w = list(base)
            for _ in range(draw.randint(0, 5)):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
            if draw.random() < 0.3:
                w = passage + w
            rows.append(" ".join(w).upper() if draw.random() < 0.2 else " ".join(w))
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_components(spark, monkeypatch, seed):
    # small cells and blocks, so that long lists are dealt too
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "UNIT", 8)
    monkeypatch.setattr(ngram_join, "GROWTH", 1)
    rows = near_copies(seed)
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ids(got, "doc_id", "n_shingles", "component_id") == brute_components(rows, 4, 85)


@pytest.mark.parametrize("which", ["hard", "clashing", "none"])
def test_similar_components_of_hard_rows(request, which):
    docs = request.getfixturevalue(which)
    got = ngram_join.similar_components(docs).collect()
    assert ids(got, "doc_id", "n_shingles", "component_id") == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 4, 85)


@pytest.mark.parametrize("small", [0, 1000])
def test_connected(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    draw = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100 + draw.randrange(30), 100 + draw.randrange(30)) for _ in range(20)] + [(500, 501)]
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = sorted((i, find(i)) for i in {x for p in links if p[0] != p[1] for x in p})
    got = components.connected(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r["node"], r["root"]) for r in got) == want
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "UNIT", 8)
    monkeypatch.setattr(ngram_join, "GROWTH", 1)
    rows = near_copies(5, copies=14) + [(900, None), (901, " "), (902, "one"), (903, "ONE")]
    members, links = ngram_join.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    of, links = {r["doc_id"]: r["set_id"] for r in members.collect()}, {(r["a"], r["b"]) for r in links.collect()}
    sets = {}
    for d, text in rows:
        w = (text or "").lower().split()
        sets[d] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    assert of[900] is of[901] is None and of[902] == of[903] and sorted(of) == sorted(sets)
    for d in sets:
        for e in sets:
            if sets[d] and sets[e] and d < e:
                a, b = sorted((of[d], of[e]))
                linked = 100 * len(sets[d] & sets[e]) >= 85 * len(sets[d] | sets[e])
                assert linked == (a == b or (a, b) in links)
    with pytest.raises(ValueError):
        ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=75)
