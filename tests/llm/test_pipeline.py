"""The pipeline's stages against brute force on rows with planted cases."""

import random

import corpus_pipeline as cp
import public_tokenizers

from tabulon.llm import bpe, common

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def planted(spark):
    draw = random.Random(9)
    words = {"en": "the of and to in is that it was for on are with as his they at be this have from".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        rows.append([i, " ".join(draw.choice(words[lang]) + draw.choice(["", "", "x", "q"]) for _ in range(80)), lang, f"s{i % 3}", 1])
    rows += [[100, rows[3][1].upper(), "en", "s0", 1], [101, rows[1][1] + " tail", "en", "s1", 1], [102, "123 !!", "en", "s1", 1], [103, None, None, None, None], [104, "", "en", "s2", 0]]
    return spark.createDataFrame([tuple(r) for r in rows], DOCS)


def test_stages(spark):
    docs = planted(spark)
    stages = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["language", "exact_copies", "near_copies", "mixture", "tokens"]
    one = common.written(stages["language"](spark, docs, ""), "t")
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {*range(60), 100, 101}
    two = common.written(stages["exact_copies"](spark, one, ""), "t")
    assert {r["doc_id"] for r in two.collect()} == {*range(60), 100, 101} - {3} and two.columns == docs.columns
    three = common.written(stages["near_copies"](spark, two, ""), "t")
    assert {r["doc_id"] for r in three.collect()} == {*range(60), 100} - {3} and three.columns == docs.columns
    four = common.written(stages["mixture"](spark, three, ""), "t")
    assert four.columns == docs.columns and {r["doc_id"] for r in four.collect()} <= {*range(60), 100} - {3}
    last = stages["tokens"](spark, four, "").collect()
    model = bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = sorted((r["doc_id"], len(model.encode([r["text"]])[0])) for r in four.collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in last) == want


def test_stages_on_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in cp.STAGES:
        docs = common.written(stage(spark, docs, ""), "t")
    assert docs.count() == 0


def test_stages_on_hard_rows(spark):
    """Null ids, repeated rows, one id with several texts, a very long text and columns of the operators' names."""
    draw = random.Random(3)
    text = lambda n: " ".join(draw.choice("the of and to in is that it was for on are with as his they".split()) + str(draw.randrange(50)) for _ in range(n))
    long, twin, other = text(60_000), text(50), text(50)
    rows = [(1, long, "en", "a"), (2, twin, "en", "a"), (2, twin, "en", "a"), (3, other, "en", None), (3, text(40), "en", None), (None, text(30), "en", "a"), (None, "!!", None, "b"), (4, None, None, "b"), (5, "", "en", "b")]
    extra = "score double, replica int, lang_pred string, row int, digest string, id int, source_rate double, `a.b` int, cdf int, n int"
    docs = spark.createDataFrame([(*r, 7, 0.5, 3, "q", 4, "d", 8, 1.5, 9, 6, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    stages = dict(cp.STAGES)
    kept = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    one = common.written(stages["language"](spark, docs, ""), "t")
    assert one.columns == docs.columns and kept(one) == sorted([r[:2] for r in rows[:6]], key=str)
    two = common.written(stages["exact_copies"](spark, one, ""), "t")
    assert two.columns == docs.columns and kept(two) == sorted({r[:2] for r in rows[:6]}, key=str)
    three = common.written(stages["near_copies"](spark, two, ""), "t")
    assert three.columns == docs.columns and kept(three) == kept(two)
    four = common.written(stages["mixture"](spark, three, ""), "t")
    assert four.columns == docs.columns and {r["doc_id"] for r in four.collect()} <= {1, 2, 3, None}
    assert {(r["replica"], r["a.b"], r["score"]) for r in four.select("replica", "`a.b`", "score").collect()} <= {(3, 9, 0.5)}
    assert stages["tokens"](spark, three, "").count() == 5


def test_run(spark, tmp_path):
    planted(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = cp.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r["doc_id"] for r in out.collect()} <= {*range(60), 100} - {3}


def test_near_copies_of_five_words_and_80_percent(spark):
    draw = random.Random(12)
    word = lambda: f"w{draw.randrange(10**6)}"
    sets, rows = [], []
    for _ in range(8):
        base = [word() for _ in range(200)]
        edited = list(base)
        for at in range(10, 200, 45):
            edited[at] = word()
        rows += [base, base + [word() for _ in range(draw.choice([44, 48, 49, 60]))], edited]
    for w in rows:
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    shares = [(100 * len(a & b) / len(a | b), i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])]
    assert sum(80 <= s < 85 for s, _, _ in shares) >= 5 and any(60 < s < 80 for s, _, _ in shares)
    for s, i, j in shares:
        if s >= 80:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate(rows)], DOCS)
    got = {r["doc_id"] for r in dict(cp.STAGES)["near_copies"](spark, docs, "").collect()}
    assert got == {i for i in range(len(rows)) if find(i) == i}
