"""Sort-means, hard negatives and SentencePiece against brute force or the library, and on odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import centroids, hard_negatives, sentence_pieces

VEC = "vec_id long, embedding array<float>, label int"


def made(n, size=64, seed=1, copies=0, spread=0.3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.3, (12, size))
    x = (middles[rng.integers(0, 12, n)] + rng.normal(0, spread * 0.3, (n, size))).astype(np.float32)
    x[:copies] = x[0]
    return [(i, [float(v) for v in row], int(rng.integers(0, 10))) for i, row in enumerate(x)]


def write(spark, tmp_path, rows, name="embeddings", schema=VEC):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def kept_ints(rows, factor, size=64):
    ok = [r for r in rows if r[1] is not None and len(r[1]) == size and all(x is not None and np.isfinite(x) for x in r[1])]
    return ok, np.array([[int(np.floor(factor * float(np.float32(x)))) for x in r[1]] for r in ok], np.int64).reshape(len(ok), size)


def clustered_by_force(rows, k=16, rounds=3):
    ok, x = kept_ints(rows, 64)
    order = sorted(range(len(ok)), key=lambda i: (ok[i][0] is None, hashlib.sha256(f"1:{ok[i][0]}".encode()).hexdigest(), x[i].tolist()))
    c = x[order[:k]]
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        at = d.argmin(1)
        if r < rounds:
            c = np.array([x[at == j].sum(0) // (at == j).sum() if (at == j).any() else c[j] for j in range(len(c))])
    best = d.min(1)
    return sorted((str(ok[i][0]), int(at[i]), int(best[i]), int(best[at == at[i]].sum()), int(best.sum()), hashlib.sha256(",".join(map(str, c[at[i]])).encode()).hexdigest()) for i in range(len(ok)))


def odd_vectors(n=60):
    rows = made(n, copies=9)
    rows[3] = (3, None, 1)
    rows[4] = (4, [0.1] * 63, 2)
    rows[5] = (5, [0.1] * 63 + [None], 2)
    rows[6] = (6, [0.1] * 63 + [float("nan")], 2)
    rows[7] = (7, [0.1] * 63 + [float("-inf")], 2)
    rows[8] = (8, [], 2)
    return [*rows, rows[20], rows[20], (None, rows[21][1], 3), (500, rows[21][1], None), (None, rows[0][1], 4)]


@pytest.mark.parametrize("rows", [made(400), odd_vectors(), made(9), made(300, copies=150), made(120, spread=0)])
def test_sort_means_equals_brute_force(spark, tmp_path, rows):
    found = centroids.op11_sort_means(spark, write(spark, tmp_path, rows)).collect()
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in found) == clustered_by_force(rows)


def test_sort_means_on_empty_tables_and_clashing_names(spark, tmp_path):
    assert centroids.op11_sort_means(spark, write(spark, tmp_path, [])).count() == 0
    df = spark.createDataFrame([(1, 5, 6, 7, [1.0, 2.0]), (2, 5, 6, 7, [3.0, 4.0])], "id long, cluster int, distance int, now int, v array<double>")
    found, c = centroids.clustered(df, "v", 2, 1, 4, 2, F.col("id").cast("string"))
    assert sorted(found.columns) == ["cluster", "distance", "id", "n_distances", "v"] and sorted(map(tuple, c.tolist())) == [(1, 2), (3, 4)]
    assert [r["distance"] for r in found.collect()] == [0, 0]


def test_sort_means_refuses_components_beyond_exact_distances(spark):
    df = spark.createDataFrame([(1, [1e12, 0.0])], "id long, e array<double>")
    with pytest.raises(ValueError, match="too large"):
        centroids.clustered(df, "e", 2, 1, 2, 1, F.lit(""))


@pytest.mark.parametrize("seed", range(4))
def test_nearest_skips_most_centroids_and_loses_none(seed):
    rng = np.random.default_rng(seed)
    c = rng.integers(-50, 50, (40, 3))
    c[7] = c[3]
    x = c[rng.integers(0, 40, 500)] + rng.integers(-2, 3, (500, 3))
    last = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
    last[:50] = rng.integers(0, 40, 50)
    at, d, took = centroids.nearest(x, last, c)
    every = ((x[:, None] - c[None]) ** 2).sum(-1)
    assert (at == every.argmin(1)).all() and (d == every.min(1)).all()
    assert took < 0.5 * every.size


def test_nearest_at_exactly_twice_the_distance_takes_the_smaller_number():
    at, d, _ = centroids.nearest(np.array([[1, 0]]), np.array([1]), np.array([[2, 0], [0, 0]]))
    assert at.tolist() == [0] and d.tolist() == [1]


def negatives_by_force(rows, step=100, n_positive=5, n_negative=10):
    ok = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in ok]
    big, out = 1 << 63, []
    for i, v, y in ok:
        if i is None or i % step:
            continue
        scores = [(sum(a * b for a, b in zip(v, w, strict=False)), j, z) for j, w, z in ok]
        first = lambda some: sorted(some, key=lambda s: (-s[0], big if s[1] is None else s[1]))
        for p, j, _ in first([s for s in scores if s[2] == y and s[1] != i])[:n_positive]:
            fits = first([s for s in scores if s[2] != y and 30 * p <= 100 * s[0] <= 90 * p])[:n_negative]
            out += [(i, str(j), r + 1, str(s[1]), p, s[0]) for r, s in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("rows", [made(700, spread=2), [*odd_vectors(250), *odd_vectors(110)[:3]], made(300, copies=140), [(0, [0.5, 0.5], 1), (1, [0.5], 1), (2, [0.25, 0.0, 9.0], 2), (4, [-0.5], 1)], []])
def test_hard_negatives_equal_brute_force(spark, tmp_path, rows):
    found = hard_negatives.op12_hard_negatives(spark, write(spark, tmp_path, rows)).collect()
    assert sorted((r[0], str(r[1]), r[2], str(r[3]), r[4], r[5]) for r in found) == negatives_by_force(rows)


def test_hard_negatives_over_several_blocks_of_anchors(spark, tmp_path):
    rows = made(500, spread=2)
    df = spark.createDataFrame(rows, VEC).withColumn("id", F.lit("extra")).repartition(7)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(hard_negatives.participants(df, "vec_id", label, "embedding", 256), F.col("id") % 20 == 0, block=4).collect()
    assert sorted((r[0], str(r[1]), r[2], str(r[3]), r[4], r[5]) for r in found) == negatives_by_force(rows, step=20)


def test_hard_negatives_beyond_float_precision(spark):
    df = spark.createDataFrame([(0, 1, [1 << 27, 1]), (1, 1, [1 << 27, 2]), (2, 2, [1 << 26, 3])], "id long, label long, v array<bigint>")
    found = hard_negatives.mine(df, F.col("id") == 0).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 2, (1 << 54) + 2, (1 << 53) + 3)]
    with pytest.raises(ValueError, match="too large"):
        hard_negatives.mine(df.withColumn("v", F.transform("v", lambda x: x * 64)), F.col("id") == 0)


# SentencePiece


@pytest.fixture(scope="module")
def raw():
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def with_normalizer(raw, rule, **kw):
    """The given model under another rule: a later field of a message replaces the earlier."""
    import sentencepiece

    spec = [v for k, v in sentence_pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule, **kw).serialized_model_proto()) if k == 3][-1]
    n, size = len(spec), b""
    while n > 127:
        n, size = n >> 7, size + bytes([n & 127 | 128])
    return raw + bytes([3 << 3 | 2]) + size + bytes([n]) + spec


ALPHABET = "abcdeT  \n\t ▁éÀ①ｱﾞ́Å日本語𐍈ﷺ㌔　\xa0…½<s>.,;:1234567890\x00​﻿�"


def odd_texts():
    rng = random.Random(3)
    return ["", " ", "  ", "▁", " ▁ ", "a", " a ", "  a  b  ", "x" * 300, " " * 100, "ab " * 100 + "c" * 60, "thethe" * 40, "<s></s><unk><0x41>"] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(400)]


RULES = [None, ("identity", True, True), ("nmt_nfkc", True, True), ("nmt_nfkc_cf", False, False), ("nmt_nfkc", True, False)]


@pytest.mark.parametrize("rule", RULES)
def test_ids_spans_and_decoding_equal_the_library(raw, rule):
    import sentencepiece

    if rule:
        raw = with_normalizer(raw, rule[0], add_dummy_prefix=rule[1], remove_extra_whitespaces=rule[2], escape_whitespaces=True)
    library, model = sentencepiece.SentencePieceProcessor(model_proto=raw), sentence_pieces.Model(raw)
    assert bool(model.map) == bool(rule and rule[0] != "identity")
    encoder, decoder, texts = sentence_pieces.Encoder(model), sentence_pieces.Decoder(model), odd_texts()
    for text, (ids, starts, ends) in zip(texts, encoder(texts), strict=True):
        want = library.encode(text, return_type="proto").pieces
        assert [(p.id, p.begin, p.end) for p in want] == list(zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True)), text
        assert decoder([*ids.tolist(), 2]) == library.decode([*ids.tolist(), 2])
    rng = random.Random(5)
    for _ in range(1000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.choice([28705, 259, 0, 1, 2, 229, 133, 175])]) for _ in range(rng.randint(0, 8))]
        assert decoder(ids) == library.decode(ids), ids
    for most in (32000, 3):  # lists that are decoded at once, and lists of which some are odd
        lists = [[rng.choice([rng.randrange(259, most + 260), 13, 28705]) for _ in range(rng.randint(0, 8))] + [2] * rng.randint(0, 1) for _ in range(60)]
        lists = [[min(i, 31999) for i in ids] for ids in lists] + ([[229, 133, 175], [229], [133, 175, 300]] if most == 3 else [[229, 133, 175]])
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        assert decoder.flat(np.array([i for x in lists for i in x]), offsets).to_pylist() == [library.decode(x) for x in lists]


def test_chunks_learned_again_when_memory_is_full(raw):
    model = sentence_pieces.Model(raw)
    large, small = sentence_pieces.Encoder(model), sentence_pieces.Encoder(model, most_chunks=40)
    texts = odd_texts()
    once = [i.tolist() for i, _, _ in large(texts)]
    assert [i.tolist() for k in range(0, len(texts), 7) for i, _, _ in small(texts[k : k + 7])] == once


def test_merging_side_by_side_equals_merging_one_by_one(raw):
    model = sentence_pieces.Model(raw)
    rng = random.Random(8)
    chunks = sorted({"▁" * rng.randint(0, 3) + "".join(rng.choice("theranison日é") for _ in range(9)) for _ in range(300)}, key=len)
    chunks = [c for c in chunks if len(c) == 10]
    found = {}
    for places, symbols in sentence_pieces.Merger(model)(chunks):
        found |= {chunks[p]: ["".join(model.pieces[s] if s < len(model.pieces) else chr(s - len(model.pieces))) for s in row] for p, row in zip(places.tolist(), symbols.tolist(), strict=True)}
    assert found == {c: sentence_pieces.merged(c, model.ranks) for c in chunks}


def test_a_long_run_without_a_break_is_merged_in_good_time(raw):
    import sentencepiece

    model, text = sentence_pieces.Model(raw), "abcdefgh" * 40_000
    ((ids, _, ends),) = sentence_pieces.Encoder(model)([text])
    assert ids.tolist() == sentencepiece.SentencePieceProcessor(model_proto=raw).encode(text) and ends[-1] == len(text)


def test_models_of_other_kinds_are_refused(raw):
    with pytest.raises(ValueError, match="BPE"):
        sentence_pieces.Model(raw + bytes([2 << 3 | 2, 2, 3 << 3, 1]))


def test_columns_of_documents(spark, tmp_path, raw):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = [*odd_texts(), None, "word " * 50_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, "again"), (5, "again")]
    found = {(r["doc_id"], i): r for i, r in enumerate(sentence_pieces.op13_sentencepiece(spark, write(spark, tmp_path, rows, "documents", "doc_id long, text string")).collect())}
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        want.append((str(i), len(ids), *digest))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found.values()) == sorted(want)
    model = sentence_pieces.Model(raw)
    odd = spark.createDataFrame([(1, "a b", "x", 2)], "ids int, text string, decoded string, starts int")
    row = sentence_pieces.decode(sentence_pieces.encode(odd, model, end=False), model).first()
    assert row["decoded"] == "a b" and row["ids"] == library.encode("a b") and row["starts"] == [0, 1] and row["ends"] == [1, 3]
    assert sentence_pieces.decode(sentence_pieces.encode(odd.limit(0), model), model).count() == 0
