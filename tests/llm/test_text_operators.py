"""Language ID, byte-level BPE, fingerprints and decontamination against brute force and on odd rows."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import byte_bpe, decontamination, language, multiset_hash
from tallyframe.llm.common import WordHasher

ODD = [(1, None), (2, ""), (3, "   \n\t"), (None, "some words here"), (5, "some words here"), (5, "some words here"), (6, "123 456 !?"), (7, "é漢字 " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_language_mixture(spark, odd):
    en, de = "the house and the garden are there with this thing ", "das haus und der garten sind nicht mit dieser sache "
    rows = [(i, (en if i % 2 else de) * (1 + i % 5), "en" if i % 2 else "de") for i in range(60)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("de", "en")
    tests = spark.createDataFrame([(1, "the garden and the house"), (2, "der garten und das haus"), (3, en * 3 + de)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identify(tests, model).collect()}
    assert (got[1]["lang_pred"], got[2]["lang_pred"], got[3]["lang_pred"]) == ("en", "de", "en")
    assert set(got[3]["mixture"]) == {"en", "de"} and 0.6 < got[3]["score"] < 0.9
    clash = odd.withColumns({"lang_pred": F.lit("x"), "score": F.lit("y")})
    found = language.identify(clash, model).collect()
    assert len(found) == len(ODD)
    for r in found:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (r["text"] is None or not any(map(str.isalpha, r["text"])))
    empty = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.identify(odd.limit(0), model).count() == 0


def test_language_never_learns_from_held_out(spark):
    rows = spark.createDataFrame([(i, "aaa bbb", "xx") for i in range(40)] + [(None, "aaa", "yy")], "doc_id long, text string, lang string")
    held = {r["doc_id"] for r in rows.where(language.held_out()).collect()}
    import zlib

    assert held == {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_bpe_equals_library(spark, odd, ranks):
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = [(20, "x" * 5000), (21, "it's we'll  two  spaces nbsp wide \r\n end "), (22, "<|endoftext|> ok"), (23, "!?" * 400 + "漢" * 300)]
    docs = odd.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("ids", F.lit("clash"))
    found = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN).withColumn("back", byte_bpe.decoded(F.col("ids"), ranks))
    rows = found.collect()
    assert len(rows) == len(ODD) + len(extra)
    for r in rows:
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["back"]) == (r["text"] or "").encode()
    assert byte_bpe.encode(odd.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_plain_texts_split_as_the_pattern_does():
    import public_tokenizers
    import regex

    split, want = byte_bpe.splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    plain = byte_bpe.PLAIN[public_tokenizers.PATTERN]  # the query's pattern has a plain form
    assert split("a") == ["a"] and plain
    for letters in (" \n\t'sdaéßŁ9!_-“€·", " \n\x1c\x1f\x85\xa0\u2003'a٣²ªº漢\u200b\u0301İǅ"):
        draw = random.Random(11)
        for _ in range(4000):
            text = "".join(draw.choice(letters) for _ in range(draw.randrange(14)))
            assert split(text) == want(text), repr(text)
    for c in map(chr, range(0x2100)):
        assert split(f"a{c} {c}b") == want(f"a{c} {c}b"), repr(c)


def test_bpe_by_higher_order_functions(spark, odd, ranks):
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = [(20, "x" * 60), (21, "it's we'll  two\u00a0spaces \r\n end "), (22, "<|endoftext|> ok"), (23, "!?" * 20 + "漢" * 9 + "\U0001f600 e\u0301")]
    rows = odd.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    for r in rows.withColumn("ids", byte_bpe.encoded(F.col("text"), ranks, public_tokenizers.PATTERN)).collect():
        assert r["ids"] == library.encode_ordinary(r["text"] or "")


def test_bpe_table_is_bounded(tmp_path, monkeypatch):
    (tmp_path / "t").write_bytes(b"YQ== 0\nYg== 1\n")
    assert byte_bpe.load_ranks(str(tmp_path / "t")) == {b"a": 0, b"b": 1}
    monkeypatch.setattr(byte_bpe, "MAX_RANK_BYTES", 5)
    with pytest.raises(ValueError):
        byte_bpe.load_ranks(str(tmp_path / "t"))


def test_fingerprint_is_a_multiset_hash(spark, odd):
    hasher = WordHasher()
    one = lambda t: multiset_hash.written_out(multiset_hash.vectors([t], hasher)[0])
    assert one("a b c\nd e\nf") == one("f\na b c\nd e") != one("a b c\nd e")
    assert multiset_hash.add(one("a b c\nd e"), one("f")) == one("a b c\nd e\nf")
    assert multiset_hash.remove(one("a b c\nd e\nf"), one("f")) == one("d e\na b c")
    words = [f"word{i}" for i in range(400)]
    near = multiset_hash.vectors([" ".join(words), " ".join(words[:200]), " ".join(f"other{i}" for i in range(400))], hasher)
    assert 0.45 < multiset_hash.likeness(near[:1], near[1:2])[0] < 0.95 and multiset_hash.likeness(near[:1], near[2:])[0] < 0.35
    rows = multiset_hash.fingerprints(odd, {"text": "fp"}).collect()
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"] or "", r["fp"]) == r["fp"]
    assert len({*by_text.values()}) == len(by_text)


def test_likeness_of_long_repetitive_texts():
    hasher = WordHasher()
    a, b, c = (multiset_hash.vectors(["the cat sat " * n], hasher) for n in (60_000, 30_000, 9_000))
    assert multiset_hash.likeness(a, b)[0] > 0.99 and multiset_hash.likeness(a, c)[0] > 0.99
    for v in (a, b, c):
        assert (multiset_hash.lanes_of(multiset_hash.written_out(v[0])) == v[0]).all()


def test_next_with_null_and_repeated_ids(spark, monkeypatch):
    """One cycle over all rows, ids falling, null ids last, though blocks are small and one id and null hold most rows."""
    monkeypatch.setattr(multiset_hash, "BLOCK_BYTES", 8)
    rows = [(7, f"a{i}") for i in range(20)] + [(None, f"b{i}") for i in range(15)] + [(i, f"c{i}") for i in (1, 2, 9, 1 << 40)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("next_text", F.lit("clash"))
    got = multiset_hash.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text"]).collect()
    ids, follows = {r["text"]: r["doc_id"] for r in got}, {r["text"]: r["next_text"] for r in got}
    assert len(got) == len(rows) and sorted(follows.values()) == sorted(follows)
    at, seen = f"c{1 << 40}", []
    while at not in seen:
        seen.append(at)
        at = follows[at]
    assert len(seen) == len(rows) and [ids[t] for t in seen] == sorted((r[0] for r in rows), key=lambda i: (i is None, -(i or 0)))
    assert multiset_hash.with_next(docs.limit(0), ["text"]).count() == 0


@pytest.mark.parametrize("ids", [[5], [10, 1000, 7, 123456789, 8], list(range(0, 600, 3))])
def test_next_in_descending_order(spark, ids, monkeypatch):
    monkeypatch.setattr(multiset_hash, "BLOCK_BYTES", 8)
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in multiset_hash.with_next(docs, ["text"]).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_fingerprint_query(spark, tmp_path):
    texts = {3: "abcd\nef", 1: "xy", 9: "", 4: "ü" * 7, 12: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in multiset_hash.op9_fingerprint(spark, str(tmp_path)).collect()}
    for k, i in enumerate(order):
        own, other = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        h = len(own) // 2
        assert got[i]["n_chars"] == len(own) and got[i]["edited_sha256"] == hashlib.sha256((own[: len(own) - h] + other[:h]).encode()).hexdigest()


ITEMS = [(1, "What is the colour of the sky on a clear day in June? It is blue."), (2, "name the seven hills of the old town by the river in order"), (3, None), (4, "?!"), (5, "one two"), (6, "What is the colour of the sky on a clear day in June? It is blue.")]


def leaking(text, items):
    own = decontamination.shingles(decontamination.words_of(text))
    out = set()
    for i, t in items:
        want = decontamination.shingles(decontamination.words_of(t))
        if want and len(next(iter(want))) == 5 and len(want & own) / len(want) >= 0.8:
            out.add(i)
    return out


def test_leaks_equal_brute_force(spark, odd, monkeypatch):
    filler = " ".join(f"w{i % 97} and the of" for i in range(300))
    texts = [filler, f"{filler} {ITEMS[0][1]} {filler}", ITEMS[1][1].upper() + "!", "the colour of the sky on a clear", f"{filler}\n{ITEMS[1][1].replace(' ', chr(10))}\n{ITEMS[0][1]}"]
    docs = odd.unionByName(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string")).withColumn("leaks", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for bound in (1 << 20, 60):
        monkeypatch.setattr(decontamination, "MAX_INDEX_BYTES", bound)
        rows = decontamination.find_leaks(docs, items).collect()
        assert len(rows) == len(ODD) + len(texts)
        for r in rows:
            assert {x["item_id"] for x in r["leaks"]} - {5} == leaking(r["text"], ITEMS)
    assert decontamination.find_leaks(docs, items.limit(0)).where("size(leaks) > 0").count() == 0


def test_wand_equals_exhaustive(spark):
    import random

    draw = random.Random(2)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(2, 90)))) for i in range(120)]
    index = decontamination.Index(items, 0.2)
    for _ in range(60):
        words = [draw.choice(vocabulary).encode() for _ in range(128)]
        terms = {t for t in index.terms(words) if t in index.most}
        scores = Counter()
        for t in terms:
            for segments, impacts, _ in index.postings[t]:
                for k, x in zip(segments, impacts, strict=True):
                    scores[k] += x
        assert {k for k, _ in index.search(terms)} == {k for k, x in scores.items() if x >= 0.2 - 1e-9}


@pytest.mark.parametrize("size", [1, 2, 3])
def test_wand_moves_between_blocks(size, monkeypatch):
    import random

    monkeypatch.setattr(decontamination, "POSTING_BLOCK", size)
    draw = random.Random(3)
    vocabulary = [f"v{i}" for i in range(12)]
    index = decontamination.Index([(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(2, 90)))) for i in range(120)], 0.2)
    for _ in range(60):
        words = [draw.choice(vocabulary).encode() for _ in range(draw.choice([6, 20, 128]))]
        terms = {t for t in index.terms(words) if t in index.most}
        scores = Counter()
        for t in terms:
            for segments, impacts, _ in index.postings[t]:
                for k, x in zip(segments, impacts, strict=True):
                    scores[k] += x
        got = dict(index.search(terms))
        assert got == pytest.approx({k: x for k, x in scores.items() if x >= 0.2 - 1e-9})
