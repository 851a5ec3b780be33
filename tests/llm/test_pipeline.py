"""The pipeline's stages against brute force, on null, empty and repeated rows, a clashing column and empty tables."""

from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .test_corpus_operators import groups_by_force
from .test_text_operators import ITEMS, leaking

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, label string"
EN, DE = "the house and the garden are there with this thing ", "das haus und der garten sind nicht mit dieser sache "
LONG = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    *[(i, f"{EN if i % 2 else DE}\nall rights reserved\n{'the' if i % 2 else 'das'} n{i} {' '.join(f't{i}x{k}' for k in range(12))}") for i in range(24)],
    (50, "all rights reserved"), (51, LONG), (52, LONG), (52, LONG), (53, LONG + " more"), (54, f"{EN * 4}{ITEMS[0][1]} {EN}"), (55, None), (56, ""), (57, "123 456 !?"), (None, EN * 2), (None, None),
]
ROWS = [(i, t, None if t is None else ("en" if "the " in t else "de"), "web", None if t is None else len(t), "x") for i, t in TEXTS]


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").lower()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def kept_ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda i: -1 if i is None else i)


def test_language_stage(spark, docs, folder):
    kept = corpus_pipeline.language_stage(spark, docs, folder)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert all(t and any(map(str.isalpha, t)) for t in texts)
    wholly = [t for _, t in TEXTS if t and (EN in t or DE in t)]
    assert {t for t in texts if EN in t or DE in t} == set(wholly)


def test_line_stage(spark, docs, folder):
    holders = defaultdict(list)
    for i, t in TEXTS:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            holders[k].append(1 << 62 if i is None else i)
    want = []
    for i, t in TEXTS:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(holders[key(x)]) < 10 or min(holders[key(x)]) == i]
        if len(left) == len(lines):
            want.append((i, t, None if t is None else len(t)))
        elif "\n".join(left).strip(" "):
            want.append((i, "\n".join(left), len("\n".join(left))))
    kept = corpus_pipeline.line_stage(spark, docs, folder)
    assert kept.columns == docs.columns
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()), key=order) == sorted(want, key=order)
    assert 50 not in {w[0] for w in want}


def test_near_stage(spark, docs, folder):
    known = {i: t for i, t in TEXTS if i is not None}
    want = sorted(i for i, (_, c) in groups_by_force(list(known.items()), 5, 80).items() if i == c)
    kept = corpus_pipeline.near_stage(spark, docs, folder)
    assert kept.columns == docs.columns
    assert [i for i in kept_ids(kept) if i is not None] == want and {52, 53}.isdisjoint(want)
    assert kept.where("doc_id is null").count() == 2  # null ids belong to no group


def test_leak_stage(spark, docs, folder):
    kept = corpus_pipeline.leak_stage(spark, docs, folder)
    assert kept.columns == docs.columns
    long_items = [x for x in ITEMS if x[0] != 5]
    assert kept_ids(kept) == sorted((i for i, t in TEXTS if not leaking(t, long_items)), key=lambda i: -1 if i is None else i)
    assert 54 not in kept_ids(kept)


def test_token_stage(spark, docs, folder):
    import public_tokenizers
    import tiktoken

    from tallyframe.llm.byte_bpe import load_ranks

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    found = corpus_pipeline.token_stage(spark, docs, folder).collect()
    assert all(r["decodes"] for r in found)
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["ids"]) for r in found), key=order) == sorted(((i, library.encode_ordinary(t or "")) for i, t in TEXTS), key=order)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_table(spark, docs, folder, name, stage):
    assert stage(spark, docs.where(F.lit(False)), folder).count() == 0
