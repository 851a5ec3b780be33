"""Language identification by multilingual mixture inference.

Every document is a mixture of languages. A word's likelihood under a language is the product of the likelihoods of its
byte trigrams; expectation-maximisation over the words gives the document's language proportions, and the set of languages
is the one with the best penalised likelihood among the nested sets of the largest proportions.

Training counts trigrams over all given rows: each task sums its own, Spark sums them by language and bucket. The model is a table of BUCKETS
trigram buckets for each language.

Defined results: null text, or text without a letter, gives lang `und`, score 0 and an empty mixture. An empty training table
gives a model without languages, under which everything is `und`. Ties go to the language that sorts first. Repeated rows are
predicted each for itself; columns named like the outputs are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

BUCKETS = 1 << 16
#: Bytes of text handled at once, cut between words; languages that a task holds counts of before it hands them on.
CHUNK, HELD = 1 << 20, 64


def trigram_buckets(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased UTF-8: the trigram bucket at each letter byte, whether a word starts there, and the letters' places."""
    a = np.frombuffer(raw, np.uint8)
    letter = ((a >= 97) & (a <= 122)) | (a >= 128)
    b = np.zeros(len(a) + 2, np.uint32)
    b[1:-1] = np.where(letter, a, 0)
    at = np.flatnonzero(letter)
    code = (b[at] << np.uint32(16)) | (b[at + 1] << np.uint32(8)) | b[at + 2]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16), b[at] == 0, at


def _pieces(raw: bytes):
    """Stretches of about CHUNK bytes that end before a space or line feed."""
    i = 0
    while i < len(raw):
        j = i + CHUNK
        if j < len(raw):
            ends = [x for x in (raw.find(b" ", j), raw.find(b"\n", j)) if x >= 0]
            j = min(ends) if ends else len(raw)
        yield raw[i:j]
        i = j


@dataclass(frozen=True)
class LanguageModel:
    """Log-likelihoods of trigram buckets, one column per language."""

    languages: tuple[str, ...]
    table: np.ndarray


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Learn from all rows with text and lang. Only sums of fixed size reach the driver."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}

        def rows():
            places = {k: np.flatnonzero(v) for k, v in sums.items()}
            langs = pa.array([k for k, at in places.items() for _ in range(len(at))], pa.string())
            bucket, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (places.values(), [sums[k][at] for k, at in places.items()]))
            sums.clear()
            return pa.RecordBatch.from_arrays([langs, pa.array(bucket.astype(np.int32)), pa.array(n)], names=["lang", "bucket", "n"])

        for batch in batches:
            for t, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own not in sums:
                    if len(sums) >= HELD:
                        yield rows()
                    sums[own] = np.zeros(BUCKETS, np.int64)
                for piece in _pieces(t.lower().encode("utf-8", "replace")):
                    sums[own] += np.bincount(trigram_buckets(piece)[0], minlength=BUCKETS)
        yield rows()

    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    got = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows a language at most
    languages = sorted(set(got["lang"]))
    counts = np.zeros((BUCKETS, len(languages)))
    counts[got["bucket"].to_numpy(np.int64), np.searchsorted(languages, got["lang"].to_numpy(str)) if languages else np.zeros(0, np.int64)] = got["n"].to_numpy(np.float64)
    table = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * BUCKETS)).astype(np.float32)
    return LanguageModel(tuple(languages), table)


def word_likelihoods(raw: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods by word and language, and the byte at which each word starts."""
    code, start, at = trigram_buckets(raw)
    if not len(at):
        return np.zeros((0, table.shape[1]), np.float32), at
    start[0] = True
    first = np.flatnonzero(start)
    return np.add.reduceat(table[code], first, axis=0), at[first]


def mixtures(ll: np.ndarray, first: np.ndarray, rounds: int, penalty: float) -> list[np.ndarray]:
    """Proportions for each of the documents whose words start at `first` (none of them empty)."""
    n_lang, sizes = ll.shape[1], np.diff(np.append(first, len(ll)))
    owner = np.repeat(np.arange(len(first)), sizes)
    top = ll.max(axis=1)
    p = np.exp(np.maximum(ll - top[:, None], -60)).astype(np.float32)
    best = np.add.reduceat(ll.astype(np.float64), first, axis=0)
    theta = np.full((len(first), n_lang), 1 / n_lang, np.float32)
    for _ in range(rounds):
        r = p * theta[owner]
        r /= r.sum(axis=1, keepdims=True)
        theta = (np.add.reduceat(r, first, axis=0) / sizes[:, None]).astype(np.float32)
    full = np.add.reduceat(np.log(np.maximum((p * theta[owner]).sum(axis=1), 1e-30)).astype(np.float64) + top, first)
    out = []
    for d in range(len(first)):
        alone = best[d].max()
        chosen, score = np.eye(n_lang, dtype=np.float32)[int(best[d].argmax())], alone
        cost = penalty * np.log(sizes[d] + 1)
        if full[d] - cost > score:  # else no set of two or more can win, as the full mixture's likelihood is the largest
            q, own_top = p[first[d] : first[d] + sizes[d]], top[first[d] : first[d] + sizes[d]].astype(np.float64).sum()
            order = np.argsort(-theta[d], kind="stable")
            for k in range(2, n_lang + 1):
                t = np.zeros(n_lang, np.float32)
                t[order[:k]] = np.maximum(theta[d][order[:k]], 1e-6)
                t /= t.sum()
                for _ in range(3 if k < n_lang else 0):
                    r = q * t
                    t = (r / np.maximum(r.sum(axis=1, keepdims=True), 1e-30)).mean(axis=0)
                now = float(np.log(np.maximum(q @ t, 1e-30)).sum() + own_top) - (k - 1) * cost
                if now > score:
                    chosen, score = t, now
        out.append(chosen / chosen.sum())
    return out


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", rounds: int = 10, penalty: float = 2.0) -> DataFrame:
    """docs with lang_pred, score (the proportion of lang_pred) and mixture (proportions of the selected languages)."""
    languages, table = model.languages, model.table

    def make():
        def columns_of(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found: list[dict[str, float] | None] = [None] * len(texts)
            group, held = [], 0

            def flush():
                nonlocal group, held
                parts = [np.concatenate([word_likelihoods(x, table)[0] for x in _pieces(raw)]) if len(raw) > CHUNK else raw for _, raw in group]
                short = [k for k, x in enumerate(parts) if isinstance(x, bytes)]
                if short:  # all short texts at once, a line break between each two
                    lengths = np.array([len(parts[k]) + 1 for k in short])
                    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                    ll, places = word_likelihoods(b"\n".join(parts[k] for k in short), table)
                    cut = np.append(np.searchsorted(places, begins), len(places))
                    full = [j for j in range(len(short)) if cut[j] < cut[j + 1]]
                    if full:
                        for j, theta in zip(full, mixtures(ll, cut[full], rounds, penalty), strict=True):
                            found[group[short[j]][0]] = theta
                for (k, _), x in zip(group, parts, strict=True):
                    if not isinstance(x, bytes) and len(x):
                        found[k] = mixtures(x, np.array([0]), rounds, penalty)[0]
                group, held = [], 0

            for k, t in enumerate(texts):
                if t and languages and any(map(str.isalpha, t)):
                    raw = t.lower().encode("utf-8", "replace")
                    group.append((k, raw))
                    held += len(raw)
                    if held > CHUNK:
                        flush()
            flush()
            preds, scores, sets = [], [], []
            for theta in found:
                if theta is None:
                    preds.append("und"), scores.append(0.0), sets.append([])
                else:
                    k = int(theta.argmax())
                    preds.append(languages[k]), scores.append(min(1.0, float(theta[k])))
                    sets.append([(languages[j], float(theta[j])) for j in np.flatnonzero(theta > 0)])
            return [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))]

        return columns_of

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))]
    return append_columns(docs, make, fields)


def held_out(doc_id: str = "doc_id"):
    """The rows that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit_on_corpus(docs: DataFrame) -> LanguageModel:
    return fit(docs.where(~held_out() & F.col("lang").isNotNull()))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit_on_corpus(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "mixture")
