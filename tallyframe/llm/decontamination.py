"""Benchmark decontamination: a BM25 index of test items, queried with every training passage by block-max WAND.

Items are cut into segments of SEGMENT words; index terms are pairs of adjacent words (the word itself where a segment has one word).
Every window of 2 * SEGMENT words of a document, one starting every SEGMENT words, is a query, so each item segment lies whole within a
window. A window's score against a segment is BM25 relative to the segment's score against itself; windows reach the index only if their
terms' largest impacts could reach the threshold, then block-max WAND returns every segment at or above it. Each (document, item) found
is verified: share of the item's five-word shingles found in the whole document, for the question (all but the last sentence) and the
answer (the last sentence); items of one sentence are all question.

The index is built in blocks of about MAX_INDEX_BYTES of item text; more items mean more passes, with the table written between them, so a
worker holds one block's index at a time. Where several blocks exist, items are dealt by hash and statistics are a block's own.

Defined results: null or empty texts leak nothing; null or wordless items are passed over; repeated documents are judged each for itself;
repeated items are reported by each of their ids; a column named `leaks` is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, written

SEGMENT, SHINGLE, POSTING_BLOCK = 64, 5, 32
MAX_INDEX_BYTES = 16 << 20
K1, B = 1.2, 0.75
#: Every ASCII character but digits and letters, as a space.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split() if text else []


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


class Index:
    """Postings of relative impacts in blocks: term -> [(segments, impacts, largest impact), ...]."""

    def __init__(self, items: list[tuple[int, str]], threshold: float):
        self.threshold, self.items, segments = threshold, {}, []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            parts = [p for p in _SENTENCES.split(text.strip()) if words_of(p)]
            answer = words_of(parts[-1]) if len(parts) > 1 else []
            self.items[item_id] = (shingles(words[: len(words) - len(answer)]), shingles(answer), shingles(words))
            for i in range(0, len(words), SEGMENT):
                # a short rest becomes the item's last SEGMENT words, so no word is left out
                start = i if i == 0 or len(words) - i >= SEGMENT // 2 else len(words) - SEGMENT
                segments.append((item_id, Counter(self.terms(words[start : start + SEGMENT]))))
        self.owner = [s[0] for s in segments]
        df = Counter(t for _, s in segments for t in s)
        mean = sum(sum(s.values()) for _, s in segments) / max(1, len(segments))
        lists: dict[tuple, list[tuple[int, float]]] = {}
        for k, (_, s) in enumerate(segments):
            norm = K1 * (1 - B + B * sum(s.values()) / mean)
            impact = {t: log(1 + (len(segments) - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in s.items()}
            own = sum(impact.values())
            for t, x in impact.items():
                lists.setdefault(t, []).append((k, x / own))
        self.postings = {}
        for t, entries in lists.items():
            blocks = [entries[i : i + POSTING_BLOCK] for i in range(0, len(entries), POSTING_BLOCK)]
            self.postings[t] = [([e[0] for e in b], [e[1] for e in b], max(e[1] for e in b)) for b in blocks]
        self.most = {t: max(b[2] for b in blocks) for t, blocks in self.postings.items()}
        self.lone = any(len(t) == 1 for t in self.most)

    @staticmethod
    def terms(words: list[bytes]) -> list[tuple]:
        return list(zip(words, words[1:], strict=False)) if len(words) > 1 else [(w,) for w in words]

    def search(self, terms: set[tuple]) -> list[tuple[int, float]]:
        """Block-max WAND: every segment whose score reaches the threshold."""
        # a cursor: [segment, block, place in block, term]
        cursors = [[self.postings[t][0][0][0], 0, 0, t] for t in terms]
        end, out, theta = len(self.owner), [], self.threshold - 1e-9
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.most[c[3]]
                if bound >= theta:
                    pivot = k
                    break
            if pivot < 0:
                return out
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            block_bound, block_end = 0.0, end
            for c in cursors[: pivot + 1]:
                blocks = self.postings[c[3]]
                while c[1] < len(blocks) - 1 and blocks[c[1]][0][-1] < at:
                    c[1], c[2] = c[1] + 1, 0
                if blocks[c[1]][0][-1] >= at:
                    block_bound += blocks[c[1]][2]
                    block_end = min(block_end, blocks[c[1]][0][-1] + 1)
            if block_bound >= theta:
                if cursors[0][0] == at:
                    score = sum(self.postings[c[3]][c[1]][1][c[2]] for c in cursors[: pivot + 1])
                    if score >= theta:
                        out.append((at, score))
                    target = at + 1
                else:
                    target = at
            else:
                target = block_end if pivot + 1 == len(cursors) else min(block_end, cursors[pivot + 1][0])
                target = max(target, at + 1)
            for c in cursors[: pivot + 1]:
                self._advance(c, target, end)
            cursors = [c for c in cursors if c[0] < end]
        return out

    def _advance(self, c: list, target: int, end: int) -> None:
        blocks = self.postings[c[3]]
        c[0] = blocks[c[1]][0][c[2]]  # a shallow move to another block left the old segment
        while c[0] < target:
            segments = blocks[c[1]][0]
            if segments[-1] < target:
                if c[1] + 1 == len(blocks):
                    c[0] = end
                    return
                c[1], c[2] = c[1] + 1, 0
            else:
                c[2] += 1
            c[0] = blocks[c[1]][0][c[2]]

    def leaks(self, text: str | None, overlap: float, answer_overlap: float) -> list[dict]:
        words = words_of(text)
        if not words:
            return []
        most = self.most
        if len(words) == 1:
            hits = [(0, (words[0],))] if (words[0],) in most else []
        else:
            hits = [(i, p) for i, p in enumerate(zip(words, words[1:], strict=False)) if p in most]
            if self.lone:
                hits += [(i, (w,)) for i, w in enumerate(words) if (w,) in most]
        windows: dict[int, set[tuple]] = {}
        for i, p in hits:
            windows.setdefault(i // SEGMENT, set()).add(p)
            if i >= SEGMENT:
                windows.setdefault(i // SEGMENT - 1, set()).add(p)
        found: dict[int, float] = {}
        for terms in windows.values():
            if sum(map(most.__getitem__, terms)) >= self.threshold:
                for segment, score in self.search(terms):
                    item = self.owner[segment]
                    found[item] = max(score, found.get(item, 0.0))
        if not found:
            return []
        own, out = shingles(words), []
        for item, score in sorted(found.items()):
            question, answer, whole = self.items[item]
            if len(next(iter(whole))) < SHINGLE:  # fewer words than a shingle
                n = len(next(iter(whole)))
                own_n = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
                total = q = a = float(whole <= own_n)
            else:
                total = len(whole & own) / len(whole)
                q = self._share(question, own, words)
                a = self._share(answer, own, words) if answer else total
            if total >= overlap and q >= overlap and a >= answer_overlap:
                out.append({"item_id": item, "score": score, "question_overlap": q, "answer_overlap": a})
        return out

    @staticmethod
    def _share(part: set, own: set, words: list[bytes]) -> float:
        if not part:
            return 1.0
        n = len(next(iter(part)))
        if n < SHINGLE:
            own = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        return len(part & own) / len(part)

LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())]))


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = 0.5, overlap: float = 0.8, answer_overlap: float = 0.5) -> DataFrame:
    """docs with `leaks`: the items that each whole text holds."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // MAX_INDEX_BYTES))
    out = docs.drop("leaks")
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        index = Index([(r["item_id"], r["text"]) for r in own.collect()], threshold)  # MAX_INDEX_BYTES a block, about

        def make(index=index):
            def columns_of(batch: pa.RecordBatch) -> list[pa.Array]:
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                return [pa.array([index.leaks(t, overlap, answer_overlap) for t in texts], LEAKS_ARROW)]

            return columns_of

        out = append_columns(out, make, [T.StructField(f"_leaks{block}", LEAKS)])
        if block + 1 < blocks:
            out = written(out, "leaks")
    names = [f"_leaks{b}" for b in range(blocks)]
    return out.withColumn("leaks", F.concat(*names)).drop(*names)


LEAKS_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(docs, items).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")
