"""N-gram Jaccard join: a grouped prefix join over distinct word shingles.

1. Every text becomes the sorted set of its shingles' 64-bit hashes. Texts with one and the same set are one document from here on.
2. A global order of shingles puts hot ones (in more than HOT sets) last and sorts the rest by hash. A set's prefix is its first
   |S| - ceil(t |S|) + 1 shingles; two sets of similarity t or more share a shingle of both prefixes.
3. Sets with the same prefix and size are one group. Groups meet in the bucket of each prefix shingle, dealt to partitions as packed arrays
   by the shingle's leading bits; group pairs whose sizes can't reach t are dropped; the rest is expanded to members and verified
   on the exact sets.
4. Buckets of hot shingles, groups of several members and pairs of such groups can be of any size, so they are not expanded to pairs. Rounds of
   hubs join their members: a bucket's hub is a member of its largest component, and a document meets one hub a round, the one that it shares
   most buckets with. Verified links contract components; a bucket that holds one component is done. So a round compares at most as many
   pairs as there are documents, and later rounds only those that stand apart.
5. A shingle's place in a set bounds the size of the sets that can link through it as their first common shingle (`most_partner`). Of two
   sets that link, the smaller has room for a partner of its own size; a bucket needs such a member, and only these meet the others.
6. In buckets that hubs don't settle, members of different components that fit are compared, a block of members against a block. Each set has
   a bitmap of the parities of its shingles by hash: the bits in which two maps differ are no more than the shingles that one set alone has,
   so most pairs that can't link are seen in the join's condition and never become rows. So no link between components is lost.

Hot shingles only steer the order and so the cost: the HEAD most frequent are sent to all executors, whatever their number.

Defined results: null or wordless texts have no shingles and link with nothing; texts shorter than a shingle are one shingle; rows that
share an id are one document, of the least of their texts, and equal texts share a component; rows with a null id get a null component; an
empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, WordHasher, grouped, mixed, offsets_of, sliced, written
from .components import components, contracted

HOT, HEAD, FEW, HUB_ROUNDS, BLOCK_ROWS = 32, 1 << 20, 8, 3, 256
#: Kinds of buckets: pairs of groups, shingles, groups.
CROSSED, TOKEN, GROUP = 0, 1, 2
#: 64-bit words of a set's bitmap.
MAP_WORDS = 8
#: A hub's text is sent once for about so many of its partners, so that a hot hub is many keys.
HUB_ROWS = 256
#: Bytes of packed entries that a partition should hold.
PART_BYTES = 8 << 20
#: Ids up to this number are broadcast to select texts; beyond it the join shuffles.
MOST_SENT = 1 << 21


def shingle_sets(texts: list[str | None], hasher: WordHasher, width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles: A-Z in lower case, words between ASCII white space."""
    out = []
    for _, group in grouped(texts):
        h, starts = hasher.words(b"\n".join(group))
        cuts = np.searchsorted(starts, offsets_of(group))
        s = np.full(max(0, len(h) - width + 1), width, np.uint64)
        for k in range(width if len(s) else 0):
            s = s * MIX_A + h[k : k + len(s)]
        s = mixed(s)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(s[a : b - width + 1]))
            elif b > a:  # fewer words than a shingle
                short = np.full(1, b - a, np.uint64)
                for k in range(a, b):
                    short = short * MIX_A + h[k]
                out.append(mixed(short))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def shingle_set(text: str | None, hasher: WordHasher, width: int) -> np.ndarray:
    return shingle_sets([text], hasher, width)[0]


def needed(n: int, percent: int) -> int:
    """Prefix length of a set of n."""
    return n - -(-percent * n // 100) + 1


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n, sig (128-bit hash of the set), low (its lowest shingles, more than a prefix) and bits (parities of its shingles by hash)."""

    def run(batches):
        hasher = WordHasher()
        for batch in sliced(batches):
            n, sig, low, bits = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), hasher, width):
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                low.append(s[: needed(len(s), percent) + len(s) // 20 + 12].tobytes())
                odd = np.bincount((s & np.uint64(64 * MAP_WORDS - 1)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(low, pa.binary()), pa.array(bits, pa.list_(pa.int64()))], names=["doc_id", "n", "sig", "low", "bits"])

    return docs.mapInArrow(run, "doc_id long, n long, sig binary, low binary, bits array<bigint>")


def _parts(tokens: np.ndarray, parts: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _dealt(tokens: np.ndarray, parts: int, *others: np.ndarray):
    """(part, tokens' bytes, others' bytes ...) of each part that has any."""
    part = _parts(tokens, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            at = order[cuts[p] : cuts[p + 1]]
            yield p, tokens[at].tobytes(), *(x[at].tobytes() for x in others)


def _hot_keys(tokens: np.ndarray, parts: int) -> np.ndarray:
    """Part and 32 further bits of each token."""
    return (_parts(tokens, parts) << np.uint64(32)) | ((tokens >> np.uint64(16)) & np.uint64(0xFFFFFFFF))


def _hot(rows: DataFrame, column: str, parts: int) -> DataFrame:
    """(token, n) of shingles in more than HOT of the packed sets in a column.

    Each batch counts its own first: a shingle that it holds once goes as it is, one that it holds more often goes once, with its count, so
    that a shingle of all documents is sent once a batch.
    """

    def deal(batches):
        for batch in batches:
            keys, n = np.unique(_hot_keys(np.concatenate([np.frombuffer(x, np.uint64) for x in batch.column(0).to_pylist()] or [np.zeros(0, np.uint64)]), parts), return_counts=True)
            cuts = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
            short, n = keys.astype(np.uint32), n.astype(np.uint32)
            got = []
            for p in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                own, times = short[cuts[p] : cuts[p + 1]], n[cuts[p] : cuts[p + 1]]
                more = times > 1
                got.append((p, own[~more].tobytes(), own[more].tobytes(), times[more].tobytes()))
            columns = [pa.array([g[k] for g in got], pa.int32() if k == 0 else pa.binary()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "once", "more", "times"])

    def count(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        once, more, times = (np.concatenate([np.frombuffer(x, np.uint32) for x in table.column(c).to_pylist()]) for c in ("once", "more", "times"))
        once, n = np.unique(once, return_counts=True)
        tokens, at = np.unique(np.concatenate([once, more]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, times]), len(tokens)).astype(np.int64)  # exact below 2**53
        hot = n > HOT
        return pa.table([pa.array((np.int64(part) << 32) | tokens[hot].astype(np.int64), pa.int64()), pa.array(n[hot], pa.int64())], names=["token", "n"])

    return rows.select(column).mapInArrow(deal, "part int, once binary, more binary, times binary").groupBy("part").applyInArrow(count, "token long, n long")


def _is_hot(tokens: np.ndarray, head: np.ndarray, parts: int) -> np.ndarray:
    if not len(head):
        return np.zeros(len(tokens), bool)
    key = _hot_keys(tokens, parts).astype(np.int64)
    at = np.searchsorted(head, key)
    return head[np.minimum(at, len(head) - 1)] == key


def _group_of(prefix: np.ndarray, n: int) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(prefix.tobytes(), n & 0xFFFFFFFF)).astype(np.int64))


def _prefixes(batches, head: np.ndarray, parts: int, percent: int):
    """Of batches of (doc_id, n, tokens, whole), slice by slice: lists of (doc_id, n, group, prefix, hot), the hot shingles last, hot their
    number; hot -1 where the tokens at hand are not the whole set and don't suffice."""
    for batch in sliced(batches):
        out = []
        for doc_id, n, raw, whole in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            s, p = np.frombuffer(raw, np.uint64), needed(n, percent)
            hot = _is_hot(s, head, parts)
            cold = s[~hot][:p]
            if len(cold) < p and not whole and len(s) < n:
                out.append((doc_id, n, 0, s[:0], -1))
            else:
                prefix = np.concatenate([cold, s[hot][: p - len(cold)]])
                out.append((doc_id, n, _group_of(prefix, n), prefix, p - len(cold)))
        yield out


def _lacking(rows: DataFrame, head: np.ndarray, parts: int, percent: int) -> DataFrame:
    """(doc_id) of the sets whose tokens at hand don't suffice."""

    def run(batches):
        for found in _prefixes(batches, head, parts, percent):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found if r[4] < 0], pa.int64())], names=["doc_id"])

    return rows.mapInArrow(run, "doc_id long")


def _groups(rows: DataFrame, head: np.ndarray, parts: int, percent: int) -> DataFrame:
    """(doc_id, n, grp): sets of one group have the same prefix and size."""

    def run(batches):
        for found in _prefixes(batches, head, parts, percent):
            kept = [r[:3] for r in found if r[4] >= 0]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], pa.int64()) for i in range(3)], names=["doc_id", "n", "grp"])

    return rows.mapInArrow(run, "doc_id long, n long, grp long")


def _meet(rows: DataFrame, head: np.ndarray, parts: int, percent: int) -> DataFrame:
    """Group pairs (kind 0: a, b) of cold shingles, and entries (kind 1: a the shingle, b the group, place of a in b's prefix) of crowded ones."""

    def deal(batches):
        for batch in batches:  # as many entries at once as fit: fewer, larger pieces
            groups: dict[int, tuple] = {}
            for found in _prefixes([batch], head, parts, percent):
                for _, n, grp, prefix, hot in found:
                    if hot >= 0 and grp not in groups:
                        groups[grp] = (prefix[: len(prefix) - hot], n)
            if groups:
                lengths = [len(x[0]) for x in groups.values()]
                tokens = np.concatenate([x[0] for x in groups.values()])
                owner = np.repeat(np.array(list(groups), np.int64), lengths)
                size = np.repeat(np.array([x[1] for x in groups.values()], np.uint32), lengths)
                place = np.concatenate([np.arange(n, dtype=np.uint32) for n in lengths])
                got = list(_dealt(tokens, parts, owner, size, place))
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), *(pa.array([g[i] for g in got], pa.binary()) for i in (1, 2, 3, 4))], names=["part", "tokens", "owner", "size", "place"])

    def meet(table: pa.Table) -> pa.Table:
        columns = (("tokens", np.uint64), ("owner", np.int64), ("size", np.uint32), ("place", np.uint32))
        tokens, owner, size, place = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in columns)
        order = np.argsort(tokens, kind="stable")
        tokens, owner, size, place = tokens[order], owner[order], size[order], place[order]
        same = tokens[1:] == tokens[:-1]
        shared = np.zeros(len(tokens), bool)
        shared[1:] |= same
        shared[:-1] |= same
        tokens, owner, size, place = tokens[shared], owner[shared], size[shared].astype(np.int64), place[shared].astype(np.int64)
        order = np.lexsort((owner, tokens))
        tokens, owner, size, place = tokens[order], owner[order], size[order], place[order]
        first = np.ones(len(tokens), bool)
        first[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        tokens, owner, size, place = tokens[first], owner[first], size[first], place[first]
        partner = most_partner(size, place, percent)
        begins = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, int)
        lengths = np.diff(np.append(begins, len(tokens)))
        a, b, crowd = [], [], {}
        for w in np.unique(lengths):  # all buckets of one width at once
            if w < 2:
                continue
            at = begins[lengths == w][:, None] + np.arange(w)
            if w > FEW:
                for row in at:  # buckets of the same groups are one, under the first of their shingles
                    members = owner[row]
                    crowd.setdefault(members.tobytes(), (tokens[row[0]], members, place[row]))
                continue
            i, j = np.triu_indices(w, 1)
            x, y = at[:, i].ravel(), at[:, j].ravel()
            fits = (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])) & (size[x] <= partner[y]) & (size[y] <= partner[x])
            a.append(owner[x[fits]])
            b.append(owner[y[fits]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        if len(a):
            a, b = np.unique(np.stack([a, b], axis=1), axis=0).T
        bucket = np.repeat(np.array([x[0] for x in crowd.values()], np.uint64).view(np.int64), [len(x[1]) for x in crowd.values()]) if crowd else np.zeros(0, np.int64)
        crowded = np.concatenate([x[1] for x in crowd.values()]) if crowd else np.zeros(0, np.int64)
        places = np.concatenate([np.zeros(len(a), np.int64), *(x[2] for x in crowd.values())])
        kind = np.concatenate([np.zeros(len(a), np.int32), np.ones(len(crowded), np.int32)])
        return pa.table([pa.array(kind, pa.int32()), pa.array(np.concatenate([a, bucket]), pa.int64()), pa.array(np.concatenate([b, crowded]), pa.int64()), pa.array(places, pa.int64())], names=["kind", "a", "b", "place"])

    return rows.mapInArrow(deal, "part int, tokens binary, owner binary, size binary, place binary").groupBy("part").applyInArrow(meet, "kind int, a long, b long, place long")


def _hot_entries(rows: DataFrame, head: np.ndarray, parts: int, percent: int) -> DataFrame:
    """(a the shingle, b the group, place of a in b's prefix) of hot shingles that stand in a prefix."""

    def run(batches):
        for found in _prefixes(batches, head, parts, percent):
            kept = [r for r in found if r[4] > 0]
            tokens = np.concatenate([r[3][-r[4] :] for r in kept] or [np.zeros(0, np.uint64)]).astype(np.int64)
            owner = np.repeat(np.array([r[2] for r in kept], np.int64), [r[4] for r in kept]) if kept else np.zeros(0, np.int64)
            place = np.concatenate([np.arange(len(r[3]) - r[4], len(r[3]), dtype=np.int64) for r in kept] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(owner), pa.array(place)], names=["a", "b", "place"])

    return rows.mapInArrow(run, "a long, b long, place long").distinct()


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (doc_id, text) of the ids."""
    few = ids.limit(MOST_SENT + 1).count() <= MOST_SENT
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _one_text_each(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with one row for each id: of rows that share one the least text; null ids stay."""
    known = docs.where("doc_id is not null")
    if not known.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return docs
    return known.groupBy("doc_id").agg(F.min("text").alias("text")).unionByName(docs.where("doc_id is null"))


def _could_link(n, bits, n2, bits2, percent: int):
    """Whether sets of these sizes and bitmaps can be similar enough: at least as many shingles stand in one alone as bits differ."""
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.get(bits, F.lit(k)).bitwiseXOR(F.get(bits2, F.lit(k)))) for k in range(MAP_WORDS)])
    return differ * (100 + percent) <= (n + n2) * (100 - percent)


def _bounded(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their bitmaps allow. maps: doc_id, n, bits."""
    x, y = (maps.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").where(_could_link(*map(F.col, ("n_a", "bits_a", "n_b", "bits_b")), percent)).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, int]:
    """The pairs (a, b) whose sets are similar enough, compared in full, and their number. Many pairs may share an a."""
    pairs = written(pairs.where("a <> b").distinct(), "pairs")
    asked = pairs.count()
    if not asked:
        return pairs, 0

    def run(batches):
        hasher = WordHasher()
        known: dict[int, np.ndarray] = {}
        for batch in sliced(batches):
            keep = []
            right = shingle_sets(batch.column(3).to_pylist(), hasher, width)
            for k, (a, x, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), right, strict=True)):
                if a not in known:
                    if len(known) >= 32:
                        known.clear()
                    known[a] = shingle_set(x, hasher, width)
                s = known[a]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    sent = F.broadcast if asked <= MOST_SENT else lambda df: df  # ids alone; texts meet in a shuffle, whatever their size
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("k"))
    x = docs.join(sent(hubs), docs["doc_id"] == hubs["a"]).select("a", F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"))
    dealt = written(pairs.join(sent(hubs), "a").select("a", "b", F.pmod(F.hash("b"), "k").alias("salt")), "pairs")
    y = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).join(sent(dealt), "b")
    found = written(y.join(x, ["a", "salt"]).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "verified")
    return found, found.count()


def most_partner(n, place, percent: int):
    """The largest set that a set of n can link to when the first shingle that they share has `place` others before it: what follows is all
    that they can share, and must be the share percent / (100 + percent) of both sizes."""
    return (n - place) * (100 + percent) // percent - n


def _fits(n, partner, bits, n2, partner2, bits2, percent: int):
    return (F.least(n, n2) * 100 >= F.greatest(n, n2) * percent) & (n <= partner2) & (n2 <= partner) & _could_link(n, bits, n2, bits2, percent)


def similar_links(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs (doc_id, text; ids differ): members (doc_id, n, rep), links (a, b) between representatives of equal sets, labels (node, label).

    The links connect every two documents that a chain of similar pairs connects; inside large buckets not every pair is listed.
    """
    sets = written(_sets(docs, width, percent), "sets")
    known = sets.where("n > 0 and doc_id is not null")
    reps = written(known.groupBy("n", "sig").agg(F.min("doc_id").alias("rep")), "reps")
    members = sets.select("doc_id", "n", "sig").join(reps, ["n", "sig"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("rep"))).otherwise(F.col("doc_id")).alias("rep"))
    equal = written(members.where("n > 0 and doc_id <> rep").select("doc_id"), "equal")
    few = equal.limit(MOST_SENT + 1).count() <= MOST_SENT
    own = known.join(F.broadcast(equal) if few else equal, "doc_id", "left_anti").select("doc_id", "n", F.col("low").alias("tokens"), F.lit(False).alias("whole"))
    maps = known.select("doc_id", "n", "bits")
    volume = own.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()[0]
    parts = max(64, -(-volume * 3 // 2 // PART_BYTES))

    def head_of(counted: DataFrame) -> np.ndarray:
        rows = counted.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "token").limit(HEAD).select("token").toPandas()  # HEAD rows at most
        return np.sort(rows["token"].to_numpy(np.int64))

    head = head_of(_hot(own, "tokens", parts))
    if len(head):  # sets of mostly hot shingles need all their shingles, and those counted
        short = written(_lacking(own, head, parts, percent), "short")

        def whole(batches):
            hasher = WordHasher()
            for batch in sliced(batches):
                found = shingle_sets(batch.column(1).to_pylist(), hasher, width)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["doc_id", "n", "tokens"])

        def in_full(ids: DataFrame) -> DataFrame:
            return written(_texts_of(docs, ids).mapInArrow(whole, "doc_id long, n long, tokens binary").withColumn("whole", F.lit(True)), "full")

        full = in_full(short)
        head = np.union1d(head, head_of(_hot(full, "tokens", parts)))
        lacking = written(_lacking(own, head, parts, percent), "short")
        more = in_full(written(lacking.join(short, "doc_id", "left_anti"), "short"))
        own = own.unionByName(full.unionByName(more).join(lacking, "doc_id", "left_semi"))
    met = written(_meet(own, head, parts, percent), "met")
    groups = written(_groups(own, head, parts, percent), "groups")
    hot_entries = _hot_entries(own, head, parts, percent)
    sized = groups.groupBy("grp").agg(F.count("*").alias("m"), F.min("doc_id").alias("one"))
    alone = sized.select("grp", F.when(F.col("m") == 1, F.col("one")).alias("one"))
    pairs = met.where("kind = 0").select("a", "b").distinct()
    pairs = written(pairs.join(alone.select(F.col("grp").alias("a"), F.col("one").alias("x")), "a").join(alone.select(F.col("grp").alias("b"), F.col("one").alias("y")), "b"), "group-pairs")
    direct = pairs.where("x is not null and y is not null").select(F.col("x").alias("a"), F.col("y").alias("b"))
    apart = pairs.where("x is null or y is null")
    crossed = apart.select(F.lit(CROSSED).alias("kind"), F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("grp"), F.lit(0).cast("bigint").alias("place"))
    crowded = met.where("kind = 1").select("a", "b", "place").unionByName(hot_entries).distinct().select(F.lit(TOKEN).alias("kind"), F.col("a").alias("key"), F.col("b").alias("grp"), "place")
    several = sized.where("m > 1").select(F.lit(GROUP).alias("kind"), F.col("grp").alias("key"), "grp", F.lit(0).cast("bigint").alias("place"))
    step = float(np.log(100 / percent))
    scale = F.floor(F.log("n") / step + F.lit(1e-9)).cast("int")
    # sizes that can link lie in one class or in two that touch: each member stands in its own class and in the next
    in_buckets = crossed.unionByName(crowded).unionByName(several).join(groups, "grp").select("kind", "key", "doc_id", "n", "place", F.explode(F.array(scale, scale + 1)).alias("size_class")).distinct()
    partner = (F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent) - F.col("n")).alias("partner")
    members_of = in_buckets.select(F.xxhash64("kind", "key", "size_class").alias("bucket"), "doc_id", "n", partner)
    buckets = written(members_of.join(maps.select("doc_id", "bits"), "doc_id").select(*PART), "buckets")

    def check(found: DataFrame) -> tuple[DataFrame, int]:
        return _verified(found, docs, width, percent)

    links, _ = check(_bounded(direct, maps, percent))
    labels = components(links)
    buckets, more, labels = _by_hubs(buckets, labels, check, percent, HUB_ROUNDS)
    links = reduce(DataFrame.unionByName, more, links)
    if buckets is not None:
        new, n_new = check(_in_blocks(buckets, percent))
        if n_new:
            links, labels = links.unionByName(new), contracted(labels, new)
    return members, links, labels


#: Columns of a bucket's member: its size, the largest size of a set that it can link to in that bucket, and its bitmap.
PART = ("bucket", "doc_id", "n", "partner", "bits")


def _labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    return buckets.join(labels, buckets["doc_id"] == labels["node"], "left").select(*buckets.columns, F.coalesce("label", "doc_id").alias("label"))


def _by_hubs(buckets: DataFrame, labels: DataFrame, check, percent: int, rounds: int) -> tuple[DataFrame | None, list[DataFrame], DataFrame]:
    """The buckets (with PART, label) that still hold several components after rounds of hubs (None: no such), the links found, and labels.

    Rounds end early when none of their comparisons links.
    """
    links: list[DataFrame] = []
    columns = buckets.columns
    for turn in range(rounds + 1):
        buckets = written(_labelled(buckets.select(*columns), labels), "buckets")
        narrow = F.col("partner") < F.col("n")
        own = buckets.groupBy("bucket", "label").agg(F.count("*").alias("m"), F.min(F.struct(narrow.alias("narrow"), F.xxhash64("doc_id", F.lit(turn)).alias("h"), *PART[1:])).alias("one"))
        top = F.max(F.struct(~F.col("one.narrow"), "m", F.xxhash64("label", F.lit(turn)).alias("h"), "label", "one")).alias("top")
        tops = own.groupBy("bucket").agg(F.count("*").alias("k"), top).where("k > 1 and not top.one.narrow")
        tops = written(tops.select("bucket", F.col("top.label").alias("hub_label"), *[F.col(f"top.one.{c}").alias(f"hub_{c}") for c in PART[1:]]), "hubs")
        n = tops.count()
        if not n:
            return None, links, labels
        met = buckets.join(F.broadcast(tops) if n <= MOST_SENT // 8 else tops, "bucket")  # only those that hold several components
        buckets = met.select(*columns, "label")
        if turn == rounds:
            break
        near = met.where((F.col("label") != F.col("hub_label")) & _fits(*map(F.col, ("n", "partner", "bits", "hub_n", "hub_partner", "hub_bits")), percent))
        shared = near.groupBy("doc_id", "hub_doc_id").agg(F.count("*").alias("m"))
        best = shared.groupBy("doc_id").agg(F.max(F.struct("m", F.xxhash64("hub_doc_id", F.lit(turn)).alias("h"), "hub_doc_id")).alias("top"))
        new, n_new = check(best.select(F.col("top.hub_doc_id").alias("a"), F.col("doc_id").alias("b")))
        if n_new:
            links.append(new)
            labels = contracted(labels, new)
        else:
            rounds = min(rounds, turn + 1)
    return buckets, links, labels


def _in_blocks(at: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that fit, in each bucket (PART, label): the members with room for their own size against all, a block of
    rows against a block."""
    at = written(at, "unsettled")
    roomy = F.col("partner") >= F.col("n")
    count = lambda c: F.ceil(F.count_if(c) / BLOCK_ROWS).cast("int")
    sized = at.groupBy("bucket").agg(count(roomy).alias("k"), count(F.lit(True)).alias("k2")).where("k > 0")
    rows = at.join(sized, "bucket").withColumns({"i": F.pmod(F.hash("doc_id"), "k"), "j": F.pmod(F.hash("doc_id"), "k2")})
    left = rows.where(roomy).select(*PART, "label", "i", F.explode(F.sequence(F.lit(0), F.col("k2") - 1)).alias("j"))
    right = rows.select("bucket", *[F.col(c).alias(f"{c}2") for c in (*PART[1:], "label")], F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), "j")
    fits = (F.col("n") <= F.col("n2")) & _fits(*map(F.col, ("n", "partner", "bits", "n2", "partner2", "bits2")), percent)
    met = left.join(right, ["bucket", "i", "j"]).where((F.col("label") != F.col("label2")) & fits)
    return met.select(F.least("doc_id", "doc_id2").alias("a"), F.greatest("doc_id", "doc_id2").alias("b"))


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    one = _one_text_each(docs)
    members, _, labels = similar_links(one, width, percent)
    found = members.join(labels, members["rep"] == labels["node"], "left")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))
    if one is docs:
        return found
    return docs.where("doc_id is not null").select("doc_id").join(found, "doc_id").unionByName(found.where("doc_id is null"))


def op1_prefix_join(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[u.i:u.i + 3], ' ') AS shingle FROM w, unnest(range(1, greatest(1, len(words) - 3) + 1)) AS u(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
side AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, side.b FROM reach r JOIN side ON r.other = side.a)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id FROM reach r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""
