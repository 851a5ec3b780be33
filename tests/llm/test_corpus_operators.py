"""Prefix join, sharding, HTML extraction, license scans, line dedup and private data against brute force and on odd rows."""

import hashlib
import importlib
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import html_text, licences, line_dedup, prefix_join, private_data, sharding
from tallyframe.llm.components import components

DOC = "doc_id long, text string"


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def groups_by_force(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def corpus(seed, n=60):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [draw.choice(words) for _ in range(60)]
    rows, base = [], []
    for i in range(n):
        kind = draw.randrange(5)
        if kind == 0 and base:
            text = list(draw.choice(base))
            for _ in range(draw.randrange(1, 5)):
                text[draw.randrange(len(text))] = draw.choice(words)
        elif kind == 1:
            text = [draw.choice(words) for _ in range(draw.randrange(5, 30))] + passage
        else:
            text = [draw.choice(words) for _ in range(draw.randrange(1, 150))]
        base.append(text)
        rows.append((i * 7 % 1000, " ".join(w.upper() if draw.random() < 0.05 else w for w in text)))
    return rows + [(2001, None), (2002, ""), (2003, " \n"), (2004, "w1"), (2005, "W1"), (2006, "w1 w2 w3")]


@pytest.mark.parametrize("width, percent, hot, few, hubs", [(4, 85, 32, 8, 6), (5, 80, 2, 2, 0), (4, 85, 1, 1, 1)])
def test_groups_equal_brute_force(spark, monkeypatch, width, percent, hot, few, hubs):
    for name, value in (("HOT", hot), ("FEW", few), ("HUB_ROUNDS", hubs)):
        monkeypatch.setattr(prefix_join, name, value)
    rows = corpus(hot)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in prefix_join.near_groups(spark.createDataFrame(rows, DOC).withColumn("n", F.lit(1)), width, percent).collect()}
    assert got == groups_by_force(rows, width, percent)


@pytest.mark.parametrize("hubs", [0, 6])
def test_large_near_group_in_blocks(spark, monkeypatch, hubs):
    for name, value in (("HOT", 3), ("FEW", 3), ("HUB_ROUNDS", hubs), ("BLOCK_ROWS", 4)):
        monkeypatch.setattr(prefix_join, name, value)
    draw = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(40):  # a chain of drifting copies: far ends are not similar
        base[draw.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(base)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in prefix_join.near_groups(spark.createDataFrame(rows, DOC), 4, 85).collect()}
    assert got == groups_by_force(rows, 4, 85)


def test_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long), (1, long), (2, long + " more"), (None, long), (None, long), (4, None)]
    got = Counter((r["doc_id"], r["component_id"]) for r in prefix_join.near_groups(spark.createDataFrame(rows, DOC)).collect())
    assert got == {(1, 1): 2, (2, 1): 1, (None, None): 2, (4, 4): 1}
    assert prefix_join.near_groups(spark.createDataFrame([], DOC)).count() == 0


@pytest.mark.parametrize("most_sent", [0, 1 << 18])
def test_components(spark, monkeypatch, most_sent):
    monkeypatch.setattr(importlib.import_module("tallyframe.llm.components"), "MOST_SENT", most_sent)
    links = [(5, 4), (4, 3), (3, 9), (20, 21), (7, 8), (8, 7), (30, 31), (31, 32), (32, 33), (33, 34), (34, 1)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20, 7: 7, 8: 7, 30: 1, 31: 1, 32: 1, 33: 1, 34: 1, 1: 1}


def test_shards(spark, tmp_path):
    draw = random.Random(1)
    rows = [(i, "x" * draw.randrange(200)) for i in range(500)] + [(None, None), (None, "é"), (7, "x"), (7, "x")]
    docs = spark.createDataFrame(rows, DOC).withColumns({"shard": F.lit("clash"), "size": F.lit("clash")})
    placed = sharding.two_pass_shuffle(docs, 24, bucket_bytes=2000)
    got = placed.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(counts[shard]))
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 for r in got)
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["slot"], r["shard"]))] != sorted(r["doc_id"] or -1 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, sharding.two_pass_shuffle(docs, 24, bucket_bytes=2000).collect()))
    sharding.write_shards(placed, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == len(rows)
    assert sharding.two_pass_shuffle(docs.limit(0), 24).count() == 0


def test_shard_query(spark, tmp_path):
    spark.createDataFrame([(1, "abc"), (2, None), (3, "é")], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in sharding.op2_sharding(spark, str(tmp_path)).collect()}
    assert {i: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for i, r in got.items()} == {1: (11, zlib.crc32(b"abc"), "rows", None), 2: (8, 0, "rows", None), 3: (10, zlib.crc32("é".encode()), "rows", None)}


def dedup_by_force(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = Counter()
    for _, t in rows:
        held.update({key(x) for x in (t or "").split("\n")} - {""})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_lines_equal_brute_force(spark):
    draw = random.Random(4)
    pool = ["Hello World", " hello world\t", "ÉTÉ", "été", "", "  ", "a", "A", "unique"]
    rows = [(i, "\n".join(draw.choice(pool) for _ in range(draw.randrange(8)))) for i in range(60)] + [(None, None), (None, "a\nb"), (3, "a"), (3, "a"), (99, "a\n" * 2000)]
    docs = spark.createDataFrame(rows, DOC).withColumn("kept", F.lit(5))
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == dedup_by_force(rows, 10)
    runs = line_dedup.LineRuns(spark, fanout=2)
    for part in range(5):
        runs.add(spark.createDataFrame(rows[part::5], DOC))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.drop_lines(docs, runs.repeated()).collect()) == got
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_settled_keys_are_not_added_again(spark):
    batches = [[(i, f"shared\nrare\nown {i}" if i % 5 == 0 else "shared") for i in range(k, k + 12)] for k in (100, 0, 200, 300)]
    docs = spark.createDataFrame([r for b in batches for r in b], DOC)
    runs = line_dedup.LineRuns(spark, fanout=8)
    for b in batches:
        runs.add(spark.createDataFrame(b, DOC), doc_id="doc_id")
    sizes = [{r["first"]: r["n"] for r in run.where("n > 9").collect()} for run in runs.levels[0]]
    assert sizes == [{100: 12}, {0: 12}, {}, {}]  # an earlier first document comes in, later ones don't
    got = {r["doc_id"]: r["kept"] for r in line_dedup.drop_lines(docs, runs.repeated(), keep_first="doc_id").collect()}
    alone = {r["doc_id"]: r["kept"] for r in line_dedup.dedup_lines(docs, keep_first="doc_id").collect()}
    assert got == alone and got[0].startswith("shared") and not got[100].startswith("shared")


def test_first_document_keeps_its_lines(spark):
    rows = [(i, f"shared line\nown {i}") for i in range(12, 0, -1)] + [(None, "shared line"), (50, "shared line")]
    got = {r["doc_id"]: r["kept"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOC), keep_first="doc_id").collect()}
    assert got == {1: "shared line\nown 1", **{i: f"own {i}" for i in range(2, 13)}, None: "", 50: ""}


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_by_force(text):
    return [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m.group())]


def test_base_spans_equal_patterns(spark):
    draw = random.Random(6)
    pieces = ["a@b.c", "x.y@z-1.co.uk", "@", ".", "a@b", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "000255.1.1.1", "4111 1111 1111 1111", "4111111111111112", "-", " ", "+1 (706) 555-3138", "+12", "+1 2 3 4 5 6 7 8", "é", "漢", "word", "99", "_d@e.f", "%"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(1, 12))) for _ in range(400)] + [None, "", "9" * 20000, "a" * 20000 + "@", "1 " * 5000, "4111 1111 1111 1111, 77 " * 3000, "a@b.c_d@e.f", "+1" + " " * 9000]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in private_data.find_private(spark.createDataFrame(rows, DOC).withColumn("spans", F.lit(0)), support=10**6).collect()}
    for i, t in rows:
        assert got[i] == base_by_force(t), t


def test_rows_of_many_spans_and_lines_take_linear_time(spark):
    """A row of 100,000 addresses and rows of 50,000 repeated lines, both whole."""
    address = "ab@cd.ef, "
    found = spark.createDataFrame([(1, address * 100_000)], DOC).select(F.explode(private_data._spans(F.col("text"), "email", F.lit(private_data.EMAIL))).alias("s"))
    assert tuple(found.agg(F.count("*"), F.max("s.end"), F.sum("s.start"), F.countDistinct("s.value")).first()) == (100_000, 999_998, 10 * sum(range(100_000)), 1)
    rows = [(i, "\n".join(f"line {k}" for k in range(100_000 if i == 0 else 50_000))) for i in range(3)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOC), min_docs=2).select("doc_id", "n_lines", "n_dropped", F.crc32(F.col("kept").cast("binary")).alias("kept")).collect()}
    assert [(got[i]["n_lines"], got[i]["n_dropped"]) for i in range(3)] == [(100_000, 50_000), (50_000, 50_000), (50_000, 50_000)]
    assert got[0]["kept"] == zlib.crc32("\n".join(f"line {k}" for k in range(50_000, 100_000)).encode())


def test_disclosing_terms(spark):
    rows = [(i, f"Please write to Zebulon at zeb@mail.example about item {i}") for i in range(4)] + [(10 + i, f"Please write to us about thing number {i}") for i in range(40)] + [(None, None), (90, "Zebulonia is a place")]
    docs = spark.createDataFrame(rows, DOC)
    assert {(r["entity"], r["term"]) for r in private_data.disclosing_terms(docs).collect()} == {("email:zeb@mail.example", "Zebulon"), ("email:zeb@mail.example", "item")}
    got = {r["doc_id"]: r for r in private_data.find_private(docs).withColumn("clean", private_data.sanitised(F.col("text"), F.col("spans"))).collect()}
    assert got[0]["clean"] == "Please write to [TERM] at [EMAIL] about [TERM] 0" and got[90]["spans"] == [] and got[12]["spans"] == []
    assert private_data.find_private(docs.limit(0)).count() == 0


def test_disclosing_terms_far_from_spans(spark):
    far = " ".join(["and so on"] * 40)
    rows = [(i, f"Zebulon said {far} zeb@mail.example") for i in range(4)] + [(10 + i, f"Quux said {far} that nobody called") for i in range(40)]
    docs = spark.createDataFrame(rows, DOC)
    assert {tuple(r) for r in private_data.disclosing_terms(docs).collect()} == {("email:zeb@mail.example", "Zebulon", 4)}
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in private_data.find_private(docs).collect()}
    assert got[0] == ["email", "term"] and got[10] == []


def test_private_query(spark, tmp_path):
    spark.createDataFrame([(1, "é a@b.c 1.2.3.4"), (2, None)], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in private_data.op10_private_data(spark, str(tmp_path)).collect()}
    assert got[1]["spans"] == "email:2:7,ip:8:15" and got[1]["base_sha256"] == hashlib.sha256(b"email:2:7,ip:8:15").hexdigest()
    assert (got[1]["n_email"], got[1]["n_ip"], got[2]["n_email"], got[2]["spans"]) == (1, 1, 0, "")


def test_licences(spark):
    filler = " ".join(f"word{i}" for i in range(40))
    mit = licences.TEMPLATES["MIT"][3]
    cut = " ".join(mit.split()[:-3])
    rows = [(1, f"{filler} Released under the MIT License. {filler}"), (2, f"{filler}\n{mit.upper()}\n{filler}"), (3, f"{cut} {filler}"), (4, f"{filler} license software permission"), (5, None), (6, ""), (None, "Licensed under CC BY-NC 4.0."), (7, "Licensed under CC BY-NC 4.0."), (7, "Licensed under CC BY-NC 4.0.")]
    got = Counter((r["doc_id"], r["license"]) for r in licences.scan(spark.createDataFrame(rows, DOC).withColumn("license", F.lit("clash"))).select("doc_id", "text", "license").distinct().collect())
    assert got == {(1, "MIT"): 1, (2, "MIT"): 1, (3, "MIT"): 1, (None, "CC-BY-NC-4.0"): 1, (7, "CC-BY-NC-4.0"): 1}
    assert licences.scan(spark.createDataFrame([], DOC)).count() == 0
    with pytest.raises(ValueError):
        licences.load_templates(spark, {"X": ["nothing of the sort stands in this one at all"]})


def test_versions_are_told_apart(spark):
    two, three = licences.TEMPLATES["GPL-2.0"][0], licences.TEMPLATES["GPL-3.0"][1]
    filler = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"{filler} {two} {filler}"), (2, f"{filler} {three} {filler}"), (3, f"{two} {filler} {three}"), (4, three.replace("redistribute", "share"))]
    got = {tuple(r) for r in licences.scan(spark.createDataFrame(rows, DOC)).select("doc_id", "license").distinct().collect()}
    assert got == {(1, "GPL-2.0"), (2, "GPL-3.0"), (3, "GPL-2.0"), (3, "GPL-3.0"), (4, "GPL-3.0")}


def containments_by_force(text, share=0.8):
    """Licenses of which a template keeps that share of its shingles in some stretch of twice its width, at every offset."""
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    found = set()
    for name, templates in licences.TEMPLATES.items():
        for template in templates:
            own = re.sub("[^a-z0-9]+", " ", template.lower()).split()
            n = len(own)
            mine = {tuple(own[i : i + 5]) for i in range(n - 4)}
            each = [tuple(w[i : i + 5]) for i in range(max(0, len(w) - 4))]
            if any(len(mine & set(each[i : i + n])) >= share * len(mine) for i in range(max(1, len(each)))):
                found.add(name)
    return found


def test_every_template_is_found_at_every_offset_and_tells_its_own_license(spark):
    rng = random.Random(4)
    rows, whole = [], {}
    for name, templates in licences.TEMPLATES.items():
        for template in templates:
            for before in (0, 1, 2, 3, 5, 7, 9, 14, 23):
                rows.append((len(rows), " ".join(rng.choice("alpha beta gamma delta") for _ in range(before)) + f"\n{template}\n" + "omega " * rng.randrange(9)))
                whole[rows[-1][0]] = name
    got = {}
    for r in licences.scan(spark.createDataFrame(rows, DOC)).select("doc_id", "license").distinct().collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    for i, text in rows:
        assert got.get(i) == {whole[i]}, (text, got.get(i))
        assert whole[i] in containments_by_force(text)


def test_notices_of_neighbours_and_denials(spark):
    gpl3 = licences.TEMPLATES["GPL-3.0"][1]
    rows = [
        (1, gpl3.replace("GNU General", "GNU Affero General")), (2, gpl3.replace("GNU General", "GNU Lesser General").replace("program", "library")), (3, "This package is not licensed under the MIT License."),
        (4, "It isn't licensed under the Apache License, Version 2.0."), (5, "license words " * 30_000 + "\nReleased under the MIT License."), (6, licences.TEMPLATES["BSD"][0] + " 1. x " + licences.TEMPLATES["BSD-3-Clause"][0]),
    ]
    got = {tuple(r) for r in licences.scan(spark.createDataFrame(rows, DOC)).select("doc_id", "license").distinct().collect()}
    assert got == {(1, "AGPL-3.0"), (2, "LGPL-3.0"), (5, "MIT"), (6, "BSD"), (6, "BSD-3-Clause")}


def test_licence_between_windows(spark):
    words = re.sub("[^a-z0-9]+", " ", licences.TEMPLATES["MIT"][3].lower()).split()
    words[24:32] = [f"x1{j}" for j in range(24, 32)]  # 0.81 of the shingles are left
    rows = [(i, " ".join([f"p{k}" for k in range(i)] + words + [f"q{k}" for k in range(67)])) for i in range(17)]
    got = licences.scan(spark.createDataFrame(rows, DOC)).select("doc_id", "license").distinct().collect()
    assert Counter(map(tuple, got)) == Counter((i, "MIT") for i in range(17))


PAGE = '<html><head><title>T</title></head><body><nav><a href="/x">Menu</a></nav><div class="ad">Buy now</div><article><h1>Head &amp; more</h1><p><b>One<br>two<p>three   four</p><div class="comments"><p>nice</p></div><form>Send</form><script>if (a<b) "</p>"</script></article><footer>End</footer>'


def test_article_text(spark):
    rows = [(1, "http://a.example/1", PAGE), (2, "http://a.example/2", PAGE), (3, None, None), (4, "x", ""), (5, "http://b.example", "<p>only &lt;this&gt;<p>and that")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got == {1: "Head & more One two three four", 2: "Head & more One two three four", 3: "", 4: "", 5: "only <this> and that"}


def test_repeated_runs_outside_articles_go(spark):
    draw = random.Random(8)
    prose = lambda: " ".join(f"w{draw.randrange(10**6)}" for _ in range(60))
    bar = " ".join(f"bar{i}" for i in range(40))
    shared = prose()
    rows, want = [], {}
    for i in range(12):
        text = prose()
        rows.append((i, "http://host.example/p", f"<div>{bar}</div><div>short bar</div><div>{text}</div>"))
        want[i] = text
    rows += [(100, "http://other.example/", f"<div>{bar}</div>"), (101, "http://third.example/a", f"<article><p>{shared}</article>"), (102, "http://third.example/b", f"<article><p>{shared}</article>")]
    want |= {100: bar, 101: shared, 102: shared}
    assert {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == want
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def boilerplate_by_force(pages):
    """(page, host, tokens of its blocks): tokens left when all runs of RUN tokens, and whole shorter blocks, that two pages of a host share are taken away."""
    grams = lambda b: {tuple(b[i : i + html_text.RUN]) for i in range(max(1, len(b) - html_text.RUN + 1))}
    out = {}
    for page, host, blocks in pages:
        left = []
        for b in blocks:
            free = [True] * len(b)
            for i in range(max(1, len(b) - html_text.RUN + 1)):
                g = tuple(b[i : i + html_text.RUN])
                if any(p != page and h == host and any(g in grams(x) for x in bs) for p, h, bs in pages):
                    free[i : i + html_text.RUN] = [False] * len(free[i : i + html_text.RUN])
            left += [w for w, f in zip(b, free, strict=True) if f]
        out[page] = " ".join(left)
    return out


def test_boilerplate_of_hosts_equals_brute_force(spark):
    rng = random.Random(11)
    for most in (5, 40):
        vocabulary = [f"w{k}" for k in range(most)]
        shared = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 9, 15, 24, 40]))] for _ in range(6)]
        pages = []
        for p in range(24):
            blocks = []
            for _ in range(5):
                own = [f"u{p}x{rng.randrange(1000)}" if rng.random() < 0.7 else rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))]
                blocks.append(own[: rng.randrange(len(own) + 1)] + rng.choice(shared) + own if rng.random() < 0.5 else own)
            pages.append((p, f"h{p % 3}", blocks))
        rows = [(p, f"https://{h}/{p}", "".join(f"<p>{' '.join(b)}</p>" for b in blocks)) for p, h, blocks in pages]
        got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == boilerplate_by_force(pages)


def test_classes_hidden_parts_and_malformed_pages(spark):
    article = "<article>{}<p>the body</p></article>"
    kept = ["<div class='related-work'>one</div>", "<div class='search-results-table'>two</div>", "<div id='social-history'>three</div>"]
    gone = ["<div class='share-buttons'>a</div>", "<div class='ad'>b</div>", "<p hidden>c</p>", "<div style='color:red; display: none'>d</div>", "<div class='site-footer'>e</div>"]
    assert [t for t, a, c in html_text.blocks_of(article.format("".join(kept + gone))) if a and not c] == ["one", "two", "three", "the body"]
    begun = time.time()
    for odd in ("<a " * 350_000, '<a ">"' * 150_000, "<a \'>" * 250_000, "<div>" * 50_000 + "</span></p>" * 50_000, "<div><b>" * 50_000 + "</i>" * 50_000, "<!--" * 250_000, "<" * 500_000):
        html_text.blocks_of(odd)
    assert time.time() - begun < 60
    assert html_text.blocks_of("<a <b x")[0][0] == "<a <b x" and html_text.blocks_of("<p>x<script>y")[0][0] == "x"
    rows = [(1, "u", "<p>same</p>"), (1, "u", "<p>same</p>"), (2, None, None), (3, "", "")]
    assert sorted((r["page_id"], r["text"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()) == [(1, "same"), (1, "same"), (2, ""), (3, "")]


def test_suffixes_are_one_sorted_array(spark):
    words = [[f"w{(i * j) % 7}" for j in range(1, 12 + i % 3)] for i in range(12)]
    rows = [(i, f"http://h{i % 2}/{i}", "<div>" + " ".join(w) + "</div><div>share this</div>") for i, w in enumerate(words)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = html_text.suffix_array(html_text._suffix_rows(pages))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(host" in plan and "Sort [host" in plan
    parts = found.rdd.map(lambda r: (r.host, bytes(r.suffix))).glom().collect()
    keys = [k for part in parts for k in part]
    assert keys == sorted(keys)
    want = {(i % 2, tuple(w[k : k + html_text.RUN])) for i, w in enumerate(words) for k in range(len(w) - html_text.RUN + 1)} | {(h, ("share", "this")) for h in (0, 1)}
    assert len(set(keys)) == len(want) and len({h for h, _ in keys}) == 2
    closed = spark.createDataFrame([(i, "http://a/", f"<nav>one menu of nine words on every single page</nav>{i}") for i in range(500)], "page_id long, url string, html string").coalesce(1)
    assert html_text._suffix_rows(closed).where("not open and low <> high").count() == 2  # once, not once a page
