"""Personal data: base patterns and information-theoretic sanitisation (built-in functions only).

Base spans come from four patterns (email, ip, card, phone). Every term that stands in a document outside the spans of a kind is a candidate
to disclose the values of these spans, the protected entities. Over the whole corpus, with document frequencies n_e, n_t and n_et, the term discloses the entity when its pointwise
mutual information reaches the share `disclosure` of the entity's information content, log2(N n_et / (n_e n_t)) >= disclosure log2(N / n_e),
and when at least `support` documents hold both. Such terms become spans of kind `term` in the documents that hold the entity.
`sanitised` writes each span as its kind in brackets.

Counts cover all documents. Rows meet their terms by a hash of the text, so null and repeated ids do no harm.

Defined results: null and empty text have no spans; repeated rows count as documents of their own; an empty table gives no rows; columns
named like the outputs are replaced. Long runs of digits or letters are scanned once: a match can only start where a run starts or where
the last match ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of 16 to 19 digits, as no other can be a card: a run's first digit has no digit (and separator) before it.
CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"
#: Tables up to this number of rows are broadcast; beyond it joins shuffle.
MOST_SENT = 1 << 18
#: Spans of a text that are gathered at a time.
FOLDED = 256


def _no_spans() -> Column:
    return F.array().cast(SPANS)


def _terms(piece: Column) -> Column:
    return F.regexp_extract_all(piece, F.lit(r"\p{L}{4,}"), F.lit(0))


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, kind: str, pattern: Column) -> Column:
    """Spans of all matches: what lies between them (split) and the matches themselves give their places."""
    def placed(found: Column, between: Column) -> Column:
        """Places by a running sum; spans are gathered in blocks of FOLDED, and these side by side, so no long array grows span by span."""

        def step(acc: Column, i: Column) -> Column:
            start, value = acc["at"] + F.char_length(F.get(between, i)), F.get(found, i)
            return F.struct((start + F.char_length(value)).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), value.alias("value")))).alias("out"))

        def block(acc: Column, k: Column) -> Column:
            own = F.sequence(k * FOLDED, F.least((k + 1) * FOLDED, F.size(found)) - 1)
            first = F.struct(acc["at"].alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out"))
            return F.aggregate(own, first, step, lambda b: F.struct(b["at"].alias("at"), F.concat(acc["blocks"], F.array(b["out"])).alias("blocks")))

        def finish(acc: Column) -> Column:
            return F.transform(F.flatten(acc["blocks"]), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].cast("long").alias("start"), (s["start"] + F.char_length(s["value"])).cast("long").alias("end"), s["value"].alias("value")))

        none = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<array<struct<start:int,value:string>>>").alias("blocks"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / FOLDED).cast("int"))
        return F.aggregate(blocks, none, block, finish)

    def of_found(found: Column) -> Column:
        return F.when(F.size(found) > 0, _bound(F.split(text, pattern, -1), lambda between: placed(found, between))).otherwise(_no_spans())

    return _bound(F.regexp_extract_all(text, pattern, F.lit(0)), of_found)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ip_holds(value: Column) -> Column:
    def small(part: Column) -> Column:
        p = F.ltrim(part, F.lit("0"))
        return F.when(F.length(p) > 3, F.lit(False)).otherwise(F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), small)


def base_spans(text: Column) -> Column:
    """All base spans by kind, then start."""
    text = F.coalesce(text, F.lit(""))
    email = F.when(F.instr(text, "@") > 0, _spans(text, "email", F.lit(EMAIL))).otherwise(_no_spans())
    ip = F.filter(_spans(text, "ip", F.lit(IP)), lambda s: _ip_holds(s["value"]))
    card = F.filter(_spans(text, "card", F.lit(CARD)), lambda s: F.length(_digits(s["value"])).between(16, 19) & F.call_function("luhn_check", _digits(s["value"])))
    phone = F.when(F.instr(text, "+") > 0, F.filter(_spans(text, "phone", F.lit(PHONE)), lambda s: F.length(_digits(s["value"])).between(8, 15))).otherwise(_no_spans())
    return F.concat(email, ip, card, phone)


def _holders(docs: DataFrame, text: str) -> DataFrame:
    """(_h, _g, s, a, o): hashes of the text, the base spans, all terms and those outside e-mail addresses, of documents that have any spans."""
    keys = F.xxhash64(text).alias("_h"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("_g")
    held = docs.select(*keys, F.col(text).alias("_t"), base_spans(F.col(text)).alias("s")).where(F.size("s") > 0)
    outside = F.regexp_replace("_t", EMAIL, " ")
    return written(held.select("_h", "_g", "s", F.array_distinct(_terms(F.col("_t"))).alias("a"), F.array_distinct(_terms(outside)).alias("o")), "holders")


def _entities(kinds) -> Column:
    """Distinct `kind:value` of a document's spans of which the condition holds."""
    return F.array_distinct(F.transform(F.filter("s", kinds), lambda s: F.concat(s["kind"], F.lit(":"), s["value"])))


def _pairs(held: DataFrame) -> DataFrame:
    """(_h, _g, entity, term), for each row of held its distinct pairs; only e-mail addresses hold letters, so other kinds meet all terms."""
    mail = held.select("_h", "_g", F.explode(_entities(lambda s: s["kind"] == "email")).alias("entity"), "o").select("_h", "_g", "entity", F.explode("o").alias("term"))
    others = held.select("_h", "_g", F.explode(_entities(lambda s: s["kind"] != "email")).alias("entity"), "a").select("_h", "_g", "entity", F.explode("a").alias("term"))
    return mail.unionAll(others)


def _sent_or_shuffled(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.limit(MOST_SENT + 1).count() <= MOST_SENT else small


def disclosing_terms(docs: DataFrame, text: str = "text", disclosure: float = 0.95, support: int = 3, holders: DataFrame | None = None) -> DataFrame:
    """(entity, term, n_et) of terms that disclose an entity.

    A term stands in at least as many documents as hold both it and any span. Pairs that even this count keeps under the threshold go
    first, so that only the rest is counted over all words.
    """
    held = _holders(docs, text) if holders is None else holders
    n_e = held.select(F.explode(_entities(lambda s: F.lit(True))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = _pairs(held).groupBy("entity", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support)
    n_holders = held.select(F.explode("a").alias("term")).groupBy("term").agg(F.count("*").alias("n_holders"))
    n = docs.agg(F.count("*").alias("n"))  # one row

    def discloses(n_t: str) -> Column:
        content = F.log2(F.col("n") / F.col("n_e"))
        return (content > 0) & (F.log2(F.col("n") * F.col("n_et") / (F.col("n_e") * F.col(n_t))) >= disclosure * content)

    open_pairs = written(pairs.join(n_holders, "term").join(n_e, "entity").join(F.broadcast(n)).where(discloses("n_holders")).drop("n_holders"), "pairs")
    wanted = _sent_or_shuffled(written(open_pairs.select("term").distinct(), "terms"))
    words = docs.select(F.explode(F.array_distinct(_terms(F.coalesce(text, F.lit(""))))).alias("term"))
    n_t = words.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    return open_pairs.join(n_t, "term").where(discloses("n_t")).select("entity", "term", "n_et")


def find_private(docs: DataFrame, text: str = "text", disclosure: float = 0.95, support: int = 3) -> DataFrame:
    """docs with spans, an array of (kind, start, end, value), by kind as in KINDS, then start."""
    docs = docs.drop("spans")
    holders = _holders(docs, text)
    found = _pairs(holders).join(disclosing_terms(docs, text, disclosure, support, holders), ["entity", "term"], "left_semi")
    terms = written(found.groupBy("_h", "_g").agg(F.sort_array(F.collect_set("term")).alias("_terms")), "term-lists")
    keyed = docs.select("*", F.xxhash64(text).alias("_h"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("_g"), base_spans(F.col(text)).alias("_base"))
    joined = keyed.join(_sent_or_shuffled(terms), ["_h", "_g"], "left")
    quoted = F.array_join(F.transform("_terms", lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}])"))
    term_spans = F.when(F.col("_terms").isNotNull(), _spans(F.col(text), "term", pattern)).otherwise(_no_spans())
    every = F.transform(F.concat("_base", term_spans), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return joined.select(*docs.columns, every.alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span written as its kind in brackets; of overlapping spans the one that starts first is kept."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], piece, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out")))

    return F.aggregate(ordered, first, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_private_data(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_private(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
