"""Personal data, and the terms that give it away.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers, found by patterns over whole texts. Each kind
is a protected entity, present in a document or not. Following information-theoretic sanitisation (Sanchez and Batet's
C-sanitized model), corpus co-occurrence estimates how much a term t tells about an entity c: PMI(c; t) = log2(N n(c, t) / (n(c) n(t))),
counted in whole documents, as a share of the entity's information, IC(c) = log2(N / n(c)). That is 1 where t never occurs without c.
Rare events are discounted (Pantel and Lin's factor): by s / (s + 1) for the s different contexts (two words on both sides) in which t stands
in documents with c, so that copies of one document count once, and by m / (m + 1), m the lesser of n(c) and n(t).

In documents with c, terms whose disclosure is ``remove_at`` or above are removed, those at ``generalise_at`` or above become a more general
term: the longest beginning of theirs that is itself a term, in at least ``MORE_GENERAL`` times as many documents, and not telling; without one, ``[TERM]``.
Co-occurrence has no reach: a term anywhere in a document counts, and is treated, like any other.

Only DataFrame functions are used. Of documents with entities words are counted, and by context only those frequent enough to reach the threshold
(bounds follow from the formula); of all other texts only terms that may still reach it are counted, and combined before they are shuffled. Placing and replacing n spans of one text takes
time in proportion to n and to the text (sums and pieces are made by blocks).

Cases: null text counts as empty and has no spans (sanitised it stays null); spans are in code points, end exclusive;
spans of different kinds may overlap and then are replaced together; a term that overlaps a base span makes no span; repeated rows count as documents each
and get the same spans; an entity that every document has tells nothing; an empty table gives no rows; columns beside doc_id and text are passed through by ``sanitise``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkcatalog.llm.common import cut, row_key

# What counts as each kind. Possessive quantifiers stand where giving back cannot help a match.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM = r"[\p{L}\p{N}]++"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

GENERALISE_AT = 0.5
REMOVE_AT = 0.75
MORE_GENERAL = 4
BROADCAST_BYTES = 16 << 20
_BLOCK = 64
_FEW = 64
_PIECE = 8192


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _counts_as(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(x)).between(14, 19), _luhn(_digits(x))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


# A cheap test that every text with a match passes.
_GATES = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": lambda t: t.rlike(r"\+[0-9]")}
_PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def _placed(found: Column, gaps: Column, wanted: Column, make) -> Column:
    """For each place in ``wanted``: ``make(found, place, start)``; a match starts behind all earlier gaps and matches and its own gap.

    Lengths are summed by blocks, so that a place needs the sum of the blocks before it and of a part of its own.
    """

    def with_all(found: Column, gaps: Column) -> Column:
        lengths = F.zip_with(gaps, found, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
        sums = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _BLOCK).cast("int")), lambda j: _sum(F.slice(n, j * _BLOCK + 1, F.lit(_BLOCK))))
        before = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda j: _sum(F.slice(s, F.lit(1), j)))

        def start(n: Column, bases: Column, j: Column) -> Column:
            block = F.floor(j / _BLOCK).cast("int")
            return F.element_at(bases, block + 1) + _sum(F.slice(n, block * _BLOCK + 1, j % _BLOCK)) + F.length(F.element_at(gaps, j + 1))

        return _let(lengths, lambda n: _let(sums(n), lambda s: _let(before(s), lambda bases: F.transform(wanted, lambda j: make(found, j, start(n, bases, j))))))

    return _let(found, lambda f: _let(gaps, lambda g: with_all(f, g)))


def with_base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base``: array of ``(start, kind, end, value)`` in order, kind as a place in ``KINDS``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    x = docs.select("*", text.rlike("[0-9@]").alias("__any"))
    x = x.select("*", *(F.when(F.col("__any") & _GATES[k](text), F.regexp_extract_all(text, F.lit(_PATTERNS[k]), F.lit(0))).otherwise(none).alias(f"__{k}") for k in KINDS))
    def places(k: str) -> Column:
        wanted = F.filter(F.sequence(F.lit(0), F.size(f"__{k}") - 1), lambda j: _counts_as(k, F.element_at(f"__{k}", j + 1)))
        return F.when(F.size(f"__{k}") > 0, wanted).otherwise(F.array().cast("array<int>"))

    def spans(i: int, k: str) -> Column:
        def make(found: Column, j: Column, start: Column) -> Column:
            m = F.element_at(found, j + 1)
            return F.struct(start.alias("start"), F.lit(i).alias("kind"), (start + F.length(m)).alias("end"), m.alias("value"))

        none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
        return F.when(F.size(f"__at_{k}") > 0, _placed(F.col(f"__{k}"), F.col(f"__gap_{k}"), F.col(f"__at_{k}"), make)).otherwise(none)

    x = x.select("*", *(places(k).alias(f"__at_{k}") for k in KINDS))
    x = x.select("*", *(F.when(F.size(f"__at_{k}") > 0, F.split(text, _PATTERNS[k], -1)).otherwise(none).alias(f"__gap_{k}") for k in KINDS))
    return x.select(*docs.columns, F.sort_array(F.concat(*(spans(i, k) for i, k in enumerate(KINDS)))).alias("base"))


def _has(i: int) -> str:
    return f"has_{KINDS[i]}"


def _held(i: int) -> Column:
    return F.exists("base", lambda s: s["kind"] == i)


def occurrences(held: DataFrame) -> DataFrame:
    """``(row, has_email, ..., term, context, start, end)`` for each word of ``held(row, base, text)``, in lower case; context hashes two words on both sides."""
    has = [_held(i).alias(_has(i)) for i in range(len(KINDS))]

    def make(found: Column, j: Column, start: Column) -> Column:
        word = lambda at: F.when((at >= 1) & (at <= F.size(found)), F.element_at(found, F.greatest(at, F.lit(1))))
        m = F.element_at(found, j + 1)
        return F.struct(F.lower(m).alias("term"), F.xxhash64(*(F.lower(F.coalesce(word(j + 1 + d), F.lit(""))) for d in (-2, -1, 1, 2))).alias("context"), start.alias("start"), (start + F.length(m)).alias("end"))

    x = held.select("row", *has, F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("found"), F.split("text", TERM, -1).alias("gaps"))
    x = x.where(F.size("found") > 0)
    words = _placed(F.col("found"), F.col("gaps"), F.sequence(F.lit(0), F.size("found") - 1), make)
    return x.select("row", *map(_has, range(len(KINDS))), F.explode(words).alias("t")).select("row", *map(_has, range(len(KINDS))), "t.*")


def _bounded(terms: DataFrame) -> DataFrame:
    """Broadcast a checkpointed table of terms if it has few enough bytes, as measured."""
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    return F.broadcast(terms) if size <= BROADCAST_BYTES else terms


def document_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, n_t)``: in how many documents each of ``terms(term)``, a checkpointed table, occurs."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    x = docs.where("text IS NOT NULL").select(F.explode(words).alias("term"))
    return x.groupBy("term").agg(F.count("*").alias("n_t")).join(terms, "term", "left_semi")


def _best_shares(total: int, n_c: int) -> list[float]:
    """For n(c, t) = 0, 1, ... ``_FEW`` (and more): the largest disclosure that any n(t) allows, contexts aside."""
    if n_c >= total:
        return [0.0] * (_FEW + 1)
    bits = math.log2(total / n_c)
    # Of n(t) = n(c, t) + k the best k is small: the discount gains less than 1 / n(t) by one more, PMI loses about as much over ``bits``.
    return [0.0] + [max((1 - math.log2((n + k) / n) / bits) * (n + k) / (n + k + 1) for k in range(256)) for n in range(1, _FEW)] + [1.0]


def disclosures(docs: DataFrame, held: DataFrame, generalise_at: float = GENERALISE_AT) -> tuple[DataFrame, DataFrame]:
    """``(kind, term, n_t, disclosure)`` of all terms at ``generalise_at`` or above, and the document frequencies of them and of their beginnings."""
    kinds = range(len(KINDS))
    total = docs.count()
    n_c = held.agg(*(F.count_if(_held(i)) for i in kinds)).first()
    found = F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lambda w: F.lower(w))
    x = held.select(*(_held(i).alias(_has(i)) for i in kinds), found.alias("found"))
    counted = F.concat(F.transform(F.array_distinct("found"), lambda w: F.struct(w.alias("term"), F.lit(1).alias("row"))), F.transform("found", lambda w: F.struct(w.alias("term"), F.lit(0).alias("row"))))
    x = x.select(*map(_has, kinds), F.explode(counted).alias("t")).groupBy(F.col("t.term").alias("term"))
    terms = x.agg(*(F.count_if(F.col(_has(i)) & (F.col("t.row") == 1)).alias(f"n_{i}") for i in kinds), F.count_if(F.col("t.row") == 0).alias("times"))
    # No more contexts than occurrences: most terms are too rare to reach the threshold whatever their contexts and frequency are.
    most = [F.element_at(F.array(*map(F.lit, _best_shares(total, n))), F.least(F.col(f"n_{i}"), F.lit(_FEW)).cast("int") + 1) if (n := n_c[i] or 0) else F.lit(0.0) for i in kinds]
    terms = cut(terms.where(F.greatest(*most) * F.col("times") >= generalise_at * (F.col("times") + 1) - 1e-9))
    words = occurrences(held).join(_bounded(terms.select("term")), "term", "left_semi")
    contexts = words.groupBy("term", "context").agg(*(F.max(_has(i)).alias(_has(i)) for i in kinds)).groupBy("term").agg(*(F.count_if(_has(i)).alias(f"s_{i}") for i in kinds))
    stats = [F.struct(F.lit(i).alias("kind"), F.col(f"s_{i}").alias("s"), F.col(f"n_{i}").alias("n_ct"), F.lit(n_c[i] or 0).cast("long").alias("n_c")) for i in kinds]
    may = contexts.join(terms, "term").select("term", F.explode(F.array(*stats)).alias("x")).select("term", "x.*")
    may = cut(may.where((F.col("n_c") > 0) & (F.col("n_c") < total) & (F.col("s") >= generalise_at * (F.col("s") + 1))))
    beginnings = F.transform(F.sequence(F.lit(3), F.greatest(F.length("term"), F.lit(3))), lambda n: F.substr(F.col("term"), F.lit(1), n))
    wanted = cut(may.select("term").distinct().select(F.explode(F.concat(beginnings, F.array("term"))).alias("term")).distinct())
    often = cut(document_frequencies(docs, wanted))
    least = F.least("n_c", "n_t")
    pmi = F.log2(F.lit(float(total)) * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    share = pmi / F.log2(F.lit(float(total)) / F.col("n_c")) * F.col("s") / (F.col("s") + 1) * least / (least + 1)
    x = may.join(often, "term").select("kind", "term", "n_t", share.alias("disclosure"))
    return cut(x.where(F.col("disclosure") >= generalise_at)), often


def more_general(risky: DataFrame, often: DataFrame) -> DataFrame:
    """``risky`` with ``by``: the longest beginning that is a more frequent term and not risky for the same kind, else ``[TERM]``."""
    x = risky.where(F.length("term") > 3).select("kind", "term", "n_t", F.explode(F.sequence(F.lit(3), F.length("term") - 1)).alias("n"))
    x = x.select("kind", "term", "n_t", F.substr(F.col("term"), F.lit(1), F.col("n")).alias("g")).join(often.select(F.col("term").alias("g"), F.col("n_t").alias("n_g")), "g")
    x = x.where(F.col("n_g") >= F.col("n_t") * MORE_GENERAL).join(risky.select("kind", F.col("term").alias("g")), ["kind", "g"], "left_anti")
    best = x.groupBy("kind", "term").agg(F.max_by("g", F.length("g")).alias("g"))
    return risky.join(best, ["kind", "term"], "left").withColumn("by", F.coalesce("g", F.lit("[TERM]"))).drop("g")


_TERMS = "array<struct<start:int,end:int,act:string,by:string>>"


def find(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """Spans of each row of ``docs(doc_id, text)``: ``(row, doc_id, base, terms)``.

    ``row`` is a hash of doc_id and text, ``terms`` an array of ``(start, end, act, by)`` with act ``remove`` or ``generalise``.
    """
    rows = docs.select("doc_id", "text").withColumn("row", row_key("doc_id", "text"))
    marked = with_base_spans(rows).select("row", "doc_id", "base", "text")
    marked = cut(marked.withColumn("text", F.when(F.size("base") > 0, F.col("text"))))  # patterns run over the texts once
    held = marked.where("size(base) > 0")
    risky, often = disclosures(docs, held, generalise_at)
    risky = cut(more_general(risky, often).withColumn("act", F.when(F.col("disclosure") >= remove_at, F.lit("remove")).otherwise(F.lit("generalise"))))
    has = F.element_at(F.array(*map(_has, range(len(KINDS)))), F.col("kind") + 1)
    hit = occurrences(held).join(_bounded(risky), "term").where(has).groupBy("row", "start", "end").agg(F.max_by(F.struct("act", F.when(F.col("act") == "remove", "").otherwise(F.col("by")).alias("by")), F.struct("disclosure", "kind")).alias("best"))
    # Terms that overlap a base span go: one that began before and has not ended, or one that begins inside.
    hit = hit.select("row", "start", "end", "best.act", "best.by")
    base = held.join(hit.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"]).select("row", F.explode("base").alias("s")).select("row", "s.start", "s.end", F.lit(None).cast("string").alias("act"), F.lit(None).cast("string").alias("by"))
    so_far = (W.unboundedPreceding, 0)  # a frame up to the end would be read anew for each row
    ended = F.max(F.when(F.col("act").isNull(), F.col("end"))).over(W.partitionBy("row").orderBy("start").rangeBetween(*so_far))
    begins = F.min(F.when(F.col("act").isNull(), F.col("start"))).over(W.partitionBy("row").orderBy(F.desc("start")).rangeBetween(*so_far))
    free = hit.union(base).withColumn("ended", ended).withColumn("begins", begins).where("act IS NOT NULL AND coalesce(ended <= start, true) AND coalesce(begins >= end, true)")
    terms = free.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "act", "by"))).alias("terms"))
    return marked.select("row", "doc_id", "base").join(terms, "row", "left").withColumn("terms", F.coalesce("terms", F.array().cast(_TERMS)))


def _replaced(text: Column, cuts: Column) -> Column:
    """``text`` with each of the disjoint, ordered ``cuts(start, end, by)`` replaced, made by pieces of ``_PIECE`` code points: a cut is written where it starts."""

    def piece(part: Column, lo: Column, here: Column) -> Column:
        bounds = lambda c: (F.greatest(c["start"] - lo, F.lit(0)), F.least(c["end"] - lo, F.length(part)))

        def from_last(c: Column, i: Column) -> Column:
            last = F.when(i > 0, F.element_at(here, F.greatest(i, F.lit(1)))["end"] - lo).otherwise(0)
            return F.concat(F.substr(part, last + 1, F.greatest(bounds(c)[0] - last, F.lit(0))), F.when(c["start"] >= lo, c["by"]).otherwise(""))

        tail = F.substr(part, F.least(F.element_at(here, -1)["end"] - lo, F.length(part)) + 1, F.length(part))
        return F.when(F.size(here) == 0, part).otherwise(F.concat(F.array_join(F.transform(here, from_last), ""), tail))

    def within(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda p, i: _let(F.filter(cuts, lambda c: (c["end"] > i * _PIECE) & (c["start"] < (i + 1) * _PIECE)), lambda here: piece(p, i * _PIECE, here))), "")

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), within)


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with personal data and telling terms replaced in ``text``."""
    found = find(docs, **options).select("row", "base", "terms").where("size(base) > 0").groupBy("row").agg(F.first("base").alias("base"), F.first("terms").alias("terms"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("by")))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["by"].alias("by")))
    spans = found.select("row", F.explode(F.concat(base, terms)).alias("s")).select("row", "s.*")
    order = W.partitionBy("row").orderBy("start", "end", "by")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.when(F.coalesce(reach, F.lit(0)) <= F.col("start"), 1).otherwise(0)).withColumn("group", F.sum("fresh").over(order))
    merged = spans.groupBy("row", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("by", F.struct("start", "end", "by")).alias("by"))
    cuts = merged.groupBy(F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "by"))).alias("__cuts"))
    x = docs.withColumn("__row", row_key("doc_id", "text")).join(cuts, "__row", "left")
    x = x.withColumn("text", F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(_replaced(F.col("text"), F.col("__cuts"))))
    return x.select(docs.columns)


def _listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in (*KINDS, "term")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of each row."""
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end")))
    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed(plain), 256).alias("base_sha256"), _listed(F.sort_array(F.concat(plain, terms))).alias("spans"), F.size("terms").cast("long").alias("n_term"))
