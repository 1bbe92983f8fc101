"""Personal data by patterns, and the terms that give protected values away.

Method. Base patterns find e-mail addresses, IP addresses, card and phone numbers; each
value is a protected entity. Corpus co-occurrence then says how strongly the words around an
entity reveal it: with N different texts, c(e) different contexts of entity e, c(e,t) of them
holding term t, and n(t) different texts holding t anywhere, the disclosure of e by t is
PMI(e;t) / IC(e) = log(N c(e,t) / (c(e) n(t))) / log(N / c(e)). A term that only ever stands
beside e has 1, a term that is independent of e has 0. From ``GENERALISE`` on a term is
replaced by its kind, from ``REMOVE`` on it is taken out, in every document where it stands
in a context of e. Texts and contexts are counted once however often they are copied, and a
term needs ``SUPPORT`` different contexts, so a single sentence proves nothing.

All of it is DataFrame expressions. Statistics cover every document; there is no cap on
entities, terms or rows. Groupings are sums that combine before the shuffle, joins are
equi-joins left to adaptive execution, and a value that a third of all documents mention is
no hot group: its contexts are reduced to distinct ones by hash first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrain.scale import lookup

from .common import shielded, store, text_of

#: Kinds and their patterns. They match what the plain patterns match:
#: repeats are possessive where nothing that follows could use a given-back character, and a
#: look-behind keeps long runs from being tried at each of their characters.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
TERM = "term"
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"

#: Words on each side of an entity that are its context, and the characters looked at first
#: for them; where those hold fewer words, the whole side is read.
CONTEXT, REACH = 6, 160
#: Different contexts that a term needs, and the disclosures from which it is changed.
SUPPORT, GENERALISE, REMOVE = 2, 0.8, 0.95
#: A term: a run of letters or digits.
WORD, NOT_WORD = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid_ip(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(F.try_to_number(bare, F.lit("999")), F.lit(0)) <= 255)
    return F.forall(F.split(value, r"\."), small)


def _valid_card(value: Column) -> Column:
    back = F.reverse(_digits(value))

    def add(total: Column, at: Column) -> Column:
        digit = F.ascii(back.substr(at, F.lit(1))) - 48
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return (total + F.when(at % 2 == 0, twice).otherwise(digit)).cast("int")
    luhn = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add)
    return F.when(F.length(back).between(13, 19), luhn % 10 == 0).otherwise(False)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return _valid_ip(value)
    if kind == "card":
        return _valid_card(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def spans_of(text: Column, pattern: str | Column, kind: str) -> Column:
    """Spans of all matches in code points: matches and the gaps between them, added up."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    hit = F.rlike(text, regex)
    found = F.when(hit, F.regexp_extract_all(text, regex, F.lit(0)))
    gaps = F.when(hit, F.split(text, regex, -1))
    start = lambda acc, x: acc["at"] + F.length(x["gap"])
    each = lambda acc, x: F.struct(
        F.lit(kind).alias("kind"), start(acc, x).cast("int").alias("start"),
        (start(acc, x) + F.length(x["value"])).cast("int").alias("end"), x["value"].alias("value"))
    summed = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), found.alias("value")),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")),
        lambda acc, x: F.struct((start(acc, x) + F.length(x["value"])).cast("int").alias("at"),
                                F.when(x["value"].isNotNull(), F.concat(acc["out"], F.array(each(acc, x))))
                                .otherwise(acc["out"]).alias("out")))
    return F.coalesce(summed["out"], F.array().cast(SPANS))


def find(docs: DataFrame) -> DataFrame:
    """``docs`` (a column text, any others) with base_spans, ordered by kind as listed, then
    start. Null is the empty text. Spans of one kind never overlap; kinds may."""
    text = text_of(F.col("text"))
    raw = docs.withColumns({f"__{k}": spans_of(text, p, k) for k, p in PATTERNS.items()})
    checked = [F.filter(f"__{k}", lambda s, k=k: s["start"] >= 0) if k == "email"
               else F.filter(f"__{k}", _checker(k)) for k in KINDS]
    return raw.withColumn("base_spans", F.concat(*checked)).drop(*[f"__{k}" for k in KINDS])


def _checker(kind: str):
    return lambda span: _valid(kind, span["value"])


def _key(docs: DataFrame) -> DataFrame:
    """``docs`` with a row key: equal for rows with equal doc_id and text, nulls included."""
    return docs.withColumn("__key", F.xxhash64("doc_id", "text"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def _entity(span: Column) -> Column:
    """The protected value, written in one way."""
    plain = F.when(span["kind"] == "email", F.lower(span["value"])).when(
        span["kind"] == "ip", span["value"]).otherwise(_digits(span["value"]))
    return F.concat(span["kind"], F.lit(":"), plain)


def mentions(found: DataFrame) -> DataFrame:
    """(__key, entity, terms): one row for each base span, with the distinct terms around it."""
    each = found.where(F.size("base_spans") > 0).select(
        "__key", text_of(F.col("text")).alias("__text"), F.explode("base_spans").alias("__span"))
    span, text = F.col("__span"), F.col("__text")

    def side(part: Column, cut: Column, whole: Column) -> Column:
        # a cut part may begin or end inside a word, so it has to hold one word more
        found = _words(part)
        return F.when(cut & (F.size(found) <= CONTEXT), _words(whole)).otherwise(found)
    left = F.greatest(F.lit(0), span["start"] - REACH)
    before = side(text.substr(left + 1, span["start"] - left), left > 0, text.substr(F.lit(1), span["start"]))
    after = side(text.substr(span["end"] + 1, F.lit(REACH)), span["end"] + REACH < F.length(text),
                 text.substr(span["end"] + 1, F.length(text)))
    near = F.concat(F.when(F.size(before) > CONTEXT, F.slice(before, -CONTEXT, CONTEXT)).otherwise(before),
                    F.slice(after, 1, CONTEXT))
    return each.select("__key", _entity(span).alias("entity"), F.array_sort(F.array_distinct(near)).alias("terms"))


def _single(docs: DataFrame) -> tuple[DataFrame, int]:
    """Each different text of ``docs`` (__key, text) once, and their number. Only the copies of
    texts that stand more than once are looked up and left out; no text is moved for it."""
    marks = {"__a": F.xxhash64("text"), "__b": F.xxhash64("text", F.lit("again"))}
    texts = docs.select("__key", text_of(F.col("text")).alias("text")).withColumns(marks)
    groups = store(texts.groupBy("__a", "__b").agg(F.count("*").alias("__n"), F.min("__key").alias("__first")))
    copied = groups.where("__n > 1").select("__a", "__b", "__first")
    known = lookup(texts, copied, ["__a", "__b"])
    once = known.where("__first IS NULL").select("text")
    # rows equal in id and text have one key; they are few, as a group keeps one id
    first = known.where("__first = __key").dropDuplicates(["__key"]).select("text")
    return once.union(first), groups.count()


def disclosures(docs: DataFrame, seen: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(entity, term, disclosure) of all terms from ``least`` on, over the whole of ``docs``
    (__key, text) and its ``seen`` mentions. Everything is counted over different texts."""
    contexts = seen.select("entity", "terms").distinct()
    together = (contexts.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term")
                .agg(F.count("*").alias("both")).where(F.col("both") >= support))
    alone = contexts.groupBy("entity").agg(F.count("*").alias("of_entity")).where(F.col("of_entity") >= support)
    candidates = store(together.join(alone, "entity"))
    wanted = candidates.select("term").distinct()
    single, total = _single(docs)
    held = (single.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
            .join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("of_term")))
    pmi = F.log(total * F.col("both") / (F.col("of_entity") * F.col("of_term")))
    information = F.log(total / F.col("of_entity"))
    return (candidates.join(held, "term").where(F.col("of_entity") < total)
            .select("entity", "term", (pmi / information).alias("disclosure")).where(F.col("disclosure") >= least))


def detect(docs: DataFrame, support: int = SUPPORT, least: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` (doc_id, text, any others) with base_spans, term_spans and removed_terms.

    term_spans are all places of terms that give away an entity of the document, in code
    points; removed_terms are those of them that are to be taken out. Null texts are empty;
    rows with a null or repeated doc_id are searched like any other; an empty table gives an
    empty one. Columns already named like the new ones are replaced.
    """
    plain = _key(docs.drop("base_spans", "term_spans", "removed_terms"))
    found = find(plain)
    seen = store(mentions(found))
    rated = disclosures(plain, seen, support, least)
    own = (seen.select("__key", "entity", F.explode("terms").alias("term")).distinct().join(rated, ["entity", "term"])
           .groupBy("__key").agg(F.array_sort(F.collect_set("term")).alias("__terms"), F.array_sort(F.collect_set(
               F.when(F.col("disclosure") >= remove, F.col("term")))).alias("__removed")))
    joined = found.join(store(own), "__key", "left")
    regex = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("__terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    none = F.array().cast(SPANS)
    return (joined.withColumn("term_spans", F.when(F.col("__terms").isNotNull(), spans_of(
                text_of(F.col("text")), regex, TERM)).otherwise(none))
            .withColumn("removed_terms", F.coalesce("__removed", F.array().cast("array<string>")))
            .drop("__key", "__terms", "__removed"))


def _label(span: Column, removed: Column) -> Column:
    """What stands for a span in the sanitised text."""
    general = F.when(F.rlike(span["value"], F.lit(r"\p{N}")), "[CODE]").when(
        F.rlike(span["value"], F.lit(r"^\p{Lu}")), "[NAME]").otherwise("[WORD]")
    term = F.when(F.array_contains(removed, F.lower(span["value"])), "").otherwise(general)
    return F.when(span["kind"] == TERM, term).otherwise(F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]")))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced in text; other columns stay.

    Of overlapping spans the first stays, the longer one on equal starts; what sticks out of
    it is covered as well. A null text stays null, since nothing in it can be replaced; empty
    texts and repeated rows stay as they are, an empty table gives an empty one.
    """
    inner = shielded(docs, "doc_id", "text")
    known = detect(inner, **options)
    spans = F.array_sort(F.concat("base_spans", "term_spans"), lambda a, b: F.when(
        a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    text, removed = F.col("text"), F.col("removed_terms")
    step = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
                acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), _label(s, removed))).alias("out")))
    known = known.withColumn("__step", step)
    whole = F.concat(F.col("__step")["out"], text.substr(F.col("__step")["at"] + 1, F.length(text)))
    changed = F.size("base_spans") + F.size("term_spans") > 0
    return known.withColumn("text", F.when(changed, whole).otherwise(text)).select(*inner.columns).toDF(
        *docs.columns)
