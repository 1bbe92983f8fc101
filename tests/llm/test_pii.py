import hashlib
import math
import re
from collections import defaultdict

from flowgrain.llm.pii import CONTEXT, detect, sanitise
from flowgrain.llm.queries_filters import op2

from .cases import AWKWARD, SMALL, folder, frame

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else True,
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end(), m.group()) for k, p in PLAIN.items() for m in re.finditer(p, text or "")
            if valid(k, m.group())]


def words(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def entity(k, v):
    return k + ":" + (v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v))


def plain_terms(docs):
    """{doc: spans of disclosing terms} by counting everything at once."""
    contexts, seen, held = defaultdict(set), [], defaultdict(int)
    single = {text or "" for text in docs.values()}
    for text in single:
        for w in set(words(text)):
            held[w] += 1
    for d, text in docs.items():
        for k, a, b, v in base(text):
            near = words(text[:a])[-CONTEXT:] + words(text[b:])[:CONTEXT]
            near = tuple(sorted(set(near)))
            contexts[entity(k, v)].add(near)
            seen.append((d, entity(k, v), near))
    out = defaultdict(set)
    for d, e, near in seen:
        for t in near:
            both, of = sum(t in c for c in contexts[e]), len(contexts[e])
            if both >= 2 and len(single) > of and held[t]:
                rate = math.log(len(single) * both / (of * held[t])) / math.log(len(single) / of)
                if rate >= 0.8:
                    out[d].add(t)
    return {d: [("term", m.start(), m.end()) for m in re.finditer(r"[^\W_]+", docs[d]) if m.group().lower() in ts]
            for d, ts in out.items()}


def joined(spans):
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def check(rows, docs):
    terms = plain_terms(docs)
    assert len(rows) == len(docs)
    for r in rows:
        found = base(docs[r.doc_id])
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in found) for k in PLAIN], r
        assert r.base_sha256 == hashlib.sha256(joined(found).encode()).hexdigest()
        assert r.spans == joined(found + terms.get(r.doc_id, []))
    return terms


HARD = ["a@b.com_x@c.de d@e.f@g.h", ".@-.-", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.001.0.0 1.2.3", "4111 1111 1111 1111",
        "4111-1111-1111-1112", "4" * 20, "0" * 13, "9" * 3000, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1 (017) 555-7713.",
        "+1 (((( 2", "+49 30 12345678 90 and +1-2-3", "\U0001f600 a@b.co \U0001f600 10.0.0.1", "a" * 3000 + "@b.c",
        "1.1.1.1" * 50, "é@b.co", "a@b.co\na@b.co", "5500 0000 0000 0004 5500000000000004"]


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check(op2(spark, SMALL).collect(), docs)


def story(n):
    people = ["Zelmira Quoxford", "Bartok Vint77"]
    return [f"{'filler text number ' + str(i)} ask {people[i % 2]} at {'zq' if i % 2 == 0 else 'bv'}@mail.org or wait {i} days"
            for i in range(n)] + [f"plain text {i} ask at or wait days filler number" for i in range(40)]


def test_awkward_rows_and_terms(spark, tmp_path):
    texts = [*AWKWARD, *HARD, *story(8), story(1)[0], "Zelmira without the address", None]
    docs = frame(spark, texts).selectExpr("*", "1 as base_spans", "2 as term_spans", "3 as value", "4 as term")
    terms = check(op2(spark, folder(tmp_path, spark, documents=docs)).collect(), dict(enumerate(texts)))
    hit = {texts[d][a:b].lower() for d, spans in terms.items() for _, a, b in spans}
    assert {"zelmira", "quoxford", "bartok", "vint77"} <= hit and not hit & {"ask", "at", "or", "text"}


def test_copies_of_a_text_do_not_switch_protection_off(spark, tmp_path):
    pair = ["ask Zelmira Quoxford at zq@mail.org today", "then Zelmira Quoxford wrote from zq@mail.org again"]
    plain = [f"plain text number {i}" for i in range(300)]
    texts = [*pair, *plain, *[pair[0]] * 400]
    docs = frame(spark, texts)
    docs = docs.union(docs.where("doc_id = 0")).union(docs.where("doc_id = 0"))
    rows = op2(spark, folder(tmp_path, spark, documents=docs)).collect()
    terms = [len([s for s in r.spans.split(",") if s.startswith("term")]) for r in rows if "email" in r.spans]
    assert len(terms) == 404 and min(terms) >= 2


def test_long_words_beside_a_value(spark, tmp_path):
    long = "k" * 400
    texts = [f"one {long} x@mail.org z{i}" for i in range(2)] + [f"x@mail.org\u4e00\u4e8c{'y' * 500} end{i}" for i in range(2)]
    texts += [f"other text {i}" for i in range(30)]
    terms = check(op2(spark, folder(tmp_path, spark, documents=frame(spark, texts))).collect(), dict(enumerate(texts)))
    assert long in {texts[d][a:b] for d, spans in terms.items() for _, a, b in spans}


def test_sanitised_text(spark):
    texts = [*story(8), "call +1 (017) 555-7713 now", "none", None, "card 4111 1111 1111 1111."]
    docs = frame(spark, texts).selectExpr("*", "1 as removed_terms", "2 as `a.b`")
    assert sanitise(docs).columns == docs.columns
    got = {r.doc_id: r.text for r in sanitise(docs, remove=2.0).collect()}
    assert got[0] == "filler text number 0 ask [NAME] [NAME] at [EMAIL] or wait 0 days"
    assert got[1].startswith("filler text number 1 ask [NAME] [CODE] at [EMAIL]")
    n = len(story(8))
    assert [got[n + i] for i in range(4)] == ["call [PHONE] now", "none", None, "card [CARD]."]
    gone = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert gone[0].startswith("filler text number 0 ask   at [EMAIL]")


def test_rows_without_an_id(spark):
    docs = frame(spark, ["a@b.co", "a@b.co", None]).selectExpr("cast(null as long) as doc_id", "text")
    assert sorted(len(r.base_spans) for r in detect(docs).collect()) == [0, 1, 1]


def test_empty_table(spark, tmp_path):
    assert op2(spark, folder(tmp_path, spark, documents=frame(spark, []))).count() == 0
