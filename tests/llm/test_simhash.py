import itertools
import random

import pytest
import xxhash

from flowgrain.llm.graph import components
from flowgrain.llm.queries_dedup import op9
from flowgrain.llm.simhash import fingerprint, links, near_duplicates

from .cases import AWKWARD, SMALL, folder, frame


def plain_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: {doc: fingerprint}."""
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in prints}


def test_fingerprint_against_plain():
    for text in AWKWARD:
        assert fingerprint((text or "").encode()) == plain_print(text)


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    prints = {d: plain_print(t) for d, t in docs.items()}
    groups = plain_components(prints)
    assert len(set(groups.values())) < len(docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op9(spark, SMALL).collect()}
    assert got == {d: (f"{prints[d]:016x}", groups[d]) for d in docs}


def test_links_find_every_near_pair(spark):
    rng = random.Random(5)
    found = {rng.getrandbits(64) for _ in range(300)}
    for p in list(found)[:120]:
        for _ in range(rng.randint(1, 4)):
            p ^= 1 << rng.randrange(64)
            found.add(p)
    prints = {p: p for p in sorted(found)}
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = plain_components(prints)
    for tile in (4, 2048):
        comps = {signed[r.node]: signed[r.root] for r in components(links(df, tile=tile)).collect()}
        groups = {}
        for p in prints:
            groups.setdefault(comps.get(p, p), set()).add(p)
        plain = {}
        for p, r in want.items():
            plain.setdefault(r, set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_group_of_near_copies_does_not_become_all_pairs(spark):
    prints = [sum(1 << b for b in c) for c in itertools.combinations(range(40), 2)]
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    made = links(df).count()
    assert made < 80 * len(prints) < len(prints) ** 2 / 2 * 0.9
    roots = {r.root for r in components(links(df)).collect()}
    assert len(roots) == 1


def test_awkward_rows(spark):
    docs = frame(spark, AWKWARD).union(frame(spark, ["same text here again"]).selectExpr(
        "cast(null as long)", "text", "lang", "source", "n_chars"))
    docs = docs.selectExpr("*", "1 as fp", "2 as component_id", "'x' as root")
    got = near_duplicates(docs).collect()
    assert len(got) == len(AWKWARD) + 1
    by = {r.doc_id: r for r in got}
    assert by[0].fp == by[1].fp == by[2].fp == 0
    assert by[8].component_id == by[7].component_id == by[None].component_id == 7
    assert by[0].component_id == by[2].component_id == 0


def test_empty_table(spark, tmp_path):
    sf = folder(tmp_path, spark, documents=frame(spark, []))
    assert op9(spark, sf).count() == 0


@pytest.mark.parametrize("n", [2, 65])
def test_chain_has_one_root(spark, n):
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "u long, v long")
    assert {r.root for r in components(edges).collect()} == {0}
