import random

import cases
import xxhash

from windowmatch.llm import simhash
from windowmatch.llm.components import components


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_those_of_the_definition():
    for _, text, _ in cases.TEXTS:
        got = simhash.fingerprint(None if text is None else text.encode())
        assert got % (1 << 64) == plain_fingerprint(text)


def test_links_are_all_pairs_within_two_bits(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    values = set(centres)
    for c in centres:
        for _ in range(25):
            v = c
            for b in rng.sample(range(64), rng.randint(1, 4)):
                v ^= 1 << b
            values.add(v)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = {
        (a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin((a ^ b) % (1 << 64)).count("1") <= 2
    }
    found = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"))
    assert {tuple(r) for r in found.collect()} == want and len(want) > 300


def test_the_index_of_few_fingerprints_is_not_broadcast(spark):
    """Spark sizes the index, 70 keys a fingerprint, like the fingerprints themselves."""
    found = simhash.fingerprint_links(spark.range(1000).withColumnRenamed("id", "fp"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_random_graphs(spark):
    rng = random.Random(6)
    for size, n in ((60, 40), (200, 150), (300, 600)):
        links = [(rng.randrange(size), rng.randrange(size)) for _ in range(n)]
        links += [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 80)]
        roots = cases.union_find({x for l in links for x in l}, links)
        linked = {x for a, b in links if a != b for x in (a, b)}
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).frame.collect()}
        assert got == {n: roots[n] for n in linked}


def test_near_duplicates_of_defined_cases(spark):
    rows = cases.documents(spark)
    got = simhash.near_duplicates(rows).collect()
    assert len(got) == len(cases.TEXTS)
    prints = [(i, plain_fingerprint(t)) for i, t, _ in cases.TEXTS]
    nodes = sorted({f for _, f in prints})
    links = [(a, b) for a in nodes for b in nodes if a < b and bin(a ^ b).count("1") <= 2]
    roots = cases.union_find(nodes, links)
    least = {}
    for i, f in prints:
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    want = sorted(((i, f, least.get(roots[f], i)) for i, f in prints), key=repr)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=repr) == want
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0


def test_a_unique_text_stays_though_its_id_has_a_duplicate(spark):
    other = "an entirely different text about ships and the sea and the wind of the north"
    same = "the cat sat on the mat and the dog ran to the house of the man"
    kept = simhash.deduplicate(cases.documents(spark, [(1, same, None), (2, same, None), (2, other, None), (2, other, None)]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, same), (2, other)]


def test_one_document_of_each_group_stays(spark):
    kept = simhash.deduplicate(cases.documents(spark))
    assert kept.columns == cases.SCHEMA.names
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda i: (i is None, i))
    # 2 copies 1; 3, 4 and 5 have no words; rows without an id stay
    assert ids == [1, 3, 6, 7, 8, 9, 9, 10, None, None]
