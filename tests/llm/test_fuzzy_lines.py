import random
from collections import Counter, defaultdict

import numpy as np

from keelmark.llm.fuzzy_lines import SHINGLE, band_hashes, fuzzy_lines, links, shingle_sets
from keelmark.llm.queries import op6_line_dedup
from tests.llm.cases import SCHEMA, edge_frame, edge_rows, table_rows


def shingles(line):
    return {line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def brute(rows):
    first, copies = {}, Counter()
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            line = line.strip(" \t\n\r\x0b\x0c")
            if line:
                copies[line] += 1
                first[line] = min(first.get(line, (i, n)), (i, n))
    lines = list(first)
    sets = [shingles(x) for x in lines]
    by_shingle = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by_shingle[x].append(i)
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in by_shingle[x] if j > i)
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    keep = {}
    for i, x in enumerate(lines):
        keep[find(i)] = min(keep.get(find(i), first[x]), first[x])
    return {(*first[x], copies[x], *keep[find(i)], keep[find(i)] == first[x]) for i, x in enumerate(lines)}


def test_documents_match_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table_rows(sf_dir, "documents")]
    want = brute(rows)
    got = {tuple(r) for r in op6_line_dedup(spark, sf_dir).collect()}
    assert {r[:3] for r in got} == {r[:3] for r in want}
    assert len(got & want) >= 0.99 * len(want)  # candidates are found with high, not full recall


def varied(rng, base, n):
    words = base.split()
    out = [base]
    for _ in range(n):
        w = list(words)
        w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_large_groups_in_blocks(spark, monkeypatch):
    import keelmark.llm.fuzzy_lines as module
    rng = random.Random(4)
    bases = [" ".join(f"w{rng.randrange(10**5)}" for _ in range(40)) for _ in range(3)]
    lines = [x for b in bases for x in varied(rng, b, 120)]
    rng.shuffle(lines)
    rows = [(i // 5, "\n".join(lines[i:i + 5]), None, None, None) for i in range(0, len(lines), 5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute([r[:2] for r in rows])
    assert sum(r[-1] for r in want) == 3
    for block in (1000, 20):
        monkeypatch.setattr(module, "BLOCK", block)
        assert {tuple(r) for r in fuzzy_lines(df).collect()} == want


def test_edges(spark):
    got = {tuple(r) for r in fuzzy_lines(edge_frame(spark).withColumnRenamed("lang", "line")).collect()}
    assert got == brute([r[:2] for r in edge_rows()])
    assert fuzzy_lines(edge_frame(spark).limit(0)).count() == 0
    df = spark.createDataFrame([(None, "abc\n\nabc"), (5, "x\n abc ")], "doc_id long, text string")
    assert {tuple(r) for r in fuzzy_lines(df).collect()} == {(5, 1, 3, 5, 1, True), (5, 0, 1, 5, 0, True)}


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    hit = tried = 0
    for _ in range(200):
        other = list(base)
        for _ in range(rng.randrange(1, 6)):
            other[rng.randrange(400)] = "Z"
        other = "".join(other)
        if jaccard(base, other) >= 0.8:
            tried += 1
            bands = band_hashes([base, other])
            hit += bool((bands[0] == bands[1]).any())
    assert tried > 100 and hit >= 0.98 * tried
    short = band_hashes(["ab", "ab", "abc", "", "ü"])
    assert (short[0] == short[1]).all() and not (short[0] == short[2]).any()
    assert np.unique(short).size == 4 * short.shape[1]


def test_links_connect_chains():
    a = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    chain = [a[i:i + 150] for i in range(0, 12, 3)]
    assert jaccard(chain[0], chain[1]) >= 0.8
    pairs = links(list(range(len(chain))), shingle_sets(chain))
    assert len(pairs) == len(chain) - 1
    assert [len(x) for x in shingle_sets([*chain, "", "ab", "aaaaaaaaaaaaaa"])] == [len(shingles(x)) for x in [*chain, "", "ab", "aaaaaaaaaaaaaa"]]
    assert links([5, 9], shingle_sets([chain[0], "something else"])) == []
    assert links([5, 9], shingle_sets([chain[0], chain[1]])) == [(5, 9)]
