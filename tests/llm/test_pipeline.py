"""The pipeline against a brute-force version of its stages, and the registered queries on the driver's smallest tables."""

import os
import random
import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from factloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(700)]
    shared = "This very long line stands in many of the documents."
    rows = []
    for k in range(120):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(55, 160)))
        rows.append((k, text + ("\n" + shared if k % 3 == 0 else "") + "\nend of document", "en", f"s{min(k % 10, 4)}", 1))
    words = rows[7][1].split(" ")
    for k in range(12):  # near copies
        w = words[:]
        w[5 + k] = "changed"
        rows.append((200 + k, " ".join(w), "en", "s1", 1))
    rows += [(300, rows[9][1], "en", "s0", 1), (300, rows[9][1], "en", "s0", 1), (301, None, "en", "s0", 1), (302, "short text", "en", None, 1), (None, rows[20][1] + " and more of it", "en", "s2", 1), (303, "buy $$$ now ### " * 30, "en", "s3", 1)]
    return rows


def words_of(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or ""))


def keeps(t):
    w = words_of(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    symbols = len(re.findall("[#*$%&|<>]", t or ""))
    return len(w) >= 50 and 100 * len(hit) <= 50 * len(w) and 10 * symbols <= len(w)


def shingles(t, size=5):
    w = words_of((t or "").lower())
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def without_lines(rows):
    holders = {}
    for r in rows:
        if r[0] is not None:
            for line in (r[1] or "").split("\n"):
                holders.setdefault(line.strip().lower(), set()).add(r[0])
    gone = lambda k, x: k is not None and len(x.strip()) >= 20 and len(holders[x.strip().lower()]) >= 3 and max(holders[x.strip().lower()]) != k
    return [(r[0], "\n".join(x for x in (r[1] or "").split("\n") if not gone(r[0], x)), *r[2:]) for r in rows]


def one_of_each(rows):
    """Which rows may stay: a set for each group of linked texts."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)))
        at[name] = docs
        assert name == "packing" or docs.columns == columns
    got = {k: sorted((tuple(r) for r in v.collect()), key=repr) for k, v in at.items() if k != "packing"}
    want = [r for r in rows if keeps(r[1])]
    assert got["quality_rules"] == sorted(want, key=repr)
    want = without_lines(want)
    assert got["line_dedup"] == sorted(want, key=repr)
    want = one_of_each(want)
    assert got["simhash_near_dedup"] == sorted(want, key=repr)
    taken = Counter(got["mixing"])
    assert set(taken) == set(want) and set(taken.values()) <= {1, 2}
    tokens = Counter()
    for r in want:
        tokens[r[3]] += len(words_of(r[1]))
    assert all(taken[r] == 1 for r in want if r[3] == max(tokens, key=tokens.get))
    tok = Tokenizer.from_file(tokenizer_path())
    total = Counter()
    for r in at["packing"].collect():
        total[r.doc_id] += r.length
    sizes = Counter()
    for r, n in taken.items():
        sizes[r[0]] += n * (len(tok.encode(r[1], add_special_tokens=False).ids) + 1)
    assert total == sizes


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"])
def test_registered_queries_run(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0


def test_near_duplicates_by_exact_similarity(spark):
    rng, rows = random.Random(5), []
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    for k in range(150):
        n, cut = 204, 18 + k % 16  # cut words at the end differ: a similarity of 0.845 to 0.716
        base = [word() for _ in range(n)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: n - cut] + [word() for _ in range(cut)]))]
    # one shingle outweighs all others in the fingerprint of words with repeats, but not in the set
    loop = "all of it again and " * 60
    rows += [(900, loop + " ".join(word() for _ in range(40))), (901, loop + " ".join(word() for _ in range(40)))]

    found = corpus_pipeline.simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in found.collect()}
    texts = dict(rows)
    linked = {k: similar(shingles(texts[k]), shingles(texts[k + 1])) for k in texts if k % 2 == 0}
    assert {k for k in linked if got[k + 1] == k} == {k for k in linked if linked[k]}
    assert 20 < sum(linked.values()) < 130


def test_similar_links_in_parts(spark):
    simhash = corpus_pipeline.simhash
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.arange(k * 4, k * 4 + 40, dtype=np.uint64) for k in range(12)] + [np.array([], np.uint64), rng.integers(10**6, 10**9, 40).astype(np.uint64)]
    a, b = simhash.similar_links(sets, 0.8)
    assert len(a) == len(b) == 11 and {*a, *b} == {*range(12)}  # a chain, each with its neighbours only
    assert simhash.similar_links(sets, 0.83) == ([], [])
    docs = spark.createDataFrame([(k, " ".join(f"w{n}" for n in range(k * 4, k * 4 + 44))) for k in range(12)], "doc_id long, text string")
    nodes = simhash.fingerprints(docs, 5, 128, sets=True).selectExpr("set", "n", "fp", "struct(doc_id, row_key) as rep")
    parts = nodes.selectExpr("fp as node", "(select min(X'00')) as component")
    links = simhash.set_links(docs, nodes, parts, 5, 0.8, block=3).collect()
    near = {r["set"]: r.rep.doc_id for r in nodes.collect()}
    pairs = {frozenset((near[r.a], near[r.b])) for r in links}
    assert pairs == {frozenset((k, k + 1)) for k in range(11)}


def test_similar_links_against_all_pairs():
    import numpy as np

    simhash, rng = corpus_pipeline.simhash, np.random.default_rng(3)
    for similarity in (0.8, 0.83, 0.9, 1.0) * 25:
        base, sets = rng.integers(0, 2**63, 300).astype(np.uint64), []
        for _ in range(rng.integers(0, 30)):
            kept = base[rng.integers(0, 30) :][: rng.integers(0, 60)]
            own = rng.integers(0, 2**63, rng.integers(0, 2 + len(kept) // 6)).astype(np.uint64)
            sets.append(np.unique(np.concatenate([kept[rng.random(len(kept)) > 0.25 * rng.random()], own])))
        sets = [*{s.tobytes(): s for s in sets}.values()]
        held = [{*s.tolist()} for s in sets]
        pairs = [(i, j) for j in range(len(held)) for i in range(j) if held[i] and held[j] and similar(held[i], held[j]) and len(held[i] & held[j]) >= similarity * len(held[i] | held[j]) - 1e-9]
        a, b = simhash.similar_links(sets, similarity)
        root = [*range(len(sets))]
        for i, j in zip(a, b):
            root = [root[i] if r == root[j] else r for r in root]
            assert (min(i, j), max(i, j)) in pairs
        assert all(root[i] == root[j] for i, j in pairs)


@pytest.mark.parametrize("low, high", [(0.3, 0.7), (0.0, 0.5), (0.05, 0.2)])
def test_similar_links_of_a_large_group(low, high):
    """Texts of one passage or template: the work must not grow with the square of their shingles."""
    import time

    import numpy as np

    simhash, rng = corpus_pipeline.simhash, np.random.default_rng(4)

    def seconds(n):
        base, sets = rng.integers(0, 2**63, 300).astype(np.uint64), []
        for own in rng.uniform(low, high, n):
            kept = base[rng.random(300) > own]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**63, 300 - len(kept)).astype(np.uint64)])))
        began = time.thread_time()
        simhash.similar_links(sets, 0.8)
        return time.thread_time() - began

    unit = seconds(200)
    assert seconds(6000) < 200 * max(unit, 0.005) + 2  # 900 times with the square


def test_sets_hashed_together():
    import numpy as np

    simhash, rng = corpus_pipeline.simhash, random.Random(6)
    texts = [None, "", " \n\t", "a", "A b", "a b c d", "a b c d e", "a  b\tC d E", " lead a b c d e f ", "x" * 5000, "x" * 5000 + " " + "y" * 300, "é è ü 日本語 x y z w"]
    texts += [" ".join(rng.choices("abcdef", k=rng.randint(1, 900))) for _ in range(40)] + [" ".join(map(str, range(230_000)))]
    want = [shingles(t) for t in texts]
    h, sizes = simhash.shingle_sets([t and t.encode() for t in texts], 5)
    assert sizes.tolist() == [len(w) for w in want]
    ends = np.cumsum(sizes)
    sets = [h[e - n : e] for e, n in zip(ends, sizes)]
    assert all((np.diff(s.astype(object)) > 0).all() for s in sets)
    assert len(np.unique(h)) == len(set().union(*want))
    for _ in range(300):
        i, j = rng.randrange(len(texts) - 1), rng.randrange(len(texts) - 1)
        assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])
    assert simhash.set_fingerprints(h, sizes, 128) == [simhash.fingerprint_of(s, 128) for s in sets]
    keys, held = simhash.set_blocks(h, sizes)
    assert [k.tolist() for k in np.split(keys, np.cumsum(held)[:-1])] == [simhash.class_blocks(s).tolist() for s in sets]
