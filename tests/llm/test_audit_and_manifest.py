"""The filter audit and the Merkle manifest, against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from millrace.llm import filter_audit, merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, digest string, n long"


def table(spark, rows):
    """Rows of (doc_id, source, lang, n_chars, text) with extra columns whose names clash."""
    return spark.createDataFrame([(i, t, lang, s, n, "p", 9, "d", 7) for i, s, lang, n, t in rows], DOC).repartition(3)


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_diagrams_visit_all_orders(k):
    rng = random.Random(k)
    counts = {m: (rng.randrange(5), rng.randrange(3)) for m in range(1 << k) if rng.random() < 0.8}
    orders = filter_audit.all_orders(counts, k)
    assert sorted(tuple(f for f, _, _ in steps) for steps in orders) == sorted(itertools.permutations(range(k)))
    for steps in orders:
        alive = dict(counts)
        for f, removed, kept in steps:
            gone = [w for m, w in alive.items() if m >> f & 1]
            alive = {m: w for m, w in alive.items() if not m >> f & 1}
            assert removed == tuple(sum(x) for x in zip((0, 0), *gone)) and kept == tuple(sum(x) for x in zip((0, 0), *alive.values()))


def test_equal_parts_of_a_diagram_are_shared():
    diagram = filter_audit.Diagram({m: (1,) for m in range(32)}, 5)
    assert [len(level) for level in diagram._known] == [1] * 5
    for level in filter_audit.level_swaps(5):
        diagram.swap(level)
        assert [len(x) for x in diagram._known] == [1] * 5 and len(diagram._edges) == 5


def plain_audit(rows, labels):
    docs = []
    for i, source, _, _, text in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and (x or "") == t for j, _, _, _, x in rows)
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), copy)
        docs.append((source or "", {x for x, f in zip("ABCDE", fails) if f}, *(i is not None and any(m[0] == i and m[k] == 1 for m in labels) for k in (1, 2))))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            alive = mine
            for step, f in enumerate(order, 1):
                gone, alive = [d for d in alive if f in d[1]], [d for d in alive if f not in d[1]]
                out[part, "".join(order), step] = (len(alive), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine),
                                                   sum(d[2] for d in gone), sum(d[3] for d in gone))
    shapley = {}
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + row[1]
    return {(*k, *row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def test_audit_against_all_orders(spark):
    rng = random.Random(5)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", " \n", "a b", "A B C", long, long + " #1", "a " * 220, "LOUD " * 210, long.upper(), "x" * 40000, "é\u00a0漢 \x1f 🙂"]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "", "s1", "s2"]), "en", 1, rng.choice(texts)) for _ in range(150)]
    rows += [(5, "s1", "en", 1, long)] * 3 + [(None, "s2", "en", 1, long)] * 2
    labels = [(rng.randrange(30), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(25)] + [(None, 1, 1)]
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.effects(filter_audit.mask_counts(table(spark, rows), marked), "ABCDE")
    assert {tuple(r) for r in found.collect()} == plain_audit(rows, labels)
    assert found.count() == 3 * 600
    assert filter_audit.effects(filter_audit.mask_counts(table(spark, rows).where("false"), marked), "ABCDE").count() == 0
    bare = filter_audit.effects(filter_audit.mask_counts(table(spark, rows), marked.where("false")), "ABCDE")
    assert bare.where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_audit_refuses_too_many_filters(spark):
    for names in ("", "AA", "ABCDEFGH"):
        with pytest.raises(ValueError):
            filter_audit.effects(spark.createDataFrame([], "part string, mask int, n long, good long, toxic long"), names)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(i, source, lang, n, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climb(nodes):
    """The root of some nodes, and the (sibling, left) of each on its way up."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for a in range(0, len(nodes), 2):
            for side, other in ((a, a + 1), (a + 1, a)):
                for i in groups[side] if side < len(nodes) else ():
                    paths[i].append((nodes[other] if other < len(nodes) else "", side > other))
        groups = [sum(groups[a:a + 2], []) for a in range(0, len(nodes), 2)]
        nodes = [h(*nodes[a:a + 2]) for a in range(0, len(nodes), 2)]
    return nodes[0], paths


def plain_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees.append((mine, *climb([leaf_of(*r) for r in mine])))
    root, over = climb([t[1] for t in trees])
    out = []
    for (mine, subroot, paths), upper in zip(trees, over):
        for row, path in zip(mine, paths):
            i, source, lang, n, text = row
            forged = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
            node = leaf_of(i, source, lang, n + 1 if forged else n, text)
            for sibling, left in path + upper:
                node = h(sibling, node) if left else h(node, sibling)
            out.append((i, leaf_of(*row), subroot, root, h(*(s for s, _ in path + upper)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits, digits", [(1, 1), (1, 2), (2, 2), (5, 2)])
def test_manifest_against_a_plain_tree(spark, bits, digits):
    rng = random.Random(bits * 10 + digits)
    rows = [(i, rng.choice([None, "s"]), rng.choice(["en", "en", "en", "dé", "z"]), rng.choice([None, i]), rng.choice([None, "", "t:1", "é🙂"])) for i in range(rng.randrange(30, 45))]
    rows += [(3, "s", "en", 1, "again"), (3, "s", "en", 2, "again"), (None, "s", "en", 4, "x"), (None, None, None, None, None), (70, "", "", 0, ""), (71, "s", "one", 5, "x" * 50000)]
    rows += [(80, "s", "z", 7, "same")] * 4
    found = merkle.audit(table(spark, rows), bits, digits)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 8, 9])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "s", "en", i, "t") for i in range(n)]
    assert sorted((tuple(r) for r in merkle.audit(table(spark, rows), 1, 2).collect()), key=str) == (plain_manifest(rows) if n else [])


def test_proofs_join_no_leaves(spark):
    """Only rows of blocks are joined on the way down; the plan of the last step generates leaves after its join."""
    plan = merkle.audit(table(spark, [(i, "s", "en", i, "t") for i in range(20)]), 1, 2)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    assert sum("Join" in x for x in lines) == 1 and next(i for i, x in enumerate(lines) if "Generate" in x) < next(i for i, x in enumerate(lines) if "Join" in x)
