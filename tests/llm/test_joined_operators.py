"""Operators that bring documents together, against plain versions, and the pipeline."""

import hashlib
import random
import re

import pytest
from compare import connect, difference

import corpus_pipeline
from millrace.llm import jaccard, warc, winnowing
from millrace.llm.registry import QUERIES
from millrace.llm.workspace import small

EDGES = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (4, "other text"), (5, "x" * 30000), (6, "w " * 3000)]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def plain_components(rows, n, percent):
    sets, parent = [shingles(t, n) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return sorted(((d, len(sets[i]), names.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("percent, n", [(90, 3), (80, 5), (80, 1), (60, 2)])
def test_components_against_all_pairs(docs, percent, n):
    rng = random.Random(percent + n)
    rows = list(EDGES)
    for family in range(20):
        base = [str(rng.randrange(30 if family % 3 == 0 else 5000)) for _ in range(rng.choice([1, 2, 4, 6, 9, 12, 20, 40, 80, 200]))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(max(1, len(base) // 10) + 1)):
                i = rng.randrange(len(words)) if words else 0
                words[i:i + rng.randrange(2)] = rng.choice([[], ["X"], [str(rng.randrange(9999))]])
            rows.append((len(rows) + 50, " ".join(words)))
    got = jaccard.similar_classes(docs(*rows), n=n, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_components(rows, n, percent)


def test_components_of_nothing(docs):
    assert jaccard.similar_classes(docs((1, "x")).where("false")).count() == 0


def plain_contamination(rows, items):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    out = []
    for i, text in rows:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            x = words(item)
            n = min(10, len(x))
            windows = {tuple(x[k:k + n]) for k in range(len(x) - n + 1)} if n and name is not None else set()
            at = [k for k in range(len(w) - n + 1) if n and tuple(w[k:k + n]) in windows]
            if at:
                names.add(str(name))
                hit.update(k + j for k in at for j in range(n))
        out.append((i, len(w), len(hit), len(names), bool(hit)))
    return sorted(out, key=str)


def test_contamination_against_all_windows(spark, docs):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("abcd") + rng.choice("İÉe") for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(12)]
    items += [(None, "x y z"), (50, None), (51, items[5][1])]
    rows = list(EDGES)
    for i in range(100, 160):
        text = [rng.choice("abcd") + rng.choice("İÉeê") for _ in range(rng.randrange(40))] + items[rng.randrange(12)][1].upper().split()
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = winnowing.contamination(docs(*rows), bench)
    assert "Python" not in plan_of(found) and "Arrow" not in plan_of(found)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found.collect()), key=str) == plain_contamination(rows, items)
    assert winnowing.contamination(docs(*rows), bench.where("false")).where("contaminated").count() == 0


def test_warc_records_in_any_chunks():
    records = [("1", "http://a/\n", b"x" * 5000, None), ("2", None, b"", None), (None, "u", b"y\r\n\r\nz" * 300, None), ("7", "u", b"x" * 5000, "1")]
    data = b"".join(warc.record(*r) for r in records)
    for size in (1, 7, 1000, 1 << 20):
        found = [warc.read_record(m, True) for m in warc.members(data[i:i + size] for i in range(0, len(data), size))]
        assert [(r["page_id"], r["payload"], r["payload_bytes"], r["refers_to"]) for r in found] == [
            (i, b"" if other else body, len(body), other) for i, _, body, other in records]
    with pytest.raises(ValueError):
        list(warc.read_record(m) for m in warc.members(iter([data[:-30]])))


def test_warc_rejects_what_does_not_fit():
    import zlib

    plain = zlib.decompress(warc.record("1", "u", b"payload"), 31)
    for wrong in (plain.replace(b"payload", b"payloaD"), plain.replace(b"payload", b"payloads"), plain[:-6]):
        with pytest.raises(ValueError):
            warc.read_record(iter([wrong]))


def test_warc_round_trip_of_edges(spark):
    body = "é" * 600
    rows = [(1, "u", body), (9, "u", body), (9, "v", body), (None, "u", body), (2, None, None), (3, "u", ""), (4, "u", "small"), (5, "u", "small")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size int")
    found = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect()), key=str)
    assert found == sorted([(1, 1200, "revisit", 9), (9, 1200, "response", None), (9, 1200, "response", None), (None, 1200, "revisit", 9),
                            (2, 0, "response", None), (3, 0, "response", None), (4, 5, "response", None), (5, 5, "response", None)], key=str)
    assert warc.archive_round_trip(pages.where("false")).count() == 0


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_queries_match_their_sql(spark, sf_dir, name):
    assert difference(QUERIES[name].run(spark, sf_dir), connect(sf_dir), QUERIES[name].sql) is None


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = stages["n-gram Jaccard join"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in plain_components(rows, 5, 80) if i == c)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = stages["benchmark decontamination"](spark, docs, sf_dir)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in plain_contamination(rows, items) if not r[4])


def test_near_duplicates_of_rows_without_names(spark, sf_dir, docs):
    copy, other = " ".join(map(str, range(60))), " ".join(map(str, range(100, 160)))
    rows = [(7, copy), (None, copy + " more"), (None, other), (None, other), (None, "alone in its group"), (3, other + " x"), (8, "one text"), (8, "another text"),
            (8, "one text"), (9, None), (9, None), (None, "")]
    kept = corpus_pipeline.near_duplicates(spark, docs(*rows).withColumnRenamed("keys", "k1"), sf_dir)
    assert kept.columns[:2] == ["doc_id", "text"] and "k1" in kept.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(7, copy), (3, other + " x"), (None, "alone in its group"), (8, "one text"), (8, "another text"), (9, None), (9, None), (None, "")], key=str)


def test_pipeline_of_edges(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    for rows in ([], [(i, t, None, None, None) for i, t in EDGES]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)
        assert docs.count() >= 0


def test_items_without_id_contaminate(spark, docs, tmp_path):
    """Such items count as one without a name, as in the SQL; the pipeline needs no id at all."""
    rows = [(1, "so one two three it is"), (2, "x y z"), (3, "x y z and one two three"), (4, "none of it"), (5, "so four five six")]
    bench = spark.createDataFrame([(None, "x y z"), (None, "four five six"), (7, "one two three")], "item_id long, text string")
    digest = {n: hashlib.sha256(n.encode()).hexdigest() for n in ("", "7")}
    found = winnowing.contamination(docs(*rows), bench).orderBy("doc_id").collect()
    assert [(r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found] == [
        (3, 1, digest["7"], True), (3, 1, digest[""], True), (6, 2, digest["7"], True), (0, 0, digest[""], False), (3, 1, digest[""], True)]
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [r.doc_id for r in corpus_pipeline.decontamination(spark, docs(*rows), str(tmp_path)).collect()] == [4]


def test_long_lists_are_no_small_table(spark):
    kept = spark.createDataFrame([(1, [0] * 8)], "k int, starts array<int>")
    hinted = ["Hint" in small(kept, *x)._jdf.queryExecution().logical().nodeName() for x in ((7,), (7, "starts"), (8, "starts"))]
    assert hinted == [True, False, True]


def test_stages_with_clashing_columns_and_long_texts(spark, sf_dir):
    """Columns that are called as the stages' own keys stay as they are, and so do very long texts without a fault."""
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(10_000_001, long, "en", "s", len(long)), (10_000_002, long + " more", "en", "s", len(long) + 5), (10_000_003, "x" * 300_000, "en", "s", 300_000)]
    docs = base.limit(50).unionByName(spark.createDataFrame(rows, base.schema)).selectExpr("*", "doc_id k1", "1 _k1", "'a' k2", "2 id", "3 label", "4 weight")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.schema.names == docs.schema.names, name
        left = {r.doc_id: r for r in kept.collect()}
        assert all(r.k1 == r.doc_id and (r._k1, r.k2, r.id, r.label, r.weight) == (1, "a", 2, 3, 4) for r in left.values()), name
        if name == "n-gram Jaccard join":
            assert 10_000_001 in left and 10_000_002 not in left
    packed = corpus_pipeline.pack(spark, docs, sf_dir)
    assert packed.where("doc_id = 10000001").agg({"length": "sum"}).first()[0] > 40_000
