"""Texts that are made to be mistaken: clashing hashes, letters beyond A-Z, attributes, ids, very long texts."""

import hashlib
import html
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import extraction, jaccard, packing, repetition, secret_scan, token_spans, tokens, warc, winnowing
from millrace.llm.words import Hashes, texts_of


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


CLASHING = [thue_morse(2048), thue_morse(2048, "ba")]


def test_hashes_tell_texts_apart():
    rng = random.Random(1)
    texts = [*CLASHING, "", "a", "a\0", "\0a", "\0", "\0\0", *("".join(rng.choice("ab\0") for _ in range(rng.randrange(130))) for _ in range(3000)), "x" * 64, "x" * 65]
    texts += [t + t for t in texts[:50]]
    made = texts_of(pa.array(texts + texts, pa.string()))
    hashes = Hashes(made)
    found = hashes.of(made.at[:-1], made.at[1:])
    assert np.array_equal(found[: len(texts)], found[len(texts):]) and len(set(found.tolist())) == len(set(texts))
    pick = np.array([rng.randrange(len(texts)) for _ in range(len(found))])
    unlike = hashes.differ(made.at[:-1], made.at[1:], made.at[pick], made.at[pick + 1])
    assert unlike.tolist() == [a != texts[b] for a, b in zip(texts + texts, pick)]


def test_clashing_texts_stay_apart(docs):
    one, two = CLASHING
    rows = [(1, one), (2, two), (3, f"{one}\n{two}")]
    assert {r.doc_id: r.n_dup_lines for r in repetition.repetition(docs(*rows)).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r.id: r.component for r in jaccard.similar_classes(docs(*rows), n=3, percent=90).collect()} == {1: 1, 2: 2, 3: 3}
    coded = tokens.load().encode(texts_of(pa.array([one, two, one], pa.string())))
    ids = [coded.ids[a:b].tolist() for a, b in zip(coded.at, coded.at[1:])]
    assert ids[0] == ids[2] != ids[1]
    assert len({r.ids_crc32 for r in packing.pack(docs(*rows[:2])).collect()}) == 2


def test_a_cached_piece_with_the_same_hash_is_not_taken(monkeypatch):
    monkeypatch.setattr(Hashes, "of", lambda self, start, end: (end - start).astype(np.uint64))
    coder = tokens.load()
    for _ in range(2):
        coded = coder.encode(texts_of(pa.array(["abc", "xyz", "abc", "xyz w"], pa.string())))
        ids = [coded.ids[a:b].tolist() for a, b in zip(coded.at, coded.at[1:])]
        assert ids[0] == ids[2] != ids[1] and ids[3][: len(ids[1])] == ids[1]


def test_special_tokens_count_as_such(docs):
    [row] = token_spans.section_tokens(docs((1, "a<|endoftext|>b"))).collect()
    assert row.n_tokens == 3


def test_sections_of_a_very_long_text(docs):
    text = "one line of it\n" * 50_000 + "last"
    found = sorted((r.section, r.start, r.end, r.n_tokens) for r in token_spans.section_tokens(docs((1, text)), rule="start").collect())
    assert len(found) == 50_001 and found[-1][1:3] == (750_000, 750_004)
    [whole] = [len(tokens.load().encode(texts_of(pa.array([text], pa.string()))).ids)]
    assert sum(r[3] for r in found) == whole


@pytest.mark.parametrize("between", [" ", ". ", "' ", "'", "\n", "·"])
def test_windows_in_letters_beyond_ascii(spark, docs, between):
    """The small form of a capital sigma depends on what follows its word; İ and ẞ change their length."""
    words = "ΟΔΟΣ ΛΟΓΟΣ ΘΕΟΣ ΝΟΜΟΣ ΤΟΠΟΣ İSTANBUL STRAẞE ΦΩΣ ΚΟΣΜΟΣ ΑΝΘΡΩΠΟΣ".split()
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    [row] = winnowing.contamination(docs((1, "x y " + between.join(words) + " z")), bench).collect()
    assert (row.n_hit, row.contaminated) == ((10, True) if between != "·" else (0, False))


KEPT_ATTRIBUTES = ['<a href="/hidden-lake">the lake</a>', '<a href="/x?id=menu">the lake</a>', '<p title="hidden gems">the lake</p>', '<div data-id="related">the lake</div>',
                   "<p data-hidden=true>the lake</p>", "<p alt='class=\"ad\"'>the lake</p>", "<math><mi>the lake</mi></math>", "<noscript>the lake</noscript>",
                   "<object><p>the lake</p></object>", '<p style="color: red">the lake</p>', '<span id="x" class="note">the lake</span>', "<p hidden-x>the lake</p>"]
DROPPED_ATTRIBUTES = ["<p hidden>the lake</p>", '<p title="x" hidden>the lake</p>', '<div id=related>the lake</div>', '<p aria-hidden="true">the lake</p>', "<div CLASS='Ad'>the lake</div>",
                      '<p style="display: none">the lake</p>', '<div role="navigation">the lake</div>', '<div class="user&#45;comments">the lake</div>', "<div class = sidebar>the lake</div>"]


@pytest.mark.parametrize("part, stays", [*((x, True) for x in KEPT_ATTRIBUTES), *((x, False) for x in DROPPED_ATTRIBUTES)])
def test_attributes_are_read_by_name(part, stays):
    page = f"<body><article><p>The first paragraph, with a comma, is here.</p>{part}<p>The second paragraph, with a comma, too.</p></article></body>"
    assert ("the lake" in extraction.main_text(page)) == stays


LINES = ["A paragraph, with commas, and words enough to count as one.", "Short.", "Another long one: it has no commas but more than a hundred characters, so that it gets "
         "some points for its length alone, or nearly.", "x < y & z > w", "é 漢字 🙂"]


@pytest.mark.parametrize("seed", range(40))
def test_random_pages_give_the_text_they_were_made_of(seed):
    rng = random.Random(seed)
    said = []

    def text():
        said.append(rng.choice(LINES) + f" No {len(said)}.")
        return html.escape(said[-1]).replace("A ", rng.choice(["A ", "A\n  ", "<b>A</b> "]), 1)

    def content(depth):
        kind = rng.choice(["p", "p", "h2", "list", "div", "quote", "table", "bare"] if depth < 3 else ["p"])
        if kind in ("p", "h2"):
            return f"<{kind} class='{rng.choice(['', 'lead', 'text'])}'>{text()}" + rng.choice(["", f"</{kind}>"] if kind == "p" else [f"</{kind}>"])
        if kind == "list":
            return "<ul>" + "".join(f"<li>{text()}" + rng.choice(["", "</li>"]) for _ in range(rng.randrange(1, 4))) + "</ul>"
        if kind == "table":
            return "<table>" + "".join(f"<tr><td>{text()}<td>{text()}" for _ in range(rng.randrange(1, 3))) + "</table>"
        if kind == "bare":
            return f"<div>{text()}</div>"
        tag = {"div": "div", "quote": "blockquote"}[kind]
        return f"<{tag}>" + "".join(content(depth + 1) for _ in range(rng.randrange(1, 4))) + f"</{tag}>"

    def noise():
        return rng.choice(["<nav><a href='/'>Home, sweet, home</a></nav>", "<aside><p>Read this, too, it is a good text, we say.</p></aside>", "<script>var x = '<p>no</p>';</script>",
                           "<div class='cookie-banner'><p>We use cookies, many of them, as one does.</p></div>", "<form><p>Send us, please, a few words, if you like.</p></form>", "<!-- <p>gone</p> -->",
                           "<style>p { color: red }</style>", "<div id='comments'><p>First, second, third, and so on, what a text!</p></div>"])

    tag = rng.choice(["article", "main"])
    inner = f"<p>{text()}" + "".join(content(0) + (noise() if rng.random() < 0.3 else "") for _ in range(rng.randrange(1, 8)))
    page = (f"<html><head><title>T</title></head><body><header><p>Site, with, commas, and a claim of some length.</p></header>{noise()}<div id='wrap'>{noise()}<{tag}>{inner}"
            f"</{tag}>{noise()}</div><footer><p>All, rights, reserved, by those who made this page.</p></footer></body></html>")
    assert extraction.main_text(page) == " ".join(said)


def test_equal_containers_are_taken_in_page_order():
    part = "<div><p>The same paragraph, with commas, twice on the page.</p></div>"
    assert extraction.main_text(f"<body><div>{part}{part}</div></body>").count("The same") == 2


@pytest.mark.parametrize("page", ["<ul><li>word, and some more text " * 30000, "<div " * 200000, '<div a="' * 120000 + ">", "<blockquote><p>a, b, c and d, a text" * 20000,
                                  "<b>" * 60000 + "<li>x" * 60000, "<div>" * 100000 + "</b>" * 100000, "<![CDATA[x>" * 90000, "<p>a paragraph, with commas, of this page" * 25000, "<script" * 150000, "<" * 10**6,
                                  "<script>x</script " * 60000])
def test_pages_of_a_megabyte_take_about_a_second(page):
    start = time.perf_counter()
    extraction.main_text(page)
    assert time.perf_counter() - start < 4


def test_ids_of_records_come_back(spark):
    body = "payload " * 200
    ids = ["", "p\n1", "<a>%41 é\r\nWARC-Type: x", "z z", None]
    pages = spark.createDataFrame([(i, "u", body + str(k)) for k, i in enumerate(ids)] + [("zz\r\nx", None, body + "0"), ("q", "", None)], "page_id string, url string, html string")
    found = {(r.page_id, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect()}
    assert found == {("", "revisit", "zz\r\nx"), *((i, "response", None) for i in ids[1:]), ("zz\r\nx", "response", None), ("q", "response", None)}


def test_a_long_payload_is_read_in_parts(spark):
    body = "".join(random.Random(4).choices("abcdefgh é", k=3_000_000))
    pages = spark.createDataFrame([(1, "u", body), (2, "u", body), (3, "u", body[:-1])], "page_id long, url string, html string")
    found = sorted(tuple(r)[:5] for r in warc.archive_round_trip(pages).collect())
    digest, other = (hashlib.sha1(x.encode()).hexdigest() for x in (body, body[:-1]))
    size = len(body.encode())
    assert found == [(1, size, digest, "revisit", 2), (2, size, digest, "response", None), (3, len(body[:-1].encode()), other, "response", None)]


PATTERNS = [r"""((?i:password|passwd|secret|token|api_?key))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+"]


def plain_base(text):
    """The patterns as the contract writes them, with the lengths asked for afterwards."""
    found = [[m.span() for m in re.finditer(PATTERNS[0], text, re.A) if len(m[2]) >= 12]]
    found += [[m.span() for m in re.finditer(p, text) if len(m[0]) >= n] for p, n in zip(PATTERNS[1:], (18, 16))]
    spans = sorted((a, kind, b) for kind, some in enumerate(found) for a, b in some)
    listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
    return (*map(len, found), hashlib.sha256(listed.encode()).hexdigest())


def test_base_secrets_against_the_plain_patterns(docs):
    rng = random.Random(9)
    parts = ["password", "PassWD", "secret", "tokEn", "api_key", "APIkey", "ſecret", "toKen", "=", ":", " ", "  ", "\t", '"', "'", "AKIA", "akia", "0123456789abcdef", "deadbeef", "F00", "Zk81xQp0LmT7", "x.y-z_w/",
             "é", "\n", "ABCDEFGHIJ1234", "=="]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(1500)] + [(9001, None), (9002, ""), (None, "token=abcdefabcdefabcdef")]
    table = secret_scan.ratio_table(secret_scan.pair_counts([secret_scan.written_together()] * 20))
    found = secret_scan.find_secrets(docs(*rows), table).collect()
    assert sorted((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found) == sorted((i or 0, *plain_base(t or "")) for i, t in rows)
    for r, text in ((r, dict(rows)[r.doc_id]) for r in found):
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        base = [(a, b) for k, a, b in spans if k != "markov"]
        added = [(a, b) for k, a, b in spans if k == "markov"]
        assert all(b <= x or y <= a for a, b in added for x, y in base)
        free = [m.span() for m in secret_scan.CANDIDATE.finditer(text or "") if all(m.end() <= x or y <= m.start() for x, y in base)]
        assert added == [(a, b) for a, b in free if secret_scan.looks_random(text[a:b], table)]


def test_a_text_of_many_keys_is_scanned_in_linear_time(docs):
    table = secret_scan.ratio_table(secret_scan.pair_counts([secret_scan.written_together()]))
    text = "token=abcdefabcdefabcdef0 xK7vQ2mZ9pLr4Tn8wB " * 25000
    start = time.perf_counter()
    assert len(secret_scan.all_spans(text, table)) >= 50000
    assert time.perf_counter() - start < 5


def test_copies_send_their_keys_once_a_task(docs, monkeypatch):
    rows = [(i, " ".join(map(str, range(60)))) for i in range(300)] + [(1000, " ".join(map(str, range(1, 61)))), (1001, "other words of a text")]
    for most in (10**6, 0):
        monkeypatch.setattr(jaccard, "SENT_CLASSES", most)
        found = {r.id: r.component for r in jaccard.similar_classes(docs(*rows), n=3, percent=90).collect()}
        assert found == {**{i: 0 for i, _ in rows}, 1001: 1001}


def test_the_number_of_key_tasks_grows_with_the_data(docs, monkeypatch):
    """Many small buckets give the same classes as one."""
    rng = random.Random(3)
    rows = [(i, " ".join(str(rng.randrange(40)) for _ in range(rng.randrange(1, 30)))) for i in range(120)]
    rows += [(200 + i, t + " end") for i, t in rows if len(t) > 60]
    plain = sorted(tuple(r) for r in jaccard.similar_classes(docs(*rows), n=1, percent=80).collect())
    monkeypatch.setattr(jaccard, "BUCKET_GRAMS", 20)
    monkeypatch.setattr(jaccard, "BUCKETS_A_TASK", 2)
    assert sorted(tuple(r) for r in jaccard.similar_classes(docs(*rows), n=1, percent=80).collect()) == plain


def near_copies(rng, families=8, copies=4, length=200):
    """Texts of which each has some others that differ in one word."""
    out = []
    for _ in range(families):
        base = [str(rng.randrange(10**6)) for _ in range(length)]
        for _ in range(copies):
            words = list(base)
            words[rng.randrange(length)] = "other"
            out.append((len(out), " ".join(words)))
    return out


def test_near_copies_are_not_reported_by_every_bucket(docs, monkeypatch, tmp_path):
    """What the buckets of keys report of near copies does not grow with their number."""
    rows, whole, told = near_copies(random.Random(5)), jaccard.shared_keys, []

    for grams in (10**6, 500):
        folder = tmp_path / str(grams)
        folder.mkdir()
        path = str(folder)

        def counted(bucket):
            out = whole(bucket)
            with open(f"{path}/{time.time_ns()}-{random.random()}", "w") as file:
                file.write(str(out.num_rows))
            return out

        monkeypatch.setattr(jaccard, "shared_keys", counted)
        monkeypatch.setattr(jaccard, "BUCKET_GRAMS", grams)
        found = {r.id: r.component for r in jaccard.similar_classes(docs(*rows), n=3, percent=90).collect()}
        assert found == {i: i - i % 4 for i, _ in rows}
        told.append(sum(int(f.read_text()) for f in folder.iterdir()))
    assert told[1] <= max(2 * told[0], len(rows))


@pytest.mark.parametrize("one", [True, False])
def test_links_do_not_depend_on_probes(docs, monkeypatch, one):
    """Sets of which all have the same probe, or each another one, are linked by their n-grams alike."""
    rows = near_copies(random.Random(6), length=60) + [(100 + i, f"{i} a text like no other {i * i}") for i in range(20)]
    plain = sorted(tuple(r) for r in jaccard.similar_classes(docs(*rows), n=2, percent=80).collect())
    assert len({c for _, _, c in plain}) == 28

    def forced(doc, gram, size):
        return np.zeros(len(size), np.uint64) if one else np.array([int(gram[doc == i].sum()) >> 32 for i in range(len(size))], np.uint64) * np.uint64((1 << 32) + 1)

    monkeypatch.setattr(jaccard, "probes", forced)
    assert sorted(tuple(r) for r in jaccard.similar_classes(docs(*rows), n=2, percent=80).collect()) == plain
