"""Each operator against a plain version, round trips and closed cases."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindrift.llm import bpe, chat, fingerprint, html, linedup, neardup, packing, quality, shards, simhash, substrings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- 1


def test_html_closed_cases():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav><a href=/>home</a></nav><div id="cookie-notice">We use cookies</div><div class="content"><h1>Head &amp; line</h1><p>First  para<br>goes <b>on</b> with a <a href=x>link</a> and more.
    <p>Second para, also long enough.<div class="ad-banner">Buy now</div><ul><li>one</li><li>two</li></ul><form><input><p>Subscribe</p></form></div>
    <section class="comments"><article><p>Nice post, I liked it very much indeed.</p></article></section><aside>side</aside><!-- c --><footer>foot</footer><script>if (a<b) x="</p>"</script></body></html>"""
    assert html.extract(page) == "Head & line\n\nFirst para goes on with a link and more.\n\nSecond para, also long enough.\n\none\n\ntwo"
    assert html.extract("<article><header><h1>T</h1></header><p>a &lt;b&gt; &#233;&nbsp;c<footer>by x</footer></article><p>other") == "T\n\na <b> é c"


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""), ("plain", "plain"), ("<p>a", "a"), ("<nav>x</nav>", ""), ("<<<>>> < b", "<<<>>> < b"),
        ('<a href="un>closed<p>text', "closed\n\ntext"), ("<script>x", ""), ("</p></div>", ""), ("<p>" * 2000 + "x", "x"),
        ("<div>" * 2000 + "x" + "</b>" * 2000, "x")
    ]
)
def test_html_odd_pages(page, want):
    assert html.extract(page) == want


def test_html_takes_the_dense_subtree():
    links = "".join(f"<li><a href=/{i}>item number {i}</a></li>" for i in range(20))
    body = "".join(f"<p>Paragraph {i} has a good deal of running text in it, as articles do.</p>" for i in range(6))
    got = html.extract(f"<body><div><ul>{links}</ul></div><div><div>{body}</div></div><div><ul>{links}</ul></div></body>")
    assert got == "\n\n".join(f"Paragraph {i} has a good deal of running text in it, as articles do." for i in range(6))


def _p(n, words, tag="p"):
    return "".join(f"<{tag}>" + " ".join(f"{tag}{i}x{j}" for j in range(words)) + f".</{tag}>" for i in range(n))


def test_html_articles_sections_and_lists_of_the_text_stay():
    two = html.extract(f"<body><article>{_p(3, 20)}</article><article>{_p(3, 20)}</article></body>")
    assert two.count("p0x0 ") == 2
    inside = f'<body><div><h1>T</h1>{_p(4, 30)}<section id="social-history"><p>Its social history.</p></section><div class="related-work"><p>Related work.</p></div>'
    books = "".join(f"<li><a href=/{i}>Author {i}, a book of some length, 19{i}0</a></li>" for i in range(5))
    got = html.extract(f"{inside}<h2>References</h2><ul>{books}</ul></div></body>")
    assert all(x in got for x in ("Its social history.", "Related work.", "References", "Author 4, a book of some length, 1940"))
    menu = "".join(f"<li><a href=/{i}>item {i}</a></li>" for i in range(9))
    assert html.extract(f"<body><ul>{menu}</ul>{_p(5, 25)}</body>").startswith("p0x0 ")


@pytest.mark.parametrize(
    "piece",
    [
        "<a href='", '<a href="', "<div><td></td>", "<", "<a 'x' \"y\" ", "<!-- ", "<li><div>", "<a b='\">", "<p ", "</a href='", "<p class='a' ",
        "&#", "<table><tr>"
    ]
)
def test_html_reads_a_megabyte_of_bad_markup_in_time(piece):
    began = time.perf_counter()
    html.extract(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 10


def plain_tree(node, linked=False):
    """Characters, tags, link characters and link tags below a node [tag, child, ...], with those of its children."""
    tag, *kids = node
    linked = linked or tag == "a"
    c = t = lc = lt = 0
    parts = []
    for k in kids:
        if isinstance(k, str):
            c, lc = c + len("".join(k.split())), lc + linked * len("".join(k.split()))
        else:
            parts.append(plain_tree(k, linked))
            c, t, lc, lt = (x + y for x, y in zip((c, t, lc, lt), parts[-1]["n"]))
            t, lt = t + 1, lt + (k[0] == "a")
    return {"tag": tag, "n": (c, t, lc, lt), "kids": parts, "node": node}


def plain_density(x, ratio):
    c, t, lc, lt = x["n"]
    if not c:
        return 0.0
    base = math.log(math.log(c * lc / max(c - lc, 1) + ratio * c + math.e))
    return c / max(t, 1) * (math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / base if base > 1e-9 else 1.0)


def plain_extract(tree):
    """The texts kept of a tree of plain tags below body: see html.choose."""
    root = plain_tree(tree)
    ratio = root["n"][2] / max(root["n"][0], 1)
    order = []

    def walk(x, path):
        x["d"], x["path"], x["keep"] = plain_density(x, ratio), [*path, x], False
        order.append(x)
        for k in x["kids"]:
            walk(k, x["path"])
        x["s"] = sum(k["d"] for k in x["kids"])

    walk(root, [])
    if not root["n"][0]:
        return []
    best = max(order, key=lambda x: x["s"]) if any(x["s"] for x in order) else root
    least = min(x["d"] for x in best["path"])
    link = lambda x: 2 * x["n"][2] > x["n"][0]
    own = lambda x: x["n"][0] - sum(k["n"][0] for k in x["kids"])

    def whole(x):
        x["keep"] = True
        for k in x["kids"]:
            whole(k)

    def beside(x, article):
        if x["tag"] == "h1" or not link(x) and (x["d"] >= least or article or x["tag"] == "article"):
            whole(x)
        else:
            for k in x["kids"]:
                beside(k, article or x["tag"] == "article")

    said = lambda x: (x["keep"] and x["n"][0] > 0) or any(said(k) for k in x["kids"])
    for x in best["path"][:-1]:
        article = any(p["tag"] == "article" for p in x["path"])
        x["keep"] = own(x) >= least or article
        for k in x["kids"]:
            if k not in best["path"]:
                beside(k, article)
    began = False
    best["keep"] = True
    for k in best["kids"]:
        if began or not link(k) or not k["n"][0]:
            whole(k)
            began = began or k["n"][0] > 0
    if not began and not own(best):
        whole(best)
    for x in best["path"][:-1]:
        after = False
        for k in reversed(x["kids"]):
            heading = k["tag"] in ("h1", "h2")
            if heading and after:
                whole(k)
            after = said(k) or k["keep"] or heading and after
    out = []

    def read(x):
        parts = iter(x["kids"])
        for k in x["node"][1:]:
            if isinstance(k, str):
                out.extend(k.split() if x["keep"] else [])
            else:
                read(next(parts))

    read(root)
    return out


def _html(node):
    return f"<{node[0]}>" + "".join(k if isinstance(k, str) else _html(k) for k in node[1:]) + f"</{node[0]}>"


def test_html_equals_a_plain_version_on_random_trees():
    rnd, names = random.Random(11), itertools.count()
    text = lambda: " ".join(f"w{next(names)}" + "x" * rnd.randint(0, 9) for _ in range(rnd.choice([1, 2, 8, 30])))

    def tree(depth):
        tag = rnd.choice(["div", "div", "section", "ul", "article", "blockquote"])
        kids = [tree(depth - 1) if depth and rnd.random() < 0.4 else leaf() for _ in range(rnd.randint(0, 5))]
        return [tag, *(["li", k] if tag == "ul" else k for k in kids)]

    def leaf():
        return rnd.choice([
            lambda: ["p", text()], lambda: ["p", ["a", text()], " " + text()], lambda: ["div", ["a", text()]], lambda: ["h2", text()],
            lambda: ["h1", text()], lambda: ["div", text()]
        ])()

    for _ in range(1500):
        t = ["body", *(rnd.choice([lambda: tree(3), leaf])() for _ in range(rnd.randint(1, 5)))]
        assert html.extract(_html(t)).split() == plain_extract(t), _html(t)


# -- 2


def plain_units(text, kind):
    """(start, end, words) of the units of a text, by hand: lines, or sentences cut before capitalised words as well."""
    out, at, i = [], 0, 0
    while i <= len(text):
        k = i
        while k < len(text) and text[k].isspace():
            k += 1
        gap = text[i:k]
        if kind == "line":
            ends = "\n" in gap
        else:
            capital = len(text) > k + 1 and text[k].isupper() and text[k + 1].islower() and text[k] <= "Þ" and text[k + 1] <= "ÿ"
            ends = gap and (i > 0 and text[i - 1] in ".!?…。！？" or "\n" in gap or capital)
        if i == len(text) or ends:
            out.append((at, i, text[at:i].lower().split()))
            at = i = max(k, i + 1) if i == len(text) else k
        else:
            i = k if gap else i + 1
    return out


def plain_substrings(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        gone = set()
        for kind, least in (("line", 15), ("sentence", 3)):
            run = []
            for a, e, words in [*(u for u in plain_units(texts[i], kind) if len(u[2]) >= least), (0, 0, None)]:
                key = None if words is None else (kind, *words)
                if key in seen:
                    run.append((a, e, len(words)))
                    if kind == "line":
                        gone |= set(range(a, e))
                else:
                    if kind == "sentence" and sum(n for _, _, n in run) >= 25:
                        gone |= set(range(run[0][0], run[-1][1]))
                    run = []
                seen.add(key)
            seen.discard(None)
        at = sorted(gone)
        out[i] = [(a, e + 1) for a, e in zip([x for x in at if x - 1 not in gone], [x for x in at if x + 1 not in gone])]
    return out


def test_substrings_equal_a_plain_version(spark, docs, texts):
    want = plain_substrings(texts)
    for r in substrings.clean(docs).select("row.doc_id", "text", "spans").collect():
        assert [(s.start, s.end) for s in r.spans] == want[r.doc_id]
        assert r.text == "".join(
            texts[r.doc_id][a:b] for a, b in zip([0, *(e for _, e in want[r.doc_id])], [*(s for s, _ in want[r.doc_id]), len(texts[r.doc_id])])
        )


def test_substrings_find_a_passage_in_the_middle_of_lines(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(9) for _ in range(6))
    own = [" ".join(sentence(9) for _ in range(8)) for _ in range(5)]
    rows = [(i, f"{t[:90]} {passage} {t[90:]}") for i, t in enumerate(own)] + [(9, own[0][:200])]
    got = {
        r.doc_id: r for r in substrings.clean(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "text", "spans").collect()
    }
    assert got[0].text == rows[0][1] and not got[0].spans
    for i in range(1, 5):
        assert passage not in got[i].text and len(got[i].spans) == 1 and rows[i][1][got[i].spans[0].start : got[i].spans[0].end] == passage


def test_substrings_of_a_line_in_half_the_documents(spark):
    """A line in every other document, another twice in each: all but the first go, and few of the rows meet in a task."""
    often = " ".join(f"often{i}" for i in range(20))
    rows = [(i, "\n".join([f"own words of document {i}"] + [often] * (i % 2) + [" ".join(f"d{i}w{j}" for j in range(18))] * 2)) for i in range(600)]
    got = {
        r.doc_id: r for r in substrings.clean(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "text", "spans").collect()
    }
    assert {i: [tuple(s) for s in r.spans] for i, r in got.items()} == plain_substrings(dict(rows))
    assert sum(often in r.text for r in got.values()) == 1 and all(r.text.count(f"d{i}w0 ") == 1 for i, r in got.items())


# -- 3


def test_fingerprint_is_homomorphic_and_order_free(texts):
    rnd = random.Random(2)
    for t in list(texts.values())[:40]:
        raw = t.encode()
        parts = raw.split(b"\n")
        rnd.shuffle(parts)
        fp = fingerprint.of(raw)
        assert fingerprint.of(b"\n".join(parts)) == fp == fingerprint.Fingerprint.parse(fp.text())
        assert fp - fingerprint.of(parts[0]) + fingerprint.of(parts[0]) == fp
        at = len(t[: rnd.randint(0, len(t))].encode())
        assert fingerprint.edit(fp, raw, at, b"new\nend") == fingerprint.of(raw[:at] + b"new\nend")
    assert fingerprint.of(b"a\nb") != fingerprint.of(b"a\nb\n") and fingerprint.of(b"") == fingerprint.of(b"") != fingerprint.of(b"x")


def plain_shingles(raw):
    """The multiset that the likeness is about: byte shingles of each line, and the lines that are shorter than one."""
    n, got = fingerprint.SHINGLE, Counter()
    for line in raw.split(b"\n"):
        got.update(line[i : i + n] for i in range(len(line) - n + 1))
        if 0 < len(line) < n:
            got[line] += 1
    return got


def plain_likeness(a, b):
    x, y = plain_shingles(a), plain_shingles(b)
    both = sum(v * v for v in x.values()) + sum(v * v for v in y.values())
    return 1.0 if x == y else 1 - sum((x[k] - y[k]) ** 2 for k in x.keys() | y.keys()) / both


def test_fingerprint_is_the_plain_sum_of_lines(texts):
    for t in list(texts.values())[:20]:
        raw = t.encode()
        want = [sum(int.from_bytes(
            hashlib.shake_128(x).digest(128)[8 * k : 8 * k + 8], "little"
        ) for x in raw.split(b"\n")) % 2**64 for k in range(16)]
        assert fingerprint.of(raw).exact.tolist() == want


def test_fingerprint_likeness_estimates_that_of_the_multisets(texts):
    long = [t.encode() for t in texts.values() if len(t) > 3000][:16]
    line, tail = b"one line of a text that says little. ", b"the end again "
    cases = [(a, a[: 2 * len(a) // 3] + b[: len(a) // 3]) for a, b in itertools.pairwise(long)] + list(itertools.pairwise(long))
    cases += [(line * n, line * (2 * n // 3)) for n in (10, 1000, 70_000)]  # 70,000 times: 2.6 MB
    cases += [(long[0] + tail * n, long[0] + tail * (2 * n // 3)) for n in (100, 100_000)]
    cases += [((line + b"\n") * 50_000, (line + b"\n") * 30_000 + tail * 40_000)]
    for a, b in cases:
        got, want = fingerprint.of(a).likeness(fingerprint.of(b)), plain_likeness(a, b)
        assert abs(got - want) < 0.25 and (want < 0.9 or abs(got - want) < 0.1), (len(a), got, want)
    assert fingerprint.of(line * 70_000).likeness(fingerprint.of(line * 46_666)) > 0.9


# -- 4

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(t):
    w = SPACE.findall(t)
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(lines), t.count("!"), sum(c.isupper() for c in t)


def plain_verdict(t, least=50):
    n, chars, sym, dup, rep, lines, excl, upper = plain_counts(t)
    return not (
        n < least or 10 * chars < 25 * n or chars > 12 * n or 10 * sym > n or 5 * excl > n or 10 * upper > 3 * chars or 10 * dup > 4 * lines or 10 * rep > 3 * n
    )


def test_quality_counts_and_verdict(spark, texts):
    odd = [
        "", "a b c a b c a", "x\x1cy z", "a\n\na\n b \n", "A B C " * 40, "é è # * | <>\t\x0b\x0c\r", "one two three " * 30,
        " ".join(f"w{i}" for i in range(60))
    ]
    odd += ["ab cd ef " * 2000 + " ".join(f"v{i}" for i in range(9000)), " ".join(f"u{i % 700} u{i % 11}" for i in range(20_000))]
    some = list(enumerate([*odd, *texts.values()]))
    d = spark.createDataFrame(some, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.counts(d).collect()}
    lazy = {r[0]: r[1] for r in d.select("doc_id", quality.n_repeat_words(F.col("text"))).collect()}
    for i, t in some:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(t)[:5] and lazy[i] == r.n_repeat_words, t[:80]
    for rules, least in ((quality.RULES, 50), (quality.CORPUS_RULES, 1)):
        assert sorted(r.doc_id for r in quality.keep(d, rules).collect()) == [i for i, t in some if plain_verdict(t, least)]


def test_repeated_words_where_hashes_agree_in_what_is_sorted(spark):
    """Hashes that differ in their lowest bits alone, between equal ones: the pairs are sorted."""
    rows = [([5 << 40, 5 << 40 | 1, 9 << 40, 5 << 40], 6), ([7 << 40, 7 << 40 | 3], 0), ([1 << 30, 2 << 30, 1 << 30], 5), ([-1, -1 << 30, -1], 5)]
    d = spark.createDataFrame([(g, n) for g, n in rows], "g array<long>, n long")
    got = d.select(quality.covered(F.col("g"), quality.packed(F.col("g"))).alias("c"), quality._slowly(F.col("g")).alias("s"), "n").collect()
    assert [r.c for r in got] == [r.s for r in got] == [r.n for r in got]


def test_cascade_order_follows_rejections_per_cost(docs):
    for counted in (None, quality.counts):
        found = quality.measure(docs, counted=counted)
        gain = [hit / took for _, hit, took in found]
        assert gain == sorted(gain, reverse=True) and {r.name for r, _, _ in found} == {r.name for r in quality.RULES}
        cost = {r.name: took for r, _, took in found}
        # What is counted already costs less than what isn't; repeated words cost most where they aren't.
        assert max(cost, key=cost.get) == "repeated_words" if counted is None else cost["repeated_words"] < cost["upper_case"]


def test_sample_is_of_all_rows(spark):
    d = spark.range(0, 20_000, numPartitions=8).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")
    )
    got = [int(r.text[5:]) for r in quality._sample(d, 500).collect()]
    assert 350 < len(got) < 650 and all(sum(a <= x < a + 5000 for x in got) > 60 for a in range(0, 20_000, 5000))
    assert quality._sample(spark.createDataFrame([(1, "x" * 40_000), (2, None)], "doc_id long, text string"), 500).count() == 1


# -- 5


def plain_components(fp, near):
    at = list(range(len(fp)))

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, j in itertools.combinations(range(len(fp)), 2):
        if near(i, j):
            a, b = sorted((top(i), top(j)))
            at[b] = a
    return [top(i) for i in range(len(fp))]


def plain_simhash(t, words=4):
    w = t.encode().lower().split()
    s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_a_plain_version(spark, docs, texts):
    ids = sorted(texts)
    fp = [plain_simhash(texts[i]) for i in ids]
    want = plain_components(fp, lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4)
    got = {r.doc_id: r for r in simhash.link(docs).collect()}
    assert [got[i].fp % 2**64 for i in ids] == fp
    assert [got[i].component_id for i in ids] == [ids[k] for k in want]


@pytest.mark.parametrize("tau", [3, 4, 8])
def test_links_join_all_that_is_near(spark, tau):
    rng = np.random.default_rng(tau)
    base = rng.integers(0, 2**63, 60, np.int64)
    flips = [int(b) ^ sum(1 << int(x) for x in rng.choice(63, rng.integers(0, tau + 3), replace=False)) for b in base for _ in range(6)]
    fp = sorted(set(flips))
    nodes = spark.createDataFrame(list(enumerate(fp)), "node long, fp long")
    want = plain_components(fp, lambda i, j: (fp[i] ^ fp[j]).bit_count() <= tau)
    for block in (simhash.BLOCK, 5):  # with five rows a block, most buckets are dealt in blocks
        made = simhash.links(nodes, tau, block, direct=block == 5).collect()
        assert block != 5 or all((fp[r.u] ^ fp[r.v]).bit_count() <= tau for r in made)
        roots = {r.v: r.root for r in simhash.components(spark.createDataFrame(made or [(0, 0)], "u long, v long")).collect()}
        assert [roots.get(i, i) for i in range(len(fp))] == want


def test_a_hot_bucket_is_dealt_in_blocks(spark):
    """40,000 fingerprints that share their upper half: one bucket of a partition in it, above a block."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**31, 39_000, np.int64)
    near = base[:1000] ^ (1 << rng.integers(0, 31, 1000)) ^ (1 << rng.integers(0, 31, 1000))
    fp = np.unique(np.r_[base, near]) | (1 << 40)
    nodes = spark.createDataFrame([(int(x), int(x)) for x in fp], "node long, fp long")
    roots = {r.v: r.root for r in simhash.components(simhash.links(nodes, 2)).collect()}
    by, at = {}, {int(x): int(x) for x in fp}

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for x in at:  # every fingerprint's neighbours, by flipping bits
        for i in range(31):
            for j in range(i, 31):
                y = x ^ (1 << i) ^ ((1 << j) if j > i else 0)
                if y in at and y > x:
                    by.setdefault(x, []).append(y)
    for x, ys in by.items():
        for y in ys:
            a, b = sorted((top(x), top(y)))
            at[b] = a
    assert {x: roots.get(x, x) for x in at} == {x: top(x) for x in at}


def test_steps_of_components_are_planned_apart(spark, monkeypatch):
    """The driver plans and compiles one star step at a time, a join in three parts, and none for links that are stars."""
    joins, keep = [], simhash.shared

    def counted(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return keep(df)

    monkeypatch.setattr(simhash, "shared", counted)
    rng = np.random.default_rng(3)
    name = rng.permutation(60).tolist()
    path = [(name[i], name[i + 1]) for i in range(39)]
    tree = [(name[i], name[int(rng.integers(40, i))]) for i in range(41, 60)]
    got = {r.v: r.root for r in simhash.components(spark.createDataFrame([*path, *tree, path[0]], "u long, v long")).collect()}
    assert {x: got.get(x, x) for x in name} == {x: min(part) for part in (name[:40], name[40:]) for x in part}
    assert max(joins) == 3
    joins.clear()
    stars = spark.createDataFrame([(1, 7), (5, 1), (2, 6), (6, 2), (3, 3)], "u long, v long")
    assert sorted(simhash.components(stars).collect()) == [(5, 1), (6, 2), (7, 1)]
    assert joins == [0]


def test_a_bucket_of_near_copies_gives_a_link_each():
    rng = np.random.default_rng(1)
    fp = np.unique(
        np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    )
    got = simhash.bucket_links(fp, 4)
    assert len(got) == len(fp) - 1


def test_plan_obeys_the_pigeonhole():
    rng = np.random.default_rng(3)
    for tau in (2, 4, 8):
        for n in (100, 10**6, 10**10):
            parts = simhash.plan(rng.integers(0, 2**63, 5000, np.int64).view(np.uint64), n, tau)
            assert sorted(b for own, _ in parts for b in own) == list(range(64)) and sum(t + 1 for _, t in parts) == tau + 1


def plain_shingle_set(t, words=5):
    w = t.encode().lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def plain_near(texts, words=5):
    """The smallest doc_id of each text's group, by the similarity of every two sets of shingles."""
    ids = sorted(texts)
    sets = [plain_shingle_set(texts[i], words) for i in ids]

    def near(i, j):
        a, b = sets[i], sets[j]
        if not a or not b or 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
            return not a and not b
        return 5 * len(a & b) >= 4 * len(a | b)

    return dict(zip(ids, [ids[k] for k in plain_components(sets, near)]))


def test_near_dedup_equals_brute_force(spark, docs, texts):
    got = {r.doc_id: r.component_id for r in neardup.members(docs).collect()}
    assert got == plain_near(texts)


def _planted(kind, like, rnd):
    """Two texts of 120 to 1500 words whose similarity is `like` or little more."""
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    a = [word() for _ in range(rnd.randint(120, 1500))]
    b, k, last = a, 0, a
    while True:
        k += 1
        if kind == "scattered":
            b = list(last)
            b[rnd.randrange(len(b))] = word()
        elif kind == "replaced":
            b = a[: len(a) // 3] + [word() for _ in range(k)] + a[len(a) // 3 + k :]
        elif kind == "appended":
            b = a + [word() for _ in range(k)]
        else:
            b = a[: len(a) - k]
        x, y = plain_shingle_set(" ".join(a)), plain_shingle_set(" ".join(b))
        if len(x & y) / len(x | y) < like:
            return " ".join(a), " ".join(last)
        last = b


@pytest.mark.parametrize("kind", ["scattered", "replaced", "appended", "cut"])
def test_near_dedup_finds_texts_at_the_threshold(spark, kind):
    """Of 100 pairs just at 0.8 nine in ten are found at least, whatever the edit."""
    rnd = random.Random(kind)
    rows = [(2 * i + k, t) for i in range(100) for k, t in enumerate(_planted(kind, 0.8, rnd))]
    left = neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert left <= 110 and left >= 100


def test_a_group_of_near_copies_below_the_threshold_stays(spark):
    """400 texts, each two of which share a little under 0.8 of their shingles, but for some pairs that share more."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(400)]
    rows = [(i, " ".join(base + [word() for _ in range(55)])) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " " + word()) for i in range(0, 400, 40)]
    got = {r.doc_id: r.component_id for r in neardup.members(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 1000 for i, _ in rows} == plain_near(dict(rows))


def test_alike_joins_what_brute_force_joins():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(2, 40))
        base = rng.integers(0, 2**62, 60)
        own = [np.unique(np.r_[rng.choice(base, rng.integers(40, 60), replace=False), rng.integers(0, 2**62, rng.integers(0, 9))]) for _ in range(n)]
        root = rng.integers(0, n, n)
        links = neardup.alike(np.concatenate(own), np.r_[0, np.cumsum([len(x) for x in own])], root)
        sets = [set(x.tolist()) for x in own]
        near = lambda i, j: root[i] == root[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
        want = plain_components(sets, near)
        ends = [int(r) for r in root]
        joined = plain_components(ends, lambda i, j: ends[i] == ends[j] or (ends[i], ends[j]) in links or (ends[j], ends[i]) in links)
        assert joined == want and len(links) == len(set(ends)) - len(set(want))


# -- 6


def plain_lines(texts, size=3):
    seen, out = set(), {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        said = [k for k, x in enumerate(lines) if SPACE.search(x)]
        gone = set()
        for j in range(len(said) - size + 1):
            key = tuple(lines[k].strip(" ") for k in said[j : j + size])
            gone |= set(said[j : j + size]) if key in seen else set()
            seen.add(key)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone), sorted(gone)
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", " a ", "", "  "]), max_size=9).map("\n".join), min_size=1, max_size=6))
def test_line_windows_on_small_texts(spark, some):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.removed) for r in linedup.clean(d).select("row.doc_id", "text", "removed").collect()}
    assert got == plain_lines(dict(enumerate(some)))


def test_line_windows_of_a_notice_in_half_the_documents(spark):
    notice = "\n".join(["all rights", "are kept", "by nobody", "at all"])
    rows = [(i, f"own {i}\n" + notice * (i % 2) + f"\nend {i}") for i in range(900)]
    got = {
        r.doc_id: (r.text, r.removed) for r in linedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "text", "removed").collect()
    }
    assert got == plain_lines(dict(rows)) and sum("by nobody" in t for t, _ in got.values()) == 1


def test_line_windows_equal_a_plain_version(docs, texts):
    got = {r.doc_id: (r.text, r.removed) for r in linedup.clean(docs).select("row.doc_id", "text", "removed").collect()}
    assert got == plain_lines(texts)


# -- 7


@pytest.mark.parametrize("chunk,overlap", [(65_536, 2_048), (300, 60), (50, 20), (20, 3)])
def test_bpe_by_chunks_equals_the_library(spark, docs, texts, chunk, overlap):
    c = bpe.coder(*bpe._where(None, None))
    odd = ["", " ", "a" * 500, "\n" * 200 + "x", "don't  we'll\n\n 12 ", "漢字かな " * 40, "👍🏽 é ​" * 30, "<|endoftext|>", "x \x1c\x85\xa0 y"]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    want = texts | {-1 - i: t for i, t in enumerate(odd)}
    got = bpe.encode(d, chunk=chunk, overlap=overlap).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.ids == c.encode(want[r.doc_id]) and c.decode(r.ids).decode() == want[r.doc_id]


def test_bpe_of_many_long_texts(spark, texts):
    """200 texts of a megabyte, as few repeated ones, held against the library on one of each."""
    c, long = bpe.coder(*bpe._where(None, None)), sorted(texts.values(), key=len)[-4:]
    some = [(t * (1 + 1_000_000 // len(t)))[:1_000_000] for t in long]
    d = spark.range(200, numPartitions=4).select(F.col("id").alias("doc_id"), (F.col("id") % 4).alias("k")).join(
        spark.createDataFrame(list(enumerate(some)), "k long, text string"), "k"
    )
    want = {k: hashlib.sha256(" ".join(map(str, c.encode(t))).encode()).hexdigest() for k, t in enumerate(some)}
    got = bpe.digests(bpe.encode(d.select("doc_id", "text"))).select("doc_id", "ids_sha256").collect()
    assert len(got) == 200 and all(r.ids_sha256 == want[r.doc_id % 4] for r in got)


# -- 8

PIECE = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", " ", "\n", "é", "x"])


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECE, max_size=12).map("".join))
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(pa.array([text]))[0].as_py()
    assert chat.unescape(hidden) == text and not any(c in hidden for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_chats_read_back(spark):
    rnd = random.Random(5)
    say = lambda: "".join(rnd.choice(["</s>", "[INST]", " ", "\\", "a", "é\n", "[/INST]", "", "漢"]) for _ in range(rnd.randint(0, 12)))
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "a[/INST]b"]), say()) for c in range(300) for t in range(rnd.randint(1, 9))]
    rnd.shuffle(rows)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(d)).collect()}
    for c in range(300):
        own = sorted((t, r, x) for k, t, r, x in rows if k == c)
        loss = "".join(x for _, r, x in own if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.loss_chars, g.loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()


def test_scatter_in_blocks(monkeypatch):
    rows = pa.table({"conv_id": [1, 1, 2, None], "role": ["user", "assistant", "assistant", "user"], "text": ["x" * 50, "é" * 30, "", "y"]})
    said = lambda: [r for b in chat.assemble(rows) for r in b.to_pylist()]
    want = said()
    monkeypatch.setattr(chat, "_BLOCK", 7)
    assert said() == want and want[2]["conv_id"] is None
    for size, batches in ((1, 3), (200, 2), (10_000, 1)):
        monkeypatch.setattr(chat, "_BATCH", size)
        assert said() == want and len(list(chat.assemble(rows))) == batches


# -- 9


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(6).integers(-(2**63), 2**63 - 1, 3000, np.int64)
    for n in (1, 2, 24, 1000):
        got, more = shards.jump(keys, n), shards.jump(keys, n + 1)
        assert got.tolist() == [plain_jump(int(k) % 2**64, n) for k in keys]
        assert set(more[got != more]) <= {n}
    assert np.bincount(shards.jump(np.arange(24_000), 24)).min() > 800


def test_slots_are_gapless(spark, docs, texts):
    got = shards.assign(docs.repartition(5), 24).collect()
    key = {r[0]: r[1] % 2**64 for r in docs.select("doc_id", F.xxhash64("doc_id")).collect()}
    by = {}
    for r in got:
        assert (r.shard, r.grown_shard) == (plain_jump(key[r.doc_id], 24), plain_jump(key[r.doc_id], 25))
        by.setdefault(r.shard, []).append(r.slot)
        assert r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert len(got) == len(texts) and all(sorted(s) == list(range(len(s))) for s in by.values())


# -- 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(lengths):
    where, offset, fill = packing.best_fit(np.array(lengths, np.int64), 50)
    for b in range(len(fill)):
        own = sorted((int(offset[i]), lengths[i]) for i in range(len(lengths)) if where[i] == b)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == fill[b] <= 50
    assert sum(2 * f <= 50 for f in fill) <= 1


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_merge_of_counts_is_best_fit(count):
    lengths = [n for n, k in count.items() for _ in range(k)]
    runs, bins = packing.merge_counts(count, 50)
    held, seen = {}, Counter()
    for n, a, e, first, per, at in runs:
        assert a == seen[n]
        seen[n] = e
        for k in range(a, e):
            held.setdefault(first + (k - a) // per, []).append((at + (k - a) % per * n, n))
    assert seen == count
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
    fill = {b: sum(n for _, n in own) for b, own in held.items()}
    assert fill == {b: f for a, e, f in bins for b in range(a, e)}
    assert sorted(fill.values()) == sorted(packing.best_fit(np.array(lengths, np.int64), 50)[2].tolist())


@pytest.mark.parametrize("parts,fan,leaf", [(64, 4, 1_000_000), (8, 2, 50)])
def test_packing_merges_every_underfull_bin(spark, parts, fan, leaf):
    """All bins of the tasks are underfull; in the end no two of them fit into one sequence with a light one."""
    rnd = random.Random(parts)
    rows = [(i, " ".join(["w"] * rnd.choice([20, 90, 150, 200, 290, 300, 330]))) for i in range(parts * (3 if leaf > 50 else 500))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
    got = packing.pack(d, size=512, fan=fan, leaf=leaf).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(got) == len(rows) and all([o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] for s in by.values())
    fill = sorted(sum(n for _, n in s) for s in by.values())
    assert fill[-1] <= 512 < fill[0] + fill[1]


@pytest.mark.parametrize("parts,fan", [(1, 16), (7, 2), (7, 16)])
def test_packing_places_every_piece(spark, docs, texts, parts, fan):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = {-1: "", -2: "İstanbul’s 漢字 ½", -3: "don't we'll!! x\x1cy", -4: "a" * 300}
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(odd.items()), "doc_id long, text string")).repartition(parts)
    rows = packing.pack(d, size=512, fan=fan, with_ids=True).collect()
    want = {}
    for i, t in (texts | odd).items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 512):
            want[i, k // 512] = (k, ids[k : k + 512])
    assert {(r.doc_id, r.piece): (r.start, r.ids) for r in rows} == want and len(rows) == len(want)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 512
    total = sum(n for s in by.values() for _, n in s)
    assert len(by) <= -(-total // 512) * 1.02 + 2


def test_words_are_encoded_as_the_library_does():
    c, rnd = packing.WordCoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(3)
    c.CACHE = 50
    parts = [
        " ", "\n", "\xa0", "a", "É", "ß", "²", "½", "1", "'s", "'S", "'", "'ll", "DON", "!!'", "漢", "İ", "\x1c", "\x85", "_", "<|endoftext|>", "é",
        "ab", "µ", "ª", "x" * 70
    ]
    for _ in range(300):
        some = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(5)]
        for t, got in zip(some, c.encode(some)):
            assert np.frombuffer(got, "<u4").tolist() == c.tok.encode(t, add_special_tokens=False).ids


def _paragraphs(n, k):
    return [" ".join(f"word{i}x{j}" for j in range(k)) + "." for i in range(n)]


def test_html_keeps_sections_beside_the_densest_one():
    links = "".join(f"<li><a href=/{i}>link {i} text</a></li>" for i in range(12))
    a, b = _paragraphs(5, 12), _paragraphs(3, 4)
    p = lambda ps: "".join(f"<p>{x}</p>" for x in ps)
    page = f"<body><div><ul>{links}</ul></div><div><h1>Head</h1><div>{p(a)}</div><div>{p(b)}</div></div><div><ul>{links}</ul></div></body>"
    assert html.extract(page) == "\n\n".join(["Head", *a, *b])
