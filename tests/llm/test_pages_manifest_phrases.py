"""Page text, manifest and phrases against brute force, on given tables and on small and odd ones."""

import collections
import hashlib
import html
import random
import re
import time
import zlib

import duckdb
import pytest

from tidewright.llm import collocations, html_extraction, merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
P = "The report of the council was read by all of the members, and it is said that they had been in the hall for hours."


def both(spark, name, sf_dir, table):
    got = [tuple(r) for r in queries.queries()[name](spark, sf_dir).collect()]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        want = db.sql(queries.oracle_sql()[name]).fetchall()
    return sorted(got, key=repr), sorted(want, key=repr)


# --- page text


def test_pages_equal_their_articles(spark):
    """Every article of the given pages, whole, and nothing else."""
    rows = queries.op11_html_extraction(spark, "/root/testdata/sf0.01").collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S).group(1)
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:h1|p)>", article.replace("<br>", " "))]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><div class=menu><a href=a>One</a> <a href=b>Two</a></div><div><h2>Head</h2><p>{P}</p><p>Short.</p><p>{P} &lt;b&gt; &eacute;</p></div><div class=comments><p>{P}</p></div><div>Copyright 2020</div>", f"Head\n{P}\nShort.\n{P} <b> é"),
        (f"<header><h1>Site</h1></header><main><div class='cookie-notice'>{P}</div><header><h1>Head</h1></header><p>{P}<p>Tiny<ul><li>a<li>b</ul><aside>{P}</aside><section id='comments'><article class='comment'>{P}</article></section></main><footer>f</footer>", f"Head\n{P}\nTiny\na\nb"),
        (f"<article><p title=it's a=\"x>y\">{P}</p><p class=\"z>Open {P}</p></article>", f"{P}\nOpen {P}"),
        (f"<article><p>{P}</p><script>if (a<b) write('<p>no</p>')</script ><style>p{{}}</style><!-- <p>no</p> --><p>1 < 2 &amp; 3</p></article>", f"{P}\n1 < 2 & 3"),
        (f"<article><p>{P}<br>b\n c&nbsp;d</p></article>", f"{P} b c d"),
        (f"<main><form><p>{P}</p><label>a</label></form><p>Kept.</p></main>", "Kept."),
        (f"<div id=sidebar>{P}</div><div id=content><div>Uno.</div><div>xyzzy plugh</div></div>", "Uno.\nxyzzy plugh"),
        (f"<article><p>{P}</p><ul class=related><li><a>x</a></ul><p><a>one link</a> | <a>two links</a></p><p>See <a>it</a> there.</p></article>", f"{P}\nSee it there."),
        ("<nav>only<p>menu", ""),
        ("<article><p>a</p><p unended", "a"),
    ],
)
def test_pages_by_hand(page, want):
    assert html_extraction.main_text(page) == want


def test_short_blocks_follow_their_neighbours():
    far = "<div>" + " ".join(f"<a>link {i}</a>" for i in range(30)) + "</div>"
    page = f"{far}<div>near links</div><p>{P}</p><div>near text</div><div>between</div><p>{P}</p>"
    assert html_extraction.main_text(page) == f"near links\n{P}\nnear text\nbetween\n{P}"  # a tie is good
    page = f"{far}<div>near links</div><div>away</div><div>nearer text</div><div>x</div><p>{P}</p>"
    assert html_extraction.main_text(page) == f"nearer text\nx\n{P}"


def test_pages_odd_rows(spark):
    df = spark.createDataFrame([(None, None, "a", 1), (1, "", None, 2), (2, f"<p>{P}" * 3000, "t", 3), (2, f"<p>{P}" * 3000, "t", 3)], "page_id long, html string, `TEXT` string, `a.b` long")
    rows = html_extraction.extract_text(df).collect()
    assert sorted((r["page_id"] is None, r["page_id"], r["n_chars"], r["a.b"]) for r in rows) == [(False, 1, 0, 2), (False, 2, 3000 * (len(P) + 1) - 1, 3), (False, 2, 3000 * (len(P) + 1) - 1, 3), (True, None, 0, 1)]
    assert html_extraction.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<b>" * 50_000, "<div>" * 50_000, '<p a="x' * 50_000, "<li>" * 50_000, "<" * 50_000, "<table>" + "<b>" * 20_000 + "<td>x" * 20_000, "&" * 50_000, "<script>" * 20_000, "<!--" * 20_000, "</p" * 20_000])
def test_pages_take_linear_time(page):
    began = time.time()
    html_extraction.main_text(page)
    assert time.time() - began < 5


# --- manifest


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_manifest(rows):
    """Roots and proofs by plain lists: {(source, place): ...}."""

    def leaf(r, text):
        return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], text)])

    def climb(nodes):
        levels = [nodes]
        while len(nodes) > 1:
            nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
            levels.append(nodes)
        return levels

    def path(levels, at):
        for level in levels[:-1]:
            run = at // 16 * 16
            yield level[run:at], level[at + 1 : run + 16]
            at //= 16

    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = climb([trees[s][-1][0] for s in sources])
    out = []
    for i, s in enumerate(sources):
        for at, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            p = [*path(trees[s], at), *path(top, i)]
            cur = leaf(r, lower(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else own
            for a, b in p:
                cur = h(*a, cur, *b)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], h(*[x for a, b in p for x in a + b]), cur, cur == top[-1][0], s, at))
    return sorted(out, key=repr)


def test_manifest_matches_sql(spark):
    got, want = both(spark, "op12_merkle_manifest", "/root/testdata/sf0.01", "documents")
    assert got == want and any(r[6] for r in got) and not all(r[6] for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 255, 256, 257, 300, 4095, 4096])
def test_paths_of_blocks(n):
    leaves = [h(str(i)) for i in range(n)]
    paths = list(merkle.walk(leaves, merkle.height(n)))
    assert len(paths) == n
    if n:
        root = merkle.root_of(leaves, merkle.height(n))
        assert all(merkle.folded(leaf, p) == root for leaf, p in zip(leaves, paths))


def test_a_lone_last_block_is_hashed_up():
    """17 leaves: the second run has one node, which becomes its own digest."""
    leaves = [h(str(i)) for i in range(17)]
    assert merkle.root_of(leaves, 2) == h(h(*leaves[:16]), h(leaves[16]))


def test_manifest_of_many_blocks_and_sources(spark, monkeypatch):
    """Several levels of blocks, with blocks of 16 leaves, and more sources than one run holds."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    random.seed(3)
    rows = [(i, random.choice(["A b", "", None, "É", "x" * 99]), "en", "big" if i % 3 else f"s{i % 40}", i % 7) for i in range(900)]
    rows += [(None, "Null", None, None, None), (None, "Other", None, None, None), (5, "A", "en", "lone", 1), (7, "Same", "en", "twice", 1), (7, "Same", "en", "twice", 1)]
    random.shuffle(rows)
    got = sorted([tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(7)).collect()], key=repr)
    assert got == plain_manifest(rows)


def test_manifest_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.manifest(empty).count() == 0
    one = spark.createDataFrame([(3, "T", None, None, None)], DOCS)
    (row,) = merkle.manifest(one.withColumns({"g": one.doc_id, "POS": one.text, "leaf": one.lang})).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == h("1:3", "-", "-", "-", "1:T") and row["proof_sha256"] == h()


# --- phrases


def plain_phrases(rows, least=30, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    drop = {(lang, p[i : i + k]) for (lang, p), a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * f[lang, p[i : i + k]]}
    out = []
    for lang in n:
        rows = []
        for (of, p), a in found.items():
            if of == lang and (of, p) not in drop:
                score, _, l, r = min((2000000 * a // (f[of, p[:k]] + f[of, p[k:]]), k, f[of, p[:k]], f[of, p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def test_phrases_match_sql(spark):
    got, want = both(spark, "op13_collocations", "/root/testdata/sf0.001", "documents")
    assert got == want


@pytest.mark.parametrize("sizes", [(1 << 22, 1 << 21, 1 << 16, 1 << 18), (50, 40, 7, 16)])
def test_phrases_match_loops(spark, sizes):
    """In one block, and in blocks, buckets, segments and slices so small that phrases cross all of them."""
    random.seed(5)
    words = ["a", "B", "cc", "Été", "x-y", " ", "d\x1fe", "longer-word-than-a-slice"]
    rows = [(random.choice(["en", "fr", None, "und"]), "".join(random.choice(words) + random.choice([" ", " ", " ", "\t ", ". ", "\n", "!?"]) for _ in range(random.choice([0, 3, 40, 400])))) for _ in range(60)]
    rows += [("en", None), ("en", ""), (None, " "), ("xx", "never often enough"), ("en", "a a a a a a " * 20), ("en", "a a a a a a " * 20)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df.withColumns({"id": df.lang, "f": df.text, "score": df.text}), top=40, sizes=sizes).collect())
    assert got == plain_phrases(rows, top=40) and {r[0] for r in got} >= {"en", "und"}


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(df).count() == 0


def test_scores_pass_64_bits(spark):
    rows = spark.createDataFrame([(9_000_000_000_000_000, 9_000_000_000_000_000, 9_000_000_000_000_001)], "f long, l long, r long")
    (row,) = rows.selectExpr("CAST(f AS DECIMAL(19,0)) * 2000000 DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0))) AS score").collect()
    assert row["score"] == 2000000 * 9_000_000_000_000_000 // 18_000_000_000_000_001
