import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer
from test_texts import WORD, brute_lines, brute_spans

import corpus_pipeline
from sigaudit.llm import html_blocks, jaccard_join, main_text, packing, secrets, signature_tree
from sigaudit.llm.bpe import LibraryCodec
from sigaudit.llm.bpe_coding import tokenizer_path
from sigaudit.llm.components import components


def shingle_set(text, k):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    both = defaultdict(int)
    for ids in holders.values():
        for a in range(len(ids)):
            for b in range(a):
                both[ids[b], ids[a]] += 1
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def variants(seed, n, words, edits):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        w = list(base)
        for j in rng.integers(0, words, rng.integers(0, edits + 1)):
            w[j] = f"e{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_components_are_brute_force(spark, docs_of, documents, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 2000)
    monkeypatch.setattr(jaccard_join, "ROW", 1)
    monkeypatch.setattr(jaccard_join, "COMMON_FROM", 4)
    texts = variants(1, 40, 120, 6) + variants(2, 12, 30, 1) + variants(3, 25, 300, 18) + ["A b C d", "a B c D", "one two", "One  two", "", None, "  ", "x" * 300000, "q " * 30000]
    rows = list(enumerate(texts))
    for df, given in ((docs_of([*rows, rows[0], rows[3]]), rows), (documents, [tuple(r) for r in documents.select("doc_id", "text").collect()])):
        want = brute_components(given, k, percent)
        got = jaccard_join.jaccard_components(df, k, percent).collect()
        assert len(got) == df.count()
        for r in got:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def test_jaccard_edges(spark, docs_of):
    assert jaccard_join.jaccard_components(docs_of([])).count() == 0
    got = jaccard_join.jaccard_components(docs_of([(None, "a b c d e"), (None, None), (4, "a b c d e")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in got) == [(0, 0, None), (0, 1, None), (4, 1, 4)]


def test_repeated_ids_are_one_document(docs_of, monkeypatch):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(3, b), (5, a), (5, b), (7, a), (8, ""), (8, a + " end"), (9, "apart from all of the others"), (9, None)]
    for listed in (200_000, -1):
        monkeypatch.setattr(jaccard_join, "LISTED", listed)
        got = jaccard_join.jaccard_components(docs_of(rows), 5, 80).collect()
        assert {(r["doc_id"], r["component_id"]) for r in got} == {(3, 3), (5, 3), (7, 3), (8, 3), (9, 9)} and len(got) == len(rows)


def test_tree_finds_every_link(monkeypatch):
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**63, rng.integers(1, 80)).astype(np.uint64)) for _ in range(12)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.05], rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64)])) for b in base for _ in range(12)]
    n = len(sets)
    width = signature_tree.width_for(80)
    i, j = signature_tree.tree_pairs(np.stack([signature_tree.bitmap(x, width) for x in sets]), np.array([max(len(x), 1) for x in sets]), np.arange(n), np.arange(n), 80)
    found = {frozenset(p) for p in zip(i.tolist(), j.tolist(), strict=True)}
    linked = {frozenset((a, b)) for a in range(n) for b in range(a) if len(sets[a]) and len(sets[b]) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert linked <= found and len(found) < n * (n - 1) // 2
    parent = list(range(n))
    for a, b in map(sorted, linked):
        parent = [parent[a] if p == parent[b] else p for p in parent]
    group = lambda labels: {frozenset(np.flatnonzero(np.array(labels) == x).tolist()) for x in labels}
    for limit in (1 << 25, 0):
        monkeypatch.setattr(signature_tree, "EXACT_BYTES", limit)
        assert group(signature_tree.tree_labels(sets, np.arange(n), 80).tolist()) == group(parent)


def test_connected_components(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(400 + i, 401 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"))[0].collect()}
    assert got == {i: find(i) for i in range(500) if find(i) != i}


# packing


def check_packing(rows, docs, codec):
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for doc_id, text in docs:
        ids = [*codec.encode(text or ""), 2]
        own = sorted(by[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:])
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_packing(spark, docs_of, documents):
    codec = LibraryCodec(tokenizer_path())
    given = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    rows = packing.pack_documents(documents, tokenizer_path()).collect()
    used = check_packing(rows, given, codec)
    assert used <= 1.02 * -(-sum(r["length"] for r in rows) // 1024) + 1
    edges = [(1, None), (2, ""), (3, "a"), (4, "word " * 5000), (5, "x")]
    check_packing(packing.pack_documents(docs_of(edges), tokenizer_path()).collect(), edges, codec)
    assert packing.pack_documents(docs_of([]), tokenizer_path()).count() == 0
    hard = [(1, " " * 1_000_000), (2, "x" * 300_000), (3, ("word" + " " * 5000 + "\n" * 700) * 20), (4, "\t \u3000" * 40_000), (5, "é" * 100_000)]
    library = Tokenizer.from_file(tokenizer_path())
    for _, text in hard:
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids
    check_packing(packing.pack_documents(docs_of(hard), tokenizer_path()).collect(), hard, codec)
    many = [(i, None) for i in range(3000)] + [(3000 + i, "a " * (i % 700)) for i in range(500)]
    used = check_packing(packing.pack_documents(docs_of(many).repartition(7), tokenizer_path()).collect(), many, codec)
    assert used <= 1.02 * -(-sum(len(codec.encode(t or "")) + 1 for _, t in many) // 1024) + 1
    twice = packing.pack_documents(docs_of([(3, "a"), (3, "a")]), tokenizer_path()).collect()
    assert len(twice) == 2 and sorted(r["offset"] for r in twice) == [0, 2]


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    count = np.bincount(np.minimum(1024, rng.lognormal(5, 1.2, 4000).astype(int) + 1), minlength=1025)
    used = np.zeros(1025, int)
    plan = packing.plan(count)
    for lengths, n in plan:
        assert n > 0 and sum(lengths) <= 1024
        for v in lengths:
            used[v] += n
    assert (used == count).all() and sum(n for _, n in plan) <= 1.01 * -(-(count @ np.arange(1025)) // 1024) + 1


# pages


FRAME = '<nav><a href=a>Home</a> <a href=b>All of it</a></nav><div class="ad">Buy this now, it is good.</div>'
PAGE = f'<html><head><title>T</title><script>var x="<p>no</p>"</script></head><body>{FRAME}<article><h1>Head&amp;line</h1><p>First  para<b>graph</b> of\ttext.<p>Second &eacute;.<br>More.</p><div class="comments"><p>I liked this text very much.</p></div></article><footer>&copy; us</footer></body>'


def test_main_text(spark):
    assert main_text.main_text(PAGE) == "Head&line\nFirst paragraph of text.\nSecond é. More."
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p>"), (5, "u", "<script>x"), (6, "u", FRAME), (7, "u", PAGE[: PAGE.index("More") + 2] + "&am"), (8, "u", "<article>" + "<p>Some words of text here.</p>" * 3000 + "</article>")]
    got = main_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")).orderBy("page_id").collect()
    assert len(got) == 9 and [r["text"] for r in got[2:7]] == [""] * 5 and got[7]["text"].endswith("Second é. Mo&am") and len(got[8]["text"].split("\n")) == 3000
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert main_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_main_text_without_marked_parts():
    long = "<p>This paragraph has plenty of words in it, and it ends as sentences do.</p>"
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div>{long}<p>Short one.</p>{long}</div><div><a href=4>More</a></div></body>"
    assert main_text.main_text(page).count("\n") == 2


def test_cut_is_minimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        odds = rng.normal(0, 2, n)
        links = [(i - 1, i, float(rng.uniform(0, 2))) for i in range(1, n)] + [(int(a), int(b), float(rng.uniform(0, 1))) for a, b in rng.integers(0, n, (3, 2)) if a != b]
        cost = lambda s: sum(max(o, 0) for o, x in zip(odds, s) if not x) + sum(max(-o, 0) for o, x in zip(odds, s) if x) + sum(c for a, b, c in links if s[a] != s[b])  # noqa: B023, E731
        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cost(main_text.source_side(odds, links).astype(int).tolist()) == pytest.approx(best)


def anonymous(html):
    """The page without any tag or class that tells its parts, and with a third of its paragraphs beginning with a list."""

    def listed(m):
        words = re.sub(r"<[^>]*>", "", m[1]).split()
        if len(words) % 3 or len(words) < 9:
            return "<p>" + m[1]
        return "<ul>" + "".join("<li>" + " ".join(words[k : k + 3]) + "</li>" for k in range(0, 9, 3)) + "</ul><p>" + " ".join(words[9:])

    marked = re.sub(r"(<article>.*</article>)", lambda a: re.sub(r"<p>((?:(?!</?p>|</article>).)*)", listed, a[1]), html, flags=re.S)
    return marked, re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(nav|article|footer)\b", r"<\1div", marked))


def test_cut_mends_labels_of_the_classifier(spark, small):
    pages = spark.read.parquet(f"{small.replace('0.001', '0.01')}/pages.parquet")
    weights = main_text.fit(pages)
    wrong, mended, changed = 0, 0, 0
    for html in [r["html"] for r in pages.select("html").collect()]:
        marked, bare = anonymous(html)
        truth = np.array([b.element.part == "main" for b in html_blocks.blocks(marked)])
        assert main_text.main_text(marked, weights) == "\n".join(b.text for b, t in zip(html_blocks.blocks(marked), truth, strict=True) if t)
        page = html_blocks.blocks(bare)
        alone, cut = main_text.log_odds(page, weights) > 0, main_text.content(page, weights)
        if len(page) == len(truth):
            wrong, mended, changed = wrong + (alone != truth).sum(), mended + (cut != truth).sum(), changed + (alone != cut).sum()
    assert changed > 100 and mended < 0.3 * wrong


def test_cut_on_pages_as_given(spark, small):
    """What the tags say is no feature of the classifier; its errors on pages as they are go by the cut, and with all tags made divs the
    words in names are enough."""
    pages = spark.read.parquet(f"{small.replace('0.001', '0.01')}/pages.parquet")
    weights, alone, cut, bare = main_text.fit(pages), 0, 0, 0
    for html in [r["html"] for r in pages.select("html").collect()]:
        page = html_blocks.blocks(html)
        truth = np.array([p == "main" for p in main_text.tag_parts(page)])
        alone += ((main_text.log_odds(page, weights) > 0) != truth).sum()
        cut += (main_text.content(page, weights) != truth).sum()
        plain = html_blocks.blocks(re.sub(r"<(/?)(nav|article|footer)\b", r"<\1div", html))
        bare += (main_text.content(plain, weights) != truth).sum()
    assert 0 < alone < 20 and cut == 0 and bare <= 5


def test_rights_anywhere_in_a_block():
    assert main_text.features(html_blocks.blocks("<p>" + "word " * 100 + "© someone"))[0, 7] == 1


def test_query_is_brute_force_labelling(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()} | {-1: anonymous(PAGE)[1], -2: "<div>a</div><div>b c d e f g h.</div>"}
    rows = [(i, "u", h) for i, h in html.items()]
    weights = main_text.fit(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    seen = 0
    for r in main_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect():
        page = html_blocks.blocks(html[r["page_id"]])
        if not 0 < len(page) <= 14:
            continue
        odds, links = main_text.capacities(page, weights), main_text.edges(page)
        side = (np.arange(1 << len(page))[:, None] >> np.arange(len(page))) & 1
        cost = side @ np.maximum(-odds, 0) + (1 - side) @ np.maximum(odds, 0) + sum(c * (side[:, a] != side[:, b]) for a, b, c in links)
        best = side[np.argmin(np.round(cost, 9) + 1e-12 * side.sum(axis=1))]
        assert r["text"] == "\n".join(b.text for b, x in zip(page, best, strict=True) if x)
        seen += 1
    assert seen > 5


def test_parts_that_are_not_the_article():
    long = "Some words in a sentence here and there, and it goes on for quite a while so that it is long enough for a paragraph."
    take = lambda h: main_text.main_text(h).replace(long, "L").split("\n")
    assert take(f'<article><p>{long}</p><div class="ad">Buy this now, it is good.</div><p>{long}</p></article>') == ["L", "L"]
    assert take(f'<article><p>{long}</p><aside><p>{long}</p></aside><p>Short.</p><div class="comments"><p>{long}</p><p>ok</p></div></article>') == ["L", "Short."]
    assert take(f'<div class="sidebar-layout"><article><h1>T</h1><p>{long}</p><p>Short.</p></article></div>') == ["T", "L", "Short."]
    assert take(f"<main><h1>T</h1><p>{long}</p></main><aside><article><p>{long}</p></article></aside>") == ["T", "L"]
    assert take(f'<body><div class="cookie-notice"><p>{long}</p></div><div class=story><h2>T</h2><ul><li>one<li>two</ul></div><form>Mail <input></form>') == ["T", "one", "two"]


@pytest.mark.parametrize("piece", ["<script", "<a ", '<a "', '<a b="', "<a b='", "<!--", "<", "</", "<svg>", "<div>", "</p>", "<p>x", "<a =", "&#9", " ="])
def test_hostile_pages_take_linear_time(piece):
    page = "<div>" * 1000 + piece * 50_000
    began = time.time()
    html_blocks.blocks(page)
    assert time.time() - began < 2


def test_numbers_of_characters():
    assert html_blocks.blocks(f"<p>&#0000000065;&#x{'0' * 20}42; &#{'9' * 6000}; &#x{'f' * 6000};c")[0].text == "AB � �c"


def test_blocks_of_malformed_pages():
    got = html_blocks.blocks("<p>a<p>b</div>c<ul><li>d<li>e</ul><table><tr><td>f<td>g</table>h <!-- i --> j<br>k <b")
    assert [b.text for b in got] == ["a", "b", "c", "d", "e", "f", "g", "h j k"]


# pipeline


def test_pipeline_stages_against_brute_force(spark, small, documents):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "jaccard_join", "secret_scan", "packing"]
    docs = stages["quality_classifier"](spark, documents, small).cache()
    assert docs.columns == documents.columns and 0 < docs.count() < documents.count()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    lines = stages["line_dedup"](spark, docs, small).cache()
    assert sorted((r["doc_id"], r["text"]) for r in lines.collect()) == [(i, t) for i, t, _, _ in brute_lines(rows)]
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    rows = [(r["doc_id"], r["text"]) for r in lines.collect()]
    one = stages["jaccard_join"](spark, lines, small).cache()
    assert {r["doc_id"] for r in one.collect()} == {i for i, (_, c) in brute_components(rows, 5, 80).items() if i == c}
    clean = {r["doc_id"]: r["text"] for r in stages["secret_scan"](spark, one, small).collect()}
    for r in one.collect():
        spans = brute_spans(r["text"])
        assert (clean[r["doc_id"]] == r["text"]) == (not spans) and not [s for s in brute_spans(clean[r["doc_id"]]) if s[0] in ("access", "hex")]
    assert secrets.redact(one).count() == one.count()
    packed = corpus_pipeline.run(spark, small).collect()
    check_packing(packed, sorted(clean.items()), LibraryCodec(tokenizer_path()))
    assert {r["doc_id"] for r in packed} == set(clean)
