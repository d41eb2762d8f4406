"""The operators on small rows against brute force, exact round trips and known answers."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import decontam, htmltext, langid, media, neardup, packing, sharding, suffixes, tokencount, urlfilter
from keyloom.llm.common import WordHashes

SF = "/root/testdata/sf0.001"


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- language ID


def test_language_is_right_on_held_out_documents(spark):
    out = langid.op9_language_id(spark, SF).join(documents(spark).select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang_pred = lang").count() >= 0.95 * out.count() > 0


def test_language_scores_equal_plain_naive_bayes(spark):
    """The model and its predictions against counts and sums of n-grams one by one."""
    docs = [(i, t, l) for i, (t, l) in enumerate([("Ünïcode wörter hier", "de"), ("plain words here, 12 of them", "en"), ("слова тут", "ru"), ("more words", "en"), ("Wörter", None)])]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")

    def grams(text):
        flat = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return [flat[i : i + n] for n in langid.ORDERS for i in range(len(flat) - n + 1)]

    bucket = lambda g: int(langid._buckets(np.array([ord(c) for c in g], np.uint32))[-1][0])
    langs, matrix = langid.train(df)
    assert langs == ["de", "en", "ru"]
    for k, lang in enumerate(langs):
        seen = Counter(bucket(g) for _, t, l in docs if l == lang for g in grams(t))
        total = sum(seen.values()) + 0.5 * langid.BUCKETS
        assert np.allclose(matrix[k, :-1], [np.log((seen[b] + 0.5) / total) for b in range(langid.BUCKETS)], atol=1e-5)
    got = {r.doc_id: r.score for r in langid.predict(df, (langs, matrix)).collect()}
    for i, t, _ in docs:
        total = [matrix[k, -1] + sum(matrix[k, bucket(g)].astype(float) for g in grams(t)) for k in range(3)]
        assert got[i] == pytest.approx(1 / sum(np.exp(x - max(total)) for x in total))


def test_language_edges(spark, edge, empty):
    got = langid.predict(edge, langid.fit(edge)).select("text", "lang_pred", "score").collect()
    assert all((r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) and 0 <= r.score <= 1 for r in got)
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(edge, ([], np.zeros((0, 1)))).collect()} == {"und"}
    assert langid.stage(spark, edge, SF).columns == edge.columns


# --- packing


def test_packing_keeps_all_limits():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 5000, 400)
    losses = (sizes * rng.random(400)).astype(int)
    limits = (2048, 6, 1200)
    pieces, _ = packing.pack(sizes, losses, limits)
    seen, bins = defaultdict(list), defaultdict(list)
    for i, at, n, s, offset in pieces:
        loss = max(0, at + n - max(at, sizes[i] - losses[i]))
        seen[i].append((at, n))
        bins[s].append((offset, n, loss))
    for i, parts in seen.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == sizes[i]
    assert len(seen) == len(sizes)
    for parts in bins.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= limits[0] and len(parts) <= limits[1] and sum(p[2] for p in parts) <= limits[2]


def check_pieces(rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing._path())
    own = defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 2048 for b in bins.values())
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))]
    by = defaultdict(list)
    for key, text in texts:
        by[key].append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert set(own) == set(by)
    for key, docs in by.items():  # each id of each of the documents with this key lies in one piece
        left = Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in own[key])
        starts = defaultdict(list)
        for piece in left:
            starts[piece[0]].append(piece)
        for ids in docs:
            at = 0
            while at < len(ids) // 4:
                piece = next(p for p in starts[at] if left[p] and p[3] == len(ids) // 4 and p[1] > 0 and p[2] == zlib.crc32(ids[4 * at : 4 * (at + p[1])]))
                left[piece] -= 1
                at += piece[1]
            assert at == len(ids) // 4
        assert not any(left.values())
    padding = sum(2048 - n for n in (sum(x for _, x in b) for b in bins.values()) if n & (n - 1))
    return padding / sum(r.length for r in rows)


def test_packing_of_documents(spark):
    rows = packing.op2_packing(spark, SF).collect()
    assert check_pieces(rows, [(r.doc_id, r.text) for r in documents(spark).collect()]) < 0.02


def test_ids_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(packing._path()), random.Random(9)
    letters = [*"abcXYZ'sdtll<|>#$ \n\t.,0149", *"éÈßÿİȺ×÷¼ªꝀ\u0301\u00a0\u2028€“中", "<|endoftext|>", "it's", "e\u0301", "'re"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    got = packing._tokenizer(packing._path())(texts)
    for text, own, e in zip(texts, got, t.encode_batch(texts, add_special_tokens=False)):
        assert own.tolist() == e.ids, text


def test_turns_are_packed_whole_within_live_limits(spark):
    """Every id of every turn lies in one piece, no sequence breaks a limit, and the loss limit decides where it is reached."""
    from tokenizers import Tokenizer

    sf = SF.replace("0.001", "0.01")
    tokenizer = Tokenizer.from_file(packing._path())
    turns = {(r.conv_id, r.turn): (r.role, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in spark.read.parquet(f"{sf}/conversations.parquet").dropDuplicates(["conv_id", "turn"]).collect()}
    turns_df = spark.read.parquet(f"{sf}/conversations.parquet").dropDuplicates(["conv_id", "turn"])
    for limits in (packing.TURN_LIMITS, (512, 7, 100)):
        rows = packing.pack_turns(turns_df, packing._path(), limits=limits).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            pieces[r.conv_id, r.turn].append(r)
            sequences[r.sequence_id].append(r)
        assert set(pieces) == set(turns)
        for key, own in pieces.items():
            own.sort(key=lambda r: r.start)
            assert [r.start for r in own] == [sum(p.length for p in own[:i]) for i in range(len(own))] and sum(r.length for r in own) == turns[key][1] == own[0].turn_tokens
            assert all(r.loss_tokens == (r.length if turns[key][0] == "assistant" else 0) for r in own)
        for own in sequences.values():
            own.sort(key=lambda r: r.offset)
            assert [r.offset for r in own] == [sum(p.length for p in own[:i]) for i in range(len(own))]
            assert sum(r.length for r in own) <= limits[0] and len(own) <= limits[1] and sum(r.loss_tokens for r in own) <= limits[2]
    assert max(sum(r.loss_tokens for r in own) for own in sequences.values()) == limits[2]
    assert packing.pack_conversations(spark, SF).count() > 0


def test_packing_edges(spark, edge, empty):
    rows = packing.pack_documents(edge, packing._path()).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in edge.collect()])
    assert packing.pack_documents(empty, packing._path()).count() == 0


# --- URL filters


def test_urls(spark):
    urls = ["https://a.example.com/en/x", "http://WWW.example.com/en/1?q", "http://x.net/es/", "http://x.net/de/", "ftp://h", None, "", "no scheme/com/", "http://www.cheap-pills.org/de/3", "https://news.library.org/en/5#x"]
    df = spark.createDataFrame([(i, u, "y") for i, u in enumerate(urls)], "page_id long, url string, path string")
    got = {r.page_id: r for r in urlfilter.judge(df, urlfilter.train(urlfilter.labelled(spark))).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(6)] == [
        ("a.example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/1", "www.example.com/en/"), ("x.net", "/es/", "net/es/"), ("x.net", "/de/", None), ("h", "", None), ("", "", None)]
    assert (got[0].verdict, got[1].verdict, got[2].verdict) == ("block", "allow", "block")
    assert (got[7].host, got[7].rule) == ("", None) and got[8].verdict == "block" and got[9].verdict == "allow"
    table = urlfilter.judge(urlfilter.labelled(spark), urlfilter.train(urlfilter.labelled(spark)), rules=())
    assert table.where("(verdict = 'block') = (blocked = 1.0)").count() == table.count()


def test_url_query_equals_brute_force(spark):
    """Host, path, rule and verdict of every page against plain Python with the same weights."""
    import xxhash

    weights = urlfilter.train(urlfilter.labelled(spark))
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def bucket(kind, gram):
        return signed(xxhash.xxh64_intdigest(gram.encode(), xxhash.xxh64_intdigest(kind.encode(), 42))) % urlfilter.DIM

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest[: min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
        path = rest[len(host) :]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, max(fits)[2], max(fits)[3]
        marked = f"^{host}$"
        found = {bucket(k, part[i : i + n]) for k, part in (("h", marked), ("p", path)) for n in urlfilter.ORDERS for i in range(len(part) - n + 1)}
        score = sum(weights[b] for b in found) / max(1, len(found)) ** 0.5 + weights[-1]
        return host, path, None, "block" if score >= 0 else "allow"

    sf = SF.replace("0.001", "0.01")
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.op3_url_filters(spark, sf).collect()}
    assert got == {i: judged(u) for i, u in urls.items()} and {v[3] for v in got.values() if v[2] is None} == {"allow", "block"}


def test_urls_held_out(spark):
    """Five folds of the labelled table by host name, each judged by the others' weights. No host label of the pages is in the table."""
    table = urlfilter.labelled(spark).withColumn("fold", urlfilter.same_host_fold(F.col("url"))).cache()
    right = 0
    for k in range(5):
        out = urlfilter.judge(table.where(F.col("fold") == k), urlfilter.train(table.where(F.col("fold") != k)), rules=())
        right += out.where("(verdict = 'block') = (blocked = 1.0)").count()
    assert right >= 0.75 * table.count()
    pages = {label for r in spark.read.parquet(f"{SF.replace('0.001', '0.1')}/pages.parquet").select("url").distinct().collect() for label in r.url.split("://")[1].split("/")[0].split(".")}
    own = {r.host.split(".")[-2] for r in table.select(urlfilter.split_url(F.col("url"))[0].alias("host")).collect()}
    assert not own & pages


def test_url_edges(spark):
    """An empty table, repeated rows, a url of 200,000 characters, no scheme and characters of any kind."""
    df = spark.createDataFrame([(1, "http://a.org/" + "x" * 200_000), (1, "http://a.org/" + "x" * 200_000), (None, None), (2, "://"), (3, "http://ÄÖ\u0130.com/\n?"), (4, "a://b://c")], "page_id long, url string")
    weights = urlfilter.train(urlfilter.labelled(spark))
    got = urlfilter.judge(df, weights)
    assert got.count() == 6 and got.where("page_id = 1").distinct().count() == 1 and urlfilter.judge(df.where("false"), weights).count() == 0
    by = {r.page_id: (r.host, r.path, r.rule) for r in got.collect()}
    assert by[2] == ("", "", None) and by[3] == ("ÄÖ\u0130.com", "/\n", "com/") and by[4] == ("b:", "//c", None)
    assert urlfilter.judge(df, urlfilter.train(urlfilter.labelled(spark).where("false"))).count() == 6


# --- token counts


def test_token_counts_equal_plain_dynamic_programming(spark):
    scores = {"▁a": -1.0, "ab": -1.5, "b": -2.0, "▁": -2.5, "abc": -1.2, "c": -2.0, "▁ab": -4.0}

    def plain(word):
        best = [(0.0, 0)]
        for n in range(1, len(word) + 1):
            size = len(word[n - 1].encode())
            top = (best[n - 1][0] + tokencount.BYTE_SCORE * size, best[n - 1][1] - size)
            for k in range(n):
                if word[k:n] in scores:
                    top = max(top, (best[k][0] + scores[word[k:n]], best[k][1] - 1))
            best.append(top)
        return -best[-1][1]

    rng = random.Random(3)
    words = {"▁" + "".join(rng.choices("abcd", k=rng.randint(0, 9))) for _ in range(300)}
    trie = tokencount.Trie(scores)
    assert {w: trie.count(w) for w in words} == {w: plain(w) for w in words} and trie.nodes < sum(map(len, words))
    long = "▁" + "".join(rng.choices("abcé", k=900))
    assert trie.count(long) == plain(long)


def test_token_counts_of_documents(spark):
    """The query's rows against the plain dynamic program over the real pieces, word by word."""
    import public_tokenizers

    scores = tokencount.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    longest, known = max(map(len, scores)), {}

    def plain(word):
        best = [(0.0, 0)]
        for n in range(1, len(word) + 1):
            size = len(word[n - 1].encode())
            ways = [(best[n - 1][0] + tokencount.BYTE_SCORE * size, best[n - 1][1] - size)]
            ways += [(best[k][0] + scores[word[k:n]], best[k][1] - 1) for k in range(max(0, n - longest), n) if word[k:n] in scores]
            best.append(max(ways))
        return -best[-1][1]

    got = {r.doc_id: r for r in tokencount.op4_token_counts(spark, SF).collect()}
    for r in documents(spark).collect():
        words = (r.text or "").split()
        for w in words:
            if w not in known:
                known[w] = plain("▁" + w)
        assert (got[r.doc_id].n_pretokens, got[r.doc_id].n_tokens) == (len(words), sum(known[w] for w in words))


def test_token_count_edges(spark, edge, empty):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = tokencount.count_tokens(edge, path).collect()
    assert len(got) == edge.count() and all((r.n_pretokens == 0) == (r.n_tokens == 0) for r in got)
    assert max(r.n_pretokens for r in got) == 30_000 and tokencount.count_tokens(empty, path).count() == 0


# --- HTML


def test_articles():
    tree = htmltext.trained()
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site name here</header><nav><a href=/x>One</a> <a href=/y>Two</a></nav>
    <article><h1>Head&amp;line</h1><p>First   <b>bold</b>text<br>more &lt;x&gt; &am <p>Second &eacute;.<div class="share">Share this now</div></article><aside>Side bar text</aside>
    <div id="comments"><p>I disagree with all of this, it is a long comment by a reader of the page.</p></div><form>Name <input></form><footer>&copy; me</footer></body></html>"""
    assert htmltext.article(page, tree) == "Head&line First boldtext more <x> &am Second é."
    plain = "<div><a href=a>Home</a></div><p>" + "word " * 50 + "</p><p>" + "more " * 40 + "</p><div><a href=b>Terms</a></div>"
    assert htmltext.article(plain, tree) == ("word " * 50 + "more " * 40).strip()
    for odd in (None, "", "<p", "<!-- x", "<script>x", "</article></div>", "&#999999999;", "<<>>"):
        assert isinstance(htmltext.article(odd, tree), str)


def test_articles_in_odd_places():
    """Names are whole tokens, a main container resets names around it but not those of comments, paragraphs have names too."""
    tree, text = htmltext.trained(), "This is a sentence of the article that has quite a few words in it."
    for name in ("has-sidebar", "no-comments", "related-posts", "with-nav menu-open", "sidebar", "headerless"):
        assert htmltext.article(f"<div class='{name}'><article><p>{text}</p><p>Short.</p></article></div>", tree) == f"{text} Short.", name
    for name in ("comment", "comments", "reader-comments", "comment-body", "ad", "ad-slot", "newsletter-form", "share-buttons"):
        assert htmltext.article(f"<article><p>{text}</p><p class={name}>{text}</p><div id={name}><p>{text}</p></div></article>", tree) == text, name
    assert htmltext.article(f"<main><p>{text}</p><div class=comments><article><p>{text}</p></article></div></main>", tree) == text
    assert htmltext.article(f"<header><h1>Site</h1></header><article><header><h1>Title</h1><p>By me</p></header><p>{text}</p></article>", tree) == f"Title {text}"


def test_link_density_and_neighbours_decide():
    """In a main container a list of short links goes and a link among text stays; without one text is told from links by its length and density."""
    tree, text = htmltext.trained(), "This is a sentence of the article that has quite a few words in it, and goes on for a while."
    menu = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(6))
    assert htmltext.article(f"<article><p>{text}</p><ul class=x>{menu}</ul><p>{text}</p></article>", tree) == f"{text} {text}"
    assert htmltext.article(f"<article><p>{text}</p><p><a href=x>A link</a></p><p>{text}</p></article>", tree) == f"{text} A link {text}"
    assert htmltext.article(f"<ul class=x>{menu}</ul><p>{text} {text}</p><p>{text} {text}</p><ul>{menu}</ul>", tree) == f"{text} {text} {text} {text}"
    used = set()

    def walk(t):
        if not isinstance(t, int):
            used.add(htmltext.FEATURES[t[0]])
            walk(t[2]), walk(t[3])

    walk(tree)
    assert {"words", "link_density", "main", "boiler"} < used and used & {"prev_links", "next_links", "prev_words", "next_words"}, used


def test_articles_keep_links_headings_and_short_texts():
    tree, w = htmltext.trained(), "word "
    for n in (1, 3, 5, 8, 10, 13, 18, 20, 25, 40):
        for heading in (1, 3, 9):
            page = f"<article><h1>{w * heading}</h1><p><a>{w * n}</a></p><p>{w * 30}</p></article>"
            assert len(htmltext.article(page, tree).split()) == heading + n + 30, (n, heading)
    for tag in ("article", "main"):
        for name in ("post related", "sidebar", "widget ad", "newsletter-form"):
            assert htmltext.article(f"<{tag} class='{name}'><p>{w * 30}</p></{tag}>", tree) == (w * 30).strip()
        for name in ("comments", "reader-comments"):
            assert htmltext.article(f"<{tag}><p>{w}</p><{tag} class='{name}'><p>{w * 30}</p></{tag}></{tag}>", tree) == w.strip()
    assert htmltext.article("<p>Short page.</p><p>It has two lines.</p>", tree) == "Short page. It has two lines."
    assert htmltext.article("<h1>Title</h1><p>One.</p><ul><li>First item.</li><li>Second.</li></ul>", tree) == "Title One. First item. Second."
    for name in ("sponsored-content", "ad-content", "sidebar-links", "related-posts", "footer-content"):
        assert htmltext.article(f"<article><p>{w * 20}</p><div class='{name}'>{w * 30}</div></article>", tree) == (w * 20).strip()


def test_tree_on_held_out_pages():
    """Other seeds than the training's; every leaf has many rows, and a long page takes no longer than its length asks."""
    tree = htmltext.trained()
    held = np.concatenate([htmltext.labelled(seed, 200) for seed in (1, 2)])
    assert (htmltext.classify(tree, held[:, :-1]) == (held[:, -1] > 0)).mean() >= 0.99
    rows = htmltext.labelled()

    def leaves(t, x):
        if isinstance(t, int):
            return [len(x)]
        side = x[:, t[0]] <= t[1]
        return leaves(t[2], x[side]) + leaves(t[3], x[~side])

    assert min(leaves(tree, rows)) >= htmltext.LEAF
    long = "<article>" + "<p>some words of a very long page</p>" * 40_000 + "</article>"
    assert len(htmltext.article(long, tree).split()) == 7 * 40_000


def test_pages_edges(spark):
    page = "<article><p>Some words of an article.</p></article>"
    rows = [(1, "u", page, 5, "old"), (1, "u", page, 5, "old"), (None, None, None, None, None), (2, "u", "", 1, ""), (3, "u", "x" * 200_000, 1, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = htmltext.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.dtypes[3] == ("n_chars", "bigint")
    assert Counter(r.text for r in got.where("page_id = 1").collect()) == {"Some words of an article.": 2}
    assert [r.n_chars for r in got.where("page_id IS NULL OR page_id = 2").collect()] == [0, 0] and htmltext.extract(df.where("false")).count() == 0


def test_articles_of_pages(spark):
    import html
    import re

    def truth(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        return " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner))).split())

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in htmltext.op5_html_extraction(spark, SF).collect():
        assert r.text == truth(pages[r.page_id]) and r.n_chars == len(r.text)


# --- suffixes


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_suffixes_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda n, letters="abcdé ": "".join(rng.choices(letters, k=n))
    shared = [word(rng.randint(60, 180)) for _ in range(6)]
    texts = [None, "", "ab" * 150, "ab" * 200, "x" * 500, "x" * 90, word(300, "ab"), word(400, "ab")]
    for _ in range(60):
        p = rng.choice(shared)
        cut = rng.randint(0, 20)
        texts.append(word(rng.randint(0, 80)) + p[cut:] + word(rng.randint(0, 80)) + rng.choice([p, p[:70], rng.choice(shared)]))
    texts += texts[10:14]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffixes.dedup(df, length=64, passage=40, words=0).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == brute(texts, 64)
    assert [(r.passage_bytes, r.n_passages) for r in got] == [b[1:3] for b in brute(texts, 40)]


def test_suffixes_of_large_groups_equal_brute_force(spark, monkeypatch):
    """One passage in many texts, in more runs than meet in one task."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcdé ", k=n))
    shared = [word(70), word(150)]
    texts = [word(rng.randint(30, 90)) + (p := rng.choice(shared))[: rng.choice([50, 66, 69, len(p)])] + rng.choice(["", "a", "ab", word(50)]) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(suffixes, "GROUP", 4)
    for n in (64, 30):
        got = suffixes.dedup(df, length=n, passage=30, words=0).orderBy("doc_id").collect()
        assert [tuple(r)[1:5] for r in got] == brute(texts, n)
        assert [(r.passage_bytes, r.n_passages) for r in got] == [b[1:3] for b in brute(texts, 30)]


def test_passages_of_the_stage(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    long, short = words(51), words(45)
    texts = [f"{words(70)} {long} {words(60)}", f"{words(9)} {long}", f"{words(70)} {short} {words(60)}", f"{short} {words(80)}", words(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffixes.stage(spark, df, SF).collect()}
    assert [got[i] == t for i, t in enumerate(texts)] == [False, False, True, True, True]
    assert long not in got[0] and long not in got[1] and len(got[0]) >= len(texts[0]) - len(long) - 4


def test_suffix_edges(spark, edge, empty):
    assert suffixes.dedup(edge).count() == edge.count() and suffixes.dedup(empty).count() == 0
    out = suffixes.stage(spark, edge, SF)
    assert out.columns == edge.columns and out.count() == edge.count()


# --- near duplicates


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(800)]
    passage = rng.choices(vocabulary, k=40)
    texts = [None, None, "", "", "!", "one two", "one two", "one two three"]
    for _ in range(12):
        base = rng.choices(vocabulary, k=150)
        for k in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(k // 2):
                copy[rng.randrange(150)] = rng.choice(vocabulary)
            texts.append(" ".join(copy + (passage if rng.random() < 0.3 else [])))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = WordHashes()
    sets = [neardup.shingles(t or "", known) for t in texts]
    counts = np.zeros((neardup.DF_ROWS, neardup.DF_BUCKETS), int)
    for e, _ in sets:
        for own, b in zip(counts, neardup._buckets(e)):
            np.add.at(own, b, 1)
    weight = neardup.InverseFrequencies(len(texts), counts)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    packed = [(e.tobytes(), c.astype(np.uint16).tobytes()) for e, c in sets]
    for i in range(len(texts)):
        for j in range(i):
            same = texts[i] is not None and texts[i] == texts[j]
            if same or (len(sets[i][0]) and len(sets[j][0]) and neardup._similarity(packed[i], packed[j], weight) >= neardup.SIMILARITY):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    kept = neardup.stage(spark, df, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(texts))})


def test_near_duplicates_of_large_buckets(spark, monkeypatch):
    """Chains of edits that share large buckets: every pair that meets in any bucket is compared."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(2000)]
    texts = []
    for _ in range(3):
        family = [rng.choices(vocabulary, k=300)]
        for _ in range(70):
            text = list(rng.choice(family[-60:]))
            for _ in range(rng.randint(1, 6)):
                text[rng.randrange(300)] = rng.choice(vocabulary)
            family.append(text)
        texts += [" ".join(x) for x in family]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known, n = WordHashes(), len(texts)
    sets = [neardup.shingles(t, known) for t in texts]
    weight = neardup.InverseFrequencies(*neardup.document_frequencies(df, "text"))
    lengths = [len(e) for e, _ in sets]
    elements = np.concatenate([e for e, _ in sets])
    weights = (np.concatenate([c for _, c in sets]) * weight[elements]).astype(np.float32)
    bands = neardup.WeightedSampler().bands(elements, weights, np.cumsum([0, *lengths[:-1]]))
    packed, root = [(e.tobytes(), neardup._packed(c)) for e, c in sets], list(range(n))
    for i in range(n):
        for j in range(i):
            if root[i] != root[j] and (bands[i] == bands[j]).any() and neardup._similarity(packed[i], packed[j], weight) >= neardup.SIMILARITY:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert max(Counter(bands.ravel().tolist()).values()) > 16 and len(set(root)) > 3
    for name, value in (("TOGETHER", 4), ("ELEMENTS", 900)):
        with monkeypatch.context() as m:
            m.setattr(neardup, name, value)
            got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
        assert got == dict(enumerate(root)), name


def test_near_duplicates_of_a_group_in_a_large_table(spark):
    """Copies of one text with four words of 200 changed: what 25 texts of 4,000 share is still rare, so that the group weighs like a pair."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    base = rng.choices(vocabulary, k=200)
    texts = [" ".join(base)]
    for k in range(24):
        copy = list(base)
        for at in (k + 10, k + 60, k + 110, k + 160):
            copy[at] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [" ".join(rng.choices(vocabulary, k=20)) for _ in range(3975)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == {i: i if i > 24 else 0 for i in range(len(texts))}


def test_similarity_does_not_fall_with_the_size_of_table_and_group():
    """What one of 200 documents holds is in common, at two numbers of documents; what more than one of 128 hold weighs less."""
    shared, own, often = np.arange(1, 91, dtype=np.uint32) * np.uint32(40_000_003), [np.arange(k, k + 10, dtype=np.uint32) * np.uint32(90_000_049) for k in (100, 200)], np.array([77], np.uint32)
    found = []
    for n in (2_000, 3_000_000):
        counters = np.zeros((neardup.DF_ROWS, neardup.DF_BUCKETS), int)
        for e, x in ((shared, n // 200), (own[0], 1), (own[1], 1), (often, n // 10)):
            for table, b in zip(counters, neardup._buckets(e)):
                np.add.at(table, b, x)
        weight = neardup.InverseFrequencies(n, counters, neardup.RARE)
        sets = [np.sort(np.concatenate([shared, o])) for o in own]
        found.append(neardup._similarity(*((e.tobytes(), neardup._packed(np.ones(len(e), int))) for e in sets), weight))
        assert abs(weight[often][0] - np.log(10) - 1) < 0.1
    assert found[0] == found[1] and abs(found[0] - 90 / 110) < 1e-6


def test_frequencies_of_shingles_stay_apart_in_full_tables():
    """A million rare shingles fill every counter; frequent ones keep their weight and rare ones the highest."""
    rng = np.random.default_rng(2)
    rare, often = rng.integers(0, 1 << 32, 3_000_000, dtype=np.uint32), np.arange(5, 2000, dtype=np.uint32) * np.uint32(2_000_003)
    counters = np.zeros((neardup.DF_ROWS, neardup.DF_BUCKETS), int)
    for own, r, o in zip(counters, neardup._buckets(rare), neardup._buckets(often)):
        np.add.at(own, r, 1)
        np.add.at(own, o, 500)
    weight, n = neardup.InverseFrequencies(100_000, counters), 100_000
    true = np.log((1 + n) / np.array([2, 501])) + 1
    assert np.mean(np.abs(weight[often] - true[1]) < 0.1) > 0.98 and np.mean(np.abs(weight[rare] - true[0]) < 0.1) > 0.98


def test_near_duplicate_counts_are_not_capped():
    e, weight = np.array([1], np.uint32), neardup.InverseFrequencies(0, np.zeros((2, neardup.DF_BUCKETS), int))
    a, b = ((e.tobytes(), neardup._packed(np.array([c]))) for c in (70_000, 140_000))
    assert neardup._similarity(a, b, weight) == 0.5


def test_near_duplicate_edges(spark, edge, empty):
    assert neardup.near_duplicates(edge).count() == edge.count() and neardup.near_duplicates(empty).count() == 0
    out = neardup.stage(spark, edge, SF)
    assert out.columns == edge.columns and out.where(F.col("text").startswith("Das")).count() == 1


# --- benchmark


def test_decontamination_equals_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(map(tuple, c.sql(decontam.SQL).fetchall()))
    assert sorted(map(tuple, decontam.op10_decontamination(spark, SF).collect())) == want


def test_decontamination_small(spark, edge, empty):
    items = spark.createDataFrame([(1, "one TWO three four five six seven eight nine ten eleven"), (2, "x y"), (3, None), (None, "z z"), (4, "!")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a one two three four five six seven eight nine ten, b"), (2, "x"), (3, "y X-y x"), (4, "z z z"), (5, None), (6, "ten nine eight seven six five four three two one")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated, r.n_near) for r in decontam.decontaminate(docs, items).collect()}
    assert got == {1: (12, 10, 1, True, 1), 2: (1, 0, 0, False, 0), 3: (4, 2, 1, True, 1), 4: (3, 3, 0, True, 0), 5: (0, 0, 0, False, 0), 6: (10, 0, 0, False, 1)}
    ends = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y q x")], "doc_id long, text string").coalesce(1)
    rows = {(r.doc_id, r.item_id): (r.exact, r.near) for r in decontam.matches(ends, items, slack=1).collect()}
    assert rows == {(3, "2"): ([], [2])} or rows == {(3, "2"): ([], [0])}
    (row,) = [r for r in decontam.matches(docs, items).collect() if r.doc_id == 3]
    assert (row.item_id, row.exact, row.n_words) == ("2", [1], 2)
    assert decontam.decontaminate(edge, items).count() == edge.count() and decontam.decontaminate(empty, items).count() == 0
    assert not decontam.decontaminate(docs, items.limit(0)).where("contaminated").count()
    tests, held = decontam.windows(items)
    assert tests.count() == 4 and sorted(r.item for r in held.collect()) == ["1", "1", "2"]
    assert decontam.stage(spark, edge, SF).columns == edge.columns


def test_decontamination_in_small_shards_and_blocks(spark, monkeypatch):
    """Shards of few words, one window in a row, and a filter so small that it lets most terms through: the same rows."""
    docs, items = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(map(tuple, decontam.decontaminate(docs, items).collect()))
    monkeypatch.setattr(decontam, "SHARD_WORDS", 2000)
    monkeypatch.setattr(decontam, "BROADCAST", 100)
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 7)
    monkeypatch.setattr(decontam, "FILTER_BITS", 1024)
    assert sorted(map(tuple, decontam.decontaminate(docs, items).collect())) == want
    index = decontam.build_index(docs)
    tests, _ = decontam.windows(items)
    met = decontam._meetings(index, tests).selectExpr("shard", "size(windows) AS n").collect()
    assert 0 < sum(r.n for r in met) < 0.5 * tests.count() * index.count()  # a window meets only shards that hold its rarest term


# --- media and shards


def test_media_round_trip_and_resync():
    for n in (0, 1, 191, 192, 193, 384, 5000):
        data = bytes(random.Random(n).choices(range(256), k=n))
        stored = media.encode(media.padded(data))
        s = media.parse(stored)
        assert s.payload == media.padded(data) and s.crc_bad == 0 and s.skipped == 0 and s.tags["TXXX"].startswith("payload")
        assert s.samples == 1152 * len(s.offsets) and s.table[0] == len(s.offsets)
    first = s.offsets[1]
    noisy = b"??" + stored[:first] + b"\x00\xff\xfajunk" + stored[first : s.offsets[3]] + b"\xff" + stored[s.offsets[3] :]
    t = media.parse(noisy)
    assert (len(t.offsets), t.payload, t.samples) == (len(s.offsets), s.payload, s.samples) and t.skipped > 8
    tagged = media.parse(stored + b"TAG" + b"title".ljust(125, b"\0"))
    assert (tagged.payload, tagged.offsets, tagged.skipped, tagged.tags["TAG"]) == (s.payload, s.offsets, 0, "title")
    broken = bytearray(stored)
    broken[s.offsets[2] + 8] ^= 1
    assert media.parse(bytes(broken)).crc_bad == 1
    assert media.parse(b"").samples == 0 and media.parse(b"\xff\xfb").offsets == []


def test_media_loses_no_payload_to_look_alikes():
    """What looks like a tag or a header is payload wherever it stands in a frame."""
    for what in (b"TAG", b"\xff\xfa\xa4\xc0", b"ID3\x03", b"Xing", b"VBRI"):
        for n in (192, 384, 576):
            for at in range(n - len(what) + 1):
                data = (b"x" * at + what).ljust(n, b"y")
                s = media.parse(media.encode(data))
                assert s.payload == data and s.skipped == 0


def _frame(one, two, size, marks=b"", at=4):
    return (bytes([0xFF, one, two, 0xC4]).ljust(at, b"\0") + marks).ljust(size, b"\0")


def test_media_of_other_versions_and_layers():
    for one, two, size, samples, rate in ((0xF3, 0x84, 192, 576, 24000), (0xE3, 0x80, 417, 576, 11025), (0xFF, 0x44, 128, 384, 48000), (0xFD, 0x80, 417, 1152, 44100), (0xFB, 0x92, 418, 1152, 44100)):
        s = media.parse(b"\xff" + _frame(one, two, size) * 5)
        assert (len(s.offsets), s.samples, s.rate, s.skipped) == (5, 5 * samples, rate, 1), (one, s)
    vbri = b"VBRI" + bytes(6) + (4 * 417).to_bytes(4, "big") + (4).to_bytes(4, "big") + bytes([0, 2, 0, 1, 0, 1, 0, 2]) + b"ab"
    s = media.parse(_frame(0xFB, 0x90, 417, vbri, 36) + _frame(0xFB, 0x90, 417) * 4)
    assert s.table == (4, 1668, b"ab") and len(s.offsets) == 4


def test_media_query_equals_brute_force(spark):
    """The stored payload's length, digest and tail, for every document."""
    c = duckdb.connect()
    want = {}
    for doc, text in c.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall():
        data = media.padded(text.encode())
        want[doc] = (len(text.encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
    rows = media.op7_media(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == want and len(rows) == len(want)


def test_media_edges(spark, edge, empty):
    rows = media.media_columns(edge).collect()
    assert len(rows) == edge.count() and all(r.payload_bytes % 192 == 0 and r.payload_bytes > 0 and r.crc_bad == 0 for r in rows)
    assert media.media_columns(empty).count() == 0


def test_flow_moves_the_fewest_bytes():
    flow = sharding.min_cost_flow([10, 0, 5], [5, 5, 5], [[int(i != j) for j in range(3)] for i in range(3)])
    assert [flow[i][i] for i in range(3)] == [5, 0, 5] and flow[0][1] == 5
    assert sharding.min_cost_flow([4, 4], [5, 5], [[3, 1], [1, 1]])[0] == [0, 4]
    with pytest.raises(ValueError):
        sharding.min_cost_flow([4], [3], [[0]])


def test_shards(spark, edge, empty):
    rows = sharding.op8_sharding(spark, SF).collect()
    by, total = defaultdict(list), sum(r.size for r in rows)
    for r in rows:
        by[r.shard].append(r)
    longest = max(r.size for r in rows)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 40) <= longest
    docs = {r.doc_id: (r.text or "").encode() for r in documents(spark).collect()}
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len(b) + 16, zlib.crc32(b)) for i, b in docs.items())
    old = F.lit(0)
    assert sharding.reshard(sharding.sizes(edge, old)).rows.count() == edge.count() and sharding.reshard(sharding.sizes(empty, old)).rows.count() == 0


def test_shards_are_nearly_equal(spark):
    """Within the stated share of the mean wherever shards hold many documents, within that of the longest document where they hold few."""
    for sf, least in ((SF, 0.96), (SF.replace("0.001", "0.01"), 1 - sharding.SPREAD)):
        rows = sharding.op8_sharding(spark, sf).groupBy("shard").agg(F.sum("size").alias("bytes"), F.max("size").alias("longest")).collect()
        mean = sum(r.bytes for r in rows) / 40
        assert len(rows) == 40 and min(r.bytes for r in rows) >= least * mean
        assert all(r.bytes <= max((1 + sharding.SPREAD) * mean, r.longest) for r in rows)


def test_evening_out_moves_and_exchanges():
    rng = random.Random(4)
    for longest in (3, 50, 900):
        own = [[(rng.randint(1, longest), 100 * j + k) for k in range(rng.randint(0, 40))] for j in range(8)]
        sizes = [sum(s for s, _ in m) for m in own]
        home = sharding.even_out(sizes, own)
        size_of = {d: s for m in own for s, d in m}
        after = list(sizes)
        for d, j in home.items():
            after[d // 100] -= size_of[d]
            after[j] += size_of[d]
        assert sum(after) == sum(sizes) and max(after) - min(after) <= max(2, 0.02 * sum(sizes) / 8)
    assert sharding.even_out([0, 0], [[], []]) == {} and sharding.even_out([9, 0], [[(9, 0)], []]) == {}


def test_rewritten_shards_hold_every_document_once(spark, tmp_path):
    """Null and repeated ids, repeated rows, a null text, and fewer new shards than old ones."""
    rows = [(i if i % 5 else None, "x" * (i % 7) if i % 11 else None, i % 4) for i in range(120)] + [(7, "same", 3)] * 6 + [(7, "other", 2)] * 3
    path = str(tmp_path / "files")
    spark.createDataFrame(rows, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(path)
    docs = spark.read.parquet(path)
    plan = sharding.reshard(sharding.sizes(docs, F.col("shard")), shards=3, least_blocks=4)
    assert 0 < plan.homes.count() < 16
    want = Counter((r.doc_id, r.size, r.shard) for r in plan.rows.collect())
    touched = sharding.rewrite(docs, F.col("shard"), plan, path)
    back = spark.read.parquet(path).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(r[:2] for r in rows)
    assert Counter((r.doc_id, len(r.text or "") + sharding.ROW_BYTES, r.shard) for r in back) == want
    assert 3 in touched and {r.shard for r in back} == {0, 1, 2}
