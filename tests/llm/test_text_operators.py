"""License scan, BPE, page text and language model against plain versions."""

import math
import random
import zlib
from collections import Counter

import tiktoken

from pyspark.sql import functions as F

from tallyarc.llm import bpe, html_text, license_scan, lm
from tallyarc.llm.queries import byte_bpe


def test_licenses_by_brute_force(spark):
    random.seed(3)
    noise = lambda n: " ".join(random.choice(["alpha", "beta", "gamma", "license", "the", "mit"]) for _ in range(n))
    texts = []
    for name, text in license_scan.TEMPLATES.items():
        words = text.split()
        edited = [w if k % 23 else "changed" for k, w in enumerate(words, 1)]
        cut = words[: len(words) // 2]
        texts += [f"{noise(30)} {text} {noise(9)}", f"{noise(3)} {' '.join(edited)}", f"{noise(40)} {' '.join(cut)} {noise(5)}", text.upper(), name]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def shingles(text):
        words, word = [], ""
        for c in text + " ":
            if c.isalnum():
                word += c.lower()
            elif word:
                words.append(word)
                word = ""
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    want = set()
    for name, text in license_scan.TEMPLATES.items():
        own = shingles(text)
        want |= {(i, name, len(own), len(own & shingles(t))) for i, t in enumerate(texts) if len(own & shingles(t)) >= 0.75 * len(own)}
    assert {tuple(r)[:4] for r in license_scan.scan(docs).collect()} == want


def test_merge_equals_the_library():
    ranks, pattern = byte_bpe()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    random.seed(1)
    pieces = ["".join(random.choice("aeiouthn rs'ß€漢\n") for _ in range(random.randint(1, 40))) for _ in range(300)] + ["a" * 5000, " " * 3000, "the" * 900]
    for piece in pieces:
        raw = piece.encode()
        assert bpe.merge(raw, ranks) == library._encode_single_piece(raw)


def test_encode_and_decode(spark):
    ranks, pattern = byte_bpe()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello  world\n\n it's 12345 <|endoftext|>", "漢字   \x1c x", "", "same", "same", "é" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = bpe.encode(docs, ranks, pattern, chars=30)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(ids, ranks).collect()} == dict(enumerate(texts))


def test_language_model_by_brute_force(spark):
    random.seed(2)
    texts = {i: " ".join(random.choice(["A", "a", "b", "cc", "dd", f"x{i}"]) for _ in range(random.randint(0, 30))) for i in range(60)}
    got = {r.doc_id: r for r in lm.scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), strength=7.0, chars=200).collect()}
    tokens = {i: [*t.lower().split(), "\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    words = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    pairs = Counter(p for i, t in tokens.items() if not held[i] for p in zip(["<", *t], t, strict=False))
    states = words + Counter({"<": sum(not h for h in held.values())})
    n, once, twice = words.total(), sum(c == 1 for c in words.values()), sum(c == 2 for c in words.values())
    off = once / (once + 2 * twice) if once else 0.5
    p = lambda w: (words[w] - off) / n if words[w] else off * len(words) / n
    arc = lambda u, w: (pairs[u, w] + 7.0 * p(w)) / (states[u] + 7.0)
    for i, t in tokens.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(t), sum(words[w] > 0 for w in t), n)
        assert math.isclose(got[i].base_score, sum(math.log10((words[w] + 1) / (n + len(words) + 1)) for w in t), abs_tol=1e-9)
        assert math.isclose(got[i].score, sum(math.log10(arc(u, w)) for u, w in zip(["<", *t], t, strict=False)), abs_tol=1e-9)
    for u in [*(words - Counter({"\n": n})), "<"]:  # the weights of a state sum to one; nothing follows an end
        assert math.isclose(sum(arc(u, w) for w in words) + arc(u, "never seen"), 1)


def test_page_text(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use</div>
    <article><header><h1>A &amp; B</h1></header><p>One   two <b>three</b><p>Four<br>five<div class="share">Tweet</div><aside>Also</aside><form>Mail</form>
    <script>var t = "</p>";</script><!-- note --><ul><li>x<li>y</ul><section id="comments"><p>First!</p></section></article><footer>end</footer></body></html>"""
    assert html_text.main_text(page, frozenset()) == "A & B\nOne two three\nFour\nfive\nx\ny"
    assert html_text.main_text("just text &lt;here&gt;", frozenset()) == "just text <here>"
    assert html_text.main_text("<div>" * 5000 + "deep", frozenset()) == "deep"


def test_recurring_subtrees_go(spark):
    body = lambda i: f"<body><div><p>All rights kept by us</p></div><section><p>Story number {i} goes like this</p></section></body>"
    rows = [(i, f"http://a.example/{i}", body(i)) for i in range(8)] + [(i, "http://copy.example/x", body(99)) for i in range(8, 20)] + [(20, None, None), (21, "http://b.example", body(1))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story number {i} goes like this" for i in range(8))
    assert got[8] == "All rights kept by us\nStory number 99 goes like this"  # copies of one page are one page
    assert got[20] == "" and got[21].startswith("All rights")


def test_text_outside_the_article_stays(spark):
    body = lambda i: f"""<body><div><a>Home</a><a>Wares</a></div><div><p>Standfirst {i} of the story</p></div><article><p>Card {i}</p><p>Shared passage</p><div>Read on</div></article>
    <main>Loose words <b>not</b> of {i}<p>And the rest {i}</p></main><div><p>Two offices</p></div></body>"""  # noqa: E731
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", body(i)) for i in range(8)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert all(got[i] == f"Standfirst {i} of the story\nCard {i}\nShared passage\nLoose words not of {i}\nAnd the rest {i}" for i in range(8))
    assert html_text.main_text(body(1), frozenset()).startswith("HomeWares\nStandfirst 1")


def test_templates_of_a_large_host_go(spark):
    body = lambda i: f"<body>{'<div><p>Notice of the week</p></div>' if i < 6 else ''}<section><p>Story number {i} goes like this</p></section></body>"
    rows = [(i, f"http://large.example/{i}", body(i)) for i in range(200)] + [(200 + i, f"http://small.example/{i}", body(i)) for i in range(4)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story number {i} goes like this" for i in range(200))  # on 3 % of the host's pages
    assert all(got[200 + i] == f"Notice of the week\nStory number {i} goes like this" for i in range(4))


def test_interrupted_licenses(spark):
    words = license_scan.TEMPLATES["mit/text"].split()
    half = len(words) // 2
    split = " ".join([*words[:half], *(f"other{i}" for i in range(60)), *words[half:]])
    docs = spark.createDataFrame([(1, split), (2, " ".join(words[:half])), (2, " ".join(words[half:])), (3, " ".join(words[:half]))], "doc_id long, text string")
    got = {r.doc_id: (r.matched, r.template_shingles) for r in license_scan.scan(docs).where("license_id = 'mit/text'").collect()}
    assert set(got) == {1, 2} and all(whole - matched == 4 for matched, whole in got.values())


def test_short_edited_licenses(spark):
    """Templates of 20 shingles with a quarter broken: none is missed."""
    texts, templates = [], {}
    for t in range(150):
        words = [f"w{t}x{i}" for i in range(24)]
        templates[f"t{t}"] = " ".join(words)
        texts += [(f"t{t}", " ".join(["changed" if i == k else w for i, w in enumerate(words)])) for k in range(4, 20)]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.license_id) for r in license_scan.scan(docs, templates).collect()}
    assert got == {(i, name) for i, (name, _) in enumerate(texts)}


def test_license_windows_collide_as_often_as_stated(spark):
    """Pairs of windows that share j of their shingles share a band with 1 - (1 - J) ** BANDS, give or take sampling error."""
    draw = random.Random(5)
    key = lambda: draw.getrandbits(64) - (1 << 63)
    size, pairs = license_scan.WINDOW, 1500
    rows = []
    for j in (3, 6, 9):
        for k in range(pairs):
            shared = [key() for _ in range(j)]
            rows += [(f"{j}", k, shared + [key() for _ in range(size - j)]) for _ in range(2)]
    shingled = spark.createDataFrame(rows, "j string, k int, shingles array<bigint>")
    bands = license_scan.windows(shingled, size).groupBy("j", "k").agg(F.collect_list("bands").alias("b"))
    got = {r.j: r.hit for r in bands.groupBy("j").agg(F.avg(F.arrays_overlap(F.col("b")[0], F.col("b")[1]).cast("int")).alias("hit")).collect()}
    for j, hit in got.items():
        similarity = int(j) / (2 * size - int(j))
        stated = 1 - (1 - similarity) ** license_scan.BANDS
        assert hit > stated - 4 * (stated * (1 - stated) / pairs) ** 0.5


def test_broken_long_licenses(spark):
    """Templates of 29 to 60 shingles, words replaced or others put between until just 3/4 are left: all are retrieved, few others are."""
    draw = random.Random(6)
    texts, templates = [], {}
    for t in range(120):
        n = 29 + t % 32
        words = [f"w{t}x{i}" for i in range(n + 4)]
        templates[f"t{t}"] = " ".join(words)
        for _ in range(6):
            cuts = set(draw.sample(range(5, n), n // 16))
            parts = [(" ".join(f"o{draw.random()}" for _ in range(draw.randint(1, 30))) + " " if i in cuts else "") + w for i, w in enumerate(words)]
            texts.append((f"t{t}", " ".join([f"p{draw.random()}"] * draw.randint(0, 9) + parts)))
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.license_id) for r in license_scan.scan(docs, templates).collect()}
    assert got == {(i, name) for i, (name, _) in enumerate(texts)}
    table = spark.createDataFrame(list(templates.items()), "license_id string, text string")
    assert license_scan.retrieved(docs, table).count() == len(got)


def test_licenses_in_odd_rows(spark):
    """Null ids and texts, empty and very long texts, repeated rows, clashing column names, an empty table."""
    name, words = "mit/text", license_scan.TEMPLATES["mit/text"].split()
    half, long = len(words) // 2, " ".join(f"x{i}" for i in range(200_000))
    rows = [(None, " ".join(words)), (None, None), (1, ""), (1, None), (2, " ".join(words)), (2, " ".join(words)), (3, f"{long} {' '.join(words)} {long}"),
            (4, " ".join(words[:half])), (4, " ".join(words[half:])), (5, " ".join(words[:half])), (6, "one two three four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = docs.withColumns({c: F.lit("other") for c in ("license_id", "key", "start", "n", "inside", "bands", "own", "salt", "found_id", "shingles", "licenses", "matched")})
    whole = {(None, name), (2, name), (3, name), (4, name)}
    for table in (docs, clashing):
        got = [(r.doc_id, r.license_id) for r in license_scan.scan(table).where(f"license_id = '{name}'").collect()]
        assert len(got) == len(whole) and set(got) == whole
    assert license_scan.scan(docs.where("doc_id > 9")).collect() == []
