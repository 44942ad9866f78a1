"""Quality, tokens, main text: held-out accuracy, another library's results, pages whose article is known."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import bpe, htmltext, quality, registry

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello, world!", "ΑΣ ΣΑΣ ς", "İstanbul ǅ", "é é ẛ̣", "it's I'LL 'tis", "a" * 3000, "  x　y\r\n\tz", "<|endoftext|>x<|startoftext|>", "日本語テキスト 123456", "🙂👩‍👩‍👧", "\x00\x07"]


def _library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def _want(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_equals_the_library(spark, data):
    t = _library()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = registry.QUERIES["op8_word_bpe"](spark, data).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == _want(t, docs[r.doc_id])


def test_bpe_of_awkward_texts(spark):
    t = _library()
    df = spark.createDataFrame([(i, x, "extra") for i, x in enumerate(TEXTS)] + [(None, "x", None)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.encode_column(df, PATH, ids=True).collect()}
    for i, x in enumerate(TEXTS):
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == _want(t, x), x
        assert list(got[i].ids) == t.encode(x or "", add_special_tokens=False).ids
    assert got[None].n_tokens == 1 and bpe.encode_column(df.limit(0), PATH).collect() == []


def test_prefix_programme_equals_merging_by_rank():
    """Random words against a plain loop over the merges."""
    b = bpe.loaded(PATH)
    rank = {pair: r for pair, r in b.merge.items()}
    joined = {}
    for whole, (x, y) in b.halves.items():
        joined[x, y] = whole
    single = {s: i for s, i in ((s, i) for s, i in b.step[0].items())}
    rng = np.random.default_rng(1)
    for _ in range(200):
        word = "".join(rng.choice(list("aeinrst'é7"), size=rng.integers(1, 14)))
        raw = word.encode().decode("latin-1")
        symbols = raw[:-1] + chr(ord(raw[-1]) + 256)
        ids = [b.ends[single[c]][-1][0] for c in symbols]
        while True:
            pairs = [(rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank and p in joined]
            if not pairs:
                break
            i = min(pairs)[1]
            ids[i : i + 2] = [joined[ids[i], ids[i + 1]]]
        assert np.frombuffer(b.word(word)[0], "<u4").tolist() == ids, word


def test_quality_on_held_out_labels(spark):
    data = "/root/testdata/sf0.01"
    scores = {r.doc_id: r for r in registry.QUERIES["op4_quality_scores"](spark, data).collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(scores[r.doc_id].held_out for r in held)
    assert sum(scores[r.doc_id].predicted == r.quality for r in held) / len(held) >= 0.9
    one, zero = ([scores[r.doc_id].score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in one for b in zero]) >= 0.95


def test_scores_depend_on_texts_alone(spark):
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate([("A fine text of some words.", "a"), ("A fine text of some words.", "b"), (None, None), ("", "c"), ("!!! $$$ ||| " * 200, "d"), ("x" * 50_000, "e")])] + [(None, "none", "f")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(0, 1), (4, 0), (5, 0), (5, 0), (1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == 7 and by[0] == by[1] and by[2] == by[3] and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.quality_scores(docs.limit(0), labels).collect() == []
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted} | {None}


def test_discriminant_equals_the_plain_formula():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, len(quality.NAMES)))
    cov = [np.cov(rng.normal(size=(200, len(quality.NAMES))).T) for _ in (0, 1)]
    mean = rng.normal(size=(2, len(quality.NAMES)))
    m = quality.Discriminant(mean, np.linalg.cholesky(np.array(cov)), np.array([-0.5 * np.linalg.slogdet(c)[1] for c in cov]))
    density = [-0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - u, np.linalg.inv(c), x - u) for c, u in zip(cov, mean)]
    assert np.allclose(m.score(x), 1 / (1 + np.exp(density[0] - density[1])))


ARTICLE = "The harbour was quiet when the first of the boats came in, and there was no one on the long wall but the man with his dog."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p {{}}</style></head><body>
<header><a href="/">Home</a> <a href="/x">More</a></header><nav><ul><li><a href=1>One</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site to give you the best of the web.</div>
<article><h1>Quiet &amp; still</h1><p>{ARTICLE}</p><p>Then   the
sun&nbsp;rose.</p><!-- <p>hidden</p> --></article>
<aside><p>{ARTICLE.replace('boats', 'adverts')}</p></aside><div id="comments"><p>{ARTICLE.replace('boats', 'readers')}</p></div>
<form><p>Write to us with your name and what you have to say.</p></form><footer>Copyright</footer></body></html>"""


def test_main_text_of_a_known_page():
    assert htmltext.main_text(PAGE) == f"Quiet & still\n{ARTICLE}\nThen the sun rose."


def test_second_pass_labels_short_blocks_by_their_neighbours():
    plain = f"<div><p>{ARTICLE}</p><p>Short one.</p><p>{ARTICLE}</p></div><div><a href=1>{'link ' * 30}</a></div><p>Menu</p><div><a href=2>{'other ' * 30}</a></div>"
    assert htmltext.main_text(plain) == f"{ARTICLE}\nShort one.\n{ARTICLE}"


def test_awkward_pages(spark):
    rows = [(1, "u", None, "a"), (2, None, "", "b"), (None, "u", "<p>" + "the word of it " * 20_000, "c"), (3, "u", "<div><script>x", None), (4, "u", "no markup & more", "d"), (4, "u", "no markup & more", "d")]
    got = htmltext.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[3] == "" and by[4] == "no markup & more" and len(by[None]) == 15 * 20_000 - 1
    assert htmltext.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pages_lose_their_frame(spark, data):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = registry.QUERIES["op9_main_text"](spark, data).collect()
    assert len(got) == len(pages) and all(r.text and "<" not in r.text for r in got)


@pytest.mark.parametrize("name", ["op4_quality_scores", "op8_word_bpe", "op9_main_text"])
def test_one_row_for_each_row(spark, data, name):
    table = "pages" if "op9" in name else "documents"
    assert registry.QUERIES[name](spark, data).count() == spark.read.parquet(f"{data}/{table}.parquet").count()


def test_unclosed_elements_and_forms_keep_the_page():
    from tessera.llm.htmltext import main_text

    body = "It is the story of a river and of the people who live by it, as they were told it when they were young. " * 3
    want = body.strip()
    for tag in ("svg", "math", "object", "canvas", "noscript", "template"):
        assert main_text(f"<body><{tag}><p>{body}</p></body>") == want
    for tag in ("script", "style", "textarea", "iframe"):
        assert main_text(f"<body><p>{body}</p><{tag}><p>{body}</p></body>") == want
    menu = "<nav><a href=a>Home</a></nav>"
    for form in ("<form>", "<form id='form1' method=post>", "<form id=aspnetForm role=form>"):
        assert main_text(f"<body>{form}{menu}<article><p>Short.</p></article></form></body>") == "Short."
        assert main_text(f"<body>{form}{menu}<div>{body}</div></form></body>") == want
        assert main_text(f"<body><article><p>{body}</p>{form}<label>Your name</label><input></form></article></body>") == want
    assert main_text(f"<body><p>{body}</p><form class=search-form><p>{body}</p></form></body>") == want


PROSE = [
    "It is the story of a river and of the people who live by it, as they were told it when they were young and had time to hear it all.",
    "There was a time when the boats came in each day with what they had, and the men who sold it were known to all of us in the town.",
    "Now that the harbour is quiet it is hard to say what has been lost, but those who stay on will tell you that it was not the work.",
]


def test_each_rule_decides_blocks_without_any_names_or_article():
    from collections import Counter

    links = "".join(f"<div><a href={i}>Section {i} of the site</a> <a href=x{i}>more</a></div>" for i in range(4))
    code = "<div>" + "x=1; zz=2; " * 30 + "</div>"
    body = f"<div>{PROSE[0]}</div><div>Short one.</div>{code}<div>{PROSE[1]}</div><h2>Then</h2><div>{PROSE[2]}</div>"
    page = f"<body>{links}<div>Menu</div>{links}<div><div>{body}</div></div>{links}<div>Imprint</div>{links}</body>"
    want = [PROSE[0], "Short one.", ("x=1; zz=2; " * 30).strip(), PROSE[1], "Then", PROSE[2]]
    assert htmltext.main_text(page).split("\n") == want
    rules = Counter(htmltext.decided(htmltext.page_blocks(page)))
    assert rules == {(False, "links"): 16, (True, "stops"): 3, (True, "length"): 1, (True, "neighbours"): 2, (False, "neighbours"): 2}
    inside = Counter(htmltext.decided(htmltext.page_blocks(f"<article>{body}</article>")))
    assert inside == {(True, "stops"): 3, (True, "length"): 1, (True, "neighbours"): 2}


def test_names_are_hints_by_their_last_word():
    for name in ("sidebar-layout", "has-sidebar", "promotion-history", "notice-of-hearing", "content"):
        assert htmltext.main_text(f"<article><p>{PROSE[0]}</p><div class='{name}'><p>{PROSE[1]}</p></div></article>").split("\n") == PROSE[:2]
    for name in ("sidebar", "main-sidebar", "comments", "comment-list", "cookie-notice", "ad-slot", "ad", "newsletter_box"):
        assert htmltext.main_text(f"<p>{PROSE[0]}</p><div class='{name}'><p>{PROSE[1]}</p></div>") == PROSE[0]
    long = " ".join(PROSE)
    assert htmltext.main_text(f"<div class='modal'><p>{long}</p></div>") == long and htmltext.main_text(f"<div class='comments'><p>{long}</p></div>") == ""


def test_hostile_pages_take_time_in_proportion():
    import time

    began = time.time()
    for piece in ("<a ", "</div>", "<svg>", '<a "', "<div>", "<!--", "<", "<a 'x>"):
        htmltext.main_text(piece * 100_000)
    assert time.time() - began < 20
    assert htmltext.main_text("\u0130" * 50 + "<script>x</script>" + PROSE[0]).endswith(PROSE[0])
