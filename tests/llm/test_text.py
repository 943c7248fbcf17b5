import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronolane.llm import bpe, common, decontaminate, html_extract, licenses, registry, toxicity, url_filter

from .helpers import SCHEMA, documents, rows, words


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.vocabulary()[0])


def test_encoding_equals_the_library(spark, tokenizer):
    rnd = random.Random(4)
    odd = [*"ab cd  \n\t'sre ll.!?éß漢🙂012", "<|endoftext|>", "<|endof", "\x1c", "longword" * 40]
    adverse = ["".join(rnd.choice(odd) for _ in range(rnd.randint(0, 5000))) for _ in range(40)] + ["x" * 20000, " " * 9000, "ab " * 7000, "don't " * 2000]
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(adverse)], "doc_id long, text string"))
    vocabulary = registry.vocabulary()
    encoded = bpe.encode(docs, vocabulary)
    got = Counter((str(r["doc_id"]), tuple(r["ids"])) for r in rows(encoded))
    want = Counter((str(r["doc_id"]), tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows(docs))
    assert got == want
    back = Counter((str(r["doc_id"]), r["text"]) for r in rows(bpe.decode(encoded, vocabulary)))
    assert back == Counter((str(r["doc_id"]), tokenizer.decode(list(ids), skip_special_tokens=False)) for r in rows(docs) for ids in [tokenizer.encode(r["text"] or "", add_special_tokens=False).ids])
    assert bpe.encode(spark.createDataFrame([], SCHEMA), vocabulary).count() == 0


def test_one_pass_encodes_and_decodes(spark):
    docs, vocabulary = documents(spark), registry.vocabulary()
    apart, once = bpe.decode(bpe.encode(docs, vocabulary), vocabulary), bpe.encode_and_decode(docs, vocabulary)
    assert once.columns == apart.columns
    assert Counter((str(r["doc_id"]), tuple(r["ids"]), r["text"]) for r in rows(once)) == Counter((str(r["doc_id"]), tuple(r["ids"]), r["text"]) for r in rows(apart))
    assert bpe.encode_and_decode(spark.createDataFrame([], SCHEMA), vocabulary).count() == 0


def test_tokens_of_the_pipeline_take_one_worker_in_a_task(spark):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    plan = corpus_pipeline.to_tokens(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    behind_shuffle = plan[: plan.index("Exchange")]
    assert len(re.findall("MapInArrow|ArrowEvalPython", behind_shuffle)) == 1, plan


def test_a_task_hands_back_what_it_held(monkeypatch):
    handed = []
    monkeypatch.setattr(common, "hand_back", lambda: handed.append(len(bpe.codec(*vocabulary).kept)))
    vocabulary, rnd = registry.vocabulary(), random.Random(9)
    batches = [pa.record_batch([pa.array([i]), pa.array([words(rnd, 900)])], names=["doc_id", "text"]) for i in range(3)]
    run = bpe.there_and_back(vocabulary)
    first = next(tasks := run(iter(batches)))
    assert first.column(2).to_pylist() == batches[0].column(1).to_pylist() and bpe.codec(*vocabulary).kept
    tasks.close()  # a task that ends early
    assert handed == [0]
    assert sum(b.num_rows for b in run(iter(batches))) == 3 and handed == [0, 0]


def test_chunks_move_with_the_content():
    rnd = random.Random(5)
    text = words(rnd, 6000)
    a = {text[s:e] for s, e in zip([0, *bpe.cut_points(text)], bpe.cut_points(text))}
    moved = "a few words before " + text
    b = {moved[s:e] for s, e in zip([0, *bpe.cut_points(moved)], bpe.cut_points(moved))}
    assert len(a & b) >= 0.7 * len(a)


def _contaminated(docs, items):
    import re

    def norm(x):
        return re.findall(r"[^\W_]+", (x or "").lower())

    def grams(w, k):
        return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]

    out = set()
    for r in docs:
        w = norm(r["text"])
        for it in items:
            iw = norm(it["text"])
            if not iw:
                continue
            k = min(5, len(iw))
            own, bag = grams(w, k), Counter(grams(iw, k))
            starts = {max(0, i - o) for o, g in enumerate(grams(iw, k)) for i, x in enumerate(own) if x == g}
            for s in starts:
                c = Counter(grams(w[s : s + len(iw)], k))
                common = sum((c & bag).values())
                if common >= 0.8 * (sum(c.values()) + sum(bag.values()) - common):
                    out.add((str(r["doc_id"]), it["item_id"]))
    return out


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(6)
    items = [(i, words(rnd, n)) for i, n in enumerate([15, 30, 60, 3, 1])] + [(5, None), (6, ""), (7, "..."), (8, "same words twice " * 8)]
    docs = rows(documents(spark).select("doc_id", "text"))
    planted = []
    for j, i in enumerate([0, 1, 2, 2, 3, 8]):
        w = items[i][1].split()
        if j == 3:
            w[5] = "swapped"
        planted.append((500 + j, words(rnd, 50) + " " + " ".join(w).upper() + ". " + words(rnd, 30)))
    near = items[1][1].split()
    near[10] = near[15] = near[20] = "other"
    planted.append((600, " ".join(near)))
    df = documents(spark).select("doc_id", "text", "fp").union(spark.createDataFrame([(a, b, 1) for a, b in planted], "doc_id long, text string, fp long"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(str(r["doc_id"]), r["item_id"]) for r in rows(decontaminate.contaminated(df, bench))}
    want = _contaminated(docs + [{"doc_id": a, "text": b} for a, b in planted], [{"item_id": a, "text": b} for a, b in items])
    assert got == want and len({d for d, _ in got}) >= 5
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_kernel_equals_its_definition_and_tolerates_gaps():
    marks = ["worthless", "lowei", "disgusting"]
    m = toxicity.Matcher(marks)
    rnd = random.Random(7)
    some = ["worthless", "loweichaft", "wxorthlesxs", "lo", ""] + ["".join(rnd.choice("worthlesxidgun") for _ in range(rnd.randint(3, 16))) for _ in range(200)]
    for w in some:
        if w:
            want = [k if (k := toxicity.kernel(w, x)) >= toxicity.LEAST else 0 for x in marks]
            assert m._kernels([w])[0] == pytest.approx(want, abs=1e-4)
    assert toxicity.kernel("wxorthlesxs", "worthless") > 0.5 > toxicity.kernel("clean", "worthless")
    assert "idiot" in toxicity.words_of("you i d i o t!") and "idiot" in toxicity.words_of("an i-d.i*o_t")


def test_toxicity_learns_held_out_labels(spark):
    rnd = random.Random(8)
    insults = ["idiot", "worthless", "scumbag", "moronic"]
    data, labels = [], []
    for i in range(600):
        w = words(rnd, 30).split()
        toxic = i % 4 == 0
        if toxic:
            bad = rnd.choice(insults)
            if i % 8 == 0 and i % 5 == 0:
                bad = bad[:2] + "x" + bad[2:]
            w[rnd.randrange(30)] = bad
        data.append((i, " ".join(w), i))
        labels.append((i, int(toxic)))
    data += [(900, None, 0), (901, "", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, score int")
    known = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known.where(~registry.held_out()))
    scores = {r["doc_id"]: r["score"] for r in rows(toxicity.score(docs, model))}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[900] == scores[901] < 0.5
    held = [i for i, _ in labels if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    right = sum((scores[i] >= 0.5) == bool(dict(labels)[i]) for i in held)
    assert right >= 0.95 * len(held)
    one = toxicity.fit(docs, known.where("toxic = 0"))
    assert {r["score"] for r in rows(toxicity.score(docs, one))} and max(r["score"] for r in rows(toxicity.score(docs, one))) < 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0


PAGES = {
    "<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>The one &amp; the <b>other</b>.<br>Next</article><footer>End of it</footer></body></html>": "Title The one & the other. Next",
    "<article><p>Short.</p><div class='ad banner'>Buy the thing that you want and need now, it is on sale</div><form>Your name <input></form><section id=comments><p>First! I like it and so does he</p></section></article>": "Short.",
    "<div class=sidebar>x</div><main><p>a  b\n c</p><script>if(a<b){'</p>'}</script><style>p{}</style><aside>no</aside></main>": "a b c",
    "<p>" + "The cat and the dog are in the house with a friend of the family and it is late. " * 2 + "<p><a href=1>One</a> <a href=2>Two</a>": ("The cat and the dog are in the house with a friend of the family and it is late. " * 2).strip(),
    "": "",
    None: "",
    "<article><p>un<i>clos</i>ed &lt;tag&gt; &#233;": "unclosed <tag> é",
    "<!-- a <p> --><article><p title='a > b'>quoted</p></article>": "quoted",
    "<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>Body</p><ul><li>one</ul></article><div id='comments'><article><p>nice post</article></div>": "T Body one",
    "<article><p>one <a href=2>link text here</a></p><p><a href=3>all link</a></p></article>": "one link text here",
    "<div id=content><h2>Head</h2><p>" + "zz yy xx " * 12 + "</p><p>Short one.</p></div><div class='cookie-notice'>We use cookies</div>": "Head " + ("zz yy xx " * 12).strip() + " Short one.",
    "<article class='comment'><p>reader says so</p></article><article><p>body</p></article>": "body",
}


def test_html_extraction(spark):
    pages = spark.createDataFrame([(i, None, p, "t") for i, p in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in rows(html_extract.main_text(pages))}
    assert got == dict(enumerate(PAGES.values()))


def test_url_rules_and_mining(spark):
    urls = [None, "no scheme", "HTTP://Sub.EXAMPLE.com/en/7x?q#f", "a://x.com/en/1", "a://com/en/", "a://xcom/en/", "a://b.net/de/8", "a://example.net/de/80", "a://b.org/es/1", "x://h?a/b", "x://h#a://b", "x://"]
    got = {r["page_id"]: r for r in rows(url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame([], "url string, blocked boolean"), registry.URL_RULES))}
    seen = [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))]
    assert seen == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("sub.example.com", "/en/7x", "example.com/en/7", "allow"), ("x.com", "/en/1", "com/en/", "block"),
        ("com", "/en/", "com/en/", "block"), ("xcom", "/en/", None, "allow"), ("b.net", "/de/8", "net/de/", "allow"), ("example.net", "/de/80", "example.net/de/8", "block"),
        ("b.org", "/es/1", "org/es/", "block"), ("h", "", None, "allow"), ("h", "", None, "allow"), ("", "", None, "allow"),
    ]
    labelled = [(f"http://{'cheap-pills' if i % 3 == 0 else 'good'}.site{i % 5}.io/fr/{i}", i % 3 == 0) for i in range(120)] + [("http://z.io/", None)]
    known = spark.createDataFrame(labelled, "url string, blocked boolean")
    rules = url_filter.mine(known)
    for r in rows(rules):
        own = [(set(t), b) for t, b in [(x["t"], x["blocked"]) for x in rows(known.where("blocked is not null").select(url_filter.tokens(F.col("url")).alias("t"), "blocked"))]]
        hit = [b for t, b in own if set(r["items"]) <= t]
        assert sum(hit) / len(hit) == pytest.approx(r["confidence"])
    fresh = spark.createDataFrame([(0, "https://www.cheap-pills.site9.io/fr/1"), (1, "https://good.site1.io/fr/2")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in rows(url_filter.judge(fresh, known, registry.URL_RULES))} == {0: "block", 1: "allow"}


def test_licences_and_inheritance(spark):
    files = [
        ("a", "repo/LICENSE", "Released under the MIT License."),
        ("b", "repo/src/x.py", "some code\nand more"),
        ("c", "repo/vendor/y.py", "code\n  Licensed under the Apache License, Version 2.0.\nmore code here that says nothing of the kind"),
        ("d", "repo/vendor/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("e", "repo/vendor/deep/er/z.py", "code"),
        ("f", "other/w.py", "the licensed driver released a statement"),
        ("g", None, None),
        ("h", "top.py", ""),
    ]
    df = spark.createDataFrame([(*f, 1) for f in files], "file_id string, path string, text string, license int")
    got = {r["file_id"]: (r["license"], r["how"], r["from_dir"]) for r in rows(licenses.scan(df, licenses.templates(spark)))}
    assert got == {
        "a": ("MIT", "file", None), "b": ("MIT", "inherited", "repo"), "c": ("Apache-2.0", "header", None), "d": ("GPL-3.0", "file", None),
        "e": ("GPL-3.0", "inherited", "repo/vendor"), "f": (None, "none", None), "g": (None, "none", None), "h": (None, "none", None),
    }
    assert licenses.scan(df.limit(0), licenses.templates(spark)).count() == 0


def test_pages_give_headline_and_document(spark, sf_dir):
    """The number that ends a page's path names the document that its article was made from."""
    import html
    import re

    documents_of = {r["doc_id"]: r["text"] for r in rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
    found = {r["page_id"]: r["text"] for r in rows(html_extract.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")))}
    seen = 0
    for page in rows(spark.read.parquet(f"{sf_dir}/pages.parquet")):
        number = re.search(r"/(\d+)[^/]*$", page["url"] or "")
        text = documents_of.get(int(number[1])) if number else None
        if text:
            head = re.search(r"<h1[^>]*>(.*?)</h1>", page["html"], re.S)
            assert found[page["page_id"]].split() == html.unescape(re.sub("<[^>]*>", "", head[1])).split() + text.split()
            seen += 1
    assert seen > 10


def test_broken_and_huge_pages_take_linear_time(spark):
    import time

    began = time.perf_counter()
    assert html_extract.extract("<p>the one and only</p><div " + " ".join('a=""' for _ in range(5000))) == "the one and only"
    assert html_extract.extract("<p title=it's>one</p><p>two</p>") == "one two"
    assert html_extract.extract("".join(f"<p>w{i}</p>" for i in range(50_000))).count(" ") == 49_999
    for part in ("<a ", "<!x", '<p a="x', "<![CDATA[", '<script a="', "<div>"):
        html_extract.extract(part * 50_000 + "</b>" * 1000)
    assert time.perf_counter() - began < 30
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.main_text(none).count() == 0
    big = (1 << 60) + 1
    odd = spark.createDataFrame([(big, None, "<p>a"), (None, None, None), (big, None, "<p>a")], "page_id long, url string, html string").coalesce(1)
    assert Counter((r["page_id"], r["text"]) for r in rows(html_extract.main_text(odd))) == {(big, "a"): 2, (None, ""): 1}


def test_url_filter_of_no_pages_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/1", 0)] * 3 + [(None, None, 0)], "page_id long, url string, verdict int")
    nothing = spark.createDataFrame([], "url string, blocked boolean")
    got = Counter((r["page_id"], r["verdict"]) for r in rows(url_filter.judge(pages, nothing, registry.URL_RULES)))
    assert got == {(1, "block"): 3, (None, "allow"): 1}
    assert url_filter.judge(pages.limit(0), nothing, registry.URL_RULES).count() == 0


def test_toxicity_of_repeated_ids_and_long_texts(spark):
    rnd = random.Random(11)
    data = [(i, words(rnd, 20) + (" worthless scumbag" if i % 2 else "")) for i in range(200)]
    data += [(7, "short")] * 300 + [(500, words(rnd, 20000) + " worthless scumbag")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(200)] * 2, "doc_id long, toxic int")
    model = toxicity.fit(docs, known, max_rows=150)
    scores = {r["doc_id"]: r["score"] for r in rows(toxicity.score(docs.where("doc_id <> 7"), model))}
    assert scores[500] >= 0.5 and sum((scores[i] >= 0.5) == bool(i % 2) for i in range(200) if i != 7) >= 190


def test_names_and_attributes_that_are_no_marks():
    text = "The quick brown fox of the story was in the garden and it is not on the way to the house with the old man, as it was for the others."
    kept = [
        '<div class="overflow-hidden"><p>{}</p></div>',
        '<article><div class="overflow-hidden"><p>{}</p></div></article>',
        '<p title="the hidden truth">{}</p>',
        '<div class="content has-sidebar"><p>{}</p></div>',
        '<p data-id="share">{}</p>',
        '<p class="related-work">{}</p>',
        '<div class="related-work"><p>{}</p></div>',
        "<div data-role=menu data-class='ad'><p>{}</p></div>",
        '<div hidden="until-found" style="color: red"><p>{}</p></div>',
    ]
    for page in kept:
        assert html_extract.extract("<body>" + page.format(text)) == text, page
    gone = [
        "<div hidden><p>{}</p></div>",
        '<div aria-hidden="true"><p>{}</p></div>',
        "<div style='display : none'><p>{}</p></div>",
        '<div class="wide comments"><p>{}</p></div>',
        '<ul id="sidebar"><li>{}</li></ul>',
        '<p class="notice">{}</p>',
    ]
    for page in gone:
        assert html_extract.extract("<body>" + page.format(text)) == "", page
    for name in ("site-footer", "cookieNotice", "post-list related-posts", "comment-list"):
        page = f'<body><div class="{name}"><p>{text} Not this.</p></div><div class="page"><p>{text}</p></div>'
        assert html_extract.extract(page) == text, name
