import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from iqspark.llm import decontamination, html_text, language_id, licenses, repetition

SENTENCE = "The river rose through the night, and by the morning the lower fields were under water, as the older people had said."
MORE = "Nobody had moved the boats, so the men walked along the wall with ropes and lamps until the wind fell and the rain stopped."
LAST = "What was left of the bridge stood for another year, until the new road came and nobody needed it any more."
COMMENT = "I was there in that year and I can tell you that all of this is quite wrong, as my father had the third boat, not the second one."
TEXT = f"<h1>The flood</h1><p>{SENTENCE}</p><p>{MORE}</p><p>{LAST}</p>"
WANT = f"The flood\n{SENTENCE}\n{MORE}\n{LAST}"
LINKS = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News of the week</a></li><li><a href=/c>Contact us</a></li></ul>"
MANY = "".join(f"<li class='comment-item'><p>{COMMENT} {k}</p></li>" for k in range(8))

LAYOUTS = {
    "plain article": f"<body><nav>{LINKS}</nav><article>{TEXT}</article><footer>All rights</footer></body>",
    "comments after the article in main": f"<body><main><article>{TEXT}</article><div class='comment-list'>{MANY}</div></main></body>",
    "comments within the article": f"<body><article>{TEXT}<section id='comments-area'><ol>{MANY}</ol></section></article></body>",
    "comments without hyphens": f"<body><div>{TEXT}</div><div class='commentList'>{MANY}</div></body>",
    "comments as articles": f"<body><article class='post'>{TEXT}</article><ol><li><article class='comment-body'><p>{COMMENT}</p></article></li></ol></body>",
    "site footer by class": f"<body><main>{TEXT}</main><div class='site-footer'><p>{COMMENT}</p></div></body>",
    "cookie banner": f"<body><div class='cookie-banner'><p>{COMMENT}</p></div><main>{TEXT}</main></body>",
    "cookie notice by id": f"<body><main>{TEXT}</main><div id='cookieNotice'><p>{COMMENT}</p></div></body>",
    "site header by class": f"<body><div class='site-header'><p>{COMMENT}</p></div><div class='content'>{TEXT}</div></body>",
    "article header stays": f"<body><article><header><h1>The flood</h1></header><p>{SENTENCE}</p><p>{MORE}</p><p>{LAST}</p></article></body>",
    "left sidebar": f"<body><div class='sidebar-left'><p>{COMMENT}</p></div><div class='page'><div class='post'>{TEXT}</div></div></body>",
    "layout that says it has a sidebar": f"<body><div class='layout with-sidebar'><div>{TEXT}</div></div></body>",
    "menu around the article": f"<body><div class='main-nav'>{LINKS}<article>{TEXT}</article></div></body>",
    "advert between paragraphs": f"<body><article><h1>The flood</h1><p>{SENTENCE}</p><div class='ad-slot'>Buy one boat and get another one free of charge today.</div><p>{MORE}</p><p>{LAST}</p></article></body>",
    "newsletter and search forms": f"<body><form><p>{COMMENT}</p></form><article>{TEXT}</article><div class='newsletter-signup'><p>{COMMENT}</p></div></body>",
    "no article, only divs": f"<body><div id='top-menu'>{LINKS}</div><div><div>{TEXT}</div></div><div id='footer'><p>{COMMENT}</p></div></body>",
    "body that says comments are open": f"<body class='single comments-open'><article class='post has-comments'>{TEXT}</article></body>",
    "a teaser is the only article": f"<body><div>{TEXT}</div><aside><article><p>Read more.</p></article></aside></body>",
    "scripts, styles and hidden text": f"<body><script>var a = '<p>{COMMENT}</p>'</script><style>p {{}}</style><article>{TEXT}<p hidden>{COMMENT}</p></article></body>",
    "pages of links and references": f"<body><div class='breadcrumbs'>{LINKS}</div><div role='main'>{TEXT.replace('flood', 'fl&#111;od')}</div><div class='pagination'>{LINKS}</div></body>",
    "replies": f"<body><article>{TEXT}</article><div class='post-replies'>{MANY}</div></body>",
    "popup": f"<body><div class='popup_overlay'><p>{COMMENT}</p></div><article>{TEXT}</article></body>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_give_the_whole_article_and_nothing_else(name):
    assert html_text.main_text(LAYOUTS[name]) == WANT


def sums_by_hand(page):
    """Density sums of a page's nodes, each from the texts below it alone."""
    n = len(page.tag)
    below = [[j for j in range(n) if j == k or any(p == k for p in parents(page, j))] for k in range(n)]
    body = page.tag.index("body") if "body" in page.tag else 0
    chars = lambda k: sum(page.chars[j] for j in below[k])
    linked = lambda k: sum(page.link_chars[j] for j in below[k])
    share = linked(body) / chars(body) if chars(body) else 0.0
    density = [html_text.composite_density(chars(k), linked(k), len(below[k]) - 1, sum(page.tag[j] == "a" for j in below[k]), share) for k in range(n)]
    return density, [sum(density[j] for j in range(1, n) if page.parent[j] == k) for k in range(n)]


def parents(page, k):
    while k:
        k = page.parent[k]
        yield k


def test_the_chosen_node_is_that_of_brute_force():
    """On pages without names that drop anything, the text is that of the first node with the largest sum."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        blocks = "".join(f"<div>{''.join(f'<p>{SENTENCE[: int(rng.integers(5, 100))]}</p>' for _ in range(rng.integers(1, 5)))}{'<a href=x>link</a>' * int(rng.integers(0, 4))}</div>" for _ in range(rng.integers(1, 5)))
        page = html_text.Page(f"<html><body>{blocks}</body></html>")
        density, sums = sums_by_hand(page)
        got = html_text.Densities(page)
        assert np.allclose(got.density, density) and np.allclose(got.sums, sums)
        fit = [k for k in range(len(page.tag)) if sums[k] > 0 and page.tag[k] in ("#root", "div", "body", "html")]
        best = max(fit, key=lambda k: (round(sums[k], 9), -k))
        kept = html_text.chosen(page)
        assert all(kept[j] for j in range(len(page.tag)) if j == best or best in parents(page, j))


def test_languages_of_few_rows_are_learned(spark):
    rng = np.random.default_rng(8)
    words = {"en": "the river and the night were long over there".split(), "sr": "ријека ноћ била дуга тамо преко".split(), "fi": "joki yö oli pitkä tuolla yli".split(), "cs": "řeka noc byla dlouhá tam přes".split()}
    many = [(k, " ".join(rng.choice(words["en"], 20)), "en") for k in range(200)]
    for first in range(0, 40, 8):  # the rows' ids, and so their hashes, differ
        few = [(1000 + first + k, " ".join(rng.choice(words[lang], 20)), lang) for k, lang in enumerate(["sr"] + ["fi"] * 2 + ["cs"] * 5)]
        docs = spark.createDataFrame(many + few, "doc_id long, text string, lang string")
        model = language_id.train(docs)
        assert [model.predict(t)[0] for _, t, _ in few] == [lang for *_, lang in few]
        assert all(model.predict(t)[0] == "en" for _, t, _ in many[:20])
    alike = spark.createDataFrame([(None, "joki yö oli pitkä", "fi")] * 50 + [(None, "the river was long", "en")] * 50, "doc_id long, text string, lang string")
    model = language_id.train(alike)
    assert model.predict("joki yö oli pitkä")[0] == "fi" and model.predict("the river was long")[0] == "en"
    assert len(language_id.train(docs, most_langs=2).langs) == 2


def test_a_language_model_keeps_the_columns_of_the_table(spark):
    docs = spark.createDataFrame([(k, "the river was long", "en", 7.5, "mine") for k in range(5)], "doc_id long, text string, lang string, score double, lang_pred string")
    got = language_id.predict(docs, language_id.train(docs), ("__l", "__s")).first()
    assert (got.score, got.lang_pred, got["__l"]) == (7.5, "mine", "en")


def brute_matches(docs, items, min_windows=3, min_share=0.3, k=8):
    """Items of plain lower-case words that a document holds, by counting the item's windows in it."""
    out = set()
    for d, text in docs:
        w = text.split()
        have = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i, item in items:
            v = item.split()
            n = max(1, len(v) - k + 1)
            hit = sum(tuple(v[j : j + k]) in have for j in range(n)) if len(v) >= k else int(any(w[j : j + len(v)] == v for j in range(len(w) - len(v) + 1)))
            if hit >= min(min_windows, n) and hit >= min_share * n:
                out.add((d, i))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_contamination_is_that_of_brute_force(spark, seed):
    """Items that share an instruction, are copies of each other, or are short; documents with parts of them."""
    rng = np.random.default_rng(seed)
    draw = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    rule = "please answer the following question in one short sentence and explain each step of your answer"
    items = [(k, f"{draw(int(rng.integers(10, 60)))} {rule if k % 2 else ''}") for k in range(40)] + [(100, draw(30)), (102, "only five words are here")]
    items.append((101, items[-2][1]))
    docs = []
    for k in range(120):
        parts = [draw(int(rng.integers(0, 40)))]
        for _ in range(rng.integers(0, 3)):
            w = items[rng.integers(len(items))][1].split()
            a, b = sorted(rng.integers(0, len(w) + 1, 2))
            parts += [" ".join(w[a:b]), draw(3)]
        if k % 5 == 0:
            parts.append(rule)
        docs.append((k if k % 7 else None, " ".join(parts) + f" end{k}"))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.text_key, r.item_id) for r in decontamination.template_matches(d, b).collect()}
    keys = {r.text: r.k for r in d.select("text", F.xxhash64("text").alias("k")).collect()}
    # Words like w12 have digits and are numbers to the templates: letters only.
    assert {(keys[t], i) for t, i in brute_matches([(t, t) for _, t in docs], items)} - got == set()
    letters = lambda t: re.sub(r"[0-9]", lambda m: "abcdefghij"[int(m[0])], t)
    d, b = ([(i, letters(t)) for i, t in rows] for rows in (docs, items))
    want = brute_matches([(t, t) for _, t in d], b)
    frame = spark.createDataFrame(d, "doc_id long, text string")
    keys = {r.text: r.k for r in frame.select("text", F.xxhash64("text").alias("k")).collect()}
    got = {(r.text_key, r.item_id) for r in decontamination.template_matches(frame, spark.createDataFrame(b, "item_id long, text string")).collect()}
    assert got == {(keys[t], i) for t, i in want} and len(want) > 20
    rows = decontamination.contaminated(frame, spark.createDataFrame(b, "item_id long, text string")).collect()
    assert len(rows) == len(d) and sum(r.contaminated for r in rows) == len({t for t, _ in want})
    assert any(r.doc_id is None and r.contaminated for r in rows)


def test_broken_text_is_read_with_replacement(spark):
    docs = spark.range(3).selectExpr("id AS doc_id", "'en' AS lang", "id AS page_id", "'http://x' AS url", "cast(concat(cast(repeat('all rights reserved ', 20) as binary), if(id = 1, X'C3', X'')) AS string) AS text").withColumn("html", F.expr("cast(concat(cast('<p>' as binary), cast(text as binary), cast('</p>' as binary)) as string)"))
    assert {r.n_base for r in licenses.scan(docs).collect()} == {20}
    assert repetition.quality(docs).count() == 3
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs.select("doc_id", "text"), language_id.train(docs.where("doc_id != 1"))).collect()} == {0: "en", 1: "en", 2: "en"}
    assert language_id.train(docs).langs == ["en"]
    got = {r.page_id: r.text for r in html_text.extract(docs).collect()}
    assert got[1] == got[0] + " �"


def test_stages_keep_columns_of_their_own_names(spark, tmp_path):
    """Columns named like those of a method, and of types that have no order, come through all stages but the last."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice("the river and the night were long over there by a wall of old stone with boats".split(), 40)) for _ in range(40)]
    rows = [(k, texts[k % 40], "en", "s", 1, -7.0, "mine", "x", "y", 3, {"k": k}) for k in range(80)] + [(5, texts[5], "en", "s", 1, -7.0, "mine", "x", "y", 3, {"k": 5})] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score double, copy string, lang_pred string, d string, position int, text_key map<string,int>")
    spark.createDataFrame([(1, "no such words stand in any of these documents at all today")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.write.parquet(f"{tmp_path}/{name}")
        out = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), str(tmp_path))
        assert out.columns == docs.columns, name
        docs = out
    got = docs.collect()
    assert got and {(r.score, r["copy"], r.lang_pred, r.d, r.position) for r in got} == {(-7.0, "mine", "x", "y", 3)}
