"""Operators that have to see all of their input, against results known beforehand."""

import random
from collections import Counter

from keyfold.llm import exact_dedup, html_extract, near_dedup


def prose_of(seed, n=60):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def changed(words):
    return [*words[:-1], "other"]


SAME_IDS = [(7, prose_of(1)), (None, changed(prose_of(1))), (None, prose_of(2)), (9, prose_of(3)), (None, changed(prose_of(3))), (5, prose_of(4)), (5, prose_of(5)), (6, changed(prose_of(5))), *[(None, prose_of(6))] * 5]


def test_texts_with_the_same_id_or_none_are_not_one(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in SAME_IDS], "doc_id long, text string").repartition(3)
    want = Counter([(7, 7), (None, 7), (None, None), (9, 9), (None, 9), (5, 5), (5, 5), (6, 5), *[(None, None)] * 5])
    for group in (near_dedup.GROUP, 60):
        monkeypatch.setattr(near_dedup, "GROUP", group)
        got = near_dedup.near_components(docs).collect()
        assert Counter((r.doc_id, r.component_id) for r in got) == want
    kept = Counter((r.doc_id, r.text) for r in near_dedup.keep_one(docs).collect())
    assert kept[None, " ".join(prose_of(2))] == 1 and kept[9, " ".join(prose_of(3))] == 1 and kept[7, " ".join(prose_of(1))] == 1


def test_pages_whose_article_is_not_the_main_text(spark):
    words = lambda n: " ".join(f"word{n}{i}" for i in range(30))
    main = f"<div class=content><p>{words('a')}</p><p>{words('b')}</p></div>"
    pages = {
        1: f"<body>{main}<article class=comment><p>A reader says so</p></article></body>",
        2: f"<body>{main}<aside><article><p>A teaser</p></article></aside></body>",
        3: f"<body><!-- <article> -->{main}<script>'<main >'</script></body>",
        4: f"<body><div><p>{words('c')}</p></div><article>{main}</article></body>",
    }
    got = html_extract.extract(spark.createDataFrame([(i, "u", h) for i, h in pages.items()], "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == dict.fromkeys(pages, f"{words('a')}\n{words('b')}")


def test_the_scan_leaves_out_links_outside_articles():
    links = "<div>" + "<a href=x>one two three</a> " * 9 + "</div>"
    weights = html_extract.fit([f"<body>{links}<article><p>{'word ' * 99}</p></article>{links}</body>"] * 30)
    assert html_extract.main_text(f"<body>{links}<div><p>the text of it</p></div>{links}</body>", weights) == "the text of it"


def test_stages_leave_one_row_of_repeated_ones(spark):
    a, b, c = (" ".join(prose_of(n)) for n in (11, 12, 13))
    texts = [(1, a), (1, a), (1, a + " "), (2, a), *[(None, b)] * 6, (None, " " + b), (3, c), (3, c), *[(None, None)] * 2, (4, " ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    kept = Counter(map(tuple, exact_dedup.keep_single(docs).collect()))
    assert kept == Counter([(1, a + " "), (None, " " + b), (3, c), (4, " ")])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in SAME_IDS] + [(7, " ".join(prose_of(1))), (5, " ".join(changed(prose_of(4))))], "doc_id long, text string").repartition(3)
    kept = Counter(map(tuple, near_dedup.keep_single(docs).collect()))
    assert sum(kept.values()) == 6 and all((i, " ".join(prose_of(n))) in kept for i, n in ((7, 1), (None, 2), (9, 3), (None, 6)))
    assert sorted(i for i, _ in kept if i == 5) == [5, 5]
