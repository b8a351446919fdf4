import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_fixtures import prose  # noqa: E402

from risewatch.llm import license_scan as L  # noqa: E402


def run(spark, texts, **settings):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: [tuple(x) for x in r["licenses"]] for r in L.scan_licenses(docs, "text", **settings).collect()}


def test_each_template_is_found_whole(spark):
    names = sorted(L.TEMPLATES)
    texts = [prose(i, 40) + "\n" + L.TEMPLATES[n] + "\n" + prose(90 + i, 40) for i, n in enumerate(names)]
    got = run(spark, texts)
    for i, n in enumerate(names):
        hit = [h for h in got[i] if h[0] == n]
        assert len(hit) == 1 and hit[0][1] == 1.0
        start, end = hit[0][3:]
        assert L._WORD.findall(texts[i][start:end].lower()) == L._WORD.findall(L.TEMPLATES[n].lower())


def test_edited_notice_and_clean_texts(spark):
    words = L.TEMPLATES["mit-notice"].split()
    del words[10], words[30]
    words[50] = "whatever"
    words.insert(60, "surplus")
    got = run(spark, [" ".join(words), prose(1, 3000), "", None, "permission is hereby granted to nobody"])
    assert [h[0] for h in got[0]] == ["mit-notice"] and 0.93 < got[0][0][1] < 1
    assert all(got[i] == [] for i in range(1, 5))


def test_two_places_and_case(spark):
    text = "İ " + L.TEMPLATES["mit"].upper() + " -- " + prose(3, 50) + " " + L.TEMPLATES["mit"]
    hits = run(spark, [text])[0]
    assert [h[0] for h in hits] == ["mit", "mit"]
    assert [text[a:b].upper() for *_, a, b in hits] == ["RELEASED UNDER THE MIT LICENSE"] * 2


def test_other_templates(spark):
    assert run(spark, ["x alpha beta gamma delta y"], templates={"own": "alpha beta gamma delta"})[0][0][:2] == ("own", 1.0)
    assert run(spark, ["x"], templates={}) == {0: []}
