"""Parsers on small inline inputs."""

import json

import pytest
from pyspark.sql import functions as F

from risewatch import schemas as S
from risewatch.functions import dates, text
from risewatch.sources import activity, files, news, patents, repos, scholarly


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("r")).first().r


def test_jsonl_round_trip(spark, tmp_path):
    schema = "id string, n bigint"
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), schema).count() == 0
    (tmp_path / "a.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": 2}\n')
    df = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema)
    assert df.count() == 2
    out = str(tmp_path / "out")
    files.write_jsonl(df, out)
    files.write_jsonl(df, out, "append")
    assert files.read_jsonl(spark, out, schema).count() == 4
    files.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    raw = str(tmp_path / "raw")
    files.write_raw(df, raw, "arxiv", "2026-01-01")
    files.write_raw(df, raw, "arxiv", "2026-01-02")
    files.write_raw(df.limit(1), raw, "arxiv", "2026-01-02")
    assert spark.read.parquet(raw).count() == 3


def test_openalex(spark):
    raw = {
        "id": "https://w/W1", "title": "T", "publication_date": "2024-01-02", "doi": None,
        "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "cited_by_count": 3,
        "concepts": [{"id": "https://w/C1", "display_name": "One", "score": 0.5}],
        "authorships": [{"author": {"id": "https://w/A1", "display_name": "Ann"}, "institutions": [{"id": "https://w/I1", "display_name": "Inst"}]}],
    }
    df = spark.read.schema(S.RAW_WORK).json(spark.sparkContext.parallelize([json.dumps(raw), json.dumps({"id": "x"})]))
    rows = {r.id: r for r in scholarly.normalize_openalex(df).collect()}
    r = rows["https://w/W1"]
    assert r.abstract == "a b a" and r.concepts[0].name == "One" and r.authorships[0].institutions[0].name == "Inst"
    assert rows["x"].abstract is None and rows["x"].concepts == [] and rows["x"].referenced_works == []


def test_crossref(spark):
    raw = {
        "DOI": "10.1/AbC", "title": [], "container-title": ["Journal"], "abstract": "<jats:p>A &lt;b&gt; &amp; c</jats:p>",
        "subject": ["AI", ""], "issued": {"date-parts": [[2024, 5]]}, "author": [{"given": "Ann", "family": "Lee"}, {"family": "Xu"}],
        "reference": [{"DOI": "10.2/x"}, {}],
    }
    df = spark.read.schema(S.RAW_DOI_WORK).json(spark.sparkContext.parallelize([json.dumps(raw)]))
    r = scholarly.normalize_crossref(df).first()
    assert (r.id, r.doi, r.title, r.publication_date, r.abstract) == ("doi:10.1/abc", "10.1/AbC", "Journal", "2024-05", "A & c")
    assert [c.id for c in r.concepts] == ["crossref:AI"] and [a.author.name for a in r.authorships] == ["Ann Lee", "Xu"]
    assert r.referenced_works == ["10.2/x"]


@pytest.mark.parametrize("parts,want", [([[2024]], "2024"), ([[2024, 5]], "2024-05"), ([[2024, 5, 7]], "2024-05-07"), ([], None)])
def test_date_parts(spark, parts, want):
    assert one(spark, dates.date_from_parts, parts, "v array<array<int>>") == want


def test_arxiv(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<feed><entry><id>http://h/abs/2301.00001v2</id><title> T </title><summary>S</summary><published>2023-01-02T00:00:00Z</published>"
        '<category term="cs.AI"/><category term="cs.LG"/><author><name>Ann</name></author><author><name>Bo</name></author></entry></feed>'
    )
    r = scholarly.normalize_arxiv(scholarly.read_atom(spark, str(tmp_path / "a.xml"))).first()
    assert (r.id, r.title, r.publication_date) == ("arxiv:2301.00001", "T", "2023-01-02")
    assert r.categories == ["cs.AI", "cs.LG"] and [a.name for a in r.authors] == ["Ann", "Bo"]
    assert one(spark, scholarly.preprint_id, "http://h/abs/solv-int/9501001v1") == "arxiv:solv-int/9501001"


DOC = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE us-patent-grant SYSTEM "x.dtd" [ ]>
<us-patent-grant><us-bibliographic-data-grant>
<publication-reference><document-id><country>US</country><doc-number>0123</doc-number><kind>B2</kind><date>20240305</date></document-id></publication-reference>
<classifications-cpc><main-cpc><classification-cpc><section>G</section><class>06</class><subclass>N</subclass></classification-cpc></main-cpc>
<further-cpc><classification-cpc><section>G</section><class>06</class><subclass>N</subclass></classification-cpc><classification-cpc><section>H</section><class>04</class><subclass>L</subclass></classification-cpc></further-cpc></classifications-cpc>
<invention-title id="d1">A &amp; B</invention-title>
<us-references-cited><us-citation><patcit><document-id><country>US</country><doc-number>77</doc-number><date>20010203</date></document-id></patcit></us-citation>
<us-citation><patcit><document-id><country>JP</country><doc-number>88</doc-number></document-id></patcit></us-citation>
<us-citation><patcit><document-id><doc-number>99</doc-number></document-id></patcit></us-citation>
<us-citation><nplcit>text</nplcit></us-citation></us-references-cited>
<us-parties><inventors><inventor><addressbook><last-name>Lee</last-name><first-name>Ann</first-name></addressbook></inventor>
<inventor><addressbook><last-name>Lee</last-name><first-name>Ann</first-name></addressbook></inventor></inventors></us-parties>
<assignees><assignee><addressbook><orgname>Org &amp; Co</orgname></addressbook></assignee></assignees>
</us-bibliographic-data-grant><abstract><p id="p1"> First. </p><p>Second.</p></abstract></us-patent-grant>
"""


def test_patent_xml(spark, tmp_path):
    bad = '<?xml version="1.0"?>\n<us-patent-grant><open></us-patent-grant>\n'
    (tmp_path / "ipgb20240305.xml").write_text(DOC + bad + DOC.replace("0123", "0456").replace("<assignees>", "<x>").replace("</assignees>", "</x>"))
    docs = patents.read_concat_xml(spark, str(tmp_path / "*.xml"))
    assert docs.count() == 2 and docs.first().file_date == "20240305"
    rows = {r.id: r for r in patents.parse_patent_biblio(docs).collect()}
    r = rows["uspto:0123"]
    assert (r.title, r.abstract, r.publication_date, r.kind) == ("A & B", "First. Second.", "2024-03-05", "B2")
    assert r.cpc == ["G06N", "H04L"] and r.inventors == ["Ann Lee"] and r.assignees == ["Org & Co"]
    assert rows["uspto:0456"].assignees == []
    cites = patents.patent_backward_citations(docs).where("citing = 'uspto:0123'").collect()
    assert {(c.cited, c.cited_date, c.citing_date) for c in cites} == {
        ("uspto:77", "20010203", "2024-03-05"), ("uspto:99", "", "2024-03-05"),
    }


def test_patent_tables(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("patent_id\tcitation_id\tdate\nA\tB\t5/6/1999\nA\t\t\nC\tA\t2001-02-03\n")
    (tmp_path / "p.tsv").write_text("patent_id\tpatent_date\nA\t2000-01-01\n")
    rows = patents.citations_from_tsv(patents.read_tsv(spark, str(tmp_path / "c.tsv")), patents.read_tsv(spark, str(tmp_path / "p.tsv"))).collect()
    assert {tuple(r) for r in rows} == {
        ("uspto:A", "2000-01-01", "uspto:B", ""), ("uspto:C", "2001-02-03", "uspto:A", "2000-01-01"),
    }
    df = spark.createDataFrame([(" 1 ", "2", "2020-01-01", None), ("", "3", "x", "y")], "patent string, cited_by string, cited_by_date string, publication_date string")
    assert [tuple(r) for r in patents.citations_from_csv(df).collect()] == [("uspto:2", "2020-01-01", "uspto:1", "")]


@pytest.mark.parametrize("raw,want", [("1/2/49", "2049-01-02"), ("1/2/51", "1951-01-02"), ("a/b/c", ""), ("2020-01-02T03", "2020-01-02"), ("", ""), ("20200102", "20200102")])
def test_clean_date(spark, raw, want):
    assert one(spark, dates.clean_date, raw) == want


def test_gkg(spark):
    line = lambda i, themes, tone: "\t".join([i, "20240102030405", *["x"] * 6, themes, *["y"] * 3, "Ann,1;Bo,2;Ann,3", "z", "Org,4", tone])
    lines = [line("GKGRECORDID", "t", "1"), line("g1", "AI,1;ML,2", "-1.5,2"), line("g2", "WAR,3", "bad"), "short\trow"]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    rows = {r.id: r for r in news.normalize_gkg(df).collect()}
    assert set(rows) == {"gdelt:g1", "gdelt:g2"}
    r = rows["gdelt:g1"]
    assert (r.persons, r.themes, r.tone, r.publication_date) == (["Ann", "Bo"], ["AI", "ML"], -1.5, "2024-01-02")
    assert r.text == "themes:AI, ML persons:Ann, Bo orgs:Org" and rows["gdelt:g2"].tone is None
    assert [r.id for r in news.normalize_gkg(df, ["ML"]).collect()] == ["gdelt:g1"]
    assert one(spark, text.split_counts, "x,1;y,2;x,3") == ["x", "y"]


def test_rss(spark):
    df = spark.createDataFrame(
        [("http://l", " T ", "<p>a&nbsp;&#38;<br>b</p>", "Tue, 05 Mar 2024 10:00:00 GMT", None), ("m", None, None, None, "2024-01-02T00:00")], S.RAW_FEED_ITEM
    )
    rows = {r.url: r for r in news.normalize_rss(df).collect()}
    assert rows["http://l"].publication_date == "2024-03-05" and rows["http://l"].text.replace("\xa0", " ") == "a & b"
    assert (rows["m"].publication_date, rows["m"].text, rows["m"].title) == ("2024-01-02", "", "")


def test_timeline(spark):
    payload = {"timeline": [{"series": "x"}, {"data": [{"date": "20240105T000000Z", "value": 3}, {"20240110000000": 4}, {"date": "20240301T0", "value": 5}]}, {"data": []}]}
    df = spark.createDataFrame([("ai", "AI", json.dumps(payload)), ("ml", "ML", "{}")], "topic_id string, topic_label string, payload string")
    windows = spark.createDataFrame([("2024-01", "2024-02"), ("2024-02", "2024-03")], "window_start string, window_end string")
    got = {(r.topic_id, r.window_start): r.activity_count for r in news.timeline_monthly(df, windows).collect()}
    assert got == {("ai", "2024-01"): 7, ("ai", "2024-02"): 0, ("ml", "2024-01"): 0, ("ml", "2024-02"): 0}


def test_count_payloads(spark):
    schema = "source string, topic_id string, topic_label string, window_start string, window_end string, payload string, error string"
    base = ("s", "t", "T", "2024-01", "2024-02")
    df = spark.createDataFrame([(*base, '{"message": {"total-results": 7}}', None), (*base, "{}", None), (*base, "<html>", None), (*base, None, "timeout")], schema)
    got = [(r.activity_count, r.collection_status) for r in activity.counts_from_payload(df, "crossref").collect()]
    assert got == [(7, "ok"), (0, "ok"), (None, "failed"), (None, "failed")]
    xml = "<feed xmlns:opensearch='u'><opensearch:totalResults>42</opensearch:totalResults></feed>"
    r = activity.counts_from_payload(spark.createDataFrame([(*base, xml, None)], schema), "arxiv").first()
    assert (r.activity_count, r.collection_status) == (42, "ok")
    r = activity.counts_from_payload(spark.createDataFrame([(*base, '{"queryStatus": {"totalResults": 9}}', None)], schema), "odp").first()
    assert r.activity_count == 9


def test_repos(spark):
    item = lambda i, name, stars, topic, seq, lang="Python": json.dumps(
        {"id": i, "full_name": name, "stargazers_count": stars, "forks_count": 2, "language": lang, "owner": {"login": "o"}, "topics": ["ai"],
         "created_at": "2024-01-01T00:00:00Z", "pushed_at": "2024-01-09T00:00:00Z", "topic_id": topic, "topic_label": topic, "_window": "w", "fetched_seq": seq}
    )
    raw = spark.read.schema(S.RAW_REPO).json(
        spark.sparkContext.parallelize([item(1, "a/b", 10, "ai", 1), item(1, "a/b", 30, "ai", 2), item(1, "a/b", 30, "ml", 3), item(2, "c/d", 5, "ai", 4, "Go")])
    )
    got = {r.id: r.stars for r in repos.normalize_repos(raw).collect()}
    assert got == {"github:a/b": 10, "github:c/d": 5}
    sig = {(r.topic_id, r.repo_id): r for r in repos.repo_signals(raw, "2024-01-11T00:00:00Z", ["Python"]).collect()}
    assert set(sig) == {("ai", 1), ("ml", 1)}
    assert sig[("ai", 1)].stars_total == 30 and sig[("ai", 1)].stars_per_day_lifetime == 3.0 and sig[("ai", 1)].activity_recent == 1


def test_text_functions(spark):
    assert one(spark, text.redact_url, "http://h/p?q=1&API_KEY=abc&token=z#f") == "http://h/p?q=1&API_KEY=%5BREDACTED%5D&token=%5BREDACTED%5D#f"
    assert one(spark, text.normalize_name, " Deep_Learning--(Neuronale Übung)! ") == "deep learning neuronale übung"
    assert one(spark, text.decode_entities, "a &amp; &#x41;&eacute;") == "a & Aé"
    assert one(spark, text.tail_id, "https://h/W1/") == "W1" and one(spark, text.tail_id, "") is None
    df = spark.createDataFrame([(None, " ", "Ann", "Lee"), ("Org", None, "x", "y"), (None, None, None, None)], "o string, n string, f string, l string")
    got = [r.r for r in df.select(text.address_name(F.col("o"), F.col("n"), F.col("f"), F.col("l")).alias("r")).collect()]
    assert got == ["Ann Lee", "Org", None]


def test_closed_references(spark):
    """A name without its semicolon is text, as in the SQL of the plain queries; the open form decodes it."""
    cases = {"a&amp </p>b": "a&amp b", "x &copy=1 &quo": "x &copy=1 &quo", "&amp;amp; &notit; &#65; &#x41;&middot;": "&amp; &notit; A A·"}
    for raw, want in cases.items():
        assert one(spark, lambda c: text.plain_summary(c, closed=True), raw) == want
        assert one(spark, lambda c: text.plain_abstract(c, closed=True), raw) == want
    assert one(spark, text.plain_summary, "a&amp </p>b") == "a& b"


def test_patent_files_are_compressed(spark, tmp_path, monkeypatch):
    """The files of the patent queries take a small part of the text they hold, and lose no document (F20, F21, F23)."""
    from risewatch.catalog import files as catalog

    folder = tmp_path / "patents"
    monkeypatch.setattr(catalog, "stream_folder", lambda *_: str(folder))
    docs = catalog.patent_files(spark, "/root/testdata/sf0.001")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert docs.count() == orders.where("o_orderkey % 10 <> 0").count()
    parts = [p for p in folder.iterdir() if p.name.startswith("part-")]
    assert all(p.suffix == ".gz" for p in parts)
    assert sum(p.stat().st_size for p in parts) < 200 * orders.count()
