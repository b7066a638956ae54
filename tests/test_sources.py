import json

import pytest
from pyspark.sql import functions as F

from termweave.operators import network
from termweave.plans import pipeline
from termweave.sources import formats, readers, sinks
from termweave.streaming import increment

WOS = "FN Export\nVR 1.0\nPT J\nAU Doe, Jane\n   Roe, Max\nTI A long title\n   that goes on\nSO Journal of Tests\nDE fall detection; Smart Home.\nID TERM ONE; TERM TWO\nPY 2021\nTC 1,234\nCR Poe, 1999; Moe, 2000\nDI 10.1/x\nER\n\nPT J\nTI Second\nPY 2019\nER\nEF\n"
RIS = "TY  - JOUR\nAU  - Doe, Jane\nAU  - Roe, Max\nTI  - On tests\nJO  - Tests\nPY  - 2020/05\nKW  - alpha; beta\nKW  - gamma.\nER  - \nTY  - JOUR\nTI  - Other\nER  - \n"
BIB = '@article{k1,\n author = {Doe, Jane and Roe, Max},\n title = {A {Nested} title},\n journal = "Tests",\n year = {2018},\n keywords = {one, two; three}\n}\n@book{k2, title = {Second}, booktitle = {Proc}, year = 2021}\n'
RW = "RT Journal\nSR 1\nA1 甲;乙\nT1 标题一\nJF 期刊\nYR 2023\nK1 养老;健康；智慧\nAB 摘要\n  续行\n\nRT Journal\nT1 标题二\nYR 2022\nER\n"
EN = "%0 Journal Article\n%A 甲\n%A 乙\n%T 标题\n%J 期刊\n%D 2020\n%K 养老;健康\n%X 摘要\n\n%0 Journal Article\n%T 第二\n"
SCOPUS = 'Authors,Author full names,Title,Year,Source title,Cited by,DOI,Author Keywords,Index Keywords,EID\n"Doe J.; Roe M.","Doe, J","Tests, tests",2017,Tests,"1,002",10.1/y,"a; b","C; D",e1\n'
TABLE = "题名\t关键词\t年份\nfirst, second\t甲；乙\t2020\n"
WORKS = json.dumps({"results": [{"title": "W", "publication_year": 2022, "cited_by_count": 3, "doi": "https://doi.org/10.1/z", "authorships": [{"author": {"display_name": "Doe"}}], "keywords": [{"display_name": "Context (archaeology"}], "abstract_inverted_index": {"world": [1, 3], "hello": [0], "big": [2]}}]})
XML = "<S><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>2016 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>T <i>x</i></ArticleTitle><Abstract><AbstractText>A</AbstractText><AbstractText>B</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><ForeName>J</ForeName></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList></Article><KeywordList><Keyword>own</Keyword></KeywordList><MeshHeadingList><MeshHeading><DescriptorName>Mesh</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='doi'>10.1/q</ArticleId></ArticleIdList></PubmedData></PubmedArticle></S>"


def one(text, name=""):
    found, records = formats.parse(text.encode(), name)
    return found, records


def test_wos():
    found, (a, b) = one(WOS)
    assert found == "wos" and a["title"] == "A long title that goes on" and a["keywords"] == ["fall detection", "Smart Home"]
    assert a["keywords_plus"] == ["TERM ONE", "TERM TWO"] and a["citations"] == 1234 and a["pub_year"] == "2021" and len(a["cited_refs"]) == 2 and b["citations"] is None
    strict = formats.read_wos(WOS, strict=True)
    assert strict[0]["title"] == "A long title" and strict[0]["doi"] == "10.1/x"


def test_ris():
    found, (a, b) = one(RIS)
    assert found == "ris" and a["authors"] == ["Doe, Jane", "Roe, Max"] and a["keywords"] == ["alpha; beta", "gamma"] and a["pub_year"] == "2020" and b["title"] == "Other"


def test_bibtex():
    found, (a, b) = one(BIB)
    assert found == "bibtex" and a["authors"] == ["Doe, Jane", "Roe, Max"] and a["keywords"] == ["one", "two", "three"] and a["source"] == "Tests" and a["title"] == "A Nested title"
    assert b["pub_year"] == "" and b["source"] == "Proc"


def test_refworks_and_endnote():
    found, (a, b) = one(RW)
    assert found == "refworks" and a["keywords"] == ["养老", "健康", "智慧"] and a["authors"] == ["甲", "乙"] and a["abstract"] == "摘要 续行" and b["pub_year"] == "2022"
    found, (a, b) = one(EN)
    assert found == "endnote" and a["authors"] == ["甲", "乙"] and a["keywords"] == ["养老", "健康"] and a["doi"] == "" and b["title"] == "第二"


def test_tables():
    found, (a,) = one(SCOPUS, "x.csv")
    assert found == "scopus" and a["citations"] == 1002 and a["keywords"] == ["a", "b"] and a["keywords_plus"] == ["C", "D"] and a["title"] == "Tests, tests"
    found, (a,) = one(TABLE, "x.tsv")
    assert found == "table" and a["title"] == "first, second" and a["keywords"] == ["甲", "乙"] and a["citations"] is None
    assert one("nothing of the kind")[1] == [] and one("")[1] == []


def test_services():
    (w,) = formats.works_from_json(WORKS)
    assert w["abstract"] == "hello world big world" and w["doi"] == "10.1/z" and w["keywords"] == ["Context"] and w["citations"] == 3
    (x,) = formats.articles_from_xml(XML)
    assert x["pub_year"] == "2016" and x["keywords"] == ["own", "Mesh"] and x["authors"] == ["Doe J", "Group"] and x["doi"] == "10.1/q" and x["title"] == "T x"
    assert formats.articles_from_xml(XML, "mesh")[0]["keywords"] == ["Mesh"] and formats.articles_from_xml("<broken") == []


@pytest.mark.parametrize("text,encoding", [("中文 text", "gb18030"), ("é", "utf-8"), ("ü", "utf-16")])
def test_decode(text, encoding):
    assert formats.decode(text.encode(encoding)) == text
    assert formats.decode("﻿x".encode()) == "x"


def test_data_source(spark, tmp_path):
    for name, text in (("a.txt", WOS), ("b.ris", RIS), ("c.bib", BIB), ("d.txt", RW)):
        (tmp_path / name).write_text(text)
    records = readers.read_bib(spark, str(tmp_path))
    assert records.count() == 8 and records.select("doc_id").distinct().count() == 8
    assert {(r["src_file"], r["src_format"]): r["records"] for r in readers.notes(records).collect()} == {("a.txt", "wos"): 2, ("b.ris", "ris"): 2, ("c.bib", "bibtex"): 2, ("d.txt", "refworks"): 2}
    (tmp_path / "w.json").write_text(WORKS)
    assert readers.read_bib(spark, str(tmp_path / "w.json"), "works_json").first()["citations"] == 3


def test_files_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "a b", 5, 3.0, 2001.5, 0.0, 2), (2, "c", 2, 3.0, 0.0, 1.25, 0)], "id long, label string, occurrences long, total_link_strength double, avg_year double, avg_citations double, cluster int")
    sinks.write_lines(sinks.map_rows(nodes, cluster=True), str(tmp_path / "map.txt"), ["id"], sinks.map_header(cluster=True))
    back = {r["id"]: r for r in readers.read_map(spark, str(tmp_path / "map.txt")).collect()}
    assert back[1]["label"] == "a b" and back[1]["avg_year"] == 2001.5 and back[2]["cluster"] == 1 and back[2]["avg_citations"] == 1.25 and back[1]["total_link_strength"] == 3.0
    edges = spark.createDataFrame([(1, 2, 2.0), (1, 3, 0.25), (2, 3, 0.0)], "src long, dst long, weight double")
    sinks.write_lines(sinks.network_rows(edges), str(tmp_path / "net.txt"), ["src", "dst"])
    assert sorted(tuple(r) for r in readers.read_network(spark, str(tmp_path / "net.txt")).collect()) == [(1, 2, 2.0), (1, 3, 0.25)]
    (tmp_path / "n2.txt").write_text("2\t1\n1\t2\t3\nx\t1\n1\n")
    assert [tuple(r) for r in readers.read_network(spark, str(tmp_path / "n2.txt")).collect()] == [(1, 2, 4.0)]
    (tmp_path / "m2.txt").write_text("id\tlabel\tcluster\tweight<Occurrences>\n7\tx\tq\t3\nbad\ty\t2\tz\n\t\t1\t1\n")
    assert [(r["id"], r["label"], r["cluster"], r["occurrences"]) for r in readers.read_map(spark, str(tmp_path / "m2.txt")).orderBy("id").collect()] == [(7, "x", 1, 3), (8, "y", 2, 0)]
    (tmp_path / "thesaurus_t.txt").write_text("﻿label\treplace by\na\tb\nc\t\nshort\n\tq\n", encoding="utf-8")
    found = readers.read_thesaurus(spark, readers.resolve_preset("t", str(tmp_path))).collect()
    assert [(r["label"], r["replace_by"]) for r in found] == [("a", "b"), ("c", "")]


def test_colors_and_dense(spark):
    rows = sinks.cluster_colors(spark.createDataFrame([(1,), (13,)], "cluster int")).collect()
    assert len({(r["red"], r["green"], r["blue"]) for r in rows}) == 1
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    lines = {r["id"]: r["line"] for r in sinks.dense_rows(nodes, spark.createDataFrame([(1, 2, 1.5)], "src long, dst long, weight double")).collect()}
    assert lines == {1: "1\t0\t1.5000", 2: "2\t1.5000\t0"}
    with pytest.raises(ValueError):
        sinks.dense_rows(nodes, spark.createDataFrame([], "src long, dst long, weight double"), most=1)


def test_pipeline(spark, tmp_path):
    groups = [["fall detection", "sensor", "camera", "Wearable"], ["policy", "nursing", "loneliness", "community"]]
    rows = [(i, f"title {i}", str(2000 + i % 20), [groups[i % 2][k] for k in range(4) if (i // 2) % 5 != k] + (["wearables"] if i % 10 == 0 else []), [], "", i) for i in range(60)]
    records = spark.createDataFrame(rows, "doc_id long, title string, pub_year string, keywords array<string>, keywords_plus array<string>, abstract string, citations long")
    a = pipeline.analyze(records, pipeline.Options(min_occurrences=3, exclude_terms=["policy"]))
    labels = {r["label"] for r in a.net.nodes.collect()}
    assert "policy" not in labels and "wearables" not in labels and "Wearable" in labels
    assert a.assignment.select("cluster").distinct().count() == 2
    pipeline.write(a, str(tmp_path / "out"))
    data = json.loads((tmp_path / "out" / "report.json").read_text())
    assert data["summary"]["n_docs"] == 60 and data["gaps"]
    assert "Synonyms" in (tmp_path / "out" / "review.md").read_text()
    with pytest.raises(pipeline.NothingLeft):
        pipeline.analyze(records, pipeline.Options(filter_terms=["no such text"]))
    with pytest.raises(pipeline.TooFewNodes):
        pipeline.analyze(records, pipeline.Options(min_occurrences=1000))


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"])], "doc_id long, terms array<string>")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    increment.count_stream(stream, str(tmp_path / "counts"), str(tmp_path / "check")).awaitTermination(60)
    got = {r["term"]: r["df"] for r in increment.totals(spark, str(tmp_path / "counts")).collect()}
    assert got == {r["term"]: r["df"] for r in network.document_frequency(docs.select("doc_id", F.col("terms"))).collect()} == {"a": 2, "b": 1}


def test_texts_in_columns(spark):
    from termweave.functions.text import text_from_positions

    df = spark.createDataFrame([("f1", RIS), ("f2", None), ("f3", "")], "f string, text string")
    rows = readers.parse_texts(df, "f", "text", "ris").orderBy("ordinal").collect()
    assert [(r["f"], r["ordinal"], r["title"]) for r in rows] == [("f1", 0, "On tests"), ("f1", 1, "Other")] and rows[0]["raw"]["KW"] == ["alpha; beta", "gamma."]
    index = spark.createDataFrame([({"b": [1], "a": [0, 2]},), ({},), (None,)], "m map<string,array<int>>")
    assert [r[0] for r in index.select(text_from_positions(F.col("m"))).collect()] == ["a b a", "", None]


def test_works_table_round_trip(spark, tmp_path):
    rows = [("A, \"b\" c", "2001", "S", "10.1/x", ["Doe, J", "Roe, K"], ["alpha", "beta"], ["plus"], "abs", 3), ("T2", "", "", "", [], [], [], "", None)]
    records = spark.createDataFrame(rows, "title string, pub_year string, source string, doi string, authors array<string>, keywords array<string>, keywords_plus array<string>, abstract string, citations long")
    sinks.write_works(records.coalesce(1), str(tmp_path / "works"))
    back = {r["title"]: r for r in readers.read_bib(spark, str(tmp_path / "works"), "scopus").collect()}
    first = back['A, "b" c']
    assert (first["pub_year"], first["doi"], first["authors"], first["keywords"], first["keywords_plus"], first["citations"]) == ("2001", "10.1/x", ["Doe, J", "Roe, K"], ["alpha", "beta"], ["plus"], 3)
    assert back["T2"]["authors"] == [] and back["T2"]["citations"] is None


def test_colour_files(spark):
    lines = [r["line"] for r in sinks.color_rows(spark.createDataFrame([(2,), (1,)], "cluster int")).orderBy("cluster").collect()]
    assert [x.split("\t")[0] for x in lines] == ["1", "2"] and all(len(x.split("\t")) == 4 for x in lines)
    assert [r["line"] for r in sinks.overlay_rows(spark, [(0, (1, 2, 3)), (1.0, (4, 5, 6))]).orderBy("value").collect()] == ["0.0\t1\t2\t3", "1.0\t4\t5\t6"]


def test_views_reload_and_no_betweenness(spark, tmp_path):
    groups = [["fall detection", "sensor", "camera", "wearable"], ["policy", "nursing", "loneliness", "community"]]
    rows = [(i, f"title {i}", str(2000 + i % 20), [groups[i % 2][k] for k in range(4) if (i // 2) % 5 != k], [], "", i) for i in range(40)]
    records = spark.createDataFrame(rows, "doc_id long, title string, pub_year string, keywords array<string>, keywords_plus array<string>, abstract string, citations long")
    a = pipeline.analyze(records, pipeline.Options(min_occurrences=3, betweenness=False))
    assert a.centrality is None
    assert pipeline.register_views(a, "kw_") == ["kw_corpus", "kw_terms", "kw_nodes", "kw_edges", "kw_clusters", "kw_rules"]
    assert spark.sql("SELECT count(*) AS n FROM kw_nodes JOIN kw_clusters USING (id)").first()["n"] == 8
    out = tmp_path / "out"
    pipeline.write(a, str(out))
    again = pipeline.reload(spark, str(out))
    assert again.net.n_docs == 40 and not again.layout and again.merge["kept"] > 0
    assert again.net.edges.count() == a.net.edges.count() and again.assignment.select("cluster").distinct().count() == 2
    nodes = a.net.nodes.withColumn("x", F.lit(0.5)).withColumn("y", F.lit(-0.25)).withColumn("cluster", F.lit(7))
    sinks.write_lines(sinks.map_rows(nodes, layout=True, cluster=True), str(tmp_path / "final.txt"), ["id"], sinks.map_header(layout=True, cluster=True))
    laid = pipeline.reload(spark, str(out), (str(tmp_path / "final.txt"), ""))
    assert laid.layout and {(r["x"], r["y"], r["cluster"]) for r in laid.net.nodes.collect()} == {(0.5, -0.25, 7)}
    sinks.write_lines(sinks.map_rows(nodes.limit(3), layout=True, cluster=True), str(tmp_path / "old.txt"), ["id"], sinks.map_header(layout=True, cluster=True))
    assert not pipeline.reload(spark, str(out), (str(tmp_path / "old.txt"), "")).layout
