"""Readers on small files, with expected values written out."""

import pytest
from pyspark.sql import functions as F

from specforge.sources import folder, readers
from specforge.sources.pages import page


def rows(df):
    return [r.asDict() for r in df.orderBy("source_ref").collect()]


def docs(spark, *contents):
    return spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "source_ref string, content string")


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Product Name,Description,Category,Voltage,Part No\nMotor A,"two\nlines",Motors,415 V,X-1\n,orphan row,,,\nPump B,,,,\n')
    records, rejects = readers.read_csv(spark, str(tmp_path / "a.csv"))
    got = rows(records)
    assert [(r["source_ref"], r["name"], r["description"], r["category"], r["sku"], r["attributes"]) for r in got] == [("a.csv#row2", "Motor A", "two lines", "Motors", "X-1", {"Voltage": "415 V"}), ("a.csv#row4", "Pump B", "", "", "", {})]
    assert [r["source_ref"] for r in rows(rejects)] == ["a.csv#row3"]


def test_csv_delimiters_and_a_missing_name(spark, tmp_path):
    (tmp_path / "s.csv").write_text("name;description\nA;b\n")
    (tmp_path / "t.tsv").write_text("name\tdescription\nA\tb\n")
    (tmp_path / "n.csv").write_text("colour,size\nred,1\n")
    assert rows(readers.read_csv(spark, str(tmp_path / "s.csv"))[0])[0]["description"] == "b"
    assert rows(readers.read_csv(spark, str(tmp_path / "t.tsv"), "\t")[0])[0]["description"] == "b"
    assert rows(readers.read_csv(spark, str(tmp_path / "t.tsv"))[0])[0]["description"] == "b"
    with pytest.raises(ValueError, match="no product name"):
        readers.read_csv(spark, str(tmp_path / "n.csv"))


def test_json(spark):
    records, rejects = readers.from_json(docs(spark, '[{"name": "A", "specs": {"voltage": "24 V"}, "tags": ["x", 2, {"y": 1}]}, 7]', '{"items": [{"title": "B"}]}', '{"name": "C", "n": null}', '{"name": "D"}\nnot json\n{"colour": "red"}'))
    got = rows(records)
    assert [(r["source_ref"], r["name"], r["attributes"]) for r in got] == [("f0#1", "A", {"specs_voltage": "24 V", "tags": "x, 2"}), ("f1#1", "B", {}), ("f2#1", "C", {}), ("f3#1", "D", {})]
    assert sorted((r["source_ref"], r["reason"]) for r in rejects.collect()) == [("f0#2", "no JSON object"), ("f3#2", "no JSON object"), ("f3#3", "no name")]


def test_html(spark):
    html = "<html><title>Pump CP-200 | Acme</title><script>var x = '<h1>no</h1>'</script><p>short</p><p>This paragraph is certainly longer than forty characters.</p><table><tr><td>Voltage:</td><td>415 V</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table><dl><dt>Weight</dt><dd>28 kg</dd></dl></html>"
    records, rejects = readers.from_html(docs(spark, html, "<p>nothing</p>", None))
    (r,) = rows(records)
    assert (r["name"], r["description"], r["attributes"]) == ("Pump CP-200", "This paragraph is certainly longer than forty characters.", {"Voltage": "415 V", "Weight": "28 kg"})
    assert [x["source_ref"] for x in rows(rejects)] == ["f1", "f2"]


def test_pages_keep_text_around_inner_tags():
    got = page("<title>x</title><h1>Pump <b>CP-200</b> | Acme</h1><p>one<p>A second paragraph, <i>with</i> inner tags, of some length.<table><tr><th>Voltage <i>rated</i><td>415 V<tr><td>a<td>b<td>c<tr><td><p>Bore</p></td><td>50&nbsp;mm</td></tr></table><dl><dt>Weight<dd>28 kg<dt>lone<dt>IP<dd>55</dl>")
    assert got == {"name": "Pump CP-200", "description": "A second paragraph, with inner tags, of some length.", "attributes": {"Voltage rated": "415 V", "Bore": "50 mm", "Weight": "28 kg", "IP": "55"}}
    nested = page("<h1>A</h1><table><tr><td>outer</td><td><table><tr><td>k</td><td>v</td></tr></table></td></tr></table>")
    assert nested["attributes"]["k"] == "v"
    assert page("<p>none</p>") is None and page(None) is None and page("<h1></h1><title>T - Shop</title>")["name"] == "T"


def test_json_in_the_jvm(spark):
    text = '{"name": "A", "z": {"b": {"c": 1.50, "d": true}, "a": "x"}, "w": 415.0, "e": 1e3, "list": [1, 2.0, true, null, [3], {"y": 4}], "s": "{\\"no\\": 1}", "n": null, "z_a": "last"}'
    records, rejects = readers.from_json(docs(spark, text, "[[1], {\"name\": \"B\", \"t\": {}}]"))
    assert "Python" not in records._jdf.queryExecution().toString() and "Pandas" not in records._jdf.queryExecution().toString()
    got = {r["name"]: r["attributes"] for r in records.collect()}
    assert got == {"A": {"z_b_c": "1.5", "z_b_d": "True", "w": "415.0", "e": "1000.0", "list": "1, 2.0, True, None", "s": '{"no": 1}', "z_a": "last"}, "B": {}}
    assert [r["source_ref"] for r in rejects.collect()] == ["f1#1"]


def test_files_of_a_folder_keep_their_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,price\nMotor,3\n,9\n")
    (tmp_path / "b.csv").write_text("price;name\n4;Pump\n")
    (tmp_path / "c.tsv").write_text("full, long name\tprice\nMotor, 3\t5\n")
    (tmp_path / "d.csv").write_text("colour,size\nred,1\n")
    records, rejects = readers.read_csv(spark, str(tmp_path))
    assert sorted((r["source_ref"], r["name"], r["attributes"]) for r in records.collect()) == [("a.csv#row2", "Motor", {"price": "3"}), ("b.csv#row2", "Pump", {"price": "4"}), ("c.tsv#row2", "Motor, 3", {"price": "5"})]
    assert sorted(r["source_ref"] for r in rejects.collect()) == ["a.csv#row3", "d.csv"]
    whole, _ = readers.read_catalogue(spark, str(tmp_path))
    assert ("c.tsv#row2", "Motor, 3") in {(r["source_ref"], r["name"]) for r in whole.collect()}


def test_content_types_decide_where_names_do_not(spark):
    files = spark.createDataFrame([("x", b"name\tprice\nA, b\t1\n", "text/tab-separated-values"), ("y", b"[1,2", "text/plain; charset=utf-8"), ("z", b'{"name": "J"}', "application/json"), ("n", b"name,p\nC,1\n", None)], "source_ref string, content binary, content_type string")
    assert sorted((r["source_ref"], r["name"]) for r in readers.ingest(files)[0].collect()) == [("n#row2", "C"), ("x#row2", "A, b"), ("y#block1", "[1,2"), ("z#1", "J")]


@pytest.fixture
def mixed(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("name,description,price\nMotor,\"two\nlines\",3\n,orphan,\n")
    (tmp_path / "in/b.csv").write_text("price|Product Name\n" + "".join(f"{i}|Pump {i}\n" for i in range(400)))
    (tmp_path / "in/c.tsv").write_text("title\tprice\nMotor, 3\t5\n")
    (tmp_path / "in/d.csv").write_text("colour,size\nred,1\n")
    (tmp_path / "in/e.jsonl").write_text('{"name": "J", "specs": {"v": 1}}\nbad\n\n[1]\n{"colour": 2}\n')
    (tmp_path / "in/f.csv").write_bytes("name;note\nL\u00fcfter;gro\u00df\n".encode("latin-1"))
    return tmp_path / "in"


def test_the_folder_source_equals_the_files_read_one_by_one(spark, mixed):
    whole = folder.read_folder(spark, str(mixed))
    keys = ["source_ref", "name", "description", "attributes"]
    got = sorted((tuple(r) for r in whole.filter("level = 'record'").select(*keys).collect()), key=str)
    one = [tuple(r) for f in sorted(mixed.iterdir()) for r in folder.read_folder(spark, str(f)).filter("level = 'record'").select(*keys).collect()]
    assert got == sorted(one, key=str) and len(got) == 404
    csvs = [tuple(r) for f in ("a.csv", "b.csv", "c.tsv") for r in readers.read_csv(spark, str(mixed / f))[0].select(*keys).collect()]
    assert set(map(str, csvs)) <= set(map(str, got))
    assert {r["file"]: (r["records"], r["skipped"], r["errors"], r["warnings"]) for r in folder.report(whole).collect()} == {
        "a.csv": (1, 1, 0, []), "b.csv": (400, 0, 0, ["no description column"]), "c.tsv": (1, 0, 0, ["no description column"]), "d.csv": (0, 0, 1, ["no product name among the columns ['colour', 'size']"]),
        "e.jsonl": (1, 2, 0, ["no valid JSON"]), "f.csv": (1, 0, 0, ["no description column"]),
    }


@pytest.mark.parametrize("size", [113, 517, 3000])
def test_byte_ranges_give_every_row_once(spark, mixed, size):
    rows = folder.read_folder(spark, str(mixed / "b.csv"), rangeBytes=size)
    assert rows.rdd.getNumPartitions() > 1
    assert sorted(r["name"] for r in rows.filter("level = 'record'").collect()) == sorted(f"Pump {i}" for i in range(400))
    lines = folder.read_folder(spark, str(mixed / "e.jsonl"), rangeBytes=size)
    assert sorted(r["level"] for r in lines.collect()) == ["record", "skipped", "skipped", "warning"]


def test_the_folder_source_streams_new_files(spark, mixed, tmp_path):
    def drain():
        rows = folder.read_folder_stream(spark, str(mixed)).filter("level = 'record'").select("source_ref", "name")
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted(r["source_ref"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = drain()
    assert len(first) == 404 and drain() == first
    (mixed / "g.csv").write_text("name\nNew\n")
    assert drain() == sorted([*first, "g.csv#row2"])


def test_text(spark):
    text = "preface\nCENTRIFUGAL PUMP\nFlow rate: 40 m3/h\nflow rate: 50 m3/h\nrobust\n2. Ball Valves\nBore:\t50 mm\n"
    records, rejects = readers.from_text(docs(spark, text, "just one line\nand another", "  "))
    got = rows(records)
    assert [(r["source_ref"], r["name"], r["attributes"]) for r in got] == [("f0#block1", "CENTRIFUGAL PUMP", {"Flow rate": "40 m3/h"}), ("f0#block2", "2. Ball Valves", {"Bore": "50 mm"}), ("f1#block1", "just one line", {})]
    assert got[0]["description"].endswith("robust") and [x["source_ref"] for x in rows(rejects)] == ["f2"]


def test_form(spark):
    forms = spark.createDataFrame([("1", " Motor ", None, "", "Brand: ABB\n# a comment\nframe = 100L\nBrand: Siemens\nprose\nurl: http://x\n"), ("2", " ", "", "", "")], "source_ref string, name string, description string, category string, attributes string")
    records, rejects = readers.from_form(forms)
    (r,) = rows(records)
    assert r["name"] == "Motor" and r["attributes"] == {"Brand": "Siemens", "frame": "100L", "url": "http://x"} and rejects.count() == 1


def test_dispatch(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,Power\nMotor,3 kW\n")
    (tmp_path / "b.jsonl").write_text('{"name": "Pump"}\n')
    (tmp_path / "c.html").write_text("<h1>Valve</h1>")
    (tmp_path / "d.txt").write_bytes("VENTILATOR\nName: Lüfter".encode("latin-1"))
    (tmp_path / "e.dat").write_text('[{"name": "Sniffed"}]')
    records, _ = readers.read_catalogue(spark, str(tmp_path))
    assert sorted(r["name"] for r in records.collect()) == ["Motor", "Pump", "Sniffed", "VENTILATOR", "Valve"]
    assert records.filter("name = 'VENTILATOR'").first()["attributes"] == {"Name": "Lüfter"}


def test_columns_are_mapped_by_best_candidate():
    assert readers.map_columns(["item", "Product Name", "long_description", "specs_voltage", "bar_code"]) == {"name": "Product Name", "description": "long_description", "category": None, "sku": "bar_code"}


def test_empty_input(spark):
    none = docs(spark).limit(0) if False else spark.createDataFrame([], "source_ref string, content string")
    for read in (readers.from_json, readers.from_html, readers.from_text, readers.csv_contents):
        assert [df.count() for df in read(none)] == [0, 0]
    assert readers.ingest(none.withColumn("content", F.col("content").cast("binary")))[0].count() == 0
