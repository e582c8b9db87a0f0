"""Refusals that no projection, filter or count gets around; layouts, catalog and joins by order."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tablewright.functions import scalar, variant
from tablewright.operators import compare, profile, ranges
from tablewright.plans import dataset
from tablewright.plans.dataset import Dataset, Recipe, found_profile, listed, profile_document, profile_paths, publish_profile, recipe_faults, selected
from tablewright.sources import archives, readers, sinks, text
from tablewright.sources.xlsx import xlsx

from .test_engine import _workbook, put  # noqa: F401  (a fixture)


def asks(df, column, value):
    """What a user may ask of a table without looking at its bad part."""
    return [lambda: df.select(column).collect(), df.count, lambda: df.where(F.col(column) == value).collect(), lambda: df.where(F.col(column) == value).count(), lambda: df.select(F.lit(1)).collect(), lambda: df.groupBy(column).count().collect()]


BAD = {
    "csv short": lambda s, w: (readers.csv(s, w("a,b,c\n1,2,3\n4,5\n7,8,9\n", "a.csv"), "a int, b int, c int"), "b", 8),
    "csv long": lambda s, w: (readers.csv(s, w("a,b,c\n1,2,3\n4,5,6,6\n7,8,9\n", "b.csv"), "a int, b int, c int"), "b", 8),
    "csv value": lambda s, w: (readers.csv(s, w("a,b\n1,x\nno,y\n", "c.csv"), "a int, b string"), "b", "x"),
    "csv inferred": lambda s, w: (readers.csv(s, w("a,b,c\n1,x,3\n4,y\n", "d.csv")), "b", "x"),
    "csv quoted": lambda s, w: (readers.csv(s, w('a,b,c\n1,"x\nx",3\n4,y\n', "e.csv")), "b", "y"),
    "json": lambda s, w: (readers.jsonl(s, w('{"a": 1, "b": "x"}\n{"a": 1, "b": \n', "a.json"), "a int, b string"), "b", "x"),
    "json value": lambda s, w: (readers.jsonl(s, w('{"a": 1, "b": "x"}\n{"a": "no", "b": "y"}\n', "b.json"), "a int, b string"), "b", "x"),
    "pipes value": lambda s, w: (text.piped_parts(s, [(w("1|x|2\nbad|y|3\n", "p_1.csv"), "create table t (a integer, b varchar, c integer)")]), "b", "x"),
    "pipes short": lambda s, w: (text.piped_parts(s, [(w("1|x|2\n2|y\n", "p_2.csv"), "create table t (a integer, b varchar, c integer)")]), "b", "x"),
    "xml": lambda s, w: (text.xml_rows(s, w('<rows>\n<row Id="1" N="a" />\n<row Id="x" N="b" />\n</rows>\n', "a.xml"), "Id int, N string"), "N", "a"),
    "games": lambda s, w: (text.tagged_games(s, w('[Event "x"]\n\n1. e4 1-0\n\n[Event y\n\n1. d4 0-1\n', "a.pgn")), "moves", "1. e4 1-0"),
    "tabs": lambda s, w: (text.tabs_then_json(s, w('t\tk\t1\t2020-01-01\t{}\nt\tk\tx\t2020-01-01\t{}\n', "a.tsv")), "key", "k"),
    "tabs json": lambda s, w: (text.tabs_then_json(s, w('t\tk\t1\t2020-01-01\t{}\nt\tk\t1\t2020-01-01\t{\n', "b.tsv")), "key", "k"),
    "vectors": lambda s, w: (text.word_vectors(s, w("a 1 2\nb 1 x\n", "a.vec"), 2), "token", "a"),
    "vectors short": lambda s, w: (text.word_vectors(s, w("a 1 2\n1 2\n", "b.vec"), 2), "token", "a"),
    "days": lambda s, w: (text.daily_fixed_width(s, w("USW00000001202102TMAX" + "".join(f"{v:5d}   " for v in [1] + [-9999] * 28 + [1, -9999]) + "\n", "a.dly")), "station", "USW00000001"),
    "preamble": lambda s, w: (text.after_preamble(s, w("head\n1 2\n3 x\n", "a.txt"), ["a", "b"]), "a", 1.0),
    "readings": lambda s, w: (text.readings(s, w("d\t9:09\t58\t100\nd\t9:10\t256\t1\n", "data-01")), "date", "d"),
    "readings short": lambda s, w: (text.readings(s, w("d\t9:09\t58\t100\nd\t9:10\t1\n", "data-02")), "date", "d"),
    "documents": lambda s, w: (text.json_documents(s, w("{", "doc.json")), "code", "doc"),
}


@pytest.mark.parametrize("name", BAD)
def test_refused_whatever_is_asked(spark, put, name):
    for i in range(6):  # some refuse when they are built, as they look at the values to find the types
        with pytest.raises(Exception, match="(?i)ragged|cast|malformed|tags|fewer|number|invalid|fields|code|february|json"):
            asks(*BAD[name](spark, put))[i]()


def test_good_records_are_kept(spark, put):
    good = readers.csv(spark, put('a,b\n1,"x\ny"\n\n2,z\n', "g.csv"))
    assert good.count() == 2 and good.select("b").count() == 2 and good.where("a = 2").first().b == "z"
    many = readers.csv(spark, put("a,b\n" + "".join(f"{i},x{i}\n" for i in range(1000)), "m.csv"), "a int, b string")
    assert many.where("b = 'x7'").first().a == 7 and many.count() == 1000
    assert text.readings(spark, put("\t138\t33\t3A\n10-12-1989\t7:00\t0\t\n10-12-1989\t7:00\t0\t1.50\n", "data-27")).orderBy("raw_value").selectExpr("patient_id", "code", "value").collect() == [(27, 0, None), (27, 0, 1.5), (27, 33, None)]


def lzw(data: bytes, widest: int = 16) -> bytes:
    """A plain encoder of the .Z format, without clear codes."""
    out, acc, filled, width, group = bytearray(b"\x1f\x9d" + bytes([128 | widest])), 0, 0, 9, 0
    table = {bytes([i]): i for i in range(256)}
    size, word = 257, b""

    def emit(code):
        nonlocal acc, filled, group
        acc |= code << filled
        filled += width
        group += 1
        while filled >= 8:
            out.append(acc & 255)
            acc >>= 8
            filled -= 8

    for b in data:
        if (more := word + bytes([b])) in table:
            word = more
            continue
        emit(table[word])
        grown = size > (1 << width) - 1 and width < widest
        if grown:
            while group % 8:
                emit(0)
            width, group = width + 1, 0
        if size < 1 << widest:
            table[more] = size
            size += 1
        word = bytes([b])
    if word:
        emit(table[word])
    if filled:
        out.append(acc & 255)
    return bytes(out)


def test_archive_within_an_archive(spark, tmp_path):
    import random

    rnd = random.Random(2)
    noise = "".join(rnd.choice("abcdefgh \n") for _ in range(60_000)).encode()
    for data in (b"", b"a", b"aaaaaaa", noise, noise * 3):
        if data:
            assert archives.uncompressed(lzw(data)) == data
    with pytest.raises(readers.BadRecord, match="not a .Z"):
        archives.uncompressed(b"xx")
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        for n, content in (("in/data-01", b"d\t9:09\t58\t100\n" * 900), ("in/data-02", b"e\t9:10\t33\t0Hi\n"), ("in/README", b"no reading\n")):
            info = tarfile.TarInfo(n)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("diabetes-data.tar.Z", lzw(tar.getvalue()))
        z.writestr("Index", "x")
    got = text.readings_archive(spark, str(tmp_path / "d.zip"))
    assert got.groupBy("patient_id").count().orderBy("patient_id").collect() == [(1, 900), (2, 1)]


def test_workbook_kinds(spark, tmp_path):
    p = str(tmp_path / "w.xlsx")
    _workbook(p, {"one": [["a", "b"], [1, "x"]], "two": [["b", "c"], ["y", 2.5]]})
    got = xlsx(spark, p, same_header=False)
    assert got.columns == ["a", "b", "c", "sheet_name"] and sorted(map(tuple, got.collect()), key=str) == [(1, "x", None, "one"), (None, "y", 2.5, "two")]
    _workbook(p, {"one": [["a"], [True], [1]]})
    with pytest.raises(readers.BadRecord, match="mixes kinds"):
        xlsx(spark, p)
    _workbook(p, {"one": [["a"], [2**53 + 1], [0.5]]})
    with pytest.raises(readers.BadRecord, match="no double"):
        xlsx(spark, p)


def test_pinned_files(spark, tmp_path):
    p = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(p)
    d = Dataset(spark, "t", lambda: spark.read.parquet(p), pinned=True)
    assert d.frame().count() == 5 and d.frame(["id"]).count() == 5
    spark.range(6).write.mode("overwrite").parquet(p)
    with pytest.raises(readers.BadRecord, match="changed"):
        d.frame()


def test_head(spark):
    d = Dataset(spark, "r", lambda: spark.range(0, 1000, 1, 7))
    assert [r.id for r in d.head(5).collect()] == [0, 1, 2, 3, 4]


def test_profile_document(spark, tmp_path):
    df = spark.createDataFrame([("https://u:p@h/x", 1.0, True), ("/home/me/f", float("inf"), None)], "link string, x double, ok boolean")
    doc = profile_document(df, "links")
    raw = json.dumps(doc, allow_nan=False)
    assert "u:p" not in raw and "/home/me" not in raw and doc["rows"] == 2
    assert {c["column"]: c.get("null_count") for c in doc["columns"]} == {"link": 0, "x": 0, "ok": 1}
    df.write.parquet(str(tmp_path / "links.parquet"))
    d = Dataset(spark, "links", lambda: spark.read.parquet(str(tmp_path / "links.parquet")))
    assert found_profile(spark, "links", str(tmp_path / "built"), str(tmp_path / "seen")) is None
    path = publish_profile(d, str(tmp_path / "built"))
    assert json.load(open(path))["slug"] == "links" and found_profile(spark, "links", str(tmp_path / "built")) == path
    assert profile_paths("a", "x", "y", "z", "y") == ["x/a/profile.json", "y/a.json", "z/a.json"]


def test_selection():
    made = [Recipe("a", ()), Recipe("b", (), hydrated=True), Recipe("c", (), parent="a")]
    names = lambda *a, **k: [r.slug for r in selected(made, *a, **k)]
    assert names(["c", "a", "c"]) == ["c", "a"] and names(everything=True) == ["a", "c"] and names(everything=True, hydrated=True) == ["a", "b", "c"]
    assert names(everything=True, derived="reject") == ["a", "b"] and names(["b"]) == ["b"]
    for bad in ({}, {"slugs": ["a"], "everything": True}):
        with pytest.raises(ValueError, match="not both"):
            selected(made, **bad)
    with pytest.raises(ValueError, match="derived from other tables: c"):
        names(["c"], derived="reject")
    with pytest.raises(KeyError, match="unknown aa .did you mean a..; unknown zz"):
        names(["aa", "zz"])


def test_fetchers(spark, put, monkeypatch):
    monkeypatch.setitem(dataset.FETCHERS, "here", lambda recipe: [put("a,b\n1,x\n", f"{recipe.slug}.csv")])
    assert Recipe("r", (), "csv", fetcher="here").frame(spark).collect() == [(1, "x")]
    with pytest.raises(KeyError, match="no fetcher other"):
        Recipe("r", (), "csv", fetcher="other").frame(spark)
    faults = recipe_faults([Recipe("r", (), handler="readings", fetcher="other")], unused=True)
    assert ("r", "unknown fetcher other") in faults and ("here", "unused") in faults and ("readings", "unused") not in faults


def test_listing(spark, sf_dir):
    got = {r.slug: r for r in listed(dataset.open_folder(spark, sf_dir, ["nation", "region"])).collect()}
    assert list(got) == ["nation", "region"] and got["region"].files == 1 and got["region"].bytes > 0 and [c.name for c in got["region"].columns] == ["r_regionkey", "r_name"]


REDACTED = [
    ("https://bob:pw@h/x", "https://<redacted-credential>@h/x"), ("https://bob@h/x", "https://<redacted-credential>@h/x"), ("https://u:p/w@h", "https://<redacted-credential>@h"), ("https://h:443/@user/post", "https://h:443/@user/post"),
    ("https://h:443/p?email=a@b.com", "https://h:443/p?email=a@b.com"), ("https://u:p@h:443/x", "https://<redacted-credential>@h:443/x"), ("https://h/x?client_secret=a&b=1", "https://h/x?client_secret=<redacted-credential>&b=1"),
    ("https://h/?X-Amz-Signature=q&pwd=z;sig=1", "https://h/?X-Amz-Signature=<redacted-credential>&pwd=<redacted-credential>"), ("https://h/x?design=1&monkey=2", "https://h/x?design=1&monkey=2"),
    ("/opt/app/x", "<redacted-path>"), ("in /home and /homer/x", "in <redacted-path> and /homer/x"), ("see C:\\Users\\bob\\f now", "see <redacted-path> now"), ("file:///var/tmp/x", "file://<redacted-path>"), ("/var/lib/x /data/x", "/var/lib/x /data/x"), ("a=/tmp/x,b", "a=<redacted-path>"),
]


def test_redaction(spark):
    df = spark.createDataFrame([(a, b) for a, b in REDACTED], "raw string, want string").select("want", scalar.redacted(F.col("raw")).alias("got"))
    assert [r.got for r in df.collect()] == [b for _, b in REDACTED]


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(scalar.sparkline(F.array(F.lit(1), F.lit(4), F.lit(8), F.lit(0)))) == "▁▄█ " and one(scalar.sparkline(F.array(F.lit(0), F.lit(0)))) == "  "
    assert one(scalar.host_of(F.lit("http://me:pw@evil.example:80/a"))) == "evil.example" and one(scalar.host_of(F.lit("http://[::1]:8080/x"))) == "::1"
    assert one(scalar.url_decision(F.lit("http://x@a.onion/"))) == "blocked_scheme"
    for bad in ("-", "1.5", "x"):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            spark.createDataFrame([(bad,)], "s string").select(scalar.optional_int(F.col("s"))).collect()
    assert scalar.type_text("list<struct<a: int, b: struct<c: x>>>") == "list<struct<...>>" and scalar.type_text("STRUCT(a DECIMAL(1, 2)) x DECIMAL(10, 2)") == "STRUCT(...) x DECIMAL(10, 2)" and scalar.type_text("map<a>") == "map<a>"
    assert one(scalar.lossy_text(F.unhex(F.lit("61ff62")))) == "a\ufffdb"
    import struct

    assert bytes(spark.sql("select 1.5D as a, -2D as b").select(scalar.point_wkb(F.col("a"), F.col("b")).alias("x")).first().x) == struct.pack("<BIdd", 1, 1, 1.5, -2)
    assert spark.sql("select cast(null as double) as a, -2D as b").select(scalar.point_wkb(F.col("a"), F.col("b")).alias("x")).first().x is None
    assert bytes(spark.sql("select array(1D, 2D, 3D, 4D) as a").select(scalar.line_wkb(F.col("a")).alias("x")).first().x) == struct.pack("<BIIdddd", 1, 2, 2, 1, 2, 3, 4)


def test_hydrate_without_the_filter(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(["ftp://x/", None, "https://ok.example/", "https://me@bad.example/"])], "i int, url string")
    fetch = lambda url: (200, "text/plain", url.encode())
    with pytest.raises(ValueError, match="accept the risk"):
        dataset.hydrated(df, "url", fetch, bypass=True)
    got = {r.i: r for r in dataset.hydrated(df, "url", fetch, bypass=True, risk_accepted=True).collect()}
    assert {r.provenance.filter_decision for r in got.values()} == {"allowed_bypass"} and bytes(got[0].content) == b"ftp://x/" and got[1].content is None
    bad = spark.createDataFrame([("bad.example",)], "host string")
    got = {r.i: r.provenance.filter_decision for r in dataset.hydrated(df, "url", fetch, bad, limit=3).collect()}
    assert got == {0: "blocked_scheme", 1: "blocked_scheme", 2: "allowed"}
    assert dataset.hydrated(df, "url", fetch, bad).where("i = 3").first().provenance.filter_decision == "blocked_by_host"


def test_first_files():
    assert readers.first_files(["b", "a", "c"], 2) == ["a", "b"] and readers.first_files(["b", "a"], None) == ["a", "b"]


def test_samples_do_not_depend_on_the_layout(spark):
    df = spark.range(500).selectExpr("id", "map('k', id) as m", "parse_json(cast(id as string)) as v")
    take = lambda x: sorted(r.id for r in profile.sampled(x, 20).collect())
    assert len(take(df)) == 20 and take(df) == take(df.repartition(7)) and profile.sampled(df, 500).count() == 500


def test_histograms_of_many_columns(spark):
    df = spark.range(1000).selectExpr(*[f"cast(id * {k} % 97 as double) as c{k}" for k in range(1, 21)])
    found = profile.profile(df).collect()
    assert len(found) == 20 and all(sum(r["counts"]) == 1000 for r in found)


def test_layout(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "cast(id as string) as s", "array(cast(id as double)) as a")
    assert sinks.layout(df, decoded_bytes=20_000)["parquet.block.row.count.limit"] != sinks.layout(df)["parquet.block.row.count.limit"] == str(sinks.GROUP_ROWS)
    back = sinks.EXPORTERS["parquet"](df.coalesce(1), str(tmp_path / "t"), verify=True, most_rows=1000, statistics_columns=1)
    stats = readers.footers(spark, back).collect()
    assert {r.rows for r in stats} == {1000} and {r.column for r in stats if r.low is not None} == {"id"}
    plain = df.drop("a")
    for fmt in ("orc", "json", "csv"):
        assert sinks.EXPORTERS[fmt](plain, str(tmp_path / fmt), verify=True).count() == 5000


def test_footer_bounds_unknown(spark):
    stats = spark.createDataFrame([("a", 0, 10, "x", 0, 1, "9", "9"), ("a", 1, 10, "x", 0, 1, "10", "10"), ("a", 0, 10, "y", 0, 1, None, None), ("a", 1, 10, "y", 0, 1, "1", "1"), ("a", 0, 10, "z", 10, 1, None, None), ("a", 1, 10, "z", None, 1, "b", "c")], readers._STATS)
    got = {r["column"]: (r.rows, r.nulls, r.low, r.high) for r in readers.footer_summary(stats).collect()}
    assert got == {"x": (20, 0, "9", "10"), "y": (20, 0, None, None), "z": (20, None, "b", "c")}


def test_footers_of_another_store(spark, tmp_path, monkeypatch):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    here = sorted(map(tuple, readers.footers(spark, df).collect()))
    monkeypatch.setattr(readers, "local", lambda files: False)
    assert sorted(map(tuple, readers.footers(spark, df).collect())) == here


def test_asof_and_intervals(spark):
    left = spark.createDataFrame([("a", 1, "l1"), ("a", 5, "l2"), ("b", 5, "l3"), (None, 5, "l4"), ("a", None, "l5")], "k string, t int, v string")
    right = spark.createDataFrame([("a", 0, 10), ("a", 5, 20), ("a", 5, 30), ("a", 9, 40), (None, 1, 50)], "k string, s int, w int")
    assert {r.v: r.w for r in ranges.asof(left, right, ["k"], "t", "s", ["w"]).collect()} == {"l1": 10, "l2": 30, "l3": None, "l4": None, "l5": None}
    points = spark.createDataFrame([(float(i) / 2,) for i in range(-20, 60)] + [(None,)], "p double")
    spans = spark.createDataFrame([("tiny", 1.0, 1.2), ("long", -100.0, 100.0), ("none", 3.0, 3.0), ("mid", 2.5, 9.5), ("null", None, 3.0), ("edge", 0.0, 16.0)], "n string, lo double, hi double")
    got = sorted(map(tuple, ranges.in_intervals(points, spans, "p", "lo", "hi").select("p", "n").collect()))
    want = sorted((i / 2, n) for i in range(-20, 60) for n, lo, hi in (("tiny", 1.0, 1.2), ("long", -100.0, 100.0), ("mid", 2.5, 9.5), ("edge", 0.0, 16.0)) if lo <= i / 2 < hi)
    assert got == want
    assert ranges.in_intervals(points, spans.where("false"), "p", "lo", "hi").count() == 0


def test_required_variant(spark):
    df = spark.sql("select 1 as k, parse_json('null') as v union all select 2, parse_json('{}')")
    assert variant.required(df, ["v"]).count() == 2
    with pytest.raises(Exception, match="required column v"):
        variant.required(df.union(spark.sql("select 3, cast(null as variant)")), ["v"]).select("k").collect()


def test_signed_zeros_in_groups(spark):
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "c double")
    assert compare.tables_equal(one(0.0, -0.0, None, float("nan")), one(-0.0, float("nan"), 0.0, None))
    assert compare.unequal_rows(one(0.0, -0.0), one(0.0, 0.0)).count() == 2


def test_entry_without_the_corpus_operators(tmp_path):
    """The rest stands without them; what is there has to import."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("tablewright", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy)(f"{root}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "tablewright" / "llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sum(n.startswith('op') for n in e.queries()), len(e.queries()) > 100)"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert said.split()[-1] == "True"
