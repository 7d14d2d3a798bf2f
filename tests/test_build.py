import bz2
import gzip
import hashlib

import pytest

from lexigraph.operators import fusion
from lexigraph.plans import stages
from lexigraph.sources import multistream, sqldump
from lexigraph.store import read_dataset, read_json


def dump(path, name, columns, rows, per_line=1):
    def value(v):
        if v is None:
            return "NULL"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    text = f"-- dump\nCREATE TABLE `{name}` (\n" + "".join(f"  `{c}` int,\n" for c in columns) + f"  PRIMARY KEY (`{columns[0]}`)\n) ENGINE=InnoDB AUTO_INCREMENT=77;\n"
    lines = ["(" + ",".join(map(value, r)) + ")" for r in rows]
    groups = [",".join(lines[i : i + per_line]) for i in range(0, len(lines), per_line)]
    if groups:
        text += f"INSERT INTO `{name}` VALUES\n" + ",\n".join(groups) + ";\n"
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write(text)


ODD = ["It's_(a),test", "back\\slash", "new\nline", "plain", "'),(", "a\\'b", "é東"]


@pytest.mark.parametrize("per_line", [1, 3])
def test_dump_values(spark, tmp_path, per_line):
    path = str(tmp_path / "t.sql.gz")
    dump(path, "t", ["a", "b", "c"], [(i, s, None if i % 2 else -5) for i, s in enumerate(ODD)], per_line)
    assert sqldump.header(spark, path) == (["a", "b", "c"], 77)
    got = {r.a: (r.b, r.c) for r in sqldump.rows(spark, path, ["a", "b", "c"], casts={"a": "int", "c": "int"}).collect()}
    assert got == {i: (s, None if i % 2 else -5) for i, s in enumerate(ODD)}
    assert [r.b for r in sqldump.rows(spark, path, ["b"], where=("a", "3")).collect()] == ["plain"]
    with pytest.raises(ValueError, match="no column zz"):
        sqldump.rows(spark, path, ["zz"])


def test_unreadable_rows_fail(spark, tmp_path):
    path = tmp_path / "bad.sql"
    path.write_text("CREATE TABLE `t` (\n  `a` int,\n  `b` int\n) X;\nINSERT INTO `t` VALUES\n(1,2),\n(3);\n")
    with pytest.raises(Exception, match="can't be read"):
        sqldump.rows(spark, str(path), ["a"]).collect()


def test_checksums(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    (tmp_path / "sha1sums.txt").write_text(f"{hashlib.sha1(b'abc').hexdigest()}  x\n{'0' * 40}  y\n")
    (tmp_path / "y").write_bytes(b"abc")
    sqldump.verify(spark, str(tmp_path), ["x"])
    for name in ("y", "z"):
        with pytest.raises(ValueError):
            sqldump.verify(spark, str(tmp_path), [name])


PAGES = [(10, "Waterloo", 0, None, "A '''battle''' near [[Rome]]. See [[Rome]] and [[Tower]].\n== Later ==\n[[Light]]"), (11, "Old name", 0, "Waterloo", "#REDIRECT"), (12, "Light", 0, None, "Bright & <b>fast</b> [[Waterloo]]"), (13, "Talk:Light", 1, None, "x"), (20, "Tower", 0, None, "High. ''[[Light]]'' [[Old name]]"), (21, "Rome", 0, None, "City of [[Missing]]."), (30, "Empty", 0, None, "")]


def article_dump(folder):
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    page = lambda i, t, ns, red, x: f"  <page>\n    <title>{escape(t)}</title>\n    <ns>{ns}</ns>\n    <id>{i}</id>\n" + (f'    <redirect title="{red}" />\n' if red else "") + "    <revision><id>1</id>" + (f'<text xml:space="preserve">{escape(x)}</text>' if x else "<text />") + "</revision>\n  </page>\n"
    data, index = bz2.compress(b"<mediawiki>\n"), []
    for k in range(0, len(PAGES), 2):
        index += [f"{len(data)}:{p[0]}:{p[1]}" for p in PAGES[k : k + 2]]
        data += bz2.compress("".join(page(*p) for p in PAGES[k : k + 2]).encode())
    (folder / "pages.xml.bz2").write_bytes(data + bz2.compress(b"</mediawiki>\n"))
    (folder / "index.txt.bz2").write_bytes(bz2.compress("\n".join(index).encode()))


def test_article_dump(spark, tmp_path):
    article_dump(tmp_path)
    pages = multistream.pages(spark, str(tmp_path / "pages.xml.bz2"))
    assert {r.page_id: (r.title, r.ns, r.redirect, r.text) for r in pages.collect()} == {p[0]: p[1:] for p in PAGES}
    index = multistream.index(spark, str(tmp_path / "index.txt.bz2"))
    assert {r.page_id: r.stream for r in index.collect()} == {p[0]: k // 2 for k, p in enumerate(PAGES)}
    kept = multistream.kept(pages)
    assert [r.page_id for r in multistream.first(kept, index, 3).collect()] == [10, 12, 20]
    assert multistream.kept(pages, None, True).count() == len(PAGES) and multistream.fetch(pages, [20]).first().title == "Tower"


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    folder = tmp_path_factory.mktemp("dump")
    article_dump(folder)
    title = {p[1]: p[0] for p in PAGES}
    dump(folder / "page.sql.gz", "page", ["page_id", "page_namespace", "page_title", "page_is_redirect", "page_len"], [(p[0], p[2], p[1].replace(" ", "_"), int(bool(p[3])), len(p[4])) for p in PAGES])
    dump(folder / "redirect.sql.gz", "redirect", ["rd_from", "rd_namespace", "rd_title", "rd_interwiki"], [(11, 0, "Waterloo", "")])
    names = [p[1] for p in PAGES if not p[2]] + ["Missing"]
    dump(folder / "linktarget.sql.gz", "linktarget", ["lt_id", "lt_namespace", "lt_title"], [(i, 0, n.replace(" ", "_")) for i, n in enumerate(names)])
    links = [("Waterloo", "Rome"), ("Waterloo", "Tower"), ("Waterloo", "Light"), ("Light", "Waterloo"), ("Tower", "Light"), ("Tower", "Old name"), ("Rome", "Missing"), ("Waterloo", "Old name")]
    dump(folder / "pagelinks.sql.gz", "pagelinks", ["pl_from", "pl_from_namespace", "pl_target_id"], [(title[a], 0, names.index(b)) for a, b in links])
    dump(folder / "geo_tags.sql.gz", "geo_tags", ["gt_id", "gt_page_id", "gt_globe", "gt_primary", "gt_lat", "gt_lon", "gt_dim", "gt_type", "gt_name", "gt_country", "gt_region"], [(1, 21, "earth", 1, 41.9, 12.5, None, "city(2,800,000)", None, "IT", None), (2, 20, "earth", 1, 120.0, 1.0, None, None, None, None, None)])
    dump(folder / "langlinks.sql.gz", "langlinks", ["ll_from", "ll_lang", "ll_title"], [(21, "de", "Rom"), (21, "fr", "Rome")])
    return folder


def test_whole_build(spark, source, tmp_path):
    b = stages.Build(spark, str(source), str(tmp_path / "out"), stages.Settings(tolerance=1e-4, shard_rows=2))
    assert dict(stages.run_all(b)) == {s.name: "skipped" if s.by_hand else "ran" for s in stages.STAGES}
    again = dict(stages.run_all(b))
    assert all(again[s.name] == "done" for s in stages.STAGES if not s.by_hand), again
    runs = read_json(spark, f"{b.target}/runs.json")["runs"]
    assert len(runs) == 2 and runs[0]["seconds"]["core"] > 0 and not runs[1]["seconds"]
    changed = stages.Build(spark, str(source), b.target, stages.Settings(tolerance=1e-3, shard_rows=2))
    assert not any(stages.done(changed, s) for s in stages.STAGES)
    edges = {(r.src, r.dst) for r in b.read("edges").collect()}
    assert edges == {(0, 3), (0, 2), (0, 1), (1, 0), (2, 1), (2, 0)}
    assert {(r.src, r.dst) for r in b.read("edges_in").collect()} == edges
    assert b.read("titles").orderBy("id").first().title in ("Light", "Waterloo")
    place = b.read("places").first()
    assert (place.title, place.type, place.pop, place.langs, place.links) == ("Rome", "city", 2800000, 2, 1)
    assert read_json(spark, f"{b.path('places')}.meta.json")["counts"]["bad_coordinates"] == 1
    leads = {r.title: (r["rank"], r.lead) for r in b.read("leads").collect()}
    assert sorted(r for r, _ in leads.values()) == [0, 1, 2, 3, 4] and leads["Waterloo"][1] == "A battle near Rome. See Rome and Tower."
    prose = {(r.src, r.dst): (r.ord, r.is_lead) for r in b.read("prose_edges").collect()}
    assert prose == {(0, 3): (0, True), (0, 2): (1, True), (0, 1): (2, False), (1, 0): (0, True), (2, 1): (0, True), (2, 0): (1, True)}
    assert {r.src: r.first_link for r in b.read("first_links").collect()} == {0: 3, 1: 0, 2: 0}
    metrics = b.read("metrics")
    assert {r.metric for r in metrics.select("metric").distinct().collect()} == {"pagerank", "reverse", "prose", "indegree"}
    calls = []

    def encode(texts):
        calls.append(len(texts))
        return fusion.hashed(texts)

    assert stages.embed(b) == 3 and stages.embed(b) == 0
    assert stages.embed(b, encode, model="other") == 3
    assert spark.read.parquet(b.path("vectors")).count() == 4  # the empty page has no vector


def test_stops_at_the_first_failure(spark, tmp_path):
    out = stages.run_all(stages.Build(spark, str(tmp_path / "nothing"), str(tmp_path / "out")))
    assert len(out) == 1 and out[0][0] == "core" and out[0][1].startswith("failed")
    lacking = [s for s in stages.STAGES if s.name == "titles"]
    assert "no articles" in stages.run_all(stages.Build(spark, "", str(tmp_path / "out")), lacking)[0][1]


def test_stale_and_missing_data(spark, tmp_path):
    from lexigraph.store import write_dataset

    path = str(tmp_path / "d.parquet")
    with pytest.raises(FileNotFoundError):
        read_dataset(spark, path)
    for rows in (3, 5):
        write_dataset(spark.range(rows), path, {"version": rows})
        assert read_dataset(spark, path, version=rows).count() == rows
    with pytest.raises(RuntimeError):
        read_dataset(spark, path, version=3)
    with pytest.raises(Exception):  # a write that fails leaves what was there
        write_dataset(spark.range(5).selectExpr("1 / (id - 2) AS x", "raise_error('no') AS y"), path, {"version": 7})
    assert read_dataset(spark, path, version=5).count() == 5


def test_settings():
    s = stages.Settings.load("[build]\ndamping = 0.5\nother = 1\n", {"LEXIGRAPH_LEAD_CHARS": "300"})
    assert (s.damping, s.lead_chars) == (0.5, 300) and stages.Settings.load(s.dump()) == s
    with pytest.raises(ValueError):
        stages.Settings.load("[build]\ndamping = 1.5\n")
