"""Every document is a template, and creates name templates over all of them."""

import duckdb
import pytest

from wikilake.plans.catalog import REGISTRY
from wikilake.plans.oracle import ORACLE
from wikilake.sources import fixtures as fx

from conftest import SMALL


def test_every_document_is_a_template(spark):
    ids = {r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()}
    assert {r.name for r in fx.document_templates(spark, SMALL).select("name").collect()} == {f"tpl_{i}" for i in ids}
    named = {r.template for r in REGISTRY["render_document_templates"](spark, SMALL).filter("template_found").collect()}
    assert len(named) > 4 and named <= {f"tpl_{i}" for i in ids}


@pytest.mark.parametrize("name", ["load_document_templates", "render_document_templates", "fill_document_templates"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    mine = REGISTRY[name](spark, SMALL)
    theirs = con.sql(ORACLE[name])
    assert mine.columns == theirs.columns
    assert sorted(map(tuple, mine.collect())) == sorted(theirs.fetchall())


def test_many_templates_are_few_files(spark, tmp_path):
    from wikilake.sources import files as FS

    path = tmp_path / "t"
    tpl = spark.createDataFrame([(f"n{i}", f"# {i}\n\n\"é\"") for i in range(500)] + [("0123", None)], "name string, body string").repartition(3)
    FS.write_templates(tpl, str(path))
    assert sum(1 for x in path.rglob("*") if x.is_file() and not x.name.startswith((".", "_"))) <= 24
    assert {r.name: r.body for r in FS.load_templates(spark, str(path)).collect()} == {f"n{i}": f"# {i}\n\n\"é\"\n" for i in range(500)} | {"0123": "\n"}
    own = tmp_path / "own"
    own.mkdir()
    (own / "plan.md").write_text("# Plan\n")
    assert [tuple(r) for r in FS.load_templates(spark, str(own)).collect()] == [("plan", "# Plan\n")]
