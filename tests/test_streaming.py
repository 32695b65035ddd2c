from cairn.sources.catalog import Catalog
from cairn.streaming.arriving import ingest_arriving


def test_arriving(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = Catalog(spark, str(tmp_path / "store"))

    def run():
        query = ingest_arriving(spark, str(tmp_path / "in"), store, str(tmp_path / "seen"))
        query.awaitTermination()
        return sorted(r.label for r in store.list().collect())

    (tmp_path / "in" / "a.dump").write_text("=proc:<0.1.0>\nMemory: 5\n=end\n")
    assert run() == ["a.dump"]
    (tmp_path / "in" / "b.dump").write_text("=proc:<0.1.0>\nMemory: 6\n=proc:<0.2.0>\nMemory: 7\n")
    assert run() == ["a.dump", "b.dump"]
    ids = {r.label: r.dump_id for r in store.list().collect()}
    assert store.open(ids["b.dump"]).processes().count() == 2
