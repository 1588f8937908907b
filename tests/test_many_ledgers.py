"""Many small ledgers in few tasks."""

from loomshed.sources import ledger_stream as stream, records


def test_many_small_ledgers_are_few_tasks(tmp_path):
    top = "version: 3\n" + "\t".join(records.LEDGER[0]) + "\n"
    for i in range(200):
        (tmp_path / f"l{i}.tsv").write_text(top + "1\ta\n")
    reader = stream.LedgerReader({"path": str(tmp_path), "range": "50"})
    parts = reader.partitions({}, reader.latestOffset())
    rows = [r for p in parts for r in reader.read(p)]
    assert len(parts) == 1 and len(rows) == 600
