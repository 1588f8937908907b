"""Ledgers that grow, read as a stream, against a batch read; and the append protocol."""

import random

import pytest

from loomshed.session import ship
from loomshed.sources import ledger_stream as stream, records

TOP = "version: 3\n" + "\t".join(records.LEDGER[0]) + "\n"


def line(i, extra=7):
    return "\t".join([str(i), "audit", "v", f"in{i}é", "out", *["x"] * extra]) + "\n"


def test_appends_that_end_in_the_middle_of_a_line(spark, tmp_path):
    ship(spark)
    folder, out, state = tmp_path / "ledgers", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    r = random.Random(3)
    texts = {
        folder / "a.tsv": TOP + "".join(line(i) for i in range(200)),
        folder / "b.tsv": TOP + "".join(line(i, r.choice([5, 6, 7])) for i in range(1000, 1100)) + "soon\tbad\n\n" + line(7),
        folder / "odd.tsv": "version: 9\n" + line(1) + line(2),
        folder / "none.tsv": line(3) * 3,
    }
    at = dict.fromkeys(texts, 0)
    while any(at[f] < len(t.encode()) for f, t in texts.items()):
        for f, t in texts.items():
            data = t.encode()
            step = r.randrange(len(data) // 2 + 2)
            with open(f, "ab") as h:
                h.write(data[at[f] : at[f] + step])
            at[f] = min(at[f] + step, len(data))
        stream.follow(spark, str(folder), out, state, range=700)
    rows, bad = records.read_ledger(spark, str(folder))
    got = stream.told(spark, out)
    assert sorted(map(str, got.drop("manifest").collect())) == sorted(map(str, rows.select(got.drop("manifest").columns).collect()))
    assert got.count() == 301
    reasons = sorted(r.reason for r in stream.told(spark, out, "-rejects").collect())
    assert reasons == sorted(r.reason for r in bad.collect()) and "unknown version" in reasons and "no version" in reasons


def test_a_torn_tail_waits(tmp_path):
    f = tmp_path / "a.tsv"
    f.write_text(TOP + line(1) + line(2)[:9])
    reader = stream.LedgerReader({"path": str(tmp_path)})
    first = reader.latestOffset()
    assert first == {str(f): len((TOP + line(1)).encode())}
    with open(f, "a") as h:
        h.write(line(2)[9:] + "3")
    second = reader.latestOffset()
    got = [r for p in reader.partitions(first, second) for r in reader.read(p)]
    assert [g[2] for g in got] == [line(2)[:-1]] and got[0][4] == "version: 3"


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_ranges_read_each_line_once(tmp_path, monkeypatch, size):
    monkeypatch.setattr(stream, "BLOCK", 11)
    text = TOP + "".join(line(i) for i in range(20)) + "\n" + line(21)
    (tmp_path / "a.tsv").write_text(text)
    reader = stream.LedgerReader({"path": str(tmp_path), "range": str(size)})
    got = [r for p in reader.partitions({}, reader.latestOffset()) for r in reader.read(p)]
    assert [g[2] for g in got] == text.split("\n")[:-1]
    assert [g[1] for g in got][:3] == [0, 1, 2]


def test_a_file_that_shrinks_fails(tmp_path):
    f = tmp_path / "a.tsv"
    f.write_text(TOP + line(1))
    reader = stream.LedgerReader({"path": str(tmp_path)})
    reader.latestOffset()
    f.write_text(TOP)
    with pytest.raises(ValueError, match="shorter"):
        reader.latestOffset()


def test_append_line_keeps_the_protocol(spark, tmp_path):
    f = tmp_path / "l.tsv"
    for i in (1, 2):
        stream.append_line(str(f), {"created": i, "command": "audit", "context": "c"})
    assert f.read_text() == TOP + "1\taudit" + "\t" * 10 + "c\n" + "2\taudit" + "\t" * 10 + "c\n"
    f.write_text(f.read_text()[:-1])  # torn
    stream.append_line(str(f), {"created": 3, "command": "bake"})
    rows, bad = records.read_ledger(spark, str(f))
    assert sorted(r.created for r in rows.collect()) == [1, 2, 3] and bad.count() == 0
    old = tmp_path / "old.tsv"
    old.write_text("version: 1\n" + "\t".join(records.LEDGER[0][:10]) + "\n")
    stream.append_line(str(old), {"created": 5, "command": "x", "context": "dropped"})
    assert old.read_text().endswith("5\tx" + "\t" * 8 + "\n")
    (tmp_path / "odd.tsv").write_text("version: 7\n")
    with pytest.raises(ValueError, match="no known version"):
        stream.append_line(str(tmp_path / "odd.tsv"), {"created": 1})
