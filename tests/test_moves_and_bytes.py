"""Runs of moved rows against patience over rows, bytes that are no UTF-8 through a written report, rows of a database, a source in parts."""

import random
from bisect import bisect_left
from dataclasses import asdict

import pytest

from tallymark import DiffOptions, ReconcileError, Source, compare
from tallymark.operators import moves
from tallymark.operators.moves import moved_rows, staying
from tallymark.options import EmitOptions
from tallymark.plans.header import Header
from tallymark.sources.strict_csv import ParseStats, bytes_of, parse, text_of


def patience(values):
    tops, at, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        tops[p : p + 1], at[p : p + 1] = [v], [i]
        back[i] = at[p - 1] if p else -1
    keep, i = [False] * len(values), at[-1] if at else -1
    while i >= 0:
        keep[i], i = True, back[i]
    return keep


def test_runs_stay_or_go_as_their_rows_do():
    rnd = random.Random(1)
    for _ in range(4000):
        sizes = [rnd.randint(1, 5) for _ in range(rnd.randint(0, 9))]
        order = rnd.sample(range(len(sizes)), len(sizes))
        start = {k: sum(sizes[j] for j in order[:n]) for n, k in enumerate(order)}
        values = [start[i] for i in range(len(sizes))]
        rows = [x for v, n in zip(values, sizes, strict=True) for x in range(v, v + n)]
        expected = patience(rows)
        assert [k for k, n in zip(staying(values, sizes), sizes, strict=True) for _ in range(n)] == expected == staying(rows)


@pytest.mark.parametrize("few", [0, 200_000])
def test_moved_rows(spark, few, monkeypatch):
    monkeypatch.setattr(moves, "FEW", few)
    rnd = random.Random(2)
    for case in range(3):
        t = list(range(400))
        for _ in range(6):  # blocks dragged elsewhere
            a, n, to = rnd.randrange(380), rnd.randint(1, 15), rnd.randrange(380)
            part, t = t[a : a + n], t[:a] + t[a + n :]
            t[to:to] = part
        if case == 2:
            t = t[-1:] + t[:-1]
        keep = patience(t)
        got = {(r.t_idx, r.move_distance) for r in moved_rows(spark.createDataFrame(list(zip(t, range(400), strict=True)), "s_idx long, t_idx long")).collect()}
        assert got == {(i, i - s) for i, (s, k) in enumerate(zip(t, keep, strict=True)) if not k}


def test_text_of_bytes_is_exact():
    rnd = random.Random(3)
    seen = {}
    for raw in [b"\xe9", "\U0010ffe9".encode(), "\U0010ff00\U0010ffff".encode(), *(bytes(rnd.choice(b"a\xe9\xf4\x8f\xbf\xbc\xc3\x80") for _ in range(rnd.randint(0, 7))) for _ in range(3000))]:
        assert bytes_of(text_of(raw)) == raw and seen.setdefault(text_of(raw), raw) == raw


def test_chunks_are_invisible():
    """Records, errors and statistics are the same however the bytes are cut."""
    rnd = random.Random(5)

    def run(data):
        stats, out = ParseStats(), []
        try:
            for record in parse(data, stats=stats):
                out.append(record)
        except ReconcileError as e:
            return out, e.message
        return out, asdict(stats)

    for _ in range(8000):
        data = b"".join(rnd.choice([b"a", b"b", b",", b",", b'"', b'"', b"\n", b"\r", b"\r\n", b" ", b"\t", b"\xef\xbb\xbf"]) for _ in range(rnd.randint(0, 14)))
        cuts = sorted(rnd.randint(0, len(data)) for _ in range(rnd.randint(0, 6)))
        assert run(data) == run([data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)])


def test_written_csv_has_the_bytes_of_its_input(spark, tmp_path):
    head = b"KEY,\n,\nVARCHAR(9),VARCHAR(9)\nid,n\n"
    odd = [b"1,a\xe9b", b"2,\xc3\xa9", "3,\U0010ffe9".encode(), b"4,\xff\xfe"]
    d = compare(spark, Source.bytes(head + b"\n".join(odd)), Source.bytes(head + b"\n".join([b"1,a\xeab", *odd[1:]])), DiffOptions(detect_moves=False))
    d.write(str(tmp_path / "out"), "csv", EmitOptions())
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert d.summary["rows"]["modified"] == 1 and all(x in text for x in (b"a\xe9b", b"a\xeab", b"\xc3\xa9", "\U0010ffe9".encode(), b"\xff\xfe"))


def test_jdbc(spark):
    url, how = "jdbc:derby:memory:tally;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    table = spark.createDataFrame([(2, "b"), (1, "a")], "id int, name string")
    try:
        table.write.jdbc(url, "t", properties=how)
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no database driver here: {type(e).__name__}")
    header = Header.of(("id", "INTEGER", True), "name")
    d = compare(spark, Source.jdbc(spark, url, "t", how, header, ["ID"]), Source.dataframe(table, header, ["id"]))
    assert d.summary["identical"]


def test_one_file_is_one_source(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.csv").write_text("id\n1\n")
    with pytest.raises(ReconcileError) as e:
        compare(spark, Source.csv(str(tmp_path)), Source.csv(str(tmp_path / "a.csv")))
    assert e.value.status == "INVALID_ARG"
