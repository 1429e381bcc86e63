"""Report strings (U unchanged, M modified, A added, D deleted, > moved) and the rest of a comparison."""

import io
import json
import random

import pytest

from tallymark import CompareOptions, DiffOptions, EmitOptions, Header, ReconcileError, Source, compare
from tallymark.operators.moves import staying
from tallymark.sinks import emitters

H = Header.of(("id", "VARCHAR(10)", True, True), ("name", "VARCHAR(20)"), ("qty", "INTEGER"))
NOKEY = Header.of(("id", "VARCHAR(10)"), ("name", "VARCHAR(20)"), ("qty", "INTEGER"))


def rows(ids, **other):
    return [[c, other.get(c, "n"), "1"] for c in ids]


def letters(diff):
    found = sorted(diff.ordered_rows().select("report_pos", "kind", "moved").collect())
    return "".join((">" if m else "") + k[0].upper() for _, k, m in found)


def diff(spark, s, t, options=DiffOptions(), header=H):
    return compare(spark, Source.rows(s, header), Source.rows(t, header), options)


@pytest.mark.parametrize(
    "s,t,expected",
    [
        (rows("abc"), rows("abd", b="changed"), "UMDA"), (rows("abc"), rows("bc"), "DUU"), (rows("abc"), rows("ab"), "UUD"), (rows("abcd"), rows("ad"), "UDDU"),
        (rows("abcdef"), rows("afbcde"), "U>UUUUU"), (rows("ab"), [], "DD"), ([], rows("ab"), "AA"), ([], [], ""),
    ],
)
def test_report_order(spark, s, t, expected):
    assert letters(diff(spark, s, t)) == expected


def test_deletions_at_end_and_unordered(spark):
    assert letters(diff(spark, rows("abc"), rows("ac"), DiffOptions(deleted="end"))) == "UUD"
    d = diff(spark, rows("abc"), rows("cab"), DiffOptions(source_ordered=False))
    assert letters(d) == "UUU" and d.summary["matching"]["movesForcedOff"]


def test_move_distance(spark):
    d = diff(spark, rows("abcdef"), rows("afbcde"))
    assert [r.move_distance for r in d.classified.where("moved").collect()] == [-4]


def test_staying_is_a_longest_increasing_run():
    rnd = random.Random(5)
    for _ in range(300):
        v = rnd.sample(range(40), rnd.randint(0, 25))
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        kept = [x for x, k in zip(v, staying(v)) if k]
        assert kept == sorted(kept) and len(kept) == max(best, default=0)


def test_random_accounting_and_moves(spark):
    """Every row of either side is in the report once; moved rows are those outside one increasing run over the whole sequence."""
    rnd = random.Random(11)
    s = [[f"k{i}", "x", str(i)] for i in range(60)]
    t = [r for r in s if rnd.random() > 0.1]
    for _ in range(6):
        t.insert(rnd.randrange(len(t)), t.pop(rnd.randrange(len(t))))
    t.insert(7, ["new", "x", "0"])
    d = diff(spark, s, t)
    got = d.classified.select("s_idx", "t_idx", "moved").collect()
    assert sorted(r.s_idx for r in got if r.s_idx is not None) == list(range(60)) and sorted(r.t_idx for r in got if r.t_idx is not None) == list(range(len(t)))
    pairs = sorted((r.t_idx, r.s_idx, r.moved) for r in got if r.s_idx is not None and r.t_idx is not None)
    assert [not m for *_, m in pairs] == staying([a for _, a, _ in pairs])


def test_duplicate_keys_name_both_rows(spark):
    with pytest.raises(ReconcileError, match="source has the key id='a' in row 5 and again in row 7") as e:
        diff(spark, rows("aba"), rows("ab"))
    assert e.value.status == "DUPLICATE_KEY"
    with pytest.raises(ReconcileError, match="target"):
        diff(spark, rows("ab"), [["a", "n", "1"], [" a ", "n", "1"]])


def test_suppressed_and_findings(spark):
    d = diff(spark, [["a", "n", "1.50"], ["b", "n", "7"]], [["a", " n", "1.5"], ["b", "n" * 21, "x"]])
    s = d.summary
    assert s["cells"] == {"changed": 2, "suppressed": 2} and s["findings"] == {"total": 3, "rows": 2, "requiredEmpty": 0, "tooLong": 1, "notNumeric": 1, "precision": 1, "enabled": True}


def test_multiset_and_likeness(spark):
    s = [["a", "x", "1"]] * 3 + [["b", "y", "2"], ["c", "z", "3"]]
    t = [["a", "x", "1"]] * 2 + [["b", "y", "9"], ["q", "r", "s"]]
    d = diff(spark, s, t, DiffOptions(detect_moves=False), NOKEY)
    assert d.summary["rows"] == {"unchanged": 2, "modified": 1, "added": 1, "deleted": 2, "moved": 0, "report": 6} and d.summary["matching"]["pairedBySimilarity"] == 1
    d = diff(spark, s, t, DiffOptions(detect_moves=False, similarity=False), NOKEY)
    assert d.summary["rows"]["added"] == 2


def test_column_policy(spark):
    s, t = [["a", "n", "1"]], [["a", "x", "n"]]
    target = Source.rows(t, Header.names_only("id", "extra", "name"))
    with pytest.raises(ReconcileError) as e:
        compare(spark, Source.rows(s, H), target)
    assert e.value.status == "COLUMN_ORDER"
    d = compare(spark, Source.rows(s, H), target, DiffOptions(CompareOptions(allow_added_columns=True, allow_removed_columns=True)))
    assert d.columns == ["id", "name"] and d.summary["identical"] and [f["name"] for f in d.schema_findings] == ["extra", "qty"]
    with pytest.raises(ReconcileError) as e:
        compare(spark, Source.rows(s, H), Source.rows([["n", "1"]], Header.names_only("name", "qty")), DiffOptions(CompareOptions(allow_removed_columns=True)))
    assert e.value.status == "MISSING_KEY_COLUMN"


def test_sources_agree(spark):
    body = 'a,"x, ""y""",1\nb,,2\n'
    head = "KEY,,\nREQUIRED,,\nVARCHAR(10),VARCHAR(20),INTEGER\nid,name,qty\n"
    same = [
        Source.string(head + body), Source.string(body).with_header(H), Source.rows([["a", 'x, "y"', "1"], ["b", None, "2"]], H),
        Source.json_rows('[{"id":"a","name":"x, \\"y\\"","qty":1},{"id":"b","name":null,"qty":2}]', H), Source.dataframe(spark.createDataFrame([("a", 'x, "y"', 1), ("b", None, 2)], "id string, name string, qty int"), H),
        Source.embedded(spark.createDataFrame([(head + body,)], "t string"), "t"),
    ]
    for source in same:
        d = compare(spark, Source.string(head + body), source)
        assert d.summary["identical"] and d.summary["cells"] == {"changed": 0, "suppressed": 0}, source


def test_emitters(spark):
    d = diff(spark, [["a", "<b>", "1"], ["c", "old word", "2"]], [["c", "new word", "2"], ["d", "=1+1\x01", "3"]])
    lines = d.emit_text("jsonl").splitlines()
    parsed = [json.loads(x) for x in lines]
    assert [p["kind"] for p in parsed] == ["deleted", "modified", "added"] and "\\u0001" in lines[2] and parsed[0]["targetRow"] is None
    assert "source" not in parsed[1]["cells"][0] and parsed[1]["cells"][1]["source"] == "old word"
    csv = d.emit_text("csv", EmitOptions(include_values=True))
    assert "\"'=1+1" in csv and csv.count("modified") == 2
    html = d.emit_text("html", EmitOptions(cell_diff="word"))
    assert "<b>" not in html and "&lt;b&gt;" in html and '<del class="tally-del">old</del>' in html
    assert json.loads(d.emit_text("summary")) == d.summary
    out = io.BytesIO()
    assert emitters.emit_to(d, out, "jsonl") == len(out.getvalue()) and out.getvalue().decode() == d.emit_text("jsonl")
    assert len(d.emit_text("jsonl", EmitOptions(max_rows=1, changes_only=True)).splitlines()) == 1
    with pytest.raises(ReconcileError):
        EmitOptions(class_prefix='x" onload="')


def test_present_page_and_next_change(spark):
    d = diff(spark, rows("abcd"), rows("abcd", c="changed"))
    assert d.find_next_change(0) == 2 and d.find_next_change(2) is None and d.page(1, 2).count() == 2
    assert {k: d.present(k).count() for k in ("inline", "stacked", "unified", "sideBySide")} == {"inline": 4, "stacked": 5, "unified": 5, "sideBySide": 8}


def test_cli(spark, tmp_path):
    from tallymark.cli import main

    head = "KEY,\n,\nVARCHAR(5),INTEGER\nid,n\n"
    (tmp_path / "a.csv").write_text(head + "x,1\n")
    (tmp_path / "b.csv").write_text("id,n\nx,2\n")
    out = io.StringIO()
    assert main(["diff", str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], spark, out) == 1 and "modified        1  (1 cells)" in out.getvalue()
    assert main(["diff", str(tmp_path / "a.csv"), str(tmp_path / "a.csv"), "--format", "summary"], spark, out) == 0
    (tmp_path / "c.csv").write_text('id,n\n"x,2\n')
    assert main(["diff", str(tmp_path / "a.csv"), str(tmp_path / "c.csv")], spark, out) == 2
    assert main(["parse", str(tmp_path / "a.csv")], spark, out) == 0


def test_stream_of_snapshots(spark, tmp_path):
    from tallymark.streaming.snapshots import reconcile_stream

    spark.createDataFrame([("a", "n", "1"), ("b", "m", "2")], "id string, name string, qty string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, name string, qty string").parquet(str(tmp_path / "in"))
    seen = []
    q = reconcile_stream(stream, lambda: Source.rows(rows("ac"), H), lambda b: Source.dataframe(b, H, ["id"]), lambda d, n: seen.append((n, d.summary["rows"])), str(tmp_path / "cp"))
    q.awaitTermination()
    assert seen[0][1]["unchanged"] == 1 and seen[0][1]["added"] == 1 and seen[0][1]["deleted"] == 1
