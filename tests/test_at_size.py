"""What keeps a query whole on large tables."""

import io

import pandas as pd
import pytest

from tallymark import compare, laws, registry
from tallymark.operators import match
from tallymark.options import DiffOptions, HeaderLayout
from tallymark.registry import table
from tallymark.sinks import emitters
from tallymark.sources import strict_csv
from tallymark.sources.tables import Source, try_parse_column

SMALL = "/root/testdata/sf0.001"


def test_texts_of_one_small_file_are_parsed_by_many_tasks(spark):
    assert laws.csv_grammar(spark, SMALL).rdd.getNumPartitions() >= 4


def test_records_of_many_texts_stay_with_their_texts(spark):
    most = strict_csv.BATCH
    texts = [(i, f"{i},a\n{i},b" + (",c" if i % 3 == 0 else "")) for i in range(most)]
    texts += [(most, "x\n" * (2 * most + 5) + '"'), (most + 1, None), (most + 2, "")]
    rows = try_parse_column(spark.createDataFrame(texts, "id int, text string").coalesce(1), "text").select("id", "rec", "cells", "status").collect()
    expected = []
    for i in range(most):
        expected += [(i, 1, [str(i), "a"], None), (i, None, None, "RAGGED_ROW") if i % 3 == 0 else (i, 2, [str(i), "b"], None)]
    expected += [(most, n, ["x"], None) for n in range(1, 2 * most + 6)] + [(most, None, None, "UNTERMINATED_QUOTE")]
    assert [tuple(r) for r in rows] == expected


def test_similarity_pairs_is_whole_beyond_the_limits_of_the_reference(spark, monkeypatch):
    rows = lambda: sorted(tuple(r) for r in registry.similarity_pairs(spark, SMALL).collect())
    expected = rows()
    assert len(expected) == table(spark, SMALL, "part").where("p_partkey % 9 = 2").count() > 16
    monkeypatch.setattr(match, "MOST_CELLS", 16)
    assert rows() == expected


def test_pairing_without_limits_looks_at_every_target():
    n = 3000
    rows = [(side, i, [str(i), f"a{i % 7}", side], [str(i), f"a{i % 7}", side]) for side in "st" for i in range(n)]
    left = pd.DataFrame(rows, columns=["side", "idx", "raw", "norm"])
    assert match.likeness_pairs(left, 3, 16, 50, 100)[1]
    assert match.likeness_pairs(left, 3, 16, 50, None) == ([(i, i) for i in range(n)], False)


def test_a_streamed_report_is_read_from_a_file_and_not_from_the_driver(spark):
    found = laws.streamed_report(spark, SMALL)
    assert found.inputFiles() and found.count() > 1500


@pytest.mark.parametrize("piece", [None, 7])
def test_a_report_is_streamed_in_pieces_of_lines(spark, monkeypatch, piece):
    if piece:
        monkeypatch.setattr(emitters, "PIECE", piece)
    one, two = ("".join(f"{i},\xe9{i % k}\n" for i in range(200)).encode("latin-1") for k in (5, 7))
    found, pieces = compare(spark, Source.bytes(one), Source.bytes(two), DiffOptions(header=HeaderLayout(rows=0))), []

    class Kept(io.RawIOBase):
        def write(self, data):
            pieces.append(bytes(data))
            return len(data)

    size = emitters.emit_to(found, Kept(), "csv")
    text = found.emit_text("csv")
    assert size == sum(map(len, pieces)) and b"".join(pieces) == strict_csv.bytes_of(text) and b"\xe9" in b"".join(pieces)
    assert max(map(len, pieces)) <= piece if piece else len(pieces) < len(text.splitlines()) // 4


def test_the_driver_holds_few_rows_of_a_streamed_report(spark, monkeypatch):
    monkeypatch.setattr(emitters, "HELD_ROWS", 20)
    body = "".join(f"{i},x\n" for i in range(1000))
    found, pieces = compare(spark, Source.string(body), Source.string(body), DiffOptions(header=HeaderLayout(rows=0))), []

    class Kept(io.RawIOBase):
        def write(self, data):
            pieces.append(bytes(data))
            return len(data)

    emitters.emit_to(found, Kept(), "csv")
    assert b"".join(pieces).decode() == found.emit_text("csv")
    assert len(pieces) >= 30 and max(p.count(b"\n") for p in pieces) <= 100
