"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns, and no rows."""

import hashlib
import json
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tallymark.llm")
from pyspark.sql import functions as F

from tallymark.llm import chat_format, class_lm, decontamination, embedding_dedup, language_id, mixing, simhash, substring_dedup, token_counts, token_output
from tallymark.llm.components import connected_components
from tallymark.llm.queries import tokenizer

RND = random.Random(8)
WORDS = [f"w{i}" for i in range(50)]
PASSAGE = " ".join(RND.choice(WORDS) for _ in range(60))
COPY = " ".join(RND.choice(WORDS) for _ in range(90))
TEXTS = [None, "", " \t\n", "one", COPY, COPY, COPY.replace("w7", "w8", 1), PASSAGE + " tail a b", "head " + PASSAGE, "a " * 300, "word " * 5000,
    "Ünïcödé ÉTÉ! <|endoftext|> x<|startoftext|>y ǰ J̌ İ", "x" * 3000,
    "The the, tHe."] + [" ".join(RND.choice(WORDS) for _ in range(RND.randint(1, 80))) for _ in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    """doc_id, text, lang, source and columns whose names operators use themselves."""
    rows = [(i * 3, t, ("en", "de", "fr", None)[i % 4], (None, "b", "a", "hot", "hot", "hot")[i % 6], 1, "x", True, 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, key string, kept boolean, m long")


@pytest.fixture(scope="module")
def messy(spark, docs):
    """The same with a repeated row, repeated and null ids."""
    extra = [(0, "again", "en", "a", 1, "x", True, 7), (None, COPY, "de", None, 1, "x", True, 7), (None, None, None, None, 1, "x", True, 7)]
    return docs.union(docs.limit(6)).union(spark.createDataFrame(extra, docs.schema))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_tokens_match_the_library(docs, messy, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer())
    ids = {i * 3: lib.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    got = token_counts.count_tokens(docs, tokenizer(), limit=100).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {i * 3: (len((t or "").encode()), len(ids[i * 3]), len(ids[i * 3]) > 100) for i, t in enumerate(TEXTS)}
    out = {r.doc_id: r for r in token_output.token_output(docs, tokenizer()).collect()}
    start = 0
    for d in sorted(ids):
        whole = [*ids[d], 1]
        assert (out[d].start, out[d].n_tokens, out[d].ids_crc32) == (start, len(whole), zlib.crc32(struct.pack(f"<{len(whole)}I", *whole)))
        start += len(whole)
    assert token_output.token_output(messy, tokenizer()).count() == messy.count() == token_counts.count_tokens(messy, tokenizer()).count()
    assert token_output.token_output(empty, tokenizer()).count() == 0 == token_counts.count_tokens(empty, tokenizer()).count()


def test_rank_merging_on_random_text():
    from tokenizers import Tokenizer

    lib, m, e = Tokenizer.from_file(tokenizer()), token_counts.RankMerger(tokenizer()), token_output.Encoder(tokenizer())
    pieces = [*"aabcdeéßñ'’ \t\n\x1c\x85ΑΣİı①9中é́.,!?_<|>|", "<|endoftext|>", "the", "tion", "'s", "'RE", "  ", "###", "J̌"]
    texts = ["".join(RND.choice(pieces) for _ in range(RND.randint(0, 40))) for _ in range(3000)] + ["a" * 2000, "ab" * 900]
    expected = [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]
    raw = [t.encode() for t in texts]
    assert m.count(raw) == [len(x) for x in expected]
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in e.encode_many(raw)] == expected


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_bit_packing_round_trip(bits, tmp_path):
    ids = np.random.default_rng(bits).integers(0, 2**bits, size=5001, dtype=np.uint64).astype(np.uint32)
    shard = token_output.Shard(token_output.pack_shard([4, None, 9], [0, 5000, 1], ids, bits, 1001))
    assert shard.doc_ids == [4, None, 9] and (shard.ids(0, 5001) == ids).all() and (shard.ids(999, 2005) == ids[999:2005]).all() and (shard.document(2) == ids[-1:]).all() and not len(shard.document(0))
    with pytest.raises(IndexError):
        shard.ids(3, 5002)


def test_export(spark, docs, tmp_path):
    shards = token_output.write_shards(docs, tokenizer(), shard_ids=500)
    assert token_output.export_shards(shards, str(tmp_path)) == shards.count() > 3
    files = sorted(tmp_path.iterdir())
    assert [d for f in files for d in token_output.Shard(f.read_bytes()).doc_ids] == [i * 3 for i in range(len(TEXTS))]


def water_fill(sizes, share=1.5, weights=(3, 1, 2), cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    target, total = dict.fromkeys(names, 0.0), share * sum(sizes.values())
    free = set(names)
    while free and total > 1e-9:
        level = total / sum(w[n] for n in free)
        over = {n for n in free if level * w[n] >= cap * sizes[n]}
        for n in over or free:
            target[n] = cap * sizes[n] if over else level * w[n]
            total -= target[n]
        free -= over or free
    return target


def test_mixing(spark, docs, messy, empty):
    for table in (docs, messy):
        got = mixing.mix(table).collect()
        sizes = Counter()
        for r in table.select("source", "text").collect():
            sizes[r.source] += len((r.text or "").encode().split())
        expected = water_fill(sizes)
        assert len(got) == table.count()
        for s in sizes:
            own = [r for r in got if r.source == s]
            assert all(r.source_size == sizes[s] and abs(r.target - expected[s]) < 1e-6 for r in own) and all(0 <= r.taken <= 2 * r["size"] for r in own)
    many = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 40 AS int)) AS text", "CASE WHEN id % 3 = 0 THEN 's0' ELSE concat('s', id % 7) END AS source")
    first, again = (sorted((r.doc_id, r.taken) for r in mixing.mix(many).collect()) for _ in range(2))
    assert first == again
    for r in mixing.mix(many).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 40
    assert mixing.mixed_rows(many).columns == many.columns and mixing.mix(empty).count() == 0 == mixing.mixed_rows(empty).count()


def test_mixing_deals_equal_rows_one_by_one(spark):
    """1000 equal rows, of which a part is taken twice, reach the target within one document; columns of any name come through."""
    rows = [(7, "a b c", "x", i) for i in range(1000)] + [(i, "w " * (1 + i % 5), "y", i) for i in range(2000, 3500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, b int")
    for name in ("bound", "key", "whole", "_s", "_h", "h", "size"):
        table = table.withColumn(name, F.col("b"))
    got = mixing.mix(table).collect()
    assert len(got) == len(rows)
    for s in "xy":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3 and {r.copies for r in own} <= {0, 1, 2}
    mixed = mixing.mixed_rows(table).collect()
    assert all(r.b == r.bound == r.key == r.whole == r._s == r._h == r.h == r["size"] for r in mixed) and len(mixed) == sum(r.copies for r in got)


def test_mixing_makes_up_for_one_long_document(spark):
    rnd = random.Random(3)
    sizes = [("a", 30_000), *(("a", rnd.randrange(20, 900)) for _ in range(70)), *(("b", rnd.randrange(1, 900)) for _ in range(80)), *(("c", rnd.randrange(1, 900)) for _ in range(80))]
    table = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes)], "doc_id long, source string, n int").selectExpr("doc_id", "source", "repeat('w ', n) AS text")
    rows = mixing.mix(table).collect()
    for s in "abc":
        own = [r for r in rows if r.source == s]
        lack = own[0].target - sum(r.taken for r in own)
        # all documents that could still move toward the target are larger than what lacks
        assert abs(lack) < 900 and all(r["size"] > abs(lack) for r in own if (r.copies < 2 if lack > 0 else r.copies > 0))


def brute_repeats(rows, n=35):
    seen = Counter(tuple(w[i : i + n]) for w in rows for i in range(len(w) - n + 1))
    out = []
    for w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("wide", [0, 1, 256])
def test_substring_dedup(docs, messy, empty, wide, monkeypatch):
    monkeypatch.setattr(substring_dedup.repeated_runs, "__defaults__", (substring_dedup.WINDOW, substring_dedup.ANCHOR, 300, wide))
    for table in (docs, messy):
        rows = [(r.text or "").encode().split() for r in table.select("text").collect()]
        got = substring_dedup.remove_repeats(table)
        assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute_repeats(rows)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup_of_a_phrase_in_ever_new_surroundings(spark, monkeypatch):
    """One minimizer with many different runs: cut anew until the pieces are few, down to windows themselves."""
    monkeypatch.setattr(substring_dedup.repeated_runs, "__defaults__", (substring_dedup.WINDOW, substring_dedup.ANCHOR, 300, 3))
    rnd = random.Random(12)
    fresh = lambda n: [f"q{rnd.randrange(10**9)}" for _ in range(n)]
    phrase = fresh(34)
    texts = [[*fresh(20), *phrase[: rnd.choice((16, 20, 28, 32, 34))], *fresh(20)] for _ in range(40)]
    texts += [[*fresh(3), *phrase, "one", *fresh(2)], [*phrase, "one"], ["one", *phrase], [*fresh(5), "one", *phrase, "two"]]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = substring_dedup.remove_repeats(table)
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute_repeats([[w.encode() for w in t] for t in texts])


def brute_class_scores(rows, held, of, width, unseen, open_classes):
    """log10 probability of every text, straight from the classes of the words."""
    c = Counter(w for d, ws in rows if not held(d) for w in ws)
    cls = lambda w: of[w] if w in of else unseen(w)
    cc, mass, kinds = np.zeros((width, width)), Counter(), Counter()
    for d, ws in rows:
        if not held(d):
            for before, w in zip([b"", *ws], ws, strict=False):
                cc[cls(before), cls(w)] += 1
    for w, n in c.items():
        mass[of[w]] += n
        kinds[of[w]] += 1
    total = sum(mass.values())

    def p(before, k):
        base = (mass[k] + 0.1) / (total + 0.1 * width)
        sent, followers = cc[before].sum(), (cc[before] > 0).sum()
        return (cc[before, k] + followers * base) / (sent + followers) if sent else base

    def emitted(w):
        k = cls(w)
        return (c[w] + 0.1) / (mass[k] + 0.1 * (kinds[k] + (k in open_classes)))

    return [sum(math.log10(p(cls(before), cls(w)) * emitted(w)) for before, w in zip([b"", *ws], ws, strict=False)) for _, ws in rows]


def test_class_lm(docs, messy, empty):
    sizes = {"kept": 20, "tails": 4, "classes": 5}
    for table in (docs, messy):
        rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in table.select("doc_id", "text").collect()]
        held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
        c = Counter(w for d, ws in rows if not held(d) for w in ws)
        total, kinds = sum(c.values()), len(c)
        raw = table.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
        log = []
        found, _ = class_lm.train(raw, log=log, **sizes)
        units = found.units
        of = {w: int(found.of[units([w])[0][0]]) for w in c}
        assert of[b""] == 0 and list(of.values()).count(0) == 1 and 0 not in found.of[1:] and units.first_tail <= 21
        assert log == sorted(log) and len(set(log)) == len(log)  # every round raises the likelihood
        scores = brute_class_scores(rows, held, of, found.width, lambda w: int(found.of[units([w])[0][0]]), set(found.of[units.first_tail :].tolist()))  # noqa: B023
        expected = sorted((str(d), held(d), len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws), 6),
            round(s, 6)) for (d, ws), s in zip(rows, scores, strict=True))
        got = class_lm.score_texts(table, **sizes).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == expected and all(r.train_tokens == total for r in got)
    assert class_lm.score_texts(empty).count() == 0
    nothing = docs.where(class_lm.held_out())  # no row to learn from
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in class_lm.score_texts(nothing).collect())


def test_class_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(4)
    cc, counts, of = rng.integers(0, 4, (5, 5)).astype(float), rng.integers(1, 9, 30), rng.integers(0, 5, 30)
    cc[3] = 0
    kinds, mass, unknown = np.bincount(of, minlength=5), np.bincount(of, weights=counts, minlength=5), np.array([0, 1, 1, 0, 1])
    model = class_lm.ClassModel(cc, kinds, mass, unknown)
    for before in range(5):
        total = sum(10 ** model.transition[before, k] * (sum(counts[of == k] + 0.1) + 0.1 * unknown[k]) / 10 ** model.room[k] if kinds[k] or unknown[k] else 10 ** model.transition[before, k] for k in range(5))
        assert abs(total - 1) < 1e-9


def test_class_lm_gains_are_exact():
    """A unit's gain is the likelihood of the whole table with it in that class."""
    rng = np.random.default_rng(6)
    b, of = rng.integers(0, 5, (12, 12)), rng.integers(1, 4, 12)
    of[0] = 0
    cc = lambda of: np.array([[b[np.ix_(of == i, of == k)].sum() for k in range(4)] for i in range(4)], dtype=float)
    table = class_lm.Table(cc(of))
    for u in range(1, 12):
        near = np.concatenate([np.bincount(of, weights=np.where(np.arange(12) == u, 0, x), minlength=4) for x in (b[u], b[:, u])])
        table.shift(of[u], near, b[u, u], -1)
        gain = table.gains(near, b[u, u])
        true = [class_lm.likelihood(cc(np.where(np.arange(12) == u, k, of))) for k in range(4)]
        assert np.allclose(np.diff(gain[1:]), np.diff(true[1:]))
        table.shift(of[u], near, b[u, u], 1)
    assert (table.cc == cc(of)).all() and (table.sums == np.r_[cc(of).sum(axis=1), cc(of).sum(axis=0)]).all()


def test_class_lm_finds_kinds_of_words(spark):
    """Two kinds of words, each in its own place, are parted, and their bigrams counted as they are."""
    rnd = random.Random(5)
    kinds = [[f"{chr(97 + i % 26)}{i}{k}{rnd.randrange(1000)}" for i in range(30)] for k in ("x", "y")]
    rows = [(1 + 10 * i, f"{w} p q" if k == 0 else f"r s {w}") for i, (k, w) in enumerate((k, w) for k in (0, 1) for w in kinds[k] for _ in range(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("raw"))
    found, texts = class_lm.train(docs, kept=200, tails=7, classes=8)
    classes = [{int(found.of[found.units([w.encode()])[0][0]]) for w in k if w.encode() in found.units.place} for k in kinds]
    assert not classes[0] & classes[1] and found.units.first_tail > 60
    learned = {r.doc_id for r in docs.where(~class_lm.held_out()).select("doc_id").collect()}
    pairs = Counter()
    for d, t in rows:
        if d in learned:
            x = found.units([*t.encode().split(), b""])[0].tolist()
            pairs.update(zip([0, *x[:-1]], x, strict=True))
    got = Counter()
    for batch in class_lm.unit_blocks(texts.where(~class_lm.held_out()), found.units.size, found.units.kind).toArrow().to_batches():
        for block in class_lm.block_bigrams(batch, found.units.size):
            for unit, other, back, n in zip(*(x.tolist() for x in block), strict=True):
                got[(other, unit) if back else (unit, other), int(back)] += n
    assert got == Counter({(p, back): n for p, n in pairs.items() for back in (0, 1)})


def brute_items(words, items, n=13):
    hit, found = [False] * len(words), set()
    for name, item in items:
        size = min(n, len(item))
        for k in range(len(item) - size + 1 if item else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == item[k : k + size]:
                    hit[i : i + size] = [True] * size
                    found.add(name)
    return sum(hit), sorted(found)


def test_decontamination(spark, docs, messy, empty):
    items = [(1, PASSAGE), (2, PASSAGE[:30]), (10, "One"), (3, None), (4, "..."), (5, COPY[40:200]), (6, "a a a"), (None, "w1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [(str(i), decontamination.normal_words((t or "").encode())) for i, t in items if i is not None]
    for table in (docs, messy):
        for shard in (decontamination.SHARD_WORDS, 40):
            got = decontamination.find_items(table, bench, shard_words=shard).collect()
            for r in got:
                words = decontamination.normal_words((r.text or "").encode())
                assert (sum(s.stop - s.start for s in r.spans), list(r["items"]), r.n_words) == (*brute_items(words, named), len(words))
    out = {r.doc_id: r for r in decontamination.decontaminate(docs, bench).collect()}
    assert out[24].contaminated and out[24].clean_text.strip() == "head" and out[0].clean_text is None and not out[3].contaminated
    assert decontamination.decontaminate(empty, bench).count() == 0 and decontamination.find_items(docs, bench.where("false")).where("size(spans) > 0").count() == 0


def test_decontamination_counts_items_without_id(spark):
    docs = spark.createDataFrame([(1, "head " + PASSAGE), (2, "other words")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, PASSAGE), (7, " ".join(PASSAGE.split()[:5]))], "item_id long, text string")
    named = {r.doc_id: (r.n_hit, list(r["items"]), r.contaminated) for r in decontamination.judge(docs, bench.where("item_id is null")).collect()}
    assert named == {1: (60, [None], True), 2: (0, [], False)}
    assert {r.doc_id: list(r["items"]) for r in decontamination.judge(docs, bench).collect()} == {1: ["7", None], 2: []}


def test_chat_format(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", '{"tool_calls":[{"id":"a","name":"f","arguments":{"x":1,"y":"$b"}},{"id":"b","name":"f","arguments":{"x":"zz"}}]}'),
            (1, 2, "tool", '{"tool_call_id":"b","content":"é\\n"}'), (1, 3, "tool", '{"tool_call_id":"a","content":"2"}'),
        (1, 4, "tool", '{"tool_call_id":"a","content":"late"}'),
            (2, 1, "assistant", '{"tool_calls":[{"id":"p","name":"f","arguments":{"x":1,"y":"$q"}},{"id":"q","name":"f","arguments":{"x":1,"y":"$p"}},{"id":"r","name":"g","arguments":{}}]}'), (2, 0, "tool", '{"tool_call_id":"p","content":"early"}'),
        (None, None, "user", None), (3, 0, "assistant", "{broken"), (3, 0, "assistant", "{broken"), (3, 1, None, ""),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash"))
    tools = {"f": {"required": ["x"], "properties": {"x": "integer", "y": "string"}}}
    got = chat_format.link_tool_calls(turns, tools).collect()
    by = {(r.conv_id, r.turn, r.item): r for r in got}
    assert len(got) == 14 and [by[1, 1, 0].depth, by[1, 1, 1].depth] == [1, 0] and [by[1, 1, i].valid for i in (0, 1)] == [True, False]
    assert [by[1, t, 0].linked for t in (2, 3, 4)] == [True, True, False] and not by[2, 0, 0].linked and not any(by[2, 1, i].valid for i in range(3))
    order = [(r.kind, r.call_id) for r in sorted((r for r in got if r.conv_id == 1 and r.linked), key=lambda r: tuple(r.ord))]
    assert order == [("call", "b"), ("result", "b"), ("call", "a"), ("result", "a")]
    assert by[1, 1, 0].json == '{"arguments":{"x":"1","y":"$b"},"id":"a","name":"f","role":"assistant"}' and json.loads(by[1, 2, 0].json)["content"] == "é\n"
    assert chat_format.link_tool_calls(turns.where("false"), tools).count() == 0


def test_chat_format_types(spark):
    values = {"string": '"5"', "integer": "5", "number": "1.5", "boolean": "true", "object": '{"b":[1,{"d":2,"c":"x"}],"a":null}', "array": "[1,2]"}
    calls = [(k, v, '{"tool_calls":[{"id":"a","name":"%s","arguments":{"z":%s}}]}' % (k, w)) for k in values for v, w in values.items()]
    turns = spark.createDataFrame([(i, 0, "assistant", c) for i, (_, _, c) in enumerate(calls)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.link_tool_calls(turns, {k: {"required": ["z"], "properties": {"z": k}} for k in values}, typed=True).collect()}
    for i, (kind, value, _) in enumerate(calls):
        assert got[i].valid == (kind == value or (kind, value) == ("number", "integer")), (kind, value)
        assert got[i].json == '{"arguments":{"z":%s},"id":"a","name":"%s","role":"assistant"}' % (json.dumps(json.loads(values[value]), sort_keys=True, separators=(",", ":")), kind)


def test_chat_format_schemas(spark):
    schema = {
        "required": ["o"], "properties": {
            "o": {"type": "object", "required": ["k"],
                "properties": {"k": {"type": "string", "enum": ["x", "y"]}, "n": {"type": "array", "items": {"type": "object", "properties": {"v": "integer"}}}},
                "additionalProperties": False},
            "s": "string", "i": "integer",
        }}
    cases = [
        ({"o": {"k": "x"}}, True), ({"o": {"k": "z"}}, False), ({"o": {}}, False), ({"o": {"k": None}}, False), ({"o": "x"}, False),
            ({"o": {"k": "y", "n": [{"v": 1}, {"v": 2}, {}]}}, True), ({"o": {"k": "y", "n": [{"v": "1"}]}}, False),
        ({"o": {"k": "y", "n": {"v": 1}}}, False), ({"o": {"k": "x", "more": 1}}, False), ({}, False), ({"o": {"k": "x"}, "s": 1}, False),
            ({"o": {"k": "x"}, "i": "$b"}, True), ({"o": {"k": "x"}, "i": "$$b"}, False), ({"o": {"k": "x"}, "s": "$$b"}, True),
        ({"o": {"k": "x"}, "s": "x" * 200_000}, True), ({"o": {"k": "x"}, "s": None}, True), ({"o": {"k": "x"}, "t": 1}, False),
    ]
    turns = spark.createDataFrame([(i, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": a}]})) for i, (a, _) in enumerate(cases)], "conv_id long, turn long, role string, text string")
    for name in ("item", "ord", "c", "depth", "at", "valid", "json"):
        turns = turns.withColumn(name, F.lit(1))
    got = {r.conv_id: r for r in chat_format.link_tool_calls(turns, {"f": schema}, typed=True).collect()}
    assert [got[i].valid for i in range(len(cases))] == [good for _, good in cases]
    assert all(json.loads(got[i].json)["arguments"] == a for i, (a, _) in enumerate(cases))


def test_chat_format_long_chain_and_later_turns(spark):
    call = lambda i, ref: json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": {"x": ref}}]})
    rows = [(1, i, "assistant", call(str(i), f"${i - 1}" if i else "x")) for i in range(68)] + [(2, 0, "assistant", call("a", "$b")), (2, 1, "assistant", call("b", "x"))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.link_tool_calls(turns, {"f": {"properties": {"x": "string"}}}).collect()
    assert all(r.valid for r in got) and [r.depth for r in sorted(got, key=lambda r: r.turn) if r.conv_id == 1] == list(range(68))
    assert [r.call_id for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: tuple(r.ord))] == ["b", "a"]


def test_language_id(spark, empty, messy):
    parts = {"en": ["the", "ing", "and", "wh"], "de": ["sch", "ung", "der", "ß"], "fr": ["eau", "que", "ér", "oi"], "es": ["ción", "que", "ez", "rr"]}
    rows = [(i, None if i % 50 == 0 else " ".join("".join(RND.choice(parts[c]) for _ in range(3)) for _ in range(25)), c) for i,
        c in enumerate(RND.choice(list(parts)) for _ in range(400))] + [(1000, "123 !", "en"), (1001, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = language_id.identify(table, language_id.train(table)).withColumn("h", language_id.held_out()).collect()
    assert {r.lang_pred for r in out if not r.text or r.doc_id == 1000} == {"und"} and all(0 <= r.score <= 1 for r in out)
    judged = [r for r in out if r.h and r.lang_pred != "und"]
    assert len(judged) > 80 and sum(r.lang == r.lang_pred for r in judged) / len(judged) > 0.97
    assert language_id.train(empty) is None and language_id.identify(messy, None).select("lang_pred").distinct().collect()[0][0] == "und" and language_id.identify(empty, None).count() == 0


def test_language_machines_reach_the_optimum():
    """The dual gap of a fitted machine is small."""
    rng = np.random.default_rng(2)
    y = np.where(rng.random(300) < 0.3, 1, -1)
    x = (rng.standard_normal((300, 12)) + 0.8 * y[:, None] * (np.arange(12) < 3)).astype(np.float32)
    w = language_id.fit_svm(x, y).astype(np.float64)
    cost = np.where(y == 1, 4.0 * 300 / (2 * (y == 1).sum()), 4.0 * 300 / (2 * (y == -1).sum()))
    z = np.c_[x, np.ones(300)]
    slack = np.maximum(0, 1 - y * (z @ w))
    alpha = 2 * cost * slack  # what the optimum's conditions say
    u = (alpha * y) @ z
    primal = 0.5 * w @ w + (cost * slack**2).sum()
    dual = alpha.sum() - 0.5 * u @ u - (alpha**2 / (4 * cost)).sum()
    assert 0 <= primal - dual < 0.02 * primal


def test_language_votes_are_as_counted():
    rng = np.random.default_rng(5)
    labels = [("en", "de", "nl", "fr", "es", "xx")[i % 6] for i in range(240)]
    x = rng.random((240, 20)).astype(np.float32) * 0.3
    x[np.arange(240), np.arange(240) % 6] += 1
    model = language_id.LanguageModel(x, labels)
    for row, (lang, score) in zip(x, model.predict(x), strict=True):
        family = max(model.names, key=lambda f: (language_id.margin(row, model.against_rest[model.names.index(f)]), f == f))  # noqa: B023
        codes = model.families[family]
        wins = Counter({c: 0 for c in codes})
        for (a, b), w in model.pairs.items():
            if a in codes:
                wins[a if language_id.margin(row, w) >= 0 else b] += 1
        assert lang in codes and wins[lang] == max(wins.values()) and 0 <= score <= 1


def test_language_labels_are_bounded(spark):
    rows = [(i, f"w{i % 7} text of words", f"l{i % 9}" if i % 3 else "en") for i in range(400)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=3)
    assert len(model.langs) == 3 and "en" in model.langs
    table = spark.createDataFrame([(1, "word " * 300_000, "en"), (2, "", "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred == "und" for r in language_id.identify(table, model).orderBy("doc_id").collect()] == [False, True]


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def test_simhash(spark, docs, messy, empty):
    import xxhash

    def fingerprint(text):
        w = (text or "").encode().lower().split()
        grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for table in (docs, messy):
        rows = [(r.doc_id, fingerprint(r.text)) for r in table.select("doc_id", "text").collect()]
        roots = components(len(rows), lambda i, j: (rows[i][1] ^ rows[j][1]).bit_count() <= 4)  # noqa: B023
        least = {}
        for (d, _), r in zip(rows, roots, strict=True):
            if d is not None:
                least[r] = min(least.get(r, d), d)
        expected = sorted((str(d), f"{f:016x}", str(least.get(r))) for (d, f), r in zip(rows, roots, strict=True))
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(table).collect()) == expected
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_of_large_groups(spark):
    """Groups beyond what a task holds are linked in blocks, and to the same effect."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, size=6, dtype=np.int64)
    fps = sorted({int(b ^ (1 << rng.integers(0, 62)) ^ (1 << rng.integers(0, 62))) for b in base.tolist() for _ in range(60)})
    roots = components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    for held in (20, 20_000):
        links = simhash.fingerprint_links(table, held=held).collect()
        assert all((r.a ^ r.b).bit_count() <= 4 for r in links)
        at = {f: i for i, f in enumerate(fps)}
        linked = {(max(at[r.a], at[r.b]), min(at[r.a], at[r.b])) for r in links}
        assert components(len(fps), lambda i, j: (i, j) in linked) == roots  # noqa: B023


def test_golay_keys_meet():
    rng = np.random.default_rng(3)
    for _ in range(500):
        x = rng.integers(0, 2**63, size=1, dtype=np.int64)
        y = x.copy()
        for b in rng.choice(64, size=rng.integers(0, 5), replace=False):
            y ^= np.uint64(1 << int(b)).view(np.int64) if b < 63 else np.int64(-(2**63))
        assert set(simhash.golay_keys(x)[0].tolist()) & set(simhash.golay_keys(y)[0].tolist())


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1200)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (None, 3)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and len({roots[i] for i in range(1000, 1200)}) == 1 and roots[0] != roots[1000]
    assert connected_components(edges.where("false")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    near = base[:25] + 0.12 * rng.standard_normal((25, 16))
    x = np.r_[base, near, base[:5] * 3, base[:1], base[:1]].astype(np.float32)
    rows = [(i, [float(a) for a in v], 1) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [1.0, 2.0], 1),
        (904, [], 1), (905, [None] * 16, 1), (906, [float("inf")] * 16, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, 0)
    expected = [(i, int((c[i] >= 0.95).sum()), r, r == i) for i, r in enumerate(components(len(x), lambda i, j: c[i, j] >= 0.95))] + [(i, 0, i, True) for i in range(900, 907)]
    assert sorted(tuple(r) for r in embedding_dedup.near_vectors(table).collect()) == sorted(expected)
    assert sorted(tuple(r) for r in embedding_dedup.near_vectors(table, signs=31).collect()) == sorted(expected)  # as planned for 2 ** 31 vectors
    assert sorted(tuple(r) for r in embedding_dedup.near_vectors(table, held=8).collect()) == sorted(expected)  # buckets compared in blocks
    assert embedding_dedup.near_vectors(table.where("false")).count() == 0
    with pytest.raises(ValueError):
        embedding_dedup.near_vectors(table, 0.5)
    # ids that repeat or are missing: every row is judged by its own vector
    ids = [5, 5, 7, 9, None, None, 5]
    vectors = [base[0], base[1], base[0] * 2, base[2], base[1], base[3], base[0]]
    same = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(same).collect())
    assert got == Counter([(5, 2, 5, True), (5, 1, 5, True), (7, 2, 5, False), (9, 0, 9, True), (None, 1, 5, False), (None, 0, None, False), (5, 2, 5, True)])
    for n in (0, 1, 10**6, 10**9, 10**12):
        tables, signs = embedding_dedup.table_plan(n, 0.95)
        assert 2**signs >= n or signs == 40
        assert (1 - (1 - math.acos(0.95) / math.pi) ** signs) ** tables <= embedding_dedup.MISS
