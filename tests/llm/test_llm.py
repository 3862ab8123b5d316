"""Packing, mixing and text quality on small cases, with exact invariants."""

from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from citygrain.llm import mixing, packing, plans, quality, tokens

DATA = Path("/root/testdata/sf0.001")
needs_tokenizer = pytest.mark.skipif(not Path(tokens.TOKENIZER).exists(), reason="no tokenizer file")


@needs_tokenizer
def test_token_counts_are_those_of_whole_texts(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.TOKENIZER, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", " ", "a", "  two  spaces\t\n\n and  tabs ", "it's we'll 'quoted'", "ü ß 漢字 é́ \u00a0x\u2003y", "\r\n\r\n", "x" * 5000, "\\alpha_{6} > 0~\\cite{abc12}.", "1234567 89", "end  ", "\u3000 a", "a\x0b\x0cb \x1c c"]
    count = tokens.token_counter()
    assert [count(t) for t in texts] == [len(whole.encode_ordinary(t)) for t in texts]
    assert count(None) == 0
    table = spark.createDataFrame([(i, t, "n") for i, t in enumerate([*texts, None])], "doc_id long, text string, n_tokens string").drop("n_tokens").selectExpr("*", "'s' source")
    assert [r.n_tokens for r in tokens.with_token_counts(table, ["doc_id", "source"]).orderBy("doc_id").collect()] == [count(t) for t in [*texts, None]]


# ---------------------------------------------------------------- packing


def test_schedule_is_deficit_round_robin():
    rng = np.random.default_rng(3)
    sizes, source = rng.integers(1, 50, 300), rng.integers(0, 3, 300)
    share, carried = np.array([0.5, 0.3, 0.2]), np.array([10.0, -5.0, 0.0])
    got = packing.schedule(sizes, source, share, carried, 100.0)
    queues, deficit = {s: [i for i in range(300) if source[i] == s] for s in range(3)}, carried.copy()
    window, round_ = np.full(300, -1), 0
    while any(queues.values()):
        for s, queue in queues.items():
            deficit[s] += share[s] * 100.0
            while queue and sizes[queue[0]] <= deficit[s] + 1e-9:
                i = queue.pop(0)
                deficit[s] -= sizes[i]
                window[i] = round_
        round_ += 1
    assert got.tolist() == window.tolist()


def test_best_fit_keeps_capacity():
    rng = np.random.default_rng(5)
    size, window = rng.integers(0, 101, 2000), np.sort(rng.integers(0, 10, 2000))
    container, offset, made = packing.best_fit(size, window, 100)
    held = np.bincount(container, size, made)
    assert held.max() <= 100 and held.sum() == size.sum() and made <= 1.03 * size.sum() / 100 + 2
    for c in range(made):
        own = np.flatnonzero((container == c) & (size > 0))
        own = own[np.argsort(offset[own])]
        assert (offset[own] + size[own] <= np.append(offset[own[1:]], 100)).all()
    assert packing.best_fit(np.array([], int), np.array([], int), 10)[2] == 0


def test_pack(spark):
    rng = np.random.default_rng(7)
    sizes = [int(v) for v in rng.integers(0, 120, 400)] + [1000, 100, 100, 0]
    docs = spark.createDataFrame([(i, ["a", "b", None][i % 3], n, "x") for i, n in enumerate(sizes)], "doc_id long, source string, n_tokens long, part string")
    capacities = spark.createDataFrame([(1, 100), (2, 250), (3, 0), (4, None)], "size_id int, capacity_tokens int")
    packed = packing.pack(docs, capacities, part_tokens=6000, window_containers=8)
    rows = packed.collect()
    for size_id, capacity in ((1, 100), (2, 250)):
        own = [r for r in rows if r.size_id == size_id]
        whole = {}
        for r in own:
            assert r.offset + r.n_tokens <= capacity and (r.n_tokens > 0 or sizes[r.doc_id] == 0)
            whole.setdefault(r.doc_id, []).append((r.piece, r.token_from, r.n_tokens))
        assert sorted(whole) == list(range(len(sizes)))
        for i, parts in whole.items():
            assert sum(p[2] for p in parts) == sizes[i]
            assert len(parts) == max(1, -(-sizes[i] // capacity))
            assert [p[1] for p in sorted(parts)] == [k * capacity for k in range(len(parts))]
        held = {}
        for r in own:
            held[r.container_id] = held.get(r.container_id, 0) + r.n_tokens
        assert max(held.values()) <= capacity
    report = {r.size_id: r for r in packing.container_report(packed).collect()}
    assert report[1].tokens == sum(sizes) and report[1].n_texts == len(sizes) and 0 <= report[2].waste_share < 0.1
    assert report[2].n_cut == sum(s > 250 for s in sizes)
    assert packing.pack(docs.limit(0), capacities).count() == 0
    assert packing.pack(docs, capacities.limit(0)).count() == 0


def test_pack_windows_follow_target(spark):
    docs = spark.createDataFrame([(i, "a" if i % 4 else "b", 10 + i % 7) for i in range(6000)], "doc_id long, source string, n_tokens long")
    capacities = spark.createDataFrame([(1, 100)], "size_id int, capacity_tokens int")
    rows = packing.pack(docs, capacities, part_tokens=20_000, window_containers=20).toPandas()
    share = rows[rows.source == "b"].n_tokens.sum() / rows.n_tokens.sum()
    by = rows.assign(part=rows.container_id // 2**32).groupby(["part", "window"]).apply(lambda g: g[g.source == "b"].n_tokens.sum() / g.n_tokens.sum(), include_groups=False)
    full = rows.assign(part=rows.container_id // 2**32).groupby(["part", "window"]).n_tokens.sum() > 1500
    inner = by[full]
    assert len(inner) > 20 and abs(inner.median() - share) < 0.02


def test_packing_rules_and_windows(spark):
    docs = spark.createDataFrame([(i, "a" if i % 4 else "b", 10 + i % 7 + (150 if i % 500 == 0 else 0)) for i in range(6000)], "doc_id long, source string, n_tokens long")
    capacities = spark.createDataFrame([(1, 100), (2, 250)], "size_id int, capacity_tokens long")
    packed = packing.pack(docs, capacities, part_tokens=40_000, window_containers=20).cache()
    rules = [tuple(r) for r in packing.broken_rules(packed, docs).orderBy("size_id").collect()]
    assert rules == [(1, 100, 6000, 0, 0, 0, 0), (2, 250, 6000, 0, 0, 0, 0)]
    moved = packed.selectExpr("size_id", "capacity_tokens", "if(doc_id = 7, 1L, container_id) container_id", "if(doc_id in (7, 8), 1L, offset) offset", "doc_id", "piece", "if(doc_id = 500, token_from + 1, token_from) token_from", "n_tokens", "source", "window").where("not (doc_id = 1000 and piece = 0)")
    broken = packing.broken_rules(moved, docs).where("size_id = 1").first()
    assert broken.overlapping >= 1 and broken.wrongly_cut == 2 and broken.incomplete == 1 and broken.n_texts == 6000
    report = {(r.size_id, r.source): r for r in packing.window_report(packed, 20).collect()}
    assert report[1, "a"].n_windows > 10 and abs(report[1, "a"].mean_share - report[1, "a"].target_share) < 0.02 and report[1, "b"].largest_error < 0.5


# ---------------------------------------------------------------- mixing


def test_mixing_rules(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], 10 + i % 50) for i in range(2000)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([(1, "a", 0.7, 2), (1, "b", 0.3, 2), (1, "none", 0.0, 2), (2, "b", 1.0, 1), (2, "gone", 0.2, 1)], "mix_id int, source string, target_share double, max_repeats int")
    drawn = mixing.draw_mixes(docs, targets)
    assert sorted(map(tuple, mixing.broken_rules(drawn, docs, targets).collect())) == [(1, 2, 0, 0, 0), (2, 1, 0, 0, 0)]
    wrong = drawn.selectExpr("mix_id", "if(mix_id = 2 and doc_id < 100, 'x', source) source", "doc_id", "n_tokens", "if(mix_id = 1 and source = 'a', uses + 1, uses) uses")
    assert sorted(map(tuple, mixing.broken_rules(wrong, docs, targets).collect())) == [(1, 2, 1, 1, 0), (2, 1, 0, 2, 1)]


def test_flight_keeps_sums():
    rng = np.random.default_rng(2)
    p, x = rng.random(500), rng.integers(0, 1000, 500)
    p[:5] = [0, 1, 0, 1, 0]
    moved = mixing.flight(p, x, rng)
    open_ = (moved > 1e-9) & (moved < 1 - 1e-9)
    assert open_.sum() <= 2 and abs(moved.sum() - p.sum()) < 1e-6 and abs((moved * x).sum() - (p * x).sum()) < 1e-3
    assert moved[:5].tolist() == [0, 1, 0, 1, 0]
    same = mixing.flight(np.full(100, 0.3), np.full(100, 7), rng)
    assert abs(same.sum() - 30) < 1e-6
    mean = np.mean([mixing.flight(np.array([0.2, 0.5, 0.6, 0.7, 0.9]), np.array([5, 1, 9, 4, 4]), np.random.default_rng(i)) for i in range(3000)], axis=0)
    assert np.abs(mean - [0.2, 0.5, 0.6, 0.7, 0.9]).max() < 0.04
    assert set(mixing.landing(np.array([0.3, 0.7, 0.5]), rng)) <= {0.0, 1.0}
    assert mixing.flight(np.array([]), np.array([]), rng).tolist() == []


@pytest.mark.parametrize("block", [10_000, 50])
def test_draw_mixes(spark, block):
    rng = np.random.default_rng(1)
    docs = [(i, ["big", "mid", "small"][0 if i % 10 < 7 else 1 if i % 10 < 9 else 2], int(v)) for i, v in enumerate(rng.integers(1, 400, 3000))]
    table = spark.createDataFrame([*docs, (9000, None, 5), (9001, "other", 5)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([(1, "big", 0.5, 2), (1, "mid", 0.3, 1), (1, "small", 0.2, 4), (2, "small", 1.0, 3), (2, "gone", 0.5, 1), (3, "big", 0.0, 1)], "mix_id int, source string, target_share double, max_repeats int")
    drawn = mixing.draw_mixes(table, targets, block)
    rows = drawn.collect()
    cap = {(r.mix_id, r.source): r.max_repeats for r in targets.collect()}
    assert len({(r.mix_id, r.doc_id) for r in rows}) == len(rows)
    assert all(1 <= r.uses <= cap[r.mix_id, r.source] for r in rows)
    assert {r.source for r in rows} == {"big", "mid", "small"}
    report = {(r.mix_id, r.source): r for r in mixing.share_report(drawn, targets).collect()}
    for source, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(report[1, source].actual_share - share) < 0.004
    assert report[2, "small"].most_uses == 3 and report[2, "gone"].actual_share == 0 and report[3, "big"].n_texts == 0
    assert sorted((r.mix_id, r.doc_id, r.uses) for r in mixing.draw_mixes(table, targets, block).collect()) == sorted((r.mix_id, r.doc_id, r.uses) for r in rows)
    assert mixing.draw_mixes(table.limit(0), targets).count() == 0


# ---------------------------------------------------------------- quality

COMMON = "the of and to in is that for with this a one each our el la de que un una cada este nuestro der das ein und ist le les un une chaque".split()
PROSE = "The network confirms the measure of the district and each grid follows this path.\nOne such model is limited by the surface of a lattice, and our index\nholds for the residual that we see.\n"
TABLE = "\\begin{tabular}{lrr}\nalpha & 1.5 & 2 \\\\\nbeta & 2.5 & 3 \\\\\ngamma & 3.5 & 4 \\\\\n\\end{tabular}\n"
FIXED = "".join(f"{w:<12}{i * 7.25:>9.3f}{i * 3:>9}\n" for i, w in enumerate(["density", "node", "lattice", "curve", "operator"]))


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (PROSE, "prose"), (PROSE.replace("\n", "\r\n"), "prose"), (PROSE.replace("\n", "\r"), "prose"), (TABLE, "table"), (FIXED * 3, "table"), ("a,1,2\nb,3,4\nc,5,6\nd,7,8\n" * 5, "table"), ("x\t1\t2\ny\t3\t4\nz\t5\t6\n", "table"), ("| a | 1 |\n| b | 2 |\n| c | 3 |\n", "table"),
        ("1. Each density.\n2. The model.\n3. A grid;\n4. Our path\n", "list"), ("- the grid\n- a node\n- our path\n", "list"), ("\\begin{itemize}\n\\item the grid\n\\item a node\n\\end{itemize}\n", "list"),
        ("@};&<7859<:$$~3!808{_$;98=}@[>={5]}\n.~0^07=+5$[+7\n", "junk"), ("yartan torsi quinu loid xanver baode juna miet\n" * 4, "junk"), ("% " + PROSE.replace("\n", "\n% "), "junk"), ("\\iffalse\n" + PROSE + "\\fi\n", "junk"), ("\\begin{comment}\n" + PROSE, "junk"),
        (PROSE + "% short remark\n" + TABLE, "prose"), ("", "empty"), (" \n\t", "empty"), (None, "empty"), (PROSE * 3000, "prose"), ("\\item " + "The network confirms the measure of the district and the grid.", "prose"), ("50\\% of the grid is in the lattice and the model is one.", "prose"),
    ],
)
def test_kinds(text, kind):
    found = quality.measure(pa.array(["x y", text, PROSE]), quality.common_codes(COMMON))
    assert found["kind"][1] == kind and found["kind"][2] == "prose"
    assert (found["sentence_share"][1] >= 0.5) == (kind == "prose")
    assert all(len(v) == 3 for v in found.values())


def test_long_texts_are_measured_whole(monkeypatch):
    codes = quality.common_codes(COMMON)
    texts = pa.array([PROSE * 30 + TABLE * 30, None, (TABLE + "\n") * 40, PROSE, "x" * 9000, "no end " * 900])
    whole = quality.measure(texts, codes)
    monkeypatch.setattr(quality, "LONG_BYTES", 4000)
    parts = quality.measure(texts, codes)
    assert parts["kind"].tolist() == whole["kind"].tolist() and parts["n_words"].tolist()[:4] == whole["n_words"].tolist()[:4]
    for k in ("sentence_share", "symbol_share", "digit_share", "table_line_share", "common_word_share"):
        assert np.abs(parts[k] - whole[k]).max() < 0.05, k
    assert "".join(quality._parts(PROSE * 200)) == PROSE * 200


def test_long_texts_have_the_statistics_of_the_whole(monkeypatch):
    codes = quality.common_codes(COMMON)
    rng = np.random.default_rng(5)
    bits = [PROSE, TABLE, "\\begin{verbatim}\n", "\\end\n{verbatim}\n", "\\iffalse\n", "\\fi\n", "% " + PROSE.replace("\n", " "), "\n\n", "a.\r\n", "a.\r", "- it is\n", "one   two   six\n", "x" * 1500, "(a). ", "\\", "2) "]
    texts = ["".join(bits[k] for k in rng.integers(0, len(bits), 60)) for _ in range(40)]
    texts += ["\\begin{verbatim}\n" + (PROSE + "\n") * 200 + "\\end{verbatim}\n", "% " + "it is the end of that. " * 400 + "\n" + PROSE, "é\n" * 3000, "\r\n" * 4000, None]
    alone = [quality.measure(pa.array([t], pa.string()), codes) for t in texts]
    monkeypatch.setattr(quality, "LONG_BYTES", 1600)
    parts = quality.measure(pa.array(texts), codes)
    for i, one in enumerate(alone):
        assert {k: parts[k][i] for k in quality.STATISTICS} == {k: one[k][0] for k in quality.STATISTICS}
    assert parts["sentence_share"][40] == 0 and parts["comment_share"][41] > 0.9
    assert all("".join(quality._parts(t)) == t for t in texts if t)


def test_common_words_beyond_the_bound_raise(spark):
    docs, words = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([("a",), ("b",), ("b",)], "word string")
    assert quality.text_statistics(docs, words, max_words=2).count() == 1
    with pytest.raises(ValueError):
        quality.text_statistics(docs, words, max_words=1)


def test_packing_has_all_capacities(spark):
    docs = spark.range(1).selectExpr("id doc_id", "'s' source", "2L n_tokens")
    many = spark.range(1, 1011).selectExpr("cast(id as int) size_id", "id + 8 capacity_tokens")
    assert packing.pack(docs, many).select("size_id").distinct().count() == 1010


def test_measures():
    found = quality.measure(pa.array(["ab cde, 12\nf."]), quality.common_codes(["f"]))
    assert found["n_words"][0] == 3 and found["mean_word_length"][0] == 2 and found["common_word_share"][0] == pytest.approx(1 / 3)
    assert found["symbol_share"][0] == pytest.approx(2 / 10) and found["digit_share"][0] == pytest.approx(2 / 10)
    assert quality.measure(pa.array([], pa.string()), quality.common_codes([]))["n_words"].tolist() == []


def test_statistics_do_not_depend_on_neighbours(spark):
    texts = [PROSE, TABLE, None, FIXED, "", "one.", PROSE + TABLE]
    words = spark.createDataFrame([(w,) for w in [*COMMON, None, ""]], "word string")
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    rows = {r.doc_id: r for r in quality.text_statistics(table, words).collect()}
    alone = [quality.measure(pa.array([t], pa.string()), quality.common_codes(COMMON)) for t in texts]
    for i, one in enumerate(alone):
        assert rows[i].kind == one["kind"][0] and rows[i].sentence_share == pytest.approx(one["sentence_share"][0]) and rows[i].table_line_share == pytest.approx(one["table_line_share"][0])
    assert quality.text_statistics(table.limit(0), words).count() == 0


def test_words_end_with_their_text():
    texts = ["a b", "c d", "the end", "table", "of", "", None, "the", "e\u0301t\u00e9", "\u00c9T\u00c9.", "a.", "b", "x\r", "\ny", "%the", "the\\", "the 50\\", "% of", "\t1", ".2", "a", ". b"]
    codes = quality.common_codes(["the", "of", "\u00e9t\u00e9", "a"])
    alone = [quality.measure(pa.array([t], pa.string()), codes) for t in texts]
    assert [int(a["n_words"][0]) for a in alone[:6]] == [2, 2, 2, 1, 1, 0]
    for cut in range(1, len(texts)):
        for lo, hi in ((0, cut), (cut, len(texts))):
            found = quality.measure(pa.array(texts[lo:hi], pa.string()), codes)
            for i in range(lo, hi):
                assert {k: found[k][i - lo] for k in quality.STATISTICS} == {k: alone[i][k][0] for k in quality.STATISTICS}, texts[i]


def test_characters_are_code_points():
    found = quality.measure(pa.array(["\u6f22\u5b57\u6f22\u5b57", "\u201cab\u201d \u2014 c", "\u00c9T\u00c9 \u00fcber", "a\u00a0b", "\u0661\u0662 x", "continuously"]), quality.common_codes(["\u00e9t\u00e9", "continuously"]))
    assert found["n_words"].tolist() == [1, 2, 2, 2, 1, 1] and found["mean_word_length"].tolist() == [4, 1.5, 3.5, 1, 1, 12]
    assert found["symbol_share"].tolist() == pytest.approx([0, 3 / 6, 0, 0, 0, 0]) and found["digit_share"][4] == pytest.approx(2 / 3)
    assert found["common_word_share"].tolist() == [0, 0, 0.5, 0, 0, 1]


LOG = "".join(f"Overfull box ({i * 7 % 90}.{i}pt too wide) in the paragraph at lines {i}--{i * 3}\nWarning: the reference on page {i} is undefined on the line {i * 11} [{i}].\n" for i in range(1, 8))
OUTLINE = "".join(f"the {a} of the network and its {b}\n        each {b} in the grid with a {a}\n    of the {a}, and for {b}\n" for a, b in zip("surface curve lattice index sensor".split(), "map error measure field noise".split(), strict=True)) + "the end of a list.\n"


@pytest.mark.parametrize(("text", "switch", "off"), [(LOG, "REPEATED_LINES", 10**9), ("We see the grid in a district.\n" + "the global parameter of each scale\n" * 30, "REPEATED_LINES", 10**9), (OUTLINE, "REGULAR", 9.0)])
def test_repetition_and_regularity_decide(monkeypatch, text, switch, off):
    codes = quality.common_codes(COMMON)
    assert quality.measure(pa.array([text]), codes)["sentence_share"][0] < 0.5
    monkeypatch.setattr(quality, switch, off)
    assert quality.measure(pa.array([text]), codes)["sentence_share"][0] > 0.5


def test_markup_shows_by_its_structure():
    sentence = "The network confirms the measure of the district and the grid."
    share = lambda t: quality.measure(pa.array([t]), quality.common_codes(COMMON))["sentence_share"][0]
    for line in ("\\anything{a title of the work with the name of it}", "\\newmacro[x]{\\y}{the of and to}", "\\phantom", "\\unheard{a}{b}{the of the}"):
        assert share(line) == 0 and share(line + "\n" + sentence) == pytest.approx(len(sentence.replace(" ", "")) / len((line + sentence).replace(" ", "")))
    assert share("\\emph{The network} confirms the measure of the district and the grid.") == 1 and share("\\footnote{" + sentence + "}") == 1


def test_a_long_environment_counts_as_one():
    text = "\\begin{verbatim}\n" + (PROSE + "\n") * (6_000_000 // len(PROSE)) + "\\end{verbatim}\n"
    assert len(text) > quality.LONG_BYTES and quality.measure(pa.array([text]), quality.common_codes(COMMON))["sentence_share"][0] == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_batches_do_not_matter():
    folder = str(DATA).replace("sf0.001", "sf0.01")
    texts = pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column("text").combine_chunks()
    codes = quality.common_codes(pq.read_table(f"{folder}/common_words.parquet").column("word").to_pylist())
    whole = quality.measure(texts, codes)
    for i in range(len(texts)):
        one = quality.measure(texts.slice(i, 1), codes)
        assert {k: whole[k][i] for k in quality.STATISTICS} == {k: one[k][0] for k in quality.STATISTICS}


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, name):
    got = plans.QUERIES[name](spark, str(DATA)).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in plans.ORACLES:
        db = duckdb.connect()
        for f in DATA.glob("*.parquet"):
            db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        want = db.execute(plans.ORACLES[name]).df()[list(got.columns)]
        rows = lambda df: sorted(map(tuple, df.astype(float).round(9).to_numpy()))
        assert rows(got) == rows(want)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_agrees_with_hand_labels(spark):
    folder = str(DATA).replace("sf0.001", "sf0.01")
    docs, words, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "common_words", "quality_labels"))
    found = {r.doc_id: r.sentence_share >= 0.5 for r in quality.text_statistics(docs, words).select("doc_id", "sentence_share").collect()}
    votes: dict = {}
    for r in labels.collect():
        votes.setdefault(r.doc_id, []).append(r.label.lower() == "prose")
    agree = [found[i] == (sum(v) * 2 > len(v)) for i, v in votes.items() if sum(v) * 2 != len(v)]
    assert np.mean(agree) > 0.93
