"""op1, op2, op3, op5, op6, op10 and the pipeline against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citegraph.llm import decontaminate, langid, mixing, neardup, queries, reshard, substring
from citegraph.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = [a + b for a in "ka lo mi nu re so ta vu xe zi".split() for b in "bel dor fin gam hot jul".split()]


def make(spark, texts, ids=None, extra=""):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}", len(t or ""), 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + ", n int, key string")


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def bag(text: str) -> Counter:
    w = WORD.findall(text or "")
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else Counter()


def classes_of(texts: dict) -> dict:
    bags, label = {i: bag(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(texts)
    for i in ids:
        for j in ids:
            if i < j:
                both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
                if (texts[i] or "") == (texts[j] or "") or (either and both >= 0.8 * either):
                    a, b = sorted((root(i), root(j)))
                    label[b] = a
    return {i: root(i) for i in ids}


def test_op3_equals_all_pairs(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(12):
        base = rng.choices(WORDS, k=rng.randint(20, 120))
        texts += [" ".join(base)] * rng.randint(1, 3)
        for _ in range(rng.randint(0, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    texts += ["", None, " ", "one two", "one two", "one two three", ("ka lo " * 3000), ("ka lo " * 3001)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(make(spark, texts)).collect()}
    assert got == classes_of(dict(enumerate(texts)))


def test_op3_a_group_around_its_least_member(spark):
    """A chain in one bucket whose ends are not alike is one class all the same."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([f"v{i}_{j}" if j < i * 2 else w for j, w in enumerate(base)]) for i in range(8)]
    got = {r.class_id for r in neardup.near_duplicate_classes(make(spark, texts)).collect()}
    assert got == set(classes_of(dict(enumerate(texts))).values())


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    text = np.repeat([0, 1], 60)
    keep = np.concatenate([a, b]) > 0
    shingles = np.tile(np.arange(60, dtype=np.uint64) * np.uint64(977) + np.uint64(5), 2)
    registers = neardup.signatures(text[keep], shingles[keep], np.concatenate([a, b])[keep], 2, 4096)
    assert abs((registers[0] == registers[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_op3_edges(spark):
    assert neardup.near_duplicate_classes(make(spark, [])).collect() == []
    rows = neardup.near_duplicate_classes(make(spark, ["a b c d e f", "a b c d e f", None, "q"], [None, 4, None, 5])).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in rows) == [("4", "4"), ("5", "5"), ("None", "4"), ("None", "None")]
    # Texts without an id, and several texts of one id, are compared like any other.
    near = [" ".join([f"w{i}" for i in range(60)] + [tail]) for tail in ("p", "q", "r")]
    other = " ".join(f"v{i}" for i in range(30))
    odd = make(spark, [near[0], near[1], near[2], other, other + " x", None], [None, None, 9, 9, None, 9]).withColumnRenamed("key", "text_key").withColumn("class_id", F.lit(1))
    classes = neardup.near_duplicate_classes(odd)
    assert sorted(str(r.class_id) for r in classes.collect()) == ["9"] * 6
    kept = neardup.keep_first(odd, classes)
    assert kept.columns == odd.columns and sorted((r.text or "")[:2] for r in kept.collect()) == ["", "v0", "w0"]
    assert {r.text_key for r in kept.collect()} == {"x"}
    without = make(spark, [near[0], near[1], other], [None, None, None])
    assert neardup.keep_first(without, neardup.near_duplicate_classes(without)).count() == 2
    docs = make(spark, ["a b c d e f"] * 3 + ["z"], [1, 1, 2, 3])
    assert sorted(r.doc_id for r in neardup.keep_first(docs, neardup.near_duplicate_classes(docs)).collect()) == [1, 3]
    assert connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).filter("label <> 0").count() == 0


def strip(texts: list, window: int) -> list:
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_op5_equals_counting(spark, sample):
    rng = random.Random(6)
    passages = [" ".join(rng.choices(WORDS, k=40)) for _ in range(5)]
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 50)))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(passages)[rng.randint(0, 30) :], " ".join(rng.choices(WORDS, k=rng.randint(0, 9)))]
        texts.append(rng.choice([" ", "\n", "\t\x0b"]).join(parts))
    texts += [None, "", "é ß " * 80, "x " * 200, texts[3], texts[3], passages[0]]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.strip_repeats(make(spark, texts)).collect()}
    assert got == dict(enumerate(strip(texts, 35)))
    rows = {r.doc_id: r.text for r in sample.collect()}
    want = dict(zip(rows, strip(list(rows.values()), 35), strict=True))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op5_substring_dedup(spark, SF).collect()} == want
    assert substring.strip_repeats(make(spark, [])).collect() == []


def test_suffix_automata_against_a_reference(spark):
    rng = random.Random(8)
    reference = [" ".join(rng.choices(WORDS[:8], k=60)) for _ in range(6)]
    texts = [" ".join(rng.choices(WORDS[:8], k=50) + reference[i % 6].split()[5:50] + rng.choices(WORDS, k=10)) for i in range(12)] + [None, ""]
    ref = spark.createDataFrame([(r,) for r in [*reference, None]], "text string")
    got = {r.doc_id: [(s.begin, s.end) for s in r.spans] for r in substring.strip_reference(make(spark, texts), ref, 10, 150).collect()}
    grams = {tuple(r.split()[i : i + 10]) for r in reference for i in range(51)}
    for i, t in enumerate(texts):
        w = (t or "").split()
        gone = {j for a in range(len(w) - 9) if tuple(w[a : a + 10]) in grams for j in range(a, a + 10)}
        assert {j for a, b in got[i] for j in range(a, b)} == gone
    assert all(not r.spans for r in substring.strip_reference(make(spark, texts), ref.limit(0), 10).collect())


def test_op1_held_out_accuracy(spark, sample):
    rows = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    odd = make(spark, [None, "", "123 !!", "der und die nicht"])
    model = langid.train(sample)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model, "doc_id").collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3][0] == "de"
    none = langid.train(make(spark, []))
    assert {r.lang_pred for r in langid.predict(odd, none, "doc_id").collect()} == {"und"}


def test_op2_moves_the_fewest_bytes(spark, sample):
    placed, plan = reshard.reshard(sample)
    rows = placed.collect()
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == sample.count()
    total = sum(size.values())
    largest = max(r.size for r in rows)
    assert max(size.values()) - min(size.values()) <= largest
    old = Counter()
    for r in rows:
        old[r.old_shard] += r.size
    assert all(abs(b - total / 16) <= largest for b in size.values())
    least = sum(max(0, old[j] - size[j]) for j in range(16))
    assert sum(r.size for r in rows if r.shard != r.old_shard) == plan.moved and least <= plan.moved <= least + 16 * largest
    texts = {r.doc_id: r.text for r in sample.collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def test_minimum_cost_flow_and_rewriting(spark, tmp_path):
    assert reshard.minimum_cost_flow([5, 0, 7], [4, 4, 4]) == [[4, 1, 0], [0, 0, 0], [0, 3, 4]]
    with pytest.raises(ValueError, match="suffice"):
        reshard.minimum_cost_flow([5], [4])
    docs = make(spark, ["a" * (i % 7) for i in range(60)] + [None])
    _, plan = reshard.reshard(docs, 4, F.lit(0))
    written = reshard.rewrite_affected(docs, plan, str(tmp_path / "out"), F.lit(0))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 61 and {r.shard for r in back.select("shard").distinct().collect()} == set(written)
    assert reshard.reshard(make(spark, []))[0].collect() == []


def goals(sizes: dict) -> dict:
    """Targets by repeated capping."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped: dict = {}
    while True:
        left = sum(sizes.values()) - sum(capped.values())
        free = {s: w for s, w in weight.items() if s not in capped}
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = {s: 3 * sizes[s] for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_op6_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    rows = mixing.mix(docs).collect()
    texts = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == len(texts) and all(r["size"] == len(WORD.findall(texts[r.doc_id].text or "")) for r in rows)
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.taken == r.copies * r["size"] and r.copies in (0, 1, 2, 3) and len(r.parts) == len(r.positions) == r.copies
    want = goals(sizes)
    for s, w in want.items():
        assert abs(taken[s] - w) <= 0.05 * w + 50
    assert all(r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] for r in rows)
    again = {r.doc_id: (r.copies, r.parts, r.positions) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: (r.copies, r.parts, r.positions) for r in rows}
    parts = Counter(p for r in rows for p in r.parts)
    assert len(parts) == 16 and max(parts.values()) < 2 * min(parts.values())
    assert any(len(set(r.parts)) > 1 for r in rows)  # copies of a document go to parts of their own
    out = mixing.repeated(docs)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_op6_cuts_large_blocks(spark, monkeypatch):
    """With tiny blocks allowed, a quota's end is found in blocks of blocks."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    monkeypatch.setattr(mixing, "MOST_ZONE", 8)
    monkeypatch.setattr(mixing, "ZONE", 3)
    sizes, taken, want = Counter(), Counter(), {}
    rows = mixing.mix(docs, blocks=3).collect()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        want[r.source] = r.target
    assert len(rows) == docs.count() and {s: pytest.approx(w) for s, w in goals(sizes).items()} == want
    largest = {r.source: max(x["size"] for x in rows if x.source == r.source) for r in rows}
    assert all(abs(taken[s] - w) <= largest[s] for s, w in want.items())
    assert Counter(r.doc_id for r in mixing.repeated(docs, blocks=3).collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_op6_edges(spark):
    assert mixing.mix(make(spark, [])).collect() == []
    docs = make(spark, [None, "", "a b", "c", "c", "x " * 50_000], [None, 1, 2, 3, 3, 4]).withColumnRenamed("key", "zone")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 6 and sum(r["size"] for r in rows) == 50_004
    got = mixing.repeated(docs)
    assert got.columns == docs.columns and got.count() == sum(r.copies for r in rows)
    assert mixing.repeated(make(spark, [])).collect() == []


def test_op10_catches_other_parameters(spark):
    item = "A farmer named Anna sold 12 apples and 7 pears to Boris for 30 dollars each morning before lunch"
    benchmark = spark.createDataFrame([(1, item), (2, "short text"), (None, item), (3, None)], "item_id long, text string")
    texts = [
        "Intro words here. " + item + " End.", "Some text. A farmer named Clara sold 99 apples and 5 pears to David for 44 dollars each morning before lunch, they say.",
        "clean prose about apples and pears without the passage at all, going on and on for a while", None, "", item.replace("12", "7"), "A farmer named Anna",
    ]
    docs = make(spark, texts)
    found = {r.doc_id: r for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert set(found) >= {0, 1} and not set(found) & {2, 3, 4, 6} and all(r.item_id == 1 for r in found.values())
    assert found[0].n_exact == found[0].n_windows and found[1].n_exact < found[1].n_windows
    assert found[5].n_windows < found[0].n_windows  # two slots that differ in the item are one here
    assert sorted(r.doc_id for r in decontaminate.clean(docs, benchmark).collect()) == [2, 3, 4, 6]
    assert decontaminate.contaminated(make(spark, []), benchmark).collect() == []
    assert decontaminate.contaminated(docs, benchmark.limit(0)).collect() == []


def test_op10_catches_verbatim_copies_of_any_item(spark):
    """Short items, arithmetic, titles, capitals and lists of names have copies too; other values of theirs are other texts."""
    items = ["Compute 12 + 35 * 7 - 4 / 2 + 81", "Name the largest moon", "THE CAPITAL OF FRANCE IS WHICH OF THESE FOUR CITIES THEN", "The Old Man And The Sea Was Written By Ernest Hemingway", "Anna, Boris, Clara, David, Emil, Fiona, Georg, Hanna, Ivan, Julia, Karl", "42"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"they ask, {t}, and go on" for t in items] + ["they ask, Compute 13 + 36 * 8 - 5 / 3 + 82, and go on", "Name the smallest moon", "Otto, Paula, Quirin, Rosa, Stefan, Tina, Udo, Vera, Willi, Xenia, Yann"]
    got = {(r.doc_id, r.item_id, r.n_windows == r.n_exact) for r in decontaminate.contaminated(make(spark, texts), benchmark).collect()}
    assert got == {(i, i, True) for i in range(len(items))}


def test_pipeline_keeps_clean_rows_beside_a_match(spark):
    """Rows without a doc_id, or with a repeated one, are judged each by its own text."""
    item = "the quick brown fox jumps over the lazy dog near the old river bank"
    docs = make(spark, ["so " + item, "a clean text", None, "so " + item, "another clean text", "so " + item], [None, None, None, 7, 7, 8])
    kept = decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and {r.key for r in kept.collect()} == {"x"}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(None, "a clean text"), (None, None), (7, "another clean text")], key=str)


def test_op10_counts_a_window_once(spark):
    """Whole results against a plain rule: a document's window counts once, whatever the item repeats."""
    item = "one two three four five six seven eight nine ten one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = make(spark, ["see one two three four five six seven eight nine ten there", item + " " + item, "nine ten one"])
    got = {(r.doc_id, r.n_windows, r.n_exact) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(0, 1, 1), (1, 31, 31)}
    twice = spark.createDataFrame([(1, item), (1, item + " eleven")], "item_id long, text string")
    assert {(r.doc_id, r.n_windows) for r in decontaminate.contaminated(docs.filter("doc_id = 0"), twice).collect()} == {(0, 1)}


def test_op10_placeholders_of_any_form(spark):
    """Numbers with separators, names of several words, and names that open sentences are one placeholder each."""
    item = "Anna bought 900 crates. Boris sold them for 3 dollars. Clara paid 15 percent of it. David kept the rest until spring came"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [
        "John Smith bought 1,250 crates. Mary sold them for 3.50 dollars. Ann Lee paid 15.5 percent of it. Bob kept the rest until spring came",
        "John bought 7 crates. Mary sold them for 8 dollars. John paid 9 percent of it. Bob kept the rest until spring came",
        "They bought some crates. We sold them for money. People paid part of it. All kept the rest",
    ]
    got = {r.doc_id: r.n_windows for r in decontaminate.contaminated(make(spark, texts), benchmark).collect()}
    assert set(got) == {0, 1}
    assert decontaminate.template(b"A 1,250.75 kg load of John Smith. Mary Ann 7. 8") == ([b"a", b"\x01", b"\x03", b"load", b"of", b"\x02", b"mary", b"\x02", b"\x01", b"\x01"], [b"", b"1,250.75", b"kg", b"", b"", b"john smith", b"", b"ann", b"7", b"8"])


@pytest.mark.parametrize("opening", [False, True])
def test_op10_both_ways_to_a_template_agree(opening):
    rng = random.Random(12)
    parts = ["Ann", "bob", "12", "3.5", "1,000", "kg", "Kg", "mm", ".", ",", "!", " ", " ", " ", "\n", "é", "Éa", "x9", "9x", "Total", "", "A"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))).encode() for _ in range(300)] + [b"", b"Ann", b"5", b"word " * 40_000]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    hashes, first, words, first_word = decontaminate.template_hashes(data, at, opening)
    for i, t in enumerate(texts):
        tokens, values = decontaminate.template(t, opening)
        assert [decontaminate._constant(x) for x in tokens] == hashes[first[i] : first[i + 1]].tolist(), t
        assert [decontaminate._constant(x) for x in decontaminate.plain(t)] == words[first_word[i] : first_word[i + 1]].tolist(), t


def plain_matches(text: str, item: str) -> tuple[int, int]:
    """n_windows and n_exact by comparing all windows with all."""
    sides = [(decontaminate.template(x.encode(), o), decontaminate.plain(x.encode())) for x in (text, item) for o in (False, True)]
    found = []
    for (mine, values), (theirs, slots) in ((sides[0][0], sides[2][0]), (sides[1][0], sides[3][0])):
        n = min(decontaminate.WINDOW, len(theirs))
        good = [b for b in range(len(theirs) - n + 1) if n >= decontaminate.MIN_WINDOW and 2 * sum(t not in (b"\x01", b"\x02", b"\x03") for t in theirs[b : b + n]) >= n]
        found.append(sum(any(mine[j : j + n] == theirs[b : b + n] and decontaminate.consistent(slots[b : b + n], values[j : j + n]) for b in good) for j in range(len(mine) - n + 1)))
    mine, theirs = sides[0][1], sides[2][1]
    n = min(decontaminate.WINDOW, len(theirs))
    exact = sum(any(mine[j : j + n] == theirs[b : b + n] for b in range(len(theirs) - n + 1)) for j in range(len(mine) - n + 1)) if n else 0
    return max(found[0] or found[1], exact), exact


def test_op10_equals_all_windows(spark, sample):
    """Every count of the whole result, and pairs that are not in it, against all pairs of windows."""
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_exact) for r in queries.op10_benchmark_decontamination(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in sample.collect()}
    rng = random.Random(1)
    for doc, item in [*got, *((rng.choice(list(texts)), rng.choice(list(items))) for _ in range(150))]:
        assert got.get((doc, item), (0, 0)) == plain_matches(texts[doc], items[item])


def test_op10_on_the_tables(spark, sample):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = {r.doc_id for r in queries.op10_benchmark_decontamination(spark, SF).collect()}
    planted = {r.doc_id for r in sample.collect() if any(t in r.text for t in items.values())}
    assert planted <= found


def test_pipeline(spark, sample):
    kept = [sample.count()]
    docs = sample
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        kept.append(docs.count())
        if name not in ("sharding",):
            assert docs.columns == sample.columns
        if name == "language_id":
            assert docs.filter("text rlike '[a-z]{4}'").count() >= 0.97 * before.count()
    assert kept[2] < kept[1] and kept[3] <= kept[2] and kept[5] == kept[4]
    assert corpus_pipeline.run(spark, SF).count() == kept[5]


CLASH = ("score", "lang_pred", "text_key", "class_id", "c0", "zone", "shard", "spans", "kept", "item_id", "size", "spot", "__copies")


def test_every_stage_keeps_its_columns_and_clean_rows(spark, sample):
    """Nulls, empty and very long texts, repeated rows and ties, and columns named as a stage names its own."""
    good = sample.filter("lang = 'en'").orderBy("doc_id").limit(30).select("doc_id", "text", "lang", "source", "n_chars")
    long = " ".join(f"{w}{i % 97}" for i, w in enumerate(WORDS * 2000))
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (5000, long, None, "s", None), (5001, "the same words in the house", "en", None, 3), (5001, "the same words in the house", "en", None, 3), (None, "another house of the words", "en", "s", 3)], DOCS)
    docs = good.unionByName(odd)
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("mine"))
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        counts.append(docs.count())
        if name != "sharding":
            assert docs.columns == [*sample.columns, *CLASH] and docs.filter(" or ".join(f"`{c}` <> 'mine'" for c in CLASH)).count() == 0
        if name == "near_dedup":
            ids = [r.doc_id for r in docs.collect()]
            assert ids.count(5001) == 1 and ids.count(None) == 1
    assert counts[1] >= 32 and counts[4] == counts[5] and sorted(docs.columns) == ["doc_id", "old_shard", "shard", "size", "slot", "text_crc32"]
    empty = sample.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []


def slow_mix(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
    return x ^ (x >> 31)


def slow_counts(text: str) -> Counter:
    """Features of one text, one n-gram after the other."""
    folded = []
    for c in text:
        low = c.lower() if c.isalpha() and len(c.lower()) == 1 else c
        if c.isalpha():
            folded.append(ord(low) if ord(c) < 1 << 16 else ord(c))
        elif folded and folded[-1]:
            folded.append(0)
    out: Counter = Counter()
    for n in langid.GRAMS:
        for i in range(len(folded) - n + 1):
            if n > 1 or folded[i]:
                key = n
                for x in folded[i : i + n]:
                    key = (key * 0x100000001B3 + x) % 2**64
                out[slow_mix(key) >> 51] += 1
    return out


def test_op1_features_and_learning_equal_plain_loops():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abÄß ñ.\n1Éé😀𐐀Z", k=rng.randint(0, 60))) for _ in range(150)] + ["", "x " * 100_000]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    text, feature, count, letters = langid.counts(data, at)
    for i, t in enumerate(texts):
        mine = text == i
        assert dict(zip(feature[mine].tolist(), count[mine].tolist(), strict=True)) == slow_counts(t) and letters[i] == sum(c.isalpha() for c in t)
    # FTRL, one coordinate at a time.
    rows = [(np.array(sorted(rng.sample(range(12), 4))), np.array([rng.random() for _ in range(4)]), rng.randrange(3)) for _ in range(40)]
    w, b = langid.fit_ftrl(rows, 3, epochs=2)
    z, n = defaultdict(float), defaultdict(float)

    def weight(f, k):
        l1 = 0.0 if f == langid.FEATURES else 0.02
        return 0.0 if abs(z[f, k]) <= l1 else -(z[f, k] - np.sign(z[f, k]) * l1) / ((1 + n[f, k] ** 0.5) / 0.5 + 0.1)

    for _ in range(2):
        for f, v, label in rows:
            cells = [*zip(f.tolist(), v.tolist(), strict=True), (langid.FEATURES, 1.0)]
            now = {(x, k): weight(x, k) for x, _ in cells for k in range(3)}
            sums = [np.exp(sum(now[x, k] * y for x, y in cells)) for k in range(3)]
            for x, y in cells:
                for k in range(3):
                    g = y * (sums[k] / sum(sums) - (k == label))
                    z[x, k] += g - ((n[x, k] + g * g) ** 0.5 - n[x, k] ** 0.5) / 0.5 * now[x, k]
                    n[x, k] += g * g
    assert np.allclose(b, [weight(langid.FEATURES, k) for k in range(3)]) and np.allclose(w[:12], [[weight(x, k) for k in range(3)] for x in range(12)]) and not w[12:].any()
    # The temperature has the least loss of a fine grid.
    logits, labels = np.array([[rng.gauss(0, 4) for _ in range(3)] for _ in range(60)]), np.array([rng.randrange(3) for _ in range(60)])

    def loss(t):
        return -np.log(langid._softmax(logits / t)[np.arange(60), labels]).mean()

    assert loss(langid._temperature(logits, labels)) <= min(loss(t) for t in np.exp(np.arange(-3.9, 3, 0.05))) + 1e-4


def test_op1_edges(spark, sample):
    """Repeated rows, very long texts and an empty table to predict; too many languages are an error."""
    model = langid.train(sample)
    rows = make(spark, ["der und die nicht"] * 2 + ["the house of the people and " * 20_000], [1, 1, 2])
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(rows, model, "doc_id").orderBy("doc_id").collect()]
    assert got[0] == got[1] and got[0][1] == "de" and got[2][1] == "en"
    assert langid.predict(rows.limit(0), model, "doc_id").collect() == []
    with pytest.raises(ValueError, match="columns"):
        langid.predict(rows.withColumn("score", F.lit(1)), model, "doc_id", "score")
    many = spark.range(langid.MAX_LANGUAGES + 1).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="languages"):
        langid.train(many)
